"""Writing results back: generated files, redirect tables, log entries, all-or-nothing changes of a folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections.abc import Iterable
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPERATION = re.compile(r"[A-Za-z]+(?:-[A-Za-z]+)*")
_SECTION = re.compile(r"^## (\d{4}-\d{2}-\d{2})[ \t]*$", re.M)


def changed_files(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """What a writer must do to turn `actual` (rel, content) into `expected` (rel, content): rel, action (write or delete), content; equal files need nothing."""
    both = expected.select("rel", F.col("content").alias("new")).join(actual.select("rel", F.col("content").alias("old")), "rel", "full_outer")
    return both.where(~F.col("new").eqNullSafe(F.col("old"))).select("rel", F.when(F.col("new").isNull(), "delete").otherwise("write").alias("action"), F.col("new").alias("content"))


def commit_files(root: str | Path, changes: Iterable[tuple[str, str | None]], replace=os.replace) -> list[str]:
    """Apply changes (rel, content; None deletes) to the files below root, all or none: on any failure every file is as before. Returns the paths changed.

    Originals are copied aside first, new contents are written beside their targets and then renamed; steps taken are undone in reverse order. A file keeps its byte
    order mark and, if it has any, its CRLF line ends. changes are what a driver writes, a page each; tables are written by their own writers.
    """
    root = Path(root).resolve()
    undo: list[tuple[Path, Path | None]] = []
    done: list[str] = []
    with tempfile.TemporaryDirectory(prefix=".undo-", dir=root) as safe:
        try:
            for i, (rel, content) in enumerate(changes):
                target = (root / rel).resolve()
                if root not in target.parents:
                    raise ValueError(f"{rel} is outside the folder")
                before = target.read_bytes() if target.exists() else None
                copy = None
                if before is not None:
                    copy = Path(safe, str(i))
                    shutil.copy2(target, copy)
                undo.append((target, copy))
                if content is None:
                    target.unlink()
                else:
                    data = content.replace("\r\n", "\n")
                    if before and b"\r\n" in before:
                        data = data.replace("\n", "\r\n")
                    raw = (b"\xef\xbb\xbf" if before and before.startswith(b"\xef\xbb\xbf") else b"") + data.encode()
                    target.parent.mkdir(parents=True, exist_ok=True)
                    beside = target.with_name(f".{target.name}.new")
                    try:
                        beside.write_bytes(raw)
                        replace(beside, target)
                    finally:
                        beside.unlink(missing_ok=True)
                done.append(rel)
        except BaseException:
            for target, copy in reversed(undo):
                if copy is not None:
                    shutil.copy2(copy, target)
                else:
                    target.unlink(missing_ok=True)
            raise
    return done


def write_redirects(moves: DataFrame, folder: str) -> None:
    """A table of redirects (source, path), sorted, as one tab-separated file with a header in a new folder."""
    moves.select("source", "path").orderBy("source").coalesce(1).write.mode("errorifexists").csv(folder, sep="\t", header=True)


def write_new(df: DataFrame, folder: str) -> None:
    """A table into a folder that must not exist yet: it is written to a folder beside and takes its name when complete."""
    spark = df.sparkSession
    staged = f"{folder.rstrip('/')}.staged"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(folder)):
        raise FileExistsError(folder)
    df.write.mode("overwrite").parquet(staged)
    if not fs.rename(path(staged), path(folder)):
        raise OSError(f"cannot name {folder}")


def log_entry(text: str, operation: str, message: str, day: date) -> str:
    """A log with one more entry, under the heading of its day, newest day first; never below a section of a later day.

    operation is one word; line breaks of the message become spaces, so that it makes neither a heading nor an entry of its own.
    """
    if not _OPERATION.fullmatch(operation):
        raise ValueError("the operation must be one word")
    line = " ".join(x.strip() for x in message.splitlines() if x.strip())
    if not line:
        raise ValueError("the message is empty")
    entry = f"* **{operation.capitalize()}**: {line}\n"
    top = _SECTION.search(text)
    if top and top[1] >= day.isoformat():
        head, rest = text[: top.end()], text[top.end() :]
        return f"{head}\n\n{entry}{rest.lstrip(chr(10))}".rstrip("\n") + "\n"
    section = f"## {day.isoformat()}\n\n{entry}"
    if top:
        return (text[: top.start()] + section + "\n" + text[top.start() :]).rstrip("\n") + "\n"
    return (text.rstrip("\n") + "\n\n" + section).lstrip("\n")


def new_page(frontmatter: dict[str, str], title: str, sections: Iterable[str]) -> str:
    """The text of a new page: its frontmatter as YAML, its title, and empty sections."""
    import json

    head = "".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in {**frontmatter, "title": title}.items())
    return f"---\n{head}---\n\n" + "\n\n".join(f"# {s}" for s in sections) + "\n"
