"""Reading a folder of Markdown files with YAML frontmatter, its configuration, and note formats next to it."""

from __future__ import annotations

import html.parser
import json
import os
import re
import subprocess
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.operators.profile import Folder, PageType, Profile

try:
    import yaml
except ImportError:  # only frontmatter and configuration need it
    yaml = None


def load_yaml(text: str) -> Any:
    """YAML with times left as they are written."""
    if yaml is None:
        raise RuntimeError("reading YAML needs the package yaml")

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        pass

    Loader.yaml_implicit_resolvers = {k: [(tag, rx) for tag, rx in v if not tag.endswith(":timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    return yaml.load(text, Loader=Loader)  # noqa: S506


def split_frontmatter(text: str) -> tuple[str | None, int, int, str | None]:
    """The YAML between the first two lines `---`, the offset and the number of lines before the body, and an error; a leading byte order mark is no part of text.

    Without a first line `---` there is none: (None, 0, 0, None). A block that is not closed is an error, and the whole text its body.
    """
    m = re.match(r"---\r*(?:\n|\Z)", text)
    if not m:
        return None, 0, 0, None
    end = re.compile(r"^---\r*$(?:\n|\Z)", re.M).search(text, m.end())
    # `$` also stands before a last line feed, which belongs to the closing line
    if not end:
        return None, 0, 0, "frontmatter block is not closed with '---'"
    return text[m.end() : end.start()], end.end(), text.count("\n", 0, end.start()) + 1, None


def parse_document(text: str) -> dict[str, Any]:
    """A page as has_frontmatter, frontmatter (JSON or None), error, body_offset, body_line, body."""
    text = text.removeprefix("﻿")
    raw, offset, line, error = split_frontmatter(text)
    data: Any = None
    if raw is not None:
        try:
            data = load_yaml(raw)
            data = {} if data is None else data
            if not isinstance(data, dict):
                data, error = None, "frontmatter is not a YAML mapping"
        except yaml.YAMLError as e:
            error = f"unparseable YAML frontmatter: {e}".replace("\n", " ")
    out = json.dumps(data, ensure_ascii=False, default=str) if data is not None else None
    return {"has_frontmatter": raw is not None, "frontmatter": out, "error": error, "body_offset": offset, "body_line": line, "body": text[offset:]}


def list_files(root: str | Path, tracked: bool = False) -> list[str]:
    """Paths of a bundle's files below root, sorted: in a git work tree what git would commit (only what it tracks already, on demand), else every file; nothing below folders with a leading dot, and no symbolic links."""
    root = Path(root)
    names: list[str] | None = None
    try:
        got = subprocess.run(["git", "ls-files", "-z", "--cached", *([] if tracked else ["--others", "--exclude-standard"])], cwd=root, capture_output=True, timeout=60, check=True)
        names = [n for n in got.stdout.decode("utf-8", "surrogateescape").split("\0") if n and (root / n).is_file()]
    except (OSError, subprocess.SubprocessError):
        pass
    if names is None:
        names = [Path(d, f).relative_to(root).as_posix() for d, subs, files in os.walk(root) if not subs.sort() for f in files]
    return sorted({n for n in names if not any(p.startswith(".") for p in n.split("/")[:-1]) and not (root / n).is_symlink()})


def read_bundle(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """The Markdown files of a folder: rel, size, has_frontmatter, frontmatter (JSON), error, body_offset, body_line, body.

    The executors list and read the folder (any file system Spark knows), whole files each; folders with a leading dot are left out. names restricts the result to
    paths, for instance list_files(root). Files that are no UTF-8 are read with replacement characters.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(base)
    at = F.expr("parse_url(path, 'PATH')") if "://" in base else F.regexp_replace("path", "^file:/*", "/")
    where = re.sub(r"^\w+://[^/]*", "", base) if "://" in base else os.path.abspath(base)
    rel = F.substring(F.url_decode(F.replace(at, F.lit("+"), F.lit("%2B"))), len(where) + 2, 1 << 30)
    files = files.select(rel.alias("rel"), F.col("length").alias("size"), "content").where(~F.concat(F.lit("/"), "rel").rlike(r"/\.[^/]*/"))
    if names is not None:
        files = files.join(spark.createDataFrame([(n,) for n in names], "rel string"), "rel", "left_semi")

    return parse_texts(files, "content", ["rel", "size"])


def parse_texts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns keep and the parts of each page's whole text (a string, or its bytes in UTF-8): has_frontmatter, frontmatter (JSON), error, body_offset, body_line, body.

    A null text is an empty one. Whole texts are read; repeated rows stay. No shuffle.
    """
    src = df.select(*keep, F.col(text).alias("__content"))
    schema = ", ".join([*[f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep], "has_frontmatter boolean, frontmatter string, error string, body_offset int, body_line int, body string"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [parse_document(c.decode("utf-8", "replace") if isinstance(c, bytes | bytearray) else c or "") for c in batch.column("__content").to_pylist()]
            own = [pa.array([x[k] for x in docs], t) for k, t in _DOCUMENT.items()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *own], names=[*keep, *_DOCUMENT])

    return src.mapInArrow(parse, schema)


_DOCUMENT = {"has_frontmatter": pa.bool_(), "frontmatter": pa.string(), "error": pa.string(), "body_offset": pa.int32(), "body_line": pa.int32(), "body": pa.string()}


def load_profile(vocabulary: str, taxonomy: str = "", resources: str = "") -> Profile:
    """A profile from the texts of its YAML files."""
    v, t, r = (load_yaml(x) or {} for x in (vocabulary, taxonomy or "{}", resources or "{}"))
    types = {n: PageType(s.get("plural", n), tuple(s.get("folders") or ("*",)), tuple(s.get("required") or ())) for n, s in (v.get("types") or {}).items()}
    folders = {n: Folder(s.get("group") or "", " ".join(str(s.get("title") or "").split()), " ".join(str(s.get("description") or "").split()), s.get("sort") or "", bool(s.get("auto_children"))) for n, s in (t.get("folders") or {}).items()}
    return Profile(types, tuple(v.get("relations") or ()), folders, tuple(t.get("root_groups") or ()), tuple(v.get("fields") or ()), tuple(r.get("roots") or ()), tuple(r.get("deny") or ()))


#: The filters a question may have, and the values some of them take.
FILTERS = {"type": None, "tag": None, "status": ("draft", "stable", "deprecated"), "folder": None, "trust": ("unverified", "machine-confirmed", "human-reviewed")}


def read_questions(text: str) -> tuple[list[dict], list[str]]:
    """The questions of a YAML file (question, expected, filters), and every error in it; whoever uses them must stop at errors."""
    try:
        data = load_yaml(text)
    except yaml.YAMLError as e:
        return [], [f"unparseable YAML: {e}"]
    if data is None:
        return [], []
    if not isinstance(data, dict) or set(data) - {"questions"} or not isinstance(data.get("questions") or [], list):
        return [], ["expected a mapping with one key, `questions`, that holds a list"]
    out, errors = [], []
    for i, q in enumerate(data.get("questions") or [], 1):
        say = lambda text, i=i: errors.append(f"question {i}: {text}")
        if not isinstance(q, dict):
            say("expected a mapping with `question` and `expected`")
            continue
        for k in sorted(set(map(str, q)) - {"question", "expected", "filters"}):
            say(f"unknown key `{k}`")
        if not isinstance(q.get("question"), str) or not q["question"].strip():
            say("`question` must be a non-empty string")
        expected = q.get("expected") if isinstance(q.get("expected"), list) else []
        if not expected:
            say("`expected` must be a non-empty list of /paths")
        if len({str(e) for e in expected}) < len(expected):
            say("an expected page is listed more than once")
        for e in expected:
            if not isinstance(e, str) or not e.startswith("/") or not e.endswith(".md"):
                say(f"expected page {e!r} is not a path such as /folder/page.md")
            elif e.rsplit("/", 1)[-1] == "index.md":
                say(f"expected page {e} is a generated index")
        filters = q.get("filters") or {}
        if not isinstance(filters, dict):
            say("`filters` must be a mapping")
            filters = {}
        for k, x in filters.items():
            if k not in FILTERS:
                say(f"unknown filter `{k}`")
            elif not isinstance(x, str) and not (k == "tag" and isinstance(x, list) and x and all(isinstance(y, str) for y in x)):
                say(f"filter `{k}` must be a string")
            elif x == "":
                say(f"filter `{k}` is empty")
            elif FILTERS[k] and x not in FILTERS[k]:
                say(f"filter `{k}` must be one of {', '.join(FILTERS[k])}")
        out.append({"question": str(q.get("question") or "").strip(), "expected": [e for e in expected if isinstance(e, str)], "filters": filters})
    return out, errors


_PROPERTY = re.compile(r"([A-Za-z][\w./-]*):: ?(.*)")


def read_properties(text: str) -> tuple[dict[str, Any], str]:
    """Page properties in the first lines `key:: value` of a note, and the rest. Page references lose their brackets, tags their mark; tags and aliases are lists; what belongs to a block (id, collapsed) is dropped."""
    props: dict[str, Any] = {}
    lines = text.split("\n")
    n = 0
    for line in lines:
        m = _PROPERTY.fullmatch(line.rstrip("\r"))
        if not m:
            break
        n += 1
        plain = lambda v: re.sub(r"\[\[([^\]]*)\]\]", r"\1", v.strip()).lstrip("#")
        if m[1] not in ("id", "collapsed"):
            props[m[1]] = [plain(v) for v in m[2].split(",") if v.strip()] if m[1] in ("tags", "alias", "aliases") else plain(m[2])
    return props, "\n".join(lines[n:])


# Elements that begin a line of their own, and those whose text is none.
_BLOCKS = set("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer blockquote pre hr".split())
_SILENT = {"script", "style"}


class _Text(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in _SILENT
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.silent -= tag in _SILENT and self.silent > 0
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def html_to_text(page: str | None) -> str | None:
    """The text of an HTML page: no scripts and styles, a line for each block, at most one blank line in a row."""
    if page is None:
        return None
    reader = _Text()
    reader.feed(page)
    reader.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(reader.out)).strip()


@F.udf(StringType(), useArrow=True)
def html_text(page):
    """html_to_text as a column function."""
    return html_to_text(page)
