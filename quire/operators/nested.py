"""Deeply nested records as related flat tables.

Each JSON record is read once by a pull parser that turns it into path-value-ordinal triples. The triples are grouped
by the path of their repeated ancestor (indices taken out), and every group is pivoted into one table whose rows point
to the row of the next object above. A record's triples are all in one place when it has been read, so grouping and pivot need no shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r'[ \t\n\r]*(?:"([^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*)"'
    r"|([{}\[\]:,])|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null)(?![A-Za-z0-9_]))"
)
_SPACE = re.compile(r"[ \t\n\r]*")
#: In a path, keys hold their own dots, brackets and backslashes escaped; an index is never escaped.
_SPECIAL = re.compile(r"[.\[\]\\]")
_STEP = re.compile(r"\\.|\[[0-9]+\]", re.S)

#: (path, parent object path, ordinal in its list or None, kind, value text or None)
Triple = tuple[str, str, int | None, str, str | None]


class _Broken(Exception):
    pass


def _unquote(raw: str) -> str:
    return json.loads(f'"{raw}"') if "\\" in raw else raw


def _escape(key: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", key) if _SPECIAL.search(key) else key


def render(path: str) -> str:
    """A path as people write it: without the escapes, so that a key `a.b` looks like `b` below `a`."""
    return re.sub(r"\\(.)", r"\1", path, flags=re.S) if "\\" in path else path


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at, match = 0, _TOKEN.match
    end = len(text)
    while at < end:
        m = match(text, at)
        if m is None or m.end() == at:
            if _SPACE.fullmatch(text, at):
                return
            raise _Broken(at)
        kind = m.lastindex
        if kind == 1:
            yield "s", m[1]
        elif kind == 2:
            yield m[2], ""
        elif kind == 3:
            yield "n", m[3]
        else:
            yield "l", m[4]
        at = m.end()


def _read(text: str, path: str, owner: str, ordinal: int | None, list_keys: frozenset[str], lone: bool, out: list[Triple]) -> None:
    """Append the triples of the JSON value in text, which stands at path below the object owner.

    lone: a single object read here counts as the first element of a list. Raises _Broken at incomplete JSON.
    """
    # a frame: [is_object, path of the container, owner for what is in it, next index, key or None, first triple by key]
    stack: list[list] = []
    want = "value"  # value | first (value or ]) | key | firstkey (key or }) | colon | after | end
    start = len(out)

    def place() -> tuple[str, str, int | None, bool]:
        """Path, owner, ordinal of the value that comes now; and whether a lone object here is a list of one."""
        if not stack:
            return path, owner, ordinal, lone
        f = stack[-1]
        if f[0]:
            key = f[4]
            return (f"{f[1]}.{key}" if f[1] else key), f[2], None, key in list_keys
        return f"{f[1]}[{f[3]}]", f[2], f[3], False

    def step() -> None:
        nonlocal want
        if stack:
            if not stack[-1][0]:
                stack[-1][3] += 1
            want = "after"
        else:
            want = "end"

    for kind, raw in _tokens(text):
        if want == "end":
            raise _Broken
        if want == "colon":
            if kind != ":":
                raise _Broken
            want = "value"
        elif want in ("key", "firstkey"):
            f = stack[-1]
            if kind == "s":
                f[4] = key = _escape(_unquote(raw))
                if key in f[5]:  # a repeated key: the last one holds, as in every common reader
                    gone = f"{f[1]}.{key}" if f[1] else key
                    out[f[5][key] :] = [t for t in out[f[5][key] :] if not (t[0] == gone or t[0].startswith((gone + ".", gone + "[")))]
                else:
                    f[5][key] = len(out)
                want = "colon"
            elif kind == "}" and want == "firstkey":
                stack.pop()
                step()
            else:
                raise _Broken
        elif want == "after":
            f = stack[-1]
            if kind == ",":
                want = "key" if f[0] else "value"
            elif kind == ("}" if f[0] else "]"):
                stack.pop()
                step()
            else:
                raise _Broken
        elif kind == "{":
            p, o, n, alone = place()
            if alone:
                p, n = f"{p}[0]", 0
            if p or stack:
                out.append((p, o, n, "object", None))
            stack.append([True, p, p, 0, None, {}])
            want = "firstkey"
        elif kind == "[":
            p, o, n, _ = place()
            stack.append([False, p, o, 0, None, None])
            want = "first"
        elif kind == "]" and want == "first":
            stack.pop()
            step()
        elif kind == "s":
            p, o, n, alone = place()
            value = _unquote(raw)
            head = value.lstrip(" \t\n\r")[:1]
            if stack and head and head in "{[" and value.rstrip(" \t\n\r")[-1] in "}]":
                mark = len(out)
                try:
                    _read(value, p, o, n, list_keys, alone, out)
                except _Broken:
                    del out[mark:]
                    out.append((p, o, n, "string", value))
            else:
                out.append((p, o, n, "string", value))
            step()
        elif kind == "n" or kind == "l":
            p, o, n, _ = place()
            out.append((p, o, n, "number" if kind == "n" else "null" if raw == "null" else "boolean", None if raw == "null" else raw))
            step()
        else:
            raise _Broken
    if want != "end":
        del out[start:]
        raise _Broken


def record_triples(text: str | None, list_keys: Iterable[str] = ()) -> list[Triple] | None:
    """Triples of one record, in the order of the text; None unless text is one complete JSON object. Paths have escaped keys, see render."""
    if not text or text.lstrip(" \t\n\r")[:1] != "{":
        return None
    out: list[Triple] = []
    try:
        _read(text, "", "", None, frozenset(map(_escape, list_keys)), False, out)
    except _Broken:
        return None
    return out


def group_of(path: str) -> str:
    """The path without list indices: sources[3].author[0] -> sources[].author[]."""
    return _STEP.sub(lambda m: m[0] if m[0][0] == "\\" else "[]", path)


def nested_triples(df: DataFrame, record: str, text: str, list_keys: Sequence[str] = (), kinds: Sequence[str] | None = None, groups: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The triples of every readable record: record, keep..., path, parent_path, ordinal, kind, value, grp.

    df: any table; record names its id column, text the JSON column. Records that are null, empty, cut off, or no object give
    nothing. path joins keys with '.', a list element is key[i] from 0, null elements counted; parent_path is the path
    of the next object above ('' at the root); both are rendered. Values of list_keys are lists: a lone object there is key[0]. A string
    that is itself JSON text of an object or list is read as that, at any depth. Of a repeated key the last one holds.
    ordinal is the index of a list element, else null; kind is object, string, number, boolean or null; grp is
    path without indices. kinds and groups keep only such triples (checked in the parser, before they leave the worker).
    Columns in keep pass through unchanged. Repeated rows give repeated triples. No shuffle.
    """
    own_kinds = frozenset(kinds) if kinds else None
    own_groups = frozenset(groups) if groups is not None else None
    head = [F.col(record).alias("record"), F.col(text).cast("string").alias("__text"), *[F.col(c) for c in keep]]
    src = df.select(*head)
    schema = [f"record {src.schema['record'].dataType.simpleString()}", *[f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep], "path string", "parent_path string", "ordinal int", "kind string", "value string", "grp string"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str] = {}
        for batch in batches:
            at: list[int] = []
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            add = [c.append for c in cols]
            for i, s in enumerate(batch.column("__text").to_pylist()):
                for t in record_triples(s, list_keys) or ():
                    if own_kinds is not None and t[3] not in own_kinds:
                        continue
                    g = cache.get(t[0])
                    if g is None:
                        if len(cache) > 200_000:
                            cache.clear()
                        g = cache[t[0]] = group_of(t[0])
                    if own_groups is not None and g not in own_groups:
                        continue
                    at.append(i)
                    for f, v in zip(add, (render(t[0]), render(t[1]), t[2], t[3], t[4], g)):
                        f(v)
            take = pa.array(at, pa.int32())
            kept = [batch.column(c).take(take) for c in ("record", *keep)]
            own = [pa.array(c, pa.int32() if k == 2 else pa.string()) for k, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([*kept, *own], names=["record", *keep, "path", "parent_path", "ordinal", "kind", "value", "grp"])

    return src.mapInArrow(parse, ", ".join(schema))


#: Columns of nested_rows after the record and what is kept.
ROW_SCHEMA = "version long, grp string, node string, parent string, ordinal int, is_object boolean, fields map<string,string>, value string"


def pivot(triples: list[Triple]) -> list[tuple[str, str, str, int | None, dict[str, str | None] | None, str | None]]:
    """The rows of one record's triples, in order: (group, node, parent, ordinal, fields, value).

    An object is a row of its group, with its scalar keys as fields; an element of a list that is no object is a row of its own group, with no fields but a value. The root
    comes first, with the empty group and path.
    """
    rows: dict[str, tuple] = {"": ("", "", "", None, {}, None)}
    for path, parent, ordinal, kind, value in triples:
        if kind == "object":
            rows[path] = group_of(path), path, parent, ordinal, {}, None
        elif ordinal is not None and path.endswith("]"):
            rows[path] = group_of(path), path, parent, ordinal, None, value
        else:
            rows[parent][4][path[len(parent) + 1 :] if parent else path] = value
    return list(rows.values())


def nested_rows(df: DataFrame, record: str, text: str, list_keys: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """All rows of all groups of every readable record: record, keep..., version, grp, node, parent, ordinal, is_object, fields, value.

    Records that are null, empty, cut off, or no object give nothing. grp is the path of the table a row belongs to, without indices, '' for the
    roots; node identifies the row within the record, parent its parent's row. In grp, node and parent keys are escaped, so that different
    places never share a path; render() makes them readable. fields maps the scalar keys of an object to their text (null for a JSON null); an
    element of a list that is no object has is_object false and its text in value. version is a hash of the record's text. See nested_triples for the
    reading of list_keys, strings that are JSON, and repeated keys. Repeated rows of df give repeated rows. No shuffle, one read.
    """
    src = df.select(F.col(record).alias("record"), F.col(text).cast("string").alias("__text"), *[F.col(c) for c in keep])
    src = src.where(F.col("__text").isNotNull()).withColumn("__version", F.xxhash64("__text"))
    head = [f"record {src.schema['record'].dataType.simpleString()}", *[f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep]]
    names = ["record", *keep, *[c.split()[0] for c in ROW_SCHEMA.split(", ")]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            offsets: list[int] = [0]
            keys: list[str] = []
            values: list[str | None] = []
            for i, s in enumerate(batch.column("__text").to_pylist()):
                triples = record_triples(s, list_keys)
                if triples is None:
                    continue
                for grp, node, parent, ordinal, fields, value in pivot(triples):
                    at.append(i)
                    for f, v in zip(cols, (grp, node, parent, ordinal, fields is not None, value)):
                        f.append(v)
                    if fields:
                        keys += fields
                        values += fields.values()
                    offsets.append(len(keys))
            take = pa.array(at, pa.int32())
            maps = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
            own = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string()))]
            kept = [batch.column(c).take(take) for c in ("record", *keep, "__version")]
            yield pa.RecordBatch.from_arrays([*kept, *own[:5], maps, own[5]], names=names)

    return src.mapInArrow(read, ", ".join([*head, ROW_SCHEMA]))


def rendered(path: Column) -> Column:
    """render() as an expression."""
    return F.regexp_replace(path, r"(?s)\\(.)", "$1")


def nested_objects(rows: DataFrame) -> DataFrame:
    """Every object below the root, once: (record, parent_path, node_path), from the pivoted groups. Repeated input rows change nothing."""
    own = rows.where(F.col("is_object") & (F.col("node") != ""))
    return own.select("record", rendered(F.col("parent")).alias("parent_path"), rendered(F.col("node")).alias("node_path")).distinct()


def one_version(rows: DataFrame, newest: str | None = None) -> DataFrame:
    """The rows of one version of each record, each once: that with the greatest `newest` (a column kept by nested_rows), then the greatest version.

    Versions are not mixed, whatever they share. One shuffle, on the record.
    """
    order = F.struct(*([F.col(newest)] if newest else []), F.col("version"))
    best = rows.withColumn("__best", F.max(order).over(Window.partitionBy("record"))).where(order.eqNullSafe(F.col("__best")))
    return best.drop("__best").dropDuplicates(["record", "node"])


def group_table(rows: DataFrame, group: str, columns: Sequence[str] = ()) -> DataFrame:
    """One group of objects as a flat table: record, node_path, parent_path, ordinal, the columns, and `other`.

    rows are one_version(nested_rows(...)). group is a path without indices ('' for the roots). Each object of the group has one row, also an
    empty one; parent_path links it to its parent's row in the parent's table. columns are the scalar keys that get a column of their own, null where
    an object lacks them; all the rest come as the map `other` from key to text, so that free keys lose nothing and none is ever counted by the driver. A list of scalars is a
    child table: see list_table. No shuffle.
    """
    own = rows.where(F.col("is_object") & (F.col("grp") == group))
    other = F.map_filter("fields", lambda k, v: ~k.isin(*columns)) if columns else F.col("fields")
    named = [F.element_at("fields", F.lit(c)).alias(c) for c in columns]
    return own.select("record", rendered(F.col("node")).alias("node_path"), rendered(F.col("parent")).alias("parent_path"), "ordinal", *named, other.alias("other"))


def list_table(rows: DataFrame, group: str | None = None) -> DataFrame:
    """The lists of scalars as child tables: record, grp, parent_path, path, ordinal, value; null elements kept. group is one list (ends in '[]'), or all."""
    own = rows.where(~F.col("is_object"))
    own = own if group is None else own.where(F.col("grp") == group)
    return own.select("record", rendered(F.col("grp")).alias("grp"), rendered(F.col("parent")).alias("parent_path"), rendered(F.col("node")).alias("path"), "ordinal", "value")
