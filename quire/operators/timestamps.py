"""Mixed timestamp formats and time zones as one UTC instant.

A written time is tokenised into a shape mask of character classes: every digit is 9, every run of letters one word. Each
distinct mask is mapped once to a parser, that is to the spans of its fields, and all values of a mask are then converted
together on a matrix of their characters. Local times go through versioned zone transition tables.
"""

from __future__ import annotations

import os
import re
import struct
import zoneinfo
from collections.abc import Callable, Iterator
from datetime import date, datetime, timezone
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The transition tables hold every rule's changes up to this year. The calendar and with it all rules repeat after 400 years, so a later time is looked up
#: that many years earlier; the table holds more than 400 years of the last rule.
HORIZON = 2500
CYCLE = 146_097 * 86_400

_WORD = re.compile(r"\[[^\[\]]*\]|[^\W\d_]+(?:[/_][^\W\d_]+|-[^\W\d_]+)*")
_DIGIT = re.compile(r"[0-9]")

# Fixed offsets, in minutes, that zone abbreviations usually stand for.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "HKT": 480, "SGT": 480, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "ART": -180, "SAST": 120, "PKT": 300,
}
# Month names, English and German, by number.
_MONTH_NAMES = {
    1: "january jan januar jän jänner", 2: "february feb februar", 3: "march mar märz mär mrz", 4: "april apr", 5: "may mai", 6: "june jun juni",
    7: "july jul juli", 8: "august aug", 9: "september sep sept", 10: "october oct oktober okt", 11: "november nov", 12: "december dec dezember dez",
}
MONTHS = {name: n for n, names in _MONTH_NAMES.items() for name in names.split()}
# Day names, English and German, in full and short.
WEEKDAYS = set(
    "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun "
    "montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag mo di mi do fr sa so".split()
)

# The grammar of masks: 9 a digit, a a word, b a bracketed word.
_SHAPE = re.compile(
    r"(?:(?P<weekday>a)\.?,? )?"
    r"(?:(?P<y1>9999)-(?P<m1>99)-(?P<d1>99)|(?P<y2>9999)/(?P<m2>99?)/(?P<d2>99?)|(?P<p3>99?)/(?P<q3>99?)/(?P<y3>9999)"
    r"|(?P<y4>9999)(?P<m4>99)(?P<d4>99)|(?P<d5>99?)\.? (?P<n5>a)\.? (?P<y5>9999)|(?P<n6>a)\.? (?P<d6>99?), (?P<y6>9999)|(?P<d7>99?)\.(?P<m7>99?)\.(?P<y7>9999))"
    r"(?:(?:(?P<t>a)|,? )(?P<hour>99?)(?::(?P<min>99)(?::(?P<sec>99)(?:[.,](?P<frac>9+))?)?|(?P<min2>99)(?:(?P<sec2>99)(?:[.,](?P<frac2>9+))?)?)"
    r"(?: ?(?P<w1>a))?(?: (?P<w2>a))?(?: ?(?P<off>[+-]99(?::?99)?))?(?: ?(?P<zone>b))?)?"
)


# A zone file's footer: standard name and offset, then perhaps the summer name and offset, and the dates of change.
_NAME, _CLOCK = r"(?:<[^>]+>|[A-Za-z]+)", r"[+-]?\d+(?::\d+){0,2}"
_FOOTER = re.compile(rf"{_NAME}({_CLOCK})(?:{_NAME}({_CLOCK})?,([^,/]+)(?:/({_CLOCK}))?,([^,/]+)(?:/({_CLOCK}))?)?")


def _seconds(clock: str) -> int:
    parts = [int(x) for x in clock.lstrip("+-").split(":")] + [0, 0]
    return (parts[0] * 3600 + parts[1] * 60 + parts[2]) * (-1 if clock.startswith("-") else 1)


def _day(rule: str, year: int) -> int:
    """Days since 1970 of a footer's date: Mm.w.d (the w-th weekday of a month, 5 the last), Jn (29 February not counted), n (from 0)."""
    if rule[0] == "M":
        month, week, weekday = (int(x) for x in rule[1:].split("."))
        first = date(year, month, 1).toordinal()
        day = first + (weekday - first) % 7 + 7 * (week - 1)  # ordinal 7 is a Sunday
        if week == 5 and day >= (date(year + month // 12, month % 12 + 1, 1)).toordinal():
            day -= 7
    else:
        n = int(rule.lstrip("J"))
        leap = rule[0] == "J" and n >= 60 and year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
        day = date(year, 1, 1).toordinal() + n - (rule[0] == "J") + leap
    return day - date(1970, 1, 1).toordinal()


def footer_changes(footer: str, years: range) -> list[tuple[int, int]]:
    """The changes (UTC second, offset from then on) that a footer's rule makes in the given years, ascending."""
    m = _FOOTER.fullmatch(footer)
    if m is None or m[3] is None:
        return []
    standard = -_seconds(m[1])
    summer = -_seconds(m[2]) if m[2] else standard + 3600
    out = []
    for year in years:
        out.append((_day(m[3], year) * 86400 + _seconds(m[4] or "2") - standard, summer))
        out.append((_day(m[5], year) * 86400 + _seconds(m[6] or "2") - summer, standard))
    return sorted(out)


def zone_bytes(key: str) -> bytes:
    """The zone file of an IANA name, from the system or the tzdata package."""
    for root in zoneinfo.TZPATH:
        p = os.path.join(root, *key.split("/"))
        if os.path.isfile(p):
            with open(p, "rb") as f:
                return f.read()
    from importlib import resources

    return resources.files("tzdata.zoneinfo").joinpath(*key.split("/")).read_bytes()


def zone_files() -> dict[str, bytes]:
    """All zone files of this machine's release, about 600 of some KB. Built on the driver and shipped, so that all workers convert by one release."""
    out = {}
    for key in sorted(zoneinfo.available_timezones()):
        raw = zone_bytes(key)
        if raw[:4] == b"TZif":
            out[key] = raw
    return out


def read_zone(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The transition table of a zone file: UTC seconds at which an offset begins (the first is minus infinity), offsets in seconds."""
    if raw[:4] != b"TZif":
        raise ValueError("no zone data")

    def counts(at: int) -> tuple[int, ...]:
        return struct.unpack(">6l", raw[at + 20 : at + 44])  # isutc, isstd, leap, time, type, char

    at, wide, footer = 0, 4, ""
    if raw[4:5] >= b"2":  # the second block has 64-bit times, and a footer follows it
        u, s, leap, n, kinds, chars = counts(0)
        at, wide = 44 + n * 5 + kinds * 6 + chars + leap * 8 + s + u, 8
        footer = raw[raw.rindex(b"\n", 0, -1) + 1 : -1].decode("ascii")
    _, _, _, n, kinds, _ = counts(at)
    at += 44
    times = np.frombuffer(raw, ">i8" if wide == 8 else ">i4", n, at).astype(np.int64)
    which = np.frombuffer(raw, np.uint8, n, at + n * wide)
    at += n * (wide + 1)
    types = [struct.unpack(">lBB", raw[at + 6 * i : at + 6 * i + 6]) for i in range(kinds)]
    first = next((t[0] for t in types if not t[1]), types[0][0])
    starts, offsets = [-(2**62)], [first]
    for t, w in zip(times.tolist(), which.tolist()):
        starts.append(t)
        offsets.append(types[w][0])
    since = max(starts[-1], 0)
    for t, offset in footer_changes(footer, range(1970 + since // 31_556_952, HORIZON + 1)):
        if t > since:
            starts.append(t)
            offsets.append(offset)
    return np.array(starts, np.int64), np.array(offsets, np.int64)


def zone_version() -> str:
    """Release of the zone data in use."""
    for root in zoneinfo.TZPATH:
        p = os.path.join(root, "tzdata.zi")
        if os.path.isfile(p):
            with open(p) as f:
                return f.readline().replace("# version", "").strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


Tables = Callable[[str], tuple[np.ndarray, np.ndarray] | None]


def zone_tables(files: dict[str, bytes] | None = None) -> Tables:
    """A lookup of transition tables by IANA name, None for unknown names: from the given files, or from this machine's."""

    @lru_cache(maxsize=1024)
    def table(key: str) -> tuple[np.ndarray, np.ndarray] | None:
        if not key or len(key) > 64 or not re.fullmatch(r"[A-Za-z0-9_+\-]+(?:/[A-Za-z0-9_+\-]+)*", key):
            return None
        try:
            return read_zone(zone_bytes(key) if files is None else files[key])
        except (KeyError, OSError, ValueError, ModuleNotFoundError):
            return None

    return table


_OWN_TABLES = zone_tables()


def local_to_utc(local: np.ndarray, key: str, tables: Tables = _OWN_TABLES) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of local wall-clock seconds, and whether the local time names exactly one instant in the zone."""
    table = tables(key)
    if table is None:
        return local, np.zeros(len(local), bool)
    starts, offsets = table
    last = int(datetime(HORIZON - 50, 1, 1, tzinfo=timezone.utc).timestamp())
    ahead = np.maximum(0, -((last - local) // CYCLE)) * CYCLE
    local = local - ahead
    hits = np.zeros(len(local), np.int64)
    utc = local.copy()
    for off in np.unique(offsets):
        u = local - off
        ok = offsets[np.searchsorted(starts, u, "right") - 1] == off
        hits += ok
        utc = np.where(ok, u, utc)
    return utc + ahead, hits == 1


def shape(value: str) -> tuple[str, list[str], str]:
    """Mask, words, and the value with every word cut to one character, so that all values of a mask have equal length."""
    words = _WORD.findall(value)
    flat = _WORD.sub(lambda m: "b" if m[0][0] == "[" else "a", value) if words else value
    return _DIGIT.sub("9", flat), words, flat


#: A fraction beyond its sixth digit.
_FINER = re.compile(r"([.,][0-9]{6})[0-9]+")
#: No mask of _SHAPE is longer once fractions are cut to six digits (its longest has 78 characters); longer ones need no look at the grammar and no place in the cache.
LONGEST_MASK = 100


@lru_cache(maxsize=100_000)
def parser_of(mask: str) -> dict[str, tuple[int, int]] | None:
    """The parser of a mask: spans of its fields (for words: place in the word list); None for what is no time."""
    if len(mask) in (10, 13) and set(mask) == {"9"}:
        return {"epoch": (0, len(mask))}
    m = _SHAPE.fullmatch(mask)
    if m is None:
        return None
    spans = {}
    for name, text in m.groupdict().items():
        if text is not None:
            a, b = m.span(name)
            if text in "ab":
                n = sum(c in "ab" for c in mask[:a])
                spans[name] = (n, n + 1)
            else:
                spans[name.rstrip("1234567") if name[0] in "ymdpqn" and name not in ("min", "min2") else name] = (a, b)
                continue
            if name[0] == "n":
                spans["month_name"] = spans.pop(name)
    for k in ("min2", "sec2", "frac2"):
        if k in spans:
            spans[k[:-1]] = spans.pop(k)
    return spans


def _digits(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    part = chars[:, span[0] : span[1]].astype(np.int64) - 48
    return part @ (10 ** np.arange(part.shape[1] - 1, -1, -1, dtype=np.int64))


def to_epoch_us(values: list[str | None], zones: list[str | None], orders: list[str | None], tables: Tables = _OWN_TABLES) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds since 1970 UTC, and whether each value names exactly one instant; the values need not share a form.

    zones hold where a value has no zone of its own; orders (dmy or mdy) rule dates written with slashes and the year last.
    """
    n = len(values)
    result, good = np.zeros(n, np.int64), np.zeros(n, bool)
    by_mask: dict[str, list[int]] = {}
    words_of: list[list[str]] = [[]] * n
    flats: list[str] = [""] * n
    for i, v in enumerate(values):
        if v is None:
            continue
        v = _FINER.sub(r"\1", v.strip()).replace("−", "-")
        if not v:
            continue
        mask, words_of[i], flats[i] = shape(v)
        if len(mask) > LONGEST_MASK:
            continue
        by_mask.setdefault(mask, []).append(i)
    for mask, rows in by_mask.items():
        spans = parser_of(mask)
        if spans is None:
            continue
        at = np.array(rows)
        chars = np.frombuffer("".join(flats[i] for i in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), -1)
        if "epoch" in spans:
            v = _digits(chars, spans["epoch"])
            result[at], good[at] = v * (1_000_000 if len(mask) == 10 else 1000), True
            continue
        us, ok = _convert(spans, chars, [words_of[i] for i in rows], [zones[i] for i in rows], [orders[i] for i in rows], tables)
        result[at], good[at] = us, ok
    return result, good


def _convert(spans: dict, chars: np.ndarray, words: list[list[str]], zones: list, orders: list, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    n = len(words)
    ok = np.ones(n, bool)
    year = _digits(chars, spans["y"])
    if "p" in spans:
        p, q = _digits(chars, spans["p"]), _digits(chars, spans["q"])
        dmy = np.array([o == "dmy" for o in orders])
        ok &= dmy | np.array([o == "mdy" for o in orders])
        day, month = np.where(dmy, p, q), np.where(dmy, q, p)
    elif "month_name" in spans:
        k = spans["month_name"][0]
        month = np.array([MONTHS.get(w[k].lower(), 0) for w in words], np.int64)
        day = _digits(chars, spans["d"])
    else:
        month, day = _digits(chars, spans["m"]), _digits(chars, spans["d"])
    if "weekday" in spans:
        k = spans["weekday"][0]
        ok &= np.array([w[k].lower() in WEEKDAYS for w in words])
    if "t" in spans:
        k = spans["t"][0]
        ok &= np.array([w[k] in "Tt" for w in words])
    ok &= (month >= 1) & (month <= 12) & (day >= 1) & (year >= 1)
    months = ((year - 1970) * 12 + np.clip(month, 1, 12) - 1).astype("datetime64[M]")
    first = months.astype("datetime64[D]").astype(np.int64)
    length = (months + 1).astype("datetime64[D]").astype(np.int64) - first
    ok &= day <= length
    zero = np.zeros(n, np.int64)
    hour, minute, second = (_digits(chars, spans[k]) if k in spans else zero for k in ("hour", "min", "sec"))
    frac = zero
    if "frac" in spans:
        a, b = spans["frac"]
        b = min(b, a + 6)  # finer digits are cut off
        frac = _digits(chars, (a, b)) * 10 ** (6 - (b - a))
    # words after the time: a half of the day, an abbreviation, a zone name
    named: list[str | None] = list(zones)
    fixed, has_fixed, halves = zero.copy(), np.zeros(n, bool), np.zeros(n, np.int64)
    for name in ("w1", "w2"):
        if name in spans:
            k = spans[name][0]
            for i, w in enumerate(words):
                u = w[k].upper()
                if u in ("AM", "PM") and name == "w1":
                    halves[i] = 1 if u == "AM" else 2
                elif has_fixed[i] or (name == "w2" and not halves[i]):
                    ok[i] = False
                elif u in ABBREVIATIONS:
                    fixed[i], has_fixed[i] = ABBREVIATIONS[u] * 60, True
                elif "/" in w[k]:
                    named[i] = w[k]
                else:
                    ok[i] = False
    if halves.any():
        half = halves > 0
        ok &= ~half | ((hour >= 1) & (hour <= 12))
        hour = np.where(half, hour % 12 + np.where(halves == 2, 12, 0), hour)
    ok &= (hour < 24) & (minute < 60) & (second < 60)
    if "zone" in spans:
        k = spans["zone"][0]
        for i, w in enumerate(words):
            key = w[k][1:-1]
            if key.upper() in ("UTC", "GMT", "Z"):
                fixed[i], has_fixed[i] = 0, True
            else:
                named[i] = key
    if "off" in spans:  # decides before any name
        a, b = spans["off"]
        digits = [c for c in range(a + 1, b) if chars[0, c] != 58]
        hh = _digits(chars, (digits[0], digits[0] + 2))
        mm = _digits(chars, (digits[2], digits[2] + 2)) if len(digits) > 2 else zero
        ok &= (hh <= 18) & (mm < 60)
        fixed, has_fixed = np.where(chars[:, a] == 45, -1, 1) * (hh * 3600 + mm * 60), np.ones(n, bool)
    local = (first + np.clip(day, 1, 31) - 1) * 86400 + hour * 3600 + minute * 60 + second
    utc = local - fixed
    ok &= has_fixed | np.array([z is not None for z in named])
    by_zone: dict[str, list[int]] = {}
    for i in np.nonzero(ok & ~has_fixed)[0].tolist():
        by_zone.setdefault(named[i], []).append(i)
    for key, rows in by_zone.items():
        at = np.array(rows)
        utc[at], ok[at] = local_to_utc(local[at], key, tables)
    return utc * 1_000_000 + frac, ok


def normalize_times(df: DataFrame, value: str, zone: str, order: str, keep: list[str], stamp: str | None = None) -> DataFrame:
    """Rows of df whose value names exactly one instant: the columns keep, epoch_us, and, if a name is given for it, the release of the zone data.

    value is any text of any length; zone an IANA name that holds where the value has none of its own; order dmy or mdy. The zone files are read once, on the
    driver, and go with the job. Null, empty and unreadable values, impossible dates, unknown zones, values without any zone, and local times that
    the clocks skipped or showed twice give no row. Repeated rows stay repeated. No shuffle.
    """
    src = df.select(*keep, F.col(value).cast("string").alias("__v"), F.col(zone).cast("string").alias("__z"), F.col(order).cast("string").alias("__o"))
    schema = ", ".join([*[f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep], "epoch_us long"])

    files = zone_files()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = zone_tables(files)
        for batch in batches:
            us, ok = to_epoch_us(*(batch.column(c).to_pylist() for c in ("__v", "__z", "__o")), tables)
            at = pa.array(np.nonzero(ok)[0])
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in keep], pa.array(us[ok])], names=[*keep, "epoch_us"])

    got = src.mapInArrow(convert, schema)
    return got if stamp is None else got.withColumn(stamp, F.lit(zone_version()))
