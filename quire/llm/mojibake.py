"""Text decoded with the wrong character encoding: find the passages and restore them where possible.

The garbled forms of all plausible characters are computed beforehand for every pair of true and wrong encoding: UTF-8 read as a one-byte encoding, one-byte
Cyrillic and Western read as another one-byte encoding, two-byte East Asian read as Western. One Aho-Corasick automaton matches them all at once; only matched spans
are replaced, so correct text around them stays. Forms that are ordinary letters themselves count only as chains of one pair, each judged by what
it decodes to; where two pairs claim a place, coverage and the letter-pair statistics of the corpus arbitrate.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import checkpoint

#: Encodings that UTF-8 text was wrongly read as. Bytes they leave undefined are taken as control characters, as lenient readers do.
WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "cp1254")
#: The characters whose garbled forms are looked for, as ranges of code points.
ALPHABETS = (
    (0x0080, 0x017F), (0x0192, 0x0192), (0x0218, 0x021B), (0x02C6, 0x02C6), (0x02DC, 0x02DC), (0x0386, 0x03CE), (0x0401, 0x0401), (0x0404, 0x0404), (0x0406, 0x0407), (0x0410, 0x044F),
    (0x0451, 0x0451), (0x0454, 0x0454), (0x0456, 0x0457), (0x0490, 0x0491), (0x060C, 0x0669), (0x066A, 0x066C), (0x067E, 0x067E), (0x0686, 0x0686), (0x06A9, 0x06AF), (0x06CC, 0x06CC),
    (0x0901, 0x097F), (0x0E01, 0x0E5B), (0x1E00, 0x1EFF), (0x2009, 0x2064), (0x20AC, 0x20AC), (0x2116, 0x2122), (0x2190, 0x21FF), (0x2200, 0x22FF), (0x2500, 0x257F), (0x2600, 0x27BF),
    (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFE0F, 0xFE0F), (0xFEFF, 0xFEFF), (0xFF01, 0xFF9F), (0xFFFD, 0xFFFD), (0x1F300, 0x1F6FF), (0x1F900, 0x1FAFF),
)
#: Characters that may follow a capital letter in correct text; a two-character form that ends with one needs more evidence.
_ORDINARY = set("»“”’–—…Ёё \u00a0\"")
_LETTERS_ONLY = re.compile("[А-Яа-яЁё]+")
_QUOTED = re.compile(r"`[^`\n]*`")
_LOST = "\ufffd"
_RUSSIAN = re.compile("[а-яё]+|[А-ЯЁ][а-яё]*|[А-ЯЁ]+")
_RUSSIAN_MARKS = "«»„“”–— "
_FLIPPED = re.compile("[а-яё][А-ЯЁ]+")
_CASELESS_WORD = re.compile("(?<![Ѐ-ӿ])[а-яё]{3,}(?![Ѐ-ӿ])")
#: Words of Latin letters with an accented one; words with a question mark where a letter may have been.
_ACCENTED = re.compile("[A-Za-zÀ-ɏ]*[À-ɏ][A-Za-zÀ-ɏ]*")
_HOLED = re.compile(r"[A-Za-zÀ-ɏ]*\?[A-Za-zÀ-ɏ?]*[A-Za-zÀ-ɏ]")
_HOLE = re.compile(r"\?[A-Za-zÀ-ɏ]")
_ACCENT = re.compile("[À-ɏ]")
#: Pairs of true and wrong encoding whose garbled forms may be ordinary letters; WESTERN stands for cp1252 and latin-1, whose readings differ in 0x80-0x9F only.
WESTERN = "cp1252"
LETTER_PAIRS = (("cp1251", WESTERN), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("gb2312", WESTERN), ("cp932", WESTERN), (WESTERN, "latin-1"))
_CYRILLIC, _KOI_READ, _ANSI_READ, _CHINESE, _JAPANESE, _PUNCTUATION = range(len(LETTER_PAIRS))


@lru_cache(maxsize=32)
def _table(codec: str) -> list[str]:
    """Character for each byte; undefined bytes stand for themselves."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@lru_cache(maxsize=32)
def _bytes_of(codec: str) -> dict[str, int]:
    """Byte for each character of a wrong reading."""
    out = {chr(b): b for b in range(256)} if codec in ("cp1252", "latin-1", "cp1254") else {chr(b): b for b in range(128)}
    for b, c in enumerate(_table(codec)):
        out[c] = b
    return out


def garbled_forms() -> Iterator[tuple[str, str]]:
    """All pairs of garbled form and true character."""
    tables = [_table(c) for c in WRONG]
    for lo, hi in ALPHABETS:
        for point in range(lo, hi + 1):
            char = chr(point)
            raw = char.encode("utf-8")
            for codec, t in zip(WRONG, tables):
                form = "".join([t[b] for b in raw])
                if not (_LETTERS_ONLY.fullmatch(form) and (len(form) > 2 or codec != "cp1251")):  # could be a Russian word
                    yield form, char


def _readings(codec: str, byte: int) -> set[str]:
    """What a byte may become when it is read with a wrong encoding."""
    return {_table(codec)[byte], chr(byte)} if codec == WESTERN else {_table(codec)[byte]}


def letter_forms() -> Iterator[tuple[str, int, str]]:
    """All garbled forms of LETTER_PAIRS: form, number of the pair, true character or characters."""
    russian = "".join(map(chr, range(0x410, 0x450))) + "Ёё" + _RUSSIAN_MARKS.strip() + "…№"
    for pair, (true, wrong) in enumerate(LETTER_PAIRS):
        if pair == _PUNCTUATION:
            for b in {*range(0x80, 0xA0)} - {0x85}:  # NEL is a line end of its own
                yield chr(b), pair, _table(true)[b]
        elif true in ("gb2312", "cp932"):
            for lead, trail in product(range(0x81, 0xF0), range(0x40, 0xFF)):
                try:
                    char = bytes([lead, trail]).decode(true)
                except UnicodeDecodeError:
                    continue
                if len(char) == 1 and (true == "cp932" or 0xB0 <= lead <= 0xD7 or lead in (0xA1, 0xA3, 0xA4, 0xA5, 0xA7)):
                    for form in product(_readings(wrong, lead), _readings(wrong, trail)):
                        yield "".join(form), pair, char
            if true == "gb2312":  # marks and accented letters of the extended set
                for lead, trail in [(0xA1, t) for t in (0xAA, 0xAD)] + [(0xA8, t) for t in range(0xA1, 0xBB)]:
                    yield chr(lead) + chr(trail), pair, bytes([lead, trail]).decode("gbk")
        else:
            for char in russian:
                try:
                    raw = char.encode(true)
                except UnicodeEncodeError:
                    continue
                for form in _readings(wrong, raw[0]):
                    yield form, pair, char


#: Matches of one text: of UTF-8 forms, and by pair number of the letter forms; start -> (end, true character).
Hits = tuple[dict[int, tuple[int, str]], dict[int, dict[int, tuple[int, str]]]]


@lru_cache(maxsize=1)
def _automaton() -> tuple[ahocorasick.Automaton, list[tuple[int, str | None, tuple[tuple[int, str], ...]]]]:
    """The automaton over all forms. A form of UTF-8 alone carries its length and character; another one the place of its entry in the list."""
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    utf8: dict[str, str] = {}
    for form, char in garbled_forms():
        utf8.setdefault(form, char)  # the encodings are in order of preference
    letters: dict[str, dict[int, str]] = defaultdict(dict)
    for form, pair, char in letter_forms():
        letters[form].setdefault(pair, char)
    entries = []
    for form, char in utf8.items():
        if form not in letters:
            a.add_word(form, len(form) << 24 | ord(char))
    for form, chars in letters.items():
        a.add_word(form, -1 - len(entries))
        entries.append((len(form), utf8.get(form), tuple(chars.items())))
    a.make_automaton()
    return a, entries


def _hits(text: str) -> Hits:
    automaton, entries = _automaton()
    utf8: dict[int, tuple[int, str]] = {}
    letters: dict[int, dict[int, tuple[int, str]]] = defaultdict(dict)
    for last, packed in automaton.iter(text):
        end = last + 1
        if packed >= 0:
            start, char = end - (packed >> 24), chr(packed & 0xFFFFFF)
        else:
            n, char, pairs = entries[-1 - packed]
            start = end - n
            for pair, c in pairs:
                letters[pair][start] = end, c
            if char is None:
                continue
        if start not in utf8 or utf8[start][0] < end:
            utf8[start] = end, char
    return utf8, letters


def _leftmost(hits: dict[int, tuple[int, str]]) -> list[tuple[int, int, str]]:
    """Leftmost longest matches that don't overlap: (start, end, true character)."""
    out, at = [], 0
    for start in sorted(hits):
        if start >= at:
            at = hits[start][0]
            out.append((start, at, hits[start][1]))
    return out


def _chains(hits: dict[int, tuple[int, str]]) -> list[tuple[int, int, str]]:
    """Matches of one pair that follow each other without a gap, joined: (start, end, true text)."""
    out: list[tuple[int, int, str]] = []
    for s, e, c in _leftmost(hits):
        if out and out[-1][1] == s:
            out[-1] = out[-1][0], e, out[-1][2] + c
        else:
            out.append((s, e, c))
    return out


def _strong(text: str, start: int, end: int) -> bool:
    """Whether a form can't be correct text where it stands."""
    if end - start > 2 or text[end - 1] not in _ORDINARY:
        return True
    return text[end : end + 1].islower()  # a closing mark is not followed by a small letter


def utf8_spans(text: str, hits: dict[int, tuple[int, str]]) -> list[tuple[int, int, str]]:
    """Spans of UTF-8 read as a one-byte encoding, with what they stand for.

    A form that correct text could contain (a capital and a quotation mark, say) counts only next to another form, or in a text with a certain one.
    """
    found = _leftmost(hits)
    if not found:
        return []
    sure = [_strong(text, s, e) for s, e, _ in found]
    touching = [i for i in range(len(found)) if (i and found[i - 1][1] == found[i][0]) or (i + 1 < len(found) and found[i][1] == found[i + 1][0])]
    if not any(sure) and not touching:
        return []
    return found if any(sure) else [found[i] for i in touching]


# --- forms that are letters ------------------------------------------------------------------------------------------


def letter_pairs(text: str) -> Counter:
    """Counts of the neighbouring letters of lower-case Russian words, word ends as blanks."""
    out: Counter = Counter()
    for w in _CASELESS_WORD.findall(text):
        w = f" {w} "
        out.update(w[i : i + 2] for i in range(len(w) - 1))
    return out


class Letters:
    """How usual a Russian word's letter pairs are in a corpus; without any corpus all pairs are equally usual."""

    #: Letters and the blank; half an occurrence is added to each pair.
    KINDS = 34

    def __init__(self, counts: dict[str, int] | None = None):
        self.counts = counts or {}
        self.first: Counter = Counter()
        for k, n in self.counts.items():
            self.first[k[0]] += n

    def score(self, word: str) -> float:
        """Mean log probability of a word's pairs."""
        w = f" {word.lower()} "
        return sum(math.log((self.counts.get(w[i : i + 2], 0) + 0.5) / (self.first[w[i]] + 0.5 * self.KINDS)) for i in range(len(w) - 1)) / (len(w) - 1)


def _alone(text: str, start: int, end: int, same: str) -> bool:
    """Whether a chain is a whole run: no character of the same kind stands beside it."""
    return not (start and re.match(same, text[start - 1])) and not (end < len(text) and re.match(same, text[end]))


def _latin_spans(text: str, hits: dict[int, dict[int, tuple[int, str]]], letters: Letters) -> list[tuple[int, int, str]]:
    """cp1251 and the Chinese set read as Western: whole runs of accented characters that decode to one Russian word, or to common Chinese characters."""
    russian: dict[tuple[int, int], str] = {}
    for s, e, got in _chains(hits.get(_CYRILLIC, {})):
        core = got.strip(_RUSSIAN_MARKS)
        if e - s >= 3 and len(core) >= 3 and _RUSSIAN.fullmatch(core) and _alone(text, s, e, _HIGH):
            russian[s, e] = got
    chinese: dict[tuple[int, int], str] = {}
    for s, e, got in _chains(hits.get(_CHINESE, {})):
        han = sum("一" <= c <= "鿿" for c in got)
        if ((e - s >= 4 and (2 * han >= len(got) or re.fullmatch("[А-яЁё]+|[ぁ-ヿ]+", got))) or (e - s == 2 and ord(text[s]) in (0xA1, 0xA8))) and _alone(text, s, e, _HIGH):
            chinese[s, e] = got
    out = chinese | russian
    if russian.keys() <= chinese.keys():  # capitals of Russian may pair to Chinese characters, here all of them do
        out |= {at: chinese[at] for at, got in russian.items() if letters.score(got.strip(_RUSSIAN_MARKS)) < -3.5}
    return [(s, e, got) for (s, e), got in out.items()]


_HIGH = "[¡-ÿŒœŠšŸŽžƒˆ˜–—‘-‚“-„†-•…‰‹›€™]"
_CYRILLIC_CHAR = "[Ѐ-џҐґ─-▟]"


def _cyrillic_spans(text: str, hits: dict[int, dict[int, tuple[int, str]]], letters: Letters) -> list[tuple[int, int, str]]:
    """Russian read with another Russian encoding, by runs: the case is turned round, and the letters make unlikely words.

    A word with a small first letter and capitals after it, or with box drawing in it, is certain if it decodes better; a word of capitals is judged by its
    letters' usual neighbours alone. Once a text has a certain run, other runs of capitals of the same reading are taken too if they decode better.
    """
    out: list[tuple[int, int, str]] = []
    most = float("-inf")
    for pair in (_KOI_READ, _ANSI_READ):
        found, total, sure = [], 0.0, False
        for s, e, got in _chains(hits.get(pair, {})):
            run = text[s:e]
            if e - s < 2 or (run.islower() and run.isalpha()) or not _alone(text, s, e, _CYRILLIC_CHAR):  # small letters would be capitals: no more likely
                continue
            core = got.strip(_RUSSIAN_MARKS)
            if not core or not _RUSSIAN.fullmatch(core) or not (run.isupper() or _FLIPPED.fullmatch(run) or not run.isalpha()):
                continue
            gain = letters.score(core) - letters.score(run)
            certain = (bool(_FLIPPED.fullmatch(run)) or (not run.isalpha() and any(c.isalpha() for c in run))) and gain > 0
            if certain or gain > 0.5:
                found.append((s, e, got))
                total += gain * (len(run) + 1)
                sure |= certain and len(run) > 1
        if found and (sure or total > 6.0) and total > most:
            out, most = found, total
    return out


_KANA_LEAD = re.compile("[\x81-\x83‚ƒ]")
_SPECIAL = re.compile("[\x80-\x9f‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")


def _japanese_spans(text: str, hits: dict[int, dict[int, tuple[int, str]]]) -> list[tuple[int, int, str]]:
    """Shift_JIS read as Western: chains of two characters at least whose first bytes are all in the range that Western text hardly uses, or with kana among them.

    One character alone counts beside such a chain, or where no letter stands next to it, since 0x91-0x97 may be Western quotation marks as well.
    """
    chains = [(s, e, got) for s, e, got in _chains(hits.get(_JAPANESE, {})) if re.fullmatch("[　-ヿ一-鿿！-～]+", got)]
    sure, single = [], []
    for s, e, got in chains:
        leads = text[s:e:2]
        kana = any(_KANA_LEAD.match(c) for c in leads)
        if len(got) > 1 and (kana or all(_SPECIAL.match(c) for c in leads)) and (kana or "\x80" <= max(leads) <= "\x9f" or len(got) > 2):
            sure.append((s, e, got))
        elif len(got) == 1 and "\x80" <= text[s] <= "\x9f":
            single.append((s, e, got))
    for s, e, got in single:
        beside = (s and text[s - 1].isalpha()) or text[e : e + 1].isalpha()
        if (sure or not beside) and text[e - 1] > "\x7f":
            sure.append((s, e, got))
    return sorted(sure)


# --- whole texts ---------------------------------------------------------------------------------------------------


def _mask_quotes(text: str) -> str:
    """The text with passages in backticks blanked, at the same length."""
    return _QUOTED.sub(lambda m: " " * len(m[0]), text) if "`" in text else text


def _covered(spans: list[tuple[int, int, str]]) -> set[int]:
    return {p for s, e, _ in spans for p in range(s, e)}


def garbled_spans(text: str, letters: Letters | None = None) -> list[tuple[int, int, str]]:
    """Garbled spans of a text outside backticks, in order: (start, end, replacement); the replacement is the span itself where it can't be restored."""
    if text.isascii():
        return []
    seen = _mask_quotes(text)
    letters = letters or Letters()
    utf8, hits = _hits(seen)
    spans = utf8_spans(seen, utf8)
    runs = _japanese_spans(seen, hits)
    taken = _covered(runs)
    latin = [r for r in _latin_spans(seen, hits, letters) if r[0] not in taken and r[1] - 1 not in taken]
    at = _covered(spans)
    # a run wins over UTF-8 forms that leave a part of it unexplained, or that are few beside the runs of its kind
    many = sum(e - s for s, e, _ in latin) > 2 * len(at)
    for r in [*runs, *latin, *_cyrillic_spans(seen, hits, letters)]:
        high = [p for p in range(r[0], r[1]) if seen[p] > "\x7f"]
        inside = sum(p in at for p in high)
        if inside < 0.8 * len(high) or (many and r in latin):
            held = set(range(r[0], r[1]))
            spans = [x for x in spans if x[0] not in held and x[1] - 1 not in held] + [r]
    at = _covered(spans)
    spans += [(s, e, c) for s, (e, c) in hits.get(_PUNCTUATION, {}).items() if s not in at]
    spans += [(m.start(), m.end(), _LOST) for m in re.finditer(_LOST, seen)]
    return sorted(spans)


def restore(text: str, letters: Letters | None = None, found: list[tuple[int, int, str]] | None = None) -> str:
    """The text with its garbled spans (as found, if known) replaced, again and again for text that was garbled more than once, until nothing changes."""
    seen = {text}
    while True:
        spans = [s for s in (garbled_spans(text, letters) if found is None else found) if text[s[0] : s[1]] != s[2]]
        found = None
        out, at = [], 0
        for s, e, new in spans:
            out += [text[at:s], new]
            at = e
        text = "".join([*out, text[at:]])
        if text in seen:
            return text
        seen.add(text)


def holed_words(text: str) -> list[str]:
    """Words outside backticks with a question mark where a letter may have been lost, each once."""
    return list(dict.fromkeys(w for w in _HOLED.findall(_mask_quotes(text)) if any(c != "?" for c in w)))


def corpus_letters(df: DataFrame, text: str) -> Letters:
    """Letter-pair statistics of all lower-case Russian words of a text column. The driver receives at most one row per pair of letters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total.update(letter_pairs(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["pair", "n"])

    src = df.select(F.col(text).cast("string").alias("t")).where(F.col("t").rlike("[а-яё]{3}"))
    rows = src.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return Letters({r["pair"]: r["n"] for r in rows})


def accented_words(df: DataFrame, text: str) -> DataFrame:
    """The accented Latin words of a text column by what remains if their accented letters become question marks: (mask, word), word null where
    several words share the mask. Words are also taken with a capital. Counted within batches before the shuffle."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = {w for t in batch.column(0).to_pylist() for w in _ACCENTED.findall(t)}
            words |= {w[0].upper() + w[1:] for w in words}
            kept = sorted(words)
            yield pa.RecordBatch.from_arrays([pa.array([_ACCENT.sub("?", w) for w in kept], pa.string()), pa.array(kept, pa.string())], names=["mask", "word"])

    src = df.select(F.col(text).cast("string").alias("t")).where(F.col("t").rlike("[À-ɏ]"))
    got = src.mapInArrow(find, "mask string, word string").groupBy("mask").agg(F.min("word").alias("word"), F.max("word").alias("other"))
    return got.select("mask", F.when(F.col("word") == F.col("other"), F.col("word")).alias("word"))


def garbled_values(df: DataFrame, value: str, keep: list[str], letters: Letters | None = None) -> DataFrame:
    """The rows of df whose value has a garbled passage: keep..., value, restored, n_spans.

    restored is the value with every passage replaced that can be restored; it equals the value where none can. Passages in
    backticks and rare but correct spelling are left alone. A question mark inside a word counts as a lost letter only if the word is one of
    the column's accented words with that letter missing. Null and empty values give no row. Whole values are read; repeated rows stay. Only words with question marks and accented words are shuffled.
    """
    src = df.select(*keep, F.col(value).cast("string").alias("value")).where(F.col("value").rlike(r"[^\x00-\x7F]|\?[a-zA-Z]"))
    schema = ", ".join([*[f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep], "value string, restored string, n_spans int, __holes array<string>"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, fixed, n, holes = [], [], [], []
            for i, v in enumerate(batch.column("value").to_pylist()):
                spans = garbled_spans(v, letters)
                words = holed_words(v) if _HOLE.search(v) else []
                if spans or words:
                    at.append(i)
                    fixed.append(restore(v, letters, spans) if spans else v)
                    n.append(len(spans))
                    holes.append(words)
            take = pa.array(at, pa.int32())
            own = [pa.array(fixed, pa.string()), pa.array(n, pa.int32()), pa.array(holes, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in (*keep, "value")], *own], names=[*keep, "value", "restored", "n_spans", "__holes"])

    names = [*keep, "value", "restored", "n_spans"]
    found = checkpoint(src.mapInArrow(find, schema).withColumn("__row", F.monotonically_increasing_id()))
    holes = found.select("__row", F.explode("__holes").alias("mask"))
    known = accented_words(df, value).join(holes.select("mask").distinct(), "mask", "left_semi")
    fixes = holes.join(known, "mask").groupBy("__row").agg(F.count(F.lit(1)).alias("__n"), F.collect_list(F.struct("mask", F.coalesce("word", "mask").alias("word"))).alias("__fix"))
    filled = F.aggregate("__fix", F.col("restored"), lambda t, f: F.replace(t, f["mask"], f["word"]))
    both = found.join(fixes, "__row", "left").where((F.col("n_spans") > 0) | F.col("__n").isNotNull())
    return both.withColumn("restored", F.when(F.col("__n").isNull(), F.col("restored")).otherwise(filled)).withColumn("n_spans", (F.col("n_spans") + F.coalesce("__n", F.lit(0))).cast("int")).select(*names)
