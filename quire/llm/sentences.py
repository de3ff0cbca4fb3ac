"""Sentence boundaries across languages and scripts.

A full stop is ambiguous; whether the word before it is an abbreviation, and whether the word after it is a proper name, is decided from the
unambiguous occurrences of these words elsewhere in the document, and where it has none, in the whole corpus. Each script
has its own terminators: the danda in Devanagari, the ideographic stop in Chinese and Japanese, spaces in Thai.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import checkpoint

# Abbreviations held for certain where neither document nor corpus says anything; lower case, without the last stop.
SEED = set(
    "dr prof mr mrs sr sra dra dott mme mlle hr no nr fig figs sec vs approx ca cf e.g i.e p.ej p.ex z.b d.h art pág págs bzw "
    "рис табл см д-р डॉ श्री د".split()
)
# Month names that follow an ordinal written with a stop (German, Danish, Norwegian, Czech and Finnish don't use others here).
MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

_THAI = "ก-ฺเ-๎"
_CLOSERS = "\"”’'»“›)\\]」』）】》〉］"
#: A run of terminators, and what belongs to the sentence directly after it.
_TAIL = rf"(?:[{_CLOSERS}]|[   ]»|\[\^[^\]\s]*\])*"
_TERM = re.compile(rf"[.!?…؟۔。！？।॥．｡]+{_TAIL}(?=[\sɐ-￿]|(?<=[。！？।॥．｡{_CLOSERS}]))")
_ALNUM = re.compile(r"[^\W_]")
_THAI_LETTER = re.compile("[ก-ฮ]")
_THAI_GAP = re.compile(rf"(?<=[{_THAI}])((?:\[\^[^\]\s]*\])*)[ \t\r\n ]+(?=[{_THAI}])")
_QUOTES = {"”": "“„", "“": "„", "»": "«", "」": "「", "』": "『", "’": "‘", "›": "‹", '"': '"'}
_OPENERS = "“„«‹‘\"'(（[「『【《¿¡*_—–-"
_SKIPPED = " \t\r\n   　"

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]+|$)")
_ITEM = re.compile(r"\s*(?:[-*+]|\d{1,9}[.)])(?:[ \t]+|$)")
_QUOTE_MARK = re.compile(r" {0,3}(?:> ?)+")
_DEFINITION = re.compile(r" {0,3}\[[^\]]+\]:")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})$")
_UNDERLINE = re.compile(r" {0,3}(?:=+|-+)$")
#: First characters of lines that may be more than paragraph text.
_MARKS = set(">`~<|[#=*_-+0123456789")
_CODE_SPAN = re.compile(r"`[^`\n]*[.!?…][^`\n]*`")


def text_blocks(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with marks inside blocks blanked (same length), and the ranges of its headings, paragraphs, list items and quotes.

    Fenced and indented code, table rows, HTML comments, link definitions and rules give no block. Ranges begin after the mark
    of a heading, item or quote and end before trailing white space.
    """
    blocks: list[tuple[int, int]] = []
    blanks: list[tuple[int, int]] = []
    first = last = -1  # the open paragraph
    fence, comment = "", False
    at, n = (1, len(text)) if text.startswith("﻿") else (0, len(text))

    def flush() -> None:
        nonlocal first, last
        if first >= 0:
            blocks.append((first, last))
        first = last = -1

    while at < n:
        stop = text.find("\n", at)
        if stop < 0:
            stop = n
        line = text[at:stop]
        start, at = at, stop + 1
        bare = line.strip()
        if fence:
            if bare.startswith(fence) and not bare.strip(fence[0]):
                fence = ""
            continue
        if comment:
            comment = "-->" not in line
            continue
        if not bare:
            flush()
            continue
        head = bare[0]
        if head not in _MARKS:
            if first < 0:
                if line[0] == "\t" or line.startswith("    "):
                    continue  # indented code
                first = start + len(line) - len(line.lstrip())
            last = start + len(line.rstrip())
            continue
        if head == ">" and (m := _QUOTE_MARK.match(line)):
            if first >= 0:
                blanks.append((start, start + m.end()))
            start += m.end()
            line = line[m.end() :]
            bare = line.strip()
            if not bare:
                flush()
                continue
            head = bare[0]
        if head in "`~" and (m := _FENCE.match(line)) and not (m[1][0] == "`" and "`" in line[m.end() :]):
            flush()
            fence = m[1]
            continue
        if head == "<" and bare.startswith("<!--"):
            flush()
            comment = "-->" not in line
            continue
        if head == "|":
            flush()
            continue
        if head == "[" and _DEFINITION.match(line):
            flush()
            continue
        if head == "#" and (m := _HEADING.match(line)):
            flush()
            a, b = m.end(), len(line.rstrip())
            body = line[a:b]
            if body.endswith("#") and (body.rstrip("#") == "" or body.rstrip("#")[-1] in " \t"):
                b = a + len(body.rstrip("#").rstrip())
            if b > a:
                blocks.append((start + a, start + b))
            continue
        if head in "=-" and first >= 0 and _UNDERLINE.match(line.rstrip()):
            flush()
            continue
        if head in "*_-" and _RULE.match(line.rstrip()):
            flush()
            continue
        if (head in "-*+" or head.isdigit()) and (m := _ITEM.match(line)):
            flush()
            a = m.end()
            while a < len(line) and (line[a] in " \t>"):
                a += 1
            if line[a:].strip():
                first, last = start + a, start + len(line.rstrip())
            continue
        if first < 0:
            if line[0] == "\t" or line.startswith("    "):
                continue  # indented code
            first = start + len(line) - len(line.lstrip())
        last = start + len(line.rstrip())
    flush()
    if blanks or "`" in text:
        out, k = [], 0
        spans = blanks + [(m.start(), m.end()) for m in _CODE_SPAN.finditer(text)] if "`" in text else blanks
        for a, b in sorted(spans):
            if a >= k:
                out += [text[k:a], ("x" if text[a] == "`" else " ") * (b - a)]
                k = b
        text = "".join([*out, text[k:]])
    return text, blocks


def word_before(text: str, stop: int, least: int) -> str:
    """The word (letters, digits, inner stops and hyphens) that ends before position stop."""
    near = text[max(least, stop - 24) : stop]
    if near and not near[-1].isspace():
        tail = near.rsplit(None, 1)[-1]
        if tail.isalnum() and (len(tail) < len(near) or stop - len(near) == least):  # the usual case: the word begins in sight
            return tail
    i = stop
    while i > least and (text[i - 1].isalnum() or text[i - 1] in ".-" or (text[i - 1] > "˿" and not text[i - 1].isspace() and text[i - 1] not in "“”„‘’‚…—–‹›")):
        i -= 1
    return text[i:stop].lstrip(".-")


@dataclass
class Words:
    """What a corpus says: its abbreviations, those that may close a sentence, and the words in small letters among those seen with a capital after a stop."""

    abbreviations: set[str] = field(default_factory=set)
    closing: set[str] = field(default_factory=set)
    small: set[str] = field(default_factory=set)
    #: Words of SEED that the corpus has often with a stop, and not as abbreviations.
    denied: set[str] = field(default_factory=set)


def _kind(text: str, at: int, stop: int) -> tuple[str, int]:
    """What comes at a position after a terminator: e (end of the block), l (small letter), d (digit), u (capital), o (other letter), x (something else); and its place."""
    while at < stop and text[at] in _SKIPPED:
        at += 1
    while at < stop and text[at] in _OPENERS:
        at += 1
        while at < stop and text[at] in _SKIPPED:
            at += 1
    if at >= stop:
        return "e", at
    c = text[at]
    if c.islower():
        return "l", at
    if c.isdigit():
        return "d", at
    if c.isupper() or c.istitle():
        return "u", at
    return ("o" if c.isalpha() else "x"), at


#: A stop, and the character after the white space that follows; none if the block ends there.
_STOP = re.compile(r"\.(?=\s|$)[ \t  ]*(?:\r?\n(?![ \t]*(?:\r?\n|[-*+>#|`~<]|\d+[.)][ \t]|$)))?[ \t  ]*([^\s\"”’'»“)\]])?")


_FENCED = re.compile(r"(?ms)^ {0,3}(```|~~~).*?(?:^ {0,3}\1[`~]*[ \t\r]*$|\Z)")


def stop_evidence(text: str | None, out: Counter) -> None:
    """Add the counts (word, kind) for the words before full stops in a document: what follows is l a small letter or digit, u a capital or other letter,
    e the end of the block.
    """
    if not text or "." not in text:
        return
    for m in _STOP.finditer(text):
        w, nxt = word_before(text, m.start(), 0), m[1]
        if not w or w[0].isdigit():
            continue
        if nxt != "|":  # a table row
            out[w.lower(), "e" if not nxt else "l" if nxt.islower() or nxt.isdigit() else "u"] += 1


#: A capitalised word after a full stop; a word that stands by itself, also one with a stop after it.
_STARTER = re.compile(r"\.[ \t\r\n\u00a0\u202f]+[\"“„«‹‘'(\[*_]*([^\W\d_]+)")
_WORD = re.compile(r"(?<![\w.'’-])[^\W\d_]+(?![\w'’-])")
#: Characters that a word standing by itself has neither before nor after it, besides letters and digits.
_JOINING = "_'’-"


def evidence(texts: Iterator[str]) -> Counter:
    """Counts (word, kind), all in small letters, over texts without their fenced code: those of stop_evidence; c a capitalised word after a full stop, s an occurrence in
    small letters, n any occurrence. Words are counted as they stand first, so that only distinct ones are looked at one by one."""
    out, words, starters = Counter(), Counter(), Counter()
    for text in texts:
        if "```" in text or "~~~" in text:
            text = _FENCED.sub("", text)
        stop_evidence(text, out)
        words.update(_WORD.findall(text))
        starters.update(_STARTER.findall(text))
    for w, n in starters.items():
        if w[0].isupper():
            out[w.lower(), "c"] += n
    for w, n in words.items():
        low = w.lower()
        if w == low:
            out[w, "s"] += n
        out[low, "n"] += n
    return out


#: A word counts as known to the corpus from this share of all its words on; so at most as many words reach the driver as this has in one.
LEAST_SHARE = 1e-6


def corpus_words(df: DataFrame, text: str) -> Words:
    """Abbreviations and small-letter words of a corpus, from all its texts.

    A word is an abbreviation if a stop after it is followed by a small letter or digit at least five times and in at least three cases of ten,
    or if it stands before capitals at least twenty times but hardly ever without a stop or at the end of a block: an ordinary word, however long, does both. It may close a
    sentence if at least one in two hundred of its stops ends a block. A word seen with a capital after a stop is an ordinary one if it occurs at least five times
    in small letters. All these counts must also reach LEAST_SHARE of the corpus's words, so that the driver receives at most a million words whatever the corpus.
    """
    src = df.select(F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull())
    kinds = "luecsn"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = evidence(batch.column(0).to_pylist())
            words = sorted({w for w, _ in total})
            cols = [pa.array([total[w, k] for w in words], pa.int64()) for k in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *cols], names=["word", *kinds])

    rows = src.mapInArrow(count, "word string, " + ", ".join(f"{k} long" for k in kinds)).groupBy("word").agg(*[F.sum(k).alias(k) for k in kinds])
    rows = checkpoint(rows)
    share = LEAST_SHARE * (rows.agg(F.sum("n")).first()[0] or 0)
    dotted = F.col("l") + F.col("u") + F.col("e")
    plain = F.greatest(F.col("n") - dotted, F.lit(0))
    inner = (F.col("l") >= max(5, share)) & (F.col("l") >= 0.3 * dotted)
    title = (F.col("u") >= max(20, share)) & (plain * 50 <= dotted) & (F.col("e") * 100 <= dotted)
    small = (F.col("c") > 0) & (F.col("s") >= max(5, share))
    out = Words()
    for r in rows.select("*", (inner | title).alias("abbreviation"), small.alias("small"), (F.col("word").isin(*SEED) & (dotted >= 20)).alias("seed")).where("abbreviation or small or seed").collect():
        if r["small"]:
            out.small.add(r["word"])
        if not r["abbreviation"]:
            if r["seed"]:
                out.denied.add(r["word"])
            continue
        out.abbreviations.add(r["word"])
        if r["e"] * 200 >= r["l"] + r["u"] + r["e"]:
            out.closing.add(r["word"])
    return out


class _Document:
    """Evidence of one document, gathered when first asked for."""

    def __init__(self, text: str, corpus: Words):
        self.text, self.corpus = text, corpus
        self._known: dict[str, bool] = {}
        self._ordinary: dict[str, bool] = {}
        self._lowered: str | None = None

    @property
    def lowered(self) -> str:
        """The text in small letters, at the same length."""
        if self._lowered is None:
            low = self.text.lower()
            self._lowered = low if len(low) == len(self.text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in self.text)
        return self._lowered

    def occurs(self, word: str, anyhow: bool) -> bool:
        """Whether a word stands by itself somewhere: as it is written, or anyhow written but without a stop after it."""
        text = self.lowered if anyhow else self.text
        at = text.find(word)
        while at >= 0:
            end = at + len(word)
            before, after = text[at - 1 : at], text[end : end + 1]
            if not (before and (before.isalnum() or before in _JOINING or before == ".")) and not (after and (after.isalnum() or after in _JOINING or (anyhow and after == "."))):
                return True
            at = text.find(word, at + 1)
        return False

    def before_small(self, word: str) -> int:
        """How often, up to twice, a small letter or digit follows the stop after a word."""
        n, at = 0, self.lowered.find(word + ".")
        while at >= 0 and n < 2:
            stop = at + len(word)
            m = _STOP.match(self.text, stop)
            if m and m[1] and (m[1].islower() or m[1].isdigit()) and word_before(self.text, stop, 0).lower() == word:
                n += 1
            at = self.lowered.find(word + ".", at + 1)
        return n

    def abbreviation(self, word: str) -> bool:
        """Whether a word is an abbreviation: as the document says, else the corpus, else the fixed list."""
        w = word.lower()
        got = self._known.get(w)
        if got is None:
            said = self._says(w)
            got = self._known[w] = said if said is not None else w in self.corpus.abbreviations or (w in SEED and w not in self.corpus.denied)
        return got

    def _says(self, w: str) -> bool | None:
        # yes: a small letter or digit after its stop at least twice, and never without a stop; no: only without one; else nothing
        inner = self.before_small(w)
        if inner < 2 and w not in self.corpus.abbreviations and w not in SEED:
            return False if not inner else None
        plain = self.occurs(w, True) if w.isalpha() else f" {w} " in self.text or f" {w}," in self.text
        return None if plain == (inner > 0) or (not plain and inner < 2) else not plain

    def closes(self, word: str) -> bool:
        return word.lower() in self.corpus.closing

    def ordinary(self, word: str) -> bool:
        """Whether a capitalised word is no proper name: it occurs in small letters in the document, or, where that has it neither so nor with a
        capital inside a sentence, in the corpus."""
        got = self._ordinary.get(word)
        if got is None:
            got = self._ordinary[word] = self._is_ordinary(word)
        return got

    def _is_ordinary(self, word: str) -> bool:
        low = word.lower()
        if not low:
            return False
        if self.occurs(low, False):
            return True
        at = self.text.find(f" {word}")
        while at > 0:
            end = at + 1 + len(word)
            if (self.text[at - 1].islower() or self.text[at - 1] == ",") and not self.text[end : end + 1].isalnum():
                return False
            at = self.text.find(f" {word}", end)
        return low in self.corpus.small


def _word_at(text: str, at: int, stop: int) -> str:
    end = at
    while end < stop and text[end].isalnum():
        end += 1
    return text[at:end]


def _caseless(c: str) -> bool:
    return c.isalpha() and not (c.islower() or c.isupper())


def _ends(doc: _Document, text: str, b: int, sent: int, pos: int, end: int) -> bool:
    """Whether the terminator text[pos:end] in a block that stops at b ends the sentence that began at sent."""
    mark = text[pos]
    nxt = text[end]
    if nxt not in _SKIPPED and mark in ".!?…؟۔" and not (mark != "." and _caseless(nxt)) and not any(c in "。！？．｡।॥" for c in text[pos:end]):
        return False
    kind, at = _kind(text, end, b)
    if kind == "e":
        return not _ALNUM.search(text, end, b)
    quote = ""
    if end - pos > 1:
        for c in text[pos:end]:
            if c in _QUOTES:  # a closing quotation mark follows the terminator
                quote = c
                break
    before = text[pos - 1] if pos > sent else " "
    if quote and (_caseless(before) or _is_mark(before)):
        # without capitals: a quotation ends the sentence only if a colon led to it
        opener = max(text.rfind(o, sent, pos) for o in _QUOTES[quote])
        lead = text[max(sent, opener - 2) : opener].rstrip(_SKIPPED) if opener >= 0 else ""
        return lead.endswith((":", "："))
    if kind == "l":
        return False
    if mark != ".":
        if (quote or mark == "…") and kind == "u":  # a sentence in capitals may go on
            return not (before.isupper() and _shouted(text, sent, pos, at, b))
        return mark != "…" or kind != "d"
    if text[pos + 1 : pos + 2] == ".":
        return True  # an ellipsis of three stops, before a capital
    word = word_before(text, pos, sent)
    if not word:
        return True
    if quote or text[pos + 1 : pos + 2] == ")":
        return not (kind == "d" and doc.abbreviation(word))
    last = word[-1]
    if last.isdigit():
        if kind == "d":
            return True
        return not (kind == "u" and len(word) <= 2 and word.isdigit() and _word_at(text, at, b).lower() in MONTHS)
    if len(word) == 1 or (len(word) == 2 and _is_mark(last)):
        # an initial, unless the next word is known as an ordinary one
        return kind not in "do" and doc.ordinary(_word_at(text, at, b)) and not doc.abbreviation(word)
    if "ऀ" <= last <= "ॿ":
        return False  # Devanagari has stops only in abbreviations
    if doc.abbreviation(word):
        # before a capital only an ordinary word shows a new sentence; a name may stand in either, there it counts whether the abbreviation closes any
        new = doc.closes(word) or (kind == "u" and doc.ordinary(_word_at(text, at, b)))
        return kind != "d" and new and not (word.isupper() and _shouted(text, sent, pos, at, b))
    return True


def _shouted(text: str, sent: int, pos: int, at: int, b: int) -> bool:
    """Whether a sentence in capitals goes on at a place: the next word is all in capitals, as all before it was."""
    word = _word_at(text, at, b)
    return len(word) > 1 and word.isupper() and text[sent:pos].isupper()


def _is_mark(c: str) -> bool:
    """Vowel signs and other combining marks of Indic and Thai script."""
    return "ऀ" <= c <= "෿" or "ั" <= c <= "๎"


def sentence_ends(text: str | None, corpus: Words | None = None) -> list[int]:
    """Offsets just past the last character of each sentence, ascending; [] for a null or empty text."""
    if not text:
        return []
    masked, blocks = text_blocks(text)
    doc = _Document(masked, corpus or Words())
    thai = not masked.isascii() and _THAI_LETTER.search(masked) is not None
    out: list[int] = []
    for a, b in blocks:
        sent = a
        cuts: list[int] = []
        for m in _TERM.finditer(masked, a, b):
            pos, end = m.span()
            if end - pos > 1:
                last = masked[end - 1]
                # a » after a space closes only what « opened, and “ only what „ opened
                if last == "»" and masked[end - 2] in "   " and masked.rfind("«", sent, pos) <= masked.rfind("»", sent, pos):
                    end -= 2
                elif "“" in m[0] and masked.rfind("„", sent, pos) < 0:
                    end = pos + m[0].index("“")
            if end < b and _ends(doc, masked, b, sent, pos, end):
                cuts.append(end)
                sent = end
        if thai:
            more = [m.end(1) for m in _THAI_GAP.finditer(masked, a, b)]
            if more:
                cuts = sorted({*cuts, *more})
        begin = a
        for c in cuts:
            if _ALNUM.search(text, begin, c):
                out.append(c)
                begin = c
        if _ALNUM.search(text, begin, b):
            out.append(b)
    return out


def split_sentences(df: DataFrame, text: str, keep: list[str], corpus: Words | None = None) -> DataFrame:
    """One row per sentence, in order: keep..., ordinal from 0, start_pos, end_pos (offsets in code points of the text as stored), sentence.

    Sentences are sought in headings, paragraphs, list items and block quotes of Markdown; null, empty and blank texts, and texts of code only,
    give none. A byte order mark, CR and LF count one each. Whole texts are split, whatever their length. No shuffle.
    """
    src = df.select(*keep, F.col(text).cast("string").alias("__t")).where(F.col("__t").isNotNull())
    schema = ", ".join([*[f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep], "ordinal int, start_pos long, end_pos long, sentence string"])
    words = corpus or Words()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):  # bounds what is held at a time
                part = batch.slice(lo, 500)
                at, ordinal, starts, ends, sents = [], [], [], [], []
                for i, t in enumerate(part.column("__t").to_pylist()):
                    before = 0
                    for k, e in enumerate(sentence_ends(t, words)):
                        s = t[before:e]
                        begin = before + len(s) - len(s.lstrip("﻿ \t\r\n "))
                        at.append(i)
                        ordinal.append(k)
                        starts.append(begin)
                        ends.append(e)
                        sents.append(t[begin:e])
                        before = e
                take = pa.array(at, pa.int32())
                cols = [pa.array(ordinal, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(sents, pa.string())]
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(take) for c in keep], *cols], names=[*keep, "ordinal", "start_pos", "end_pos", "sentence"])

    return src.mapInArrow(split, schema)


def sentence_positions(df: DataFrame, text: str, keep: list[str], corpus: Words | None = None) -> DataFrame:
    """As split_sentences, but only keep... and end_pos."""
    src = df.select(*keep, F.col(text).cast("string").alias("__t")).where(F.col("__t").isNotNull())
    schema = ", ".join([*[f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep], "end_pos long"])
    words = corpus or Words()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ends = [], []
            for i, t in enumerate(batch.column("__t").to_pylist()):
                got = sentence_ends(t, words)
                ends += got
                at += [i] * len(got)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in keep], pa.array(ends, pa.int64())], names=[*keep, "end_pos"])

    return src.mapInArrow(split, schema)
