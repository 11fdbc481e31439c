"""Personal data with offset-preserving deobfuscation.

Base detection finds e-mail addresses, IPv4 addresses, card numbers and phone
numbers in the text as it is, by linear scans.  Texts with a hint of disguise
then pass through three transducers, each of which keeps for every character the
span of the source it stands for: look-alike and invisible characters, spelled
digits, and at/dot disguises.  What the base detectors find in the normalised
text, and owes to an edit, is mapped back to the source and added.

Edge cases: a null or empty text has no spans; a span is never cut; texts of any
length are scanned whole; each row is judged on its own, so repeated rows and
clashing columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from twinfold.functions.ship import ship
from twinfold.llm.kernels import chunks

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Numbers joined by points, in one piece; four at a time they may be an address.
POINTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
NUMBER = re.compile(r"[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # kind's number, start, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base(text: str) -> list[Span]:
    """Spans by kind, then start."""
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    if NUMBER.search(text) is None:
        return out
    for m in POINTED.finditer(text):
        if m[0].count(".") >= 3:
            parts = list(NUMBER.finditer(text, *m.span()))
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                if all(len(p := x[0].lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                    out.append((1, four[0].start(), four[3].end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((3, *m.span()))
    return out


class Mapped:
    """A text whose every character knows the span of the source it stands for, and whether an edit made it."""

    def __init__(self, text: str):
        self.text = text
        self.starts = list(range(len(text)))
        self.ends = list(range(1, len(text) + 1))
        self.edited = [False] * len(text)

    def edit(self, edits: list[tuple[int, int, str, list[tuple[int, int]] | None]]) -> None:
        """Put other characters for spans, in order; each new one stands for its own span of the present text, or the whole."""
        text, starts, ends, edited, at = [], [], [], [], 0
        for a, z, new, own in edits:
            text.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            edited += self.edited[at:a]
            text.append(new)
            for b, y in own or [(a, z)] * len(new):
                starts.append(self.starts[b])
                ends.append(self.ends[y - 1])
                edited.append(True)
            at = z
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends, self.edited = starts + self.starts[at:], ends + self.ends[at:], edited + self.edited[at:]


#: Look-alikes that compatibility normalisation leaves alone: Cyrillic, then Greek, then others.
LIKE: dict[str, str] = {}
for _from, _to in (
    ("асԁеһіјкӏмноррԛѕтԝхуѵ", "acdehijklmhoppqstwxyv"),
    ("АВСЕНІЈКМОРЅТХУ", "ABCEHIJKMOPSTXY"),
    ("αεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeiknoptuxABEZHIKMNOPTYX"),
    ("ı․。﹒∙", "i...."),
):
    LIKE |= dict(zip(_from, _to, strict=True))
INVISIBLE = "­​‌‍‎‏⁠﻿"
ODD = re.compile("[­ıͰ-ԯ٠-٩۰-۹०-९ ​-‏‐-―․ ⁠⁰-₉∙①-⓿。﹒﹫＀-￯\U0001d400-\U0001d7ff﻿]")


def _plain(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LIKE:
        return LIKE[c]
    if "‐" <= c <= "―":
        return "-"
    d = unicodedata.digit(c, None)
    if d is not None:
        return str(d)
    n = unicodedata.normalize("NFKC", c)
    return n if n.isascii() else LIKE.get(n, c)


#: Spelled digits in the corpus's languages, from zero on; spellings that several share stand once.
SPELLED = {
    w: str(i % 10)
    for words in ("zero one two three four five six seven eight nine oh", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
    for i, w in enumerate(words.split())
}
_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_OPEN, _SHUT = r"[\[({<]\s{0,2}", r"\s{0,2}[\])}>]"
_DOT = rf"(?:\s{{0,2}}{_OPEN}(?:dot|punkt|punto|point|\.){_SHUT}\s{{0,2}}|\s{{1,2}}(?:dot|punkt|punto|point)\s{{1,2}}|\s?\.\s?)"
AT = re.compile(rf"\s{{0,2}}{_OPEN}(?:at|@|arobase|arroba){_SHUT}\s{{0,2}}|\s{{1,2}}(?:at|arobase|arroba|@)\s{{1,2}}|@", re.I)
HOST = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
DOT = re.compile(_DOT, re.I)
FOUR = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
#: What every disguise that _hosts undoes holds: an AT other than a plain @, or a _DOT other than a plain point.
HINT = re.compile(rf"{_OPEN}(?:at|@|arobase|arroba|dot|punkt|punto|point|\.){_SHUT}|\s(?:at|dot|punkt|punto|point|arobase|arroba)\s|\s@|@\s", re.I)
_POINT = rf"(?:\s{{0,2}}{_OPEN}(?:dot|punkt|punto|point|\.){_SHUT}\s{{0,2}}|\s{{1,2}}(?:dot|punkt|punto|point)\s{{1,2}})"
#: Spelled digits and numerals side by side, or with spelled points between them.
RUN = re.compile(rf"(?<![^\W_])(?:(?:plus|más|mas)[\s,.-]{{1,3}})?(?:{_WORD}|[0-9]++)(?:(?:{_POINT}|[\s,.-]{{1,3}})(?:{_WORD}|[0-9]++)(?![^\W_]))+", re.I)
#: The pieces of a run: digits, signs, and spelled points; what is between them is a separator.
PIECE = re.compile(rf"(?<![^\W_])(?:plus|más|mas|{_WORD}|[0-9]++)(?![^\W_])|{_POINT}", re.I)
DIGIT_WORD = re.compile(rf"(?<![^\W_])(?:{_WORD})(?![^\W_])", re.I)
#: A disguised dot right before a place, in the local part of an address.
BEFORE = re.compile(rf"(?:\s{{0,2}}{_OPEN}(?:dot|punkt|punto|point|\.){_SHUT}\s{{0,2}}|\s{{1,2}}(?:dot|punkt|punto|point)\s{{1,2}})\Z", re.I)
LABEL = re.compile(r"[A-Za-z0-9-]+")
#: Last labels that a host must have if neither its last dot nor the at has brackets.
LAST = frozenset("com net org edu gov mil int info biz io ai app dev co me tv uk us ca au de fr es it nl be ch at eu pt pl se no dk fi ie in jp cn br mx ar example test".split())


def _bracketed(disguise: str) -> bool:
    return disguise.strip()[:1] in set("[({<")


def _local(text: str, at: int, least: int, plain: bool) -> list[tuple[int, int, str, None]]:
    """Edits that put . for the disguised dots of the local part that ends at a place; before a plain @ only for bracketed ones."""
    out = []
    while True:
        start = at
        while start > least and text[start - 1] in LOCAL:
            start -= 1
        low = max(least, start - 16)
        d = BEFORE.search(text[low:start])
        if start == at or d is None or low + d.start() <= least or text[low + d.start() - 1] not in LOCAL or plain and not _bracketed(d[0]):
            return out[::-1]
        out.append((low + d.start(), start, ".", None))
        at = low + d.start()


def _hosts(text: str) -> list[tuple[int, int, str, None]]:
    """Edits that put @ and . for their disguises in addresses."""
    out: list[tuple[int, int, str, None]] = []
    done = 0
    for m in AT.finditer(text):
        if m.start() <= done or text[m.start() - 1] not in LOCAL or m.start() == 0:
            continue
        h = HOST.match(text, m.end())
        if h is None:
            continue
        dots = list(DOT.finditer(text, h.start(), h.end()))
        # Plain points end at the first that white space follows, as sentences do.
        for d in dots:
            if d[0].strip() == "." and d[0] != ".":
                dots = [x for x in dots if x.start() < d.start()]
                break
        after = [LABEL.match(text, d.end()) for d in dots]
        # A bare word that doesn't end a host belongs to the sentence.
        while len(dots) > 1 and dots[-1][0].strip() != "." and not _bracketed(dots[-1][0]) and (after[-1] is None or after[-1][0].lower() not in LAST):
            dots.pop()
            after.pop()
        if not dots or after[-1] is None:
            continue
        plain = m[0] == "@" and all(d[0] == "." for d in dots)
        local = _local(text, m.start(), done, m[0] == "@")
        if plain and not local or not plain and not _bracketed(m[0]) and not _bracketed(dots[-1][0]) and after[-1][0].lower() not in LAST:
            continue
        edits = [*local, (m.start(), m.end(), "@", None), *[(d.start(), d.end(), ".", None) for d in dots]]
        out += [e for e in edits if text[e[0] : e[1]] != e[2]]
        done = after[-1].end()
    for m in FOUR.finditer(text):
        out += [(d.start(), d.end(), ".", None) for d in DOT.finditer(text, *m.span()) if d[0] != "." and d[0].strip() != "."]
    out.sort()
    return [e for i, e in enumerate(out) if not i or e[0] >= out[i - 1][1]]


def _digits(text: str) -> list[tuple[int, int, str, list[tuple[int, int]]]]:
    """Edits that put digits for spelled ones; separators go, but those between two numerals stay."""
    out = []
    for m in RUN.finditer(text):
        if DIGIT_WORD.search(text, *m.span()) is None:
            continue
        new: list[str] = []
        own: list[tuple[int, int]] = []
        last = None
        for x in PIECE.finditer(text, *m.span()):
            word = x[0].lower()
            if word.isdigit():
                kept = range(last if last is not None else x.start(), x.end())
                new += [text[i] for i in kept]
                own += [(i, i + 1) for i in kept]
                last = x.end()
            else:
                new.append(SPELLED.get(word) or ("+" if word in ("plus", "más", "mas") else "."))
                own.append(x.span())
                last = None
        out.append((*m.span(), "".join(new), own))
    return out


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each by kind, then start."""
    if not text:
        return [], []
    own = base(text)
    odd = not text.isascii() and ODD.search(text) is not None
    spelled = DIGIT_WORD.search(text) is not None and any(DIGIT_WORD.search(text, *x.span()) for x in RUN.finditer(text))
    # Without those two kinds the hosts' edits are the only ones, so a text with none needs no map.
    if not odd and not spelled and (HINT.search(text) is None or not _hosts(text)):
        return own, own
    m = Mapped(text)
    if odd:
        m.edit([(x.start(), x.end(), _plain(x[0]), None) for x in ODD.finditer(text) if _plain(x[0]) != x[0]])
    m.edit(_digits(m.text))
    m.edit(_hosts(m.text))
    if not any(m.edited) and len(m.text) == len(text):
        return own, own
    more = []
    for kind, a, z in base(m.text):
        start, end = m.starts[a], m.ends[z - 1]
        plain = end - start == z - a and not any(m.edited[a:z])
        if not plain and not any(k == kind and s <= start and end <= e for k, s, e in own):
            more.append((kind, start, end))
    return own, sorted(own + more)


def written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in found)


def masked(text: str | None, found: list[Span]) -> str | None:
    """The text with a placeholder for each span; spans that overlap share one, named after the first."""
    if not found:
        return text
    out, at, last = [], 0, -1
    for a, z, k in sorted((a, z, k) for k, a, z in found):
        if a >= last:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        last = at = max(last, z)
    return "".join([*out, text[at:]])


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, all spans as text."""
    ship(docs.sparkSession)
    schema = docs.select("doc_id").schema.add("n_email", "long").add("n_ip", "long").add("n_card", "long").add("n_phone", "long").add("base_sha256", "string").add("spans", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            both = [spans(t.as_py()) for t in part.column("text")]
            counts = [pa.array([sum(k == kind for k, _, _ in own) for own, _ in both], pa.int64()) for kind in range(4)]
            sha = [hashlib.sha256(written(own).encode()).hexdigest() for own, _ in both]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array(sha, pa.string()), pa.array([written(a) for _, a in both], pa.string())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def mask(docs: DataFrame) -> DataFrame:
    """docs with placeholders for personal data in text, and n_chars (if there is such a column) counted anew."""
    ship(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts = [masked(t.as_py(), spans(t.as_py())[1]) for t in part.column("text")]
            columns = dict(zip(names, part.columns)) | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                old = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([n if n is None or t is None else len(t) for n, t in zip(old, texts)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(run, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(spark.read.parquet(f"{sf_dir}/documents.parquet"))
