"""Personal data in texts, also in disguise, with the source characters of every find.

Plain patterns give the base spans. Where a cheap test says that a disguise may be there, transducers rewrite
the text step by step (look-alike and invisible characters, ``at`` and ``dot`` in words or brackets, spelled digits) and
carry for every character the range of source characters that it stands for; the same patterns then run on the
rewritten text, and finds that depend on a rewriting are mapped back and added. Base spans always stay.

Nulls: a null text is empty and has no spans. Repeated rows are scanned one by one; spans are ordered by kind, start and end, so
there are no ties. An empty table gives no rows. Columns other than ``doc_id`` and ``text`` are ignored by ``find`` and
kept by ``redact``. Texts are scanned whole, in time that grows with their length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmerge.llm.common import id_number, id_text

KINDS = ("email", "ip", "card", "phone")

# Fixed by the contract; the guards before a digit only save retries inside of one run of digits.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, ``@`` and domain: from each ``@`` to the left as far as the last match allows."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the plain patterns."""
    found = [(0, *span) for span in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 13:
            digits = match.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, *match.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return found


#: Cyrillic and Greek letters, and marks, that look like ASCII characters.
_ALIKE = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο" + "＠．﹫。․", "ABEKMHOPCTXaeopcyxijsd" + "ABEZHIKMNOPTYXo" + "@.@.."))
_ALIKE |= dict(zip("ЅІЈУҮԌԚԜѴЗЬӀҺԛԝѵүһӏгктмпьвнҽԍ" + "αβγεηικνρσςτυχωϲϹϳͿϱϝ", "SIJYYGQWV3blhqwvyhlrktmnbbheg" + "abyenikvpoctuxwcCjJpf"))


def _lookalikes() -> dict[str, str]:
    """What a character stands for: its digit value, else its compatibility form (NFKC) if that is, or looks like, one ASCII character; invisible ones nothing."""
    found = {}
    for code in range(0x80, 0x20000):
        char = chr(code)
        plain = _ALIKE.get(char) or unicodedata.normalize("NFKC", char)
        digit = unicodedata.digit(char, None)
        plain = _ALIKE.get(plain, plain) if digit is None else str(digit)
        if len(plain) == 1 and "\x20" <= plain <= "\x7e" or 0xFB00 <= code <= 0xFB06:  # the last are ligatures of ASCII letters
            found[char] = plain
    return found | dict.fromkeys("\u00ad\u200b\u200c\u200d\u2060\ufeff", "")


def _ranges(chars: Iterable[str]) -> str:
    """A pattern's character class of few ranges."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]"


LOOKALIKES = _lookalikes()
_LOOKALIKE = re.compile(_ranges(LOOKALIKES))
NUMERALS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_NUMERAL = "|".join((*NUMERALS, "oh"))
_SPELLED = re.compile(rf"(?i)\b(?:(?:{_NUMERAL})|[0-9]+)(?:[\s.,-]{{1,3}}(?:(?:{_NUMERAL})|[0-9]+))+\b")
_WORDS = re.compile(rf"(?i){_NUMERAL}")
_PART = re.compile(rf"(?i){_NUMERAL}|[0-9]+")
#: Found by their brackets; white space before them is taken along by hand, so that long runs of it are read once.
_BRACKET_AT = re.compile(r"(?i)[\[({<]\s*at\s*[\])}>]\s*")
_BRACKET_DOT = re.compile(r"(?i)[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*")
#: Words after ``at`` that make it and ``dot`` plain words, unless a common ending follows; all other names take any last label.
LAST_LABELS = "com org net edu gov info biz io co eu uk de fr es it nl at ch us ca au".split()
DETERMINERS = "the a an this that these those each every any some no his her its my your our their another which what".split()
_DISGUISED_DOT = r"(?:\s+dot\s+|\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*)"
_LABELS = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"
_NAMES = rf"{_LABELS}(?:{_DISGUISED_DOT}{_LABELS})*{_DISGUISED_DOT}(?:[A-Za-z0-9-]+\.)*"
_WORD_AT = re.compile(
    rf"(?i)(?<=[A-Za-z0-9_])\s+at\s+(?={_NAMES}(?:{'|'.join(LAST_LABELS)})\b|(?!(?:{'|'.join(DETERMINERS)})\b){_NAMES}[a-z]{{2,}}(?![a-z0-9-]))"
)
_WORD_DOT = re.compile(r"(?i)(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9])")
_PLUS = re.compile(r"(?i)\bplus\s+(?=[0-9])")
#: Digits that a run without ``+`` needs to count as a phone number, and how many of them have to be spelled; runs that a
#: checksum, an address's form or a ``+`` proves need one spelled digit only.
SPELLED_PHONE, SPELLED_LEAST = 9, 3


class Rewritten:
    """A rewritten text and the source range of every character."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text))
        self.ends = self.starts + 1
        self.spelled: list[tuple[int, int]] = []

    def replace(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Apply edits (start, end, new text) in order; every new character stands for the whole range replaced."""
        texts, starts, ends, done = [], [], [], 0
        for start, end, new in edits:
            texts += [self.text[done:start], new]
            starts += [self.starts[done:start], np.full(len(new), self.starts[start])]
            ends += [self.ends[done:start], np.full(len(new), self.ends[end - 1])]
            done = end
        if done:
            self.text = "".join((*texts, self.text[done:]))
            self.starts = np.concatenate((*starts, self.starts[done:]))
            self.ends = np.concatenate((*ends, self.ends[done:]))

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start]), int(self.ends[end - 1])


def _marks(text: str, pattern: re.Pattern, new: str) -> Iterator[tuple[int, int, str]]:
    """Edits of a pattern's matches with the white space around them."""
    done = 0
    for match in pattern.finditer(text):
        start = match.start()
        while start > done and text[start - 1].isspace():
            start -= 1
        done = match.end()
        yield start, done, new


def _digits(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits that turn runs with spelled digits into digits."""
    for run in _SPELLED.finditer(text):
        parts = list(_PART.finditer(text, *run.span()))
        if all(p.group().isdigit() for p in parts):
            continue
        end = run.start()
        for part in parts:
            between, word = text[end : part.start()], part.group().lower()
            if end < part.start():
                yield end, part.start(), "." if between.strip() == "." else ""
            if not word.isdigit():
                yield *part.span(), str(NUMERALS.index(word) if word in NUMERALS else 0)
            end = part.end()


def rewrite(text: str) -> Rewritten | None:
    """The text without disguises; None where there is nothing to rewrite."""
    lower = text.lower()
    glyphs = not text.isascii() and _LOOKALIKE.search(text)
    marks = "dot" in lower or ("at" in lower and any(b in text for b in "[({<") and _BRACKET_AT.search(text)) or (any(b in text for b in "[({<") and _BRACKET_DOT.search(text))
    numerals = any(n in lower for n in (*NUMERALS, "oh")) and _SPELLED.search(text)
    if not (glyphs or marks or numerals):
        return None
    made = Rewritten(text)
    if glyphs:
        made.replace((m.start(), m.end(), LOOKALIKES[m.group()]) for m in _LOOKALIKE.finditer(text))
    for pattern, new in ((_BRACKET_AT, "@"), (_WORD_AT, "@"), (_BRACKET_DOT, "."), (_WORD_DOT, ".")):
        made.replace(list(_marks(made.text, pattern, new)))
    made.replace(list(_digits(made.text)))
    made.replace([(*m.span(), "+") for m in _PLUS.finditer(made.text)])
    return made


def _rewritten_spans(text: str, made: Rewritten) -> Iterator[Span]:
    """Finds that depend on the rewriting, in source characters."""
    found = base_spans(made.text)
    for match in _CARD.finditer(made.text):  # digit words stand for a phone number also without a plus
        start, end = made.source(*match.span())
        letters = re.findall(rf"(?i){_NUMERAL}", text[start:end])
        if len(letters) >= SPELLED_LEAST and SPELLED_PHONE <= len(_DIGIT.findall(match.group())) <= 15 and not any(s <= match.start() and match.end() <= e for _, s, e in found):
            found.append((3, *match.span()))
    for kind, start, end in found:
        source = made.source(start, end)
        if text[source[0] : source[1]] != made.text[start:end]:
            yield kind, *source


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), both in the order of kind and start."""
    base = sorted(base_spans(text))
    made = rewrite(text)
    if made is None:
        return base, base
    by_kind = [[(s, e) for k, s, e in base if k == kind] for kind in range(len(KINDS))]

    def inside(kind: int, start: int, end: int) -> bool:
        at = bisect_right(by_kind[kind], (start, 1 << 60)) - 1
        return at >= 0 and end <= by_kind[kind][at][1]

    def overdone(kind: int, start: int, end: int) -> bool:
        """A number that is complete without the one or two digit words beside it."""
        if not kind or not 0 < len(_WORDS.findall(text, start, end)) < SPELLED_LEAST:
            return False
        at = bisect_right(by_kind[kind], (start, -1))
        return at < len(by_kind[kind]) and by_kind[kind][at][1] <= end

    return base, sorted({*base, *(x for x in _rewritten_spans(text, made) if not inside(*x) and not overdone(*x))})


def _written(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redacted(text: str | None) -> str | None:
    """The text with ``[KIND]`` for every find; finds that overlap become one mark."""
    if not text:
        return text
    parts, done, last = [], 0, -1
    for start, end, kind in sorted((s, e, k) for k, s, e in all_spans(text)[1]):
        if start >= last:
            parts += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = last = max(last, end)
    return "".join((*parts, text[done:]))


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            base, every = all_spans(text or "")
            counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
            rows.append((doc_id, *counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(every), len(every) - len(base)))
        yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])


def find(documents: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, base counts by kind, ``base_sha256``, ``spans`` (all), ``n_added``."""
    source = documents.select(id_text("doc_id"), F.col("text").cast("string"))
    found = source.mapInPandas(_found, "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return found.withColumn("doc_id", id_number("doc_id"))


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with finds in ``text`` replaced by marks; ``n_chars``, if there, follows."""
    clean = F.pandas_udf(lambda texts: pd.Series([redacted(t) for t in texts], dtype=object), "string")
    made = documents.withColumn("text", clean(F.col("text")))
    return made.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else made
