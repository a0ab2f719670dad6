"""Line-first quality rules: failing lines go, then documents that lost too much of their text.

A null or empty text has no words and is not kept (under ten words). Repeated
rows are judged each. Other columns pass or are not read; an empty table gives
an empty one. Texts are judged whole, one at a time.
"""

from __future__ import annotations

import operator
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField

from .arrow import map_texts

SPACE = b"\t\n\x0b\x0c\r "
SYMBOLS = b"#*$%&|<>"
#: A document fails below so many words, or where repeated windows of words cover more than this share.
LEAST_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
#: A document whose failing lines hold more than this share of its word characters is rejected.
MOST_LOST = 0.5

# Marks that separate menu entries, and phrases of page furniture.
SEPARATORS = "|»›•·"
NOISE_MARKS = b"#*$%&<>~^=_\\!?"
UPPER, LOWER = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
NOISE = re.compile(r"[#*$%&<>~^=_\\]|[!?]{2}")
BOILERPLATE = re.compile(
    r"\b(?:accept (?:all )?cookies|all rights reserved|click here|cookie policy|enable javascript|javascript is disabled"
    r"|log ?in|privacy policy|read more|share this|sign (?:in|up)|skip to content|subscribe now|terms of (?:use|service))\b",
    re.IGNORECASE)
#: Page furniture stands in short lines; longer ones are prose that mentions it.
FURNITURE_WORDS = 15


def _shouts(line: str, raw: bytes) -> bool:
    """Whether four in five cased characters and more are upper-case; ASCII letters alone tell that most lines' are not."""
    lower = _count(raw, LOWER)
    if _count(raw, UPPER) + len(raw) - len(raw.decode("ascii", "ignore")) <= 4 * lower:
        return False
    return sum(map(str.isupper, line)) > 4 * sum(map(str.islower, line))


def _count(raw: bytes, of: bytes) -> int:
    return len(raw) - len(raw.translate(None, of))


def line_fault(line: str) -> str | None:
    """The first rule that a line with words breaks, or None."""
    words, raw = line.split(), line.encode("utf-8", "replace")
    n = len(words)
    if sum(map(line.count, SEPARATORS)) >= max(3, n // 4):
        return "navigation"
    # No match is without such a mark.
    if n >= 3 and _count(raw, NOISE_MARKS) >= n and len(NOISE.findall(line)) >= n:
        return "symbols"
    if n <= FURNITURE_WORDS and BOILERPLATE.search(line):
        return "boilerplate"
    if n >= 5 and _shouts(line, raw):
        return "shouting"
    if n >= 8 and sum(map(operator.eq, words, words[1:])) > 0.3 * n:
        return "stutter"
    if n <= 2 and line.rstrip()[-1:].isalnum():
        return "fragment"
    return None


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``window`` words that stand twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = hashes[:n].copy()
    for i in range(1, window):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + hashes[i:n + i]
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    # Equal keys are candidates; the words themselves decide.
    places = np.flatnonzero(np.isin(keys, twice)).tolist()
    found = [tuple(words[i:i + window]) for i in places]
    counts = Counter(found)
    covered = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(places, found, strict=True):
        if counts[w] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


def _word_chars(text: bytes) -> int:
    return len(text.translate(None, SPACE).decode("utf-8", "replace"))


def judge(text: bytes | None, most_lost: float = MOST_LOST) -> tuple:
    """Counts, verdicts, lines and failing lines, lost share, and the text without failing lines.

    A line that equals an earlier one fails as well. Lines without words stay.
    """
    text = text or b""
    words = text.split()
    size = _word_chars(text)
    seen: set[bytes] = set()
    kept, lines, failed, repeats, lost = [], 0, 0, 0, 0
    for line in text.split(b"\n"):
        if line.translate(None, SPACE):
            lines += 1
            again = line in seen
            repeats += again
            seen.add(line)
            if again or line_fault(line.decode("utf-8", "replace")):
                failed += 1
                lost += _word_chars(line)
                continue
        kept.append(line)
    repeated = repeated_words(words)
    base_failed = len(words) < LEAST_WORDS or 100 * repeated > REPEAT_PERCENT * len(words)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    share = lost / size if size else 0.0
    return (len(words), size, symbols, repeats, repeated, base_failed, not base_failed and share <= most_lost,
            lines, failed, share, b"\n".join(kept))


_FIELDS = (
    ("n_words", LongType()), ("word_chars", LongType()), ("n_symbols", LongType()), ("n_dup_lines", LongType()),
    ("n_repeat_words", LongType()), ("base_failed", BooleanType()), ("kept", BooleanType()), ("n_lines", LongType()),
    ("n_failed_lines", LongType()), ("lost_share", DoubleType()), ("cleaned", StringType()),
)
_ARROW = {LongType: pa.int64(), BooleanType: pa.bool_(), DoubleType: pa.float64(), StringType: pa.string()}


def quality_rules(df: DataFrame, keep: list[str], text: str = "text", most_lost: float = MOST_LOST, prefix: str = "",
                  with_text: bool = True) -> DataFrame:
    """The ``keep`` columns with counts, verdicts and (where asked) the cleaned text, named with ``prefix``."""
    fields = _FIELDS if with_text else _FIELDS[:-1]

    def make(texts: list[bytes | None]) -> list[pa.Array]:
        rows = [judge(t, most_lost) for t in texts]
        return [pa.array([r[i] if kind != StringType() else r[i].decode("utf-8", "replace") for r in rows], _ARROW[type(kind)])
                for i, (_, kind) in enumerate(fields)]

    return map_texts(df, text, keep, [StructField(prefix + name, kind) for name, kind in fields], make)


def clean_documents(df: DataFrame, text: str = "text", length: str = "n_chars", most_lost: float = MOST_LOST) -> DataFrame:
    """The kept documents, same columns, with their failing lines removed and ``length`` brought up to date."""
    mark = "__llm_"
    judged = quality_rules(df, df.columns, text, most_lost, mark).filter(F.col(mark + "kept"))
    cleaned = F.col(mark + "cleaned")
    changed = F.col(mark + "n_failed_lines") > 0
    new = {text: F.when(changed, cleaned).otherwise(F.col(f"`{text}`"))}
    if length in df.columns:
        new[length] = F.when(changed, F.char_length(cleaned)).otherwise(F.col(f"`{length}`")).cast(df.schema[length].dataType)
    return judged.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])
