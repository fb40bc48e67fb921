"""Numeric descriptors of whole texts; they stand where molecule descriptors stand."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Descriptor names in canonical order, and the two views of them.
DESCRIPTORS = [
    "t_chars",
    "t_words",
    "t_distinct",
    "t_digit",
    "t_upper",
    "t_punct",
    "t_lines",
    "t_wordlen",
]
VIEW_SIZE = ["t_chars", "t_words", "t_lines", "t_wordlen"]
VIEW_STYLE = ["t_distinct", "t_digit", "t_upper", "t_punct"]

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


DIGITS = "0123456789"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _count_of(text: Column, chars: str) -> Column:
    """How many of the characters a text has, without an array of matches."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _share_of(text: Column, chars: str) -> Column:
    return F.coalesce(_count_of(text, chars) / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \t\r\n]+"), "")


def text_descriptors(text: Column, split_words: Column | None = None) -> list[Column]:
    """The descriptors in canonical order; pass the words when they are a column already."""
    w = words(text) if split_words is None else split_words
    n_words, n_distinct = F.size(w), F.size(F.array_distinct(w))
    letters = F.length(F.array_join(w, ""))
    return [
        F.length(text).cast("double").alias("t_chars"),
        n_words.cast("double").alias("t_words"),
        F.coalesce(n_distinct / F.nullif(n_words, F.lit(0)), F.lit(0.0)).alias(
            "t_distinct"
        ),
        _share_of(text, DIGITS).alias("t_digit"),
        _share_of(text, CAPITALS).alias("t_upper"),
        _share_of(text, PUNCTUATION).alias("t_punct"),
        (_count_of(text, "\n") + F.lit(1)).cast("double").alias("t_lines"),
        F.coalesce(letters / F.nullif(n_words, F.lit(0)), F.lit(0.0)).alias("t_wordlen"),
    ]


# --- the same descriptors over Arrow batches -----------------------------------------------

#: Bytes of text whose marks are held at a time.
MEASURED_BYTES = 1_000_000
_GAP, _LINE, _DIGIT, _CAPITAL, _MARK, _TAIL = (1 << i for i in range(6))


def _byte_marks() -> np.ndarray:
    """What each byte of UTF-8 counts as; characters of one byte never occur inside longer ones."""
    marks = np.zeros(256, np.uint8)
    for chars, mark in ((" \t\r\n", _GAP), ("\n", _LINE), (DIGITS, _DIGIT), (CAPITALS, _CAPITAL), (PUNCTUATION, _MARK)):
        marks[[ord(c) for c in chars]] |= mark
    marks[0x80:0xC0] = _TAIL
    return marks


_MARKS = _byte_marks()
_TO_BLANK = bytes(32 if _MARKS[b] & _GAP else b for b in range(256))


def _measured(text: pa.Array) -> dict[str, np.ndarray]:
    """``text_descriptors`` of a batch; of a missing text only the shares and means are numbers, 0."""
    text = text.cast(pa.large_binary())
    n, missing = len(text), np.array(text.is_null())
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + n + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
    size = np.diff(at)
    counts = {k: np.zeros(n) for k in ("chars", "words", "distinct", "gap", "line", "digit", "upper", "punct")}
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + MEASURED_BYTES, side="right")) - 1)
        some = first + np.flatnonzero(size[first:last])
        if len(some):
            raw = data[at[first]:at[last]]
            marks, starts = _MARKS[raw], at[some] - at[first]
            total = lambda flags, starts=starts: np.add.reduceat(flags, starts, dtype=np.int64)
            for name, mark in (("gap", _GAP), ("line", _LINE), ("digit", _DIGIT), ("upper", _CAPITAL), ("punct", _MARK)):
                counts[name][some] = total((marks & mark) != 0)
            counts["chars"][some] = size[some] - total((marks & _TAIL) != 0)
            gap = (marks & _GAP) != 0
            begins = ~gap
            begins[1:] &= gap[:-1]
            begins[starts] = ~gap[starts]
            counts["words"][some] = total(begins)
            for i in some:
                words = set(data[at[i]:at[i + 1]].tobytes().translate(_TO_BLANK).split(b" "))
                counts["distinct"][i] = len(words) - (b"" in words)
        first = last
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    chars, words = counts["chars"], counts["words"]
    whole = {"t_chars": chars, "t_words": words, "t_lines": counts["line"] + 1}
    out = {k: pa.array(v, pa.float64(), mask=missing) for k, v in whole.items()}
    parts = {"t_distinct": share(counts["distinct"], words), "t_digit": share(counts["digit"], chars),
             "t_upper": share(counts["upper"], chars), "t_punct": share(counts["punct"], chars),
             "t_wordlen": share(chars - counts["gap"], words)}
    return out | {k: pa.array(v, pa.float64()) for k, v in parts.items()}


def measure_texts(batches):
    """Arrow batches of an id and a text as batches of the id and the descriptors."""
    for batch in batches:
        found = _measured(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[found[c] for c in DESCRIPTORS]],
                                         [batch.schema.field(0).name, *DESCRIPTORS])
