"""Quality rules by compression bands: zstandard ratios over whole documents and fixed chunks, with limits by length.

The ratio is UTF-8 bytes over compressed bytes. Text that repeats itself compresses too well, noise hardly at all; as the
ratio of ordinary prose rises with its length, each length class has its own band. A document is rejected if its own
ratio leaves its band, or if more than `share` of its chunks leave the band of chunks: those find a stretch of repetition
or noise that the rest of a long document hides. A last chunk of less than half the size joins the one before.

Base rules come first: fewer than 20 words, or more than 30 % of the words in 8-word windows found twice or more.

Defined cases: a null or empty text has no words and fails the base rules, with a null ratio; texts of any length are
compressed whole; each row is judged alone, so repeated rows get the same verdict; a ratio or share equal to its limit is
within it; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches

_SEPARATORS_AND_TAILS = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Bands of ratios. starts: from how many bytes on each band holds; chunk: bytes of a chunk and its band.

    Each band leaves room on both sides of the ratios of prose that passes the base rules (quantiles 0.001 and 0.999 over
    9,066 documents in four languages: 1.10-3.33 from 64 bytes on, of which what is above 2 is words said over and over,
    1.36-2.07 up to there from 256, 1.76-2.48 from 1024, 2.12-2.74 from 4096, 2.33-2.90 from 16384, 1.80-2.41 by chunks).
    Base64 has 1.3, lists and templates 4 and more; hexadecimal digits (1.9) and random letters (1.7) are like prose.
    """

    starts: tuple = (0, 64, 256, 1024, 4096, 16384)
    bands: tuple = ((0.3, 2.0), (0.95, 2.1), (1.2, 2.4), (1.45, 2.8), (1.5, 3.1), (1.5, 3.5))
    chunk: int = 2048
    chunk_band: tuple = (1.45, 2.7)
    share: float = 0.2
    level: int = 3
    least_words: int = 20
    repeat_percent: int = 30
    window: int = 8


def repeated_words(words: list[bytes], window: int) -> int:
    """Words that lie in a window found twice or more, the first included. Hashes only show that no window repeats."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    spans = list(zip(*(words[i : i + n] for i in range(window))))
    times = Counter(spans)
    found = np.fromiter((times[s] > 1 for s in spans), np.int64, n)
    ends = np.concatenate([found, np.zeros(window, np.int64)])
    ends[window:] -= found
    return int((np.cumsum(ends) > 0).sum())


def base(text: bytes, window: int = 8) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    seen, dups = set(), 0
    if text.count(b"\n"):
        for line in text.split(b"\n"):
            if line in seen:
                dups += 1
            elif line and not line.isspace():
                seen.add(line)
    chars = len(text.translate(None, _SEPARATORS_AND_TAILS))
    return len(words), chars, len(text) - len(text.translate(None, _SYMBOLS)), dups, repeated_words(words, window)


def ratios(text: bytes, limits: Limits, press) -> tuple[float | None, list[float]]:
    """Of the whole text and of each chunk."""
    if not text:
        return None, []
    size, n = limits.chunk, len(text)
    count = max(1, (n + size // 2) // size)
    whole = n / len(press(text))
    if count == 1:
        return whole, []
    cuts = [*range(0, count * size, size)]
    return whole, [len(c) / len(press(c)) for c in (text[a:b] for a, b in zip(cuts, [*cuts[1:], n]))]


def verdict(n_words: int, n_repeat: int, n_bytes: int, whole: float | None, chunks: list[float], limits: Limits) -> tuple[bool, str | None, int]:
    """base_failed, the first reason to reject or None, chunks out of their band."""
    low, high = limits.chunk_band
    odd = sum(not low <= r <= high for r in chunks)
    if n_words < limits.least_words:
        return True, "few words", odd
    if 100 * n_repeat > limits.repeat_percent * n_words:
        return True, "repeated windows", odd
    low, high = limits.bands[bisect_right(limits.starts, n_bytes) - 1]
    if whole > high:
        return False, "repetitive", odd
    if whole < low:
        return False, "incompressible", odd
    if odd > limits.share * len(chunks):
        return False, "chunks", odd
    return False, None, odd


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, reason string, ratio double, n_chunks long, n_chunks_out long"
)


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row for each document: base measures, ratio, chunks, reason and kept."""

    def run(given):
        import zstandard

        press = zstandard.ZstdCompressor(level=limits.level, write_content_size=False).compress
        for batch in batches.slices(given, "text"):
            rows = []
            for text in batches.raw(batch.column("text")):
                text = text or b""
                measured = base(text, limits.window)
                whole, chunks = ratios(text, limits, press)
                failed, reason, odd = verdict(measured[0], measured[4], len(text), whole, chunks, limits)
                rows.append((*measured, failed, reason is None, reason, whole, len(chunks), odd))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string(), pa.float64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
