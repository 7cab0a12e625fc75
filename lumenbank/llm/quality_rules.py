"""Quality rules: word and line counts, and bands of zstandard ratios over whole texts and fixed chunks."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lumenbank.llm.common import SLICE, WORD, map_rows

#: Words of a repeated window, bytes of a chunk, and the compression level.
WINDOW, CHUNK, LEVEL = 8, 4_096, 3

#: Least and most compressed size as a share of the text, from so many bytes on. Short texts compress little, long ones more.
BANDS = [(0, 0.0, 9.0), (256, 0.25, 1.0), (1_024, 0.22, 0.9), (4_096, 0.2, 0.85), (16_384, 0.18, 0.8)]
#: The same for each chunk of CHUNK bytes, and the share of chunks outside it that rejects a text. A shorter last chunk
#: is held against the limits of its own length.
CHUNK_BAND, CHUNK_SHARE = (0.2, 0.85), 0.5

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks long, chunks_outside long"

_WORD = re.compile(WORD)


def repeated_words(words: list[str]) -> int:
    """Words in windows of WINDOW words that the text has twice or more, the first of them included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    value = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + value[k : k + n]
    _, inverse, count = np.unique(mixed, return_inverse=True, return_counts=True)
    if len(count) == n:
        return 0  # unlike hashes: unlike windows
    again = np.flatnonzero(count[inverse] > 1)
    same = Counter(tuple(words[i : i + WINDOW]) for i in again)
    covered = np.zeros(len(words) + 1, np.int64)
    for i in again:
        if same[tuple(words[i : i + WINDOW])] > 1:
            covered[i] += 1
            covered[i + WINDOW] -= 1
    return int((np.cumsum(covered) > 0).sum())


def band(size: int) -> tuple[float, float]:
    """Least and most ratio of a text of so many bytes."""
    return max(b for b in BANDS if b[0] <= size)[1:]


def compression(raw: bytes, compressor) -> tuple[float, int, int]:
    """Ratio of the whole, number of chunks, and how many of them leave their band."""
    ratio = len(compressor.compress(raw)) / len(raw) if raw else 1.0
    outside = 0
    for at in range(0, len(raw), CHUNK):
        part = raw[at : at + CHUNK]
        least, most = CHUNK_BAND if len(part) == CHUNK else band(len(part))
        outside += not least <= len(compressor.compress(part)) / len(part) <= most
    return ratio, -(-len(raw) // CHUNK), outside


def measure(text: str | None, compressor) -> tuple:
    """The measures of one whole text, in the order of MEASURES; a null or empty text has no words and fails the base rules."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    repeats = repeated_words(words)
    failed = n < 20 or 100 * repeats > 30 * n
    raw = text.encode("utf-8", "surrogatepass")
    ratio, chunks, outside = compression(raw, compressor)
    least, most = band(len(raw))
    good = least <= ratio <= most and outside <= CHUNK_SHARE * chunks
    return n, sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeats, failed, not failed and good, ratio, chunks, outside


def measure_documents(docs: DataFrame) -> DataFrame:
    """doc_id and the MEASURES of every row of ``docs``; no shuffle, no text is cut, other columns are ignored.

    A null or empty text has no words and is not kept. Null and repeated ids
    stay as they are; an empty table gives no rows.
    """

    def make():
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        return lambda doc, text: [(doc, *measure(text, compressor))]

    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MEASURES}")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; the same rules, one pass and no join.

    Each row is judged by its own text: ids may be null or repeated, and equal
    rows stay or go together. An empty table gives no rows.
    """
    at = docs.columns.index("text")

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                yield part.filter(pa.array([measure(t.as_py(), compressor)[6] for t in part.column(at)]))

    return docs.mapInArrow(run, docs.schema)
