"""Quality rules by compression bands.

A text is compressed with zstandard as a whole and in fixed chunks.  Natural
prose compresses within a band that widens and rises with its length; a ratio
above the band means repetition, one below it means noise.  A document is
rejected if the whole ratio lies outside the band of its length, or if chunks
outside the chunk band hold more than a set share of its bytes.  Noise of small
alphabets (lower case letters, hexadecimal digits) compresses about as well as
prose and is not told from it.

Cases: a null text is an empty one, has no words and fails the base rule; the
row stays in the result.  Repeated rows and ids are judged row by row.  A very
long text is compressed whole, by itself.  Ratios at a limit pass.  Other
columns are ignored by ``measure`` and carried along by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkrules.llm.common import WordHashes, keep_texts, map_texts, split_words, texts, window_hashes

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: words of a worker's table and bytes of texts in one slice, so that its memory does not grow with the rows of a task
MOST_WORDS, MOST_BYTES = 50_000, 1 << 20


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio of plain to compressed bytes."""

    #: (texts of up to so many bytes, least ratio, largest ratio); the least ratio of a step lies above words of random letters
    #: and digits of its greatest length and below prose of its smallest; up to 96 bytes the two do not differ
    whole: tuple = (
        (96, 0.5, 3.0), (112, 0.975, 3.0), (128, 1.02, 3.0), (160, 1.07, 3.0), (192, 1.095, 3.0), (224, 1.14, 3.0), (256, 1.17, 3.0),
        (320, 1.2, 3.5), (384, 1.23, 3.5), (512, 1.29, 3.5), (768, 1.34, 3.5), (1024, 1.4, 3.5), (2048, 1.5, 4.0), (4096, 1.6, 4.0),
        (16384, 1.6, 4.5), (65536, 1.6, 5.0), (float("inf"), 1.6, 6.0),
    )
    chunk_bytes: int = 4096
    chunk: tuple = (1.6, 4.0)
    #: a last chunk shorter than this belongs to the one before
    least_chunk: int = 2048
    #: share of bytes in chunks outside their band that a text may have
    bad_share: float = 0.3
    level: int = 3
    #: words of a repeated window, and the base rule's limits
    window: int = 8
    least_words: int = 20
    repeat_percent: int = 30


def repeated_words(words: list[bytes], counts: np.ndarray, hashes: WordHashes, width: int) -> np.ndarray:
    """By text, the words inside windows that occur twice or more in that text, the first included."""
    found = np.zeros(len(counts), np.int64)
    h = hashes(words)
    keys = window_hashes(h, width)
    if not len(keys):
        return found
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(len(keys))
    inside = starts + width <= ends[owner[: len(keys)]]
    starts = starts[inside]
    with np.errstate(over="ignore"):
        keys = keys[inside] ^ (owner[starts].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return found
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    starts = starts[twice[at] == keys]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    np.add.at(found, owner[covered], 1)
    return found


def judge(data: bytes, packer, bands: Bands) -> tuple[float, float, bool]:
    """Ratio of the whole, share of bytes in bad chunks, verdict."""
    n = len(data)
    if not n:
        return 1.0, 0.0, True
    ratio = n / len(packer.compress(data))
    low, high = next((a, b) for most, a, b in bands.whole if n <= most)
    bad = 0
    if n > bands.chunk_bytes:
        start = 0
        while start < n:
            stop = start + bands.chunk_bytes
            stop = n if n - stop < bands.least_chunk else stop
            part = data[start:stop]
            if not bands.chunk[0] <= len(part) / len(packer.compress(part)) <= bands.chunk[1]:
                bad += len(part)
            start = stop
    return ratio, bad / n, low <= ratio <= high and bad <= bands.bad_share * n


class _Rules:
    """Works on a slice of texts; its word table and compressor last as long as the task."""

    def __init__(self, bands: Bands):
        self.bands, self.hashes, self.packer = bands, WordHashes(MOST_WORDS), None

    def __getstate__(self):
        return {"bands": self.bands, "hashes": WordHashes(MOST_WORDS), "packer": None}

    def __call__(self, batch: pa.RecordBatch) -> dict:
        import zstandard

        self.packer = self.packer or zstandard.ZstdCompressor(level=self.bands.level)
        values = texts(batch)
        words, counts = split_words(values)
        repeats = repeated_words(words, counts, self.hashes, self.bands.window)
        out = {k: [] for k in ("word_chars", "n_symbols", "n_dup_lines", "ratio", "bad_share", "in_band")}
        for t in values:
            out["word_chars"].append(len(t) - sum(map(t.count, SPACES)))
            out["n_symbols"].append(sum(map(t.count, SYMBOLS)))
            data = t.encode()
            lines = [x for x in data.split(b"\n") if x.strip()]
            out["n_dup_lines"].append(len(lines) - len(set(lines)))
            for k, v in zip(("ratio", "bad_share", "in_band"), judge(data, self.packer, self.bands)):
                out[k].append(v)
        failed = (counts < self.bands.least_words) | (100 * repeats > self.bands.repeat_percent * counts)
        return out | {"n_words": counts, "n_repeat_words": repeats, "base_failed": failed, "kept": ~failed & np.array(out["in_band"], bool)}


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_share double"


def measure(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per document: base figures, compression figures and the verdict."""
    rules = _Rules(bands)
    return map_texts(docs, ["doc_id", "text"], lambda b: rules(b) | {"doc_id": b.column("doc_id")}, SCHEMA, most=MOST_BYTES)


def keep(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The documents, with all their columns, that pass."""
    rules = _Rules(bands)
    return keep_texts(docs, lambda b: rules(b)["kept"], MOST_BYTES)
