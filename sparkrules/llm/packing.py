"""Packing of tokenised documents into sequences by order-preserving dynamic programming.

The ids of consecutive documents form one stream per block.  The stream is cut
into sequences of at most ``LENGTH`` ids; cuts fall at ends of documents (free),
at ends of sentences (a small penalty) or, where sentences are long, between
words (a larger one).  With f(j) the least cost of the stream up to cut j,

    f(j) = penalty(j) + PER_SEQUENCE + min over i of f(i) + padding(p(j) - p(i)),

where a sequence of n ids is padded to LENGTH, unless n is a power of two.  As
the padding is linear in p(i), the minimum over the window of i comes from a
monotone queue; the few transitions over a power of two are tried beside it.

A block is what one task reads, closed after ``BLOCK_TOKENS`` ids at a document
end, so nothing is shuffled and memory is bounded.  Sequence ids are unique:
the task's partition number in the upper bits, a running number below.

Cases: a null or empty text has the closing id alone; a text longer than a
block makes a block of its own; null and repeated doc_ids are packed like
others, row by row; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkrules.llm.common import kept, lean, slices, texts

LENGTH = 1024
END_ID = 0
#: penalties in ids of padding; PER_SEQUENCE keeps short sequences rare
SENTENCE, WORD, ANYWHERE, PER_SEQUENCE = 1.0, 6.0, 24.0, 256.0
#: one cut between words is offered in so many ids
EVERY = 32
#: texts of a worker that are encoded both ways
COMPARED = 64
BLOCK_TOKENS = 2_000_000
#: fixed values: bytes that end a line or sentence wherever they stand, and those that end one before white space
LINE_ENDS = tuple(x.encode() for x in ("\n", "\u3002", "\uff01", "\uff1f"))
STOPS = (b".", b"!", b"?")
_END = np.array([END_ID], np.uint32)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


class TextTokenizer:
    """ids of whole texts, and what ids say about places to cut.

    A rank file of the same vocabulary, if given, encodes faster.  The strings
    of special tokens are ids of their own to the tokenizer alone, so texts that
    hold "<|" are left to it; the first texts of a worker are encoded both ways,
    and a difference is an error.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.coder, self.quick, self.compared = Tokenizer.from_file(path), None, 0
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("texts", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        pieces = [self._bytes(k) for k in range(self.coder.get_vocab_size())]
        table = lambda test: np.array([test(p) for p in pieces], bool)
        #: ids after which a line or sentence ends, those after which it does before white space, and those that begin with white space
        self.closes = table(lambda p: p.endswith(LINE_ENDS))
        self.stops = table(lambda p: p.endswith(STOPS))
        self.opens = table(lambda p: p[:1].isspace())

    def _bytes(self, k: int) -> bytes:
        return self.coder.decode([k], skip_special_tokens=False).encode()

    def _plain(self, values: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.coder.encode_batch_fast(values, add_special_tokens=False)]

    def __call__(self, values: list[str]) -> list[np.ndarray]:
        if not self.quick:
            return self._plain(values)
        out = [None if "<|" in t else self.quick.encode_to_numpy(t) for t in values]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(rest, self._plain([values[k] for k in rest])):
            out[k] = ids
        if self.compared < COMPARED:
            first = values[: COMPARED - self.compared]
            self.compared += len(first)
            if not all(map(np.array_equal, out, self._plain(first))):
                raise ValueError("the rank file does not give the tokenizer's ids")
        return out

    def breaks(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places between ids where a sentence ends, and where a word begins."""
        before, after = ids[:-1], ids[1:]
        opens = self.opens[after]
        return np.flatnonzero(self.closes[before] | (self.stops[before] & opens)) + 1, np.flatnonzero(opens) + 1


def candidates(sentences: np.ndarray, words: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts and their penalties from the breaks (increasing) in all documents of a block."""
    total = int(doc_ends[-1])
    kinds = [(doc_ends, 0.0), (sentences, SENTENCE)]
    if len(words):
        cell = words // EVERY
        kinds.append((words[np.append(cell[1:] != cell[:-1], True)], WORD))
    kinds.append((np.arange(LENGTH // 2, total, LENGTH // 2), ANYWHERE))  # words can be long
    points = np.concatenate([k for k, _ in kinds])
    costs = np.concatenate([np.full(len(k), c) for k, c in kinds])
    order = np.lexsort((costs, points))
    points, costs = points[order], costs[order]
    first = np.append(points[:1] > 0, (points[1:] != points[:-1]))
    return points[first], costs[first]


def best_cuts(points: np.ndarray, costs: np.ndarray, length: int = LENGTH, per_sequence: float = PER_SEQUENCE) -> np.ndarray:
    """The chosen ends of sequences among ``points`` (increasing, gaps of at most ``length``, the last one required)."""
    at = np.concatenate([[0], points])
    into, source = [], []
    power = 1
    while power < length:
        i = np.searchsorted(at, at - power)
        hit = np.flatnonzero((at >= power) & (at[np.minimum(i, len(at) - 1)] == at - power))
        into.append(hit)
        source.append(i[hit])
        power *= 2
    into, source = np.concatenate(into), np.concatenate(source)
    order = np.argsort(into, kind="stable")
    into, source = into[order].tolist() + [-1], source[order].tolist()
    pos, cost = at.tolist(), [0.0, *costs.tolist()]
    f, back = [0.0] * len(pos), [0] * len(pos)
    queue: deque = deque([(0.0, 0)])  # (f(i) + p(i), i), increasing in both
    k = 0
    for j in range(1, len(pos)):
        p = pos[j]
        while pos[queue[0][1]] < p - length:
            queue.popleft()
        best, i = queue[0]
        best += length - p
        while into[k] == j:
            if f[source[k]] < best:
                best, i = f[source[k]], source[k]
            k += 1
        best += cost[j] + per_sequence
        f[j], back[j] = best, i
        best += p
        while queue and queue[-1][0] >= best:
            queue.pop()
        queue.append((best, j))
    cuts, j = [], len(pos) - 1
    while j:
        cuts.append(pos[j])
        j = back[j]
    return np.array(cuts[::-1], np.int64)


class _Block:
    """Documents gathered for one run of the dynamic programme."""

    def __init__(self, coder: TextTokenizer):
        self.coder, self.docs, self.ids, self.ends, self.tokens = coder, [], [], [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.ids += [ids, _END]
        self.tokens += len(ids) + 1
        self.ends.append(self.tokens)

    def rows(self, first: int) -> tuple[dict, int]:
        ends, all_ = np.array(self.ends, np.int64), np.concatenate(self.ids).astype("<u4", copy=False)
        data = memoryview(all_).cast("B")
        cuts = best_cuts(*candidates(*self.coder.breaks(all_), ends))
        bounds = np.union1d(np.concatenate([[0], cuts]), ends)
        a, b = bounds[:-1], bounds[1:]
        doc, seq = np.searchsorted(ends, a, side="right"), np.searchsorted(cuts, a, side="right")
        begins, starts = np.concatenate([[0], ends[:-1]]), np.concatenate([[0], cuts[:-1]])
        crcs = [zlib.crc32(data[x:y]) for x, y in zip((a * 4).tolist(), (b * 4).tolist())]
        ids = self.docs
        return {
            "doc_id": [ids[k] for k in doc.tolist()], "start": a - begins[doc], "length": b - a, "ids_crc32": crcs, "doc_tokens": (ends - begins)[doc],
            "sequence_id": first + seq, "offset": a - starts[seq], "sequence_length": (cuts - starts)[seq],
        }, len(cuts)


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece of a document in a sequence."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))
    key = (tokenizer, ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = kept(key, lambda: TextTokenizer(*key))
        first, block = TaskContext.get().partitionId() << 40, _Block(coder)

        def closed():
            nonlocal first, block
            rows, used = block.rows(first)
            first, block = first + used, _Block(coder)
            return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in schema], schema=schema)

        for part in slices(batches):
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), coder(texts(part))):
                block.add(doc_id, ids)
                if block.tokens >= block_tokens:
                    yield closed()
        if block.tokens:
            yield closed()

    return docs.select("doc_id", "text").mapInArrow(lean(run, keeps=True), SCHEMA)
