"""Language-model scores from Elias-Fano n-gram tries.

The model is a bigram model with a Dirichlet prior around discounted unigrams,

    p1(w) = (c(w) - D) / N, unknown words together D * V / N,
    p(w | u) = (c(u, w) + M * p1(w)) / (c(u) + M),

over lower-cased words and the end of a text; D is estimated from the words
seen once and twice.  It is learned from the texts outside the held-out fold.

It grows with the corpus, so it is never brought to one place: a token (with
its predecessor) goes to the shard of its word, which counts, builds a trie of
memory-mapped levels (words; below each its predecessors; quantised scores) and
answers the look-ups of that shard.  The numerator needs the word and the pair
alone, and the denominator belongs to the preceding word's own token, so every
token is looked up in one shard.  Its document and quantised score come back, 4
bytes, and each word's count once for a slice of documents, so that what is
shuffled grows with the tokens and not with the number of shards.  A shard has
about ``SHARD_TOKENS`` tokens, their number grows with the corpus.  Words with
more than a set share of all tokens are spread over the shards by predecessor,
with their counts sent along; there are at most ``MOST_OFTEN`` of them, so that
beyond 65 billion tokens the largest shard is a 65,536th of the corpus.

Words are known by 64-bit hashes, predecessors by 32 bits of one.  Cases: a
null text is empty and has the end alone; null doc_ids are learned from (their
fold is unknown) and scored; repeated rows count and are scored one by one; a
very long text is a slice of its own, split over the shards like others;
without training tokens all scores are 0.  Other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrules.llm.blocks import runs
from sparkrules.llm.common import WordHashes, crc_of_id, lean, map_texts, mix, slices, split_words, store, texts
from sparkrules.llm.elias_fano import Trie, quantise

FOLDS, HELD = 7, 2
PRIOR = 200.0
SHARD_TOKENS = 1_000_000
#: words spread by predecessor (their counts, 1 MB at most, go to every task), and tasks over which the shards are dealt
MOST_OFTEN, MOST_PARTITIONS = 65_536, 50_000
TOGETHER = 1_000_000
END, BEGIN = np.uint64(0x656E64656E64656E), np.uint64(0x626567696E626567)
_LOG = np.log10


def tokens(values: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and the number of each text."""
    words, counts = split_words(values, lower=True)
    h = hashes(words)
    ends = np.cumsum(counts + 1) - 1
    out = np.empty(len(h) + len(counts), np.uint64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = h, END
    return out, counts + 1


def _counts(hashes: WordHashes):
    def run(batch: pa.RecordBatch) -> dict:
        values = [t for t, held in zip(texts(batch), batch.column("held").to_pylist()) if not held]
        w, n = np.unique(tokens(values, hashes)[0], return_counts=True)
        return {"w": w.view(np.int64), "n": n}

    return run


EVENTS = "slice long, shard int, info boolean, a binary, b binary, c binary, d binary"


def _events(shards: int, heavy: np.ndarray):
    """Tokens of a slice of documents by shard: words and their numbers, predecessors, documents; and the documents."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(EVENTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, name = WordHashes(0), TaskContext.get().partitionId() << 32
        for part in slices(batches):
            w, n = tokens(texts(part), hashes)
            doc = np.repeat(np.arange(len(n), dtype=np.uint16), n)
            u = np.concatenate([[BEGIN], w[:-1]])
            u[np.cumsum(n) - n] = BEGIN
            u = (mix(u) >> np.uint64(32)).astype(np.uint32)
            key = mix(w)
            if len(heavy):
                spread = heavy[np.minimum(np.searchsorted(heavy, w), len(heavy) - 1)] == w
                key[spread] = mix(key[spread] ^ u[spread].astype(np.uint64))
            shard = ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
            order = np.lexsort((w, shard))
            w, u, doc, shard = w[order], u[order], doc[order], shard[order]
            at = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
            rows = {f.name: [] for f in schema}
            ids = part.column("doc_id")
            info = (ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), n.tobytes(), np.array(part.column("held").to_pylist(), bool).tobytes())
            held = np.array(part.column("held").to_pylist(), bool)
            for k, s in enumerate(shard[at[:-1]].tolist()):
                x = slice(at[k], at[k + 1])
                new = np.flatnonzero(np.concatenate([[True], w[x][1:] != w[x][:-1]]))
                sizes = np.diff(np.append(new, len(w[x]))).astype(np.uint32)
                d = doc[x].astype(np.uint16) | (held[doc[x]].astype(np.uint16) << np.uint16(15))
                for column, v in zip(schema.names, (name, s, False, w[x][new].tobytes(), sizes.tobytes(), u[x].tobytes(), d.tobytes())):
                    rows[column].append(v)
            for k, v in zip(schema.names, (name, name % shards, True, *info)):
                rows[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
            name += 1

    return run


def score_shard(w: np.ndarray, u: np.ndarray, train: np.ndarray, heavy: dict[int, int], total: float, discount: float, prior: float):
    """Of every token of a shard: count of its word, log10 of the numerator (of an unknown word NaN) and of its own denominator."""
    order = np.lexsort((u, w))
    ws, us = w[order], u[order]
    new = np.concatenate([[True], (ws[1:] != ws[:-1]) | (us[1:] != us[:-1])])
    pair = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    pw, pu = ws[at], us[at]
    seen = np.bincount(pair, train[order], len(at))
    # what was seen in training becomes the trie
    kept = seen > 0
    kw, ku, kn = pw[kept], pu[kept], seen[kept]
    first = np.flatnonzero(np.concatenate([[True], kw[1:] != kw[:-1]])) if len(kw) else np.zeros(0, np.int64)
    words, sizes = kw[first], np.diff(np.append(first, len(kw)))
    counts = np.add.reduceat(kn, first) if len(kw) else np.zeros(0)
    if heavy and len(words):
        known = np.fromiter((heavy.get(x, -1) for x in words.tolist()), float, len(words))
        counts = np.where(known >= 0, known, counts)
    base = prior * (counts - discount) / max(total, 1.0)
    parts = Trie.parts(words, counts, sizes, ku, _LOG(kn + np.repeat(base, sizes)))
    handle, path = tempfile.mkstemp(suffix=".trie")
    try:
        with os.fdopen(handle, "wb") as f:
            where = Trie.write(parts, f)
        trie = Trie.mapped(path, where)
        uw = np.flatnonzero(np.concatenate([[True], pw[1:] != pw[:-1]]))
        rank = np.repeat(trie.find(pw[uw]), np.diff(np.append(uw, len(pw))))
        c = np.where(rank >= 0, trie.counts[np.maximum(rank, 0)] if len(trie.counts) else 0, 0).astype(float)
        if heavy:  # a known word can lack training pairs in this shard
            lost = np.flatnonzero(rank < 0)
            c[lost] = [heavy.get(x, 0) for x in pw[lost].tolist()]
        numerator = trie.scores(rank, pu)
        unseen = np.isnan(numerator)
        with np.errstate(divide="ignore"):
            numerator[unseen] = np.where(c[unseen] > 0, _LOG(np.maximum(prior * (c[unseen] - discount) / max(total, 1.0), 1e-300)), np.nan)
        denominator = np.where(pw == END, 0.0, _LOG(c + prior))
    finally:
        os.unlink(path)
    back = np.empty(len(w), np.int64)
    back[order] = pair
    return c[back], numerator[back], denominator[back]


SUMS = "slice long, info boolean, a binary, b binary, c binary, d binary"


def _shards(heavy: dict[int, int], total: float, discount: float, prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ("shard",)):
            info = t.filter(t.column("info"))
            if info.num_rows:
                yield from info.drop_columns(["shard"]).to_batches()
            t = t.filter(pc.invert(t.column("info")))
            if not t.num_rows:
                continue
            col = lambda k, kind: [np.frombuffer(x, kind) for x in t.column(k).to_pylist()]  # noqa: E731,B023
            docs, sizes = col("d", np.uint16), col("b", np.uint32)
            ends = np.cumsum([len(x) for x in docs])
            w = np.repeat(np.concatenate(col("a", np.uint64)), np.concatenate(sizes))
            held = (np.concatenate(docs) >> np.uint16(15)) == 1
            c, num, den = score_shard(w, np.concatenate(col("c", np.uint32)), ~held, heavy, total, discount, prior)
            codes, scale = quantise(np.where(np.isnan(num), 0.0, num) - den)
            out = {k: [] for k in ("slice", "info", "a", "b", "c", "d")}
            for name, stop, doc, size in zip(t.column("slice").to_pylist(), ends.tolist(), docs, sizes):
                start = stop - len(doc)
                counts = c[start + np.cumsum(size, dtype=np.int64) - size]  # one for each word
                values = (doc & np.uint16(0x7FFF), codes[start:stop], size, np.append(scale, counts.astype(np.float64)))
                for k, v in zip(out, (name, False, *(y.tobytes() for y in values))):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["slice"], pa.int64()), pa.array(out["info"], pa.bool_()), *(pa.array(out[k], pa.binary()) for k in "abcd")], names=list(out)
            )

    return run


def _total(total: float, distinct: float, discount: float, prior: float, docs: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ("slice",)):
            info = t.filter(t.column("info")).to_pylist()[0]
            ids, valid = np.frombuffer(info["a"], np.int64), np.frombuffer(info["b"], bool)
            n, held = np.frombuffer(info["c"], np.int64), np.frombuffer(info["d"], bool)
            base, score, known = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), np.int64)
            rest = t.filter(pc.invert(t.column("info")))
            ends = np.cumsum([len(x) >> 1 for x in rest.column("a").to_pylist()], dtype=np.int64)
            start = 0
            while start < rest.num_rows:  # rows of a million tokens or so at once
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TOGETHER, side="right")))
                part = rest.slice(start, stop - start)
                col = lambda k, kind: [np.frombuffer(x, kind) for x in part.column(k).to_pylist()]  # noqa: E731,B023
                docs_, codes, tails = col("a", np.uint16), col("b", np.uint16), col("d", np.float64)
                at, size = np.concatenate(docs_), [len(x) for x in docs_]
                c = np.repeat(np.concatenate([x[2:] for x in tails]), np.concatenate(col("c", np.uint32)))
                low, step = (np.repeat([x[k] for x in tails], size) for k in (0, 1))
                base += np.bincount(at, _LOG(c + 1), len(n))
                score += np.bincount(at, low + np.concatenate(codes) * step, len(n))
                known += np.bincount(at, c > 0, len(n)).astype(np.int64)
                start = stop
            base -= n * _LOG(total + distinct + 1)
            if total:
                score += (n - known) * _LOG(prior * discount * distinct / total) - _LOG(docs + prior)
            else:
                score[:] = 0.0
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=~valid), pa.array(held), pa.array(n), pa.array(known), pa.array(np.full(len(n), int(total))), pa.array(base), pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, prior: float = PRIOR, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_of_id() % FOLDS == HELD, F.lit(False)).alias("held"), "text")
    counts = map_texts(rows, ["held", "text"], _counts(WordHashes(0)), "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counts = store(counts, "words")
    sums = counts.agg(
        F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum(F.when(F.col("n") == 1, 1)).alias("once"), F.sum(F.when(F.col("n") == 2, 1)).alias("twice"),
        F.max(F.when(F.col("w") == int(END.view(np.int64)), F.col("n"))).alias("docs"),
    ).first()
    total, distinct = sums["total"] or 0, sums["distinct"]
    once, twice = sums["once"] or 0, sums["twice"] or 0
    discount = min(0.9, max(0.1, once / (once + 2 * twice) if once else 0.5))
    shards = max(1, -(-total // shard_tokens))
    # at most MOST_OFTEN words can have so large a share
    often = counts.where(F.col("n") * min(8 * shards, MOST_OFTEN) >= total).collect() if total and shards > 1 else []
    heavy = {int(np.int64(r["w"]).view(np.uint64)): r["n"] for r in often}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = rows.mapInArrow(lean(_events(shards, np.array(sorted(heavy), np.uint64))), EVENTS)
    events = events.repartition(max(parts, min(shards, MOST_PARTITIONS)), "shard").sortWithinPartitions("shard")
    found = events.mapInArrow(_shards(heavy, total, discount, prior), SUMS)
    back = found.repartition(parts, "slice").sortWithinPartitions("slice")
    return back.mapInArrow(_total(total, distinct, discount, prior, sums["docs"] or 0), RESULT)
