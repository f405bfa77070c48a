"""Near-duplicate documents by BagMinHash over multisets of word shingles.

Every shingle is the seed of Poisson processes over its weight axis.  The axis
is discretised and split hierarchically: [0, 1), [1, 2), [2, 4), ... each have
a process of points (time, component, position); a document of multiplicity w
sees the points at positions below w, so the same points appear in every
document that holds the shingle often enough.  A component's signature is the
first point it sees; two documents agree in it with a probability equal to
their weighted Jaccard similarity.  Points are drawn up to a time by which all
components have very likely seen one (else further), so that a document takes
about  SIZE * log(SIZE)  points beyond one for each shingle.

Documents that agree in a band of ``ROWS`` components are candidates; the
multiset overlap of candidates is verified on whole texts.  Exact copies are
one class.  In each band bucket members are first verified against the smallest
one; buckets that then still hold several components get all pairs between
components verified, dealt out in pairs of blocks.

Words are runs without ASCII white space, shingles ``WIDTH`` of them (a text of
fewer words is one shingle, one without words links with exact copies alone).

A document is known by (doc_id, text): different texts of one doc_id are
documents of their own, of which none is dropped on account of the other.  A
group has the smallest doc_id in it for a name; of its documents the one with
the smallest (doc_id, digest) is kept, so groups that share a doc_id can share
a name and still keep a document each.

Cases: null texts are empty texts and copies of each other; a null doc_id links
with nothing and stays; rows of equal doc_id and text are one document, all
marked alike by ``groups``; ``keep`` lets the one stay whose columns come first
as JSON.  A very long text is a slice of its own, its shingles 8 bytes a word.
Other columns are ignored by ``groups`` and carried along by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrules.llm.blocks import deal, runs, sides
from sparkrules.llm.common import WordHashes, delete, free_names, join_counted, lean, map_texts, mix, split_words, store, texts, window_hashes
from sparkrules.llm.components import Sets, components

WIDTH = 5
LEAST = 0.8
BANDS, ROWS = 24, 5
SIZE = BANDS * ROWS
BLOCK = 128


def shingles(values: list[str], hashes: WordHashes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, sorted within each text, and the number of each text."""
    words, counts = split_words(values)
    h = hashes(words)
    ends = np.cumsum(counts)
    n = np.maximum(counts - width + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(values)), n)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + (ends - counts)[owner]
    all_ = window_hashes(h, width)
    out = np.empty(len(owner), np.uint64)
    whole = counts[owner] >= width
    out[whole] = all_[first[whole]]
    for k in np.flatnonzero((counts > 0) & (counts < width)).tolist():
        out[np.searchsorted(owner, k)] = window_hashes(h[ends[k] - counts[k] : ends[k]], int(counts[k]))[0]
    order = np.lexsort((out, owner))
    return out[order], n


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(sorted_shingles: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """By text, ``size`` 64-bit point names (0 for a text without shingles)."""
    texts_ = len(counts)
    out = np.zeros((texts_, size), np.uint64)
    if not len(sorted_shingles):
        return out
    owner = np.repeat(np.arange(texts_), counts)
    new = np.concatenate([[True], (sorted_shingles[1:] != sorted_shingles[:-1]) | (owner[1:] != owner[:-1])])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(owner)))
    seed, doc = sorted_shingles[at], owner[at]
    # the parts of the weight axis that each shingle reaches: [0, 1), [1, 2), [2, 4), ...
    parts = [(seed, doc, np.zeros(len(seed)), np.ones(len(seed)), weight, np.zeros(len(seed), np.uint64))]
    low, level = 1, 1
    while (more := np.flatnonzero(weight > low)).size:
        parts.append((seed[more], doc[more], np.full(len(more), float(low)), np.full(len(more), float(low)), weight[more], np.full(len(more), level, np.uint64)))
        low, level = low * 2, level + 1
    seed, doc, low_, length, weight, level_ = (np.concatenate(x) for x in zip(*parts))
    with np.errstate(over="ignore"):
        seed = mix(seed + level_ * np.uint64(0xA24BAED4963EE407))
    best, limit = np.full(texts_ * size, np.inf), (np.log(size) + 3) / np.maximum(counts, 1)
    flat = out.reshape(-1)
    todo = np.ones(len(seed), bool)
    while todo.any():
        live = np.flatnonzero(todo)
        time, k = np.zeros(len(live)), 0
        while len(live):
            k += 1
            with np.errstate(over="ignore"):
                name = mix(seed[live] + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1)))
                other = mix(name ^ np.uint64(0x5851F42D4C957F2D))
            time = time - np.log(_uniform(name)) / (size * length[live])
            near = time <= limit[doc[live]]
            live, time, name, other = live[near], time[near], name[near], other[near]
            seen = low_[live] + length[live] * _uniform(mix(other)) < weight[live]
            slot = doc[live[seen]] * size + (other[seen] % np.uint64(size)).astype(np.int64)
            t = time[seen]
            np.minimum.at(best, slot, t)
            won = best[slot] == t
            flat[slot[won]] = name[seen][won]
        short = np.flatnonzero(np.isinf(best.reshape(texts_, size)).any(axis=1) & (counts > 0))
        limit[short] *= 2
        todo = np.isin(doc, short)
    return out


def band_hashes(found: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = found.shape[1] // bands
    h = np.zeros((len(found), bands), np.uint64)
    cut = found.reshape(len(found), bands, rows)
    with np.errstate(over="ignore"):
        for r in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, r] + np.uint64(r + 1))
        h = mix(h + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted multisets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    # an element of multiplicities x and y appears x + y times; its k-th copy in either gets the name (element, k)
    if (a[1:] != a[:-1]).all() and (b[1:] != b[:-1]).all():
        return int((both[1:] == both[:-1]).sum())
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(ub, ua), len(ub) - 1)
    return int(np.minimum(ca, cb[at])[ub[at] == ua].sum())


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    n, m = len(a), len(b)
    if min(n, m) < least * max(n, m) or not min(n, m):
        return False
    c = overlap(a, b)
    return c >= least * (n + m - c)


def _sign(hashes: WordHashes):
    def run(batch: pa.RecordBatch) -> dict:
        found, counts = shingles(texts(batch), hashes)
        bands = band_hashes(signatures(found, counts))
        return {"doc_id": batch.column("doc_id"), "digest": batch.column("digest"), "bands": [b if n else None for b, n in zip(bands, counts)]}

    return run


def _shingled(hashes: WordHashes):
    def run(batch: pa.RecordBatch) -> dict:
        found, counts = shingles(texts(batch), hashes)
        cuts = np.split(found, np.cumsum(counts)[:-1])
        return {"node": batch.column("node"), "bag": [x.tobytes() for x in cuts]}

    return run


def _bag(data) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _check_pairs(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [alike(_bag(x), _bag(y), least) for x, y in zip(batch.column("bag_a").to_pylist(), batch.column("bag_b").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _check_blocks(least: float):
    """All pairs of a run that lie in different components and meet here first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ("bucket", "c1", "c2")):
            left, right = sides(t)
            ids, roots = t.column("doc").to_pylist(), t.column("root").to_pylist()
            bags = [_bag(x) for x in t.column("bag").to_pylist()]
            bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            bucket, sets, found = t.column("bucket")[0].as_py(), Sets(), []
            for i in left.tolist():
                for j in right.tolist():
                    if (left is right and i >= j) or roots[i] == roots[j] or sets.find(roots[i]) == sets.find(roots[j]):
                        continue
                    shared = bands[i] == bands[j]
                    if bands[i][shared.argmax()] == bucket and alike(bags[i], bags[j], least):
                        sets.join(roots[i], roots[j])
                        found.append((ids[i], ids[j]))
            if found:
                both = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return run


def _digest(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _grouped(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """doc_id and digest of every row; and for each text the smallest doc_id, that of its group, and the group's first (doc_id, digest)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _digest().alias("digest"))
    signed = map_texts(rows, ["doc_id", "digest", "text"], _sign(WordHashes()), "doc_id long, digest binary, bands array<long>")
    signed = store(signed, "signatures")
    named = signed.where("doc_id is not null")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands"))
    # written once, so the numbers hold
    classes = store(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = classes.where("bands is not null").select("node", "bands")
    member = nodes.select("node", F.explode("bands").alias("bucket"))
    heads = member.groupBy(F.col("bucket").alias("k")).agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    crowded = store(join_counted(member, "bucket", heads).select("node", "bucket", "head"), "buckets")
    pairs = crowded.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    wanted = crowded.select(F.col("node").alias("w")).distinct().join(classes, F.col("w") == F.col("node")).select("node", F.col("class_id").alias("wd"), F.col("digest").alias("wg"))
    chosen = rows.join(wanted, (F.col("doc_id") == F.col("wd")) & (F.col("digest") == F.col("wg"))).select("node", "text")
    bags = store(map_texts(chosen, ["node", "text"], _shingled(WordHashes()), "node long, bag binary"), "bags")
    again = store(bags.groupBy("node").count().where("count > 1").select(F.col("node").alias("t")), "repeated-bags")
    if not again.isEmpty():  # rows that repeat doc_id and text have a bag each
        twice = bags.join(again, F.col("node") == F.col("t"), "left_semi").groupBy("node").agg(F.first("bag").alias("bag"))
        bags = store(bags.join(again, F.col("node") == F.col("t"), "left_anti").unionByName(twice), "bags")
    bag = lambda n: bags.select(F.col("node").alias(f"k{n}"), F.col("bag").alias(f"bag_{n}"))
    both = pairs.join(bag("a"), F.col("a") == F.col("ka")).join(bag("b"), F.col("b") == F.col("kb")).select("a", "b", "bag_a", "bag_b")
    links = store(both.mapInArrow(lean(_check_pairs(least)), "a long, b long"), "links")
    roots = components(links).withColumnRenamed("node", "rn")
    rooted = crowded.join(roots, F.col("node") == F.col("rn"), "left").select("node", "bucket", F.coalesce("root", "node").alias("root"))
    open_ = rooted.groupBy(F.col("bucket").alias("k")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("k", "n")
    rest = join_counted(rooted, "bucket", open_).select("node", "bucket", "root")
    rest = rest.join(nodes.select(F.col("node").alias("nd"), "bands"), F.col("node") == F.col("nd")).join(bags.select(F.col("node").alias("nb"), "bag"), F.col("node") == F.col("nb"))
    rest = deal(rest.select("bucket", F.col("node").alias("doc"), "root", "bands", "bag"), "bucket", "doc", BLOCK)
    more = store(rest.mapInArrow(lean(_check_blocks(least)), "a long, b long"), "more-links")
    joined = roots if more.isEmpty() else components(links.unionByName(more)).withColumnRenamed("node", "rn")
    delete(bags, crowded)
    rooted = classes.join(joined, F.col("node") == F.col("rn"), "left").select("digest", "class_id", F.coalesce("root", "node").alias("root"))
    first = rooted.groupBy(F.col("root").alias("k")).agg(F.min(F.struct("class_id", "digest")).alias("first"), F.count("*").alias("n"))
    return signed.select("doc_id", "digest"), join_counted(rooted, "root", first).select(F.col("digest").alias("d"), "class_id", "first")


def groups(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, class_id (smallest exact copy), group_id, kept."""
    rows, labelled = _grouped(docs, least)
    known = F.col("doc_id").isNotNull()
    return rows.join(labelled, F.when(known, F.col("digest")) == F.col("d"), "left").select(
        "doc_id", "class_id", F.col("first.class_id").alias("group_id"),
        F.coalesce((F.col("doc_id") == F.col("first.class_id")) & (F.col("digest") == F.col("first.digest")), ~known).alias("kept"),
    )


def keep(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One document of each group, with all its columns."""
    rows, labelled = _grouped(docs, least)
    i, g, n, row = free_names(docs.columns, "_doc", "_digest", "_rows", "_row")
    # what does not simply stay: documents that are not the first of their group (no rows), and those of several rows
    each = rows.where("doc_id is not null").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).join(labelled, F.col("digest") == F.col("d"))
    is_first = (F.col("doc_id") == F.col("first.class_id")) & (F.col("digest") == F.col("first.digest"))
    marks = each.select(F.col("doc_id").alias(i), F.col("digest").alias(g), F.when(is_first, F.col("n")).otherwise(0).alias(n)).where(F.col(n) != 1)
    both = docs.join(marks, (F.col("doc_id").cast("long") == F.col(i)) & (_digest() == F.col(g)), "left")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    several = both.where(F.col(n) > 1).groupBy(i, g).agg(F.min_by(whole, F.to_json(whole)).alias(row)).select(f"{row}.*")
    return both.where(F.col(n).isNull()).select(*docs.columns).unionByName(several)
