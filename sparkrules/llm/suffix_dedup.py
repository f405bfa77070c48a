"""Repeated passages by a sparse suffix array.

A passage is a run of ``PASSAGE`` words.  The smallest hash of the ``SEED``-word
windows inside it, leftmost of equals, selects a position that depends on its
content alone; only suffixes that start at such minimisers are retained.  Those
whose seed occurs once in the corpus match nothing.  The others carry the words
up to a passage's length to either side; they are sorted by seed and right
content, and the longest common prefix with both neighbours bounds how far any
match reaches to the right.  Inside that bound, matches are extended to the
left and equal passages named; the first place of a passage, by (doc_id, text
hash, position), keeps it, all later ones are repeats.  The result is exact:
every passage that occurs twice is found, and none else (up to hash collisions, below).

A seed of many occurrences is sorted in chunks; a chunk then passes on its
first place of each passage, and the smallest of these is taken by an
aggregation that combines before its shuffle.

Suffixes are compared by 31 bits of each word's hash and passages named by 64
bits of these, within one seed (64 bits of the full hashes): two passages that
differ in a single word are taken for one with a probability of 2^-31.

Words are runs without ASCII white space; spans are in words.  Cases: null and
short texts have no passages; a null doc_id has none either and stays as it is;
rows of equal doc_id and text are one document, with the same spans in each.
A very long text is a slice of its own, its minimisers chosen part by part.
``remove`` cuts repeats out and drops documents of which no word is left; of
the rows of one document of ``PASSAGE`` words or more it keeps the one whose
columns come first as JSON.  Other columns are carried along, n_chars is counted anew where there is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrules.llm.blocks import whole_runs
from sparkrules.llm.common import WordHashes, free_names, lean, map_texts, slices, split_words, store, texts, window_hashes

PASSAGE = 50
SEED = 8
CHUNK = 1024
#: suffixes that a worker holds as matrices at once
BLOCK = 6_000
#: windows whose minimisers are found at once
PART = 8_000_000
SIDE = PASSAGE - SEED
_LOW = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_BASE, k, 1 << 64) for k in range(2 * PASSAGE)], np.uint64)
_INVERSE = np.array([pow(pow(_BASE, -1, 1 << 64), k, 1 << 64) for k in range(2 * PASSAGE)], np.uint64)
SPAN = "struct<start:long,length:long>"


def minimisers(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in ``h``) of the selected suffixes, and their seeds."""
    seeds = window_hashes(h, SEED)
    if len(h) < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends, windows = np.cumsum(counts), len(h) - PASSAGE + 1
    inside = np.arange(windows) + PASSAGE <= np.repeat(ends, counts)[:windows]
    whole, parts = PASSAGE - SEED + 1, []
    for start in range(0, windows, PART):  # positions in a part fit into the low bits
        stop = min(start + PART, windows)
        near = seeds[start : stop + whole - 1]
        m = (near & ~_LOW) | np.arange(len(near), dtype=np.uint64)
        width = 1
        while width * 2 <= whole:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < whole:
            m = np.minimum(m[: len(m) - (whole - width)], m[whole - width :])
        parts.append((m[inside[start:stop]] & _LOW).astype(np.int64) + start)
    at = np.unique(np.concatenate(parts))
    return at, seeds[at]


def _seeds(hashes: WordHashes):
    def run(batch: pa.RecordBatch) -> dict:
        words, counts = split_words(texts(batch))
        at, seeds = minimisers(hashes(words), counts)
        row = np.searchsorted(np.cumsum(counts), at, side="right")
        take = pa.array(row)
        return {
            "seed": seeds.view(np.int64), "doc_id": batch.column("doc_id").take(take), "digest": batch.column("digest").take(take),
            "pos": at - (np.cumsum(counts) - counts)[row],
        }

    return run


def _suffixes(hashes: WordHashes):
    """Each hit with its surroundings: 4 bytes a word, zeros beyond the text; ``left`` nearest word first."""

    def run(batch: pa.RecordBatch) -> dict:
        words, counts = split_words(texts(batch))
        h = hashes(words)
        short = np.concatenate([np.zeros(SIDE, np.uint32), ((h >> np.uint64(32)) | np.uint64(1)).astype(np.uint32), np.zeros(PASSAGE, np.uint32)])
        hits, ends = batch.column("hits"), np.cumsum(counts)
        n = pc.list_value_length(hits).to_numpy()
        flat = hits.flatten()
        row = np.repeat(np.arange(len(counts)), n)
        pos = flat.field("pos").to_numpy()
        at = (ends - counts)[row] + pos
        left, right = [], []
        for k in range(0, len(at), BLOCK):
            part = slice(k, k + BLOCK)
            around = short[at[part, None] + np.arange(SIDE + PASSAGE)[None, :]]
            rel = pos[part, None] + np.arange(-SIDE, PASSAGE)[None, :]
            around[(rel < 0) | (rel >= counts[row[part]][:, None])] = 0
            left += [x.tobytes() for x in around[:, :SIDE]]
            right += [x.astype(">u4").tobytes() for x in around[:, SIDE:]]
        take = pa.array(row)
        return {
            "seed": flat.field("seed"), "salt": flat.field("n").to_numpy(), "doc_id": batch.column("doc_id").take(take), "digest": batch.column("digest").take(take),
            "pos": pos, "left": left, "right": right,
        }

    return run


def _matches(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Of suffixes sorted by right content: rows and offsets of matched passages, 0 (later), 1 (first) or 2 (alone) for each, and its name."""
    n = table.num_rows
    right = np.frombuffer(b"".join(table.column("right").to_pylist()), ">u4").reshape(n, PASSAGE).astype(np.uint64)
    left = np.frombuffer(b"".join(table.column("left").to_pylist()), np.uint32).reshape(n, SIDE).astype(np.uint64)
    seed, chunked = table.column("seed").to_numpy(), table.column("chunks").to_numpy() > 1
    same = (right[1:] == right[:-1]) & (right[1:] != 0) & (seed[1:] == seed[:-1])[:, None]
    lcp = np.where(same.all(axis=1), PASSAGE, same.argmin(axis=1)) if n > 1 else np.zeros(0, np.int64)
    reach = np.maximum(np.append(0, lcp), np.append(lcp, 0))
    has_left, has_right = (left != 0).sum(axis=1), (right != 0).sum(axis=1)
    offsets = np.arange(SIDE + 1)
    reach = np.where(chunked, PASSAGE, reach)  # a chunk's suffix may match one of another chunk
    fits = (offsets[None, :] <= has_left[:, None]) & (PASSAGE - offsets[None, :] <= np.minimum(has_right, reach)[:, None])
    rows, o = np.nonzero(fits)
    if not len(rows):
        return rows, o, np.zeros(0, bool), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        whole = np.concatenate([left, right], axis=1) * _POWERS[: SIDE + PASSAGE]
        sums = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(whole, axis=1, dtype=np.uint64)], axis=1)
        start = SIDE - o
        names = (sums[rows, start + PASSAGE] - sums[rows, start]) * _INVERSE[start]
    # equal passages have their seed at the same offset
    order = np.lexsort((table.column("pos").to_numpy()[rows] - o, table.column("digest").to_numpy()[rows], table.column("doc_id").to_numpy()[rows], seed[rows], o, names))
    a, b, c = names[order], o[order], seed[rows][order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
    alone = new & np.append(new[1:], True)
    first = np.zeros(len(rows), np.int8)
    first[order] = np.where(alone, 2, new)  # 0 later, 1 first of several, 2 alone
    return rows, o, first, names


def _merge(doc, digest, kind, start, end) -> list[np.ndarray]:
    """Join overlapping spans of a document and kind."""
    order = np.lexsort((start, kind, digest, doc))
    doc, digest, kind, start, end = (x[order] for x in (doc, digest, kind, start, end))
    group = np.concatenate([[True], (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1]) | (kind[1:] != kind[:-1])])
    # starts and ends rise together (all spans are equally long or merged), so a gap shows between neighbours
    new = group | np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(new)) - 1
    return [doc[at], digest[at], kind[at], start[at], np.maximum.reduceat(end, at) if len(at) else end[last]]


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes without those of a document's further rows, which follow their equals."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.column_stack([batch.column(k).to_numpy() for k in ("seed", "chunk", "doc_id", "digest", "pos")])
        new = np.append(last is None or (ids[0] != last).any(), (ids[1:] != ids[:-1]).any(axis=1))
        last = ids[-1]
        yield batch if new.all() else batch.filter(pa.array(new))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of matched passages; of chunked seeds also the chunk's first places (kind 2, with the passage's name)."""
    names = ["doc_id", "digest", "kind", "start", "end", "name", "seed"]
    held: list[list[np.ndarray]] = []

    def flush():
        cols = [np.concatenate(x) for x in zip(*held)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    for t in whole_runs(_once(batches), ("seed", "chunk"), BLOCK):
        rows, o, first, name = _matches(t)
        if not len(rows):
            continue
        doc, digest = t.column("doc_id").to_numpy()[rows], t.column("digest").to_numpy()[rows]
        start = t.column("pos").to_numpy()[rows] - o
        pick = first < 2
        if pick.any():
            cols = _merge(doc[pick], digest[pick], (first[pick] > 0).astype(np.int64), start[pick], start[pick] + PASSAGE)
            held.append([*cols, np.zeros(len(cols[0]), np.int64), np.zeros(len(cols[0]), np.int64)])
        head = (first > 0) & (t.column("chunks").to_numpy()[rows] > 1)
        if head.any():
            names_ = (name[head] + o[head].astype(np.uint64) * np.uint64(_BASE)).view(np.int64)
            held.append([doc[head], digest[head], np.full(len(names_), 2, np.int64), start[head], start[head] + PASSAGE, names_, t.column("seed").to_numpy()[rows][head]])
        if sum(len(x[0]) for x in held) > 50_000:
            yield flush()
    if held:
        yield flush()


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), shared and removed spans of the documents that have any."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    found = map_texts(rows, ["doc_id", "digest", "text"], _seeds(WordHashes()), "seed long, doc_id long, digest long, pos int")
    found = store(found, "suffixes")
    # places, not rows: a document in several rows is counted once
    place = F.xxhash64("doc_id", "digest", "pos")
    repeated = found.groupBy(F.col("seed").alias("s")).agg(F.count("*").alias("n"), F.min(place).alias("a"), F.max(place).alias("b"))
    repeated = repeated.where("a <> b").select("s", "n")
    repeated = store(repeated, "seeds")  # joined as a plain table, the rows of a frequent seed can be split
    hit = found.join(repeated, F.col("seed") == F.col("s")).select("doc_id", "digest", F.struct("pos", "seed", "n").alias("hit"))
    # the positions of one document
    hits = hit.groupBy("doc_id", "digest").agg(F.collect_set("hit").alias("hits"))
    hits = hits.select(F.col("doc_id").alias("hd"), F.col("digest").alias("hg"), "hits")
    near = rows.join(hits, (F.col("doc_id") == F.col("hd")) & (F.col("digest") == F.col("hg")))
    schema = "seed long, salt long, doc_id long, digest long, pos int, left binary, right binary"
    suffixes = map_texts(near, ["doc_id", "digest", "text", "hits"], _suffixes(WordHashes()), schema)
    chunks = F.ceil(F.col("salt") / CHUNK).cast("int")
    suffixes = suffixes.select("*", chunks.alias("chunks"), F.pmod(F.xxhash64("doc_id", "pos"), chunks).alias("chunk"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = suffixes.repartition(parts, "seed", "chunk").sortWithinPartitions("seed", "chunk", "right", "doc_id", "digest", "pos")
    matched = store(ordered.mapInArrow(lean(_search), "doc_id long, digest long, kind long, start long, end long, name long, seed long"), "matches")
    heads = matched.where("kind = 2")
    place = F.struct("doc_id", "digest", "start")
    best = heads.groupBy("name", "seed").agg(F.min(place).alias("best"), F.max(place).alias("most"))
    best = best.where("best <> most").select(F.col("name").alias("bn"), F.col("seed").alias("bs"), "best")
    joined = heads.join(best, (F.col("name") == F.col("bn")) & (F.col("seed") == F.col("bs"))).withColumn("kind", F.when(place == F.col("best"), 1).otherwise(0).cast("long"))
    # a chunk's later places are repeats of its first one, which is then shared as well
    inner = matched.where("kind <> 2").select("doc_id", "digest", "kind", "start", "end")
    all_ = inner.unionByName(joined.select("doc_id", "digest", "kind", "start", "end"))
    schema = f"doc_id long, digest long, shared array<{SPAN}>, removed array<{SPAN}>"
    grouped = all_.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "end", "kind")).alias("all"))
    return grouped.mapInArrow(lean(_united), schema)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    for batch in batches:
        both: dict[str, list] = {"shared": [], "removed": []}
        for got in batch.column("all").to_pylist():
            for key, rows in (("shared", got), ("removed", [x for x in got if x["kind"] == 0])):
                out: list[list[int]] = []
                for s, e in sorted((x["start"], x["end"]) for x in rows):
                    if out and s <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], e)
                    else:
                        out.append([s, e])
                both[key].append([{"start": s, "length": e - s} for s, e in out])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), *(pa.array(both[k], kind) for k in both)], names=["doc_id", "digest", "shared", "removed"]
        )


def repeats(docs: DataFrame) -> DataFrame:
    """One row per document: words in passages that occur twice, words in later places, and both as spans."""
    got = spans(docs).withColumnsRenamed({"doc_id": "sd", "digest": "sg"})
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"))
    total = lambda c: F.aggregate(F.coalesce(c, F.array().cast(f"array<{SPAN}>")), F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return ids.join(got, (F.col("doc_id") == F.col("sd")) & (F.col("digest") == F.col("sg")), "left").select(
        "doc_id", total(F.col("shared")).alias("n_shared_words"), total(F.col("removed")).alias("n_removed_words"), "shared", "removed"
    )


_WORD = re.compile(r"[^ \t-\r]+")


def cut(text: str, removed: list[dict]) -> str:
    """The text without the words of the spans and the white space after each."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for s in removed:
        out.append(text[at : starts[s["start"]]])
        at = starts[s["start"] + s["length"]]
    return "".join(out) + text[at:]


def remove(docs: DataFrame) -> DataFrame:
    """Documents without their repeats, with all their columns."""
    names = docs.columns
    i, g, c, n, row = free_names(names, "_doc", "_digest", "_cut", "_rows", "_row")
    got = spans(docs).where("size(removed) > 0").select(F.col("doc_id").alias("sd"), F.col("digest").alias("sg"), "removed")
    keys = [F.col("doc_id").cast("long").alias("td"), F.xxhash64("text").alias("tg")]
    twins = docs.where("doc_id is not null").select(*keys).groupBy("td", "tg").agg(F.count("*").alias("n")).where("n > 1")
    got = got.join(twins, (F.col("sd") == F.col("td")) & (F.col("sg") == F.col("tg")), "full")
    got = got.select(F.coalesce("sd", "td").alias(i), F.coalesce("sg", "tg").alias(g), F.col("removed").alias(c), F.col("n").alias(n))
    both = docs.join(got, (F.col("doc_id").cast("long") == F.col(i)) & (F.xxhash64("text") == F.col(g)), "left")
    plain = [F.col(f"`{x}`") for x in names]
    twin = F.col(n).isNotNull() & F.coalesce(F.regexp_count("text", F.lit(_WORD.pattern)) >= PASSAGE, F.lit(False))
    whole = F.struct(*plain)
    several = both.where(twin).groupBy(i, g).agg(F.first(c).alias(c), F.min_by(whole, F.to_json(whole)).alias(row)).select(f"{row}.*", c)
    both = both.where(~twin).select(*plain, c).unionByName(several)
    counted = "n_chars" in names
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = batch.column(c).to_pylist()
            whole = batch.column("text").to_pylist()
            values = [cut(t, m) if m else t for t, m in zip(whole, marks)]
            columns = {x: batch.column(x) for x in names}
            columns["text"] = pa.array(values, schema.field("text").type)
            if counted:
                old = batch.column("n_chars").to_pylist()
                columns["n_chars"] = pa.array([len(v) if m else x for v, m, x in zip(values, marks, old)], schema.field("n_chars").type)
            stays = pa.array([not m or bool(_WORD.search(v)) for v, m in zip(values, marks)])
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema).filter(stays)

    return both.mapInArrow(lean(run), docs.schema)
