"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives P; a sample of texts, whatever their
labels, is the unlabelled set U.  A linear model over hashed words minimises
the non-negative risk  prior * R+(P) + max(0, R-(U) - prior * R-(P))  with the
logistic loss, by gradient descent in numpy; where the bracket turns negative,
a step is taken back along it.  The margin is then scaled to a probability on
the labelled rows.  Words are runs of letters and digits in lower case.

Only the fit uses samples, one row of a doc_id, and their bounds are parameters
(``MOST_POSITIVE``, ``MOST_UNLABELLED``, ``MOST_LABELLED``); how many texts hold
a word is counted over all rows outside the fold, and every whole text is
scored.  The features are all words whose frequencies in P and among all texts
differ by ``LEAST_Z`` standard errors or more, however many; copies of a text
in P count once there.  The driver gets the features of the sampled texts and
two counts for each of ``BUCKETS`` hashed words.

Cases: a null or empty text has the score of a text without known words; with
no positive or no negative labels every score is the prior (0 without labels).
Repeated labels of a document count as toxic if any does; of rows that repeat a
doc_id, the fit takes the one with the smallest text hash.  Rows are scored one
by one, so repeated rows have equal scores; words of equal z are all features
or none.  A very long text is a slice of its own and counts each word once.
Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrules.llm.common import crc_of_id, map_texts, slices, store, texts
from sparkrules.llm.learning import decide, fit_logistic, sample_ids, sigmoid

BUCKETS = 1 << 18
MOST_POSITIVE = 5_000
MOST_UNLABELLED = 10_000
MOST_LABELLED = 10_000
LEAST_Z = 3.5
FOLDS, HELD = 5, 0

_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> set[bytes]:
    return set(text.lower().encode().translate(_PLAIN).split())


def bucket(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word) % BUCKETS


def _buckets(batch: pa.RecordBatch) -> dict:
    from xxhash import xxh64_intdigest

    values = texts(batch)
    digests = np.array([xxh64_intdigest(t.encode()) for t in values], np.uint64).view(np.int64)
    return {"doc_id": batch.column("doc_id"), "digest": digests, "buckets": [sorted({bucket(w) for w in words_of(t)}) for t in values]}


@dataclass
class Model:
    weights: dict[int, float]
    intercept: float
    scale: float
    shift: float

    def __post_init__(self):
        self.cache: dict[bytes, float] = {}

    def score(self, values: list[str]) -> np.ndarray:
        cache, out = self.cache, np.empty(len(values))
        for i, t in enumerate(values):
            words = words_of(t)
            for w in [w for w in words if w not in cache]:
                cache[w] = self.weights.get(bucket(w), 0.0)
            out[i] = sum(sorted(filter(None, map(cache.__getitem__, words))))
            if len(cache) > 400_000:
                cache.clear()
        return sigmoid(self.scale * (out + self.intercept) + self.shift)


class Rows:
    """A sparse matrix of zeros and ones, with a product from either side."""

    __array_ufunc__ = None  # leaves ``g @ rows`` to __rmatmul__
    dtype = np.dtype(float)

    def __init__(self, rows: list, features: np.ndarray):
        at = np.full(BUCKETS, -1, np.int32)
        at[features] = np.arange(len(features))
        picked = [j[j >= 0] for j in (at[np.asarray(r, np.int64)] for r in rows)]
        self.shape = len(rows), len(features)
        self.column = np.concatenate([*picked, np.zeros(0, np.int32)])
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(j) for j in picked])

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.shape[0])

    def __rmatmul__(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, g[self.row], self.shape[1])


def _counts(rows: list) -> np.ndarray:
    """In how many rows each bucket is."""
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[np.asarray(r, np.int64)] += 1
    return out


def risk_gradient(xp, xu, w, b, prior):
    """Gradient of the non-negative risk, and the bracket that must not be negative."""
    w = w.astype(xp.dtype)
    p, u = (xp @ w + b).astype(float), (xu @ w + b).astype(float)
    gp, gu = -sigmoid(-p) / len(p), sigmoid(u) / len(u)  # of the losses of P as positive and U as negative
    gn = sigmoid(p) / len(p)  # of P as negative
    bracket = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
    gp, gu, gn = (g.astype(xp.dtype) for g in (gp, gu, gn))
    neg_w, neg_b = gu @ xu - prior * (gn @ xp), float(gu.sum() - prior * gn.sum())
    if bracket < 0:
        return -neg_w, -neg_b, bracket
    return prior * (gp @ xp) + neg_w, prior * float(gp.sum()) + neg_b, bracket


def telling(cp: np.ndarray, np_: int, cu: np.ndarray, nu: int) -> np.ndarray:
    """Buckets whose shares of np_ positive and nu unlabelled texts differ clearly, the clearest first."""
    share = np.clip((cp + cu + 1.0) / (np_ + nu + 2.0), 1e-12, 1 - 1e-12)
    z = (cp / np_ - cu / nu) / np.sqrt(share * (1 - share) * (1 / np_ + 1 / nu))
    order = np.argsort(-np.abs(z), kind="stable")
    features = order[np.abs(z[order]) >= LEAST_Z]
    return features if len(features) else order[:64]


def fit(positive: list, unlabelled: list, labelled: list, labels: np.ndarray, prior: float, steps: int = 300, features: np.ndarray | None = None) -> Model:
    """``positive``, ``unlabelled``, ``labelled``: bucket lists; ``labels`` (0 or 1) of the last, for the scale; ``features``: the buckets used."""
    if not len(positive) or not len(unlabelled) or not 0 < prior < 1:
        return _flat(prior)
    if features is None:
        features = telling(_counts(positive), len(positive), _counts(unlabelled), len(unlabelled))
    xp, xu = Rows(positive, features), Rows(unlabelled, features)
    w, b = np.zeros(len(features)), float(np.log(prior / (1 - prior)))
    m, v, l2, rate = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 1e-5, 0.05
    for t in range(1, steps + 1):
        gw, gb, _ = risk_gradient(xp, xu, w, b, prior)
        g = np.append(gw + l2 * w, gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    margin = decide(Rows(labelled, features), np.append(w, b))
    scale, shift = 1.0, 0.0
    if 0 < labels.sum() < len(labels):
        scale, shift = fit_logistic(margin[:, None], labels.astype(float), l2=0.01)
    keep = np.abs(w) > 1e-4
    return Model(dict(zip(features[keep].tolist(), w[keep].tolist())), b, float(scale), float(shift))


def _flat(prior: float) -> Model:
    return Model({}, 0.0, 0.0, -40.0 if prior <= 0 else 40.0 if prior >= 1 else float(np.log(prior / (1 - prior))))


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket is, and the number of texts; counted in tables of fixed size, one a task."""

    def run(batches):
        total, rows, known = np.zeros(BUCKETS, np.int64), 0, {}
        for part in slices(batches):
            if len(known) > 400_000:
                known.clear()
            for t in texts(part):
                words = words_of(t)
                for w in [w for w in words if w not in known]:
                    known[w] = bucket(w)
                total[list(set(map(known.__getitem__, words)))] += 1
                rows += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], names=["bucket", "n"])

    # one row for a bucket
    found = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    at, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    counts = np.zeros(BUCKETS, np.int64)
    counts[at[at >= 0]] = n[at >= 0]
    return counts, int(n[at < 0].sum())


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labels of rows outside the held-out fold, word counts of all such rows and a bounded sample of texts."""
    fold = crc_of_id() % FOLDS != HELD
    marks = labels.where(fold & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = marks.agg(F.avg("toxic"), F.count("*")).first()
    if not share[1]:
        return Model({}, 0.0, 0.0, -40.0)
    open_ = docs.where(fold & F.col("doc_id").isNotNull()).select("doc_id", "text")
    ids = open_.select("doc_id").distinct()
    chosen = (
        sample_ids(ids, MOST_UNLABELLED).select("doc_id", F.lit(2).alias("kind"))
        .unionByName(sample_ids(marks.where("toxic = 1"), MOST_POSITIVE).select("doc_id", F.lit(1).alias("kind")))
        .unionByName(sample_ids(marks, MOST_LABELLED).select("doc_id", F.when(F.col("toxic") == 1, 4).otherwise(3).alias("kind")))
        .groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))
    )
    # at most the three bounds together, so small enough to send to every executor
    found = map_texts(open_.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"), ["doc_id", "text"], _buckets, "doc_id long, digest long, buckets array<int>")
    found = found.groupBy("doc_id").agg(F.min(F.struct("digest", "buckets")).alias("one")).select("doc_id", "one.*")
    found = store(found.join(F.broadcast(chosen), "doc_id"), "sampled-words")
    positive = found.where(F.array_contains("kinds", 1)).dropDuplicates(["digest"])
    got = positive.select(F.explode("buckets").alias("b")).groupBy("b").count().toArrow()  # at most BUCKETS rows
    cp, np_ = np.zeros(BUCKETS, np.int64), positive.count()
    cp[got.column("b").to_numpy()] = got.column("count").to_numpy()
    cu, nu = frequencies(open_)
    if not np_ or not nu:
        return _flat(float(share[0]))
    features = telling(cp, np_, cu, nu)
    wanted = pa.array(features.astype(np.int32))

    def picked(batches):
        import pyarrow.compute as pc

        for batch in batches:
            lists = batch.column("buckets")
            flat, n = lists.flatten(), pc.list_value_length(lists).to_numpy()
            owner, hit = np.repeat(np.arange(len(n)), n), pc.is_in(flat, wanted).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[hit], minlength=len(n)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("kinds"), pa.ListArray.from_arrays(pa.array(ends), flat.filter(pa.array(hit)))], names=["kinds", "buckets"])

    rows = found.select("kinds", "buckets").mapInArrow(picked, "kinds array<int>, buckets array<int>").toArrow()
    kinds, buckets = rows.column("kinds").to_pylist(), rows.column("buckets").combine_chunks()
    flat, ends = buckets.values.to_numpy(), buckets.offsets.to_numpy()
    of = lambda *which: [flat[ends[i] : ends[i + 1]] for i, k in enumerate(kinds) if any(x in k for x in which)]
    return fit(of(1), of(2), of(3, 4), np.array([int(4 in k) for k in kinds if 3 in k or 4 in k]), float(share[0]), features=features)


SCHEMA = "doc_id long, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    found = map_texts(docs, ["doc_id", "text"], lambda b: {"doc_id": b.column("doc_id"), "score": model.score(texts(b))}, SCHEMA)
    return found.select(
        "doc_id", F.coalesce(crc_of_id() % FOLDS == HELD, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
