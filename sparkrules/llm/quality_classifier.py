"""Quality classifier by co-training of two views.

The content view sees style figures of the text; the metadata view sees
source, language and length.  Both start from the labelled rows; in each round
either view labels the pool rows that it is most sure of and hands them to the
other one.  Afterwards each view is calibrated on labelled rows that neither
was fitted to, and a logistic combination of the calibrated views scores all
documents.

The fit uses at most ``MOST_LABELLED`` labelled rows and ``MOST_POOL`` others,
one row of a doc_id; the mean and spread of the content figures are those of
all rows outside the fold, and every whole text is scored.

Cases: a null text is empty; null source or language is a value of its own; a
null n_chars is 0.  With labels of one class or none every score is that
class's share (0.5 without labels).  Of repeated labels the lowest counts; of
rows that repeat a doc_id, the fit takes the one whose figures come first.
Pool rows of which a view is equally sure come in the order of their rows.
Repeated rows have equal scores.  A very long text is a slice of its own.  Other
columns are ignored by ``score`` and carried along by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrules.llm.common import crc_of_id, keep_texts, lean, map_texts, slices, texts
from sparkrules.llm.learning import decide, fit_logistic, sample_ids, sigmoid

MOST_LABELLED = 6_000
MOST_POOL = 6_000
ROUNDS = 4
SURE = 0.95
#: pool rows that a view hands over in a round, at most, as a share of the pool
SHARE = 0.1
FOLDS, HELD, CALIBRATE = 5, 0, 1
#: documents below this score are rejected
LEAST_SCORE = 0.5
KINDS = 16
SOURCES, LANGS, LENGTHS = 64, 16, 24


def _kind(c: int) -> int:
    """A class for each byte: letters by case, digits, white space, marks."""
    ch = chr(c)
    if c >= 128:
        return 0
    fixed = {" ": 1, "\n": 2, ".": 3, ",": 4, "!": 5, "?": 5, "|": 6, "*": 7, "#": 8, "$": 7, "%": 7, "&": 7, "<": 9, ">": 9, "\t": 1}
    if ch in fixed:
        return fixed[ch]
    return 10 if ch in "aeiou" else 11 if ch.islower() else 12 if ch.isupper() else 13 if ch.isdigit() else 14 if ch.isprintable() else 15


_KIND = np.array([_kind(c) for c in range(256)], dtype=np.uint16)
N_CONTENT = KINDS * KINDS + 8


def content_features(values: list[str]) -> np.ndarray:
    """Square roots of the shares of byte-class pairs, then figures of words and lines."""
    out = np.zeros((len(values), N_CONTENT), np.float32)
    for i, t in enumerate(values):
        data = t.encode()
        if not data:
            continue
        kinds = _KIND[np.frombuffer(data, np.uint8)]
        pairs = np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS)
        out[i, : KINDS * KINDS] = np.sqrt(pairs / max(1, len(data) - 1))
        words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
        n, distinct = len(words), len(set(words))
        out[i, KINDS * KINDS :] = (
            np.log1p(n), distinct / max(1, n), np.log1p(n) * distinct / max(1, n), len(data) / max(1, n) / 10,
            len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), np.log1p(len(data) / max(1, len(lines))), 1.0,
        )
    return out


def _slot(value: str | None, slots: int) -> int:
    from xxhash import xxh64_intdigest

    return 0 if value is None else 1 + xxh64_intdigest(value.encode()) % (slots - 1)


def metadata_features(sources: list, langs: list, lengths: list) -> np.ndarray:
    """Indicators of source, language and the power of two of the length."""
    out = np.zeros((len(sources), SOURCES + LANGS + LENGTHS), np.float32)
    for i, (s, g, n) in enumerate(zip(sources, langs, lengths)):
        out[i, _slot(s, SOURCES)] = out[i, SOURCES + _slot(g, LANGS)] = 1
        out[i, SOURCES + LANGS + min(LENGTHS - 1, max(0, n or 0).bit_length())] = 1
    return out


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    meta = [batch.column(k).to_pylist() for k in ("source", "lang", "n_chars")]
    return content_features(texts(batch)), metadata_features(*meta)


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    content: np.ndarray
    metadata: np.ndarray
    scales: np.ndarray  # of either view: slope, shift
    mixed: np.ndarray  # weights of the calibrated log odds, intercept

    def views(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        raw = np.column_stack([decide((x - self.mean) / self.spread, self.content), decide(z, self.metadata)])
        return np.clip(raw * self.scales[:, 0] + self.scales[:, 1], -30, 30)

    def score(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        odds = self.views(*_views(batch))
        return sigmoid(odds), sigmoid(decide(odds, self.mixed))


def _flat(odds: float) -> Model:
    return Model(np.zeros(N_CONTENT), np.ones(N_CONTENT), np.zeros(N_CONTENT + 1), np.zeros(SOURCES + LANGS + LENGTHS + 1), np.zeros((2, 2)), np.array([0.0, 0.0, odds]))


def _calibrated(raw: np.ndarray, y: np.ndarray) -> np.ndarray:
    got = fit_logistic(raw[:, None], y, l2=0.01)
    return got if got[0] > 0 else np.array([0.0, got[1]])


def handed_over(p: np.ndarray, free: np.ndarray, share: float, most: int) -> list[tuple[np.ndarray, int]]:
    """Free pool rows by label that a view of probabilities ``p`` is surest of: at most ``most``, good and bad ones in the ratio of its own."""
    sides = []
    for label, sure in ((1, p), (0, 1 - p)):
        rows = np.flatnonzero(free & (sure >= SURE))
        sides.append((rows[np.argsort(-sure[rows], kind="stable")], share if label else 1 - share, label))
    whole = min(most, *(len(rows) / max(part, 1e-9) for rows, part, _ in sides))
    return [(rows[: int(whole * part + 1e-9)], label) for rows, part, label in sides]


def fit(x: np.ndarray, z: np.ndarray, y: np.ndarray, hold: np.ndarray, rounds: int = ROUNDS, figures: tuple | None = None) -> Model:
    """x, z: the views; y: 1, 0 or -1 (pool); hold: labelled rows kept for calibration; figures: mean and spread of x."""
    known = y >= 0
    if len(set(y[known].tolist())) < 2:
        share = y[known].mean() if known.any() else 0.5
        return _flat(float(np.log((share + 1e-4) / (1 - share + 1e-4))))
    if len(set(y[known & hold].tolist())) < 2 or len(set(y[known & ~hold].tolist())) < 2:
        hold = known  # too few rows to hold any back
        start = known
    else:
        start = known & ~hold
    mean, spread = figures or (x.mean(0), x.std(0) + 1e-3)
    views = [((x - mean) / spread).astype(np.float64), z.astype(np.float64)]
    mine = [np.where(start, y, -1), np.where(start, y, -1)]  # what each view learns from
    models = [None, None]
    for turn in range(rounds + 1):
        for k in (0, 1):
            rows = mine[k] >= 0
            models[k] = fit_logistic(views[k][rows], mine[k][rows].astype(float), l2=3.0)
        if turn == rounds:
            break
        most = max(1, int(SHARE * (y < 0).sum()))
        for k in (0, 1):
            p = sigmoid(decide(views[k], models[k]))
            share = float(mine[k][mine[k] >= 0].mean())
            for rows, label in handed_over(p, (y < 0) & (mine[1 - k] < 0), share, most):
                mine[1 - k][rows] = label
    held = known & hold
    scales = np.array([_calibrated(decide(v[held], m), y[held].astype(float)) for v, m in zip(views, models)])
    model = Model(mean, spread, models[0], models[1], scales, np.zeros(3))
    model.mixed = fit_logistic(model.views(x[held], z[held]), y[held].astype(float), l2=0.1)
    return model


def figures(docs: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and spread of the content figures of all texts; None if there are none."""

    def run(batches):
        n, total = 0, np.zeros((2, N_CONTENT))
        for part in slices(batches):
            x = content_features(texts(part)).astype(np.float64)
            n += len(x)
            total += [x.sum(0), (x * x).sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total[0]], pa.list_(pa.float64())), pa.array([total[1]], pa.list_(pa.float64()))], names=["n", "s", "q"])

    sums = [F.sum(F.col(c)[k]) for c in ("s", "q") for k in range(N_CONTENT)]
    got = docs.select("text").mapInArrow(lean(run), "n long, s array<double>, q array<double>").agg(F.sum("n"), F.array(*sums[:N_CONTENT]), F.array(*sums[N_CONTENT:])).first()
    if not got[0]:
        return None
    mean = np.array(got[1]) / got[0]
    return mean, np.sqrt(np.maximum(np.array(got[2]) / got[0] - mean * mean, 0)) + 1e-3


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from a bounded sample of labelled rows outside the held-out fold and a bounded pool."""
    fold = crc_of_id() % FOLDS != HELD
    marks = labels.where(fold & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    open_ = docs.where(fold & F.col("doc_id").isNotNull())
    chosen = (
        sample_ids(marks, MOST_LABELLED).unionByName(sample_ids(open_.select("doc_id").distinct(), MOST_POOL).withColumn("y", F.lit(-1)))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )

    def features(b: pa.RecordBatch) -> dict:
        x, z = _views(b)
        return {"doc_id": b.column("doc_id"), "x": list(x), "z": list(z)}

    # at most both bounds together, so small enough to send to every executor
    part = open_.select(*COLUMNS).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").select(*COLUMNS)
    found = map_texts(part, COLUMNS, features, "doc_id long, x array<float>, z array<float>")
    found = found.groupBy("doc_id").agg(F.min(F.struct("x", "z")).alias("one")).select("doc_id", "one.*")
    rows = found.join(F.broadcast(chosen), "doc_id").select("x", "z", "y", (crc_of_id() % FOLDS == CALIBRATE).alias("hold"), "doc_id").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return _flat(0.0)
    wide = lambda k: rows.column(k).combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    return fit(wide("x"), wide("z"), rows.column("y").to_numpy(), rows.column("hold").to_numpy(), figures=figures(open_))


SCHEMA = "doc_id long, content_score double, metadata_score double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every document's scores by view and combined, and the decision."""

    def run(b: pa.RecordBatch) -> dict:
        views, mixed = model.score(b)
        return {"doc_id": b.column("doc_id"), "content_score": views[:, 0], "metadata_score": views[:, 1], "score": mixed}

    found = map_texts(docs, COLUMNS, run, SCHEMA)
    return found.select(
        "doc_id", F.coalesce(crc_of_id() % FOLDS == HELD, F.lit(False)).alias("held_out"), "content_score", "metadata_score", "score", (F.col("score") >= LEAST_SCORE).alias("kept")
    )


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, that are not rejected."""
    return keep_texts(docs, lambda b: model.score(b)[1] >= LEAST_SCORE)
