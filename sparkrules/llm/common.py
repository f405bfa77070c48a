"""What the text operators share: reading, bounded Arrow batches, shared storage and word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and text bytes that one call of a text function sees at most (a longer single text comes alone).  Spark itself
#: bounds the bytes of an Arrow batch, to 64 MB unless told otherwise.
SLICE_ROWS = 1000
SLICE_BYTES = 6 << 20
#: rows of an Arrow batch while a step is written, so that workers hold less
STORE_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names that clash with none of ``taken`` (names are compared without case)."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not where and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="sparkrules-"))
    return (where or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = STORE_ROWS) -> Iterator[None]:
    """Arrow batches of fewer rows inside; the session is then as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def delete(*frames: DataFrame) -> None:
    """Remove tables written by ``store`` that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent()
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: keys with more than so small a part of all rows are joined by broadcast; there can be no more of them than this
CROWDED = 1000


def join_counted(rows: DataFrame, key: str, keyed: DataFrame) -> DataFrame:
    """``rows`` with the row of ``keyed`` (k, n: how many rows have that key, others) of their key; rows without one go.

    A key of very many rows would make one task of a shuffle join long, so those
    keys, few by their definition, are joined by broadcast.
    """
    shared_dir(rows.sparkSession)
    keyed = keyed.checkpoint()
    total, most = keyed.agg(F.sum("n"), F.max("n")).first()
    crowded = F.col("n") * CROWDED >= (total or 0)
    if not total or most * CROWDED < total:
        return rows.join(keyed, F.col(key) == F.col("k"))
    rest = rows.join(F.broadcast(keyed.where(crowded).select("k")), F.col(key) == F.col("k"), "left_anti")
    return rows.join(F.broadcast(keyed.where(crowded)), F.col(key) == F.col("k")).unionByName(rest.join(keyed.where(~crowded), F.col(key) == F.col("k")))


#: word hashes that this worker knows, and what it keeps from task to task, of one operator at a time
_WORDS: dict[bytes, int] = {}
_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What a worker makes once and has until it works for another operator."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    """Forget the word table and return freed memory to the system: idle workers count beside the executor's heap."""
    _WORDS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable:
    """``run`` in a worker that holds nothing of other operators (``keeps``: it uses ``kept``) and gives memory back at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def forget() -> None:
    """Drop what the worker keeps."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``rows`` rows and ``most`` bytes of the text column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(text).cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, base + most, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def map_texts(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], dict], schema: str, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> DataFrame:
    """Apply ``fn`` to bounded slices of the named columns; it returns the output columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=most, rows=rows):
            got = fn(part)
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)

    return df.select(*columns).mapInArrow(lean(run), schema)


def keep_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray], most: int = SLICE_BYTES) -> DataFrame:
    """Rows of ``df``, all columns, for which ``fn`` (True to keep, by row of a slice) holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=most):
            yield part.filter(pa.array(fn(part), type=pa.bool_()))

    return df.mapInArrow(lean(run), df.schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as text, as a Spark column."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of words, the same on every machine; a worker's table of at most ``most`` words saves hashing frequent ones again (0: no table, which is faster where many words differ)."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        if not self.most:
            return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        known = _WORDS
        try:
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            pass
        new = {w for w in words if w not in known}
        if len(known) + len(new) > self.most:
            known.clear()
            new = set(words)
        if len(new) > self.most:  # more than the table may hold
            return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        for w in new:
            known[w] = xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def split_words(values: list[str], lower: bool = False) -> tuple[list[bytes], np.ndarray]:
    """All words (maximal runs without ASCII white space) of all texts, and the number of words of each."""
    parts = [(t.encode().lower() if lower else t.encode()).split() for t in values]
    counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    return [w for p in parts for w in p], counts


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive hashes (by start; empty if there are fewer)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += hashes[j : j + n]
    return mix(out)
