"""Comparing all members of lists without ever holding a long list in one task.

A list of more than ``block`` members is cut into n chunks by a hash of the
member; the rows of chunk c go to the n pairs (c, o), so that every pair of
members meets in exactly one pair of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrules.llm.common import join_counted


def deal(posted: DataFrame, key: str, member: str, block: int, least: int = 2) -> DataFrame:
    """``posted`` rows of lists of at least ``least`` members, with c1, c2 (the pair of chunks) and c (the row's own), grouped and sorted by them."""
    lengths = posted.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rows = join_counted(posted, key, lengths).withColumn("_n", F.ceil(F.col("n") / block).cast("int")).drop("k", "n")
    rows = rows.withColumn("c", F.pmod(F.xxhash64(member), F.col("_n")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.withColumn("c1", F.least("c", "_o")).withColumn("c2", F.greatest("c", "_o")).drop("_n", "_o")
    parts = int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, key, "c1", "c2").sortWithinPartitions(key, "c1", "c2")


def runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of consecutive rows equal in the (integer) columns."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        if not table.num_rows:
            continue
        ids = np.column_stack([table.column(k).to_numpy() for k in columns])
        start = 0
        for stop in (np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist():
            yield table.slice(start, stop - start)
            start = stop
        rest = table.slice(start)
    if rest is not None and rest.num_rows:
        yield rest


def whole_runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of one or more whole runs, of about ``least`` rows unless a run is longer."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < least:
            continue
        table = pa.concat_tables(held).combine_chunks()
        ids = np.column_stack([table.column(k).to_numpy() for k in columns])
        cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1))
        stop = int(cuts[-1]) + 1 if len(cuts) else 0
        if stop:
            yield table.slice(0, stop).combine_chunks()
        held = [table.slice(stop)]
    if held and sum(t.num_rows for t in held):
        yield pa.concat_tables(held).combine_chunks()


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two chunks of a run (the same array where it is one chunk)."""
    c1, c2, c = (table.column(k).to_numpy() for k in ("c1", "c2", "c"))
    rows = np.arange(len(c))
    if c1[0] == c2[0]:
        return rows, rows
    return rows[c == c1[0]], rows[c == c2[0]]
