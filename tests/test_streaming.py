import pandas as pd
import pytest

from sparkrules.streaming import windows


@pytest.fixture()
def stream(spark, tmp_path):
    rows = pd.DataFrame({"k": ["a", "a", "b", "a"], "ts": [1000, 1400, 1100, 1900], "v": [3.0, 2.0, 5.0, 4.0]})
    path = str(tmp_path / "in")
    spark.createDataFrame(rows).coalesce(1).write.parquet(path)
    return spark.readStream.schema("k string, ts long, v double").parquet(path)


def collect(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return sorted(tuple(r) for r in df.sparkSession.table(name).collect())


def test_time_and_length_windows(stream):
    assert collect(windows.time_window_sum(stream, "k", "ts", "v", 500, "s"), "w1") == [("a", 1000, 3.0, 3.0), ("a", 1400, 2.0, 5.0), ("a", 1900, 4.0, 4.0), ("b", 1100, 5.0, 5.0)]
    assert collect(windows.length_window_sum(stream, "k", "ts", "v", 2, "s"), "w2") == [("a", 1000, 3.0, 3.0), ("a", 1400, 2.0, 5.0), ("a", 1900, 4.0, 6.0), ("b", 1100, 5.0, 5.0)]


def test_windows_equal_a_row_at_a_time(spark, tmp_path):
    """Several batches with late rows, against a plain replay."""
    import random

    r = random.Random(2)
    files, seen, want, lengths = [], {}, [], []
    for f in range(3):
        rows = [(r.choice("ab"), 1000 * f + r.randint(-900, 1500) + 2000, float(r.randint(0, 9))) for _ in range(25)]
        for k, t, v in sorted(rows, key=lambda x: x[1]):
            clock, kept, last = seen.get(k, (0, [], []))
            clock = max(clock, t)
            kept = [(x, y) for x, y in [*kept, (t, v)] if x + 500 > clock]
            last = [*last, v][-4:]
            seen[k] = clock, kept, last
            want.append((k, t, v, sum(y for _, y in kept)))
            lengths.append((k, t, v, sum(last)))
        files.append(rows)
    path = str(tmp_path / "in")
    for rows in files:
        spark.createDataFrame(rows, "k string, ts long, v double").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("k string, ts long, v double").option("maxFilesPerTrigger", 1).parquet(path)
    assert collect(windows.time_window_sum(stream, "k", "ts", "v", 500, "s"), "w5") == sorted(want)
    assert collect(windows.length_window_sum(stream, "k", "ts", "v", 4, "s"), "w6") == sorted(lengths)


def test_live_and_idle_keys(stream):
    assert [r[1] for r in collect(windows.live(stream, "k", "ts", "v", 100), "w7")] == [1000, 1400, 1900, 1100]
    assert len(collect(windows.time_window_sum(stream, "k", "ts", "v", 500, "s", idle_ms=10_000), "w8")) == 4


def test_closing(stream):
    assert [r[3] for r in collect(windows.closing(stream, "k", "ts", "v", 450, "c"), "w3")] == [False, True, False, False]


def test_temporal_join(stream):
    got = collect(windows.temporal_join(stream, stream, "k", "ts", 1, 500).select("a_k", "a_ts", "b_ts"), "w4")
    assert got == [("a", 1000, 1400), ("a", 1400, 1900)]
