"""Streams with state against the batch, in any batching, with late rows and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from lumenspan import queries
from lumenspan.operators import metrics, rollups
from lumenspan.streaming.deltas import Deltas
from lumenspan.streaming.series import SeriesGuard, increases_table, land_increases

SECOND = 1_000_000_000
MINUTE = 60 * SECOND


def points_of(rng, n):
    rows = []
    for s in ("a", "b", "c"):
        value = 0
        for k in range(n):
            value = rng.randrange(5) if rng.random() < 0.1 else value + rng.randrange(9)
            rows.append((s, 7 * k * SECOND + rng.randrange(SECOND), value))
    return rows


def run(spark, tmp_path, batches, cumulative=True, horizon=10**15, idle="7 days"):
    """Each batch is a file that arrives before the query is started once more."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "series string, recorded_at long, value long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("series string, recorded_at long, value long").parquet(str(tmp_path / "in"))
        land_increases(stream, MINUTE, str(tmp_path / "out"), str(tmp_path / "check"), cumulative, horizon, idle).awaitTermination(90)
        if k == 1:
            increases_table(str(tmp_path / "out")).compact(spark)
    return increases_table(str(tmp_path / "out")).read(spark)


@pytest.mark.parametrize("cumulative", [True, False])
def test_increases_don_t_depend_on_batches(spark, tmp_path, cumulative):
    rng = random.Random(3)
    rows = points_of(rng, 40)
    mixed = rng.sample(rows, len(rows))
    found = run(spark, tmp_path, [mixed[:50], mixed[50:55], mixed[55:]], cumulative)
    want = metrics.increases(spark.createDataFrame(rows, "series string, recorded_at long, value long"), ["series"], MINUTE, cumulative)
    tuples = lambda df: sorted((r["series"], r["step_at"], r["increase"], r["elapsed_ns"]) for r in df.collect() if r["increase"] or r["elapsed_ns"])
    assert tuples(found) == tuples(want) and found.agg(F.sum("late")).first()[0] == 0


def test_points_beyond_the_horizon_are_counted(spark, tmp_path):
    rows = [("a", k * MINUTE, 10 * k) for k in range(1, 10)]
    found = run(spark, tmp_path, [rows, [("a", MINUTE + 1, 11), ("a", 10 * MINUTE, 100)]], horizon=2 * MINUTE)
    assert found.agg(F.sum("late"), F.sum("increase")).first()[:] == (1, 90)
    assert [r["step_at"] for r in found.filter("late > 0").collect()] == [MINUTE]


def test_idle_series_are_forgotten(spark, tmp_path):
    day = 86_400 * SECOND
    found = run(spark, tmp_path, [[("a", 100 * day, 5), ("b", 100 * day, 5)], [("b", 103 * day, 8)], [("a", 103 * day, 9), ("b", 103 * day + 1, 9)]], idle="1 day")
    assert {r["series"]: r["increase"] for r in found.groupBy("series").agg(F.sum("increase").alias("increase")).collect()} == {"b": 4}


def test_delta_tables(spark, tmp_path):
    table = Deltas(str(tmp_path), ("k",), {"n": "sum", "low": "min", "high": "max", "value": "last:at", "at": "max"})
    rows = lambda *r: spark.createDataFrame(list(r), "k string, n long, low long, high long, value long, at long")
    with pytest.raises(FileNotFoundError):
        table.read(spark)
    table.add(rows(("a", 1, 5, 5, 5, 1), ("a", 1, 7, 7, 7, 2), ("b", 1, 1, 1, 1, 1)), 0)
    for _ in range(2):  # a repeated batch replaces itself
        table.add(rows(("a", 2, 3, 9, 3, 0)), 1)
    want = [("a", 4, 3, 9, 7, 2), ("b", 1, 1, 1, 1, 1)]
    assert sorted(map(tuple, table.read(spark).collect())) == want
    assert table.compact(spark, keep=True) == table.compact(spark) == 1
    assert sorted(map(tuple, table.read(spark).collect())) == want
    table.add(rows(("b", 5, 0, 0, 0, 9)), 2)
    assert sorted(map(tuple, table.read(spark).collect())) == [want[0], ("b", 6, 0, 1, 0, 9)] and table.compact(spark) == 2 == table.compact(spark)
    assert sorted(map(tuple, table.read(spark).collect())) == [want[0], ("b", 6, 0, 1, 0, 9)]


@pytest.mark.parametrize("cuts", [(), (3, 7), tuple(range(1, 12))])
def test_series_guard_whatever_the_batches(spark, tmp_path, cuts):
    rows = [("m", f"s{k % 5}", k) for k in range(12)] + [("other", "s0", 1)]
    points = lambda r: spark.createDataFrame(r, "metric string, series string, recorded_at long")
    guard = SeriesGuard(str(tmp_path), 3)
    bounds = [0, *cuts, len(rows)]
    for batch, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        for _ in range(2 if batch == 1 else 1):
            guard.writer()(points(rows[a:b]), batch)
    kept, rest = rollups.first_series(points(rows), "metric", "series", 3)
    assert sorted(map(tuple, guard.points(spark).select("metric", "series", "recorded_at").collect())) == sorted(map(tuple, kept.select("metric", "series", "recorded_at").collect()))
    assert {r["metric"]: r["rejected"] for r in guard.rejected(spark).collect()} == {"m": rest.count(), "other": 0}


def test_late_spans_are_made_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def mark(k):
        made.add(1)
        return k

    rows = spark.range(300).select("id", F.udf(mark, "long")("id").alias("row_id"))
    spans = rows.select("row_id", F.lit("svc").alias("service"), (F.col("id") * 10**9).alias("started_at"), (F.col("id") + 1).alias("duration_ns"))
    monkeypatch.setattr(queries.S, "spans", lambda *_: spans)
    r = queries.snk_3_ing_5_late_spans(spark, "").agg(F.sum("n"), F.sum("sum_ns")).first()
    assert tuple(r) == (300, 300 * 301 // 2) and made.value == 300
