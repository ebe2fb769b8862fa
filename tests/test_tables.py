"""Tables that grow: the roll-up job, landing of requests, pages of days, and their plans."""

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F
from test_ingest import LOGS, METRICS, SPANS, attribute

from lumenspan.functions import attributes as A
from lumenspan.functions import texts as T
from lumenspan.operators import catalog, distinct, newest, retention, rollup_job, rollups, spans
from lumenspan.plans.ranges import DAY, HOUR, MINUTE, Range
from lumenspan.sources import daily
from lumenspan.streaming import landing


def test_rollup_job_in_any_runs_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(7)
    rows, value = [], 0
    for t in sorted(rng.sample(range(0, 30 * 60), 300)):
        value = rng.randrange(4) if rng.random() < 0.1 else value + rng.randrange(5)
        rows.append((rng.choice("ab"), t * MINUTE + t, value))
    points = spark.createDataFrame(rows, "series string, recorded_at long, value long")
    job = rollup_job.MetricRollup(str(tmp_path / "t"))
    assert job.run(points, HOUR + 2 * MINUTE - 1) == 0 and job.run(points, 5 * HOUR + 2 * MINUTE) == 5 * HOUR == job.run(points, 5 * HOUR + 3 * MINUTE)
    rollups.metric_summary(points.limit(1), ["series"], MINUTE).write.parquet(f"{tmp_path}/t/version=0/minutes/upto={6 * HOUR}")  # of a run that died
    assert job.run(points, 7 * HOUR + 2 * MINUTE) == 7 * HOUR and job.run(points, 24 * HOUR + 2 * MINUTE) == 24 * HOUR
    columns = ["series", "unit_at", "n", "low", "high", "sum", "last", "increase", "elapsed_ns"]
    read = lambda unit: sorted(map(tuple, job.read(spark, unit).select(columns).collect()))
    live = {unit: read(unit) for unit in ("minutes", "hours")}
    for unit, size in (("minutes", MINUTE), ("hours", HOUR)):
        want = rollups.metric_summary(points, ["series"], size).filter(F.col("unit_at") < 24 * HOUR).select(columns)
        assert live[unit] == sorted(map(tuple, want.collect()))
    assert job.rebuild(points, 24 * HOUR + 2 * MINUTE) == 1 == job.version(spark) and {unit: read(unit) for unit in live} == live


def test_landing_splits_every_line(spark, tmp_path):
    """Three signals with rejects, lines that are no requests, a late span; what is written adds up, also when repeated."""
    def span(trace, at, took, service):
        return json.dumps({"resourceSpans": [{"resource": {"attributes": [attribute("service.name", stringValue=service)]}, "scopeSpans": [{"spans": [{"traceId": trace * 16, "spanId": "12" * 8, "startTimeUnixNano": str(at), "endTimeUnixNano": str(at + took)}]}]}]})

    wild = {"resourceMetrics": [{"resource": {}, "scopeMetrics": [{"metrics": [{"name": "e", "exponentialHistogram": {"aggregationTemporality": 1, "dataPoints": [
        {"timeUnixNano": "9", "count": "1", "scale": s, "positive": {"offset": 0, "bucketCounts": ["1"] * n}} for s, n in ((20, 1), (21, 1), (-10, 4096), (-11, 1), (0, 4097))]}}]}]}]}
    batches = [[json.dumps(LOGS), json.dumps(SPANS), "{broken", "", span("aa", 8 * DAY, 5, "s")], [json.dumps(METRICS), json.dumps(wild), "[1]", span("bb", 8 * DAY + 1, 7, "s"), span("cc", DAY, 9, "s")]]
    (tmp_path / "in").mkdir()
    for k, lines in enumerate(batches):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines))
        landing.land(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    landing.land_batch(str(tmp_path / "out"))(spark.read.text(str(tmp_path / "in" / "1.json")), 1)  # the same batch again
    out = str(tmp_path / "out")
    assert [landing.records(spark, out, s).count() for s in ("logs", "spans", "points")] == [2, 4, 8]
    assert {(r["signal"], r["reason"]): r["n"] for r in landing.rejected(spark, out).collect()} == {
        ("lines", "a line is no JSON object"): 2, ("spans", "an ID of a span is missing"): 1, ("points", "summary metrics are not supported"): 1, ("points", "a delta sum that is not monotonic"): 1,
        ("points", "a point has no value"): 1, ("points", "the buckets of a histogram do not fit"): 1, ("points", "an exponential histogram is out of range"): 3,
    }
    minutes = {(r["unit_at"], r["bucket"] > 0): (r["n"], r["sum_ns"], r["low_ns"], r["high_ns"]) for r in landing.minutes_table(out).read(spark).filter("service = 's'").groupBy("unit_at", "bucket").agg(*[F.sum(c).alias(c) for c in ("n", "sum_ns")], F.min("low_ns").alias("low_ns"), F.max("high_ns").alias("high_ns")).groupBy("unit_at", (F.col("bucket") > 0).alias("bucket")).agg(F.sum("n").alias("n"), F.sum("sum_ns").alias("sum_ns"), F.min("low_ns").alias("low_ns"), F.max("high_ns").alias("high_ns")).collect()}
    assert minutes == {(8 * DAY, True): (2, 12, 5, 7), (DAY, True): (1, 9, 9, 9)}
    assert landing.records(spark, out, "spans", Range(8 * DAY, 9 * DAY)).count() == 2


@pytest.fixture(scope="module")
def days(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("days") / "t")
    rows = [(d * DAY + (k % 3) * HOUR, d * 10 + k, "rare" if d == 2 and k == 1 else "plain") for d in range(20) for k in range(6)]
    daily.write(spark.createDataFrame(rows, "logged_at long, row_id long, body string"), "logged_at", path)
    return path, sorted(rows, key=lambda r: (-r[0], -r[1]))


def test_pages_are_read_from_the_newest_day(spark, days):
    path, rows = days
    first = newest.newest_page(spark, path, "logged_at", F.lit(True), 4)
    assert [tuple(r)[1] for r in first.rows.collect()] == [r[1] for r in rows[:4]] and (first.truncated, first.partial, first.days) == (True, False, 1)
    got, cursor, most = [r["row_id"] for r in first.rows.collect()], first.next, 0
    while cursor:
        page = newest.newest_page(spark, path, "logged_at", F.lit(True), 25, cursor)
        got, cursor, most = got + [r["row_id"] for r in page.rows.collect()], page.next, max(most, page.days)
    assert got == [r[1] for r in rows] and most <= 7
    rare = newest.newest_page(spark, path, "logged_at", F.col("body") == "rare", 1)
    assert (rare.rows.count(), rare.truncated, rare.next, rare.partial, rare.days) == (1, False, None, False, 20)
    times = iter([0.0, 1.0, 9.0])
    late = newest.newest_page(spark, path, "logged_at", F.col("body") == "rare", 1, seconds=5, clock=lambda: next(times))
    assert (late.rows.count(), late.partial, late.days) == (0, True, 3)


def test_a_range_reads_its_days(spark, days):
    plan = daily.read(spark, days[0], "logged_at", Range(3 * DAY, 5 * DAY))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(logged_at" in plan
    assert daily.read(spark, days[0], "logged_at", Range(3 * DAY, 5 * DAY)).count() == 12


def test_what_was_wrong(spark):
    one = lambda column, **v: spark.range(1).withColumns({k: F.lit(x) for k, x in v.items()}).select(column.alias("x")).first()["x"]
    for text in ("1_000", " 1000", "1000 ", "١٠٠٠", "1e3x", "0x10", "inf"):
        assert one(A.equals(F.col("v"), text), v="1000") is False
    assert one(A.equals(F.col("v"), "+1000"), v="1000") and one(A.equals(F.col("v"), "1e3"), v="1000") and one(A.equals(F.col("v"), ".5"), v="0.5")
    texts = {"SELECT prefix'ab'": "SELECT prefix?", "tabelle_ä1 = 3": "tabelle_ä1 = ?", 'a = 1 AND "open 2': 'a = ? AND "open 2', "x'0f' = max'y'": "? = max?", "`b 1": None, "ñ2": None}
    assert {t: one(T.sanitize_sql(F.col("v")), v=t) for t in texts} == texts
    with pytest.raises(ValueError, match="double quote"):
        catalog.values(spark.range(1), 'a"b')
    huge = spark.createDataFrame([("s", "n", 0, 2**62, 1, k) for k in range(4)], "service string, name string, started_at long, duration_ns long, status int, row_id long")
    found = spans.group_steps(huge, {"service": F.col("service")}, Range(0, MINUTE), MINUTE, 5).first()
    assert (found["n"], found["total_ns"]) == (4, 2**63 - 1)


def test_distinct_values_merge(spark):
    """Lists while short, sketches beyond; merged days equal the whole."""
    rows = [(d, "few", f"v{(d + k) % 40}") for d in range(4) for k in range(30)] + [(d, "some", f"v{30 * d + k}") for d in range(4) for k in range(30)] + [(d, "many", f"v{(d * 500 + k) % 3000}") for d in range(4) for k in range(2000)] + [(0, "none", None)]
    values = spark.createDataFrame(rows, "day int, key string, value string")
    cells = distinct.value_cells(values, ["day", "key"])
    assert {(r["day"], r["key"]): r["exact"] for r in cells.collect()} == {(d, k): k != "many" for d in range(4) for k in ("few", "some", "many")}
    found = {r["key"]: r for r in distinct.merged_cells(cells, ["key"]).withColumn("values", distinct.n_values()).collect()}
    assert (found["few"]["exact"], found["few"]["values"], found["few"]["n"]) == (True, 33, 120)
    assert not found["some"]["exact"] and found["some"]["n"] == 120 and abs(found["some"]["values"] - 120) <= 3
    assert abs(found["many"]["values"] / 3000 - 1) < 0.05 and found["many"]["n"] == 8000
    top = distinct.first_values(values.filter("key = 'few'"), limit=5).collect()
    assert len(top) == 5 and all(r["has_more"] for r in top) and not distinct.first_values(values.filter("key = 'few'")).first()["has_more"]


def test_days_are_dropped_with_what_they_refer_to(spark, tmp_path):
    facts, sets = str(tmp_path / "facts"), str(tmp_path / "keys")
    rows = spark.createDataFrame([(d * DAY, k) for d, ks in enumerate(("abc", "bd", "ce", "e")) for k in ks] + [(0, None)], "at long, k string")
    daily.write(rows, "at", facts)
    retention.key_sets(rows, "at", F.col("k"), sets)
    retention.key_sets(rows.filter(F.col("at") == 0), "at", F.col("k"), sets)  # a repeated day replaces itself
    first = date(1970, 1, 3)
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "facts").glob("day=1970-01-0[34]/*.parquet")}
    assert sorted(r["key"] for r in retention.orphans(spark, sets, first).collect()) == ["a", "b", "d"]
    assert retention.drop_days(spark, first, facts, sets) == 4 and retention.drop_days(spark, first, facts, sets) == 0
    assert {str(p): p.stat().st_mtime_ns for p in (tmp_path / "facts").glob("day=*/*.parquet")} == before
    assert daily.read(spark, facts, "at").count() == 3 and retention.orphans(spark, sets, first).count() == 0
