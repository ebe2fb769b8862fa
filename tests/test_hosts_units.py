from pyspark.sql import functions as F

from lumenspan.functions import units
from lumenspan.operators import hosts, rollups


def test_cpu_shares(spark):
    rows = [("h", m, t, v) for t, user, idle in ((1, 10, 90), (2, 40, 160)) for m, v in (("user", user), ("idle", idle))]
    found = hosts.cpu_shares(spark.createDataFrame(rows, "host string, mode string, at long, ticks long")).collect()
    assert {r["mode"]: r["share"] for r in found} == {"user": 0.3, "idle": 0.7}


def test_file_systems_count_once(spark):
    rows = [("h", "sda", "/mnt/long"), ("h", "sda", "/"), ("h", "sdb", "/b")]
    assert sorted(r["mount"] for r in hosts.file_systems(spark.createDataFrame(rows, "host string, device string, mount string")).collect()) == ["/", "/b"]


def test_unit_time_never_falls(spark):
    rows = [("h", "u", "p", 1, 10), ("h", "u", "q", 1, 5), ("h", "u", "p", 2, 12), ("h", "u", "p", 3, 13), ("h", "u", "r", 3, 4)]
    found = hosts.unit_times(spark.createDataFrame(rows, "host string, unit string, process string, at long, cpu_ns long")).orderBy("at").collect()
    assert [r["cpu_ns"] for r in found] == [15, 17, 22]


def test_units(spark):
    value = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert value(units.scaled(F.lit(3), "ms")[0]) == 3_000_000 and units.scaled(F.lit(1), "%")[1] == "ratio" and units.scaled(F.lit(1), "{req}")[1] == "count"
    assert [value(units.duration_text(F.lit(x))) for x in (12, 1_500, 90_000_000_000)] == ["12ns", "1.5us", "1.5min"]
    assert value(units.count_text(F.lit(2_500_000))) == "2.5M" and value(units.bytes_text(F.lit(2048))) == "2.0 KiB"


def test_series_guard_and_latest_write(spark):
    rows = [("m", f"s{k}", k, k) for k in range(5)] + [("m", "s0", 0, 9)]
    points = spark.createDataFrame(rows, "metric string, series string, recorded_at long, value long")
    kept, over = rollups.first_series(points, "metric", "series", 2)
    assert {r["series"] for r in kept.collect()} == {"s0", "s1"} and over.count() == 3
    assert rollups.latest_write(points, ["series", "recorded_at"], F.col("value")).filter("series = 's0'").first()["value"] == 9
