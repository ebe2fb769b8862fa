import random
import time
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from lumenspan.functions import attributes as A
from lumenspan.functions import texts as T
from lumenspan.operators import catalog, metrics, sketch, spans, steps, traces
from lumenspan.operators import spans as span_ops
from lumenspan.plans import ranges
from lumenspan.sources import daily


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("order 81 shipped 3.25 kg after 17h", "order <num> shipped <num> kg after <num>h"),
        ("PUT /carts/9/items/44: 201", "PUT /carts/<num>/items/<num>: <num>"),
        ("ipv6 host9 b_12c", "ipv6 host9 b_12c"),
        ("job 0a1b2c3d-1111-2222-3333-abcdefabcdef done", "job <uuid> done"),
        ("block c0ffee1234 at 0xbeef", "block <hex> at <hex>"),
        ("facade decade", "facade decade"),
        (r"""key 'o\'clock' maps to "a \"b\" c".""", """key '<str>' maps to "<str>"."""),
        ("isn't it", "isn't it"),
        ("a 'lone quote", "a 'lone quote"),
        ("größe 5µ", "größe <num>µ"),
        ("12_3 and 4.5.6", "<num>_3 and <num>.<num>"),
        ("0X1F is no hex", "<num>X1F is no hex"),
        ("""'it "x' y" 8""", """'<str>' y" <num>"""),
    ],
)
def test_templates(spark, text, want):
    assert one(spark, T.template(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("UPDATE stock SET note = 'it''s low', left = 12 WHERE price > 1.5E+2", "UPDATE stock SET note = ?, left = ? WHERE price > ?"),
        ("DELETE FROM files WHERE sum = x'00FF' AND mask = 0xAB", "DELETE FROM files WHERE sum = ? AND mask = ?"),
        ("SELECT 1 FROM cars WHERE color IN ('red', 'blue') AND year IN (1999 , 2001,2003)", "SELECT ? FROM cars WHERE color IN (?) AND year IN (?)"),
        ("INSERT INTO seats (r, c) VALUES (4, 'a') , (5, 'b')", "INSERT INTO seats (r, c) VALUES (?)"),
        ("SELECT name FROM clubs WHERE id = $2 AND city = :city AND tag = @t1", None),
        ("SELECT t1.a, t2.b2 FROM t1, t2", None),
        ("SELECT k FROM m WHERE a = $1 AND b = 'x'", "SELECT k FROM m WHERE a = $1 AND b = ?"),
        ('SELECT "col 7", `odd 8` FROM m WHERE z = 9 -- line 10', 'SELECT "col 7", `odd 8` FROM m WHERE z = ? -- line 10'),
    ],
)
def test_sql_texts(spark, text, want):
    assert one(spark, T.sanitize_sql(F.col("t")), t=text) == want


def test_sql_systems(spark):
    found = {x: one(spark, T.is_sql_system(F.col("t")), t=x) for x in ("postgresql", "mssql", "mongodb", "redis")}
    assert found == {"postgresql": True, "mssql": True, "mongodb": False, "redis": False}


def test_numbers_are_exact_or_doubles(spark):
    v = F.col("v")
    is_ = lambda value, condition: one(spark, condition, v=value)
    assert is_("1e-12", A.equals(v, 0)) is False and is_("1e-10", A.equals(v, 2e-10)) is False and is_("1e-10", A.equals(v, 1e-10)) is True
    assert is_("1e30", A.compares(v, ">", 5)) is True and is_("-1e300", A.compares(v, "<", 0)) is True and is_("7.0", A.equals(v, 7)) is True
    assert is_("123456789012345678901", A.compares(v, ">", 123456789012345678900)) is True and is_("0.1", A.compares(v, ">=", 0.1)) is True
    with pytest.raises(ValueError, match="double quote"):
        A.value("attributes", 'a"b')


def test_values_of_mixed_types(spark):
    v = F.col("v")
    is_ = lambda value, condition: one(spark, condition, v=value)
    assert is_("7", A.equals(v, "7")) and is_('"7"', A.equals(v, 7)) and is_("true", A.equals(v, 1)) and is_("1", A.equals(v, True))
    assert is_("7", A.equals(v, 8)) is False and is_("null", A.equals(v, 8)) is None and is_("null", A.differs(v, 8)) is True
    assert is_('"3"', A.compares(v, ">", 5)) and not is_('"3"', A.compares(v, "<", 5)) and is_("3", A.compares(v, "<", "x"))
    assert is_("9007199254740993", A.equals(v, 9007199254740992)) is False
    assert is_('"caf\\u00e9 \\"x\\""', A.text_of(v)) == 'café "x"'
    assert [is_(t, A.json_type(v)) for t in ("1", "1.0", '"a"', "true", "null", "[1]", "{}")] == ["int", "float", "string", "bool", "null", "array", "object"]


def test_full_text(spark):
    t = F.col("t")
    has = lambda text, words: one(spark, A.matches_text(t, words), t=text)
    assert has("User signed in", "signed IN") and has("failed payment", "payment failed") and not has("failed payment", "payment-failed")
    assert has("Žluťoučký kůň", "zlutoucky") and not has("signed", "sig") and not has("user", "!!!") and has("user", "user !!!") and has("x", " ")


def test_sketch_is_within_one_percent(spark):
    found = sketch.quantiles(spark.range(1, 1001).select((F.col("id") * 1_000_000).alias("duration_ns")), []).first()
    assert [abs(found[p] / w - 1) < 0.01 for p, w in (("p50", 500e6), ("p95", 950e6), ("p99", 990e6))] == [True] * 3
    powers = spark.range(62).select("id", sketch.bucket(F.expr("shiftleft(1L, CAST(id AS INT))")).alias("b"))
    assert [r["b"] for r in powers.orderBy("id").collect()] == [64 * k for k in range(62)]
    assert one(spark, sketch.bucket(F.col("d")), d=0) == -1


def test_counter_restarts(spark):
    """A base, a rise by 7, a standstill, a restart that reached 3, a rise by 8; then a step that starts from the one before."""
    sec = 1_000_000_000
    rows = [("s", t * sec, v) for t, v in ((2, 40), (9, 47), (20, 47), (31, 3), (50, 11), (64, 12))]
    found = metrics.increases(spark.createDataFrame(rows, "series string, recorded_at long, value long"), ["series"], 60 * sec).orderBy("step_at").collect()
    assert [(r["increase"], r["elapsed_ns"]) for r in found] == [(18, 48 * sec), (1, 14 * sec)]


HISTOGRAMS = "series string, recorded_at long, step_at long, bounds array<double>, counts array<long>, sum double, low double, high double"


def brute_fold(points, cumulative):
    """Point by point in order of time."""
    out, before = {}, {}
    for s, _, step, bounds, counts, total, low, high in sorted(points, key=lambda p: (p[0], p[1])):
        last, before[s] = before.get(s), (bounds, counts, total)
        if cumulative:
            low = high = None
            if last is None:
                continue
            if last[0] == bounds and all(a >= b for a, b in zip(counts, last[1], strict=True)):
                counts, total = [a - b for a, b in zip(counts, last[1], strict=True)], total - last[2]
        held = out.get((s, step))
        if held is None or held[0] != bounds:
            out[s, step] = (bounds, counts, total, low, high)
        else:
            both = lambda f, a, b: None if a is None or b is None else f(a, b)
            out[s, step] = (bounds, [a + b for a, b in zip(held[1], counts, strict=True)], held[2] + total, both(min, held[3], low), both(max, held[4], high))
    return out


@pytest.mark.parametrize("cumulative", [True, False])
def test_histograms_are_folded_in_order(spark, cumulative):
    rng = random.Random(9)
    points = []
    for s in ("a", "b"):
        bounds, counts = [1.0, 4.0], [0, 0, 0]
        for t in range(60):
            if rng.random() < 0.2:
                bounds = rng.choice([[1.0, 4.0], [2.0], [1.0, 4.0, 9.0]])
                counts = [0] * (len(bounds) + 1)
            counts = [rng.randrange(3) for _ in counts] if not cumulative or rng.random() < 0.15 else [n + rng.randrange(3) for n in counts]
            gap = rng.random() < 0.2
            points.append((s, t, t // 7, bounds, list(counts), float(sum(counts)), None if gap else float(t % 5), None if gap else float(t)))
    found = metrics.fold_histograms(spark.createDataFrame(points, HISTOGRAMS).repartition(3), ["series"], cumulative, block=10)
    assert {(r["series"], r["step_at"]): (r["bounds"], r["counts"], r["sum"], r["low"], r["high"]) for r in found.collect()} == brute_fold(points, cumulative)


def brute_exponential(points, cumulative):
    def cells(scale, zeros, positive, negative):
        own = Counter({("zero", 0): zeros})
        for sign, (offset, counts) in (("positive", positive), ("negative", negative)):
            own.update({(sign, offset + k): n for k, n in enumerate(counts)})
        return scale, Counter({k: n for k, n in own.items() if n})

    def at(scale, old, own):
        out = Counter()
        for (sign, index), n in own.items():
            out[sign, index >> (old - scale)] += n
        return out

    out, before = {}, {}
    for s, _, step, *point in sorted(points, key=lambda p: (p[0], p[1])):
        scale, own = cells(*point)
        last, before[s] = before.get(s), (scale, own)
        if cumulative:
            if last is None:
                continue
            least = min(scale, last[0])
            now, then = at(least, scale, own), at(least, *last)
            if all(now[k] >= n for k, n in then.items()):
                scale, own = least, now - then
        held = out.get((s, step))
        if held is None:
            out[s, step] = (scale, own)
        else:
            least = min(scale, held[0])
            out[s, step] = (least, at(least, *held) + at(least, scale, own))
    return {(s, step, scale, *k, n) for (s, step), (scale, own) in out.items() for k, n in own.items()}


@pytest.mark.parametrize("cumulative", [True, False])
def test_exponential_histograms_are_folded(spark, cumulative):
    rng = random.Random(5)
    points = []
    for s in ("a", "b"):
        positive, negative, zeros, scale = [-3, [0] * 9], [2, [0] * 4], 0, 3
        for t in range(50):
            if rng.random() < 0.15:
                positive, negative, zeros, scale = [rng.randrange(-9, 5), [0] * rng.randrange(9)], [rng.randrange(-5, 5), [0] * rng.randrange(4)], 0, rng.randrange(5)
            grow = lambda counts: [(n if cumulative else 0) + rng.randrange(3) for n in counts]
            positive, negative, zeros = [positive[0], grow(positive[1])], [negative[0], grow(negative[1])], (zeros if cumulative else 0) + rng.randrange(2)
            points.append((s, t, t // 6, scale, zeros, tuple(positive), tuple(negative)))
    fields = "series string, recorded_at long, step_at long, scale int, zeros long, positive struct<offset:int,counts:array<long>>, negative struct<offset:int,counts:array<long>>"
    found = metrics.fold_exponential(spark.createDataFrame(points, fields).repartition(3), ["series"], cumulative, block=10)
    assert {(r["series"], r["step_at"], r["scale"], r["sign"], r["index"], r["n"]) for r in found.collect()} == brute_exponential(points, cumulative)


def test_percentiles_of_histograms(spark):
    counts = F.array(*[F.lit(x).cast("long") for x in (0, 6, 2)])
    assert one(spark, metrics.percentile(counts, [3.0, 9.0], 0.25)) == 5.0 and one(spark, metrics.percentile(counts, [3.0, 9.0], 0.9)) == 9.0
    assert one(spark, metrics.percentile(F.array(*[F.lit(0).cast("long")] * 3), [3.0, 9.0], 0.5)) is None


def test_large_traces_have_the_trees_of_small_ones(spark):
    rng = random.Random(11)
    rows = [("deep", f"{k}", f"{k - 1}" if k else None, k, k) for k in range(70)] + [("wide", f"{k}", "0" if k else "0", 5, k) for k in range(40)]
    for t in range(12):
        n = rng.randrange(1, 25)
        rows += [(f"t{t}", str(rng.randrange(n)), rng.choice([None, "gone", *map(str, range(n))]), rng.randrange(9), k) for k in range(n)]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, started_at long, row_id long").repartition(3)
    whole, spread = (sorted(map(tuple, span_ops.trace_trees(spans, per_trace=n).collect())) for n in (10**6, 20))
    assert whole == spread == sorted(map(tuple, traces.large_trace_trees(spans).collect()))


def test_bucket_arrays(spark):
    longs = lambda *xs: F.array(*[F.lit(x).cast("long") for x in xs])
    assert one(spark, metrics.subtract_counts(longs(5, 7), longs(2, 7))) == [3, 0]
    assert one(spark, metrics.subtract_counts(longs(5, 1), longs(2, 7))) is None and one(spark, metrics.subtract_counts(longs(5), longs(2, 7))) is None
    found = one(spark, metrics.explicit_bounds(F.lit(-1), longs(1, 2, 3), F.lit(0)))
    assert (found["bounds"], found["counts"]) == ([1.0, 2.0, 4.0], [1, 2, 3])
    joined = one(spark, metrics.explicit_bounds(F.lit(-1), longs(1, 2, 3, 4), F.lit(0), most=2))
    assert (joined["bounds"], joined["counts"]) == ([1.0, 16.0], [1, 9])
    wide = one(spark, metrics.explicit_bounds(F.lit(-100), longs(*range(1, 201)), F.lit(3)))
    assert len(wide["counts"]) <= 64 and sum(wide["counts"]) == sum(range(1, 201)) and wide["bounds"] == sorted(wide["bounds"])
    powers = spark.range(1, 40).select("id", metrics.exponential_index(F.pow(F.lit(2.0), F.col("id")), 5).alias("i")).collect()
    assert all(r["i"] == r["id"] * 32 - 1 for r in powers)


def test_completion_finds_rare_values(spark):
    rows = [(k, {"x": f'"v{k % 600}"'}) for k in range(6_000)] + [(9_999, {"x": '"zz1"'}), (1, {"y": "3"})]
    table = spark.createDataFrame(rows, "row_id long, attributes map<string,string>")
    found = catalog.suggestions(table, F.lit(True), [F.desc("row_id")], "x", "ZZ").collect()
    assert [(r["value"], r["n"]) for r in found] == [('"zz1"', 1)]
    about = catalog.help_on(table, "y").first()
    assert (about["type"], about["n_values"], about["common"]) == ("int", 1, ["3"]) and catalog.help_on(table, "none").first()["type"] is None


def test_pages_cursors_and_table_order(spark):
    rows = spark.createDataFrame([(k, None if k % 3 == 0 else k % 5) for k in range(20)], "id int, v int")
    first = steps.page(rows, [F.asc("id")], 7).collect()
    assert [r["id"] for r in first] == list(range(7)) and all(r["truncated"] for r in first)
    assert not any(r["truncated"] for r in steps.page(rows, [F.asc("id")], 20).collect())
    order = [("v", True), ("id", False)]
    whole = [(r["v"], r["id"]) for r in rows.filter("v is not null").orderBy(F.desc("v"), "id").collect()]
    rest = rows.filter(steps.after(order, list(whole[4]))).orderBy(F.desc("v"), "id").collect()
    assert [(r["v"], r["id"]) for r in rest] == whole[5:]
    with pytest.raises(ValueError, match="cursor"):
        steps.after(order, [1])
    for descending in (True, False):
        assert [r["v"] for r in rows.orderBy(steps.table_order("v", descending)).collect()][-7:] == [None] * 7


def test_range_texts():
    now, day = 1_700_000_000 * ranges.SECOND, ranges.DAY
    assert ranges.parse_time("1970-01-02T00:00:00.25+01:00", now) == 23 * ranges.HOUR + ranges.SECOND // 4
    assert ranges.parse_time("1h30m", now) == now - 90 * ranges.MINUTE and ranges.parse_duration("2d") == 2 * day and ranges.parse_duration("1.5s") == 3 * ranges.SECOND // 2
    for bad in ("-1h", "soon", "1x", "5"):
        with pytest.raises(ValueError):
            ranges.parse_time(bad, now)
    assert ranges.resolve(None, None, now, [now - 9 * day]) == ranges.Range(now - ranges.HOUR, now)
    assert ranges.resolve("20d", None, now, [now - 9 * day, now - 7 * day]).start == now - 7 * day and ranges.resolve(None, "1d", now, [now - 9 * day], whole=True) == ranges.Range(now - 9 * day, now - day)
    with pytest.raises(ValueError, match="before the oldest"):
        ranges.resolve("3d", "2d", now, [now - day])
    with pytest.raises(ValueError, match="since"):
        ranges.resolve("1d", "2d", now, [0])


def test_days_that_a_range_does_not_touch_are_not_read(spark, tmp_path):
    rows = spark.range(0, 300).select((F.col("id") * 3_600_000_000_000).alias("at"), "id")
    daily.write(rows, "at", str(tmp_path / "t"))
    r = ranges.Range(2 * ranges.DAY + 5, 4 * ranges.DAY)
    found = daily.read(spark, str(tmp_path / "t"), "at", r)
    assert sorted(x["id"] for x in found.collect()) == list(range(49, 96)) and daily.read(spark, str(tmp_path / "t"), "at").count() == 300
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(at), GreaterThanOrEqual(at" in plan


def test_identity_of_a_series_ignores_the_order_of_attributes(spark):
    rows = spark.createDataFrame([({"a": "1", "b": "2"}, {}), ({"b": "2", "a": "1"}, {}), ({"a": "1"}, {})], "attributes map<string,string>, resource map<string,string>")
    found = [r[0] for r in rows.withColumns({k: F.lit(k) for k in ("service", "name", "unit", "kind")}).select(daily.series_identity("service", "name", "unit", "kind", "attributes", "resource")).collect()]
    assert found[0] == found[1] != found[2]


def test_steps_floor_before_the_epoch(spark):
    minute = 60_000_000_000
    assert one(spark, steps.step_of(F.col("t"), minute), t=-1) == -minute
    assert one(spark, steps.step_of(F.col("t"), minute), t=1704067199999999999) == 1704067140000000000
    assert str(one(spark, steps.day_of(F.col("t")), t=-1)) == "1969-12-31"


def test_trees_with_orphans_and_cycles(spark):
    rows = [("t", "a", None, 0, 1), ("t", "b", "a", 1, 2), ("t", "c", "b", 2, 3), ("t", "d", "a", 3, 4), ("t", "o", "zz", 4, 5), ("t", "x", "y", 5, 6), ("t", "y", "x", 6, 7)]
    found = spans.trace_trees(spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, started_at long, row_id long"))
    assert [(r["span_id"], r["depth"]) for r in found.orderBy("place").collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", 1), ("o", 0), ("x", 0), ("y", 1)]


def test_ranges():
    r = ranges.Range(0, 7 * ranges.HOUR)
    assert ranges.default_step(r) == 300 * ranges.SECOND and ranges.resolution(r) == "1m" and ranges.resolution(ranges.Range(0, 15 * ranges.DAY)) == "1h"
    assert ranges.summary_step(90 * ranges.SECOND, "1m") == 120 * ranges.SECOND
    for a, z in ((5, 3 * ranges.HOUR + 7), (ranges.HOUR, 2 * ranges.HOUR), (3, 9), (ranges.MINUTE - 1, 2 * ranges.MINUTE + 1)):
        cut = sorted((p.start, p.end) for ps in ranges.parts(ranges.Range(a, z)).values() for p in ps if p.start < p.end)
        assert cut[0][0] == a and cut[-1][1] == z and all(x[1] == y[0] for x, y in zip(cut, cut[1:], strict=False))
    with pytest.raises(ValueError, match="start before"):
        ranges.Range(1, 1)
    with pytest.raises(ValueError, match="limit"):
        ranges.page_limit("logs", 1_001)


def test_shallow_traces_take_few_rounds(spark, monkeypatch):
    rows = [("t", 0, "r", None, 0)] + [("t", k, f"s{k}", "r", k) for k in range(1, 400)] + [("t", 400, "leaf", "s7", 7)]
    written, whole = [], traces._written
    monkeypatch.setattr(traces, "_written", lambda df: written.append(df) or whole(df))
    found = traces.large_trace_trees(spark.createDataFrame(rows, "trace_id string, row_id long, span_id string, parent_span_id string, started_at long"))
    told = {r["span_id"]: (r["place"], r["depth"], r["children"], r["offset_ns"]) for r in found.collect()}
    assert (told["r"], told["s7"], told["leaf"], told["s8"]) == ((0, 0, 399, 0), (7, 1, 1, 7), (8, 2, 0, 7), (9, 1, 0, 8))
    assert len(told) == 401 and len(written) < 10


def test_large_traces_let_go_of_what_their_steps_shuffled_and_wrote(spark, monkeypatch):
    disk, written, whole = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), [], traces._written
    shuffled = lambda: {b for b in disk.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_") and b.endswith(".data")}
    monkeypatch.setattr(traces, "_written", lambda df: written.append(whole(df)) or written[-1])
    rows = [("t", k, f"s{k}", f"s{k // 3}" if k else None, -k) for k in range(300)] + [("c", k, s, up, at) for k, (s, up, at) in enumerate([("x", "y", 5), ("y", "x", 6), ("z", "x", 3), ("v", "x", 8), ("w", "x", 7), ("u", "z", 9), ("x", "u", 9)])]
    spans = spark.createDataFrame(rows, "trace_id string, row_id long, span_id string, parent_span_id string, started_at long").repartition(3)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled(), spark.conf.get(cleanup, "false")
    found = traces.large_trace_trees(spans)
    until = time.time() + 20
    while shuffled() - before and time.time() < until:  # removed in the background
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(cleanup, "false") == setting
    assert {f for table in written for f in table.inputFiles() if Path(urlparse(f).path).exists()} == set(found.inputFiles())
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, span_ops.trace_trees(spans).collect()))
