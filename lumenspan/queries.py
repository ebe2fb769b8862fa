"""The registered telemetry queries, by inventory number, over whole tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import attributes as A
from .functions import texts as T
from .operators import catalog, distinct, logs, metrics, newest, retention, rollup_job, rollups, spans, steps, traces
from .plans.ranges import DAY, HOUR, MINUTE, Range
from .sources import daily, stored
from .sources import signals as S
from .streaming import series
from .streaming.deltas import Deltas

JAN = 1_704_067_200_000_000_000  # 2024-01-01 in nanoseconds
WEEK = Range(JAN + 7 * DAY + 12_345_678_901, JAN + 14 * DAY + 3_000_000_007)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# The signals in DuckDB: attributes as columns of JSON texts instead of a map.
LOGS = """
    logs AS (
        SELECT event_id AS row_id, epoch_us(ts) * 1000 AS logged_at, 'svc-' || (user_id % 5) AS service, user_id, event_type,
            CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 WHEN 'signup' THEN 9 WHEN 'click' THEN 5 WHEN 'view' THEN 1 ELSE 0 END AS severity,
            'user ' || user_id || ' ' || event_type || ' ' || CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) AS body,
            lpad(lower(to_hex(user_id * 100000 + epoch_us(ts) // 86400000000)), 32, '0') AS trace_id,
            CASE WHEN event_id % 7 = 0 THEN '"' || user_id || '"' ELSE user_id::VARCHAR END AS a_user, '"' || event_type || '"' AS a_type,
            CASE WHEN event_id % 11 <> 0 THEN json_extract_string(props, '$.k') END AS a_k, CASE WHEN event_type <> 'error' THEN 'true' ELSE 'false' END AS a_ok,
            '"host-' || (user_id % 3) || '"' AS host
        FROM events
    )"""
SPANS = """
    spans AS (
        SELECT lpad(lower(to_hex(o_orderkey)), 32, '0') AS trace_id, lpad(lower(to_hex(o_orderkey * 1000)), 16, '0') AS span_id, NULL::VARCHAR AS parent_span_id, o_orderpriority AS name, 2 AS kind,
            epoch_us(o_orderdate) * 1000 + (o_orderkey % 86400) * 1000000000 AS started_at, CAST(round(o_totalprice * 100) AS BIGINT) * 10000 AS duration_ns,
            CASE WHEN o_orderkey % 20 = 1 THEN 2 WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS status, 'svc-' || (o_custkey % 5) AS service,
            CASE WHEN o_custkey % 4 = 0 THEN '"POST"' ELSE '"GET"' END AS method, '"/r' || (o_custkey % 7) || '/{id}"' AS route, NULL::VARCHAR AS query, NULL::VARCHAR AS system, o_orderkey * 1000 AS row_id
        FROM orders
        UNION ALL
        SELECT lpad(lower(to_hex(l_orderkey)), 32, '0'), lpad(lower(to_hex(l_orderkey * 1000 + n)), 16, '0'), lpad(lower(to_hex(l_orderkey * 1000 + CASE WHEN l_orderkey % 50 = 0 THEN 999 WHEN n % 3 = 0 THEN n - 1 ELSE 0 END)), 16, '0'), 'ship ' || l_linestatus, 3,
            epoch_us(l_shipdate) * 1000 + n * 1000000, CAST(round(l_extendedprice * 100) AS BIGINT) * 10000, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END, 'svc-' || (l_suppkey % 5),
            NULL, NULL, '"' || CASE l_orderkey % 4 WHEN 0 THEN 'SELECT * FROM part WHERE id = ' || l_partkey || ' AND qty > ' || CAST(l_quantity AS INT) WHEN 1 THEN 'SELECT name FROM supplier WHERE note IN (''it''''s'', ''b'') AND id = ' || l_suppkey
                WHEN 2 THEN 'INSERT INTO shipped (id, mode) VALUES (' || l_partkey || ', ''air''), (' || l_suppkey || ', ''rail'')' ELSE 'SELECT * FROM part WHERE id = $1 -- 42' END || '"', CASE WHEN l_orderkey % 7 = 0 THEN '"mongodb"' ELSE '"postgresql"' END, l_orderkey * 1000 + n
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem)
    )"""
POINTS = """
    points AS (
        SELECT (user_id % 10) || '/' || event_type AS series, user_id % 10 AS shard, event_type AS type, epoch_us(ts) * 1000 AS recorded_at, CAST(round(value * 100) AS BIGINT) AS value FROM events
    )"""
COUNTER = POINTS + """, counter AS (
        SELECT series, shard, type, recorded_at, sum(value) OVER (PARTITION BY series, recorded_at // 86400000000000 ORDER BY recorded_at ROWS UNBOUNDED PRECEDING)::BIGINT AS value FROM points
    )"""


def query(oracle: str | None = None, cte: str = ""):
    """Register the function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"WITH {cte} {oracle}" if cte else oracle
        return f

    return put


def kept(df: DataFrame, conditions: dict) -> DataFrame:
    """Rows that each named condition keeps: one pass, a row for each condition and record."""
    flags = F.array(*[F.struct(F.lit(k).alias("filter"), F.coalesce(c, F.lit(False)).alias("keep")) for k, c in conditions.items()])
    return df.select("row_id", F.explode(F.filter(flags, lambda x: x["keep"])["filter"]).alias("filter"))


def kept_sql(table: str, conditions: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT row_id, '{k}' AS filter FROM {table} WHERE {c}" for k, c in conditions.items())


@query("SELECT row_id, logged_at, service, severity, body FROM logs WHERE service = 'svc-1' AND severity >= 13 ORDER BY logged_at DESC, row_id DESC LIMIT 100", LOGS)
def srt_1_lim_1_newest_logs(spark: SparkSession, sf: str) -> DataFrame:
    """service = svc-1 level >= warn, newest first."""
    condition = (F.col("service") == "svc-1") & A.level(F.col("severity"), ">=", "warn")
    return logs.newest(S.logs(spark, sf), condition, 100).select("row_id", "logged_at", "service", "severity", "body")


@query("SELECT row_id, logged_at FROM (SELECT *, row_number() OVER (ORDER BY logged_at DESC, row_id DESC) AS n FROM logs) WHERE n BETWEEN 101 AND 200", LOGS)
def lim_2_next_page(spark: SparkSession, sf: str) -> DataFrame:
    """The page after the first 100 lines, by keyset."""
    rows = S.logs(spark, sf)
    last = logs.newest(rows, F.lit(True), 100).agg(F.min(F.struct("logged_at", "row_id")).alias("x")).first()["x"]
    return logs.newest(rows, F.lit(True), 100, (last["logged_at"], last["row_id"])).select("row_id", "logged_at")


@query(
    kept_sql("logs", {
        "flt_7_int": "user_id = 42", "flt_7_text": "user_id = 42", "flt_7_bool": "a_ok = 'true'", "flt_8_ne": "user_id <> 42 OR user_id IS NULL", "flt_8_ne_missing": "a_k IS NULL OR a_k <> '7'",
        "flt_9_gt": "event_id_string OR user_id > 100", "flt_9_lt": "NOT event_id_string AND user_id < 10", "flt_9_text": "NOT event_id_string OR user_id::VARCHAR < '5'", "flt_10_in": "user_id IN (1, 2, 3)",
        "flt_11_contains": "contains(user_id::VARCHAR, '4')", "flt_12_has": "a_k IS NOT NULL", "flt_12_has_not": "a_k IS NULL", "flt_13_resource": "host = '\"host-1\"'",
        "flt_5_or": "user_id = 42 OR a_k = '7'", "flt_6_not": "NOT coalesce(a_k = '7' OR user_id = 42, FALSE)", "flt_14_service": "service <> 'svc-1'", "flt_15_service_part": "contains(service, '-3')",
        "flt_17_warn": "severity BETWEEN 13 AND 16", "flt_17_not": "NOT severity BETWEEN 13 AND 16", "flt_17_below": "severity < 9", "flt_17_most": "severity <= 12", "flt_17_number": "severity = 5", "flt_18_trace": "trace_id = lpad(lower(to_hex(800000 + 19723)), 32, '0')",
    }).replace("FROM logs", "FROM flagged"), LOGS + ", flagged AS (SELECT *, row_id % 7 = 0 AS event_id_string FROM logs)",
)
def flt_5_to_18_log_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Predicates over attributes, resources and the fixed fields of logs."""
    user, k, ok = A.value("attributes", "user.id"), A.value("attributes", "k"), A.value("attributes", "ok")
    severity, service = F.col("severity"), F.col("service")
    both = A.equals(k, 7) | A.equals(user, 42)
    return kept(S.logs(spark, sf), {
        "flt_7_int": A.equals(user, 42), "flt_7_text": A.equals(user, "42"), "flt_7_bool": A.equals(ok, True), "flt_8_ne": A.differs(user, 42), "flt_8_ne_missing": A.differs(k, 7),
        "flt_9_gt": A.compares(user, ">", 100), "flt_9_lt": A.compares(user, "<", 10), "flt_9_text": A.compares(user, "<", "5"), "flt_10_in": A.is_in(user, [1, "2", 3]),
        "flt_11_contains": A.contains(user, "4"), "flt_12_has": A.has("attributes", "k"), "flt_12_has_not": A.keep_unless(A.has("attributes", "k")), "flt_13_resource": A.equals(A.value("resource", "host.name"), "host-1"),
        "flt_5_or": both, "flt_6_not": A.keep_unless(both), "flt_14_service": service != "svc-1", "flt_15_service_part": F.contains(service, F.lit("-3")),
        "flt_17_warn": A.level(severity, "=", "warning"), "flt_17_not": A.level(severity, "!=", "warn"), "flt_17_below": A.level(severity, "<", "info"), "flt_17_most": A.level(severity, "<=", "info"), "flt_17_number": A.level(severity, "=", 5),
        "flt_18_trace": F.col("trace_id") == S.hex_id(F.lit(800000 + 19723), 32),
    })


@query(
    kept_sql("numbers", {"zero": "k = 0 AND x = 0", "above_5": "k > 0", "small": "k = 0 AND x > 5e-11", "not_small": "NOT (k = 0 AND x > 5e-11)", "huge": "k = 1", "exact": "event_id = 50", "below_exact": "k = 0 OR (k = 2 AND event_id < 50)"}),
    "numbers AS (SELECT event_id AS row_id, event_id, event_id % 3 AS k, value * 1e-12 AS x FROM events)",
)
def flt_7_flt_9_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers near zero, beyond any decimal, and whole ones that doubles can't tell apart."""
    k, v = F.col("event_id") % 3, F.col("v")
    text = F.when(k == 0, (F.col("value") * 1e-12).cast("string")).when(k == 1, "1e30").otherwise((F.col("event_id") + 9_007_199_254_740_992).cast("string"))
    return kept(S.table(spark, sf, "events").select(F.col("event_id").alias("row_id"), text.alias("v")), {
        "zero": A.equals(v, 0), "above_5": A.compares(v, ">", 5), "small": A.compares(v, ">", 5e-11) & ~A.compares(v, ">", 1), "not_small": A.keep_unless(A.compares(v, ">", 5e-11) & ~A.compares(v, ">", 1)), "huge": A.equals(v, "1e30"),
        "exact": A.equals(v, 9_007_199_254_741_042), "below_exact": A.compares(v, "<", 9_007_199_254_741_042),
    })


@query(
    kept_sql("docs", {"one": "contains(line, ' the ')", "order_free": "contains(line, ' of ') AND contains(line, ' the ')", "phrase": "contains(line, ' of the ')", "marks": "contains(line, ' ete ') OR contains(line, ' a ')", "ignored": "contains(line, ' und ')"}),
    "docs AS (SELECT doc_id AS row_id, ' ' || trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS line FROM documents)",
)
def flt_16_full_text(spark: SparkSession, sf: str) -> DataFrame:
    """Words and phrases in texts, whatever the case and marks."""
    line = F.col("line")
    lines = S.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), A.tokens_line(F.col("text")).alias("line"))
    return kept(lines, {
        "one": A.matches_line(line, "THE"), "order_free": A.matches_line(line, "the of"), "phrase": A.matches_line(line, "of-the"), "marks": A.matches_line(line, "été") | A.matches_line(line, "à"), "ignored": A.matches_line(line, "!!! und"),
    })


@query(kept_sql("spans", {"flt_19_kind": "kind = 2", "flt_19_status": "status = 2", "flt_20_error": "status <> 2", "flt_20_root": "parent_span_id IS NULL", "flt_21_duration": "duration_ns >= 1500000000", "flt_21_below": "duration_ns < 100000000", "route": "route = '\"/r3/{id}\"' AND method = '\"GET\"'"}), SPANS)
def flt_19_to_21_span_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Kind, status, error, root and duration of spans."""
    status, duration = F.col("status"), F.col("duration_ns")
    return kept(S.spans(spark, sf), {
        "flt_19_kind": F.col("kind") == A.KINDS["server"], "flt_19_status": status == A.STATUSES["error"], "flt_20_error": status != 2, "flt_20_root": F.col("parent_span_id").isNull(), "flt_21_duration": duration >= 1_500_000_000, "flt_21_below": duration < 100_000_000,
        "route": A.equals(A.value("attributes", "http.route"), "/r3/{id}") & A.equals(A.value("attributes", "http.request.method"), "GET"),
    })


@query(
    f"""SELECT s.step_at, count(l.row_id) AS n FROM (SELECT unnest(range({WEEK.first_step(HOUR)}, {WEEK.end}, {HOUR})) AS step_at) s
    LEFT JOIN (SELECT * FROM logs WHERE logged_at >= {WEEK.start} AND logged_at < {WEEK.end}) l ON l.logged_at - l.logged_at % {HOUR} = s.step_at GROUP BY 1""", LOGS,
)
def agg_2_dat_1_log_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Logs of a week by hour, zero filled."""
    return logs.counts_by_step(S.logs(spark, sf), WEEK, HOUR)


@query("SELECT service, CASE WHEN severity >= 17 THEN 'error' WHEN severity >= 13 THEN 'warn' WHEN severity >= 9 THEN 'info' WHEN severity >= 5 THEN 'debug' WHEN severity >= 1 THEN 'trace' ELSE 'unspecified' END AS level, count(*) AS n FROM logs GROUP BY ALL ORDER BY n DESC, service NULLS FIRST, level NULLS FIRST LIMIT 20", LOGS)
def agg_3_log_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Logs by service and level, the 20 most frequent."""
    return logs.top_groups(S.logs(spark, sf), {"service": F.col("service"), "level": A.level_name(F.col("severity"))}, 20)


@query(
    f"""SELECT k.k, s.step_at, count(l.row_id) AS n FROM (SELECT a_k AS k FROM logs WHERE logged_at >= {WEEK.start} AND logged_at < {WEEK.end} GROUP BY 1 ORDER BY count(*) DESC, a_k NULLS FIRST LIMIT 5) k
    CROSS JOIN (SELECT unnest(range({WEEK.first_step(DAY)}, {WEEK.end}, {DAY})) AS step_at) s
    LEFT JOIN (SELECT * FROM logs WHERE logged_at >= {WEEK.start} AND logged_at < {WEEK.end}) l ON l.logged_at - l.logged_at % {DAY} = s.step_at AND l.a_k IS NOT DISTINCT FROM k.k GROUP BY ALL""", LOGS,
)
def agg_2_group_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The five most frequent values of an attribute, missing included, by day."""
    return logs.group_steps(S.logs(spark, sf), {"k": A.value("attributes", "k")}, WEEK, DAY, 5)


@query(f"SELECT service AS grp, logged_at - logged_at % {DAY} AS step_at, grouping(service) * 2 + grouping(logged_at - logged_at % {DAY}) AS grp_id, count(*) AS n FROM logs WHERE logged_at >= {WEEK.start} AND logged_at < {WEEK.end} GROUP BY GROUPING SETS ((), (logged_at - logged_at % {DAY}), (service), (service, logged_at - logged_at % {DAY}))", LOGS)
def agg_2_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Total, steps, groups and steps of groups in one pass."""
    return logs.everything(S.logs(spark, sf), F.col("service"), WEEK, DAY)


@query(
    """SELECT g.*, s.samples FROM (SELECT template, count(*) AS n, max(severity) AS severity, min(logged_at) AS first_at, max(logged_at) AS last_at, array_to_string(list_sort(list(DISTINCT service)), ',') AS services FROM lines GROUP BY template) g
    JOIN (SELECT template, string_agg(body, '|' ORDER BY seen_at DESC) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY seen_at DESC) AS place FROM (SELECT template, body, max((logged_at, row_id)) AS seen_at FROM lines GROUP BY ALL)) WHERE place <= 3 GROUP BY template) s USING (template)
    ORDER BY n DESC, last_at DESC, template LIMIT 50""",
    LOGS + ", lines AS (SELECT *, regexp_replace(body, '[0-9]+(\\.[0-9]+)?', '<num>', 'g') AS template FROM (SELECT * FROM logs ORDER BY logged_at DESC, row_id DESC LIMIT 50000))",
)
def agg_1_str_1_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Templates of the newest 50,000 lines, each with its newest samples."""
    found = logs.templates(S.logs(spark, sf))
    return found.select("template", "n", "severity", "first_at", "last_at", F.array_join("services", ",").alias("services"), F.array_join("samples", "|").alias("samples"))


SKETCH = """, cells AS (
        SELECT {keys}, bucket, count(*) AS n FROM (SELECT *, CASE WHEN duration_ns <= 0 THEN -1 ELSE (length(bin(duration_ns)) - 1) * 64 + CAST(ceil(log2(duration_ns / pow(2.0, length(bin(duration_ns)) - 1)) * 64) AS INT) END AS bucket FROM spans) GROUP BY ALL
    ), seen AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY {keys}) AS total FROM cells),
    quant AS (SELECT {keys}, {columns} FROM seen GROUP BY {keys})"""
_Q = ", ".join(f"CASE WHEN min(CASE WHEN seen > greatest(ceil({q} * total), 1) - 1 THEN bucket END) < 0 THEN 0 ELSE CAST(round(2.0 * pow(2.0, min(CASE WHEN seen > greatest(ceil({q} * total), 1) - 1 THEN bucket END) / 64.0) / (pow(2.0, 1.0 / 64) + 1.0)) AS BIGINT) END AS {p}" for p, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))


@query(
    "SELECT g.*, q.p50, q.p95, q.p99 FROM (SELECT service, name, count(*) AS n, count(*) FILTER (status = 2) AS errors, sum(duration_ns)::BIGINT AS total_ns, max_by(name, (started_at, row_id)) AS newest FROM spans GROUP BY ALL) g JOIN quant q ON q.service = g.service AND q.name = g.name ORDER BY total_ns DESC LIMIT 50",
    SPANS + SKETCH.format(keys="service, name", columns=_Q),
)
def agg_4_to_8_span_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Spans by service and name, ranked by time, with sketched percentiles."""
    keys = {"service": F.col("service"), "name": F.col("name")}
    return spans.ranked(spans.span_groups(S.spans(spark, sf), keys), list(keys))


@query("SELECT g.*, q.p50, q.p95, q.p99 FROM (SELECT route, count(*) AS n, count(*) FILTER (status = 2) AS errors, sum(duration_ns)::BIGINT AS total_ns, max_by(name, (started_at, row_id)) AS newest FROM spans GROUP BY ALL) g JOIN quant q ON q.route IS NOT DISTINCT FROM g.route", SPANS + SKETCH.format(keys="route", columns=_Q))
def agg_9_missing_is_a_group(spark: SparkSession, sf: str) -> DataFrame:
    """Spans by route, spans without one being a group of their own."""
    return spans.span_groups(S.spans(spark, sf), {"route": A.value("attributes", "http.route")})


@query("SELECT service, count(*) AS n, count(*) FILTER (status = 2) AS errors FROM spans GROUP BY 1 ORDER BY errors * 1.0 / n DESC, service LIMIT 3", SPANS)
def agg_5_error_rate_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Services by share of failed spans."""
    found = S.spans(spark, sf).groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == 2).alias("errors"))
    return spans.ranked(found, ["service"], "error_rate", 3)


@query(
    """SELECT s.service, coalesce(r.requests, 0) AS requests, coalesce(r.failed, 0) AS failed, s.n AS spans, coalesce(l.logs, 0) AS logs, coalesce(l.errors, 0) AS error_logs, q.p50, q.p95, q.p99 FROM (SELECT service, count(*) AS n FROM spans GROUP BY 1) s
    FULL JOIN (SELECT service, count(*) AS logs, count(*) FILTER (severity >= 17) AS errors FROM logs GROUP BY 1) l USING (service)
    LEFT JOIN (SELECT service, count(*) AS requests, count(*) FILTER (status = 2) AS failed FROM http GROUP BY 1) r USING (service) LEFT JOIN quant q USING (service)""",
    LOGS + "," + SPANS + ", http AS (SELECT * FROM spans WHERE kind = 2 AND method IS NOT NULL)" + SKETCH.format(keys="service", columns=_Q).replace("FROM spans", "FROM http"),
)
def agg_10_services(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with their percentiles, spans and logs of each service."""
    return spans.services(S.spans(spark, sf), S.logs(spark, sf))


@query(
    """SELECT row_number() OVER (ORDER BY coalesce(r.requests, 0) DESC, coalesce(l.logs, 0) DESC, service) AS place, service, coalesce(r.requests, 0) AS requests, coalesce(l.logs, 0) AS logs FROM (SELECT name AS service, count(*) AS n FROM spans GROUP BY 1) s
    FULL JOIN (SELECT service, count(*) AS logs FROM logs GROUP BY 1) l USING (service) LEFT JOIN (SELECT name AS service, count(*) AS requests FROM spans WHERE kind = 2 AND method IS NOT NULL GROUP BY 1) r USING (service)""", LOGS + "," + SPANS,
)
def agg_10_service_order(spark: SparkSession, sf: str) -> DataFrame:
    """Services in their order, many of which have no requests: most requests, then most logs, then by name."""
    found = spans.services(S.spans(spark, sf).withColumn("service", F.col("name")), S.logs(spark, sf))
    place = F.row_number().over(Window.orderBy(F.desc("requests"), F.desc("logs"), "service"))  # a row for each service
    return found.select(place.cast("long").alias("place"), "service", "requests", "logs")


YEAR_95 = Range(788_918_400 * 10**9, 820_454_400 * 10**9)


@query(
    f"""SELECT k.service, k.name, s.step_at, count(x.row_id) AS n, count(x.row_id) FILTER (x.status = 2) AS errors, coalesce(sum(x.duration_ns), 0)::BIGINT AS total_ns FROM (SELECT service, name FROM spans WHERE started_at >= {YEAR_95.start} AND started_at < {YEAR_95.end} GROUP BY ALL ORDER BY sum(duration_ns) DESC, service, name LIMIT 5) k
    CROSS JOIN (SELECT unnest(range({YEAR_95.first_step(10 * DAY)}, {YEAR_95.end}, {10 * DAY})) AS step_at) s
    LEFT JOIN (SELECT * FROM spans WHERE started_at >= {YEAR_95.start} AND started_at < {YEAR_95.end}) x ON x.started_at - x.started_at % {10 * DAY} = s.step_at AND x.service = k.service AND x.name = k.name GROUP BY ALL""", SPANS,
)
def agg_4_span_group_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The five groups with most time of a year, by ten days, zero filled."""
    return spans.group_steps(S.spans(spark, sf), {"service": F.col("service"), "name": F.col("name")}, YEAR_95, 10 * DAY, 5)


@query("SELECT name, count(*) AS n, max_by(coalesce(route, query), (started_at, row_id)) AS shown FROM spans GROUP BY 1", SPANS)
def agg_4_newest_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """What the newest span of each name was about."""
    shown = F.coalesce(A.value("attributes", "http.route"), A.value("attributes", "db.query.text"))
    return spans.span_groups(S.spans(spark, sf), {"name": F.col("name")}, {"shown": shown}).select("name", "n", "shown")


@query(
    f"""SELECT k.service, s.step_at, coalesce(c.requests, 0)::BIGINT AS requests, coalesce(c.failed, 0)::BIGINT AS failed, coalesce(c.logs, 0)::BIGINT AS logs, coalesce(c.error_logs, 0)::BIGINT AS error_logs FROM (SELECT DISTINCT service FROM cells) k
    CROSS JOIN (SELECT unnest(range({WEEK.first_step(DAY)}, {WEEK.end}, {DAY})) AS step_at) s LEFT JOIN cells c USING (service, step_at)""",
    LOGS + "," + SPANS + f""", cells AS (SELECT service, t - t % {DAY} AS step_at, sum(requests) AS requests, sum(failed) AS failed, sum(logs) AS logs, sum(error_logs) AS error_logs FROM (
        SELECT service, started_at AS t, (kind = 2 AND method IS NOT NULL)::INT AS requests, (kind = 2 AND method IS NOT NULL AND status = 2)::INT AS failed, 0 AS logs, 0 AS error_logs FROM spans
        UNION ALL SELECT service, logged_at, 0, 0, 1, (severity >= 17)::INT FROM logs) WHERE t >= {WEEK.start} AND t < {WEEK.end} GROUP BY ALL)""",
)
def agg_10_service_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Requests and logs of every service of a week by day, zero filled."""
    return spans.service_steps(S.spans(spark, sf), S.logs(spark, sf), WEEK, DAY)


@query(
    f"""SELECT r.trace_id, r.name, r.service, r.started_at, r.duration_ns, t.n_spans, t.failed FROM (SELECT * FROM spans WHERE parent_span_id IS NULL AND started_at >= 820454400000000000 AND trace_id IN (SELECT trace_id FROM spans WHERE status = 2) ORDER BY duration_ns DESC, started_at DESC, row_id DESC LIMIT 50) r
    JOIN (SELECT trace_id, count(*) AS n_spans, max(status = 2) AS failed FROM spans GROUP BY 1) t USING (trace_id)""", SPANS,
)
def jon_4_jon_9_agg_12_trace_list(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 longest traces with a failed span."""
    return spans.trace_list(S.spans(spark, sf), F.col("status") == 2, F.col("started_at") >= 820454400000000000, 50, "longest")


@query("SELECT trace_id, count(*) AS n_spans, count(*) FILTER (status = 2) AS errors, max(started_at + duration_ns) - min(started_at) AS length_ns, min(started_at) AS started_at FROM spans GROUP BY 1", SPANS)
def cli_2_trace_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return spans.trace_summaries(S.spans(spark, sf))


@query(
    """tree AS (
        SELECT trace_id, span_id, 0 AS depth, [(started_at, row_id)] AS path FROM linked WHERE parent_span_id IS NULL OR NOT known
        UNION ALL SELECT c.trace_id, c.span_id, t.depth + 1, list_append(t.path, (c.started_at, c.row_id)) FROM linked c JOIN tree t ON c.trace_id = t.trace_id AND c.parent_span_id = t.span_id AND c.known
    ) SELECT t.trace_id, t.span_id, t.depth, (row_number() OVER (PARTITION BY t.trace_id ORDER BY path) - 1)::INT AS place, coalesce(k.children, 0)::INT AS children, s.started_at - min(s.started_at) OVER (PARTITION BY t.trace_id) AS offset_ns
    FROM tree t JOIN spans s ON s.span_id = t.span_id LEFT JOIN (SELECT parent_span_id AS span_id, count(*) AS children FROM spans GROUP BY 1) k ON k.span_id = t.span_id""",
    "RECURSIVE" + SPANS + ", linked AS (SELECT s.*, p.span_id IS NOT NULL AS known FROM spans s LEFT JOIN spans p ON p.span_id = s.parent_span_id),",
)
def cli_1_trace_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Every trace as a tree in depth-first order."""
    return spans.trace_trees(S.spans(spark, sf))


@query(f"SELECT series, recorded_at - recorded_at % {DAY} AS step_at, count(*) AS n, min(value) AS low, max(value) AS high, sum(value)::BIGINT AS sum, max_by(value, recorded_at) AS last FROM points GROUP BY ALL", POINTS)
def agg_13_levels(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.levels(S.gauge_points(spark, sf), ["series"], DAY)


@query(
    f"""SELECT series, recorded_at - recorded_at % {HOUR} AS step_at, sum(grown)::BIGINT AS increase, sum(took)::BIGINT AS elapsed_ns FROM (
        SELECT *, CASE WHEN value >= lag(value) OVER w THEN value - lag(value) OVER w WHEN lag(value) OVER w IS NOT NULL THEN value END AS grown, coalesce(recorded_at - lag(recorded_at) OVER w, 0) AS took FROM counter WINDOW w AS (PARTITION BY series ORDER BY recorded_at)
    ) WHERE grown IS NOT NULL GROUP BY ALL""", COUNTER,
)
def agg_14_win_1_counter_increase(spark: SparkSession, sf: str) -> DataFrame:
    """Increase of cumulative counters that restart, by hour."""
    return metrics.increases(S.counter_points(spark, sf), ["series"], HOUR)


@query(
    f"""SELECT series, recorded_at - recorded_at % {HOUR} AS step_at, sum(grown)::BIGINT AS increase, sum(took)::BIGINT AS elapsed_ns FROM (
        SELECT *, CASE WHEN value >= lag(value) OVER w THEN value - lag(value) OVER w WHEN lag(value) OVER w IS NOT NULL THEN value END AS grown, coalesce(recorded_at - lag(recorded_at) OVER w, 0) AS took
        FROM counter WHERE recorded_at >= {WEEK.start - 5 * MINUTE} AND recorded_at < {WEEK.end} WINDOW w AS (PARTITION BY series ORDER BY recorded_at)
    ) WHERE grown IS NOT NULL AND recorded_at >= {WEEK.start} GROUP BY ALL""", COUNTER,
)
def jon_12_increase_in_range(spark: SparkSession, sf: str) -> DataFrame:
    """Increase of counters in a week; a point up to five minutes before it is the base of the first."""
    return metrics.increases(S.counter_points(spark, sf), ["series"], HOUR, r=WEEK)


LEVELS = f", steps AS (SELECT series, shard, type, recorded_at - recorded_at % {DAY} AS step_at, count(*) AS n, min(value) AS low, max(value) AS high, sum(value)::BIGINT AS sum, max_by(value, recorded_at) AS last FROM points GROUP BY ALL)"


@query("SELECT type, step_at, sum(n)::BIGINT AS n, min(low) AS low, max(high) AS high, round(avg(sum / n), 6) AS avg, round(avg(last), 6) AS last FROM steps GROUP BY ALL", POINTS + LEVELS)
def agg_18_gauge_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Gauges grouped by type: averages of averages."""
    found = metrics.grouped_levels(metrics.levels(S.gauge_points(spark, sf), ["series", "shard", "type"], DAY), ["type"], "gauge")
    return found.withColumns({"avg": F.round("avg", 6), "last": F.round("last", 6)})


@query("SELECT shard, step_at, sum(n)::BIGINT AS n, sum(low)::BIGINT AS low, sum(high)::BIGINT AS high, round(sum(sum / n), 6) AS avg, sum(last)::BIGINT AS last FROM steps GROUP BY ALL", POINTS + LEVELS)
def agg_18_updown_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Updown series add up, least and greatest too."""
    found = metrics.grouped_levels(metrics.levels(S.gauge_points(spark, sf), ["series", "shard", "type"], DAY), ["shard"], "updown")
    return found.withColumn("avg", F.round("avg", 6))


@query(
    f"""SELECT coalesce(r.series, 'other') AS series, step_at, sum(c.increase)::BIGINT AS increase, count(DISTINCT c.series) AS series_count FROM steps c
    LEFT JOIN (SELECT series FROM steps WHERE elapsed > 0 GROUP BY 1 ORDER BY avg(increase / (elapsed / 1e9)) DESC, series LIMIT 5) r USING (series) GROUP BY ALL""",
    POINTS + f", steps AS (SELECT series, recorded_at - recorded_at % {DAY} AS step_at, sum(value)::BIGINT AS increase, sum(took)::BIGINT AS elapsed FROM (SELECT *, coalesce(recorded_at - lag(recorded_at) OVER (PARTITION BY series ORDER BY recorded_at), 0) AS took FROM points) GROUP BY ALL)",
)
def agg_19_agg_20_top_and_other(spark: SparkSession, sf: str) -> DataFrame:
    """The five delta counters with the greatest mean rate by day, and all others as one group."""
    found = metrics.increases(S.gauge_points(spark, sf), ["series"], DAY, cumulative=False)
    return metrics.top_and_rest(found, "series", metrics.ranking(found, "series", "counter"), 5, "increase")


BOUNDS = [1_000.0, 5_000.0, 10_000.0, 25_000.0]


@query(
    f"SELECT type, recorded_at - recorded_at % {DAY} AS step_at, count(*) AS n, sum(value)::BIGINT AS sum, " + ", ".join(f"count(*) FILTER ({c}) AS b{k}" for k, c in enumerate(["value <= 1000", "value > 1000 AND value <= 5000", "value > 5000 AND value <= 10000", "value > 10000 AND value <= 25000", "value > 25000"])) + " FROM points GROUP BY ALL", POINTS,
)
def agg_15_histogram_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Histograms by series and hour, merged by type and day."""
    hours = metrics.histogram_points(S.gauge_points(spark, sf), ["series", "type"], BOUNDS, HOUR)
    merged = metrics.add_counts(hours.withColumn("step_at", steps.step_of(F.col("step_at"), DAY)), ["type", "step_at"], len(BOUNDS) + 1)
    return merged.select("type", "step_at", "n", "sum", *[F.col("counts")[k].alias(f"b{k}") for k in range(len(BOUNDS) + 1)])


_EDGES = [0.0, *BOUNDS, BOUNDS[-1]]
_PLACED = "CASE " + " ".join(f"WHEN value <= {b} THEN {k}" for k, b in enumerate(BOUNDS)) + f" ELSE {len(BOUNDS)} END"
_AT = " ".join(f"WHEN {k} THEN {{}}" for k in range(len(BOUNDS) + 1))
_LOW, _HIGH = "CASE k " + _AT.format(*_EDGES[:-1]) + " END", "CASE k " + _AT.format(*_EDGES[1:]) + " END"


@query(
    "SELECT type, " + ", ".join(f"round(arg_min({_LOW} + ({_HIGH} - {_LOW}) * ({q} * total - (seen - n)) / n, k) FILTER (seen >= {q} * total), 3) AS {p}" for p, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))) + " FROM summed GROUP BY type",
    POINTS + f", cells AS (SELECT type, {_PLACED} AS k, count(*) AS n FROM points GROUP BY ALL), summed AS (SELECT *, sum(n) OVER (PARTITION BY type ORDER BY k)::DOUBLE AS seen, sum(n) OVER (PARTITION BY type)::DOUBLE AS total FROM cells)",
)
def agg_17_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """p50, p90 and p99 of the merged histograms by type."""
    whole = metrics.add_counts(metrics.histogram_points(S.gauge_points(spark, sf), ["type"], BOUNDS, DAY), ["type"], len(BOUNDS) + 1)
    return whole.select("type", *[F.round(metrics.percentile(F.col("counts"), BOUNDS, q), 3).alias(p) for p, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))])


@query("SELECT type, index >> 2 AS index, count(*) AS n FROM (SELECT type, CAST(ceil(log2(value) * 8) AS INT) - 1 AS index FROM points) GROUP BY ALL", POINTS)
def agg_16_exponential_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Exponential buckets of scale 3, joined to scale 1."""
    cells = S.gauge_points(spark, sf).groupBy("type", metrics.exponential_index(F.col("value"), 3).alias("index")).agg(F.count(F.lit(1)).alias("n"))
    return metrics.lower_scale(cells, ["type"], 2)


@query("SELECT type, 2 AS scale, CASE WHEN shard % 2 = 0 THEN index >> 1 ELSE index END AS index, count(*) AS n FROM (SELECT type, shard, CAST(ceil(log2(value) * CASE WHEN shard % 2 = 0 THEN 8 ELSE 4 END) AS INT) - 1 AS index FROM points) GROUP BY ALL", POINTS)
def agg_16_add_scales(spark: SparkSession, sf: str) -> DataFrame:
    """Exponential buckets of two scales, added at the smaller one."""
    points = S.gauge_points(spark, sf)
    even = F.col("shard") % 2 == 0
    index = F.when(even, metrics.exponential_index(F.col("value"), 3)).otherwise(metrics.exponential_index(F.col("value"), 2))
    cells = points.groupBy("type", F.when(even, 3).otherwise(2).alias("scale"), index.alias("index")).agg(F.count(F.lit(1)).alias("n"))
    return metrics.to_least_scale(cells, ["type"])


@query("SELECT key, count(*) AS n, CASE WHEN min(type) = max(type) THEN min(type) ELSE 'mixed' END AS type FROM (SELECT 'user.id' AS key, CASE WHEN starts_with(a_user, '\"') THEN 'string' ELSE 'int' END AS type FROM logs UNION ALL SELECT 'event.type', 'string' FROM logs UNION ALL SELECT 'k', 'int' FROM logs WHERE a_k IS NOT NULL UNION ALL SELECT 'ok', 'bool' FROM logs) GROUP BY key", LOGS)
def agg_21_jsn_2_attribute_keys(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.keys(S.logs(spark, sf))


@query("SELECT a_user AS value, count(*) AS n FROM logs GROUP BY 1 ORDER BY n DESC, value LIMIT 500", LOGS)
def agg_22_attribute_values(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.values(S.logs(spark, sf), "user.id")


@query("SELECT name, count(*) AS n FROM spans GROUP BY 1", SPANS)
def agg_23_span_names(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.counts_of(S.spans(spark, sf), "name")


@query(
    "SELECT CAST(to_timestamp(logged_at // 1000000000) AT TIME ZONE 'UTC' AS DATE)::VARCHAR AS day, key, count(*) AS n, count(DISTINCT value) AS n_values FROM entries GROUP BY ALL",
    LOGS + ", entries AS (" + " UNION ALL ".join(f"SELECT logged_at, '{k}' AS key, {c} AS value FROM logs WHERE {c} IS NOT NULL" for k, c in (("user.id", "a_user"), ("event.type", "a_type"), ("k", "a_k"), ("ok", "a_ok"))) + ")",
)
def ing_7_dat_2_catalog_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """Every attribute key by day, with how many values it had."""
    return catalog.keys_by_day(S.logs(spark, sf), steps.day_of(F.col("logged_at"))).withColumn("day", F.col("day").cast("string"))


@query("SELECT 'user.id' AS key, 'mixed' AS type, 'attributes' AS origin, (SELECT count(DISTINCT a_user) FROM logs) AS n_values, (SELECT string_agg(a_user, ',' ORDER BY n DESC, a_user) FROM (SELECT a_user, count(*) AS n FROM logs GROUP BY 1 ORDER BY n DESC, a_user LIMIT 10)) AS common", LOGS)
def cmp_3_field_help(spark: SparkSession, sf: str) -> DataFrame:
    """What completion says about a field."""
    return catalog.help_on(S.logs(spark, sf), "user.id").withColumn("common", F.array_join("common", ","))


@query("SELECT a_user AS value, count(*) AS n FROM (SELECT * FROM logs WHERE severity >= 13 AND starts_with(ltrim(a_user, '\"'), '1') ORDER BY logged_at DESC, row_id DESC LIMIT 10000) GROUP BY 1 ORDER BY n DESC, value LIMIT 50", LOGS)
def cmp_4_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """What completion offers for user.id after `1`, among recent warnings."""
    return catalog.suggestions(S.logs(spark, sf), F.col("severity") >= 13, [F.desc("logged_at"), F.desc("row_id")], "user.id", "1")


@query("SELECT service, sum(n)::BIGINT AS n, sum(total)::BIGINT AS sum_ns FROM (SELECT service, count(*) AS n, sum(duration_ns) AS total FROM spans WHERE started_at >= 820454400000000123 AND started_at < 883612800000000456 GROUP BY 1) GROUP BY 1", SPANS)
def ing_5_set_2_summary_read(spark: SparkSession, sf: str) -> DataFrame:
    """A range read from hour and minute summaries and raw ends: equal to reading it raw."""
    rows = S.spans(spark, sf)
    minutes, hours = rollups.minutes_and_hours(rows, ["service"])
    cells = rollups.read_range(rows, minutes, hours, ["service"], Range(820454400000000123, 883612800000000456))
    return cells.groupBy("service").agg(F.sum("n").alias("n"), F.sum("sum_ns").alias("sum_ns"))


@query(
    f"""SELECT series, recorded_at - recorded_at % {HOUR} AS unit_at, count(*) AS n, min(value) AS low, max(value) AS high, sum(value)::BIGINT AS sum, max_by(value, recorded_at) AS last, sum(grown)::BIGINT AS increase, sum(took)::BIGINT AS elapsed_ns FROM (
        SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value >= lag(value) OVER w THEN value - lag(value) OVER w ELSE value END AS grown, coalesce(recorded_at - lag(recorded_at) OVER w, 0) AS took FROM counter WINDOW w AS (PARTITION BY series ORDER BY recorded_at)) GROUP BY ALL""", COUNTER,
)
def ing_6_metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Hours made from the summaries of their minutes; the SQL makes them from the points."""
    return rollups.coarser_metrics(rollups.metric_summary(S.counter_points(spark, sf), ["series"], MINUTE), ["series"], HOUR)


@query(f"SELECT row_id FROM logs WHERE logged_at >= {JAN + 22 * DAY}", LOGS)
def ing_8_retention(spark: SparkSession, sf: str) -> DataFrame:
    """What a week's retention keeps on the 29th."""
    return rollups.retained(S.logs(spark, sf), "logged_at", JAN + 28 * DAY + HOUR).select("row_id")


@query(f"SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE epoch_us(ts) * 1000 >= {JAN + 29 * DAY})")
def jon_8_unreferenced(spark: SparkSession, sf: str) -> DataFrame:
    """Users that nothing refers to any more once only the last days are kept."""
    events = S.table(spark, sf, "events").select("user_id", S.nanos("ts").alias("at"))
    kept_rows = rollups.retained(events, "at", JAN + 30 * DAY + HOUR, days=2)
    return rollups.unreferenced(events.select("user_id").distinct(), kept_rows, "user_id")


@query("SELECT series, hour, value FROM (SELECT *, recorded_at - recorded_at % 3600000000000 AS hour FROM (SELECT (user_id % 10) || '/' || event_type AS series, epoch_us(ts) * 1000 AS recorded_at, CAST(round(value * 100) AS BIGINT) AS value, event_id * 7919 % 1000003 AS arrival FROM events)) QUALIFY row_number() OVER (PARTITION BY series, hour ORDER BY arrival DESC) = 1")
def snk_4_latest_write(spark: SparkSession, sf: str) -> DataFrame:
    """Points written in another order than they were recorded: of one series and instant, the last to arrive holds."""
    rows = S.table(spark, sf, "events").select(F.concat_ws("/", (F.col("user_id") % 10).cast("string"), "event_type").alias("series"), steps.step_of(S.nanos("ts"), HOUR).alias("hour"), F.round(F.col("value") * 100).cast("long").alias("value"), (F.col("event_id") * 7919 % 1_000_003).alias("arrival"))
    return rollups.latest_write(rows, ["series", "hour"], F.col("arrival")).select("series", "hour", "value")


@query("SELECT p.series, p.recorded_at FROM points p JOIN (SELECT type, series FROM points GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY type ORDER BY min(recorded_at), series) <= 3) USING (type, series)", POINTS)
def snk_5_lim_6_series_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the first three series of each metric."""
    return rollups.first_series(S.gauge_points(spark, sf), "type", "series", 3)[0].select("series", "recorded_at")


@query(
    f"""SELECT series, s.step_at, last_value(p.last IGNORE NULLS) OVER (PARTITION BY series ORDER BY s.step_at ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS last
    FROM (SELECT DISTINCT series FROM points) k CROSS JOIN (SELECT unnest(range({JAN}, {JAN + 6 * HOUR}, {MINUTE})) AS step_at) s
    LEFT JOIN (SELECT series, recorded_at - recorded_at % {MINUTE} AS step_at, max_by(value, recorded_at) AS last FROM points GROUP BY ALL) p USING (series, step_at)""", POINTS,
)
def win_5_fill_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Last values by minute, carried for under five minutes."""
    r = Range(JAN, JAN + 6 * HOUR)
    points = S.gauge_points(spark, sf)
    found = metrics.levels(steps.within(points, "recorded_at", r), ["series"], MINUTE)
    cells = points.select("series").distinct().crossJoin(F.broadcast(steps.grid(spark, r, MINUTE)))
    return steps.fill_forward(cells.join(found, ["series", "step_at"], "left").select("series", "step_at", "last"), ["series"], "last", MINUTE)


@query(
    """SELECT DISTINCT CASE WHEN system = '"mongodb"' THEN trim(query, '"') ELSE CASE row_id // 1000 % 4 WHEN 0 THEN 'SELECT * FROM part WHERE id = ? AND qty > ?' WHEN 1 THEN 'SELECT name FROM supplier WHERE note IN (?) AND id = ?'
    WHEN 2 THEN 'INSERT INTO shipped (id, mode) VALUES (?)' ELSE 'SELECT * FROM part WHERE id = $1 -- 42' END END AS text FROM spans WHERE query IS NOT NULL""", SPANS,
)
def str_2_str_3_ing_1_sanitized_sql(spark: SparkSession, sf: str) -> DataFrame:
    """Query texts of spans, those of SQL systems without their literals."""
    system, text = A.text_of(A.value("attributes", "db.system.name")), A.text_of(A.value("attributes", "db.query.text"))
    texts = S.spans(spark, sf).filter(A.has("attributes", "db.query.text")).select(T.is_sql_system(system).alias("sql"), text.alias("raw")).distinct()
    return texts.select(F.when(F.col("sql"), F.coalesce(T.sanitize_sql(F.col("raw")), F.col("raw"))).otherwise(F.col("raw")).alias("text")).distinct()


@query("SELECT url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1), '/[0-9]+', '/{}', 'g') AS shape FROM pages")
def str_9_route_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts and route shapes of page addresses."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1)
    return S.table(spark, sf, "pages").select("url", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), T.route_shape(F.regexp_replace(path, "/[0-9]+", "/{id}")).alias("shape"))


@query(f"SELECT started_at - started_at % {30 * DAY} AS step_at, count(*) AS n, count(*) FILTER (status = 2) AS errors, round(count(*) / {30 * DAY / 1e9}, 9) AS rate, round(count(*) FILTER (status = 2) / count(*), 9) AS error_rate FROM spans GROUP BY 1", SPANS)
def cli_4_mth_3_span_measures(spark: SparkSession, sf: str) -> DataFrame:
    return spans.span_steps(S.spans(spark, sf), 30 * DAY).withColumns({"rate": F.round("rate", 9), "error_rate": F.round("error_rate", 9)})


@query(f"SELECT type AS name, series, count(*) OVER () > 20 AS truncated FROM (SELECT DISTINCT type, series FROM points WHERE recorded_at >= {JAN} AND recorded_at < {JAN + 2 * HOUR}) QUALIFY row_number() OVER (ORDER BY type, series) <= 20", POINTS)
def agg_25_jon_7_metric_list(spark: SparkSession, sf: str) -> DataFrame:
    """The first series, by name, with a point in two hours, and whether there are more."""
    points = S.gauge_points(spark, sf)
    series = points.select(F.col("type").alias("name"), "series").distinct()
    return metrics.metric_list(series, points, Range(JAN, JAN + 2 * HOUR), 20).select("name", "series", "truncated")


@query("SELECT row_id, route, true AS truncated FROM (SELECT * FROM spans ORDER BY route DESC NULLS LAST, row_id LIMIT 50)", SPANS)
def srt_4_lim_1_table_order(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a table that is sorted by a column with gaps, and whether there is more."""
    rows = S.spans(spark, sf).select("row_id", A.value("attributes", "http.route").alias("route"))
    return steps.page(rows, [steps.table_order("route", True), F.asc("row_id")], 50)


@query("SELECT row_id, duration_ns FROM (SELECT *, row_number() OVER (ORDER BY duration_ns DESC, started_at DESC, row_id DESC) AS place FROM spans) WHERE place BETWEEN 51 AND 100", SPANS)
def lim_2_next_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of the longest spans, by the cursor of the first."""
    rows = S.spans(spark, sf)
    order = [c for c, _ in spans.order_of("longest")]
    last = spans.ordered(rows, "longest", 50).agg(F.min(F.struct(*order)).alias("x")).first()["x"]
    return spans.ordered(rows, "longest", 50, list(last)).select("row_id", "duration_ns")


@query("SELECT method, route, count(*) AS n, count(*) FILTER (status = 2) AS errors FROM spans WHERE service = 'svc-1' AND kind = 2 AND method IS NOT NULL GROUP BY ALL", SPANS)
def cli_11_routes_of_a_service(spark: SparkSession, sf: str) -> DataFrame:
    """A service's routes."""
    condition, keys = spans.routes_of("svc-1")
    groups = spans.span_groups(S.spans(spark, sf).filter(condition), keys)
    return groups.select(F.col("http_request_method").alias("method"), F.col("http_route").alias("route"), "n", "errors")


@query("SELECT row_id FROM spans WHERE method = '\"POST\"' AND query IS NULL", SPANS)
def cli_13_drill_down(spark: SparkSession, sf: str) -> DataFrame:
    """The spans of a group, one of whose keys is missing."""
    return S.spans(spark, sf).filter(spans.drill_down({"http.request.method": "POST", "db.query.text": None})).select("row_id")


@query("SELECT a_type AS value, count(DISTINCT a_user) AS n_distinct FROM logs GROUP BY 1", LOGS)
def agg_24_distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return S.logs(spark, sf).groupBy(A.value("attributes", "event.type").alias("value")).agg(F.count_distinct(A.value("attributes", "user.id")).alias("n_distinct"))


def _span_page(order: str) -> str:
    return f"SELECT row_id, '{order}' AS sorted_by FROM (SELECT * FROM spans ORDER BY {dict(newest='started_at DESC', oldest='started_at', longest='duration_ns DESC', shortest='duration_ns')[order]}, started_at DESC, row_id DESC LIMIT 100)"


@query(" UNION ALL ".join(map(_span_page, ("newest", "oldest", "longest", "shortest"))), SPANS)
def srt_2_span_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A page of spans in each of the four orders."""
    rows = S.spans(spark, sf)
    pages = [spans.ordered(rows, order, 100).select("row_id", F.lit(order).alias("sorted_by")) for order in ("newest", "oldest", "longest", "shortest")]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])


@query("SELECT l.row_id, l.trace_id FROM logs l JOIN (SELECT trace_id FROM logs GROUP BY 1 ORDER BY count(*) DESC, trace_id LIMIT 10) t USING (trace_id)", LOGS)
def srt_3_jon_6_logs_of_traces(spark: SparkSession, sf: str) -> DataFrame:
    """The logs of the ten traces with most of them."""
    rows = S.logs(spark, sf)
    page = rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "trace_id").limit(10)
    return rows.join(F.broadcast(page), "trace_id", "left_semi").select("row_id", "trace_id")


@query(
    "SELECT service, max_by(host, (host IS NOT NULL, t, row_id)) AS host, max(t) AS newest_at FROM (SELECT service, CASE WHEN row_id % 9 <> 0 THEN host END AS host, logged_at AS t, row_id FROM logs UNION ALL SELECT service, NULL, started_at, row_id FROM spans) GROUP BY 1", LOGS + "," + SPANS,
)
def agg_11_resource_of_service(spark: SparkSession, sf: str) -> DataFrame:
    """The resource of each service over logs and spans; one without attributes only where there is no other."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    lines = S.logs(spark, sf).select("service", F.when(F.col("row_id") % 9 != 0, F.col("resource")).otherwise(empty).alias("resource"), F.col("logged_at").alias("at"), "row_id")
    found = spans.resource_of_service(lines.unionByName(S.spans(spark, sf).select("service", empty.alias("resource"), F.col("started_at").alias("at"), "row_id")))
    return found.select("service", A.value("resource", "host.name").alias("host"), "newest_at")


@query("SELECT type AS name, count(DISTINCT series) AS n_series, min(value) AS low, max(value) AS high FROM points GROUP BY 1", POINTS)
def agg_26_metric_names(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.metric_names(S.gauge_points(spark, sf), "type")


@query(
    f"""SELECT step_at, round(avg(a), 6) AS gauge, round(sum(a), 6) AS updown FROM (SELECT series, recorded_at - recorded_at % {DAY} AS step_at, sum(value) / count(*) AS a FROM points GROUP BY ALL) GROUP BY 1""", POINTS,
)
def cli_5_cli_6_combined_series(spark: SparkSession, sf: str) -> DataFrame:
    """All series of a chart as one line: gauges average, updowns add up, steps without a point left out."""
    found = metrics.levels(S.gauge_points(spark, sf), ["series"], DAY)
    gauge, updown = (metrics.combined(found, kind).select("step_at", F.round("value", 6).alias(kind)) for kind in ("gauge", "updown"))
    return gauge.join(updown, "step_at")


@query(
    f"""SELECT step_at, l.n AS logs, coalesce(p.n, 0) AS purchases FROM (SELECT logged_at - logged_at % {DAY} AS step_at, count(*) AS n FROM logs GROUP BY 1) l
    LEFT JOIN (SELECT recorded_at - recorded_at % {DAY} AS step_at, count(*) AS n FROM points WHERE type = 'purchase' GROUP BY 1) p USING (step_at)""", LOGS + "," + POINTS,
)
def cli_7_two_queries_on_one_chart(spark: SparkSession, sf: str) -> DataFrame:
    """Two queries aligned by the start of their steps."""
    a = S.logs(spark, sf).groupBy(steps.step_of(F.col("logged_at"), DAY).alias("step_at")).agg(F.count(F.lit(1)).alias("logs"))
    b = S.gauge_points(spark, sf).filter("type = 'purchase'").groupBy(steps.step_of(F.col("recorded_at"), DAY).alias("step_at")).agg(F.count(F.lit(1)).alias("purchases"))
    return metrics.aligned(a, b, "purchases")


@query("SELECT row_id, CASE WHEN method IS NOT NULL THEN 'http' WHEN query IS NOT NULL THEN 'database' END AS meaning, coalesce(trim(method, '\"') || ' ' || trim(route, '\"'), trim(system, '\"')) AS title FROM spans", SPANS)
def cli_14_span_meaning(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a span is an HTTP request or a database call, by new and old attribute names."""
    return S.spans(spark, sf).select("row_id", *spans.meaning())


@query(f"SELECT service, count(*) AS n, round(sum(duration_ns) / 1e9, 3) AS seconds FROM spans WHERE started_at >= {820454400 * 10**9} AND started_at < {852076800 * 10**9} GROUP BY 1", SPANS)
def src_13_mth_2_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Total time of the spans of a range, in decimals that can't overflow."""
    rows = steps.within(S.spans(spark, sf), "started_at", Range(820454400 * 10**9, 852076800 * 10**9))
    total = F.sum(F.col("duration_ns").cast("decimal(38,0)"))
    return rows.groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.round(total.cast("double") / 1e9, 3).alias("seconds"))


def in_batches(rows: DataFrame, batch: Column, n: int, name: str) -> str:
    """A folder of the rows' files, batch by batch in the order of their names; each is written by Spark from the tables."""
    path = stored.shared(rows.sparkSession, name)
    for k in range(n):
        rows.filter(batch == k).repartition(4).write.mode("append").parquet(path)
    return path


@query(ORACLES["agg_14_win_1_counter_increase"])
def agg_14_win_1_increase_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Increase of cumulative counters by hour from a stream: files with points of all times, in any order."""
    points = S.counter_points(spark, sf).select("series", "recorded_at", F.col("value").cast("long").alias("value"))
    source = in_batches(points, F.pmod(F.xxhash64("series", "recorded_at"), F.lit(2)), 2, "arriving")
    target, checkpoint = stored.shared(spark, "increases"), stored.shared(spark, "offsets")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 4).parquet(source)
    series.land_increases(stream, HOUR, target, checkpoint, horizon=400 * DAY, idle="400 days").awaitTermination()
    table = series.increases_table(target)
    table.compact(spark)
    # Steps in which nothing grew and no time passed add nothing; a step with a point has time in it.
    return table.read(spark).select("series", "step_at", "increase", "elapsed_ns").filter("elapsed_ns > 0")


@query("SELECT service, started_at - started_at % 3600000000000 AS hour_at, count(*) AS n, sum(duration_ns)::BIGINT AS sum_ns, min(duration_ns) AS low_ns, max(duration_ns) AS high_ns FROM spans GROUP BY ALL", SPANS)
def snk_3_ing_5_late_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of spans of which a third came years late: minute cells that batches add to, one of them twice, compacted midway."""
    table = Deltas(stored.shared(spark, "minutes"), ("service", "unit_at", "bucket"), {"n": "sum", "sum_ns": "sum", "low_ns": "min", "high_ns": "max"})
    arrived = stored.shared(spark, "arrived")
    stored.put(S.spans(spark, sf).select("service", "started_at", "duration_ns", F.pmod("row_id", F.lit(3)).alias("batch")), arrived)
    rows = spark.read.parquet(arrived)
    for k in (0, 1, 1, 2):
        table.add(rollups.span_cells(rows.filter(F.col("batch") == k), ["service"], MINUTE), k)
        if k == 0:
            table.compact(spark)
    hours = table.read(spark).groupBy("service", steps.step_of(F.col("unit_at"), HOUR).alias("hour_at"))
    return hours.agg(F.sum("n").alias("n"), F.sum("sum_ns").alias("sum_ns"), F.min("low_ns").alias("low_ns"), F.max("high_ns").alias("high_ns"))


@query(ORACLES["snk_5_lim_6_series_guard"])
def snk_5_ing_9_series_guard_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the first three series of each metric, from batches in order of time, one of which comes twice."""
    guard = series.SeriesGuard(stored.shared(spark, "guard"), 3)
    points = S.gauge_points(spark, sf).select(F.col("type").alias("metric"), "series", "recorded_at")
    cuts = [None, JAN + HOUR, JAN + DAY, None]
    for k in (0, 1, 1, 2):
        low, high = cuts[k], cuts[k + 1]
        within = (F.lit(True) if low is None else F.col("recorded_at") >= low) & (F.lit(True) if high is None else F.col("recorded_at") < high)
        guard.writer()(points.filter(within), k)
    return guard.points(spark).select("series", "recorded_at")


@query(ORACLES["cli_1_trace_trees"])
def cli_1_large_trace_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Every trace as a tree, by pointer jumping over all rows instead of trace by trace."""
    return traces.large_trace_trees(S.spans(spark, sf))


@query(ORACLES["ing_6_metric_summary"])
def ing_6_ing_10_rollup_job(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of counters by the job: two runs, then a rebuild, of which every hour has to equal what the runs left."""
    points = S.counter_points(spark, sf).select("series", "recorded_at", "value")
    job = rollup_job.MetricRollup(stored.shared(spark, "rollup"))
    for until in (JAN + 11 * DAY + 5 * HOUR, JAN + 60 * DAY):
        job.run(points, until)
    live = job.read(spark, "hours")
    job.rebuild(points, JAN + 60 * DAY)
    rebuilt = job.read(spark, "hours")
    columns = ["series", "unit_at", "n", "low", "high", "sum", "last", "increase", "elapsed_ns"]
    return live.select(columns).intersect(rebuilt.select(columns))


_CELLS = [f"b{k}" for k in range(5)]
_CASES = ["value <= {0}", "value > {0} AND value <= {1}", "value > {1} AND value <= {2}", "value > {2} AND value <= {3}", "value > {3}"]
OTHER_BOUNDS = [2_000.0, 4_000.0, 20_000.0, 40_000.0]
WIDE = 10 * DAY


def _placed(bounds: list[float]) -> str:
    return ", ".join(f"count(*) FILTER ({c.format(*map(int, bounds))}) AS b{k}" for k, c in enumerate(_CASES))


@query(
    f"""SELECT series, step_at, max(set) AS set, {", ".join(f"sum(g{k})::BIGINT AS b{k}" for k in range(5))}, sum(gs)::BIGINT AS sum FROM (
        SELECT *, max(CASE WHEN changed THEN recorded_at END) OVER (PARTITION BY series, step_at) AS since FROM (
            SELECT series, recorded_at, recorded_at - recorded_at % {WIDE} AS step_at, set, p_set IS DISTINCT FROM set AS changed, p_set IS NULL AS first,
                {", ".join(f"CASE WHEN p_set = set AND {' AND '.join(f'{c} >= p_{c}' for c in _CELLS)} THEN {x} - p_{x} ELSE {x} END AS g{x[1:] if x != 'total' else 's'}" for x in [*_CELLS, "total"])}
            FROM (SELECT *, {", ".join(f"lag({x}) OVER w AS p_{x}" for x in ["set", "total", *_CELLS])} FROM running WINDOW w AS (PARTITION BY series ORDER BY recorded_at))
        ) WHERE NOT first
    ) WHERE since IS NULL OR recorded_at >= since GROUP BY ALL""",
    POINTS + f""", hours AS (SELECT series, recorded_at - recorded_at % {HOUR} AS recorded_at, recorded_at // {7 * DAY} % 2 AS set, sum(value)::BIGINT AS total, {_placed(BOUNDS)} FROM points WHERE recorded_at // {7 * DAY} % 2 = 0 GROUP BY ALL
        UNION ALL SELECT series, recorded_at - recorded_at % {HOUR}, recorded_at // {7 * DAY} % 2, sum(value)::BIGINT, {_placed(OTHER_BOUNDS)} FROM points WHERE recorded_at // {7 * DAY} % 2 = 1 GROUP BY ALL),
    running AS (SELECT series, recorded_at, set, {", ".join(f"sum({x}) OVER (PARTITION BY series, recorded_at // {7 * DAY}, recorded_at // {3 * DAY} ORDER BY recorded_at) AS {x}" for x in ["total", *_CELLS])} FROM hours)""",
)
def agg_15_histogram_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative histograms by hour that restart every few days and change their bounds each week, folded to ten days."""
    points = S.gauge_points(spark, sf).select("series", "recorded_at", "value", (F.expr(f"recorded_at div {7 * DAY}") % 2).alias("set"))
    hours = [metrics.histogram_points(points.filter(F.col("set") == k), ["series", "set"], b, HOUR).withColumn("bounds", F.array(*map(F.lit, b))) for k, b in enumerate((BOUNDS, OTHER_BOUNDS))]
    week, part = F.expr(f"step_at div {7 * DAY}"), F.expr(f"step_at div {3 * DAY}")
    so_far = Window.partitionBy("series", week, part).orderBy("step_at").rowsBetween(Window.unboundedPreceding, 0)
    running = F.array(*[F.sum(F.col("counts")[k]).over(so_far) for k in range(5)])
    rows = hours[0].unionByName(hours[1]).select("series", F.col("step_at").alias("recorded_at"), steps.step_of(F.col("step_at"), WIDE).alias("step_at"), "bounds", running.alias("counts"), F.sum("sum").over(so_far).cast("double").alias("sum"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    found = metrics.fold_histograms(rows, ["series"], cumulative=True, block=DAY)
    return found.select("series", "step_at", (F.col("bounds")[0] == OTHER_BOUNDS[0]).cast("long").alias("set"), *[F.col("counts")[k].alias(f"b{k}") for k in range(5)], F.col("sum").cast("long").alias("sum"))


@query("SELECT row_id, logged_at, true AS truncated, false AS partial FROM logs WHERE severity >= 13 ORDER BY logged_at DESC, row_id DESC LIMIT 100", LOGS)
def srt_1_lim_1_newest_days(spark: SparkSession, sf: str) -> DataFrame:
    """A page of warnings from a table by day, read back from its newest day until it is full."""
    path = stored.shared(spark, "logs-by-day")
    daily.write(S.logs(spark, sf), "logged_at", path)
    page = newest.newest_page(spark, path, "logged_at", F.col("severity") >= 13, 100)
    return page.rows.select("row_id", "logged_at", F.lit(page.truncated).alias("truncated"), F.lit(page.partial).alias("partial"))


@query(f"SELECT row_id, service, severity FROM logs WHERE logged_at >= {WEEK.start} AND logged_at < {WEEK.end}", LOGS)
def src_13_day_table_range(spark: SparkSession, sf: str) -> DataFrame:
    """A week of logs from a table by day: its days are partition filters, its ends filters on their files."""
    path = stored.shared(spark, "logs-by-day")
    daily.write(S.logs(spark, sf), "logged_at", path)
    return daily.read(spark, path, "logged_at", WEEK).select("row_id", "service", "severity")


_WEEK_ENTRIES = LOGS + ", entries AS (" + " UNION ALL ".join(f"SELECT '{k}' AS key, {c} AS value FROM logs WHERE {c} IS NOT NULL AND logged_at >= {JAN + 7 * DAY} AND logged_at < {JAN + 14 * DAY}" for k, c in (("user.id", "a_user"), ("event.type", "a_type"), ("k", "a_k"), ("ok", "a_ok"))) + ")"


@query("SELECT key, count(*) AS n, count(DISTINCT value) <= 64 AS exact, CASE WHEN count(DISTINCT value) <= 64 THEN count(DISTINCT value) END AS n_values, true AS close FROM entries GROUP BY 1", _WEEK_ENTRIES)
def agg_24_ing_7_merged_days(spark: SparkSession, sf: str) -> DataFrame:
    """Different values of each key in a week, merged from the stored cells of its days; estimates are within 5 per cent."""
    path = stored.shared(spark, "catalog")
    entries = catalog.entries(S.logs(spark, sf).withColumn("day", F.expr(f"logged_at div {DAY}")), "attributes", "day")
    stored.put(distinct.value_cells(entries, ["day", "key"]), path, ("day",))
    first = JAN // DAY + 7
    week = distinct.merged_cells(spark.read.parquet(path).filter(F.col("day").between(first, first + 6)), ["key"])
    true = entries.filter(F.col("day").between(first, first + 6)).groupBy("key").agg(F.count_distinct("value").alias("true"))
    n = distinct.n_values()
    return week.join(true, "key").select("key", "n", "exact", F.when(F.col("exact"), n).alias("n_values"), (F.abs(n - F.col("true")) <= 0.05 * F.col("true")).alias("close"))


@query(ORACLES["jon_8_unreferenced"])
def jon_8_ing_8_dropped_days(spark: SparkSession, sf: str) -> DataFrame:
    """Users whom nothing refers to once the days before the 30th are dropped, told from the days' key sets."""
    events = S.table(spark, sf, "events").select("user_id", S.nanos("ts").alias("at"))
    facts, sets, first = stored.shared(spark, "facts"), stored.shared(spark, "keys"), date(2024, 1, 30)
    daily.write(events, "at", facts)
    retention.key_sets(events, "at", F.col("user_id"), sets)
    gone = stored.shared(spark, "orphans")
    stored.put(retention.orphans(spark, sets, first).select(F.col("key").alias("user_id")), gone)
    retention.drop_days(spark, first, facts, sets)
    return spark.read.parquet(gone)
