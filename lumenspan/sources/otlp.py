"""OTLP/JSON export requests, one to a line of a text file, as the three signals and what was rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH = 2  # arrays and maps within one another whose form is made canonical; what is deeper is left as it came


def _any(depth: int) -> str:
    inner = _any(depth - 1) if depth else ""
    array = f"STRUCT<values: ARRAY<{inner}>>" if depth else "STRING"
    pairs = f"STRUCT<values: ARRAY<STRUCT<key: STRING, value: {inner}>>>" if depth else "STRING"
    return f"STRUCT<stringValue: STRING, boolValue: BOOLEAN, intValue: STRING, doubleValue: STRING, bytesValue: STRING, arrayValue: {array}, kvlistValue: {pairs}>"


ANY = _any(DEPTH)
KEYS = f"ARRAY<STRUCT<key: STRING, value: {ANY}>>"
SCOPE = f"scope: STRUCT<name: STRING, version: STRING, attributes: {KEYS}>"
RESOURCE = f"resource: STRUCT<attributes: {KEYS}>"
LOG = f"STRUCT<timeUnixNano: STRING, observedTimeUnixNano: STRING, severityNumber: INT, body: {ANY}, attributes: {KEYS}, traceId: STRING, spanId: STRING, eventName: STRING>"
EVENT = f"STRUCT<timeUnixNano: STRING, name: STRING, attributes: {KEYS}>"
SPAN = f"STRUCT<traceId: STRING, spanId: STRING, parentSpanId: STRING, name: STRING, kind: INT, startTimeUnixNano: STRING, endTimeUnixNano: STRING, attributes: {KEYS}, events: ARRAY<{EVENT}>, status: STRUCT<code: INT, message: STRING>>"
BUCKETS = "STRUCT<offset: INT, bucketCounts: ARRAY<STRING>>"
POINT = f"STRUCT<attributes: {KEYS}, timeUnixNano: STRING, asDouble: STRING, asInt: STRING, flags: INT, count: STRING, sum: DOUBLE, min: DOUBLE, max: DOUBLE, bucketCounts: ARRAY<STRING>, explicitBounds: ARRAY<DOUBLE>, scale: INT, zeroCount: STRING, positive: {BUCKETS}, negative: {BUCKETS}>"
POINTS = f"STRUCT<dataPoints: ARRAY<{POINT}>, aggregationTemporality: INT, isMonotonic: BOOLEAN>"
METRIC = f"STRUCT<name: STRING, unit: STRING, gauge: {POINTS}, sum: {POINTS}, histogram: {POINTS}, exponentialHistogram: {POINTS}, summary: {POINTS}>"
REQUEST = (
    f"resourceLogs ARRAY<STRUCT<{RESOURCE}, scopeLogs: ARRAY<STRUCT<{SCOPE}, logRecords: ARRAY<{LOG}>>>>>, resourceSpans ARRAY<STRUCT<{RESOURCE}, scopeSpans: ARRAY<STRUCT<{SCOPE}, spans: ARRAY<{SPAN}>>>>>,"
    f" resourceMetrics ARRAY<STRUCT<{RESOURCE}, scopeMetrics: ARRAY<STRUCT<{SCOPE}, metrics: ARRAY<{METRIC}>>>>>"
)
LONG_MAX = 2**63 - 1


def requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Requests of files (gzip by name), read once or as a stream; a line that isn't a request has only nulls."""
    lines = (spark.readStream if stream else spark.read).text(path)
    return lines.select(F.from_json("value", REQUEST).alias("r")).select("r.*")


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """One row: how many lines of the files, other than blank ones, are no JSON objects."""
    whole = F.coalesce(F.get_json_object("value", "$").startswith("{"), F.lit(False))
    return spark.read.text(path).filter(F.trim("value") != "").agg(F.count_if(~whole).alias("unreadable"))


def _quoted(text: Column) -> Column:
    array = F.to_json(F.array(text))
    return array.substr(F.lit(2), F.length(array) - 2)


def _json(value: Column, depth: int = DEPTH) -> Column:
    """Canonical JSON text of a value; doubles that JSON lacks are strings, maps are in order of their keys."""
    double = value["doubleValue"]
    array, pairs = value["arrayValue"], value["kvlistValue"]
    if depth:
        array = F.when(array.isNotNull(), _listed("[", F.transform(array["values"], lambda v: _json(v, depth - 1)), "]"))
        texts = F.array_sort(F.transform(pairs["values"], lambda p: F.concat(_quoted(p["key"]), F.lit(":"), _json(p["value"], depth - 1))))
        pairs = F.when(pairs.isNotNull(), _listed("{", texts, "}"))
    return F.coalesce(
        F.when(value["stringValue"].isNotNull(), _quoted(value["stringValue"])), value["boolValue"].cast("string"), value["intValue"],
        F.when(double.isin("NaN", "Infinity", "-Infinity"), F.concat(F.lit('"'), double, F.lit('"'))).when(double.rlike(r"[.eE]"), double).when(double.isNotNull(), F.concat(double, F.lit(".0"))),
        F.concat(F.lit('"'), value["bytesValue"], F.lit('"')), array, pairs, F.lit("null"),
    )


def _listed(start: str, texts: Column, end: str) -> Column:
    return F.concat(F.lit(start), F.coalesce(F.array_join(texts, ","), F.lit("")), F.lit(end))


def _entries(keys: Column) -> Column:
    return F.transform(F.coalesce(keys, F.array().cast(KEYS)), lambda k: F.struct(k["key"].alias("key"), _json(k["value"]).alias("value")))


def _map(*lists: Column) -> Column:
    """A map of all entries; of a repeated key the last holds. Entries are sorted, so equal sets print alike."""
    joined = F.concat(*lists)
    last = F.filter(joined, lambda e, i: ~F.exists(F.slice(joined, i + 2, F.size(joined)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(F.array_sort(last))


def _text(name: str, value: Column) -> Column:
    """An entry for a text, or none if it is missing or empty."""
    entry = F.array(F.struct(F.lit(name).alias("key"), _quoted(value).alias("value")))
    return F.when(F.coalesce(value, F.lit("")) != "", entry).otherwise(F.array().cast("array<struct<key:string,value:string>>"))


def _time(value: Column) -> Column:
    """Unsigned nanoseconds held at the largest long; 0 and missing are null."""
    n = value.try_cast("decimal(20,0)")
    return F.when(n > 0, F.least(n, F.lit(LONG_MAX).cast("decimal(20,0)")).cast("long"))


def _id(value: Column, digits: int) -> Column:
    low = F.lower(value)
    return F.when(low.rlike(f"^[0-9a-f]{{{digits}}}$") & ~low.rlike("^0+$"), low)


def _opened(request: DataFrame, kind: str, scopes: str, items: str) -> DataFrame:
    resource = request.select(F.explode(kind).alias("r")).select("r.resource.attributes", F.explode(f"r.{scopes}").alias("s"))
    named = F.filter(F.coalesce("attributes", F.array().cast(KEYS)), lambda k: k["key"] == "service.name")  # the last one holds
    service = F.try_element_at(named, F.lit(-1))["value"]["stringValue"]
    return resource.select(
        F.coalesce(F.nullif(service, F.lit("")), F.lit("unknown_service")).alias("service"), _map(_entries(F.col("attributes"))).alias("resource"), F.col("s.scope").alias("scope"), F.explode(f"s.{items}").alias("x")
    )


def _scope() -> list[Column]:
    return [_text("otel.scope.name", F.col("scope.name")), _text("otel.scope.version", F.col("scope.version"))]


def logs(request: DataFrame, now: Column | None = None) -> DataFrame:
    """Log records: time, else observed time, else now; a body that isn't a string is its JSON; a span needs its trace."""
    x = F.col("x")
    trace = _id(x["traceId"], 32)
    severity = F.coalesce(x["severityNumber"], F.lit(0))
    return _opened(request, "resourceLogs", "scopeLogs", "logRecords").select(
        F.coalesce(_time(x["timeUnixNano"]), _time(x["observedTimeUnixNano"]), now if now is not None else F.unix_micros(F.current_timestamp()) * 1000).alias("logged_at"), "service",
        F.when(severity.between(0, 24), severity).otherwise(0).alias("severity"), F.when(x["body"].isNotNull(), F.coalesce(x["body"]["stringValue"], _json(x["body"]))).otherwise("").alias("body"), trace.alias("trace_id"), F.when(trace.isNotNull(), _id(x["spanId"], 16)).alias("span_id"),
        _map(*_scope(), _entries(x["attributes"]), _text("event.name", x["eventName"])).alias("attributes"), "resource",
    )


def spans(request: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans, and the number of rejected ones, which lack a valid trace or span ID."""
    x = F.col("x")
    start, end = F.coalesce(_time(x["startTimeUnixNano"]), F.lit(0)), F.coalesce(_time(x["endTimeUnixNano"]), F.lit(0))
    status = F.coalesce(x["status"]["code"], F.lit(0))
    events = F.transform(F.coalesce(x["events"], F.array().cast(f"ARRAY<{EVENT}>")), lambda e: F.struct(F.coalesce(_time(e["timeUnixNano"]), F.lit(0)).alias("occurred_at"), e["name"].alias("name"), _map(_entries(e["attributes"])).alias("attributes")))
    found = _opened(request, "resourceSpans", "scopeSpans", "spans").select(
        _id(x["traceId"], 32).alias("trace_id"), _id(x["spanId"], 16).alias("span_id"), _id(x["parentSpanId"], 16).alias("parent_span_id"), F.coalesce(x["name"], F.lit("")).alias("name"), F.coalesce(x["kind"], F.lit(0)).alias("kind"),
        start.alias("started_at"), F.greatest(end - start, F.lit(0)).alias("duration_ns"), F.when(status.isin(0, 1, 2), status).otherwise(0).alias("status"), "service", _map(*_scope(), _entries(x["attributes"]), _text("otel.status_description", x["status"]["message"])).alias("attributes"), "resource", events.alias("events"),
    )
    whole = F.col("trace_id").isNotNull() & F.col("span_id").isNotNull()
    return found.filter(whole), found.filter(~whole).agg(F.count(F.lit(1)).alias("rejected"))


def metrics(request: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metric points with their kind, and rejected ones counted by reason. Points that say they have no value are left out."""
    x = F.col("x")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), x[k].alias("data")) for k in ("gauge", "sum", "histogram", "exponentialHistogram", "summary")])
    rows = _opened(request, "resourceMetrics", "scopeMetrics", "metrics").select("service", "resource", "scope", x["name"].alias("name"), F.coalesce(x["unit"], F.lit("")).alias("unit"), F.explode(F.filter(kinds, lambda k: k["data"].isNotNull())).alias("k"))
    rows = rows.select("service", "resource", "scope", "name", "unit", "k.kind", F.coalesce("k.data.aggregationTemporality", F.lit(0)).alias("temporality"), F.coalesce("k.data.isMonotonic", F.lit(False)).alias("rising"), F.explode("k.data.dataPoints").alias("p"))
    p, t = F.col("p"), F.col("temporality")
    value = F.coalesce(p["asDouble"].try_cast("double"), p["asInt"].try_cast("bigint").cast("double"))
    longs = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda c: c.try_cast("bigint"))
    counts, bounds = longs(p["bucketCounts"]), F.coalesce(p["explicitBounds"], F.array().cast("array<double>"))
    counts = F.when((F.size(counts) == 0) & (F.size(bounds) == 0), F.array(p["count"].try_cast("bigint"))).otherwise(counts)
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(bounds) - 1, F.lit(1))), lambda i: F.coalesce(F.get(bounds, i) > F.get(bounds, i - 1), F.lit(True)))
    both = F.size(longs(p["positive"]["bucketCounts"])) + F.size(longs(p["negative"]["bucketCounts"]))
    reason = (
        F.when(F.col("kind") == "summary", "summary metrics are not supported")
        .when((F.col("kind") != "gauge") & ~t.isin(1, 2), "a temporality is missing")
        .when((F.col("kind") == "sum") & ~F.col("rising") & (t == 1), "a delta sum that is not monotonic")
        .when(F.col("kind").isin("gauge", "sum") & value.isNull(), "a point has no value")
        .when((F.col("kind") == "histogram") & ((F.size(counts) != F.size(bounds) + 1) | ~rising), "the buckets of a histogram do not fit")
        .when((F.col("kind") == "exponentialHistogram") & (~F.coalesce(p["scale"], F.lit(0)).between(-10, 20) | (both > 4_096)), "an exponential histogram is out of range")
    )
    kind = F.when(F.col("kind") == "gauge", "gauge").when(F.col("kind") == "sum", F.when(F.col("rising"), "counter").otherwise("updown")).otherwise("histogram")
    temporality = F.when(kind.isin("counter", "histogram"), F.when(t == 1, "delta").otherwise("cumulative"))
    skipped = F.coalesce(p["flags"], F.lit(0)).bitwiseAND(F.lit(1)) == 1
    found = rows.filter(~skipped).select(
        "service", "resource", "name", "unit", kind.alias("kind"), temporality.alias("temporality"), F.coalesce(_time(p["timeUnixNano"]), F.lit(0)).alias("recorded_at"), value.alias("value"), _map(*_scope(), _entries(p["attributes"])).alias("attributes"), reason.alias("reason"),
        F.when(F.col("kind").isin("histogram", "exponentialHistogram"), F.struct(
            p["count"].try_cast("bigint").alias("count"), p["sum"].alias("sum"), p["min"].alias("min"), p["max"].alias("max"), bounds.alias("bounds"), counts.alias("counts"), F.when(F.col("kind") == "exponentialHistogram", F.coalesce(p["scale"], F.lit(0))).alias("scale"), F.coalesce(p["zeroCount"].try_cast("bigint"), F.lit(0)).alias("zero_count"),
            F.struct(F.coalesce(p["positive"]["offset"], F.lit(0)).alias("offset"), longs(p["positive"]["bucketCounts"]).alias("counts")).alias("positive"), F.struct(F.coalesce(p["negative"]["offset"], F.lit(0)).alias("offset"), longs(p["negative"]["bucketCounts"]).alias("counts")).alias("negative"),
        )).alias("histogram"),
    )
    return found.filter("reason IS NULL").drop("reason"), found.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("rejected"))
