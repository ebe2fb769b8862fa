import json

from lumenspan.sources import otlp
from lumenspan.streaming import ingest
from pyspark.sql import functions as F


def attribute(key, **value):
    return {"key": key, "value": value}


RESOURCE = {"attributes": [attribute("service.name", stringValue="api"), attribute("host.name", stringValue="h1")]}
LOGS = {"resourceLogs": [{"resource": RESOURCE, "scopeLogs": [{"scope": {"name": "lib"}, "logRecords": [
    {"timeUnixNano": "1704067200000000001", "severityNumber": 17, "body": {"stringValue": "boom"}, "attributes": [attribute("n", intValue="7"), attribute("s", stringValue='a"b'), attribute("d", doubleValue=1), attribute("n", intValue="8")], "traceId": "AB" * 16, "spanId": "0" * 16},
    {"observedTimeUnixNano": "5", "severityNumber": 99, "body": {"intValue": "3"}, "spanId": "12" * 8, "eventName": "e"},
]}]}]}
SPANS = {"resourceSpans": [{"resource": {}, "scopeSpans": [{"spans": [
    {"traceId": "ab" * 16, "spanId": "12" * 8, "name": "x", "kind": 2, "startTimeUnixNano": "100", "endTimeUnixNano": "90", "status": {"code": 2, "message": "bad"}, "events": [{"timeUnixNano": "101", "name": "ev"}]},
    {"traceId": "0" * 32, "spanId": "12" * 8, "name": "y"},
]}]}]}


def point(**p):
    return {"timeUnixNano": "9", **p}


METRICS = {"resourceMetrics": [{"resource": RESOURCE, "scopeMetrics": [{"metrics": [
    {"name": "g", "unit": "By", "gauge": {"dataPoints": [point(asInt="5"), point(asDouble=2.5), point(flags=1), point()]}},
    {"name": "c", "sum": {"aggregationTemporality": 2, "isMonotonic": True, "dataPoints": [point(asInt="5")]}},
    {"name": "u", "sum": {"aggregationTemporality": 2, "dataPoints": [point(asInt="5")]}},
    {"name": "bad", "sum": {"aggregationTemporality": 1, "dataPoints": [point(asInt="5")]}},
    {"name": "h", "histogram": {"aggregationTemporality": 1, "dataPoints": [point(count="3", sum=4.0), point(count="3", bucketCounts=["1", "2"], explicitBounds=[1.0]), point(count="3", bucketCounts=["1"], explicitBounds=[1.0])]}},
    {"name": "s", "summary": {"dataPoints": [point(count="1")]}},
]}]}]}


def test_otlp_json(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, (LOGS, SPANS, METRICS))) + "\nnot json\n")
    request = otlp.requests(spark, str(tmp_path))
    a, b = otlp.logs(request).orderBy(F.desc("logged_at")).collect()
    assert (a["logged_at"], a["service"], a["severity"], a["body"], a["trace_id"], a["span_id"]) == (1704067200000000001, "api", 17, "boom", "ab" * 16, None)
    assert a["attributes"] == {"n": "8", "s": '"a\\"b"', "d": "1.0", "otel.scope.name": '"lib"'} and a["resource"]["host.name"] == '"h1"'
    assert (b["logged_at"], b["severity"], b["body"], b["span_id"], b["attributes"]["event.name"]) == (5, 0, "3", None, '"e"')
    kept, rejected = otlp.spans(request)
    s = kept.first()
    assert rejected.first()["rejected"] == 1 and kept.count() == 1
    assert (s["service"], s["duration_ns"], s["status"], s["attributes"], s["events"][0]["occurred_at"]) == ("unknown_service", 0, 2, {"otel.status_description": '"bad"'}, 101)
    points, reasons = otlp.metrics(request)
    assert sorted((r["name"], r["kind"], r["temporality"] or "", r["value"] or 0) for r in points.collect()) == [("c", "counter", "cumulative", 5.0), ("g", "gauge", "", 2.5), ("g", "gauge", "", 5.0), ("h", "histogram", "delta", 0), ("h", "histogram", "delta", 0), ("u", "updown", "", 5.0)]
    assert sum(r["rejected"] for r in reasons.collect()) == 4
    assert [list(r["histogram"]["counts"]) for r in points.filter("name = 'h'").orderBy(F.size("histogram.counts")).collect()] == [[3], [1, 2]]


def test_repeated_keys_arrays_and_unreadable_lines(spark, tmp_path):
    twice = {"attributes": [attribute("service.name", stringValue="old"), attribute("service.name", stringValue="new")]}
    tags = attribute("tags", arrayValue={"values": [{"intValue": "1"}, {"stringValue": "x"}, {"arrayValue": {"values": []}}]})
    tree = attribute("tree", kvlistValue={"values": [attribute("b", boolValue=True), attribute("a", doubleValue=2)]})
    event = {"timeUnixNano": "7", "name": "e", "attributes": [attribute("k", intValue="1"), attribute("k", intValue="2")]}
    span = {"traceId": "ab" * 16, "spanId": "12" * 8, "attributes": [tags, tree], "events": [event]}
    lines = [json.dumps({"resourceSpans": [{"resource": twice, "scopeSpans": [{"spans": [span]}]}]}), "{broken", "", "[]", "{}"]
    (tmp_path / "r.json").write_text("\n".join(lines) + "\n")
    found = otlp.spans(otlp.requests(spark, str(tmp_path)))[0].first()
    assert found["service"] == "new" and found["resource"] == {"service.name": '"new"'} and found["events"][0]["attributes"] == {"k": "2"}
    assert found["attributes"] == {"tags": '[1,"x",[]]', "tree": '{"a":2.0,"b":true}'}
    assert otlp.unreadable(spark, str(tmp_path)).first()["unreadable"] == 2


def test_streamed_logs_equal_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(LOGS))
        ingest.land_logs(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_streamed_minutes_equal_batch(spark, tmp_path):
    minute = 60_000_000_000
    rows = [(k * 7_000_000_000, "s", 1_000 + k, 2 if k % 5 == 0 else 0) for k in range(100)]
    spans = spark.createDataFrame(rows, "started_at long, service string, duration_ns long, status int")
    spans.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spans.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ingest.minute_counts(stream, "1 day").writeStream.outputMode("update").foreachBatch(ingest.upsert_minutes(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = ingest.read_minutes(spark, str(tmp_path / "out")).groupBy("minute_at").agg(F.sum("n").alias("n"), F.sum("errors").alias("e"), F.sum("sum_ns").alias("s"))
    want = spans.groupBy((F.col("started_at") - F.pmod("started_at", F.lit(minute))).alias("minute_at")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == 2).alias("e"), F.sum("duration_ns").alias("s"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
