"""Groups of spans, services, traces and trace trees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import KINDS, equals, has, keep_unless, text_of, value
from ..plans.ranges import Range, group_limit
from .sketch import bucket, quantiles_of_counts
from .steps import after, step_of, within, zero_filled
from .traces import large_trace_trees

MOST = 2**63 - 1


def span_groups(spans: DataFrame, keys: dict[str, Column], carry: dict[str, Column] | None = None) -> DataFrame:
    """Per group: count, errors, total time (held at the largest long), the name of the newest span, percentiles.

    `carry` names columns of the newest span to come along. One aggregate by group and duration bucket, combined before
    the shuffle, has all of it; what follows reads its cells only.
    """
    carry = carry or {}
    rows = spans.select(*[c.alias(k) for k, c in keys.items()], F.struct(F.col("name").alias("newest"), *[c.alias(k) for k, c in carry.items()]).alias("span"), "status", bucket(F.col("duration_ns")).alias("bucket"), "duration_ns", F.struct("started_at", "row_id").alias("at"))
    cells = rows.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == 2).alias("errors"), F.sum(F.col("duration_ns").cast("decimal(38,0)")).alias("time"), F.max_by("span", "at").alias("span"), F.max("at").alias("at")
    )
    total = F.least(F.sum("time"), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = [F.sum("n").alias("n"), F.sum("errors").alias("errors"), total.alias("total_ns"), F.max_by("span", "at").alias("span")]
    found = quantiles_of_counts(cells, list(keys), also=sums)
    return found.select(*keys, "n", "errors", "total_ns", "span.*", "p50", "p95", "p99")


def group_steps(spans: DataFrame, keys: dict[str, Column], r: Range, step: int, limit: int, by: str = "total_ns") -> DataFrame:
    """The steps of the first groups of a range: count, errors and time, zero filled. Groups are ranked from their steps."""
    cells = within(spans, "started_at", r).groupBy(*[c.alias(k) for k, c in keys.items()], step_of(F.col("started_at"), step).alias("step_at")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == 2).alias("errors"), F.sum(F.col("duration_ns").cast("decimal(38,0)")).alias("total_ns")
    )
    whole = cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "errors", "total_ns")])
    page = ranked(whole, list(keys), by, group_limit(limit, r.steps(step)))
    held = F.least("total_ns", F.lit(MOST).cast("decimal(38,0)")).cast("long")
    return zero_filled(cells.withColumn("total_ns", held), page.select(*keys), r, step, ["n", "errors", "total_ns"])


def ranked(groups: DataFrame, keys: list[str], by: str = "total_ns", limit: int = 50, highest: bool = True) -> DataFrame:
    measure = F.col("errors") * 1.0 / F.col("n") if by == "error_rate" else F.col(by)
    return groups.orderBy(measure.desc() if highest else measure.asc(), *[F.asc_nulls_first(k) for k in keys]).limit(limit)


ORDERS = {"newest": [], "oldest": [("started_at", False)], "longest": [("duration_ns", True)], "shortest": [("duration_ns", False)]}


def order_of(order: str) -> list[tuple[str, bool]]:
    """(column, descending) of one of four orders; equal durations and starts break ties newest first."""
    return [*ORDERS[order], ("started_at", True), ("row_id", True)]


def ordered(spans: DataFrame, order: str, limit: int, cursor: list | None = None) -> DataFrame:
    """A page; the cursor has the last row's values of the order's columns."""
    by = order_of(order)
    rows = spans.filter(after(by, cursor)) if cursor else spans
    return rows.orderBy(*[F.desc(c) if d else F.asc(c) for c, d in by]).limit(limit)


def routes_of(service: str) -> tuple[Column, dict[str, Column]]:
    """What a service's routes are: the condition on spans, and the keys of their groups."""
    condition = (F.col("service") == service) & (F.col("kind") == KINDS["server"]) & has("attributes", "http.request.method")
    return condition, {k.replace(".", "_"): value("attributes", k) for k in ("http.request.method", "http.route")}


def queries_of(service: str) -> tuple[Column, dict[str, Column]]:
    """What a service's database queries are: the condition on spans, and the keys of their groups."""
    return (F.col("service") == service) & has("attributes", "db.system.name"), {k.replace(".", "_"): value("attributes", k) for k in ("db.system.name", "db.namespace", "db.query.text")}


def drill_down(group: dict[str, str | int | float | bool | None], map_col: str = "attributes") -> Column:
    """The records of a group: each key equals its value, or is missing."""
    out = F.lit(True)
    for key, x in group.items():
        out = out & (keep_unless(has(map_col, key)) if x is None else F.coalesce(equals(value(map_col, key), x), F.lit(False)))
    return out


def meaning() -> list[Column]:
    """What a span is about, http or database, and its title, from new and old attribute names."""
    text = lambda *keys: F.coalesce(*[text_of(F.try_element_at("attributes", F.lit(k))) for k in keys])
    method, route = text("http.request.method", "http.method"), text("http.route", "url.path", "http.target")
    system = text("db.system.name", "db.system")
    kind = F.when(method.isNotNull(), "http").when(system.isNotNull(), "database")
    return [kind.alias("meaning"), F.when(method.isNotNull(), F.concat_ws(" ", method, route)).otherwise(system).alias("title")]


def services(spans: DataFrame, logs: DataFrame) -> DataFrame:
    """Per service: HTTP requests with their errors and percentiles, all spans, logs, error logs. Most requests first, then most logs, then by name."""
    http = spans.filter((F.col("kind") == KINDS["server"]) & has("attributes", "http.request.method"))
    requests = span_groups(http, {"service": F.col("service")}).select("service", F.col("n").alias("requests"), F.col("errors").alias("failed"), "p50", "p95", "p99")
    all_spans = spans.groupBy("service").agg(F.count(F.lit(1)).alias("spans"))
    lines = logs.groupBy("service").agg(F.count(F.lit(1)).alias("logs"), F.count_if(F.col("severity") >= 17).alias("error_logs"))
    joined = all_spans.join(lines, "service", "full").join(requests, "service", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("requests", "failed", "spans", "logs", "error_logs")]
    return joined.select("service", *counts, "p50", "p95", "p99").orderBy(F.desc("requests"), F.desc("logs"), "service")


def service_steps(spans: DataFrame, logs: DataFrame, r: Range, step: int) -> DataFrame:
    """Requests, failed requests, logs and error logs of every service that has any in the range, by step, zero filled."""
    columns = ["requests", "failed", "logs", "error_logs"]
    http = F.when((F.col("kind") == KINDS["server"]) & has("attributes", "http.request.method"), 1).otherwise(0)
    a = within(spans, "started_at", r).select("service", step_of(F.col("started_at"), step).alias("step_at"), http.alias("requests"), (http * (F.col("status") == 2).cast("int")).alias("failed"), F.lit(0).alias("logs"), F.lit(0).alias("error_logs"))
    b = within(logs, "logged_at", r).select("service", step_of(F.col("logged_at"), step).alias("step_at"), F.lit(0).alias("requests"), F.lit(0).alias("failed"), F.lit(1).alias("logs"), (F.col("severity") >= 17).cast("int").alias("error_logs"))
    cells = a.unionByName(b).groupBy("service", "step_at").agg(*[F.sum(c).alias(c) for c in columns])
    names = cells.select("service").distinct().orderBy("service").limit(group_limit(10_000, r.steps(step)))
    return zero_filled(cells, names, r, step, columns)


def resource_of_service(records: DataFrame) -> DataFrame:
    """The resource of each service in (service, resource, at, row_id) of logs and spans: one with attributes before one
    without, then that of the newest record, then the highest row."""
    rank = F.struct(F.size("resource") > 0, "at", "row_id")
    return records.groupBy("service").agg(F.max_by("resource", rank).alias("resource"), F.max("at").alias("newest_at"))


def trace_list(spans: DataFrame, condition: Column, roots_in: Column, limit: int, order: str = "newest", cursor: list | None = None) -> DataFrame:
    """Traces with a root in range and any matching span; the page's span count and errors are over the whole trace."""
    matching = spans.filter(condition).select("trace_id").distinct()
    roots = spans.filter(F.col("parent_span_id").isNull() & roots_in).join(matching, "trace_id", "left_semi")
    page = ordered(roots, order, limit, cursor)
    stats = spans.join(F.broadcast(page.select("trace_id")), "trace_id", "left_semi").groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_spans"), F.max(F.col("status") == 2).alias("failed"))
    return page.join(stats, "trace_id").select("trace_id", "name", "service", "started_at", "duration_ns", "n_spans", "failed")


def trace_summaries(spans: DataFrame) -> DataFrame:
    """Per trace: spans, errors, length from the first start to the last end."""
    end = F.max(F.col("started_at") + F.col("duration_ns"))
    return spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_spans"), F.count_if(F.col("status") == 2).alias("errors"), (end - F.min("started_at")).alias("length_ns"), F.min("started_at").alias("started_at"))


def trace_trees(spans: DataFrame, per_task: int = 200_000, per_trace: int = 200_000) -> DataFrame:
    """Rows of each trace's tree in depth-first order: place, depth, children, offset.

    A span whose parent is missing is a root; siblings are in order of start; spans in a cycle of parents come last, the
    first reached as a root. Traces are dealt to tasks whole, about per_task spans together; those of more than per_trace
    spans are spread over all tasks instead, with the same rows.
    """

    def trees(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["trace_id", "started_at", "row_id"], kind="stable")
        trace, span, parent, start = (rows[c].tolist() for c in ("trace_id", "span_id", "parent_span_id", "started_at"))
        out: list[tuple] = []
        a = 0
        while a < len(trace):
            z = a + 1
            while z < len(trace) and trace[z] == trace[a]:
                z += 1
            at = {span[k]: k for k in range(z - 1, a - 1, -1)}
            below: dict[int, list[int]] = {}
            roots = []
            for k in range(a, z):
                up = at.get(parent[k])
                roots.append(k) if up is None or up == k else below.setdefault(up, []).append(k)
            seen: set[int] = set()
            first = len(out)
            for root in (*roots, *range(a, z)):  # what only a cycle reaches comes last
                stack = [(root, 0)]
                while stack:
                    k, depth = stack.pop()
                    if k not in seen:
                        seen.add(k)
                        out.append((trace[k], span[k], len(out) - first, depth, len(below.get(k, ())), start[k] - start[a]))
                        stack += [(c, depth + 1) for c in reversed(below.get(k, ())) if c not in seen]
            a = z
        return pd.DataFrame(out, columns=["trace_id", "span_id", "place", "depth", "children", "offset_ns"])

    sizes = spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("__n"))
    count, most = sizes.agg(F.sum("__n"), F.max("__n")).first()
    tasks = max(1, -(-(count or 0) // per_task))
    if (most or 0) > per_trace:
        large = sizes.filter(F.col("__n") > per_trace).select("trace_id")
        found = large_trace_trees(spans.join(large, "trace_id", "left_semi"))
        return found.unionByName(trace_trees(spans.join(large, "trace_id", "left_anti"), per_task, per_trace))
    dealt = spans.select("trace_id", "span_id", "parent_span_id", "started_at", "row_id", F.pmod(F.xxhash64("trace_id"), F.lit(tasks)).alias("task"))
    return dealt.groupBy("task").applyInPandas(trees, "trace_id string, span_id string, place int, depth int, children int, offset_ns long")


def span_steps(spans: DataFrame, step: int) -> DataFrame:
    """Measures of each step: count, rate a second, errors, error rate."""
    found = spans.groupBy(step_of(F.col("started_at"), step).alias("step_at")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == 2).alias("errors"))
    return found.withColumns({"rate": F.col("n") / F.lit(step / 1e9), "error_rate": F.try_divide(F.col("errors"), F.col("n"))})
