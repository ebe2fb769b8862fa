"""The pipeline's stages on small tables against what they should do."""

import re
from collections import Counter

import pytest
from test_operators import brute_lines, components

import corpus_pipeline as pipeline
from lumenspan.llm.common import cut, read
from lumenspan.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def stages(spark, sf):
    found, docs = [read(spark, sf, "documents")], read(spark, sf, "documents")
    for name, stage in pipeline.STAGES:
        docs = cut(stage(spark, docs, sf), name)
        found.append(docs)
    return found


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality_keeps_the_good(stages, spark, sf):
    kept = {r["doc_id"] for r in stages[1].collect()}
    labels = read(spark, sf, "labels").collect()
    good, bad = [r["doc_id"] for r in labels if r["quality"] == 1], [r["doc_id"] for r in labels if r["quality"] == 0]
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i in kept for i in bad) <= 0.3 * len(bad) + 1


def test_lines_are_those_of_brute_force(stages):
    rows = sorted((r["doc_id"], r["text"]) for r in stages[1].collect())
    want = {i: t for (i, old), t in zip(rows, brute_lines(rows), strict=True) if t.strip() or t == old}
    found = {r["doc_id"]: r for r in stages[2].collect()}
    assert {i: r["text"] for i, r in found.items()} == want and all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_one_of_each_group_stays(stages):
    rows = stages[2].collect()
    groups = components([r["text"] for r in rows], [r["doc_id"] for r in rows])
    assert {r["doc_id"] for r in stages[3].collect()} == {i for i, _, low in groups if i == low}


def test_mix_repeats_whole_documents(stages):
    before = {r["doc_id"]: r for r in stages[3].collect()}
    uses = Counter(r["doc_id"] for r in stages[4].collect())
    assert set(uses) <= set(before) and max(uses.values()) <= 3
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, taken = sum(size(r["text"]) for r in before.values()), sum(n * size(before[i]["text"]) for i, n in uses.items())
    assert abs(taken - total) < 0.05 * total


def test_all_is_packed(stages):
    pieces = stages[5].toPandas()
    assert Counter(pieces[pieces["piece"] == 0]["doc_id"]) == Counter(r["doc_id"] for r in stages[4].collect())
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 4096


def test_rows_that_repeat_and_empty_tables(spark, sf):
    docs = read(spark, sf, "documents").limit(30)
    odd = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, None, None, None, None), (7, "", None, None, None)], docs.schema))
    for table in (odd, docs.filter("doc_id < 0")):
        for _, stage in pipeline.STAGES:
            stage(spark, table, sf).count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    from oracle import rows, tables

    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(tables(sf).sql(ORACLES[name]).df())
