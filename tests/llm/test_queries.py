"""Registered queries against their oracles, and the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import compare, connect
from conftest import SMALL
from crewline.llm.common import materialize, read_table
from crewline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert not compare(spark, connect(SMALL), SMALL, QUERIES[name], ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))


def test_pipeline(spark):
    docs = read_table(spark, SMALL, "documents")
    columns, counts = docs.columns, [docs.count()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, SMALL))
        counts.append(docs.count())
        assert n == 4 or docs.columns == columns
    assert counts[0] > counts[1] >= counts[2] >= counts[3] <= counts[4] == counts[5]
    assert docs.where("NOT round_trip").count() == 0


def test_near_copies_are_judged_by_row(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, a), (2, a), (2, b), (3, b + " end"), (None, a), (4, ""), (4, "")]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a), (2, b), (None, a), (4, ""), (4, "")], key=str)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b\nc\nd", "de", "s", 7)]])
def test_stages_on_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"score": F.lit(1), "rate": F.lit("r"), "ids": F.lit(2), "n": F.lit(3), "copies": F.lit(0)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert name.startswith("Sentence") or out.columns == docs.columns
        assert (out.count() > 0) == bool(rows)
