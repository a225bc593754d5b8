"""The registered queries of the subpackage and the pipeline on the smallest tables."""

import os
import random

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from eventloom.llm import decontam, languages, lines, neardup
from eventloom.llm.queries import QUERIES, SQL
from tests.check_oracles import compare
from tests.llm.conftest import prose

SF_DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no generated tables")


def test_all_are_registered():
    assert len(QUERIES) == 13
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


@tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    ok, note = compare(spark, name, SF_DIR)
    assert ok, note


@tables
def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.count() > 0
    assert rows.where("not round_trip").count() == 0
    assert rows.count() == rows.select("doc_id").distinct().count()


def test_stages_by_brute_force(spark, documents, tmp_path, vocabulary):
    """Each stage's effect on planted rows, and clean rows that pass all of them unchanged."""
    rng = random.Random(20)
    clean = [(i, prose(rng, 60), "en") for i in range(30)]
    item = prose(rng, 30)
    passage = prose(rng, 60)
    rows = clean + [
        (100, clean[3][1], "en"), (101, clean[4][1].replace(" ", "  ", 2), "en"),
        (102, f"{prose(rng, 40)} {item} {prose(rng, 5)}", "en"),
        (103, f"{passage}\n{prose(rng, 50)}", "en"), (104, f"{prose(rng, 50)}\n{passage}", "en"),
        (105, "12 34 !", "en"), (106, None, None)]
    sf = str(tmp_path)
    documents(rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    # Of a text and its copy one stays, whichever comes first in the table.
    assert {d for d, *_ in clean} - {3, 4} <= set(got)
    assert len({3, 100} & set(got)) == len({4, 101} & set(got)) == 1
    assert not {102, 105, 106} & set(got)
    assert {103, 104} <= set(got)
    assert got[103].n_tokens != got[104].n_tokens
    columns = documents(rows).columns
    docs = documents(rows)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    for stage in (languages.keep_known, lines.dedup, neardup.dedup, lambda d: decontam.clean(d, bench)):
        assert stage(docs).columns == columns
