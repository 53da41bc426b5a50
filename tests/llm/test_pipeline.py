"""The corpus pipeline: stages act on their own input, and their union equals brute force."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from featurelens.llm.queries import ORACLES, QUERIES
from tests.llm.test_near_copies import groups_by_hand
from tests.llm.test_operators import contamination_by_hand, lines_by_hand
from tools.check import TABLES, compare


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    verdict, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert verdict.startswith("match"), verdict


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(100_000, None, "en", "src0", 0), (100_001, "1 2 3", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [n for n, _ in corpus_pipeline.STAGES] and len(stages) == 5

    def step(name, df):
        return spark.createDataFrame(stages[name](spark, df, sf).collect(), df.schema)

    known = step("language", docs)
    assert known.columns == columns and {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in known.collect()} == {100_000, 100_001}

    lines = step("lines", known)
    want = lines_by_hand(sorted((r["doc_id"], r["text"]) for r in known.collect()))
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {i: t for i, (n, gone, t) in want.items() if not gone or gone < n}

    single = step("near_duplicates", lines)
    rows = sorted((r["doc_id"], r["text"]) for r in lines.collect())
    assert sorted(r["doc_id"] for r in single.collect()) == [rows[i][0] for i in sorted(set(groups_by_hand([t for _, t in rows])))]

    clean = step("decontamination", single)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in single.collect() if not contamination_by_hand(r["text"], items)[3])

    mixed = step("mix", clean)
    ids = {r["doc_id"] for r in clean.collect()}
    assert {r["doc_id"] for r in mixed.collect()} <= ids and mixed.columns == columns


def test_run_equals_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    key = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(docs)
