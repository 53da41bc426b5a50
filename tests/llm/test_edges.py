"""Ties of the mix and blank lines of every kind."""

import random

import pytest

from featurelens.llm import linededup, mixing
from tests.llm.test_operators import lines_by_hand, prose, table


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def test_mix_of_null_and_repeated_ids_is_free_of_the_partitioning(spark):
    rng = random.Random(9)
    rows = [(None, prose(rng, 6), "en", "a") for _ in range(300)] + [(4, prose(rng, 6), "en", "a") for _ in range(100)] + [(i, "one two", "en", "b") for i in range(200)]
    taken = []
    for n in (1, 3, 7):
        rng.shuffle(rows)
        out = mixing.mix(table(spark, rows).repartition(n)).where("copies > 0").select("_row.doc_id", "_row.text", "copies")
        taken.append(sorted(map(tuple, out.collect()), key=str))
    assert taken[0] == taken[1] == taken[2]


def test_blank_lines_of_any_white_space(spark):
    blank = ["\r", "\t", " ", "", "\x0b\x0c"]
    docs = [(1, "\n".join(["a", *blank, "b"])), (2, "\n".join(["c", *blank, "d"])), (3, "x\r\n\r\n\r\n\r\ny"), (4, "x\r\n\r\n\r\n\r\ny")]
    got = {r["_row"]["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_text"]) for r in linededup.dedup_lines(table(spark, docs)).collect()}
    assert got == lines_by_hand(docs) and got[2][1] == 0 and got[4][1] > 0
