"""One row of each near-duplicate group: brute force, repeated and null ids, edited copies."""

import random

import pytest
from pyspark.sql import functions as F

from featurelens.llm import simhash
from tests.llm.test_operators import odd, prose, table  # noqa: F401


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def groups_by_hand(texts):
    """Group number of every text, by comparing all pairs."""
    prints = [(simhash.simhash((t or "").encode()), *simhash.word_hashes((t or "").encode())) for t in texts]
    low = list(range(len(texts)))

    def near(a, b):
        apart = [(x ^ y).bit_count() for x, y in zip(a, b)]
        return apart[0] <= 2 or (apart[0] <= simhash.SHINGLE_SLACK and min(apart[1:]) <= simhash.WIDE_BUDGET)

    links = [(i, j) for i in range(len(texts)) for j in range(i) if near(prints[i], prints[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    return low


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = rng.choice("abcdefgh") * 9
    return " ".join(words)


@pytest.mark.parametrize("leaf", [6, simhash.LEAF])
def test_edited_copies(spark, leaf):
    rng = random.Random(11)
    # words of a large vocabulary, as in texts that are not copies of each other
    vocabulary = [prose(rng, 1) + rng.choice("xyzw") * rng.randint(1, 3) + str(n) for n in range(4000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(120, 250))) for _ in range(40)]
    copies = [edited(rng, t, 3) for t in texts for _ in range(2)]
    same_words = []
    for _ in range(12):                                     # equal word fingerprints, other shingles
        words = texts[0].split()
        rng.shuffle(words)
        same_words.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts + copies + same_words)]
    kept = {r["doc_id"] for r in simhash.one_of_each(table(spark, rows).repartition(3), leaf=leaf).collect()}
    low = groups_by_hand([t for _, t in rows])
    assert kept == set(low)
    caught = sum(i not in kept for i in range(40, 120))
    assert caught >= 0.9 * 80 and set(range(40)) <= kept and set(range(120, 132)) <= kept


def test_every_text_keeps_a_row(spark):
    rng = random.Random(2)
    a, b, c = (prose(rng, 60, [f"w{rng.random()}" for _ in range(200)]) for _ in range(3))
    rows = [(5, a), (5, b), (9, b), (None, c), (None, c), (7, c), (None, "alone on its own here"), (None, "alone on its own here"), (1, None), (2, ""), (None, " ")]
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.one_of_each(table(spark, rows)).collect()), key=str)
    assert got == sorted([(5, a), (5, b), (7, c), (None, "alone on its own here"), (1, None)], key=str)


def test_odd_rows_and_none(spark, odd):  # noqa: F811
    more = odd.withColumn("node", F.lit("mine")).withColumn("low", F.lit(1)).withColumn("_h1", F.lit(2)).withColumn("_n", F.lit(3))
    rows = [(r["doc_id"], r["text"]) for r in more.collect()]
    low = groups_by_hand([t for _, t in rows])
    kept = simhash.one_of_each(more)
    assert kept.columns == more.columns and kept.count() == len(set(low))
    assert simhash.one_of_each(more.limit(0)).count() == 0
