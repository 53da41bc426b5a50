"""Token files, fill-in-middle and the prefix trie against brute force, with nulls, blanks, ties, repeats and clashing columns."""

import hashlib
import json
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from featurelens.llm import fim, prefixtrie, tokenfiles
from tests.llm.test_operators import DOCS, odd, prose, table  # noqa: F401

PATH = public_tokenizers.path("byte_bpe_50k.json")
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture(scope="module")
def coder():
    return Tokenizer.from_file(PATH)


# ---------------------------------------------------------------- token files

def documents_by_hand(rows, coder):
    """doc_id, start, n_tokens, crc in file order; rows that repeat an id may stand in either order."""
    return {(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows for ids in [coder.encode(t or "", add_special_tokens=False).ids + [2]]}


def test_files_hold_all_documents(spark, odd, coder):  # noqa: F811
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    path = tokenfiles.write_token_files(odd, PATH, file_ids=1000)
    got = sorted(tokenfiles.read_token_files(spark, path, "documents").collect(), key=lambda r: r["start"])
    assert len(got) == len(rows) and {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got} == documents_by_hand(rows, coder)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    assert len(tokenfiles.manifest(path)["files"]) > 4
    assert tokenfiles.read_token_files(spark, path, "index").count() == len(rows)


def test_parts_give_the_ids_back(spark, odd, coder):  # noqa: F811
    path = tokenfiles.write_token_files(odd.where("doc_id in (103, 104, 5)"), PATH)
    parts = {}
    for r in sorted(tokenfiles.read_token_files(spark, path).collect(), key=lambda r: r["part"]):
        parts.setdefault(r["doc_id"], []).append(bytes(r["ids"]))
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(parts) == 3
    for i, held in parts.items():
        assert tokenfiles.ids_of(held).tolist() == coder.encode(texts[i], add_special_tokens=False).ids + [2]


def test_requests_read_only_their_frames(spark, odd, coder):  # noqa: F811
    path = tokenfiles.write_token_files(odd, PATH)
    place = path.removeprefix("file:")
    # damage every frame but that of document 7: a request for it alone must not notice
    for f in tokenfiles.manifest(path)["files"]:
        name = os.path.join(place, f["name"])
        with tokenfiles._place(name)[0].open_input_file(tokenfiles._place(name)[1]) as file:
            source = tokenfiles.FrameReader(file)
        ids = source.docs.column("doc_id").to_pylist()
        raw = bytearray(open(name, "rb").read())
        for n, doc in enumerate(ids):
            if doc != 7:
                for k in range(int(source.first[n]), int(source.first[n + 1])):
                    raw[int(source.offsets[k + 1]) - 1] ^= 255
        open(name, "wb").write(raw)
    wanted = spark.createDataFrame([(7,), (7,), (None,), (-1,)], "doc_id long")
    got = tokenfiles.requested_documents(path, wanted).collect()
    text = next(r["text"] for r in odd.collect() if r["doc_id"] == 7)
    assert [tokenfiles.ids_of([r["ids"]]).tolist() for r in got] == [coder.encode(text, add_special_tokens=False).ids + [2]]
    with pytest.raises(Exception, match="frame|decompress"):
        tokenfiles.read_token_files(spark, path, "documents").collect()


def test_files_are_plain_zstandard(spark, coder):
    import zstandard
    path = tokenfiles.write_token_files(table(spark, [(2, "two words"), (1, "one")]).coalesce(1), PATH)
    names = [f["name"] for f in tokenfiles.manifest(path)["files"]]
    ids = []
    for n in names:
        with open(os.path.join(path.removeprefix("file:"), n), "rb") as f:
            ids += np.frombuffer(zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read(), "<u4").tolist()
    assert ids == [*coder.encode("one").ids, 2, *coder.encode("two words").ids, 2]


def test_text_ids_and_empty_table(spark, coder):
    docs = spark.createDataFrame([("b", "x y"), (None, "q"), ("a", None)], "doc_id string, text string")
    got = sorted(tokenfiles.read_token_files(spark, tokenfiles.write_token_files(docs, PATH), "documents").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, "a", "b"]
    path = tokenfiles.write_token_files(docs.limit(0), PATH)
    assert tokenfiles.manifest(path)["files"] == [] and tokenfiles.read_token_files(spark, path, "documents").count() == 0
    assert json.loads(json.dumps(tokenfiles.manifest(path)))["id_type"] == "string"


def test_pieces_tokenize_alike(coder):
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice([" ", "  ", "\n", "a", "Bc", "12", "'s", "!", "ü", "…", " ", "　", "<|endoftext|>"]) for _ in range(400))
        pieces = list(tokenfiles.safe_pieces(text, 37))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in coder.encode(p, add_special_tokens=False).ids] == coder.encode(text, add_special_tokens=False).ids


# ---------------------------------------------------------------- fill in the middle

def middle_by_hand(doc_id, text):
    text = text or ""
    units = re.findall("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark, odd):  # noqa: F811
    rng = random.Random(8)
    rows = [(200 + i, "".join(rng.choice([" ", "\t", "\n", "ab", "ü", "x", "€", "𝄞", "<", "P>", "S>", " "]) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    more = table(spark, rows)
    for c in odd.columns[5:]:
        more = more.withColumn(c, F.lit("mine"))
    docs = odd.unionByName(more)
    made = fim.fill_in_middle(docs).withColumn("_again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(made) == docs.count() and {r["form"] for r in made} == {"plain", "spm", "psm"}
    for r in made:
        assert tuple(r[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) == middle_by_hand(r["_row"]["doc_id"], r["_row"]["text"])
        assert r["_again"] == (r["_row"]["text"] or "") and r["_row"]["score"] == "mine"
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind, offsets", [
    ("array", np.cumsum(np.random.default_rng(1).integers(2, 300, 3000))),
    ("bitmap", np.cumsum(np.random.default_rng(2).integers(2, 4, 200_000))),
    ("runs", np.arange(1, 300_000)),
])
def test_containers(kind, offsets):
    held = fim.BoundarySet()
    for part in np.array_split(offsets, 7):
        held.add(part)
    held.close()
    assert len(held) == len(offsets) and kind in {k for k, _ in held.containers}
    for rank in [0, len(offsets) - 1, *random.Random(4).sample(range(len(offsets)), 500)]:
        assert held.select(rank) == offsets[rank]


def test_cut_at_characters(spark):
    docs = table(spark, [(i, "ab cü€ " * 20_000) for i in range(12)])
    made = fim.fill_in_middle(docs, unit="characters", cut_share=100).collect()
    assert {r["n"] for r in made} == {7 * 20_000}
    for r in made:
        text = r["_row"]["text"]
        a, m = r["prefix_chars"], r["middle_chars"]
        assert r["output"] in (f"<S>{text[a + m:]}<P>{text[:a]}<M>{text[a:a + m]}", f"<P>{text[:a]}<S>{text[a + m:]}<M>{text[a:a + m]}")


# ---------------------------------------------------------------- prefix trie

def trie_by_hand(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members, kids, totals = {}, {}, {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        totals[p] = (sum(totals[q][0] for q in below) or 1, sum(totals[q][1] for q in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0))
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_trie(spark, seed, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK", 3)          # long conversations in several chunks
    monkeypatch.setattr(prefixtrie, "PACK_BYTES", 20)    # many members in several packs
    rng = random.Random(seed)
    rows = []
    for c in [*rng.sample(range(-250, 700), 120), 0, 100, 200, None]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 21])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "bot", None]), rng.choice(["a", "bb", "ü€", None, ""])))
    rows += [(c, t, "user", "a") for c in range(1000, 1040) for t in range(12)] + [rows[0], rows[0]]
    rows += [(2000, t, "user", "long " * (t % 3)) for t in range(150)]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    for c in ("low", "depth", "place", "item", "size", "conv", "p1"):
        df = df.withColumn(c, F.lit("mine"))
    assert trie_rows(prefixtrie.prefix_trie(df)) == trie_by_hand(rows)


def test_small_tries(spark):
    df = spark.createDataFrame([], TURNS)
    assert prefixtrie.prefix_trie(df).count() == 0
    assert prefixtrie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0
    alone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    turnless = [(alone, 0, "user", "x")]                 # its only turn is replaced by turns of a conversation that is not there
    assert trie_rows(prefixtrie.prefix_trie(spark.createDataFrame(turnless, TURNS))) == trie_by_hand(turnless)
    one = [(300, 0, "user", "x" * 100_000), (300, 1, None, None)]
    assert trie_rows(prefixtrie.prefix_trie(spark.createDataFrame(one, TURNS))) == trie_by_hand(one)
