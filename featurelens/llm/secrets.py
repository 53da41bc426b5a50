"""Operator 2: secret scan. Candidates from patterns; a random forest over their shape and context removes false positives."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from featurelens.llm.text import bounded_sample, checkpointed, held_out, pieces

SAMPLE = 5000           # labelled findings of each class that the forest is fitted on
TREES, DEPTH = 40, 8
DICTIONARY = 20_000     # most frequent words of all documents
COUNTED = 200_000       # words that a task holds before it hands on their counts
SHORTEST = 8
KEPT = 0.5
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789"     # characters of the transition model; others are one more

# Words that announce a secret, and those that mark a stand-in.
KEYWORDS = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "private_key", "bearer"]
STAND_INS = ["example", "changeme", "placeholder", "your", "xxxx", "dummy", "sample", "test"]
TEST_PATHS = ["test", "example", "sample", "doc", "mock", "fixture"]

_token = re.compile(rb"[A-Za-z0-9_+/=\-.@:]{%d,}" % SHORTEST)
# a keyword, the rest of its name, a closing quote, the separator; then a value up to its quote, or up to a space, quote, comma or semicolon
_key = re.compile(rb"(?i)(?:%s)[\w-]{0,40}[\"']?\s{0,3}[:=]\s{0,3}([\"']?)" % "|".join(KEYWORDS).encode())
_plain = re.compile(rb"[^\s\"',;]{%d,}" % SHORTEST)
_quoted = {b'"': re.compile(rb'((?:[^\s"\\]|\\\S){%d,})"' % SHORTEST), b"'": re.compile(rb"([^\s']{%d,})'" % SHORTEST)}
_named = re.compile(rb"[\w-]+[:=]+")
_prefix = re.compile(rb"(?i)^(?:%s)[:=]+" % "|".join(KEYWORDS).encode())
_letters = re.compile(rb"[A-Za-z]{3,}")
_word = re.compile(rb"[a-z]{3,}")
FEATURES = ["length", "letters", "digits", "upper", "symbols", "switches", "entropy", "transitions", "dictionary", "hex", "runs",
            "keyword near", "keyword before", "assigned", "quoted", "stand-in", "path depth", "test path", "words around"]
SHAPE = "doc_id long, start long, length int, sha256 string, label int, features array<double>"


@dataclass
class CorpusModel:
    """Transition log-probabilities of the letters of all documents, and their most frequent words."""

    transitions: np.ndarray
    words: frozenset[bytes]


_code = np.full(256, len(SYMBOLS), np.int64)
for _i, _c in enumerate(SYMBOLS):
    _code[[ord(_c), ord(_c.upper())]] = _i


def corpus_model(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY) -> CorpusModel:
    """Counted over all documents. A task that holds ``COUNTED`` words hands their counts on and starts anew, so counts are exact."""
    side = len(SYMBOLS) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, seen = np.zeros(side * side, np.int64), Counter()

        def rows(keys: list[bytes], counts: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], ["key", "n"])

        for batch in batches:
            for text in batch.column(0):
                for part in pieces(text.as_py() or b""):
                    code = _code[np.frombuffer(part, np.uint8)]
                    pairs += np.bincount(code[:-1] * side + code[1:], minlength=side * side)
                    seen.update(_word.findall(part.lower()))
                    if len(seen) > COUNTED:
                        yield rows(list(seen), list(seen.values()))
                        seen.clear()
        yield rows([*(b"#%d" % i for i in range(side * side)), *seen], [*pairs.tolist(), *seen.values()])

    totals = checkpointed(docs.select(F.col(text_col).cast("binary")).mapInArrow(count, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n")))
    is_pair = F.col("key").cast("string").startswith("#")
    pairs = np.ones(side * side)
    for row in totals.where(is_pair).collect():
        pairs[int(bytes(row["key"])[1:])] += row["n"]
    pairs = pairs.reshape(side, side)
    # classes of counts, 16 for each doubling, tell which counts can be among the highest; only those are ordered
    counted = totals.where(~is_pair).withColumn("level", F.floor(16 * F.log2("n")).cast("int"))
    least, held = 0, 0
    for row in counted.groupBy("level").count().orderBy(F.desc("level")).collect():
        least, held = row["level"], held + row["count"]
        if held >= words:
            break
    top = counted.where(F.col("level") >= least).orderBy(F.desc("n"), "key").limit(words).collect()
    return CorpusModel(np.log(pairs / pairs.sum(axis=1, keepdims=True)), frozenset(bytes(r["key"]) for r in top))


def candidates(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Byte offset and value of what could be a secret: values given to a keyword, and tokens of letters and digits."""
    found, end = {}, 0
    for m in _key.finditer(text):
        at = m.end()
        if at < end:            # inside the value before
            continue
        value = (q := _quoted.get(m[1])) and (v := q.match(text, at)) and v[1] or (v := _plain.match(text, at)) and v[0]
        if value:
            found[at], end = value, at + len(value)
    for m in _token.finditer(text):
        value = m[0]
        start = m.start()
        if (named := _named.match(value)) and start + named.end() in found:
            continue
        if lead := _prefix.match(value):
            value, start = value[lead.end():], start + lead.end()
        value = value.rstrip(b".:-")
        if start not in found and len(value) >= SHORTEST and re.search(rb"\d", value) and re.search(rb"[A-Za-z]", value):
            found[start] = value
    yield from sorted(found.items())


def describe(text: bytes, start: int, value: bytes, path: str, model: CorpusModel) -> list[float]:
    n = len(value)
    lower = value.lower()
    counts = Counter(value)
    kinds = "".join("d" if 48 <= c < 58 else "u" if 65 <= c < 91 else "l" if 97 <= c < 123 else "s" for c in value)
    code = _code[np.frombuffer(value, np.uint8)]
    steps = model.transitions[code[:-1], code[1:]]
    covered = 0
    for run in _letters.findall(lower):
        at = 0
        while at < len(run):           # longest dictionary word first
            size = next((s for s in range(min(len(run) - at, 12), 2, -1) if run[at:at + s] in model.words), 0)
            covered += size
            at += size or 1
    before, after = text[max(0, start - 60):start].lower(), text[start + n:start + n + 60].lower()
    near = before.split()[-5:] + after.split()[:5]
    around = [w for w in _word.findall(b" ".join(near))]
    lead = before.rstrip()
    return [float(x) for x in (
        math.log1p(n), kinds.count("l") / n, kinds.count("d") / n, kinds.count("u") / n, kinds.count("s") / n, sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()), steps.mean() if len(steps) else 0.0, covered / n, sum(c in b"0123456789abcdef" for c in lower) / n,
        max(counts.values()) / n, any(k.encode() in w for w in near for k in KEYWORDS), any(k.encode() in before[-24:] for k in KEYWORDS), lead[-1:] in (b"=", b":") or lead[-2:-1] in (b"=", b":") or lead[:-1].rstrip()[-1:] in (b"=", b":"),
        lead[-1:] in (b'"', b"'"), any(s.encode() in lower for s in STAND_INS), path.count("/"), any(t in path.lower() for t in TEST_PATHS),
        sum(w in model.words for w in around) / max(len(around), 1))]


def known_label(text: bytes, start: int, value: bytes) -> int | None:
    """Label of a finding that its format proves: 1 a credential of a known issuer format, 0 a stand-in, address or name; else None."""
    if any(s.encode() in value.lower() for s in STAND_INS):
        return 0
    if re.fullmatch(rb"AKIA[A-Z0-9]{16}", value):
        return 1
    lead = text[max(0, start - 24):start].lower()
    if re.search(rb"(?:password|token|secret|api_?key)\s*[:=]\s*[\"']?$", lead) and re.fullmatch(rb"[0-9a-f]{16,64}", value):
        return 1
    if b"@" in value or re.fullmatch(rb"[\d.:/\-]+", value) or b"://" in value or value.lower().startswith(b"www."):
        return 0
    return None


def scan(docs: DataFrame, model: CorpusModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``doc_id, start, length, sha256, label, features``: all candidates of whole texts; ``label`` where the format proves it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, path in zip(*(c.to_pylist() for c in batch.columns)):
                for start, value in candidates(text or b""):
                    out.append((doc_id, start, len(value), hashlib.sha256(value).hexdigest(), known_label(text, start, value), describe(text, start, value, path or "", shared.value)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["doc_id", "start", "length", "sha256", "label", "features"])

    path = F.col(path_col).cast("string") if path_col and path_col in docs.columns else F.lit("")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), path.alias("path")).mapInArrow(run, SHAPE)


def find_secrets(docs: DataFrame, findings: DataFrame | None = None, sample: int = SAMPLE, trees: int = TREES, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``doc_id, start, length, sha256, held_out, label, score, kept``: each candidate with the forest's probability of a real secret.

    ``findings(doc_id, start, label)`` are labelled findings; without them, those whose format proves the label serve. Only findings
    outside the held-out fifth are learned from, at most ``sample`` of each class (smallest hashes). The features do not
    hold the label's rule. ``start`` and ``length`` are bytes of the UTF-8 text; the value itself is not returned. Null and empty texts
    and an empty table give no rows; a null path is an empty one; repeated rows give repeated findings. With one class of
    labels the score is that label; without any it is 1, so that nothing is removed.
    """
    rows = checkpointed(scan(docs, corpus_model(docs, text_col), id_col, text_col, path_col))
    learn = rows.where(~held_out("doc_id"))
    if findings is not None:
        given = findings.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("start").cast("bigint").alias("start"), F.col("label").cast("int").alias("label")).dropDuplicates(["doc_id", "start"])
        learn = learn.drop("label").join(given, ["doc_id", "start"])
    learn = bounded_sample(learn.where(F.col("label").isin(0, 1)).withColumn("o", F.xxhash64("doc_id", "start", "sha256")), "label", "o", sample)
    learn = checkpointed(learn.orderBy("o").select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features")))
    classes = [r["label"] for r in learn.select("label").distinct().collect()]
    plain = [F.col(c) for c in ("doc_id", "start", "length", "sha256")] + [held_out("doc_id").alias("held_out"), F.col("label").alias("label")]
    if len(classes) < 2:
        out = rows.select(*plain, F.lit(classes[0] if classes else 1.0).alias("score"))
    else:
        forest = RandomForestClassifier(numTrees=trees, maxDepth=DEPTH, seed=7).fit(learn)
        vectors = rows.withColumnRenamed("features", "_f").withColumn("features", array_to_vector("_f"))
        out = forest.transform(vectors).select(*plain, vector_to_array("probability")[1].alias("score"))
    return out.withColumn("kept", F.col("score") >= KEPT)
