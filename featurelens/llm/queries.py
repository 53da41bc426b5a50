"""The registered queries of the document operators, over whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from featurelens.llm import decontam, fim, language, linededup, mixing, prefixtrie, quality, secrets, simhash, suffix, tokenfiles, topk, toxicity

QUALITY_AT, TOXIC_AT = 0.3, 0.5
TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_mix(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("_row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf, "documents"))


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, _table(spark, sf, "benchmark"))
    return found.select("_row.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.fit_language(language.training_rows(docs))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("_row.doc_id", language.held_out(F.col("_row.doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op6_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("_row.doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("text_sha256"))


def op7_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.quality(_table(spark, sf, "documents"), _table(spark, sf, "labels"))
    return found.withColumn("predicted", (F.col("score") >= QUALITY_AT).cast("int"))


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    found = toxicity.toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))
    return found.withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int"))


def op10_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.repeated_passages(_table(spark, sf, "documents").select("doc_id", "text")).drop("_k1", "_k2")


def op11_token_files(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers
    folder = tokenfiles.write_token_files(_table(spark, sf, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return tokenfiles.read_token_files(spark, folder, "documents")


def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    made = fim.fill_in_middle(_table(spark, sf, "documents").select("doc_id", "text"))
    return made.select("_row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefixtrie.prefix_trie(_table(spark, sf, "conversations")).drop("n_ends")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix, op2_secrets, op3_simhash, op4_decontaminate, op5_language, op6_lines, op7_top_k, op8_quality, op9_toxicity, op10_suffixes,
                            op11_token_files, op12_fill_in_middle, op13_prefix_trie)}

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), text, '')) AS h, text FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS room FROM w),
c AS (SELECT *, SUM(cap) OVER o - cap AS caps, SUM(weight) OVER o - weight AS weights, SUM(source_size) OVER () AS total, SUM(weight) OVER () AS all_weight,
             row_number() OVER o AS place FROM r WINDOW o AS (ORDER BY room, source NULLS LAST)),
l AS (SELECT *, CAST(total - caps AS DOUBLE) / CAST(all_weight - weights AS DOUBLE) AS level FROM c),
g AS (SELECT level AS common FROM l WHERE level <= room ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, LEAST(CAST(cap AS DOUBLE), weight * common) AS target,
             CAST(('0x' || substr(md5('mix' || COALESCE('s' || source, 'n')), 1, 5)) AS BIGINT) / 1048576.0::DOUBLE AS u FROM l, g),
n AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY d.source ORDER BY len(bin(d.size)) * 16 + (d.size >> GREATEST(len(bin(d.size)) - 4, 0)), d.h, d.size, md5(d.text) NULLS FIRST) AS i
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(u + i * rate) - floor(u + (i - 1) * rate)) * size AS BIGINT) AS taken FROM n
"""

DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, LEAST(len(w), 13) AS n, array_to_string(list_slice(w, i, i + LEAST(len(w), 13) - 1), ' ') AS win
       FROM (SELECT *, unnest(range(1, GREATEST(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, COALESCE(len(d.w), 0)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
       sha256(COALESCE(names, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= COALESCE(len(d.w), 0) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

LINES_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, list_slice(l, i, i + 2) AS win FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3)
      WHERE regexp_matches(array_to_string(list_slice(l, i, i + 2), ''), '[^\x20\x09-\x0D]')),
f AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS FIRST, i) AS nth FROM w),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM f WHERE nth > 1) GROUP BY doc_id)
SELECT d.doc_id, COALESCE(len(l), 0)::BIGINT AS n_lines, COALESCE(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN text ELSE array_to_string([x for x, i in l if NOT list_contains(gone, i)], chr(10)) END) AS text_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

TOP_K_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10
"""

FILL_IN_MIDDLE_SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, sha256('42:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
             [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS r FROM d),
c AS (SELECT *, len(w) AS n, LEAST(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS a, GREATEST(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
                  WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT *, COALESCE(array_to_string(list_slice(w, 1, a), ''), '') AS pre, COALESCE(array_to_string(list_slice(w, a + 1, b), ''), '') AS mid,
             COALESCE(array_to_string(list_slice(w, b + 1, n), ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

# CRC-32 has no function in this dialect: eight shifts for each byte of the decimal id.
PREFIX_TRIE_SQL = """
WITH t AS (SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(CAST(length(COALESCE(role, '')) AS VARCHAR) || ':' || COALESCE(role, '') || COALESCE(text, ''))) AS place
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295::BIGINT, list_reduce([ascii(x)::BIGINT FOR x IN string_split(CAST(conv_id AS VARCHAR), '')],
             lambda crc, byte : list_reduce([0::BIGINT, 1, 2, 3, 4, 5, 6, 7], lambda x, i : xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)), 4294967295::BIGINT)) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, t.place AS k, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.place <= c.h
      UNION ALL SELECT c.conv_id, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, role, text FROM b),
p AS (SELECT *, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r),
n AS (SELECT path, depth, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, MIN(length(text)) AS size FROM p GROUP BY path, depth
      UNION ALL SELECT [], 0, MIN(conv_id), COUNT(*), 0 FROM c HAVING COUNT(*) > 0),
u AS (SELECT n.*, m.conv_id AS parent_conv_id FROM n LEFT JOIN n m ON n.depth > 0 AND m.depth = n.depth - 1 AND m.path = list_slice(n.path, 1, n.depth - 1)),
k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, COUNT(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
v AS (SELECT u.*, COALESCE(n_children, 0) AS n_children FROM u LEFT JOIN k USING (conv_id, depth)),
s AS (SELECT a.conv_id, a.depth, COUNT(*) FILTER (WHERE x.n_children = 0) AS n_leaves, CAST(SUM((x.n_convs - 1) * x.size) AS BIGINT) AS saved_tokens
      FROM v a JOIN v x ON x.depth >= a.depth AND list_slice(x.path, 1, a.depth) = a.path GROUP BY ALL),
l AS (SELECT c.conv_id, COALESCE(MAX(r.depth), 0) AS depth FROM c LEFT JOIN r USING (conv_id) GROUP BY ALL),
e AS (SELECT COALESCE(p.path, []) AS path, l.depth, string_agg(CAST(l.conv_id AS VARCHAR), ',' ORDER BY l.conv_id) AS ids FROM l LEFT JOIN p ON p.conv_id = l.conv_id AND p.depth = l.depth GROUP BY ALL)
SELECT v.conv_id, v.depth, v.parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, sha256(COALESCE(e.ids, '')) AS ends_sha256
FROM v JOIN s USING (conv_id, depth) LEFT JOIN e ON e.depth = v.depth AND e.path = v.path
"""

ORACLES: dict[str, str] = {"op1_mix": MIX_SQL, "op4_decontaminate": DECONTAMINATION_SQL, "op6_lines": LINES_SQL, "op7_top_k": TOP_K_SQL,
                           "op12_fill_in_middle": FILL_IN_MIDDLE_SQL, "op13_prefix_trie": PREFIX_TRIE_SQL}
