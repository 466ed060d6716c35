"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.llm import conversations, gam, katz, langid, licenses, lines, mixing, multi_index, ngram_join, packing, pii, quantised, whitening
from panelcast.llm.sampling import remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return multi_index.nearest(rows, rows.where("vec_id % 50 = 0"))


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = gam.fit(docs, gam.train_part(table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    return gam.score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", predicted)


def op4_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.learn(docs)).drop("text")
    counts = [pii.count("base", i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.as_text("base"), 256).alias("base_sha256"), pii.as_text("spans").alias("spans"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer()).drop("ids")


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = katz.score(docs.withColumn("train", remainder("doc_id", 10) != 0), "train").withColumn("held_out", remainder("doc_id", 10) == 0)
    return scored.select("doc_id", "held_out", *[c for c in scored.columns if c not in ("doc_id", "held_out")])


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedupe_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(langid.train_part(docs))
    return langid.identify(docs.drop("lang"), model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))
    return conversations.report(pieces).withColumnRenamed("conv", "conv_id")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows)
    explained = F.array(*[F.lit(v / model["trace"]) for v in model["values"]], F.lit(None).cast("double"))
    each = whitening.whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    n, error = F.lit(model["n"]).cast("long").alias("n"), F.lit(model["identity_error"]).alias("identity_error")
    component, share = (F.col("at") + 1).alias("component"), F.element_at(explained, F.col("at") + 1).alias("explained")
    return each.select("vec_id", component, n, "deviation", "whitened", share, error)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.transform(base, lambda p: p["label"])).alias("base_labels"),
        joined(F.col("labels")).alias("labels"),
        "score",
    )


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_multi_index": op2_multi_index,
    "op3_quality_gam": op3_quality_gam,
    "op4_quantised": op4_quantised,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_katz": op7_katz,
    "op8_fuzzy_lines": op8_fuzzy_lines,
    "op9_language_kernel": op9_language_kernel,
    "op10_mixing": op10_mixing,
    "op11_repair": op11_repair,
    "op12_whitening": op12_whitening,
    "op13_licenses": op13_licenses,
}
SQL_OP1 = r"""WITH RECURSIVE lowered AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS items FROM lowered
),
sizes AS (SELECT doc_id, len(items)::BIGINT AS n FROM sets),
tokens AS MATERIALIZED (SELECT doc_id, n, hash(unnest(items)) AS item FROM sets JOIN sizes USING (doc_id)),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM tokens a JOIN tokens b ON a.item = b.item AND a.doc_id < b.doc_id
    AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node
)
SELECT s.doc_id, s.n AS n_shingles, min(r.root) AS component_id
FROM sizes s JOIN reach r ON r.node = s.doc_id GROUP BY 1, 2"""
SQL_OP4 = """WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
),
reach(node, root) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
),
components AS (SELECT node, min(root) AS component_id FROM reach GROUP BY 1)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.component_id,
  e.vec_id = c.component_id AS kept
FROM embeddings e JOIN components c ON c.node = e.vec_id"""
SQL_OP11 = r"""WITH RECURSIVE shown AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
),
crc AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || range(8 * length(k)), lambda r, i:
    xor(xor(r, CASE WHEN i % 8 = 0 THEN ascii(substring(k, i // 8 + 1, 1)) ELSE 0 END) >> 1,
        3988292384 * (xor(r, CASE WHEN i % 8 = 0 THEN ascii(substring(k, i // 8 + 1, 1)) ELSE 0 END) & 1))), 4294967295) % 20 AS fault FROM shown
),
damaged AS (
  SELECT c, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM crc JOIN (VALUES (1), (2)) copies(copy) ON copy = 1 OR fault = 3 WHERE fault <> 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
judged AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY c ORDER BY pos), 1) || left(role, 1) AS pair FROM placed
),
inserts(src, edits, said, mid) AS (
  VALUES ('0', '', '', '0'), ('0', 'I', chr(10) || 'user:', 'U'), ('0', 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 'A'),
    ('S', '', '', 'S'), ('S', 'I', chr(10) || 'user:', 'U'), ('S', 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 'A'),
    ('U', '', '', 'U'), ('U', 'I', chr(10) || 'assistant:', 'A'), ('A', '', '', 'A'), ('A', 'I', chr(10) || 'user:', 'U')
),
edits(mid, edit, initial, dst, new_role) AS (
  VALUES ('0', 'D', NULL, '0', NULL), ('S', 'D', NULL, 'S', NULL), ('U', 'D', NULL, 'U', NULL), ('A', 'D', NULL, 'A', NULL),
    ('0', 'K', 's', 'S', NULL), ('0', 'K', 'u', 'U', NULL), ('S', 'K', 'u', 'U', NULL), ('U', 'K', 'a', 'A', NULL), ('A', 'K', 'u', 'U', NULL),
    ('0', 'R', NULL, 'U', 'user'), ('S', 'R', NULL, 'U', 'user'), ('U', 'R', NULL, 'A', 'assistant'), ('A', 'R', NULL, 'U', 'user')
),
moves AS (SELECT i.src, i.edits || e.edit AS audit, 5 * length(i.edits) + CASE e.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END AS cost, i.said, e.* FROM inserts i JOIN edits e USING (mid)),
walk(c, pos, state, best) AS (
  SELECT DISTINCT c, 0::BIGINT, '0', {'cost': 0::BIGINT, 'audit': '', 'said': ''} FROM shown
  UNION ALL
  SELECT w.c, w.pos + 1, m.dst, min({'cost': w.best.cost + m.cost + CASE WHEN r.fault = 'truncated' AND m.edit <> 'D' THEN 5 ELSE 0 END,
    'audit': w.best.audit || m.audit, 'said': w.best.said || m.said || CASE WHEN m.edit = 'D' THEN '' ELSE chr(10) || coalesce(m.new_role, r.role) || ':' || r.text END})
  FROM walk w JOIN judged r ON r.c = w.c AND r.pos = w.pos + 1
    JOIN moves m ON m.src = w.state AND (m.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate')) AND (m.initial IS NULL OR m.initial = r.initial)
  GROUP BY w.c, w.pos, m.dst
),
ended AS (
  SELECT w.c, w.pos, min({'cost': w.best.cost + 5 * length(i.edits), 'audit': w.best.audit || i.edits, 'said': w.best.said || i.said}) AS best
  FROM walk w JOIN inserts i ON i.src = w.state AND i.mid IN ('0', 'A') GROUP BY 1, 2
),
counts AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY c
)
SELECT k.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated,
  coalesce(n.illegal, 0) AS illegal, e.best.cost AS cost, e.best.audit AS audit, sha256(substring(e.best.said, 2)) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM shown) k LEFT JOIN counts n USING (c) JOIN ended e ON e.c = k.c AND e.pos = coalesce(n.n, 0)"""
SQL = {"op1_ngram_join": SQL_OP1, "op4_quantised": SQL_OP4, "op11_repair": SQL_OP11}
