"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faceoff.llm import alignment, bpe, chat, jaccard, lines, lmscore, neardup, negatives, packing, quality, secrets, substring, toxicity
from faceoff.llm.registry import ORACLES, QUERIES, register, table  # noqa: F401


@register("op6_quality_rules")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"))
    return quality.measure(docs, model).drop("score")


WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWERED)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 80 * (p.n + q.n - o)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
walk AS (SELECT doc_id AS v, doc_id AS root FROM documents UNION SELECT e.y, w.root FROM walk w JOIN edges e ON e.x = w.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v AS doc_id, min(root) AS component_id FROM walk GROUP BY v) r USING (doc_id)
"""


@register("op4_ngram_jaccard_join", OP4)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"))


OP7 = f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
kept AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.p) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) a ANTI JOIN gone USING (doc_id, p) GROUP BY a.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""


@register("op7_substring_dedup", OP7)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return substring.digest(table(spark, folder, "documents"))


@register("op1_best_fit_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@register("op9_bpe_encode_decode")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode(table(spark, folder, "documents"), path)
    return bpe.decode(ids, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.btrim(F.to_json("ids"), F.lit("[]")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op5_lm_scoring")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    scored = lmscore.score(table(spark, folder, "documents"), remainder != 2)
    return scored.withColumn("held_out", remainder == 2)


@register("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"), ~held_out)
    return toxicity.score(docs, model).withColumn("held_out", held_out)


@register("op2_secret_scans")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = secrets.findings(docs, secrets.fit(docs))
    joined = lambda cells: F.array_join(F.transform(cells, lambda f: F.concat_ws(":", f.kind, f.start, f.end)), ",")
    of = lambda kind: F.size(F.filter("findings", lambda f: f.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", of("assign"), of("access"), of("hex"),
                        F.sha2(joined(F.filter("findings", lambda f: f.kind != "net")), 256).alias("base_sha256"), joined("findings").alias("spans"),
                        of("net"))


#: Fields of the two tools that conversations are read as: a question is a call, the turn after it answers.
TOOLS = """
SELECT * FROM VALUES ('ask', 'n_chars', 'integer', true), ('ask', 'text', 'string', true), ('ask', 'turn', 'integer', true),
  ('ask_lines', 'n_lines', 'integer', true), ('ask_lines', 'text', 'string', true), ('ask_lines', 'turn', 'string', false)
  AS tools(name, field, type, required)
"""

OP10 = """
WITH calls AS (
  SELECT conv_id, 'c' || conv_id || '-' || turn AS call_id, turn,
         CASE WHEN contains(text, chr(10)) THEN 'ask_lines' ELSE 'ask' END AS name,
         json_object('n_chars', length(text), 'text', text, 'turn', turn) AS arguments
  FROM conversations WHERE role = 'user'),
results AS (
  SELECT conv_id, 'c' || conv_id || '-' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
chains AS (  -- a question comes after the one two turns before it
  SELECT conv_id, turn, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run, turn % 2 AS half
  FROM calls),
depths AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, half, run ORDER BY turn) - 1 AS depth FROM chains),
linked AS (
  SELECT c.conv_id, c.call_id, d.depth, CASE WHEN r.call_id IS NULL THEN 'no_result' ELSE 'ok' END AS status,
         CASE c.name WHEN 'ask' THEN '' ELSE 'n_chars:unknown,n_lines:missing,turn:type' END AS errors, c.arguments, c.name, r.content AS result
  FROM calls c JOIN depths d USING (conv_id, turn) LEFT JOIN results r ON r.call_id = c.call_id
  UNION ALL
  SELECT r.conv_id, r.call_id, NULL, 'orphan_result', '', NULL, NULL, r.content
  FROM results r LEFT JOIN calls c ON r.call_id = c.call_id WHERE c.call_id IS NULL),
every AS (
  SELECT *, lpad(CAST(coalesce(depth, 9999999999) AS VARCHAR), 10, '0') || ':' || call_id AS order_key FROM linked
  UNION ALL
  SELECT conv_id, NULL, NULL, 'unlinked', '', NULL, role, text, '-' || lpad(CAST(coalesce(turn, 9999999999) AS VARCHAR), 10, '0')
  FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant'))
SELECT conv_id, call_id, depth, order_key, status, errors,
  '{' || concat_ws(',', '"arguments":' || arguments, '"call_id":' || to_json(call_id), '"conv_id":' || to_json(CAST(conv_id AS VARCHAR)),
    '"depth":' || depth, '"errors":' || to_json(errors), '"name":' || to_json(name), '"result":' || to_json(result),
    '"status":' || to_json(status)) || '}' AS record
FROM every
"""


@register("op10_chat_formatting", OP10)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    at = lambda back: F.concat(F.lit("c"), "conv_id", F.lit("-"), F.col("turn") - back)
    calls = turns.where("role = 'user'").select(
        "conv_id", at(0).alias("call_id"), at(2).alias("after"), "turn",
        F.when(F.contains("text", F.lit("\n")), "ask_lines").otherwise("ask").alias("name"),
        F.to_json(F.struct(F.length("text").alias("n_chars"), "text", "turn")).alias("arguments"))
    results = turns.where("role = 'assistant'").select("conv_id", at(1).alias("call_id"), "turn", F.col("text").alias("content"))
    others = turns.where("role is null or role not in ('user', 'assistant')").select("conv_id", "turn", "role", F.col("text").alias("content"))
    return chat.link(calls, results, spark.sql(TOOLS), others)


OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= 0.93),
walk AS (SELECT vec_id AS v, vec_id AS root FROM v UNION SELECT l.y, w.root FROM walk w JOIN links l ON l.x = w.v),
n AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM v LEFT JOIN n USING (vec_id) JOIN (SELECT v AS vec_id, min(root) AS component_id FROM walk GROUP BY v) r USING (vec_id)
"""


@register("op8_embedding_near_dedup", OP8)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "embeddings"))


@register("op11_cross_tokenizer_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.link_counts(table(spark, folder, "documents"), *paths)


@register("op13_quality_classifier")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    docs = table(spark, folder, "documents")
    model = lines.fit(docs, table(spark, folder, "labels"), ~held_out)
    return lines.score(docs, model).withColumn("held_out", held_out)


OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM p JOIN s n USING (anchor_id) WHERE NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 10
"""


@register("op12_hard_negatives", OP12)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)
