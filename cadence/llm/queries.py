"""Thin contract queries over whole tables, and the DuckDB statements of those SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fingerprints, hmm_lm, mixing, packing, pii, prefix_trie, secrets, simhash, substring_dedup, toxicity, whitening
from .common import documents, materialise


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary; ``CADENCE_TOKENIZERS`` names another folder."""
    folder = os.environ.get("CADENCE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(documents(spark, sf_dir), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _spans_text(spans, kinds=None):
    """``kind:start:end`` of the spans, of ``kinds`` only, joined by commas."""
    if kinds:
        spans = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _digest(text):
    return F.sha2(text.cast("binary"), 256)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, kinds = F.col("spans"), pii.KINDS
    found = pii.pii_spans(documents(spark, sf_dir))
    return found.select("doc_id", *(_count(spans, k) for k in kinds), _digest(_spans_text(spans, kinds)).alias("base_sha256"), _spans_text(spans).alias("spans"))


def op3_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.hmm_scores(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, kinds = F.col("spans"), secrets.KINDS[:3]
    found = secrets.secret_spans(documents(spark, sf_dir))
    return found.select("doc_id", *(_count(spans, k) for k in kinds), _digest(_spans_text(spans, kinds)).alias("base_sha256"), _spans_text(spans).alias("spans"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_near_dedup(documents(spark, sf_dir), shingle_words=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode(documents(spark, sf_dir), path, pattern)
    back = bpe.decode(coded, path, pattern, keep=("doc_id", "n_tokens", "ids"))
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(documents(spark, sf_dir), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt by the contract of op11: their turns, and their ids (turnless ones too)."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    ids = ids.select("conv_id", "n_own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    lengths = ids.select(F.col("conv_id").alias("base"), F.least("n_own", F.lit(8)).alias("n_base"))
    ids = materialise(ids.join(lengths, "base", "left").withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0)))), "rebuilt-ids")
    heads = turns.where("place <= 8").withColumnRenamed("conv_id", "base").join(ids.select("conv_id", "base", "head"), "base").where("place <= head")
    tails = turns.join(ids.select("conv_id", "h", "head"), "conv_id").where("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("head"))
    of = ["conv_id", "place", "a", "b", "c", "n_bytes"]
    return heads.select(*of).unionByName(tails.select(*of)), ids.select("conv_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, ids = rebuilt(materialise(prefix_trie.turn_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns"))
    return prefix_trie.prefix_trie(turns, ids)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=8)
    rows = found.select("*", F.posexplode(F.arrays_zip(F.col("whitened").alias("w"), F.col("explained").alias("e"))).alias("at", "of"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", F.col("deviation").try_cast("long").alias("deviation"),
        F.col("of")["w"].alias("whitened"), F.col("of")["e"].alias("explained"), "identity_error",
    )


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_pii, op3_hmm_lm, op4_packing, op5_secrets, op6_toxicity, op7_simhash, op8_fingerprints, op9_byte_bpe, op10_substring_dedup, op11_prefix_trie, op12_whitening, op13_mixing)}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

SQL = {
    "op1_exact_dedup": f"""
        WITH n AS (SELECT doc_id, sha256({_NORM}) AS text_sha256, length(coalesce(text, '')) AS n_chars FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS kept,
               text_sha256
        FROM n
    """,
    "op10_substring_dedup": r"""
        WITH texts AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS sequence
                    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM texts)),
        repeated AS (SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY sequence) < doc_id),
        gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS at FROM repeated),
        placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at FROM texts),
        kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.at) AS text FROM placed p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.at = p.at GROUP BY p.doc_id)
        SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM texts t LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = t.doc_id LEFT JOIN kept k ON k.doc_id = t.doc_id
    """,
    "op11_prefix_trie": r"""
        WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
                              coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                       lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
                FROM (SELECT DISTINCT conv_id FROM turns)),
        bound AS (SELECT i.*, least(h, (SELECT count(*) FROM turns t WHERE t.conv_id = i.base)) AS head FROM ids i),
        built AS (SELECT b.conv_id, t.place AS depth, role, text FROM bound b JOIN turns t ON t.conv_id = b.base AND t.place <= b.head
                  UNION ALL SELECT b.conv_id, t.place - b.h + b.head, role, text FROM bound b JOIN turns t ON t.conv_id = b.conv_id AND t.place > b.h),
        paths AS (SELECT conv_id, depth, octet_length(encode(text)) AS n_bytes,
                         string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM built
                  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
        ends AS (SELECT conv_id, max(depth) AS last FROM paths GROUP BY conv_id),
        nodes AS (SELECT path, depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(n_bytes) AS n_bytes,
                         sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE depth = last), '')) AS ends_sha256
                  FROM paths p JOIN ends USING (conv_id) GROUP BY path, depth),
        linked AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND starts_with(c.path, n.path)) AS n_children
                   FROM nodes n LEFT JOIN nodes u ON u.depth = n.depth - 1 AND starts_with(n.path, u.path)),
        under AS (SELECT a.path, count(*) FILTER (WHERE n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.n_bytes)::BIGINT AS saved_tokens
                  FROM linked a JOIN linked n ON n.depth >= a.depth AND starts_with(n.path, a.path) GROUP BY a.path)
        SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM linked JOIN under USING (path)
    """,
    "op13_mixing": r"""
        WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                              CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
        sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sizes GROUP BY source),
        ranked AS (SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS k FROM sources),
        steps AS (SELECT k, CAST(coalesce(sum(cap) OVER w, 0) AS BIGINT) AS spent, CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS BIGINT) AS free,
                         1.5::DOUBLE * sum(source_size) OVER () AS budget, cap, weight
                  FROM ranked WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        level AS (SELECT spent, free, budget FROM steps WHERE cap > (budget - spent) * weight / free ORDER BY k LIMIT 1),
        aims AS (SELECT source, source_size, CASE WHEN l.free IS NULL OR cap <= (budget - l.spent) * weight / l.free THEN CAST(cap AS DOUBLE) ELSE (budget - l.spent) * weight / l.free END AS target
                 FROM ranked LEFT JOIN level l ON true),
        quotas AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS copies FROM aims),
        sums AS (SELECT s.*, source_size, target, copies, CAST(round(target) AS BIGINT) - copies * source_size AS rest,
                        CAST(sum(size) OVER w AS BIGINT) AS upto, CAST(sum(size) OVER (PARTITION BY s.source, h) AS BIGINT) AS edge_size
                 FROM sizes s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source WINDOW w AS (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT doc_id, size, source_size, target,
               copies * size + CASE WHEN size = 0 THEN 0 WHEN upto <= rest THEN size WHEN upto - edge_size <= rest THEN CAST(size::HUGEINT * (rest - upto + edge_size) // edge_size AS BIGINT) ELSE 0 END AS taken
        FROM sums
    """,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
