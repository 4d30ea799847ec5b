"""The queries of the text operators, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_substring import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_and_decode

    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pitman_yor import scored

    return scored(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_format

    return chat_format(table(spark, sf_dir, "conversations"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import BASE_KINDS, scan, span_text

    base = f"x.order < {len(BASE_KINDS)}"
    counts = (F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k, *_ in BASE_KINDS)
    return scan(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(span_text("spans", base), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .state import shared_folder
    from .token_files import token_counts, write_token_files

    path = shared_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return token_counts(spark, path).select(F.regexp_extract("file", r"part-(\d+)", 1).cast("long").alias("file"), "doc", "n_tokens")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import fold, manifest, proof_text

    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = manifest(table(spark, sf_dir, "documents"), {"n_chars": tampered}).withColumn("folded_root", fold(F.col("claimed"), F.col("siblings")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("siblings")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_decontamination, op3_quality_rules, op4_html_extraction, op5_byte_bpe, op6_pitman_yor, op7_chat_format, op8_ngram_jaccard_join, op9_secret_scan, op10_token_counts, op11_line_dedup, op12_merkle_manifest)}

ORACLES: dict[str, str] = {
    "op2_decontamination": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, w[i : i + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sized AS (SELECT item_id, array_to_string(win, ' ') AS win, len(win) AS n FROM wins),
long AS (SELECT doc_id, i, array_to_string(w[i : i + n - 1], ' ') AS win, n FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, long.n, item_id FROM long JOIN sized ON long.win = sized.win AND long.n = sized.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op7_chat_format": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rank, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
p AS (SELECT conv_id, rank, n, md5(CAST(list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY rank) AS VARCHAR)) AS h FROM r),
whole AS (SELECT h, min(conv_id) AS conv_id FROM p WHERE rank = n GROUP BY h),
kept AS (SELECT conv_id FROM whole WHERE h NOT IN (SELECT h FROM p WHERE rank < n))
SELECT conv_id, count(*) AS n_turns, string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY rank) AS chat
FROM r WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id""",
    "op11_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT doc_id, i, line, first IS NOT NULL AND first <> doc_id AS dropped FROM k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op12_merkle_manifest": """
WITH RECURSIVE bits AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, 4294967295::BIGINT AS c FROM documents UNION ALL
    SELECT doc_id, s, k + 1, xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END) FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(c, ascii(s[k // 8 + 1])::BIGINT) ELSE c END AS b FROM bits WHERE k < 8 * length(s))),
crc AS (SELECT doc_id, xor(c, 4294967295::BIGINT) AS crc FROM bits WHERE k = 8 * length(s)),
f AS (SELECT doc_id, lang, CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS more, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS before,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS after FROM documents JOIN crc USING (doc_id)),
h AS (SELECT doc_id, lang, sha256(before || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || after) AS leaf, sha256(before || coalesce(strlen((n_chars + more)::VARCHAR) || ':' || (n_chars + more), '-') || after) AS claimed FROM f),
i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS idx FROM h),
tree AS (SELECT lang, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM i GROUP BY lang UNION ALL
    SELECT lang, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda x: sha256(nodes[2 * x + 1] || coalesce(nodes[2 * x + 2], ''))) FROM tree WHERE len(nodes) > 1),
subs AS (SELECT lang, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM tree WHERE len(nodes) = 1),
top AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subs UNION ALL
    SELECT level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda x: sha256(nodes[2 * x + 1] || coalesce(nodes[2 * x + 2], ''))) FROM top WHERE len(nodes) > 1),
whole AS (SELECT nodes[1] AS root, level AS top_height FROM top WHERE len(nodes) = 1),
steps AS (SELECT lang, level AS step, 0 AS upper, level, nodes FROM tree WHERE len(nodes) > 1 UNION ALL SELECT lang, height + level, 1, level, nodes FROM subs, top WHERE len(nodes) > 1),
sib AS (SELECT doc_id, leaf, step, (p >> level) & 1 = 1 AS left_side, coalesce(nodes[xor(p >> level, 1) + 1], '') AS digest FROM
    (SELECT i.doc_id, i.leaf, step, level, nodes, CASE upper WHEN 0 THEN idx ELSE place END AS p FROM i JOIN subs ON i.lang IS NOT DISTINCT FROM subs.lang JOIN steps ON i.lang IS NOT DISTINCT FROM steps.lang)),
folding AS (SELECT doc_id, leaf, 0 AS step, claimed AS node FROM i UNION ALL
    SELECT g.doc_id, g.leaf, g.step + 1, sha256(CASE WHEN left_side THEN digest ELSE '' END || node || CASE WHEN left_side THEN '' ELSE digest END) FROM folding g JOIN sib ON sib.doc_id = g.doc_id AND sib.leaf = g.leaf AND sib.step = g.step),
proof AS (SELECT doc_id, leaf, sha256(string_agg(digest, '' ORDER BY step)) AS proof_sha256 FROM sib GROUP BY doc_id, leaf)
SELECT i.doc_id, i.leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, node AS folded_root, node = root AS verified
FROM i JOIN subs ON i.lang IS NOT DISTINCT FROM subs.lang, whole, folding LEFT JOIN proof ON proof.doc_id = folding.doc_id AND proof.leaf = folding.leaf
WHERE folding.doc_id = i.doc_id AND folding.leaf = i.leaf AND folding.step = height + top_height""",
}
