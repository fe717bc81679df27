"""Queries over the training-data operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import alignment, byte_bpe, centroids, chat, html_text, language, media, packing, quality, simhash, substrings, token_store, toxicity
from lodestone.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_store.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read_documents(shards)


#: A conversation whose texts are markup.
MARKUP = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2, numPartitions=1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKUP).alias("text"))
    return chat.digests(chat.formatted(turns.union(extra), context=0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).withColumn("quality", F.round("quality", 6))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash, "op2_token_store": op2_token_store, "op3_chat_format": op3_chat_format, "op4_toxicity": op4_toxicity, "op5_byte_bpe": op5_byte_bpe, "op6_media": op6_media, "op7_language_id": op7_language_id, "op8_best_fit_packing": op8_best_fit_packing, "op9_quality_rules": op9_quality_rules, "op10_html_text": op10_html_text, "op11_centroids": op11_centroids, "op12_alignment": op12_alignment, "op13_substrings": op13_substrings}
#: Lengths of the template's markup: <s>, then for each turn brackets, and one more character for each escaped one.
OP3_SQL = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\\[\]<>]', '', 'g')) AS n, length(role) + length(regexp_replace(role, '[^\\\[\]<>]', '', 'g')) AS r FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n + CASE role WHEN 'assistant' THEN 15 WHEN 'user' THEN 13 ELSE 26 + r END))::BIGINT AS formatted_chars, false AS rewritten FROM e GROUP BY conv_id"""

#: Votes by rule: against, for.
OP9_RULES = {
    "v_length": ("n_words < 30", "n_words >= 60"),
    "v_word_length": ("mean < 2.5 OR mean > 12", "mean BETWEEN 3 AND 10"),
    "v_symbols": ("n_symbols / n > 0.3", "n_symbols / n < 0.1"),
    "v_marked": ("n_marked / n > 0.3", "n_marked / n < 0.1"),
    "v_upper": ("n_upper / n > 2", "n_upper / n < 0.5"),
    "v_shouts": ("n_shouts / n > 0.5", "n_shouts / n < 0.05"),
    "v_dup_lines": ("dup > 0.5", "n_lines >= 2 AND dup < 0.05"),
    "v_repeats": ("n_repeat_words / n > 0.4", "n_repeat_words / n < 0.1"),
}


def _op9_sql() -> str:
    """Counts from positions of words, votes, and expectation-maximisation as a recursive query over the table of votes."""
    names, w = list(OP9_RULES), quality.WEIGHT
    blank = r"[\x20\x09-\x0D]+"
    votes = ", ".join(f"CASE WHEN coalesce({bad}, false) THEN -1 WHEN coalesce({good}, false) THEN 1 ELSE 0 END AS {v}" for v, (bad, good) in OP9_RULES.items())
    log_good = "ln(share)" + "".join(f" + CASE {v} WHEN 1 THEN ln(good[{k}]) WHEN -1 THEN ln(1 - good[{k}]) ELSE 0 END" for k, v in enumerate(names, 1))
    log_bad = "ln(1 - share)" + "".join(f" + CASE {v} WHEN 1 THEN ln(1 - bad[{k}]) WHEN -1 THEN ln(bad[{k}]) ELSE 0 END" for k, v in enumerate(names, 1))
    bound = lambda x: f"least(greatest({x}, 1e-4), 1 - 1e-4)"
    good = ", ".join(bound(f"(coalesce(sum(n * g) FILTER ({v} = 1), 0) + {w * quality.START_GOOD}) / (coalesce(sum(n * g) FILTER ({v} <> 0), 0) + {w})") for v in names)
    bad = ", ".join(bound(f"(coalesce(sum(n * (1 - g)) FILTER ({v} = -1), 0) + {w * quality.START_BAD}) / (coalesce(sum(n * (1 - g)) FILTER ({v} <> 0), 0) + {w})") for v in names)
    share = f"least(greatest((sum(n * g) + {w * quality.START_SHARE}) / (sum(n) + {w}), {quality.LEAST_SHARE}), {quality.MOST_SHARE})"
    start = lambda x: "[" + ", ".join([f"{x}::DOUBLE"] * len(names)) + "]"
    posterior = f"1 / (1 + exp(({log_bad}) - ({log_good})))"
    return f"""WITH RECURSIVE rows AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '{blank}'), lambda x: x <> '') AS words, list_filter(string_split(text, E'\\n'), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM rows),
windows AS (SELECT rid, unnest(list_transform(range(1, len(words) - 1), lambda i: {{'i': i, 'w': words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]}}), recursive := true) FROM cut),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(3) AS s(k) GROUP BY rid),
counts AS (SELECT rid, doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{blank}', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^!]+', '', 'g')) AS n_shouts,
  length(regexp_replace(text, '\\P{{Lu}}+', '', 'g')) AS n_upper, len(list_filter(words, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS n_marked FROM cut LEFT JOIN covered USING (rid)),
ratios AS (SELECT *, nullif(n_words, 0)::DOUBLE AS n, word_chars / nullif(n_words, 0) AS mean, n_dup_lines / nullif(n_lines, 0) AS dup FROM counts),
voted AS MATERIALIZED (SELECT *, {votes} FROM ratios), patterns AS MATERIALIZED (SELECT {', '.join(names)}, count(*)::DOUBLE AS n FROM voted GROUP BY ALL),
em AS (SELECT 0 AS round, {quality.START_SHARE}::DOUBLE AS share, {start(quality.START_GOOD)} AS good, {start(quality.START_BAD)} AS bad
  UNION ALL SELECT round + 1, {share}, [{good}], [{bad}] FROM (SELECT em.round, patterns.*, {posterior} AS g FROM em, patterns WHERE em.round < {quality.ROUNDS}) GROUP BY round),
judged AS (SELECT voted.*, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed, {posterior} AS p FROM voted, (SELECT * FROM em WHERE round = {quality.ROUNDS}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= {quality.KEEP} AS kept, round(p, 6) AS quality, {', '.join(names)} FROM judged"""


def _op11_sql() -> str:
    """Every round as two tables: all vectors with their nearest centroid, and the centroids that follow."""
    distance = "list_inner_product(v.p, v.p) - 2 * list_inner_product(v.p, c.p) + list_inner_product(c.p, c.p)"
    near = lambda n: f"a{n} AS MATERIALIZED (SELECT rid, min_by(z, (d, z)) AS z, min(d)::BIGINT AS d FROM (SELECT v.rid, c.z, {distance} AS d FROM v, c{n} AS c) GROUP BY rid)"
    moved = lambda n: f"""c{n + 1} AS MATERIALIZED (SELECT c{n}.z, coalesce(m.p, c{n}.p) AS p FROM c{n} LEFT JOIN (SELECT z, list(x ORDER BY k) AS p FROM
  (SELECT z, k, floor(sum(x) / count(*)) AS x FROM (SELECT z, unnest(p) AS x, unnest(range(64)) AS k FROM v JOIN a{n} USING (rid)) GROUP BY z, k) GROUP BY z) AS m USING (z))"""  # noqa: E731
    steps = ", ".join(f"{near(n)}, {moved(n)}" for n in range(5))
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS p FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), p) - 1 AS z, p FROM v QUALIFY z < 40), {steps}, {near(5)}
SELECT vec_id, z::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY z)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(list_transform(c5.p, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM v JOIN a5 USING (rid) JOIN c5 USING (z)"""


OP13_SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT rid, i, sha256(array_to_string(w[i:i + 34], ' ')) AS key FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY key) AS n FROM starts) WHERE n > 1),
gone AS (SELECT DISTINCT rid, i + k AS p FROM twice, range(35) AS s(k)),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid), lost AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid) LEFT JOIN lost USING (rid)"""

#: The others are fingerprint graphs, tokenizers, trained models and files; tests/llm holds them against plain versions.
ORACLE = {"op3_chat_format": OP3_SQL, "op9_quality_rules": _op9_sql(), "op11_centroids": _op11_sql(), "op13_substrings": OP13_SQL}
