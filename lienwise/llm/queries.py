"""One query per numbered operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, language_model, licenses, packing, prefixes, quality, recompression, simhash, topk, transducer, wrapper
from .storage import table, written


def op1_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op2_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.repeated_passages(table(spark, sf_dir, "documents"))[0].drop("key", "sha")


def op6_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    return language_model.score_texts(table(spark, sf_dir, "documents"), training, steady=True)


def op7_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents")))


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, quality.grades(table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", "expected_grade", "top_probability", (F.col("top_probability") >= 0.5).alias("keep"))


def op9_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("select -7L as conv_id, n as turn, if(n = 0, 'user', 'assistant') as role, '</s>[INST] ok [/INST]' as text from (select explode(array(0L, 1L)) as n)")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    messages = written(chat.conversation_messages(rows), "messages")
    out = chat.format_paths(chat.reply_paths(messages), messages)
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    out = out.select(F.col("root.conv_id").alias("conv_id"), turns.alias("turns"), loss.alias("loss"), "formatted")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_conditional_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_notices(table(spark, sf_dir, "documents"))


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    out = alignment.link_figures(table(spark, sf_dir, "documents"), text=digest)
    return out.select(F.col("doc_id").cast("long"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transducer.encoded(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(F.col("doc_id").cast("long"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixes.ordered(table(spark, sf_dir, "conversations"))
    c = F.col("conv_id")
    turns, convs = prefixes.rebuilt(turns, c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6, 5)
    nodes, ends = prefixes.trie(turns, convs)
    out = nodes.join(prefixes.end_digests(ends), prefixes.KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wrapper_induction": op1_wrapper_induction,
    "op2_simhash_windows": op2_simhash_windows,
    "op3_branch_and_bound": op3_branch_and_bound,
    "op4_simhash_trie": op4_simhash_trie,
    "op5_recompression": op5_recompression,
    "op6_elias_fano": op6_elias_fano,
    "op7_minimum_bin_slack": op7_minimum_bin_slack,
    "op8_ordinal_quality": op8_ordinal_quality,
    "op9_reply_trees": op9_reply_trees,
    "op10_conditional_compression": op10_conditional_compression,
    "op11_cross_tokenizer": op11_cross_tokenizer,
    "op12_transducer_bpe": op12_transducer_bpe,
    "op13_prefix_trie": op13_prefix_trie,
}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_ESCAPED = r"regexp_replace(coalesce({0}, ''), '" + chat._pattern("") + r"', '\1\\\2', 'g')"
_ROLE = "replace(replace(" + _ESCAPED.format("role") + ", '%', '%25'), chr(10), '%0A')"

ORACLES: dict[str, str] = {
    "op3_branch_and_bound": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS c FROM embeddings),
q AS (SELECT vec_id, min(c) AS c FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.c, v.c) AS BIGINT) AS score FROM q JOIN v ON v.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op5_recompression": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
low AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
cov AS (SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS j FROM win JOIN low USING (s) WHERE m < doc_id),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM each ANTI JOIN cov USING (doc_id, j) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)""",
    "op9_reply_trees": f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x, length({_ROLE}) + length({_ESCAPED.format("text")}) + 24 AS n FROM c WHERE conv_id IS NOT NULL)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id""",
    "op13_prefix_trie": """
WITH o AS (SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS v),
g AS (SELECT conv_id, t, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)), lambda c, b: xor(c >> 8, v[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h FROM o, tab),
b AS (SELECT g.conv_id, list_concat(coalesce(list_slice(s.t, 1, g.h), []), list_slice(g.t, g.h + 1, len(g.t))) AS t FROM g LEFT JOIN o s ON s.conv_id = g.conv_id - g.conv_id % 100),
m AS (SELECT conv_id, d, to_json(list_slice(t, 1, d))::VARCHAR AS k, to_json(list_slice(t, 1, d - 1))::VARCHAR AS p, coalesce(length(t[d].x), 0) AS n, len(t) = d AS ends FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM b)),
v AS (SELECT k, d, any_value(p) AS p, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM m GROUP BY k, d),
w AS (SELECT v.*, (SELECT count(*) FROM v c WHERE c.p = v.k AND c.d = v.d + 1) AS n_children FROM v),
sub AS (SELECT DISTINCT a.k, b.k AS u FROM m a JOIN m b ON b.conv_id = a.conv_id AND b.d >= a.d),
tot AS (SELECT sub.k, count(*) FILTER (w.n_children = 0) AS n_leaves, CAST(sum((w.n_convs - 1) * w.n) AS BIGINT) AS saved_tokens FROM sub JOIN w ON w.k = sub.u GROUP BY sub.k)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, sha256(w.ids) AS ends_sha256
FROM w JOIN tot USING (k) LEFT JOIN w u ON u.k = w.p AND u.d = w.d - 1""",
}
