"""The queries of the numbered operators: each applies its operator to its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import bpe, filter_audit, html_extract, langid, merkle, minhash, mixing, quality, secrets, token_counts, token_output, topk
from logweave.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and what they decode to, as counts and digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the base spans, and all spans."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector with all others, in integers."""
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    return topk.top_k(vectors, vectors.where("id % 100 = 0"), 10)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, where=~langid.held_out())
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learned from labels of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    forest = quality.fit_quality(docs, table(spark, sf_dir, "labels"), where=~langid.held_out("id"))
    found = quality.quality_scores(docs, forest)
    return found.select("doc_id", langid.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of all sources takes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])
    taken = (F.col("mix.copies") * F.col("mix.size")).alias("taken")
    return mixed.select("row.doc_id", "mix.size", "mix.source_size", "mix.target", taken)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document lies in the token files, and a checksum of its ids, read back from the files."""
    folder = token_output.new_folder(spark)
    docs = table(spark, sf_dir, "documents")
    token_output.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, folder)
    return token_output.token_index(spark, folder)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and whether the base rules and then the trees keep it."""
    docs = table(spark, sf_dir, "documents")
    forest = quality.fit_quality(docs, table(spark, sf_dir, "labels"), monotone=quality.MONOTONE)
    return quality.quality_rules(docs, forest)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, on 3-word shingles at a similarity of 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=3)


#: Rows are documents of their own, also where they share an id; a row without an id links with nothing.
OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT r, doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words
), sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
linkable AS (SELECT r, s FROM shingles WHERE doc_id IS NOT NULL),
common AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c FROM linkable a JOIN linkable b ON a.s = b.s AND a.r < b.r GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(r, other) AS (
  SELECT r, r FROM words
  UNION
  SELECT reach.r, edges.b FROM reach JOIN edges ON edges.a = reach.other
), least AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN words ON words.r = reach.other GROUP BY reach.r)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(d.doc_id = component_id, true) AS kept
FROM words d JOIN least USING (r) LEFT JOIN sizes USING (r)
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from the documents of each language, in every order."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
marked AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN said ON said.doc_id = w.doc_id
), cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM marked GROUP BY ALL
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), placed AS (
  SELECT part, filter_order, step, filter_order[step] AS letter, fails, n, g, x, contains(fails, filter_order[step]) AS fails_it,
    length(translate(fails, filter_order[:step - 1], '')) < length(fails) AS gone
  FROM cells, orders, (SELECT unnest(range(1, 6)) AS step)
), summed AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT fails_it), 0) AS kept,
    coalesce(sum(n) FILTER (NOT gone AND fails_it), 0) AS removed, coalesce(sum(n) FILTER (gone AND fails_it), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails, coalesce(sum(g) FILTER (NOT gone AND fails_it), 0) AS good_lost,
    coalesce(sum(x) FILTER (NOT gone AND fails_it), 0) AS toxic_lost
  FROM placed GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM summed
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots and proofs over all documents; every fifth one, by its checksum, is read again in lower case."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    later = {"text": F.when(tampered, lowered).otherwise(F.col("text"))}
    return merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], later=later)


def _tree_sql(name: str, leaves: str) -> str:
    """The levels and runs of trees over rows (tree, i, h, n) of ``leaves``."""
    return f"""{name}(l, tree, i, h, n) AS (
  SELECT 0, tree, i, h, n FROM {leaves}
  UNION ALL
  SELECT l + 1, tree, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM {name} WHERE n > 1 GROUP BY l, tree, i // 16, n
), {name}_runs AS (SELECT l, tree, i // 16 AS r, list(h ORDER BY i) AS hs FROM {name} WHERE n > 1 GROUP BY ALL)"""


OP12_SQL = rf"""
WITH RECURSIVE enc AS (
  SELECT *, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents
), leaf AS (
  SELECT doc_id, coalesce('s' || source, '') AS tree, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS h,
    sha256(head || CASE WHEN text IS NULL THEN '-' WHEN crc % 5 = 0 THEN strlen(low) || ':' || low ELSE strlen(text) || ':' || text END) AS again
  FROM enc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaf
), {_tree_sql('own', 'placed')},
subs AS (SELECT tree AS sub, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM own WHERE n = 1),
tops AS (SELECT '' AS tree, i, subroot AS h, n FROM subs),
{_tree_sql('top', 'tops')},
up(doc_id, leaf, tree, l, i, cur, beside) AS (
  SELECT doc_id, h, tree, 0, i, again, '' FROM placed
  UNION ALL
  SELECT u.doc_id, u.leaf, u.tree, u.l + 1, u.i // 16, sha256(array_to_string(hs[:u.i % 16], '') || cur || array_to_string(hs[u.i % 16 + 2:], '')),
    beside || array_to_string(hs[:u.i % 16], '') || array_to_string(hs[u.i % 16 + 2:], '')
  FROM up u JOIN own_runs r ON r.l = u.l AND r.tree = u.tree AND r.r = u.i // 16
), mid AS (SELECT * FROM up WHERE l = (SELECT max(o.l) FROM own o WHERE o.tree = up.tree)),
over(doc_id, leaf, tree, l, i, cur, beside) AS (
  SELECT doc_id, leaf, mid.tree, 0, subs.i, cur, beside FROM mid JOIN subs ON subs.sub = mid.tree
  UNION ALL
  SELECT u.doc_id, u.leaf, u.tree, u.l + 1, u.i // 16, sha256(array_to_string(hs[:u.i % 16], '') || cur || array_to_string(hs[u.i % 16 + 2:], '')),
    beside || array_to_string(hs[:u.i % 16], '') || array_to_string(hs[u.i % 16 + 2:], '')
  FROM over u JOIN top_runs r ON r.l = u.l AND r.r = u.i // 16
)
SELECT doc_id, leaf, subroot, t.h AS root, sha256(beside) AS proof_sha256, cur AS folded_root, cur = t.h AS verified
FROM over o JOIN subs ON subs.sub = o.tree JOIN top t ON t.n = 1 AND o.l = t.l
"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document by a vocabulary with word ends."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_secrets": op2_secrets,
        "op3_main_text": op3_main_text,
        "op4_topk": op4_topk,
        "op5_language": op5_language,
        "op6_quality": op6_quality,
        "op7_mixing": op7_mixing,
        "op8_token_output": op8_token_output,
        "op9_quality_rules": op9_quality_rules,
        "op10_near_duplicates": op10_near_duplicates,
        "op11_filter_audit": op11_filter_audit,
        "op12_merkle": op12_merkle,
        "op13_token_counts": op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": OP4_SQL, "op10_near_duplicates": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_merkle": OP12_SQL}
