"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm import language_id
from repolith.llm.common import crc_bucket, table
from repolith.llm.decontamination import contamination
from repolith.llm.exact_dedup import exact_dedup
from repolith.llm.line_dedup import dedup_lines
from repolith.llm.merkle import tamper_check
from repolith.llm.mixing import mix
from repolith.llm.page_text import main_text
from repolith.llm.quotation import link_quotations
from repolith.llm.ranked_search import search
from repolith.llm.simhash import simhash_dedup
from repolith.llm.suffix_dedup import dedup_substrings
from repolith.llm.toxicity import score_toxicity
from repolith.llm.window_dedup import dedup_windows


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_quotations(table(spark, sf_dir, "conversations"))
    origins = F.transform("links", lambda x: F.concat_ws(":", x["level"], x["from_conv"], x["from_turn"]))
    return linked.withColumns({"plain_sha256": F.sha2("plain", 256), "links": F.array_join(origins, " ")}).drop("plain")


def op2_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_minhash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(text, 256).alias("kept_sha256"))


def op4_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_superkmer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_windows(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def op7_exact_tree_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("proof")


def op9_bloom_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(language_id.training_rows(docs, language_id.held_out()))
    texts = docs.select("doc_id", language_id.held_out().alias("held_out"), "text")
    return language_id.identify(texts, model, ["doc_id", "held_out"])


def op10_induced_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("spans")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper_check(table(spark, sf_dir, "documents"), crc_bucket(F.col("doc_id"), 3) == 0)


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op13_pair_bound_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quotation_links,
        op2_weighted_fair_mix,
        op3_minhash_lines,
        op4_noisy_channel_toxicity,
        op5_superkmer_windows,
        op6_simhash_trie,
        op7_exact_tree_merge,
        op8_template_decontamination,
        op9_bloom_language_id,
        op10_induced_suffixes,
        op11_merkle_manifest,
        op12_page_text,
        op13_pair_bound_search,
    )
}

SQL: dict[str, str] = {
    "op2_weighted_fair_mix": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(doc_id::VARCHAR || ':mix') AS k
  FROM documents
), w AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source
), o AS (
  SELECT *, 3.0::DOUBLE * source_size AS lim,
         sum(source_size) OVER ()::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER (
           ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem,
         sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest
  FROM w
), lv AS (
  SELECT rem, rest FROM o WHERE NOT (lim * rest < rem * weight) ORDER BY rest DESC LIMIT 1
), t AS (
  SELECT source, source_size,
         CASE WHEN lim * o.rest < o.rem * weight THEN lim ELSE weight * lv.rem / lv.rest END AS target
  FROM o LEFT JOIN lv ON true
), d AS (
  SELECT s.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS sofar
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT d.*, p, coalesce((p * source_size + sofar)::DOUBLE / nullif(target, 0), 0) AS finish
  FROM d, (VALUES (0), (1), (2)) v(p)
  WHERE p * source_size < target OR source_size = 0 AND p = 0
), c AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, p, k, doc_id, size ROWS UNBOUNDED PRECEDING) AS total
  FROM q
), n AS (
  SELECT doc_id, count(*) AS copies FROM c WHERE total <= (SELECT sum(size) FROM sized) GROUP BY doc_id
)
SELECT d.doc_id, d.size::BIGINT AS size, d.source_size, d.target::DOUBLE AS target,
       (coalesce(copies, 0) * d.size)::BIGINT AS taken
FROM d LEFT JOIN n USING (doc_id)""",
    "op5_superkmer_windows": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), least AS (
  SELECT h, min(doc_id) AS m FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (h) WHERE doc_id > m
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op7_exact_tree_merge": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE bits AS (
  SELECT b::BIGINT AS b, b::BIGINT AS v, 0 AS s FROM range(256) r(b)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, s + 1 FROM bits WHERE s < 8
), tab AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE s = 8),
d AS (
  SELECT *, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                             lambda x, y: xor(x >> 8, t[xor(x & 255, y) + 1])), 4294967295) % 3 = 0, false) AS tampered
  FROM documents, tab
), e AS (
  SELECT doc_id, lang, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS body,
         coalesce(octet_length(encode(text)) || ':' || CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-') AS other
  FROM d
), leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, sha256(head || body)) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n, sha256(head || body) AS h, sha256(head || other) AS a
  FROM e
), low AS (
  SELECT 0 AS lvl, g, pos, n, h FROM leaves
  UNION ALL
  SELECT lvl + 1, g, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lvl, g, pos // 8
), sub AS (SELECT g, lvl AS height, h FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, g AS pos, count(*) OVER () AS n, h FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 8
), lows AS (
  SELECT x.lvl, x.g, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r
  FROM low x JOIN low y ON x.lvl = y.lvl AND x.g = y.g AND x.pos // 8 = y.pos // 8 WHERE x.n > 1 GROUP BY ALL
), highs AS (
  SELECT x.lvl, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r
  FROM high x JOIN high y ON x.lvl = y.lvl AND x.pos // 8 = y.pos // 8 WHERE x.n > 1 GROUP BY ALL
), steps AS (
  SELECT f.g, f.pos, s.lvl, l, r FROM leaves f JOIN lows s ON s.g = f.g AND s.pos = f.pos // (8 ** s.lvl)::BIGINT
  UNION ALL
  SELECT f.g, f.pos, sub.height + s.lvl, l, r FROM leaves f JOIN sub USING (g) JOIN highs s ON s.pos = f.g // (8 ** s.lvl)::BIGINT
), walk AS (
  SELECT g, pos, 0 AS lvl, a AS h FROM leaves
  UNION ALL
  SELECT w.g, w.pos, w.lvl + 1, sha256(l || w.h || r) FROM walk w JOIN steps USING (g, pos, lvl)
), ends AS (SELECT g, pos, arg_max(h, lvl) AS folded FROM walk GROUP BY ALL),
proof AS (SELECT g, pos, string_agg(l || r, '' ORDER BY lvl) AS p FROM steps GROUP BY ALL)
SELECT doc_id, leaves.h AS leaf, sub.h AS subroot, root.h AS root, sha256(coalesce(p, '')) AS proof_sha256, folded AS folded_root, folded = root.h AS verified
FROM leaves JOIN sub USING (g) JOIN ends USING (g, pos) LEFT JOIN proof USING (g, pos), (SELECT h FROM high WHERE n = 1) root""",
    "op13_pair_bound_search": r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), d AS (SELECT row_number() OVER () AS r, doc_id, ws, len(ws)::BIGINT AS n FROM t WHERE len(ws) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), p AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, total GROUP BY term, n_docs
), m AS (SELECT r, doc_id, 100 - 90 + ((90 * n * n_docs) // n_terms) AS m FROM d, total),
s AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10""",
}
