"""Queries ``opN_<name>`` over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from crewline.llm import capfilters, codebooks, induced_suffixes, linewindows, maxscore, mixing, recurrent_lm, sentencepiece_lattice, periodic_runs, templates, toxicity, trie_join, url_reputation
from crewline.llm.common import read_table


def op1_maxscore_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return maxscore.top_k_embeddings(read_table(spark, folder, "embeddings"), every=50, k=5, scale=256)


def op2_template_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return templates.extract(read_table(spark, folder, "pages"))


def op3_cap_filter_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return capfilters.near_duplicates(read_table(spark, folder, "embeddings"), threshold=0.93)


def op4_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents").select("doc_id", "text", "lang")
    labelled = mixing.language_and_quality(documents, read_table(spark, folder, "labels"))
    return mixing.mixed(documents.drop("lang"), labelled, mixing.TARGETS).drop("text")


def op5_line_windows(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents").select("doc_id", "text")
    return linewindows.line_dedup(documents).select("doc_id", "n_lines", "n_removed", "text")


def op6_sentencepiece_lattice(spark: SparkSession, folder: str) -> DataFrame:
    pieces = sentencepiece_lattice.Pieces(sentencepiece_lattice.model_path())
    coded = sentencepiece_lattice.encode(read_table(spark, folder, "documents"), pieces)
    return coded.select("doc_id", F.size("ids").alias("n_pieces"), "ids", F.col("exact").alias("round_trip"))


def op7_trie_join(spark: SparkSession, folder: str) -> DataFrame:
    return trie_join.ngram_groups(read_table(spark, folder, "documents"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op9_recurrent_lm(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return recurrent_lm.score_documents(read_table(spark, folder, "documents"), held_out)


def op10_induced_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return induced_suffixes.remove_repeats(read_table(spark, folder, "documents")).drop("kept")


def op11_adaptive_codebooks(spark: SparkSession, folder: str) -> DataFrame:
    return codebooks.coded(read_table(spark, folder, "embeddings")).drop("label")


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find_runs(read_table(spark, folder, "documents")))


def op13_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    return url_reputation.judge(read_table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_maxscore_top_k": op1_maxscore_top_k,
    "op2_template_extraction": op2_template_extraction,
    "op3_cap_filter_dedup": op3_cap_filter_dedup,
    "op4_soft_mixing": op4_soft_mixing,
    "op5_line_windows": op5_line_windows,
    "op6_sentencepiece_lattice": op6_sentencepiece_lattice,
    "op7_trie_join": op7_trie_join,
    "op8_toxicity": op8_toxicity,
    "op9_recurrent_lm": op9_recurrent_lm,
    "op10_induced_suffixes": op10_induced_suffixes,
    "op11_adaptive_codebooks": op11_adaptive_codebooks,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_url_reputation": op13_url_reputation,
    "pipeline": corpus_pipeline.run,
}

def _strength(name: str, level: str) -> str:
    """The prior strength of a level as ``url_reputation._strength`` estimates it."""
    r = url_reputation
    return f"""{name} AS (
  SELECT CASE WHEN w IS NULL OR w = 0 OR s IS NULL THEN {r.STRENGTH_DEFAULT} WHEN (s - v) / w <= 0 THEN {r.STRENGTH_MAX}
              ELSE least({r.STRENGTH_MAX}, greatest({r.STRENGTH_MIN}, 1 / ((s - v) / w) - 1)) END AS k
  FROM (SELECT sum(n * (bad / n - m) ** 2) AS s, sum(m * (1 - m)) AS v, sum(m * (1 - m) * (n - 1)) AS w FROM {level} WHERE n > 0)
)"""


FINE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLES: dict[str, str] = {
    "op1_maxscore_top_k": f"""
WITH terms AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS t FROM embeddings WHERE {FINE}
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.t, c.t) AS BIGINT) AS score
  FROM terms q JOIN terms c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
""",
    "op3_cap_filter_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE {FINE} AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS id, vec_id AS top FROM embeddings
  UNION
  SELECT links.b, reach.top FROM reach JOIN links ON links.a = reach.id
), tops AS (SELECT id, min(top) AS component_id FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN tops ON tops.id = vec_id LEFT JOIN counts ON counts.a = vec_id
""",
    # Documents have distinct ids in the given tables.
    "op5_line_windows": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), full_lines AS (
  SELECT doc_id, pos, trim(regexp_replace(line, '[\\t\\x0B\\f\\r]+', ' ', 'g'), ' ') AS line FROM lines
), windows AS (
  SELECT doc_id, pos AS a1, lead(pos, 1) OVER w AS a2, lead(pos, 2) OVER w AS a3, line AS l1, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3
  FROM full_lines WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT *, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, a1) AS turn FROM windows WHERE a3 IS NOT NULL
), gone AS (
  SELECT doc_id, a1 AS pos FROM later WHERE turn > 1 UNION SELECT doc_id, a2 FROM later WHERE turn > 1 UNION SELECT doc_id, a3 FROM later WHERE turn > 1
)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(gone.pos) AS INTEGER) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone.pos IS NULL), '') AS text
FROM lines LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id
""",
    "op13_url_reputation": f"""
WITH split AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC, verdict = 'block' DESC, rhost || rpath DESC) AS r
  FROM hp JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
), judged AS (
  SELECT hp.page_id, host, path, f.rule, f.verdict AS rule_verdict FROM hp LEFT JOIN (SELECT * FROM fits WHERE r = 1) f USING (page_id)
), hosts AS (
  SELECT host, count(rule_verdict)::DOUBLE AS n, sum(CASE WHEN rule_verdict = 'block' THEN 1 ELSE 0 END)::DOUBLE AS bad,
         CASE WHEN len(string_split(host, '.')) >= 2 THEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') ELSE host END AS domain,
         string_split(host, '.')[-1] AS suffix
  FROM judged GROUP BY host
), top AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m, coalesce(sum(n), 0) + 2 AS sure FROM hosts),
suf AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT m FROM top) AS m FROM hosts GROUP BY suffix),
{_strength("k1", "suf")},
suf2 AS (SELECT suffix, (m * least(k, sure) + bad) / (least(k, sure) + n) AS suffix_mean, least(k, sure) + n AS suffix_sure FROM suf, k1, (SELECT sure FROM top)),
dom AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
dom1 AS (SELECT dom.*, suffix_mean AS m, suffix_sure FROM dom JOIN suf2 USING (suffix)),
{_strength("k2", "dom1")},
dom2 AS (SELECT domain, suffix, (m * least(k, suffix_sure) + bad) / (least(k, suffix_sure) + n) AS domain_mean, least(k, suffix_sure) + n AS domain_sure FROM dom1, k2),
host1 AS (SELECT hosts.host, hosts.n, hosts.bad, domain_mean AS m, domain_sure FROM hosts JOIN dom2 USING (domain, suffix)),
{_strength("k3", "host1")},
post AS (
  SELECT host, m * least(k, domain_sure) + bad AS a, (1 - m) * least(k, domain_sure) + n - bad AS b FROM host1, k3
), bounds AS (
  SELECT host, a / (a + b) - {url_reputation.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower FROM post
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN lower >= {url_reputation.BOUND} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN bounds USING (host)
""",
}
