"""The operators as queries over the test tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourline.llm import bpe, decontaminate, divergence, embeddings, html_text, line_dedup, merkle, quality, repeats, simhash, token_counts, token_files, url_filter
from hourline.llm.frames import read_table
from hourline.sources.files import work_path

BPE_FILE = public_tokenizers.path("word_bpe_49k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(read_table(spark, folder, "documents"), BPE_FILE)


def op2_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(read_table(spark, folder, "pages"))


def op3_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_copies(read_table(spark, folder, "embeddings"), threshold=0.98)


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(read_table(spark, folder, "documents"), shingle=4, radius=4)


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    n_lines = F.size(F.split("text", "\n", -1)).cast("bigint")
    done = line_dedup.drop_recurring(docs.select("doc_id", "text", n_lines.alias("n_lines")), dropped_col="n_dropped")
    return done.select("doc_id", "n_lines", "n_dropped", "text")


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, folder, "documents"), PIECE_FILE, limit=4096)


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(read_table(spark, folder, "pages"), RULES)


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that the sampler keeps."""
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    return quality.resample(docs.select("doc_id", "text"), labels).select("doc_id", "log_weight", "key")


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """The leaks: documents and the benchmark items they hold."""
    leaks = decontaminate.find_leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    each = leaks.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(F.max("n_words").alias("n_words"), F.max("n_found").alias("n_found"))
    return each.select("doc_id", "item_id", F.col("n_words").cast("bigint"), F.col("n_found").cast("bigint"))


def op10_token_index(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "tokens")
    token_files.write_tokens(read_table(spark, folder, "documents"), BPE_FILE, path, END_ID)
    return token_files.read_documents(spark, path)


def op11_repeats(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeats.cut_repeats(read_table(spark, folder, "documents"), window=400)
    return cut.select("doc_id", *repeats.digests(), repeats.kept_text().alias("text"))


def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(read_table(spark, folder, "documents"), min_docs=3, top=200)


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(read_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_html, op3_embeddings, op4_simhash, op5_line_dedup, op6_token_counts, op7_url_filter, op8_quality, op9_decontaminate, op10_token_index, op11_repeats, op12_divergence, op13_merkle)
}

URL_SQL = r"""
WITH rules(rule, host, path, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
rest AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path
  FROM (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest)),
fit AS (SELECT p.page_id, p.host, p.path, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS n
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE n = 1"""

#: The pages of the test tables all mark their article, and hold these character references only.
HTML_SQL = r"""
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|\z)', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'),
    '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text
  FROM pages)"""

EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) x ON x.a = e.vec_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) y ON y.a = e.vec_id"""

DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 3),
sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM cells JOIN sizes USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN sizes USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, k::INT AS rank FROM ranked WHERE part = 'pair' OR k <= 200"""


def merkle_sql(levels: int = 14, over: int = 8) -> str:
    """The manifest for sources of up to 3 ** ``levels`` documents and up to 3 ** ``over`` sources: a step for each level."""

    def leaf(text: str) -> str:
        values = [("doc_id", "doc_id::VARCHAR"), ("source", "source"), ("lang", "lang"), ("n_chars", "n_chars::VARCHAR"), ("text", text)]
        return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END" for c, v in values) + ")"

    def up(name: str, n: int) -> tuple[list[str], str]:
        steps = []
        for k in range(n):
            steps.append(f"{name}_runs_{k} AS (SELECT tree, pos // 3 AS pos, any_value(n) AS n, list(d ORDER BY pos) AS ds FROM {name}_{k} WHERE n > 1 GROUP BY 1, 2)")
            steps.append(f"{name}_{k + 1} AS (SELECT tree, pos, (n + 2) // 3 AS n, sha256(array_to_string(ds, '')) AS d FROM {name}_runs_{k})")
        return steps, " UNION ALL ".join(f"SELECT tree, d FROM {name}_{k} WHERE n = 1" for k in range(n + 1))

    def fold(way: str, name: str, n: int) -> list[str]:
        steps = []
        for k in range(n):
            low, high = "array_to_string(ds[1:pos_0 % 3], '')", "array_to_string(ds[pos_0 % 3 + 2:], '')"
            steps.append(
                f"{way}_{k + 1} AS (SELECT doc_id, leaf, sub, source, tree, CASE WHEN ds IS NULL THEN pos_0 ELSE pos_0 // 3 END AS pos_0, "
                f"CASE WHEN ds IS NULL THEN cur ELSE sha256({low} || cur || {high}) END AS cur, CASE WHEN ds IS NULL THEN proof ELSE proof || {low} || {high} END AS proof "
                f"FROM {way}_{k} w LEFT JOIN {name}_runs_{k} r USING (tree) WHERE r.pos IS NULL OR r.pos = w.pos_0 // 3)"
            )
        return steps

    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    odd = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {step}), 4294967295) & 1"
    source_levels, subroots = up("s", levels)
    top_levels, roots = up("t", over)
    name = "coalesce('=' || source, '')"
    parts = [
        f"leaves AS (SELECT doc_id, source, {leaf('text')} AS d, {leaf('text_seen')} AS seen FROM (SELECT *, CASE WHEN {odd} = 0 THEN replace(text, chr(10), '') ELSE text END AS text_seen FROM documents))",
        f"placed AS (SELECT *, {name} AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves)",
        "s_0 AS (SELECT tree, pos, n, d FROM placed)", *source_levels, f"subroots AS ({subroots})",
        "t_0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, d, tree AS source FROM subroots)", *top_levels, f"roots AS ({roots})",
        "w_0 AS (SELECT doc_id, p.d AS leaf, b.d AS sub, source, tree, pos AS pos_0, seen AS cur, '' AS proof FROM placed p JOIN subroots b USING (tree))", *fold("w", "s", levels),
        f"x_0 AS (SELECT doc_id, leaf, sub, w.source, 0 AS tree, t_0.pos AS pos_0, cur, proof FROM w_{levels} w JOIN t_0 ON t_0.source = w.tree)", *fold("x", "t", over),
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, sub AS subroot, r.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = r.d AS verified FROM x_{over}, roots r"


ORACLES: dict[str, str] = {
    "op2_html": HTML_SQL, "op3_embeddings": EMBEDDING_SQL, "op5_line_dedup": line_dedup.line_dedup_sql(), "op7_url_filter": URL_SQL, "op9_decontaminate": decontaminate.leaks_sql(),
    "op12_divergence": DIVERGENCE_SQL, "op13_merkle": merkle_sql(),
}
