"""Line dedup with a log-template tree, in DataFrame operations only.

A line is parsed down a tree of fixed depth: its number of fields, then its ``LEADING`` first fields.
In a leaf, fields with a digit count as variable if the line has at least ``LITERAL`` others and at least as many others as variable
ones: tables of numbers and numbered headings keep their values. Every template that a line fits is a key: the
line's fields as they are, and, from ``MIN_FIELDS`` fields on, the line with one block of a fifth of
its fields left open. Open blocks begin at fields ``LEADING``, ``LEADING`` + width and so on. So two lines of as many fields share a template if
their leading fields agree and what differs lies in one such block; a change that reaches over a border, stands among the leading
fields, or adds or takes a field makes other templates. Passages that recur inside longer lines are what ``repeats`` finds.

A template recurs if lines of different documents fit it. Its lines are dropped from every document
but the first, by id. Templates are hashed (32 bits for the leaf, 64 for the rest) and counted with a map-side combine, so a line
that a third of all documents hold is one row from each task; a line costs a handful of keys, and only
texts that lose lines are written anew.

Defined results: a null text stays null; empty lines are never dropped, and a document all of whose
lines go stays, with what empty lines it has. Lines that recur within one document only are kept, and
rows of equal id are one document; a null id comes before all others and is one document. Repeated
rows give repeated rows. All columns pass through; only the text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.llm.frames import col, stored

LEADING = 3
MIN_FIELDS = 8
#: Fields without a digit that a line has at least, if its others are to count as variable.
LITERAL = 2
#: Blocks that a line's fields make: at most a share of 1 / BLOCKS differs.
BLOCKS = 5


def fields(line: F.Column) -> F.Column:
    """A line's fields; those with a digit are variable in a line with enough others. Most lines need no rewriting."""
    spaced = F.translate(line, "\t\r\f\v", "    ")
    plain = F.array_remove(F.split(F.when(line.rlike("[\t\r\f\x0b]"), spaced).otherwise(line), " "), "")

    def masked(f: F.Column) -> F.Column:
        n = F.size(F.filter(f, lambda x: x.rlike("[0-9]")))
        literal = F.size(f) - n
        return F.when((literal >= LITERAL) & (literal >= n), F.transform(f, lambda x: F.when(x.rlike("[0-9]"), "<*>").otherwise(x))).otherwise(f)

    return F.when(line.rlike("[0-9]"), F.get(F.transform(F.array(plain), masked), F.lit(0))).otherwise(plain)


def template_keys(f: F.Column, hashes: F.Column) -> F.Column:
    """The templates that a line with the fields ``f`` fits, as (leaf, rest).

    The leaf is the line's place in the tree: its number of fields and the leading ones. The rest is
    the exclusive-or of the other fields' hashes, each salted with its place, so leaving a block open
    costs the block's fields only.
    """
    n = F.size(f)
    width = (n / BLOCKS).cast("int")

    def mixed(values: F.Column) -> F.Column:
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda x, h: x.bitwiseXOR(h))

    whole = mixed(hashes)
    starts = F.sequence(F.lit(LEADING), n - 1, width)
    generalised = F.transform(starts, lambda s: F.xxhash64(s, whole.bitwiseXOR(mixed(F.slice(hashes, s + 1, width)))))
    exact = F.array(F.xxhash64(F.lit(0), whole))
    leaf = F.hash(n, F.slice(f, F.lit(1), F.least(n, F.lit(LEADING))))
    return F.struct(leaf.alias("leaf"), F.when(n < MIN_FIELDS, exact).otherwise(F.concat(exact, generalised)).alias("rests"))


def _line_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, content, k, x, y): a row for each line and template; content tells rows of one id apart."""
    rows = docs.select(F.coalesce(col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("doc"), col(text_col).cast("string").alias("text"))
    lines = rows.select("doc", F.xxhash64("text").alias("content"), F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    # exploding an array of one keeps Spark from working out the fields again for each use
    parsed = lines.select("doc", "content", "k", F.explode(F.array(fields(F.col("line")))).alias("f")).filter(F.size("f") > 0)
    hashed = parsed.select("doc", "content", "k", "f", F.explode(F.array(F.transform("f", lambda t, i: F.xxhash64(t, i)))).alias("h"))
    keyed = hashed.select("doc", "content", "k", F.explode(F.array(template_keys(F.col("f"), F.col("h")))).alias("t"))
    return keyed.select("doc", "content", "k", F.explode("t.rests").alias("x"), F.col("t.leaf").alias("y"))


def recurring_templates(keys: DataFrame) -> DataFrame:
    """(x, y, first): templates that several documents hold, and the first of these."""
    spans = keys.groupBy("x", "y").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    return spans.filter("first < last").select("x", "y", "first")


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped_col: str | None = None) -> DataFrame:
    """``docs`` without recurring lines; ``dropped_col`` names a further column with their number."""
    keys = stored(_line_keys(docs, id_col, text_col), "line-keys")  # parsing costs more than reading this
    templates = stored(recurring_templates(keys), "templates")
    hits = keys.join(templates, ["x", "y"]).filter("first < doc")
    gone = hits.groupBy("doc", "content").agg(F.collect_set("k").alias("gone"))  # numbers of one text's lines
    row = docs.select(F.coalesce(col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(col(text_col).cast("string")).alias("content"), F.struct("*").alias("row"))
    met = row.join(gone, ["doc", "content"], "left").select("row", "gone")
    lines = F.split(F.col(f"row.`{text_col}`"), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
    met = met.select("row", "gone", F.when(F.col("gone").isNotNull(), lines).alias("lines"))
    columns = [text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]
    if dropped_col:
        columns.append(F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias(dropped_col))
    return met.select(*columns)


def line_dedup_sql() -> str:
    """The same rows as ``drop_recurring`` with counts, for tables without null or repeated ids."""
    return rf"""
WITH line AS (
  SELECT doc_id, k, f, len(f) AS n, len(f) // {BLOCKS} AS w FROM (
    SELECT doc_id, k, CASE WHEN len(list_filter(g, lambda x: NOT regexp_matches(x, '[0-9]'))) >= greatest({LITERAL}, len(list_filter(g, lambda x: regexp_matches(x, '[0-9]'))))
      THEN list_transform(g, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) ELSE g END AS f
    FROM (SELECT doc_id, k, string_split_regex(trim(translate(line, chr(9) || chr(13) || chr(12) || chr(11), '    ')), ' +') AS g FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents)
    WHERE regexp_matches(line, '\S')))),
keyed AS (
  SELECT doc_id, k, n || ':0:' || array_to_string(f, ' ') AS key FROM line
  UNION ALL
  SELECT doc_id, k, n || ':' || s || ':' || array_to_string(f[1:s], ' ') || chr(10) || array_to_string(f[s + w + 1:], ' ') AS key
  FROM (SELECT *, unnest(range({LEADING}, n, w)) AS s FROM line WHERE n >= {MIN_FIELDS})),
recurring AS (SELECT key, min(doc_id) AS first FROM keyed GROUP BY key HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, k FROM keyed JOIN recurring USING (key) WHERE first < doc_id),
kept AS (
  SELECT d.doc_id, string_agg(line, chr(10) ORDER BY d.k) AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents) d
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = d.doc_id AND g.k = d.k) GROUP BY d.doc_id)
SELECT doc_id, CAST(len(string_split(documents.text, chr(10))) AS BIGINT) AS n_lines,
  CAST(coalesce((SELECT count(*) FROM gone g WHERE g.doc_id = documents.doc_id), 0) AS BIGINT) AS n_dropped, coalesce(kept.text, '') AS text
FROM documents LEFT JOIN kept USING (doc_id)"""
