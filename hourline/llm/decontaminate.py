"""Benchmark decontamination with spaced seeds, in DataFrame operations only.

A seed is a mask over neighbouring words: it takes the words under its ones and ignores those under
its zeros (Ma, Tromp and Li, "PatternHunter", 2002). The hashes of all seeds at all places of a
benchmark item meet those of every document. A hit tells how the item lies along the document; the
words there are compared one by one, so changed words between hits do no harm. A document leaks an
item if in some ``WINDOW`` neighbouring words of the item (the whole item if it is shorter) a share of
``SIMILARITY`` stands in the document at the same distance.

The documents are read once and their words are never shuffled: hits carry the stretch they lie in.
Benchmark seeds are broadcast in blocks of at most ``MAX_SEEDS``; a larger benchmark takes more passes
over the documents. Hits on the same lie are one row before words are compared.

The four ``SEEDS`` hit every item of seven words or more that reaches the share. Items of five or six words have ``SHORT_SEEDS`` as well,
so that one changed word anywhere is passed over, and an item of fewer words is a seed as a whole. Documents are hashed under such seeds only if
the benchmark has such items.

Words are runs of letters and digits, in lower case. Defined results: null texts count as empty; items
without words are not searched for; repeated rows and items give one leak;
a null id is an id like any other. ``drop_leaks`` keeps rows and columns as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.llm.frames import col, stored

#: Five words each, with up to two ignored between.
SEEDS = ("11111", "110111", "1101011", "11001011")
#: Four words each, for items of five or six words.
SHORT_SEEDS = ("1111", "10111", "11011", "11101")
WINDOW = 13
SIMILARITY = 0.8
#: Benchmark seeds of a broadcast: about 60 bytes each in memory.
MAX_SEEDS = 500_000


def words(text: F.Column) -> F.Column:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.split(plain, " ")


def _masks_for(n: F.Column, mask: str) -> F.Column:
    """Whether items of ``n`` words have a seed of this mask."""
    if mask in SEEDS:
        return n >= 5
    return n.isin(5, 6) if mask in SHORT_SEEDS and len(mask) > 4 else n.isin(4, 5, 6) if mask == "1111" else n == len(mask)


def _masks(n_words: set[int]) -> list[str]:
    """The masks that items of these sizes need."""
    return [*(SEEDS if max(n_words, default=0) >= 5 else ()), *(SHORT_SEEDS if n_words & {5, 6} else ("1111",) if 4 in n_words else ()), *("1" * n for n in sorted(n_words & {1, 2, 3}))]


def _seed_hashes(w: F.Column, at: F.Column, masks: list[str], n: F.Column | None = None) -> F.Column:
    """(seed, hash) of each seed that fits between place ``at`` (from 0) and the end."""
    made = []
    for mask in masks:
        taken = [F.get(w, at + i) for i, c in enumerate(mask) if c == "1"]
        fits = at + len(mask) <= F.size(w)
        made.append(F.when(fits if n is None else fits & _masks_for(n, mask), F.xxhash64(F.lit(mask), *taken)))
    return F.array(*made)


def _places(rows: DataFrame, masks: list[str], *keep: str, sized: bool = False) -> DataFrame:
    """(keep, w, at, h): a row for each place and seed of the words ``w``; ``sized`` for items, whose ``n`` words choose their seeds."""
    shortest = min(map(len, masks))
    long = rows.filter(F.size("w") >= shortest)
    placed = long.select(*keep, "w", F.explode(F.sequence(F.lit(0), F.size("w") - shortest)).alias("at"))
    hashes = _seed_hashes(F.col("w"), F.col("at"), masks, F.col("n") if sized else None)
    return placed.select(*keep, "w", "at", F.explode(hashes).alias("h")).filter("h IS NOT NULL")


def _needed(n: F.Column) -> F.Column:
    return F.ceil(F.least(n, F.lit(WINDOW)) * SIMILARITY)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_seeds: int = MAX_SEEDS) -> DataFrame:
    """(doc, content, item, n_words, n_found): each document and the items it leaks. ``content`` is the
    text's hash and ``n_found`` the most words found in one window."""
    split = benchmark.select(col(item_col).alias("item"), F.explode(F.array(words(col(item_text_col)))).alias("w"))
    items = stored(split.distinct().filter(F.get("w", F.lit(0)) != "").select("item", F.xxhash64("w").alias("item_hash"), "w"), "items")
    sizes = items.select(F.least(F.size("w"), F.lit(7)).alias("n")).distinct().collect()  # seven rows at most
    masks = _masks({r.n for r in sizes}) or [SEEDS[0]]
    places = _places(items.withColumn("n", F.size("w")), masks, "item", "item_hash", "n", sized=True)
    seeds = stored(places.select("h", "item", "item_hash", "n", F.col("at").alias("item_at")), "seeds")
    texts = docs.select(col(id_col).alias("doc"), F.xxhash64(col(text_col).cast("string")).alias("content"), F.explode(F.array(words(col(text_col)))).alias("w"))
    n_blocks = max(1, -(-seeds.count() // max_seeds))
    blocks = [seeds.filter(F.pmod(F.xxhash64("h"), F.lit(n_blocks)) == b) for b in range(n_blocks)]
    found = reduce(DataFrame.unionByName, [_hits(texts, block, masks) for block in blocks])
    return _verified(found, items)


def _hits(texts: DataFrame, seeds: DataFrame, masks: list[str]) -> DataFrame:
    """(doc, content, item, item_hash, lie, near): the place of the item's first word in the document, which may be
    before its beginning, and the document's words from there on, as many as the item has."""
    met = _places(texts, masks, "doc", "content").join(F.broadcast(seeds), "h")  # max_seeds rows at most
    lie = F.col("at") - F.col("item_at")
    return met.select("doc", "content", "item", "item_hash", lie.alias("lie"), F.slice("w", F.greatest(lie, F.lit(0)) + 1, F.col("n")).alias("near"))


def _verified(hits: DataFrame, items: DataFrame) -> DataFrame:
    lies = hits.groupBy("doc", "content", "item", "item_hash", "lie").agg(F.first("near").alias("near"))
    named = items.select(F.col("item").alias("named"), F.col("item_hash").alias("hash"), "w")
    lies = lies.join(named, (F.col("item_hash") == F.col("hash")) & F.col("item").eqNullSafe(F.col("named")))
    n = F.size("w")
    window = F.least(n, F.lit(WINDOW))
    same = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.coalesce((F.get("near", j + F.least("lie", F.lit(0))) == F.get("w", j)).cast("int"), F.lit(0)))
    flagged = lies.select("doc", "content", "item", n.alias("n_words"), window.alias("window"), F.explode(F.array(same)).alias("same"))
    sums = F.transform(F.sequence(F.lit(0), F.col("n_words") - F.col("window")), lambda k: F.aggregate(F.slice("same", k + 1, F.col("window")), F.lit(0), lambda x, y: x + y))
    best = flagged.select("doc", "content", "item", "n_words", "window", F.array_max(sums).alias("n_found"))
    leaks = best.filter(F.col("n_found") >= F.ceil(F.col("window") * SIMILARITY))
    return leaks.groupBy("doc", "content", "item", "n_words").agg(F.max("n_found").alias("n_found"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item."""
    leaks = find_leaks(docs, benchmark, id_col, text_col, **names).select("doc", "content").distinct()
    rows = docs.select(F.struct("*").alias("row"), col(id_col).alias("id"), F.xxhash64(col(text_col).cast("string")).alias("hash"))
    met = (F.col("hash") == F.col("content")) & F.col("id").eqNullSafe(F.col("doc"))
    return rows.join(leaks, met, "left_anti").select("row.*")


def leaks_sql() -> str:
    """The rows of the leak query: the same seeds, joined as text."""
    def seeds(table: str, key: str) -> str:
        parts = []
        for mask in (*SEEDS, *SHORT_SEEDS, "1", "11", "111"):
            taken = " || ' ' || ".join(f"w[p + {i + 1}]" for i, c in enumerate(mask) if c == "1")
            own = ">= 5" if mask in SEEDS else "IN (5, 6)" if mask in SHORT_SEEDS and len(mask) > 4 else "IN (4, 5, 6)" if mask == "1111" else f"= {len(mask)}"
            chosen = f"len(w) {own} AND w[1] <> ''" if table == "bw" else f"len(w) >= {len(mask)} AND EXISTS (SELECT 1 FROM bw b WHERE len(b.w) {own})"
            parts.append(f"SELECT {key}, p, '{mask} ' || {taken} AS h FROM (SELECT {key}, w, unnest(range(len(w) - {len(mask)} + 1)) AS p FROM {table} WHERE len(w) >= {len(mask)} AND {chosen})")
        return " UNION ALL ".join(parts)

    def split(table: str, key: str) -> str:
        return rf"SELECT {key}, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM {table}"

    return f"""
WITH dw AS ({split('documents', 'doc_id')}), bw AS ({split('benchmark', 'item_id')}),
lies AS (SELECT DISTINCT doc_id, item_id, d.p - b.p AS lie FROM ({seeds('dw', 'doc_id')}) d JOIN ({seeds('bw', 'item_id')}) b USING (h)),
same AS (
  SELECT doc_id, item_id, lie, len(bw.w) AS n, j, CASE WHEN lie + j >= 0 AND lie + j < len(dw.w) AND dw.w[lie + j + 1] = bw.w[j + 1] THEN 1 ELSE 0 END AS hit
  FROM (SELECT *, unnest(range(len(bw.w))) AS j FROM lies JOIN bw USING (item_id)) x JOIN dw USING (doc_id) JOIN bw USING (item_id)),
sums AS (SELECT doc_id, item_id, lie, n, j, sum(hit) OVER (PARTITION BY doc_id, item_id, lie ORDER BY j ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS s FROM same)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_words, CAST(max(s) AS BIGINT) AS n_found FROM sums
WHERE j <= n - least(n, {WINDOW}) GROUP BY doc_id, item_id, n HAVING max(s) >= ceil(least(n, {WINDOW}) * {SIMILARITY})"""
