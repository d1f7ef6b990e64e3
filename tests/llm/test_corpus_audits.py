"""Repeated passages, source divergence and Merkle manifest against plain programs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourline.llm import divergence, merkle, queries, repeats

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


# --- repeated passages -------------------------------------------------------------------------


def without_repeats(rows, window):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + window] for _, b in texts for k in range(len(b) - window + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def dropped(df, **params):
    return sorted((tuple(r) for r in repeats.drop_repeats(df, **params).collect()), key=str)


def texts_with_repeats(seed):
    """Random texts that share passages around the window's length, over few and many letters."""
    rng = random.Random(seed)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    passages = [word(rng.randint(40, 160), letters) for letters in ("abcdefgh ", "ab", "äöü日本 x") for _ in range(3)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                cut = rng.randrange(len(p))
                p = p[:cut] + word(1, "xyz") + p[cut + 1 :]
            parts += [word(rng.randint(0, 70), "abcdefgh "), p[rng.randint(0, 30) :]]
        texts.append("".join(parts))
    return [*texts, "ab" * 200, "a" * 500, "a" * 64, "a" * 63, "", None, texts[0], texts[1], texts[1]]


@pytest.mark.parametrize("group", [4096, 2])
def test_repeats_equal_brute_force(docs, group):
    """With groups of two at most, all others are halved down to whole windows."""
    rows = list(enumerate(texts_with_repeats(7)))
    assert dropped(docs(rows), window=64, cell=32, group=group) == without_repeats(rows, 64)


def test_repeats_of_the_given_documents(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = dropped(df)
    assert got == without_repeats(rows, 400) and sum(r[2] for r in got) > 0


def test_long_texts_are_cut_in_pieces(docs, monkeypatch):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    rows = list(enumerate([long, long[2000:3000] + "x" + long[500:1400], long[:64] + long[100:170], "q" * 4000]))
    want = without_repeats(rows, 64)
    for size in (1000, 1 << 17):
        monkeypatch.setattr(repeats, "PIECE", size)
        pieces = [p for piece in repeats._pieces([(t or "").encode() for _, t in rows], 64) for p in piece]
        assert len(pieces) == (16 if size == 1000 else 4)
        found = [repeats.parse(piece, 64, 32) for piece in repeats._pieces([(t or "").encode() for _, t in rows], 64)]
        cores = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
        starts = Counter((r, a - j) for r, a, lo, hi in zip(cores["row"], cores["at"], cores["lo"], cores["hi"], strict=True) for j in range(lo, hi + 1))
        assert set(starts.values()) == {1} and len(starts) == sum(len(t) - 63 for _, t in rows)
    assert dropped(docs(rows), window=64, cell=32) == want


def test_equal_windows_have_equal_cores():
    rng = random.Random(5)
    passage = bytes(rng.choice(b"abc ") for _ in range(300))
    texts = [bytes(rng.choice(b"abc ") for _ in range(n)) + passage + b"#" * n for n in (0, 13, 200)]
    found = repeats.parse(next(repeats._pieces(texts, 64)), 64, 32)
    by = defaultdict(set)
    for key, row, at, lo, hi in zip(*(found[n] for n in ("key", "row", "at", "lo", "hi")), strict=True):
        for j in range(lo, hi + 1):
            by[texts[row][at - j : at - j + 64]].add((key, j))
    assert all(len(kinds) == 1 for kinds in by.values())


def test_repeats_of_hot_passage(docs):
    """A passage in a third of the documents, each with other words around it: one group, cut to small ones."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(150)
    rows = [(i, word(80) + (passage if i % 3 == 0 else word(150)) + word(80)) for i in range(300)]
    got = dropped(docs(rows), window=64, cell=32, group=20)
    assert got == without_repeats(rows, 64) and sum(r[2] >= 150 for r in got) == 100


def test_repeats_of_odd_tables(spark, docs, clashing):
    assert dropped(docs([])) == []
    text = "word " * 100
    rows = [(None, text), (None, text), (1, "x" * 399), (2, "x" * 399), (3, None), (3, None)]
    assert dropped(docs(rows)) == without_repeats(rows, 400)
    assert dropped(clashing(rows)) == without_repeats(rows, 400)
    named = docs([(1, text), (2, text + "y")]).select(F.col("doc_id").alias("a.b"), F.col("text").alias("t1"), "lang", F.lit(1).alias("bytes"))
    assert [r[2] for r in dropped(named, id_col="a.b", text_col="t1")] == [500, 500]


def test_repeats_give_runs_and_what_is_left(docs):
    """Runs and bytes themselves, next to the digests made from them; a run that ends inside a character, and copies that go whole."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(99)
    texts = [word(50) + passage + "ä" + word(30), passage + "ö" + word(10), passage + "z" + word(70) + passage, passage[:63], word(90), "", None, *[word(80)] * 2]
    rows = list(enumerate([*texts, texts[0]]))
    df = docs(rows)
    got = repeats.cut_repeats(df, window=64, cell=32).select("*", *(c.alias(f"d{i}") for i, c in enumerate(repeats.digests())), repeats.kept_text().alias("left")).collect()
    assert sorted(((r.doc_id, r.d0, r.d1, r.d2, r.d3) for r in got), key=str) == without_repeats(rows, 64)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        data, at, kept = (t or "").encode(), 0, b""
        for begin, end in by[i].spans:
            assert at <= begin < end <= len(data)
            kept, at = kept + data[at:begin], end
        assert bytes(by[i].kept) == kept + data[at:] and by[i].left == (kept + data[at:]).decode(errors="replace") and by[i].n_bytes == len(data)
    assert [len(by[i].spans) for i in range(10)] == [1, 1, 2, 0, 0, 0, 0, 1, 1, 1]
    assert by[1].left.startswith("\ufffd") and by[3].left == passage[:63] and by[7].left == by[9].left == ""


def test_repeats_query_shows_the_text_that_is_left(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.op11_repeats(spark, FOLDER).collect()
    assert sorted((r.doc_id for r in got)) == sorted(docs)
    assert all((r.text == docs[r.doc_id]) == (r.n_removed == 0) and r.n_bytes == len(docs[r.doc_id].encode()) for r in got)
    cut = [r for r in got if r.n_removed and "\ufffd" not in r.text]
    assert cut and all(len(r.text.encode()) == r.n_bytes - r.n_removed and hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in cut)


# --- source divergence -------------------------------------------------------------------------


def audited(rows, min_docs=3, top=200):
    """From (lang, source, text) rows."""
    holds, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        c = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER)))
        holds[lang].update(c.keys())
        counts[lang, source].update(c)
        counts[lang].update(c)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in holds[lang].items() if n >= min_docs]

        def shares(group, kept=kept):
            size = sum(counts[group][t] for t in kept)
            return {t: 1 + 10**9 * (counts[group][t] + 1) // (size + len(kept)) for t in kept}

        whole, by = shares(lang), {s: shares((lang, s)) for g, s in groups if g == lang}
        apart = lambda p, q: (p - q) ** 2 // q
        for s, p in by.items():
            pairs = sorted((-sum(apart(p[t], by[o][t]) for t in kept), o.encode()) for o in by if o != s)
            terms = sorted((-apart(p[t], whole[t]), t.encode()) for t in kept if counts[lang, s][t] and p[t] > whole[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


def audit_of(df, **params):
    return sorted(tuple(r) for r in divergence.audit(df, **params).collect())


@pytest.mark.parametrize("piece", [divergence.PIECE, 400])
def test_divergence_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(divergence, "PIECE", piece)  # whole texts, or parts that go on
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert audit_of(df) == audited([(r.lang, r.source, r.text) for r in df.collect()])


def test_divergence_of_odd_tables(spark, docs, clashing):
    schema = "lang STRING, source STRING, text STRING, size BIGINT, kept STRING, item STRING"
    rows = [
        ("en", "a", "One two THREE three"), ("en", "a", "one"), ("en", "b", "one twofold straße ÄÄ"), ("en", "b", "straße one x9y"), ("en", None, "straße, two"),
        (None, None, None), (None, "c", "!!"), ("de", "only", "one one one"), ("de", "only", "one one one"), ("de", "only", "one"), ("fr", "a", "\x00 ab_cd-ab\x7fcd"), ("fr", "d", "ab"), ("fr", "e", "ab" * 3000),
    ]
    df = spark.createDataFrame([(*r, 1, "k", "i") for r in rows], schema)
    assert audit_of(df) == audited(rows)
    assert audit_of(df, min_docs=1, top=2) == audited(rows, 1, 2)
    assert audit_of(df.limit(0)) == []


def test_prefixes_of_rare_terms_go(spark, docs):
    """What the first level rules out isn't counted by the second one."""
    df = docs(["alphabet alpine", "alphabet", "alphabets", "beta", "betamax gamma"]).select("lang", "source", "text")
    first = divergence._prefixes(df, 4, None).groupBy("key").agg(F.sum("n").alias("n"))
    assert sorted(r.n for r in first.collect()) == [1, 1, 2, 3]  # alpi, gamm, beta, alph
    sieve = divergence.Sieve(first.filter("n >= 3"))
    second = divergence._prefixes(df, 8, (4, sieve)).groupBy("key").agg(F.sum("n").alias("n"))
    assert [r.n for r in second.collect()] == [3]
    kept = divergence.kept_terms(df)
    assert [(r.term, r.total) for r in kept.collect()] == []
    assert [(r.term, r.total) for r in divergence.kept_terms(df, min_docs=2).collect()] == [("alphabet", 2)]


# --- Merkle manifest ---------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def proved(rows, arity=3):
    """From dicts of documents' columns."""

    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    def tree(nodes):
        paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            runs = [(nodes[b : b + arity], groups[b : b + arity]) for b in range(0, len(nodes), arity)]
            for run, members in runs:
                for slot, own in enumerate(members):
                    for i in own:
                        paths[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            nodes, groups = [sha("".join(run)) for run, _ in runs], [sum(members, []) for _, members in runs]
        return nodes[0], paths

    by = defaultdict(list)
    for k, r in enumerate(rows):
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), k))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in sources}
    root, over = tree([trees[s][0] for s in sources]) if sources else (None, [])
    out = []
    for n, s in enumerate(sources):
        for (_, _, own, k), path in zip(sorted(by[s]), trees[s][1], strict=True):
            text, number = rows[k]["text"], rows[k]["doc_id"]
            if number is not None and text is not None and zlib.crc32(str(number).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node, path = leaf(rows[k], text), path + over[n]
            for before, after in path:
                node = sha(before + node + after)
            out.append((number, own, trees[s][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def manifest_of(df, **params):
    return sorted((tuple(r) for r in merkle.manifest(df, **params).collect()), key=str)


@pytest.mark.parametrize("arity", [3, 2, 5])
def test_manifest_equals_brute_force(spark, arity):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [r.asDict() for r in df.collect()]
    got = manifest_of(df, arity=arity)
    assert got == proved(rows, arity) and {r[-1] for r in got} == {True, False}


def test_manifest_of_odd_tables(spark, docs, clashing):
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    rows = [
        (1, "a\nb", "en", "z", 3), (1, "a\nb", "en", "z", 3), (2, "a\nb", "en", "z", None), (None, "x\n", None, "z", 1), (None, "y", None, None, 1), (-5, None, None, None, None),
        (10, "ü\n日本", "de", "", 4), (11, "", "de", "é", 0), (12, "\n\n", "de", "Z", 2), (13, "plain", "de", "Z", 2),
    ]
    df = spark.createDataFrame(rows, schema)
    want = proved([r.asDict() for r in df.collect()])
    assert manifest_of(df) == want
    assert manifest_of(df.withColumns({n: F.lit(n) for n in ("tree", "place", "n", "digest", "id", "seen", "path")})) == want
    assert manifest_of(df.limit(0)) == []
    one = df.filter("doc_id = 13")
    assert manifest_of(one) == proved([r.asDict() for r in one.collect()])


def test_large_source_is_spread(spark, docs):
    """Places come from ranges, not from one window over a source."""
    df = docs([(i * 7 % 2000, f"text {i}\n") for i in range(2000)])
    assert manifest_of(df) == proved([r.asDict() for r in df.collect()])
    placed = merkle.with_places(df.select(F.lit("s").alias("tree"), F.col("doc_id").alias("id"), F.col("text").alias("digest")), "tree", "id", "digest")
    assert [(r.place, r.n) for r in placed.orderBy("id", "digest").collect()] == [(i, 2000) for i in range(2000)]
