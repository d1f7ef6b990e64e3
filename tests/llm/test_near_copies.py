"""Near-copy operators against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hourline.llm import bktree, components, embeddings, simhash


def groups_of(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("n,bits", [(0, 64), (1, 64), (300, 64), (500, 9), (700, 14)])
@pytest.mark.parametrize("radius", [0, 1, 4])
def test_bk_tree_loses_no_link(n, bits, radius):
    rng = np.random.default_rng(n + bits)
    prints = np.unique(rng.integers(0, 1 << bits, n, dtype=np.uint64)) if bits < 64 else rng.integers(0, 1 << 63, n, dtype=np.uint64)
    near = [(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= radius]
    prints = prints[:, None]
    low, high = bktree.links(prints, radius)
    assert groups_of(len(prints), zip(low, high, strict=True)) == groups_of(len(prints), near)
    found = {(int(a), int(b)) for x, y in bktree.BkTree(prints).near(prints, np.arange(len(prints)), radius) for a, b in zip(x, y, strict=True) if a > b} if n else set()
    assert found == set(near)


@pytest.mark.parametrize("shape", ["path", "star", "random", "none", "loops"])
def test_components(spark, shape):
    r = random.Random(3)
    edges = {
        "path": [(i, i + 1) for i in range(60)], "star": [(99, i) for i in range(40)], "none": [], "loops": [(1, 1), (None, 2), (3, 4), (4, 3), (3, 4)],
        "random": [(r.randrange(80), r.randrange(80)) for _ in range(60)],
    }[shape]
    out = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = groups_of(100, real)
    assert out == {i: want[i] for e in real for i in e}


def simple_fingerprint(text, k):
    words = (text or "").lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def corpus():
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefghij") * 3 for _ in range(r.randrange(1, 60))) for _ in range(12)]
    rows = [*base, *base[:4], base[0].upper(), base[1].replace(" ", "\n\t"), "", None, "word", "word", "x " * 40000]
    for t in base:
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        rows += [" ".join(w), " ".join([*t.split(), "more"])]
    return rows


def test_fingerprint_counts_all_steps(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(400))
    whole = simhash.fingerprint(text.encode(), 4)
    monkeypatch.setattr(simhash, "_STEP", 7)
    assert simhash.fingerprint(text.encode(), 4) == whole == [simple_fingerprint(text, 4)]


@pytest.mark.parametrize("radius", [3, 12])
def test_simhash_groups(clashing, radius):
    texts = corpus()
    out = {r.doc_id: r for r in simhash.near_copies(clashing(texts).repartition(5), shingle=4, radius=radius).collect()}
    prints = [simple_fingerprint(t, 4) for t in texts]
    assert [out[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    assert [out[i].component_id for i in range(len(texts))] == groups_of(len(texts), links)


def test_simhash_nulls_and_repeats(docs):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "only null ids here at all"), (3, None)]
    out = sorted(((r.doc_id, r.component_id) for r in simhash.near_copies(docs(rows)).collect()), key=str)
    assert out == sorted([(None, 7), (7, 7), (7, 7), (None, None), (3, 3)], key=str)
    assert simhash.near_copies(docs([])).count() == 0


def near(texts, k, radius):
    """Links (i, j) between texts whose fingerprints differ in at most ``radius`` bits."""
    prints = [simple_fingerprint(t, k) for t in texts]
    return [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]


def edited_corpus():
    """Texts with copies in which one to twelve words in a hundred differ, and unrelated ones."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(4))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(r.randrange(60, 240))]
        texts.append(" ".join(base))
        for share in (0.01, 0.02, 0.03, 0.06, 0.12):
            texts.append(" ".join(word() if r.random() < share else w for w in base))
    return texts + [" ".join(word() for _ in range(n)) for n in range(1, 60)]


@pytest.mark.parametrize("radius", [0, 4, 10])
def test_keep_first_keeps_one_whole_row(clashing, radius):
    texts = [*corpus(), *edited_corpus()]
    rows = clashing([*enumerate(texts), (None, texts[0]), (2, texts[2]), (None, "a text of its own without id")]).repartition(4)
    kept = simhash.keep_first(rows, shingle=4, radius=radius)
    assert kept.columns == rows.columns
    out = kept.collect()
    got = sorted(-1 if r.doc_id is None else r.doc_id for r in out)
    assert got == sorted({-1, *groups_of(len(texts), near(texts, 4, radius))})
    assert all(r.label == "label-" + ("-" if r.text is None else r.text) for r in out)
    assert simhash.keep_first(rows.limit(0)).count() == 0


def test_keep_first_keeps_what_near_copies_names(docs):
    rows = docs(edited_corpus())
    named = simhash.near_copies(rows, shingle=4, radius=4)
    assert {r.doc_id for r in simhash.keep_first(rows, shingle=4, radius=4).collect()} == {r.component_id for r in named.collect()}


def test_repeated_rows_leave_one(docs):
    rows = docs([(5, "a b c d e")] * 4 + [(None, "a b c d e")] * 3 + [(None, "x y z u v")] * 2 + [(1, "other words that stay here")])
    out = simhash.keep_first(rows).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([(5, "a b c d e"), (None, "x y z u v"), (1, "other words that stay here")], key=str)


@pytest.mark.parametrize("crowd", [3, 40, 1 << 14])
def test_hot_shards_are_cut_into_blocks(spark, crowd):
    """A family around one centre: all in a few shards, whose blocks meet two by two."""
    rng = np.random.default_rng(3)
    prints = np.uint64(0x0123456789ABCDEF) ^ np.array([sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(250)], dtype=np.uint64)
    prints = np.unique(np.append(prints, rng.integers(0, 1 << 63, 50, dtype=np.uint64)))
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fingerprint BIGINT")
    shards = simhash._shards(frame, 4)
    most = simhash._block_pairs(shards, crowd).groupBy("pair", "x", "y", "low", "high").count().agg(F.max("count")).first()[0]
    assert most <= max(4 * crowd, 20)
    order = {int(p): i for i, p in enumerate(prints.view(np.int64))}
    edges = [(order[r.a], order[r.b]) for r in simhash.fingerprint_links(frame, 4, crowd).collect()]
    want = [(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 4]
    assert groups_of(len(prints), edges) == groups_of(len(prints), want)


def vectors(seed=2, n=60):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 16))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    rows += [(100 + i, (v + rng.normal(size=16) * s).tolist(), int(i % 3)) for i, v in enumerate(base[:40]) for s in [(0.02, 0.05, 0.1, 0.2)[i % 4]]]
    rows += [(200 + i, (base[0] * 3).tolist(), 0) for i in range(9)] + [(300 + i, base[3].tolist(), 0) for i in range(5)]
    inf, nan = float("inf"), float("nan")
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [1.0, None, 2.0], 1), (404, [nan] + [1.0] * 15, 1), (405, [inf] + [1.0] * 15, 1), (406, base[0].tolist(), None), (407, base[0].tolist(), None)]
    rows += [(408, [1.0, 2.0], 2), (409, [1.0, 2.0], 2), (410, [1e200] * 16, 2), (411, [1e-200] * 16, 2), (412, [-0.0, 1.0], 2), (413, [0.0, 1.0], 2)]
    return rows


def brute(rows, threshold):
    good = [(i, np.array(v), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = []
    for x in range(len(good)):
        for y in range(x):
            a, b = good[x][1] / np.abs(good[x][1]).max(), good[y][1] / np.abs(good[y][1]).max() if len(good[y][1]) else 0
            if good[x][2] == good[y][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links.append((good[x][0], good[y][0]))
    groups = groups_of(1000, links)
    return {i: (sum(i in e for e in links), groups[i], groups[i] == i) for i, _, _ in rows}


@pytest.mark.parametrize("block", [embeddings.BLOCK, 3])
def test_embeddings(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT").withColumns({"node": F.lit("x"), "v": F.lit("y"), "weight": F.lit(1)})
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_copies(df.repartition(4), threshold=0.98, block=block).collect()}
    assert out == brute(rows, 0.98)


def test_embeddings_find_pairs_at_the_threshold(spark):
    """Pairs just above 0.98 are the hardest to find."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        a, b = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (0.9801 * a + np.sqrt(1 - 0.9801**2) * b).tolist(), 0)]
    out = embeddings.near_copies(spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT"))
    assert out.filter("n_links = 1").count() >= 594


def test_embeddings_repeats_and_null_ids(spark):
    rows = [(None, [1.0, 0.0], 1), (4, [2.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (None, None, 1)]
    out = embeddings.near_copies(spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str) == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 0, None), (None, 0, None)], key=str)
    assert embeddings.near_copies(spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")).count() == 0
