"""Quality, line dedup and decontamination against direct readings."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourline.llm import decontaminate, line_dedup, ngrams, quality

# --- quality -----------------------------------------------------------------------------------


def grams(text, n):
    """(n, buckets) by ngram_buckets, one text alone."""
    return sorted(b for _, found in ngrams.ngram_buckets([text], n) for b in found.tolist())


def test_ngrams_do_not_depend_on_the_pieces(monkeypatch):
    r = random.Random(1)
    texts = ["", " ", "One two, two; three", "x" * 50, *("".join(r.choice("ab é.,\n9") for _ in range(r.randrange(300))) for _ in range(40))]
    texts = [t.encode() for t in texts]
    whole = [grams(t, 1 << 30) for t in texts]
    words = [len(re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+", t)) for t in texts]
    assert [len(g) for g in whole] == [max(0, 2 * n - 1) for n in words]
    for piece in (16, 64):
        monkeypatch.setattr(ngrams, "PIECE", piece)
        together = [[] for _ in texts]
        for numbers, buckets in ngrams.ngram_buckets(texts, 1 << 30):
            for n, b in zip(numbers.tolist(), buckets.tolist(), strict=True):
                together[n].append(b)
        spaced = [t for t in texts if len(t) <= piece]
        assert [sorted(g) for t, g in zip(texts, together, strict=True) if t in spaced] == [g for t, g in zip(texts, whole, strict=True) if t in spaced]
    monkeypatch.setattr(ngrams, "PIECE", 100)
    long = b"some words and others, " * 90  # cut after spaces only
    cut = grams(long, 1 << 30)
    monkeypatch.setattr(ngrams, "PIECE", 1 << 20)
    assert cut == grams(long, 1 << 30)


def labelled_corpus(n=400):
    r = random.Random(4)
    good = ["the", "river", "runs", "to", "sea", "and", "hills", "stand", "over", "it", "in", "rain"]
    docs, labels = [], []
    for i in range(n):
        size = r.randrange(8, 60)
        junk = i % 5 == 0
        docs.append((i, " ".join((r.choice(good) + ("###" if junk else "")) for _ in range(size))))
        if i % 2:
            labels.append((i, 0 if junk else 1, 0))
    return docs, labels


def brute_weights(docs, fitted, n_buckets):
    raw, target = np.zeros(n_buckets), np.zeros(n_buckets)
    each = {}
    for i, t in docs:
        each[i] = np.array(grams((t or "").encode(), n_buckets), dtype=int)
        np.add.at(raw, each[i], 1)
        if i in fitted:
            np.add.at(target, each[i], 1)
    ratio = np.log((target + 2) / (raw * target.sum() / raw.sum() + 2))
    return {i: ratio[g].sum() / math.sqrt(max(1, len(g))) for i, g in each.items()}


def test_quality_weights_and_sample(spark, clashing):
    docs, labels = labelled_corpus()
    rows, marks = clashing(docs).repartition(5), spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")
    ids = {r.id: r.held_out for r in quality.target_ids(marks).collect()}
    assert set(ids) == {i for i, q, _ in labels if q} and 0 < sum(ids.values()) < len(ids) / 2
    kept = quality.resample(rows, marks)
    assert kept.columns == [*rows.columns, "_log_weight", "_key"]
    want = brute_weights(docs, {i for i, h in ids.items() if not h}, quality.BUCKETS)
    out = {r.doc_id: r for r in kept.collect()}
    assert all(abs(r._log_weight - want[i]) < 1e-9 for i, r in out.items())
    assert "evidence" not in kept.columns
    lowest = np.percentile([want[i] for i, h in ids.items() if h], 100 * (1 - quality.RECALL))
    k = sum(w >= lowest - 1e-12 for w in want.values())
    keys = {r.doc_id: r.key for r in rows.select("doc_id", (F.lit(0.0) + quality._noise("doc_id", "text", 7)).alias("key")).collect()}
    ranked = sorted((want[i] / quality.TEMPERATURE + keys[i] for i in want), reverse=True)
    assert len(out) == k and abs(min(r._key for r in out.values()) - ranked[k - 1]) < 1e-6
    assert sum(i % 5 != 0 for i in out) >= 0.9 * 320 and sum(i % 5 == 0 for i in out) <= 8


def toxic_corpus(n=600):
    r = random.Random(14)
    good = [a + b for a in ("ri", "va", "mo", "le", "su") for b in ("ver", "lley", "unt", "af", "n")]
    bad = ["idiot", "scum", "moron"]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(good) for _ in range(r.randrange(30, 400))]
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(bad))
        docs.append((i, " ".join(words)))
        if i % 2 == 0 or i % 7 == 0:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxic_documents_go_and_clean_ones_stay(spark, docs):
    rows, labels = toxic_corpus()
    marks = spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")
    kept = {r.doc_id for r in quality.resample(docs(rows).repartition(5), marks).collect()}
    toxic = {i for i, _ in rows if i % 6 == 0}
    assert not kept & toxic
    assert len(kept) >= 0.95 * (len(rows) - len(toxic))
    bad, clean = (quality.target_ids(marks, good=f"toxic = {t}") for t in (1, 0))
    grams, ratios = quality.telling_grams(docs(rows), bad, clean)
    told = {g for w in (b"idiot", b"scum", b"moron") for _, found in ngrams.ngram_buckets([w], quality.GRAMS) for g in found.tolist()}
    assert told <= set(grams.tolist()) and (ratios >= quality.TELLING).all() and (np.diff(grams) > 0).all()


def test_toxic_labels_of_the_given_documents(spark):
    """Held against the labels that the models weren't fitted on."""
    folder = "/root/testdata/sf0.01"
    rows, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    kept = {r.doc_id for r in quality.resample(rows.select("doc_id", "text"), marks).collect()}
    toxic, good = ({r.doc_id for r in marks.filter(c).collect()} for c in ("toxic = 1", "toxic = 0 AND quality = 1"))
    assert len(kept & toxic) <= 0.25 * len(toxic) and len(kept & good) >= 0.98 * len(good)


def test_gumbel_noise_is_standard(spark):
    rows = spark.range(20000).select(F.col("id"), F.lit("t").alias("text"))
    mean, var = rows.select(quality._noise("id", "text", 3).alias("g")).agg(F.avg("g"), F.var_samp("g")).first()
    assert abs(mean - 0.5772) < 0.03 and abs(var - math.pi**2 / 6) < 0.1


@pytest.mark.parametrize("numbers", [[5], [3, 3, 3], [-1, 0, 1, -(1 << 63), (1 << 63) - 1], [random.Random(i).randrange(-(10**12), 10**12) for i in range(200)]])
def test_kth_largest(spark, numbers):
    df = spark.createDataFrame([(n,) for n in numbers], "number BIGINT")
    for k in {1, (len(numbers) + 1) // 2, len(numbers)}:
        assert quality.kth_largest(df, k) == sorted(numbers, reverse=True)[k - 1]
    assert quality.kth_largest(df, len(numbers) + 1) is None


def test_quality_edges(spark, docs):
    rows = docs([(1, None), (None, "a b"), (2, ""), (2, ""), (3, "x " * 5)])
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    assert quality.resample(rows, none).count() == 5
    assert quality.resample(docs([]), none).count() == 0
    odd = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (2, 1, None), (None, 1, 0), (1, 1, 0), (1, 1, 0)], "doc_id BIGINT, quality INT, toxic INT")
    assert [r.id for r in quality.target_ids(odd).collect()] == [1]
    assert quality.resample(rows, odd).count() >= 1


# --- lines -------------------------------------------------------------------------------------


def template_keys(line):
    f = [w for w in re.sub("[\t\r\f\v]", " ", line).split(" ") if w]
    n = sum(bool(re.search("[0-9]", w)) for w in f)
    if len(f) - n >= max(2, n):
        f = [("<*>" if re.search("[0-9]", w) else w) for w in f]
    keys = [(len(f), 0, tuple(f))]
    if len(f) >= 8:
        w = len(f) // 5
        keys += [(len(f), s, tuple(f[:s]), tuple(f[s + w :])) for s in range(3, len(f), w)]
    return keys


def without_recurring(docs):
    first = {}
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        for line in (t or "").split("\n"):
            for key in template_keys(line) if line.strip(" \t\r\f\v") else []:
                first.setdefault(key, i)
    out = []
    for i, t in docs:
        lines = t.split("\n") if t is not None else []
        left = [x for x in lines if not x.strip(" \t\r\f\v") or all(first[k] == i for k in template_keys(x))]
        out.append((i, None if t is None else "\n".join(left)))
    return out


def line_corpus():
    r = random.Random(8)
    word = lambda: r.choice("abcdefgh") * r.randrange(1, 4)
    long = [" ".join(word() for _ in range(r.randrange(8, 70))) for _ in range(12)]
    docs = []
    for i in range(40):
        lines = [" ".join(word() for _ in range(r.randrange(1, 30))) for _ in range(r.randrange(6))]
        lines += r.sample(long, 2) + ["License 4.0 of 2024", "", "  ", f"user {i} logged in at 10:{i}"]
        changed = r.choice(long).split()
        changed[r.randrange(len(changed))] = "CHANGED"
        r.shuffle(lines)
        docs.append((i, "\n".join([*lines, " ".join(changed)])))
    return [*docs, (50, docs[3][1]), (51, None), (52, ""), (53, "one line alone"), (54, "\n\n"), (55, "a\tb\r\nc  d"), (56, "a b\nc d")]


def test_recurring_lines_go_from_all_but_the_first(clashing):
    corpus = line_corpus()
    rows = clashing(corpus).repartition(4)
    out = line_dedup.drop_recurring(rows, dropped_col="n_gone")
    assert out.columns == [*rows.columns, "n_gone"]
    found = {r.doc_id: r.text for r in out.collect()}
    assert found == dict(without_recurring(corpus))
    assert found[50].strip() == "" and found[53] == "one line alone"


def test_changed_passage_is_found_and_clean_lines_stay(docs):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    other = [*words[:20], "x", "y", "z", *words[23:]]
    apart = [*words[:10], "x", *words[11:30], "y", *words[31:50], "z", *words[51:]]
    out = {r.doc_id: r.text for r in line_dedup.drop_recurring(docs([" ".join(words), " ".join(other), " ".join(apart), " ".join(words[:59])])).collect()}
    assert out == {0: " ".join(words), 1: "", 2: " ".join(apart), 3: " ".join(words[:59])}


def test_numbers_keep_their_values_without_enough_words(docs):
    lines = ["12 45", "99 77", "Chapter 3", "Chapter 9", "user 7 logged in at 10:02", "user 9 logged in at 11:30", "Chapter 3"]
    out = {r.doc_id: r.text for r in line_dedup.drop_recurring(docs(lines)).collect()}
    assert out == {0: "12 45", 1: "99 77", 2: "Chapter 3", 3: "Chapter 9", 4: lines[4], 5: "", 6: ""}


def test_what_the_grid_of_open_blocks_finds(docs):
    """Changes within a block, over a border, in the leading fields, and an added field."""
    line = "a b c d e f g h i j k l m"  # blocks of two, from the fourth field on
    out = {r.doc_id: r.text for r in line_dedup.drop_recurring(docs([line, line.replace("d e", "X Y"), line.replace("e f", "X Y"), line.replace("b", "X"), line + " n"])).collect()}
    assert out[1] == "" and all(out[i] for i in (0, 2, 3, 4))


def test_very_long_lines(docs):
    long = " ".join(f"word{chr(97 + i % 26)}" for i in range(20_000))
    out = {r.doc_id: r.text for r in line_dedup.drop_recurring(docs([long + "\nown", "other\n" + long, long])).collect()}
    assert out == {0: long + "\nown", 1: "other", 2: ""}


def test_line_edges(docs):
    rows = [(None, "same old line"), (None, "same old line"), (4, "same old line"), (4, "same old line\nown"), (2, "twice\ntwice")]
    out = sorted(((r.doc_id, r.text) for r in line_dedup.drop_recurring(docs(rows)).collect()), key=str)
    assert out == sorted([(None, "same old line"), (None, "same old line"), (4, ""), (4, "own"), (2, "twice\ntwice")], key=str)
    assert line_dedup.drop_recurring(docs([])).count() == 0


def test_native_operators_run_no_python(docs):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    bench = docs(["one two three four five six"]).select(F.col("doc_id").alias("item_id"), "text")
    for df in (line_dedup.drop_recurring(docs(["a"])), decontaminate.find_leaks(docs(["a"]), bench)):
        assert not re.search("Python|Pandas|Arrow", plan(df))


# --- leaks -------------------------------------------------------------------------------------


def leaks(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for i, t in docs:
        d = words(t)
        for j, s in items:
            b = words(s)
            best = 0
            for lie in range(-len(b), len(d)):
                same = [0 <= lie + k < len(d) and d[lie + k] == b[k] for k in range(len(b))]
                w = min(13, len(b))
                best = max(best, max(sum(same[k : k + w]) for k in range(len(b) - w + 1)))
            if b and best >= math.ceil(min(13, len(b)) * 0.8):
                out[i, j] = best
    return out


def leak_corpus():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(4))
    text = lambda n: [word() for _ in range(n)]
    items = [(j, " ".join(text(r.randrange(12, 50)))) for j in range(10)] + [(10, "short one"), (11, None), (12, ""), (13, "five words are just enough")]
    docs = []
    for i in range(60):
        own, (j, item) = text(r.randrange(20, 90)), items[i % 10]
        b = item.split()
        kind = i % 6
        if kind == 1:
            b[len(b) // 2] = "other"
        elif kind == 2:
            b = b[:13] if len(b) > 13 else b
        elif kind == 3:
            b = b[:5]
        elif kind == 4:
            b = [w.upper() + "," for w in b]
        elif kind == 5:
            b = [w if k % 6 else "x" for k, w in enumerate(b)]
        at = r.randrange(len(own))
        docs.append((i, " ".join([*own[:at], *b, *own[at:]] if kind else own)))
    return [*docs, (100, None), (101, ""), (102, items[0][1]), (103, "Five words, are just ENOUGH!"), (104, "short one"), (105, " ".join(items[2][1].split()[1:]))], items


@pytest.mark.parametrize("max_seeds", [decontaminate.MAX_SEEDS, 150])
def test_leaks(spark, clashing, max_seeds):
    corpus, items = leak_corpus()
    bench = spark.createDataFrame([(j, t, "k") for j, t in items], "item_id BIGINT, text STRING, w STRING")
    found = decontaminate.find_leaks(clashing(corpus).repartition(4), bench, max_seeds=max_seeds).collect()
    want = leaks(corpus, items)
    assert {(r.doc, r.item): r.n_found for r in found} == want and len(want) > 40
    kept = decontaminate.drop_leaks(clashing(corpus), bench)
    assert kept.columns == clashing(corpus).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in corpus} - {i for i, _ in want}


@pytest.mark.parametrize("n", range(1, 12))
def test_items_of_few_words_with_a_change_anywhere(spark, docs, n):
    item = [f"item{k}" for k in range(n)]
    texts = [" ".join(["some", "own", *[("changed" if k == j else w) for j, w in enumerate(item)], "words"]) for k in range(-1, n)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id BIGINT, text STRING")
    found = {r.doc for r in decontaminate.find_leaks(docs(texts), bench).collect()}
    assert found == {i for i, _ in leaks(list(enumerate(texts)), [(1, " ".join(item))])}
    assert found == (set(range(n + 1)) if n >= 5 else {0})


def test_leak_edges(spark, docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven")] * 2 + [(None, "one two three four five six seven")], "item_id BIGINT, text STRING")
    rows = docs([(None, "one two three four five six seven"), (3, "one two three four five six seven"), (3, "one two three four five six seven"), (3, "nothing")])
    assert sorted(((r.doc, r.item) for r in decontaminate.find_leaks(rows, bench).collect()), key=str) == sorted([(None, None), (None, 1), (3, None), (3, 1)], key=str)
    assert [r.text for r in decontaminate.drop_leaks(rows, bench).collect()] == ["nothing"]
    assert decontaminate.drop_leaks(rows, bench.limit(0)).count() == 4
    assert decontaminate.find_leaks(docs([]), bench).count() == 0
