"""Token operators against the libraries whose results they must give."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hourline.llm import bpe, token_counts, token_files
from hourline.llm.automaton import Encoder, TokenAutomaton
from hourline.llm.queries import BPE_FILE, END_ID, PIECE_FILE
from hourline.llm.words import Kept

TEXTS = [
    "", None, "Hello world", "  two  spaces\nand\tlines \r\n", "I'm we'll don't 'S", "aaaaaaaaaaaaaaaaaaaaaaaa " * 5, "ñ" * 300, "a<|endoftext|>b <|startoftext|>", "x\x00y \x1c z\x85w",
    "日本語 😀👩‍👩‍👧 ﬁ ǅ ẞ İ ΑΣ", "1234 ½ ٣", "<s> </s> <unk> ▁ ▁▁x", " " * 50, "\n\n \n", "word " * 3000, "é́ é", "֋ ׊ ͸", "end.",
]
LIBRARY = Tokenizer.from_file(BPE_FILE)
PIECES = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


def noise(seed, letters, n=120):
    r = random.Random(seed)
    return "".join(r.choice(letters) for _ in range(n))


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_bpe_path_is_the_library_path(text):
    mine = bpe.tokenizer(BPE_FILE)
    ids = mine.encode(text.encode("utf-8", "ignore"))
    clean = text.encode("utf-8", "ignore").decode()
    assert ids == packed(library_ids(clean))
    assert mine.decode(ids) == LIBRARY.decode(library_ids(clean), skip_special_tokens=False)


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=8, unique=True), st.text("abc", min_size=1, max_size=12))
@settings(max_examples=300, deadline=None)
def test_automaton_accepts_what_merging_gives(picks, text):
    """Any rule list, also with rules that can't apply, against merging step by step."""
    ids, rules = {"a": 0, "b": 1, "c": 2}, []
    for x, y in picks:
        names = list(ids)
        left, right = names[x % len(names)], names[y % len(names)]
        if left + right not in ids:
            ids[left + right] = len(ids)
            rules.append((len(rules), ids[left], ids[right], ids[left + right]))
    ranks = {(a, b): r for r, a, b, _ in rules}
    merged = {(a, b): m for _, a, b, m in rules}
    tokens = [ids[c] for c in text]
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in ranks), default=None)
        if best is None:
            break
        tokens[best[1] : best[1] + 2] = [merged[tuple(tokens[best[1] : best[1] + 2])]]
    automaton = TokenAutomaton(rules, lambda a, b: ranks.get((a, b)))
    assert Encoder(automaton, ids).path(text) == tokens


def test_bpe_operators(spark, clashing):
    rows = clashing(TEXTS)
    out = bpe.decode(bpe.encode(rows, BPE_FILE, ids_col="tokens"), BPE_FILE, "tokens", "back")
    assert out.columns == [*rows.columns, "tokens", "back"]
    for r in out.collect():
        assert bytes(r.tokens) == packed(library_ids(r.text)) and r.back == LIBRARY.decode(library_ids(r.text), skip_special_tokens=False)
    assert "_ids" in bpe.encode(rows, BPE_FILE).columns  # "ids" is taken
    digests = {r.doc_id: r for r in bpe.digests(rows, BPE_FILE).collect()}
    for i, text in enumerate(TEXTS):
        ids = library_ids(text)
        assert digests[i].n_tokens == len(ids) and digests[i].ids_sha256 == hashlib.sha256(packed(ids)).hexdigest()
    assert bpe.digests(rows.limit(0), BPE_FILE).count() == 0


def test_bpe_keeps_repeated_rows_and_null_ids(docs):
    out = bpe.digests(docs([(None, "a b"), (1, "a b"), (1, "a b")]), BPE_FILE).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in out) == [(False, 2), (False, 2), (True, 2)]


@given(st.text(max_size=60), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_piece_counts_and_chunk_maps(text, size):
    text = text.encode("utf-8", "ignore").decode()
    machine = token_counts.transducer(PIECE_FILE)
    marked = token_counts.marked(text)
    n = len(PIECES.encode(text))
    assert machine.count(marked) == n
    maps = [machine.chunk_map(marked[k : k + size]) for k in range(0, len(marked), size)]
    assert token_counts._fold(machine, maps) == n


@pytest.mark.parametrize("letters", ["ab \n▁é", "the quick<|>", "  x1.,", "日本a 語😀"])
def test_chunk_maps_compose_in_any_order(letters):
    machine = token_counts.transducer(PIECE_FILE)
    for seed in range(30):
        marked = token_counts.marked(noise(seed, letters))
        r = random.Random(seed)
        size = r.randrange(1, 20)
        maps = [machine.chunk_map(marked[k : k + size]) for k in range(0, len(marked), size)]
        while len(maps) > 1:
            k = r.randrange(len(maps) - 1)
            maps[k : k + 2] = [machine.compose(maps[k], maps[k + 1])]
        assert token_counts._fold(machine, maps) == machine.count(marked)


@pytest.mark.parametrize("chunk,spread", [(token_counts.CHUNK, token_counts.SPREAD), (7, 1 << 20), (7, 0), (64, 20)])
def test_token_counts(docs, clashing, chunk, spread):
    texts = [*TEXTS, "long words and more " * 900]
    out = {r.doc_id: r for r in token_counts.count_tokens(clashing(texts), PIECE_FILE, limit=200, chunk=chunk, spread=spread).collect()}
    for i, text in enumerate(texts):
        n = len(PIECES.encode(text or ""))
        assert (out[i].n_bytes, out[i].n_tokens, out[i].over_limit) == (len((text or "").encode()), n, n > 200)
    twice = token_counts.count_tokens(docs([(None, "a b c " * 9), (1, "a b c " * 9), (1, "a b c " * 9)]), PIECE_FILE, chunk=chunk, spread=spread).collect()
    assert len(twice) == 3 and len({r.n_tokens for r in twice}) == 1
    assert token_counts.count_tokens(docs([]), PIECE_FILE).count() == 0


@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), max_size=80, unique=True), st.booleans())
@settings(max_examples=100, deadline=None)
def test_perfect_hash_is_minimal(keys, with_null):
    nulls = np.array([with_null] + [False] * len(keys)) if with_null else np.zeros(len(keys), bool)
    values = np.array(([0] if with_null else []) + keys, dtype=np.int64)
    seeds, slots = token_files.build_index(values, nulls)
    assert sorted(slots.tolist()) == list(range(len(values)))
    assert len(values) == 0 or token_files.slots_of(values, nulls, seeds).tolist() == slots.tolist()


@pytest.mark.parametrize("shard_ids", [token_files.SHARD_IDS, 40])
def test_token_file_round_trip(spark, clashing, tmp_path, shard_ids):
    rows = [(i * 7 - 20, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, ""), (8, "again"), (8, "again"), ((1 << 62), "far")]
    path = str(tmp_path / "tokens")
    token_files.write_tokens(clashing(rows).repartition(3), BPE_FILE, path, END_ID, shard_ids=shard_ids)
    out = token_files.read_documents(spark, path).orderBy("start").collect()
    kind = lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], dtype="<u2").tobytes())
    want = sorted(((i, [*library_ids(t), END_ID]) for i, t in rows), key=kind)
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in out] == [(i, len(ids), zlib.crc32(packed(ids))) for i, ids in want]
    assert [r.start for r in out] == np.cumsum([0, *(len(ids) for _, ids in want)])[:-1].tolist()

    asked = spark.createDataFrame([(8,), (None,), (1 << 62,), (5,), (-1000,), (1 << 61,), (-20,)], "doc_id BIGINT")
    found = token_files.lookup(spark, path, asked).collect()
    wanted = [(i, ids) for i, ids in want if i in (8, None, 1 << 62, -20)]
    assert sorted(((r.doc_id, r.ids) for r in found), key=str) == sorted(wanted, key=str)


def test_token_file_of_an_empty_table(spark, docs, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_tokens(docs([]), BPE_FILE, path, END_ID)
    assert token_files.read_documents(spark, path).count() == 0
    assert token_files.lookup(spark, path, spark.createDataFrame([(1,)], "doc_id BIGINT")).count() == 0


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_library_words_are_the_library_text(text):
    clean = text.encode("utf-8", "ignore")
    ids, ends = token_files._library(BPE_FILE).encode([clean, b"", clean + b" and\nmore <|endoftext|>", clean])
    texts = [clean.decode(), "", clean.decode() + " and\nmore <|endoftext|>", clean.decode()]
    assert ends.tolist() == np.cumsum([len(library_ids(t)) for t in texts]).tolist()
    assert ids.tolist() == [i for t in texts for i in library_ids(t)]


def test_chunks_are_forgotten_and_learned_anew(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_WORDS", 3)
    library = token_files.LibraryEncoder(BPE_FILE)
    for text in ["one two three", "four five", "one six", "six six one", ""]:
        ids, ends = library.encode([text.encode()])
        assert ids.tolist() == library_ids(text) and ends.tolist() == [len(ids)]


@pytest.mark.parametrize("key", [7, None])
def test_hot_key_is_dealt_over_shards(spark, docs, tmp_path, key):
    """One key, or null, on a third of the rows and more."""
    rows = [(key if i % 2 == 0 else i, f"text number {i} " * (i % 5)) for i in range(400)]
    path = str(tmp_path / "hot")
    token_files.write_tokens(docs(rows).repartition(4), BPE_FILE, path, END_ID, shard_ids=300)
    shards = spark.read.parquet(f"{path}/shards")
    held = shards.filter(F.col("first_null") if key is None else F.col("first_key") == key)
    assert held.count() > 5 and held.select("part").distinct().count() > 1
    assert shards.agg(F.max("n_ids")).first()[0] <= 300 + 20
    out = token_files.read_documents(spark, path).orderBy("start").collect()
    assert [r.start for r in out] == np.cumsum([0, *(r.n_tokens for r in out)])[:-1].tolist()
    kind = lambda x: (x[0] is not None, x[0] or 0, x[1])
    got = [(r.doc_id, r.ids_crc32) for r in out]
    assert [k for k, _ in got] == [k for k, _ in sorted(got, key=kind)]
    assert sorted(got, key=kind) == sorted(((k, zlib.crc32(packed([*library_ids(t), END_ID]))) for k, t in rows), key=kind)
    found = token_files.lookup(spark, path, spark.createDataFrame([(key,), (1,), (2,)], "doc_id BIGINT")).collect()
    assert sorted(str(r.ids) for r in found) == sorted(str([*library_ids(t), END_ID]) for k, t in rows if k == key or k == 1)


def test_kept_results_come_from_the_function():
    asked = []
    kept = Kept(lambda k: asked.append(k) or len(k), 3, longest=4)
    assert [kept[k] for k in ("a", "bb", "a", "ccccc", "ccccc", "d", "e", "a")] == [1, 2, 1, 5, 5, 1, 1, 1]
    assert asked == ["a", "bb", "ccccc", "ccccc", "d", "e"] and len(kept) <= 3


def test_token_file_refuses_a_vocabulary_that_keeps_space(docs, tmp_path):
    with pytest.raises(ValueError):
        token_files._library(public_tokenizers.path("byte_bpe_50k.json"))


def test_files_are_scanned_for_their_columns_only(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("z").alias("other")).write.parquet(str(tmp_path / "d"))
    plan = bpe.digests(spark.read.parquet(str(tmp_path / "d")), BPE_FILE)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
