"""Operators over pieces, words and terms: against the library, brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from callmark.llm import pieces, ranking, spelling

SMALL = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (None, None, None, "x", 1), (None, "alphas betas: alphas", "a", "y", 1), (1, "Alphas betas here\n\nbetas alphaz", "a", "z", 2), (1, "Alphas betas here\n\nbetas alphaz", "a", "z", 2),
        (2, "", "b", "z", 3), (3, "wörds " * 9_000 + "alphaz alphaz alphaz", "b", "z", 4), (4, " \t\n", None, "", 5), (5, "x" * 100_000 + "  \x00▁ 日本🙂", "c", "", 5),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, word string, n int")


# 11
@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    with open(MODEL, "rb") as f:
        return pieces.Vocabulary(f.read())


def ids(x):
    return np.frombuffer(x, "<u4").tolist()


@pytest.mark.parametrize("long_word", [2_048, 20])
def test_pieces_of_random_texts(vocabulary, library, monkeypatch, long_word):
    monkeypatch.setattr(pieces, "LONG_WORD", long_word)
    vocabulary.cache.clear()
    r = random.Random(7)
    known = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32_000)]
    alphabets = ["abc", "ethsinraoud ", "ab ▁ ", "日本語のテスト。", "éèàç eux", "\n\t  xX", "bottom mob so", "🙂a日\x00", "01 29."]
    texts = ["", " ", "▁", "  a", " " * 5_000, "ab" * 2_000, "<s>", "</s> <unk> <0x41>", "é", "�"]
    texts += ["".join(r.choice(a) for _ in range(r.randint(0, 90))) for a in alphabets for _ in range(60)] + ["".join(r.choice(known) for _ in range(r.randint(1, 20))) for _ in range(500)]
    for text, found in zip(texts, vocabulary.encode(texts), strict=True):
        want = library.encode(text)
        assert ids(found) == want, text[:60]
        assert vocabulary.decode(np.array([1, *want, 2])) == library.decode([1, *want, 2])


def test_pieces_decode_any_ids(vocabulary, library):
    r = random.Random(3)
    for _ in range(3_000):
        some = [r.choice([0, 1, 2, r.randint(3, 258), r.randint(3, 258), r.randint(259, 31_999), 29_871, 259]) for _ in range(r.randint(0, 12))]
        assert vocabulary.decode(np.array(some, int)) == library.decode(some), some


def test_pieces_of_table(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = pieces.op11_sentencepiece(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(want).encode()).hexdigest())


def test_pieces_of_odd_table(spark, odd, library):
    model = pieces.load_model(spark, MODEL)
    found = Counter((r["doc_id"], r["text"]) for r in pieces.decode(pieces.encode(odd, model), model).collect())
    assert found == Counter((r["doc_id"], library.decode(library.encode(r["text"] or ""))) for r in odd.collect())
    assert [ids(r["ids"]) for r in pieces.encode(odd.limit(0), model).collect()] == []
    assert {tuple(ids(r["ids"])) for r in pieces.encode(odd.filter("doc_id = 2"), model, begin=False).collect()} == {(2,)}


def test_pieces_refuses_other_models(tmp_path):
    with pytest.raises(ValueError, match="only BPE"):
        pieces.Vocabulary(bytes([0x12, 2, 0x18, 1]))


# 12
def words_of(docs):
    """(doc_id, text) -> word -> n, by hand."""
    counts = Counter()
    for i, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def variants_of(counts):
    """word -> (form, root, n, n_near, form_n), by comparing every two words of like length."""
    by_size, near = defaultdict(list), {}
    for w in counts:
        by_size[len(w)].append(w)
    for w in counts:
        near[w] = [x for d in (-1, 0, 1) for x in by_size[len(w) + d] if is_near(w, x)]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def shown(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_spelling_of_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert shown(spelling.op12_spelling(spark, SMALL)) == variants_of(words_of(docs))


@pytest.mark.parametrize("long_chars", [64, 5, 1])
def test_spelling_of_random_words(spark, long_chars):
    """Runs of equal letters, every place of an edit, ties, chains; keys as texts and as digests."""
    r = random.Random(long_chars)
    counts = {"".join(r.choice("aabc") for _ in range(r.randint(1, 9))): r.choice([1, 1, 2, 3, 4, 8, 16]) for _ in range(700)}
    counts |= {"letter": 9, "leter": 4, "lettter": 2, "lettre": 20, "übel": 3, "ubel": 6}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert shown(spelling.variants(df, long_chars=long_chars)) == variants_of(counts)


def test_spelling_of_long_words(spark):
    """Words around and far above the longest text key."""
    r = random.Random(1)
    base = "".join(r.choice("abcdefgh") for _ in range(63))
    counts = {base + "a" * i: 3 + i for i in range(6)} | {base + "ab": 9, "b" + base: 2}
    counts |= {"z" * 50_000: 5, "z" * 49_999: 11, "z" * 25_000 + "y" + "z" * 24_999: 2, "y" + "z" * 49_999: 1}
    assert shown(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == variants_of(counts)


def test_spelling_across_batches(spark):
    """Groups that go over the ends of Arrow batches."""
    counts = {a + b + "cdef": 1 + len(a + b) for a in "abcdefgh" for b in ["", *"abcdefgh"]}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert shown(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == variants_of(counts)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_spelling_of_odd_tables(spark, odd):
    counts = words_of([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert "alphaz" in counts and "alphas" in counts
    found = spelling.vocabulary(spelling.with_typos(spelling.runs(odd)))
    assert {r["word"]: r["n"] for r in found.collect()} == counts
    assert shown(spelling.variants(found)) == variants_of(counts)
    assert shown(spelling.variants(found.limit(0))) == {}


# 13
def ranked(docs, items, k=10):
    """(item, rank, doc_id, score) by hand; docs (doc_id, text), items (item_id, text)."""
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    tfs = [(i, Counter(terms(t))) for i, t in docs]
    tfs = [(i, tf) for i, tf in tfs if tf]
    n, total = len(tfs), sum(tf.total() for _, tf in tfs)
    df = Counter(w for _, tf in tfs for w in tf)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for w, d in df.items()}
    out = []
    asked = defaultdict(list)
    for item, text in items:
        asked[item] += terms(text)
    for item, words in asked.items():
        scores = [(sum(weight[w] * (10**9 * tf[w] // (1000 * tf[w] + 8 * (25 + 75 * tf.total() * n // total))) for w in words if w in tf), i) for i, tf in tfs]
        best = sorted(((s, i) for s, i in scores if s > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, rank, i, s) for rank, (s, i) in enumerate(best, 1)]
    return Counter(out)


def found_by(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_ranking_of_odd_tables(spark, odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(1, "Alphas, alphas! betas"), (2, None), (3, "nothing of it"), (4, "here"), (None, "wörds 日本"), (4, "日本🙂 alphaz"), (5, ""), (6, "x" * 100_000)]
    asked = spark.createDataFrame([(*x, "s") for x in items], "item_id long, text string, score string")
    want = ranked(docs, items)
    assert len(want) > 8
    for most in (1_000_000, 3):
        assert found_by(ranking.search(odd, asked, most_terms=most)) == want
    assert found_by(ranking.search(odd.limit(0), asked)) == Counter() == found_by(ranking.search(odd, asked.limit(0)))


def test_ranking_of_random_texts(spark, monkeypatch):
    """Many ties, more documents than an item keeps, several tasks, drops in between."""
    monkeypatch.setattr(ranking, "HELD", 50)
    r = random.Random(5)
    words = ["a", "b", "ab", "ba", "aba", "x1", "é", "éa", "日"]
    docs = [(i // 2, r.choice([" ", "-", "  "]).join(r.choice(words) for _ in range(r.randint(0, 6)))) for i in range(600)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 4)))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found_by(ranking.search(df, spark.createDataFrame(items, "item_id long, text string"), k=4)) == ranked(docs, items, 4)


def test_ranking_of_table(spark):
    read = lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet")
    docs, items = ([tuple(r) for r in read(t).select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert found_by(ranking.op13_lexical(spark, SMALL)) == ranked(docs, items)


def test_no_python_names_clash(spark, odd):
    """Columns that are named like the operators' own are left alone."""
    both = odd.withColumnRenamed("word", "term").withColumn("ids", F.lit(1)).withColumn("run", F.lit("q"))
    assert spelling.runs(both).columns == ["doc_id", "run"]
    assert ranking.search(both, both.select(F.col("doc_id").alias("item_id"), "text", F.lit(1).alias("rank"))).count() > 0
