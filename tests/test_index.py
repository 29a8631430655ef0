"""The positional index: ranks and headlines by hand, and what a query reads."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callmark.operators import text_index as ix


@pytest.fixture(scope="module")
def docs():
    r = random.Random(2)
    words = ["alpha", "Beta", "gamma", "d", "été", "日本"]
    made = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 4))), " ".join(r.choice(words) + r.choice(["", ",", "."]) for _ in range(r.randint(0, 300)))) for i in range(60)]
    return [*made, (60, None, None), (61, "alpha", None), (62, None, "beta " + "x " * 200 + "alpha")]


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    ix.write_index(spark.createDataFrame(docs, "doc_id long, title string, body string"), path, 8)
    return ix.read_index(spark, path)


def places(title, body):
    import re

    t, b = (re.findall(r"\w+", (x or "").lower()) for x in (title, body))
    return [(w, i, 1.0 if i <= len(t) else 0.4) for i, w in enumerate(t + b, 1)]


@pytest.mark.parametrize("query", ["alpha", "ALPHA beta", "beta alpha gamma", "日本 été", "alpha alpha", "alpha none"])
def test_rank(spark, docs, index, query):
    terms, want = ix.query_words(query), {}
    for i, title, body in docs:
        own = [[(p, w) for x, p, w in places(title, body) if x == t] for t in terms]
        if not all(own):
            continue
        if len(own) == 1:
            w = [x for _, x in own[0]]
            best = w.index(max(w))
            want[i] = (w[best] + sum(x / (k + 1) ** 2 for k, x in enumerate(w) if k != best)) / (math.pi**2 / 6)
        else:
            none = 1.0
            for a in range(len(own)):
                for b in range(a):
                    for p, v in own[a]:
                        for q, w in own[b]:
                            if abs(p - q) <= ix.NEAR:
                                none *= 1 - math.sqrt(v * w / (1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2)))
            want[i] = 1 - none
    found = {r["doc_id"]: r["rank"] for r in ix.search(index, query, 8).collect()}
    assert found.keys() == want.keys()
    assert all(math.isclose(found[i], want[i], abs_tol=1e-12) for i in want)


def test_reads_its_words_alone(spark, index):
    found = ix.search(index, "alpha beta", 8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "bucket" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0] and "In(term" in plan
    assert len(index.filter(F.col("bucket") == ix.bucket("alpha", 8)).inputFiles()) > 0
    assert ix.search(index, " ,. ", 8).collect() == []


def test_covers():
    assert ix.covers([np.array([1, 5, 9]), np.array([6, 20])]) == [(5, 6), (6, 9), (9, 20)]
    assert ix.covers([np.array([3])]) == [(3, 3)]
    assert ix.covers([np.array([1, 2, 3]), np.array([4])]) == [(3, 4)]


def test_headlines():
    text = " ".join(f"word{i}" for i in range(100))
    at = lambda *p: [np.array(x) for x in p]
    shown = ix.headline_of(text, at([11, 51], [12, 70]), frozenset(["word10", "word50", "word11", "word69"]))
    assert shown.count("<b>") == 4 and " ... " in shown
    one, two = shown.split(" ... ")
    assert "<b>word10</b> <b>word11</b>" in one and one.startswith("word0 ") and len(one.split()) == len(two.split()) == 30 and two.startswith("word45 ")
    assert ix.headline_of("a is on the edge of it, Oil and gas - up", at([8]), frozenset(["oil"])) == "a is on the edge of it, <b>Oil</b> and gas - up"
    assert ix.headline_of("a is on the very edge of it, Oil and gas - up", at([9]), frozenset(["oil"])) == "the very edge of it, <b>Oil</b> and gas"
    assert ix.headline_of("only the title has it", at([], [1]), frozenset(["x"])) == "only the title has it"
    far = ix.headline_of("oil " + "x1x " * 50 + "gas", at([1], [52]), frozenset(["oil", "gas"]))
    assert far.startswith("<b>oil</b> x1x") and len(far.split()) == 30
    assert ix.headline_of("", at([]), frozenset(["oil"])) == ""


def test_a_row_is_a_word_of_a_block(spark, tmp_path):
    """A word that all of 400 documents have is one row for each block that was read, not one for each document."""
    made = spark.range(400, numPartitions=1).selectExpr("id AS doc_id", "'Common' AS title", "concat('common words w', id) AS body")
    ix.write_index(made, f"{tmp_path}/i", 8)
    rows = ix.read_index(spark, f"{tmp_path}/i").filter("term = 'common'").collect()
    assert len(rows) == 1 and sorted(rows[0]["docs"]) == list(range(400)) and rows[0]["sizes"] == [2] * 400 and rows[0]["in_title"] == [1] * 400 and rows[0]["positions"] == [1, 2] * 400


def test_words_are_split_where_they_are_indexed(spark, tmp_path):
    """Texts go to the index as they are, not as lists of words; their words are those of words()."""
    import pyarrow as pa

    texts = ["", " ,. ", "one", " two\twords ", "a_b-c d1", "l'\u00e9t\u00e9 \u65e5\u672c\u8a9e\u3001\u6771\u4eac", "x" * 5_000, "\u0663\u00b2 \u2167 e\u0301\u00a0y", "\n\nthird line\r\n"]
    docs = spark.createDataFrame([*((i, t, t) for i, t in enumerate(texts)), (99, None, None)], "doc_id long, title string, body string")
    want = [r[0] for r in docs.filter("doc_id < 99").orderBy("doc_id").select(ix.words(F.col("body"))).collect()]
    assert [x or [] for x in ix.words_of(pa.array([t.lower() for t in texts])).to_pylist()] == want
    assert "regexp" not in ix.postings(docs, 8)._jdf.queryExecution().executedPlan().toString()
    ix.write_index(docs, f"{tmp_path}/i", 8)
    found = {}
    for r in ix.read_index(spark, f"{tmp_path}/i").collect():
        at = iter(r["positions"])
        for doc, n, size in zip(r["docs"], r["in_title"], r["sizes"]):
            mine = [next(at) for _ in range(size)]
            assert n == sum(p <= len(want[doc]) for p in mine)
            found.setdefault(doc, []).extend((p, r["term"]) for p in mine)
    assert {k: [w for _, w in sorted(v)] for k, v in found.items()} == {i: w * 2 for i, w in enumerate(want) if w}
