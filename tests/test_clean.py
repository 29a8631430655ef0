"""Facts about cleaning."""

from pyspark.sql import functions as F

from callmark.functions import clean
from tests.test_functions import values


def test_bodies(spark):
    body = "# Opinion\nx\n# Real title\ntext"
    assert values(spark, [(body,), ("no heading",), ("# Own\ny",)], "t string", clean.from_heading(F.col("t"))) == ["# Real title\ntext", "no heading", "# Own\ny"]
    assert values(spark, [("x" * 500,), ("x" * 500 + "…",), ("short",), ("x" * 500 + "（節錄）",)], "t string", clean.is_full(F.col("t"))) == [True, False, False, False]
    assert values(spark, [("a _(no transcript available)_",), ("b",)], "t string", clean.has_transcript(F.col("t"))) == [False, True]


def test_patch(spark):
    body = "- **Duration:** ?\n- **Published:** ?\n\n## Description\n\n## Transcript\ntext"
    patched = lambda c: clean.patch_metadata(c, F.lit("10:00"), F.lit("2024-01-02"), F.lit("About it"))
    [once] = values(spark, [(body,)], "t string", patched(F.col("t")))
    assert "- **Duration:** 10:00\n- **Published:** 2024-01-02" in once and "## Description\n\nAbout it\n\n## Transcript" in once
    assert values(spark, [(once,)], "t string", patched(F.col("t"))) == [once]


def test_names(spark):
    raw = [("https://example.com/c/jane/posts",), ("@jane",), ("https://example.com/x?u=1&VANITY=jane",), ("cw/jane",)]
    assert values(spark, raw, "t string", clean.vanity(F.col("t"))) == ["jane"] * 4 and values(spark, [("https://example.com/user?u=1",), ("user/7",), ("c",), ("",), ("https://example.com",)], "t string", clean.vanity(F.col("t"))) == [None, "7", "c", None, None] and values(spark, raw[:1], "t string", clean.at_handle(F.col("t"))) == ["@jane"]
    assert values(spark, [("/a",), ("//h/a",), ("https://h/a",), (None,)], "t string", clean.absolute_url(F.col("t"), "https://b/")) == ["https://b/a", "https://h/a", "https://h/a", ""]


def test_model_output(spark):
    raw = 'x\nTOPIC: Gold | RECURRING: yes | NEW: no\nCHANGE: "it fell" -> lower\nso\nCHANGE: "up" -> higher \nTOPIC: Oil | RECURRING: N | NEW:\nTOPIC: broken'
    [topics] = values(spark, [(raw,)], "t string", clean.topic_lines(F.col("t")))
    assert [(t["topic"], t["recurring"], t["new"], [tuple(c) for c in t["changes"]]) for t in topics] == [("Gold", True, "no", [("it fell", "lower"), ("up", "higher")]), ("Oil", False, "", [])]
    [tags] = values(spark, [("1 | gold; odd\n2 | oil, gas\nnoise\n3 | ;\n7 | late",)], "t string", clean.numbered_tags(F.col("t"), F.lit(5)))
    assert [(t["i"], t["tags"]) for t in tags] == [(1, ["gold", "odd"]), (2, ["oil", "gas"])]


def test_links(spark):
    text = spark.createDataFrame([(1, "[A](a_b.md) [B](no.md) [C](c.md)"), (2, None)], "id int, body string")
    pages = spark.createDataFrame([("a-b.md",), ("c.md",)], "page string")
    assert sorted((r["id"], r["body"]) for r in clean.sanitise_links(text, pages, "id", "body").collect()) == [(1, "[A](a-b.md) B [C](c.md)"), (2, None)]


def test_json_rows(spark):
    lines = spark.createDataFrame([(1, "broken"), (2, '{"uploader": " "}'), (3, '{"channel": "Jane"}'), (4, '{"uploader": "Late"}')], "n int, line string")
    assert clean.first_label(lines, "line", "n").first()["label"] == "Jane"
    got = values(spark, [("Story", '{"uuid": "1", "title": "t", "canonicalUrl": {"url": "u"}}'), ("Outlink", '{"id": "2", "headline": "h", "outlinkUrl": "o"}'), ("Ad", "{}")], "k string, t string", clean.asset_row(F.col("k"), F.col("t")))
    assert [tuple(g) if g else None for g in got] == [("1", "t", "u"), ("2", "h", "o"), None]


def test_signs_of_patterns(spark):
    """Dollar signs, backslashes and quotes stand for themselves in patches and links."""
    body = "- **Duration:** ?\n- **Published:** ?\n\n## Description\n\n\n## Transcript\ntext"
    said = "costs $5 now, C:\\new, ${a} \\E $1"
    [out] = [r[0] for r in spark.createDataFrame([(body, said)], "b string, s string").select(clean.patch_metadata(F.col("b"), F.col("s"), F.lit("$9"), F.col("s"))).collect()]
    assert out == f"- **Duration:** {said}\n- **Published:** $9\n\n## Description\n\n{said}\n\n## Transcript\ntext"
    pages = spark.createDataFrame([("a-$1\\Eb.md",), ("c.md",)], "page string")
    text = spark.createDataFrame([(1, "[A](a_$1\\Eb.md) [C](c.md) [D$](d+(.md)")], "id long, text string")
    assert clean.sanitise_links(text, pages, "id", "text").collect()[0]["text"] == "[A](a-$1\\Eb.md) [C](c.md) D$"


def test_audit(spark):
    from callmark.operators import audit

    rows = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "a", 1), (3, "b", None), (None, "b", 1)], "key long, source string, content long")
    files = spark.createDataFrame([(1, "a", 5), (2, "a", 2), (2, "c", 2), (4, "c", 1), (None, "c", 1), (None, None, 1), (3, "b", 1)], "key long, source string, content long")
    found = {r["source"]: tuple(r)[1:] for r in audit.compared(rows, files).collect()}
    assert found == {"a": (0, 0, 1, 1, 1, 1, 0), "b": (0, 0, 0, 0, 0, 0, 0), "c": (0, 1, 0, 0, 0, 0, 1), None: (0, 0, 0, 0, 0, 0, 1)}
    assert audit.compared(rows.limit(0), files.limit(0)).collect() == []
