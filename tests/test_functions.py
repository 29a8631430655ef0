"""Facts about scoring, prices, text and dates on small fixtures."""

import ipaddress
import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from callmark.functions import calls
from callmark.functions import html as ht
from callmark.functions import text as tx
from callmark.functions import variants as va
from callmark.operators import fuzzy, incremental, listing, opinions
from callmark.operators.asof import asof_forward
from callmark.operators.scoring import refresh_scores, score_calls
from callmark.sources import frontmatter as fm
from callmark.sources import markdown as md
from callmark.sources import sinks


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r["x"] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_horizon(spark):
    want = {"day": 7, "5d": 7, "week": 14, "2 weeks": 14, "month": 90, "3M": 90, "quarter": 90, "1Q": 90, "year": 365, "2Y": 365, "by year end": 7, "within a year": 365, "6-12 months": 90, "": 90, None: 90}
    assert values(spark, [(k,) for k in want], "t string", calls.horizon_days(F.col("t"))) == list(want.values())


def test_stance(spark):
    want = [("up", None, 1), ("down", None, -1), ("flat", "unspecified", 0), (None, "buy", 1), (None, "long", 1), (None, "cover", 1), (None, "sell", -1), (None, "short", -1), (None, "avoid", -1), (None, "watch", 0), ("up", "watch", 1), ("down", "buy", 1), ("UP", "BUY", 1), ("Down", "SHORT", -1), (None, None, 0)]
    assert values(spark, [w[:2] for w in want], "d string, a string", calls.stance(F.col("d"), F.col("a"))) == [w[2] for w in want]


def test_score(spark):
    want = [(1, None, 1.0, None), (1, 0.0, 1.0, None), (0, 100.0, 130.0, 0.0), (1, 100.0, 120.0, 1.0), (-1, 100.0, 80.0, 1.0), (1, 100.0, 150.0, 1.0), (1, 100.0, 50.0, -1.0), (1, 100.0, 90.0, -0.5), (-1, 100.0, 110.0, -0.5), (1, 100.0, 101.0, 0.05)]
    got = values(spark, [w[:3] for w in want], "s int, c double, e double", calls.score(F.col("s"), F.col("c"), F.col("e")))
    assert got == [pytest.approx(w[3]) if w[3] is not None else None for w in want]


def test_prices_and_scores(spark):
    prices = spark.createDataFrame([("X", dt.date(2026, 8, d), p) for d, p in ((3, 10.0), (4, 11.0), (5, 12.0))] + [("X", dt.date(2026, 8, 6), None)], "ticker string, day date, close double")
    asked = spark.createDataFrame([(1, "X", dt.date(2026, 8, 1)), (2, "X", dt.date(2026, 8, 4)), (3, "X", dt.date(2026, 8, 7)), (4, "Y", dt.date(2026, 8, 4)), (5, "X", dt.date(2020, 1, 1))], "id int, ticker string, day date")
    assert {r["id"]: r["close"] for r in asof_forward(asked, prices).collect()} == {1: 10.0, 2: 11.0, 3: 12.0, 4: None, 5: 10.0}
    made = spark.createDataFrame([("a", "X", "up", None, "day", dt.datetime(2026, 7, 25)), ("b", "X", "flat", None, "day", dt.datetime(2026, 8, 3)), ("c", "X", None, "short", "1Y", dt.datetime(2026, 8, 3))], "call_id string, ticker string, direction string, action string, timeframe string, made_at timestamp_ntz")
    first = score_calls(made, prices, "2026-08-05 00:00:00")
    assert {r["call_id"]: r["score"] for r in first.collect()} == {"a": 0.0, "b": None, "c": -1.0}
    again = {r["call_id"]: (r["frozen"], r["score"]) for r in refresh_scores(first, prices.withColumn("close", F.col("close") * 2 + F.dayofmonth("day")), "2026-08-04 00:00:00").collect()}
    assert again["a"] == (True, 0.0) and again["b"] == (False, None) and again["c"][0] is False


def test_ticker_hygiene(spark):
    rows = [(" aapl ", None), ("BRK.B", "x"), ("not a ticker", ""), (None, "Gold"), ("^GSPC", None)]
    assert values(spark, rows, "t string, n string", calls.ticker(F.col("t"))) == ["AAPL", "BRK.B", None, None, "^GSPC"]
    assert values(spark, rows, "t string, n string", calls.asset_name(F.col("t"), F.col("n"))) == [None, "x", "Not A Ticker", "Gold", None]


def test_chunks():
    assert tx.packed("short", 100) == ["short"] and tx.packed("  ", 5) == [""]
    assert list(map(len, tx.packed("\n\n".join(["x" * 50] * 3), 60))) == [50, 50, 50]
    words = " ".join(f"w{i}" for i in range(10_000))
    for text, most in ((words, 1_000), ("漢" * 40_000, 5_000)):
        out = tx.packed(text, most)
        assert max(map(len, out)) <= most and "".join(out).replace(" ", "") == text.replace(" ", "")
    assert tx.packed("aaa bbbbbbbbbbbb cc", 5) == ["aaa", "bbbbb", "bbbbb", "bb", "cc"]
    assert tx.packed("a  b\nc\n\n\nd\n\n" + "e" * 8 + "\n\nf", 8) == ["a  b\nc", "d", "e" * 8, "f"]
    assert all(w in " ".join(tx.packed("alpha beta gamma delta", 12)) for w in ("alpha", "beta", "gamma", "delta"))


def test_paragraphs(spark):
    text = "One line\nwrapped.\n\n>> Second speaker. " + "A sentence here. " * 60
    [got] = values(spark, [(text,)], "t string", tx.paragraphs(F.col("t")))
    assert got[0] == "One line wrapped." and got[1].startswith("Second speaker.") and all(len(p) <= 600 for p in got)
    assert values(spark, [("\n\n".join(got),)], "t string", tx.paragraphs(F.col("t")))[0] == got
    stored = "\nNothing is a\nrecommendation to buy\n\n>> dude? It's a pleasure.\nMan, great to see you.\n"
    assert values(spark, [(stored,), ("a\nb\nc\n",), ("",)], "t string", tx.paragraphs(F.col("t"))) == [["Nothing is a recommendation to buy", "dude? It's a pleasure. Man, great to see you."], ["a b c"], []]


def capped(paragraph, most):
    """Sentences filled into pieces, one by one."""
    out = []
    for s in re.split(r"(?<=[.!?])\s+", paragraph):
        if out and len(out[-1]) + 1 + len(s) <= most:
            out[-1] += " " + s
        else:
            out.append(s)
    return out


def test_cap(spark):
    rng = random.Random(4)
    mark = lambda: rng.choice(["", "", ".", "!", "?", "...", ".5"])
    texts = [" ".join("x" * rng.randrange(1, 9) + mark() for _ in range(rng.randrange(1, 60))) for _ in range(200)] + [". . .", "a.", "é🙂. " * 30 + "é"]
    got = values(spark, [(t,) for t in texts], "t string", tx.capped(F.col("t"), 40))
    assert got == [capped(t, 40) if len(t) > 40 else [t] for t in texts]


VTT = """WEBVTT
Kind: captions

00:00:00.500 --> 00:00:02.000
Nothing said here is a
recommendation to buy

00:00:02.100 --> 00:00:04.000 align:start
any product.
<c>All right, what's going on?</c>

00:00:04.100 --> 00:00:06.000
&gt;&gt; Welcome back

00:00:06.100 --> 00:00:08.000
to Tom &amp; Jerry&#39;s.

00:00:06.200 --> 00:00:08.000
to Tom &amp; Jerry&#39;s.

00:00:30.000 --> 00:00:32.000
After a pause, a new topic.
"""


def test_captions(spark):
    vtt = "WEBVTT\n\n0:00.500 --> 00:02.000\r\n<c>Hello</c> there\r\n\r\n00:02,000 --> 00:03,000\n \n\n01:00:03.000 -->\nlater\n<00:00:01.000>more\n1:00:05.000 --> 1:00:06.000\nnext\n\nbad --> 00:01.000\nlost"
    assert [tuple(c) for c in values(spark, [(vtt,)], "t string", tx.cue_blocks(F.col("t")))[0]] == [(0.5, 2.0, "Hello there"), (3603.0, 3603.0, "later more"), (3605.0, 3606.0, "next")]
    cues, none = values(spark, [(VTT,), ("WEBVTT\n",)], "t string", tx.cue_blocks(F.col("t")))
    assert len(cues) == 5 and cues[0]["text"] == "Nothing said here is a recommendation to buy" and none == []
    assert values(spark, [(VTT,), ("",)], "t string", tx.caption_paragraphs(F.col("t"))) == [["Nothing said here is a recommendation to buy any product. All right, what's going on?", "Welcome back to Tom & Jerry's.", "After a pause, a new topic."], []]


def test_dates(spark):
    want = {"15May2022 talk": "20220515", "3rd Sep 2025": "20250903", "May 15, 2022": "20220515", "on 2026-08-02": "20260802", "nothing": None, "1 Jan 1987": None, "1 Jan 2030": None, "2022": None, None: None, "選舉 | 6Nov2020": "20201106", "Wrap 15 May, 2026": "20260515", "Sept 21 2025 episode": "20250921", "15May 1987 crash": None,
            "2024.1.5": None, "x115May2022": None, "2024-1-5": None, "30 Feb 2020": None}
    assert values(spark, [(k,) for k in want], "t string", tx.title_date(F.col("t"), F.lit("2026-12-31").cast("date"))) == list(want.values())
    html = ['{"uploadDate":"2022-05-15"}', '"publishDate": "2020-01-02T00"', '"uploadDate":"1987-02-30"', "none"]
    assert values(spark, [(h,) for h in html], "t string", tx.upload_date(F.col("t"), F.lit("2026-12-31").cast("date"))) == ["20220515", "20200102", None, None]
    assert [str(x) for x in values(spark, [("2025-q4",), ("1Q2024",), ("x",)], "t string", tx.quarter_end(F.col("t")))] == ["2025-12-31", "2024-03-31", "None"]


def test_json(spark):
    raw = ['{"a": 1}', '```json\n{"a": {"b": 2}}\n```', 'Sure: {"a": "}{"} done', "garbage"]
    assert values(spark, [(r,) for r in raw], "t string", tx.loose_json(F.col("t"))) == ['{"a": 1}', '{"a": {"b": 2}}', '{"a": "}{"}', None]
    scripts = ['x var d = {"q": "a \\" } b", "n": {}}; y', "x", 'var d = {"open', 'var d = {"a": "' + "\\\\é" * 9_000 + '"} z', None]
    assert values(spark, [(x,) for x in scripts], "t string", tx.json_after(F.col("t"), "var d")) == ['{"q": "a \\" } b", "n": {}}', None, None, '{"a": "' + "\\\\é" * 9_000 + '"}', None]


def test_errors_urls_slugs(spark):
    assert values(spark, [("HTTP 429",), ("Sign in to confirm you",), ("Private video",), ("has been removed",), ("else",), ("protect our community",), ("deleted",), ("members-only",), ("Private video. Sign in if",)], "t string", tx.error_class(F.col("t"))) == ["blocked", "blocked", "gone", "gone", None, "blocked", "gone", "gone", "gone"]
    hosts = ["127.0.0.1", "10.0.0.1", "172.20.1.1", "172.32.0.1", "8.8.8.8", "192.168.3.4", "169.254.1.1", "0.0.0.0", "240.1.2.3", "255.255.255.255", "198.18.0.1", "1.2.3.4", "100.1.2.3"]
    hosts += [f"[{x}]" for x in ("fd00::1", "fe80::1", "::1", "::", "::ffff:127.0.0.1", "::ffff:8.8.8.8", "::ffff:7f00:1", "2606:4700::1111", "2001:db8::5", "2a00:1450:4001:82a::200e", "fc00:1:2:3:4:5:6:7", "FE80::1", "fec0::1", "100::1", "64:ff9b::8.8.8.8", "1:2:3:4:5:6:7:8")]
    def allowed(host):
        ip = ipaddress.ip_address(host.strip("[]"))
        return not (ip.is_private or ip.is_loopback or ip.is_reserved or ip.is_link_local)

    urls = {f"http://{h}{rest}": allowed(h) for h in hosts for rest in ("", "/a?b=c", ":8080/")}
    urls |= {"https://example.com/a": True, "HTTPS://Example.com:81": True, "http://localhost/x": False, "http://LOCALHOST:3": False, "http://u:p@10.0.0.1/": False, "http://10.example.com/": True, "http://[::1": False, "http://[1::2::3]/": False, "http:///x": False, "ftp://example.com": False, "nonsense": False, None: False}
    found = values(spark, [(u,) for u in urls], "t string", tx.safe_url(F.col("t")))
    assert {u: f for u, f in zip(urls, found) if f != urls[u]} == {}
    assert values(spark, [("Héllo, Wörld! 漢字",), ("!!!",)], "t string", tx.slug(F.col("t"))) == ["héllo-wörld-漢字", "x"]
    a, b, c = values(spark, [(["1", "2"],), (["1", "2"],), (["2", "1"],)], "t array<string>", tx.fingerprint(F.col("t")))
    assert a == b != c


def test_html(spark):
    html = '<h2>Title</h2><script>no</script><p>A <b>bold</b> <a href="/x">link</a></p><ul><li>one<li>two</ul>'
    [out] = values(spark, [(html,)], "t string", ht.html_markdown(F.col("t")))
    assert out.startswith("## Title") and "**bold**" in out and "[link](/x)" in out and "* one" in out and "no" not in out
    assert values(spark, [(html,)], "t string", tx.html_text(F.col("t"))) == ["Title A bold link one two"]


def test_markdown_files(spark, tmp_path):
    (tmp_path / "a" / "raw").mkdir(parents=True)
    (tmp_path / "a" / "x.md").write_text("---\ntitle: 'T: 1'\nextra:\n  views: 3\n  tag: x y\nn: 2\n---\nbody\n")
    (tmp_path / "a" / "raw" / "y.md").write_text("no")
    (tmp_path / "z.md").write_text("all body")
    read = md.read_markdown(spark, str(tmp_path)).select(fm.split_front_matter(F.col("text")).alias("f"))
    rows = sorted((r["b"], r["f"]) for r in read.select(F.to_json("f.front").alias("f"), F.col("f.body").alias("b")).collect())
    assert rows == [("all body", "{}"), ("body\n", '{"extra":{"tag":"x y","views":3},"n":2,"title":"T: 1"}')]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, None, 5)], "id int, v string, t int")
    new = spark.createDataFrame([(2, "b", 4), (3, "c", 1)], "id int, v string, t int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(incremental.upsert(old, new, ["id"], "t").filter("v IS NOT NULL")) == [(1, "a", 1), (3, "c", 1)]
    assert rows(incremental.upsert_filling(old, new, ["id"], ["t"])) == [(1, "a", 1, False), (2, "b", 5, False), (3, "c", 1, True)]
    assert rows(incremental.insert_absent(old.na.fill("n"), new, ["id"])) == [(1, "a", 1), (2, "n", 5), (3, "c", 1)]
    once = incremental.replace_run(old, new, "id")
    assert rows(incremental.replace_run(once, new, "id")) == rows(once)
    pages = spark.createDataFrame([("r", n) for n in (1, 2, 3, 5)] + [("s", 2)], "run_id string, page_num int")
    assert rows(incremental.longest_prefix(pages)) == [("r", 3)]


def test_persons_and_themes(spark):
    names = [("  Jane   Doe ",), ("Host",), ("Speaker 2",), ("",), ("jd",), (None,)]
    assert values(spark, names, "t string", opinions.resolve_person(F.col("t"), {"jd": "Jane Doe"})) == ["Jane Doe", None, None, None, "Jane Doe", None]
    themes = {"chips": ["chip"], "ai": ["ai "], "cjk": ["黃金"]}
    got = values(spark, [("Chip makers and AI stocks",), ("chipmakers",), ("買黃金",)], "t string", opinions.themes_of(F.col("t"), themes))
    assert got == [["chips", "ai"], [], ["cjk"]]


def test_all_themes(spark):
    """One pass over a text against every keyword on its own; edges of words, both languages, overlaps, nulls."""
    from callmark.functions import themes

    def one_by_one(text):
        low = (text or "").lower()
        return [name for name, words in themes.THEMES.items() if any(re.search(rf"\b{re.escape(k.lower())}\b", low) if themes.whole_word(k) else k.lower() in low for k in words)]

    r = random.Random(9)
    words = [k for of in themes.THEMES.values() for k in of]
    texts = ["Goldman Sachs", "gold", "_gold", "gold_", "é gold", "黃gold", "GOLD!", "warm", "war zone", "paid ", "ai", "A.I.", "S&P500", "港股", "", None, "silver-lined", "robotics", "robot robots", "x" * 10_000 + " oil " + "y" * 10_000]
    texts += ["".join(r.choice([*words, " ", "-", "x", "漢", "_"]) for _ in range(r.randint(1, 8))) for _ in range(400)]
    got = values(spark, [(t,) for t in texts], "t string", opinions.themes_of(F.col("t")))
    assert {t: g for t, g in zip(texts, got) if g != one_by_one(t)} == {}
    assert values(spark, [("a",)], "t string", opinions.themes_of(F.col("t"), {"x": []})) == [[]]


def test_slugs_of_many_nameless(spark, monkeypatch):
    """Numbers go on over ranges as in one task."""
    from callmark.operators import ordering

    people = spark.createDataFrame([(chr(0x4E00 + i),) for i in range(1_500)] + [("Jane Doe",)], "person string")
    want = {r["person"]: r["slug"] for r in opinions.person_slugs(people).collect()}
    assert want[chr(0x4E00)] == "person-001" and want[chr(0x4E00 + 1_499)] == "person-1500" and want["Jane Doe"] == "jane-doe"
    monkeypatch.setattr(ordering, "FEW_ROWS", 10)
    assert {r["person"]: r["slug"] for r in opinions.person_slugs(people).collect()} == want


def test_flips(spark):
    d = dt.datetime
    rows = [("t", 1, d(2026, 1, 1), "1"), ("t", 0, d(2026, 1, 2), "2"), ("t", -1, d(2026, 1, 3), "3"), ("t", 1, d(2026, 1, 3), "4")]
    events = spark.createDataFrame(rows, "topic string, stance int, seen_at timestamp_ntz, ref string")
    assert [r["ref"] for r in opinions.flips(events, ["topic"]).collect()] == ["3"]
    assert opinions.current_stance(events.filter("ref <= '2'"), ["topic"]).first()["stance"] == 1


def test_paging(spark):
    df = spark.range(500)
    assert [r["id"] for r in listing.page(df, [F.desc("id")], 0, -5).collect()] == [499]
    assert listing.page(df, [F.desc("id")], 10_000).count() == 200 and listing.page(df, [F.desc("id")], None, 100).count() == 400
    [(last, total, limit, offset)] = listing.page_with_total(df, [F.desc("id")], 1, 2).collect()
    assert (last, total, limit, offset) == (497, 500, 1, 2)
    scores = spark.createDataFrame([("a", None), ("b", 1.0), ("c", -1.0)], "call_id string, score double")
    assert [scores.filter(listing.scored_filter(w)).count() for w in (True, False, None)] == [2, 1, 3]
    for name, order in (("score_desc", "bca"), ("score_asc", "cba")):
        assert "".join(r["call_id"] for r in scores.withColumn("made_at", F.lit(1)).orderBy(*listing.call_order(name)).collect()) == order


def test_sinks(spark, tmp_path):
    """Pages are written once, again only if they change, and removed when they are no more."""
    root = f"file://{tmp_path}/wiki"
    pages = lambda **of: spark.createDataFrame([(k.replace("_", "/") + ".md", v) for k, v in of.items()], "path string, text string")
    assert sinks.write_pages(pages(a_x="one", b="two"), root) == (2, 0)
    assert sinks.write_pages(pages(a_x="one", b="two"), root) == (0, 0)
    assert sinks.write_pages(pages(a_x="one!", c="é"), root) == (2, 1)
    assert (tmp_path / "wiki/a/x.md").read_text() == "one!" and (tmp_path / "wiki/c.md").read_text() == "é" and not (tmp_path / "wiki/b.md").exists()
    for name in ("src/en/2024-01-05-a.md", "src/de/2024-01-06-b.md", "src/en/2023-01-01-c.md", "src/en/raw/2024-01-07-d.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src/fr").mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "src/fr/2024-01-08-e.md").write_text("no")
    copy = lambda: sinks.copy_subset(spark, f"file://{tmp_path}", f"file://{tmp_path}/public", ["en", "de"], "2024-01-01", "2024-12-31")
    assert (copy(), copy()) == (2, 0) and (tmp_path / "public/src/en/2024-01-05-a.md").exists()


def test_promotion_and_backfill(spark):
    items = spark.createDataFrame([(1, "old"), (2, None), (3, "old")], "item_id int, primary_run string")
    runs = spark.createDataFrame([(1, "r1", 1, True, False), (1, "r2", 2, True, True), (1, "r3", 3, False, False), (2, "r4", 1, True, False), (2, "r5", 5, True, False)], "item_id int, run string, finished_at int, done boolean, compares boolean")
    assert sorted(map(tuple, incremental.promote(items, runs).collect())) == [(1, "r1"), (2, "r5"), (3, "old")]
    pages = spark.createDataFrame([("c", r, n) for r, ns in ((1, (1, 2, 4)), (2, (1, 2, 3)), (3, (2, 3))) for n in ns], "creator string, run_id int, page_num int")
    assert sorted(map(tuple, incremental.best_prefix(pages, "creator").collect())) == [("c", 2, 1), ("c", 2, 2), ("c", 2, 3)]


def test_fuzzy(spark):
    asked = spark.createDataFrame([("Silver",), ("silver market analysis",), ("GOLD!",), ("--",), ("au",)], "asked string")
    topics = spark.createDataFrame([("Silver",), ("gold",), ("gold miners",), ("Laurel",)], "topic string")
    assert sorted(map(tuple, fuzzy.contained(asked, "asked", topics, "topic").collect())) == [("GOLD!", "gold"), ("Silver", "Silver"), ("au", "Laurel"), ("silver market analysis", "Silver")]
    wanted = spark.createDataFrame([(1, "jeffrey-snider-luke-gromen-on-money", "545"), (2, "short", "7")], "w int, slug string, number string")
    files = spark.createDataFrame([(1, "2024-mv-545-other"), (2, "x-luke-gromen-jeff-snider-y"), (3, "x-jeffrey-snider-luke-gromen-z"), (4, "a-short-b"), (5, "mv-71-x"), (6, "luke-only")], "f int, stem string")
    found = {(r["w"], r["f"]): (r["by_prefix"], r["by_number"], r["by_tokens"]) for r in fuzzy.same_title(wanted, files, "w", "f").collect()}
    assert found == {(1, 1): (False, True, False), (1, 2): (False, False, True), (1, 3): (True, False, True), (2, 4): (True, False, False), (2, 5): (False, True, False)}


def test_hosts(spark):
    rows = [("Jane", "The Jane Show"), ("Jane", "Other"), ("Joe", "The Jane Show"), (None, "x"), ("Jane", None)]
    assert values(spark, rows, "p string, c string", opinions.hosts(F.col("p"), F.col("c"), {"Jane": ["jane s"]})) == [True, False, False, False, False]


def test_stream(spark, tmp_path):
    from callmark.streaming.weekly import start_weekly, weekly

    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    start_weekly(stream, "weeks", str(tmp_path / "state")).awaitTermination(120)
    assert {(r["user_id"], r["week"], r["n"]) for r in spark.table("weeks").collect()} == {(r["user_id"], r["week"], r["n"]) for r in weekly(batch).collect()}


def test_typed_json(spark):
    """Fields keep their types beside a key that is set; what is no object stays; malformed elements go alone."""
    blobs = {None: '{"seen":1}', '{"z":2,"o":{"k":[1]},"f":true,"n":null}': '{"f":true,"n":null,"o":{"k":[1]},"seen":1,"z":2}', "[1]": "[1]", '"x"': '"x"', "{broken": "{broken", "": "", '{"seen":{"a":1},"b":"2"}': '{"b":"2","seen":1}', "{}": '{"seen":1}'}
    assert values(spark, [(b,) for b in blobs], "t string", va.set_key(F.col("t"), "seen", F.lit(1))) == list(blobs.values())
    assert values(spark, [('{"a":1}',)], "t string", va.set_key(F.col("t"), "b", F.lit(None).cast("string"))) == ['{"a":1,"b":null}']
    names = lambda t: F.transform(va.records(t, "$.e"), lambda x: va.text_of(x, "$.name"))
    raw = {'{"e":[{"name":"a"},"x",{"name":"b"}]}': ["a", "b"], '{"e":[1,null,[{"name":"c"}],{"name":5},{},true]}': ["5", None], '{"e":{"name":"a"}}': None, '{"e":[]}': [], '{"x":1}': None, '{"e":[{"name":"a"},': None, None: None}
    assert values(spark, [(r,) for r in raw], "t string", names(F.col("t"))) == list(raw.values())
    sides = [('{"a":1,"b":{"c":true}}', '{"b":[1.5],"d":null}', '{"a":1,"b":[1.5],"d":null}'), (None, '{"b":1}', '{"b":1}'), ('{"b":1}', "[2]", '{"b":1}'), (None, None, "{}")]
    found = spark.createDataFrame(sides, "a string, b string, want string").select(va.shown(va.merged(va.fields(F.col("a")), va.fields(F.col("b")))).alias("x"), "want").collect()
    assert [r["x"] for r in found] == [r["want"] for r in found]


def test_packed_pieces():
    """Every piece fits, nothing is lost but white space at cuts, and no two neighbours would fit together unless a longer unit stands between."""
    import random

    r = random.Random(4)
    for _ in range(300):
        most = r.randint(1, 12)
        text = "".join(r.choice("ab  \n\n") for _ in range(r.randint(0, 60)))
        found = tx.packed(text, most)
        assert all(len(p) <= max(most, len(text.strip()) if len(found) == 1 else most) for p in found)
        assert "".join("".join(found).split()) == "".join(text.split())
    assert tx.packed("aa bb\n\ncc", 20) == ["aa bb\n\ncc"]
    assert tx.packed("aaaaaaa bb cc\n\nd", 5) == ["aaaaa", "aa", "bb cc", "d"]
    assert tx.packed("a b\n\nccc\n\n\ndd", 6) == ["a b", "ccc", "dd"] or tx.packed("a b\n\nccc\n\n\ndd", 6) == ["a b", "ccc", "dd"]


def test_markdown_of_hostile_pages(spark):
    cases = {
        "<ol><li>one<li>two<ul><li>a<ol start=3><li>x</ol></li><li>b</ul></ol>": "1. one\n2. two\n   + a\n     3. x\n   + b",
        "<table><tr><th>A<th>B|c<tr><td>1<td><b>2</b><br>3</table>": "| A | B\\|c |\n| --- | --- |\n| 1 | **2** 3 |",
        "<table><tr><td>1</td><td>2<tr><td>3</table>": "|  |  |\n| --- | --- |\n| 1 | 2 |\n| 3 |  |",
        "<p>x &amp; y &lt;b&gt; a*b_c &nbsp;&#39;": "x & y <b> a\\*b\\_c '",
        "<pre><code>def f(x):\n  return x_*2 &lt; 3</code></pre>": "```\ndef f(x):\n  return x_*2 < 3\n```",
        "use <code>a_b</code> and <b></b>": "use `a_b` and",
        "<blockquote><p>one<p>two</blockquote>after": "> one\n>\n> two\n\nafter",
        "<img src='a.png' alt='A' title=T><img>": '![A](a.png "T")![]()',
        "<a href='http://x.y'>http://x.y</a> <a href=/z title='q'> <b>z</b> </a><a>none</a>": '<http://x.y> [**z**](/z "q")none',
        "<p>unclosed <b>bold <i>both</b> after</i> end</div></p>": "unclosed **bold *both*** after end",
        "<h2>Ti<br>tle</h2>text<h3></h3><h6>six": "## Ti tle\n\ntext\n\n###### six",
        "a<br>b<hr>c": "a  \nb\n\n---\n\nc",
        "<script>if (a<b) '</p>'</script>ok<style>p{": "ok", "<!-- x -->t<!-- never": "t", "2 < 3 and <3 <q x='>'>z</q>": "2 < 3 and <3 z", "<p>a</p>\n\n  <p>b</p>": "a\n\nb", "<ul><li><p>para</p><p>two</p></li></ul>": "* para\n\n  two",
        "": "", "<": "<", "<p": "<p", None: None, "<div>" * 20_000 + "deep" + "</p>" * 20_000: "deep", "x" * 100_000 + "<b>": "x" * 100_000,
    }
    got = values(spark, [(h,) for h in cases], "t string", ht.html_markdown(F.col("t")))
    assert {h[:60]: g for h, g in zip(cases, got) if h is not None and g != cases[h]} == {} and got[list(cases).index(None)] is None


def test_markdown_of_references_cut_off(spark):
    cases = {"<h1>a&amp;&amp;&amp</h1>": "# a&&&amp", "<p>&ampx &am &#65 &#x41; &nosuch; &notit; &lt;": "&ampx &am &#65 A &nosuch; &notit; <", "<a href='/x?a=1&copy=2&amp;b'>y</a>": "[y](/x?a=1&copy=2&b)"}
    assert values(spark, [(h,) for h in cases], "t string", ht.html_markdown(F.col("t"))) == list(cases.values())


def test_page_authors(spark):
    long = "n" * 41
    pages = {
        '<a href="https://x/author/jane-doe?a=1"><b>Jane Doe</b></a><a href="/author/jane-doe">Again</a><A HREF=\'/author/j%C3%A9+r/\'> </A>': [("jane-doe", "Jane Doe"), ("jé+r", "jé+r")],
        f'<a href="/author/a">{long}</a><a class=x href="/author/b">A | B</a><a href="/other/c">C</a>': [("a", "a"), ("b", "b")],
        '<script type="application/json">{"u": "/author/x", "v": "/author/y?z", "w": "/author/x"}</script>': [("x", "x"), ("y", "y")],
        '<script>"/author/x"</script>': [], "": [],
    }
    got = values(spark, [(h,) for h in pages], "t string", ht.page_authors(F.col("t")))
    assert [[tuple(a) for a in x] for x in got] == list(pages.values())


FRONTS = {
    "title: 'T: 1'\nextra:\n  views: 3\n  deep:\n    z: a\n  tag: a\nn: 2": {"title": "T: 1", "extra": {"views": 3, "deep": {"z": "a"}, "tag": "a"}, "n": 2},
    "tags:\n- a\n- 'b c'\n- k: 1\n  l: 2\n-\n  - x\nm:\n  - y": {"tags": ["a", "b c", {"k": 1, "l": 2}, ["x"]], "m": ["y"]},
    "n: ~\nb: Yes\nf: 1.5e3\nd: 2024-01-02\ne:\nx: -7": {"n": None, "b": True, "f": 1500.0, "d": "2024-01-02", "e": None, "x": -7},
    "t: |\n  one\n   two\n\n  three\nu: >-\n  fold\n  ed\n\n  new\nk: |+\n  a\n\nv: end": {"t": "one\n two\n\nthree\n", "u": "fold ed\nnew", "k": "a\n\n", "v": "end"},
    "long: this is a long\n  text that goes on\n  and on # note\nq: \"quoted \\\n  more\n  line \\u00e9\"\ns: 'it''s\n  fine'": {"long": "this is a long text that goes on and on", "q": "quoted more line é", "s": "it's fine"},
    "a: [x, \"y, z\", 3, {k: v, w: [1]}] # c\nb: {}\nc: []\n'quoted key': 1\n\"k2\": http://x.y/z#f": {"a": ["x", "y, z", 3, {"k": "v", "w": [1]}], "b": {}, "c": [], "quoted key": 1, "k2": "http://x.y/z#f"},
    "# c\na: 1 # no\nb: 'x # y'\nc: a#b": {"a": 1, "b": "x # y", "c": "a#b"}, "": {},
    "- a\n- b": None, "broken: [a": None, "x\ty": None, "a: 1\n  b: 2": None, "a:\n  b: 1\n c: 2": None, "p: \"a\" b": None, "a:\n\tb: 1": None, "'open: 1": None, "a: " + "[" * 100_000: None,
}


def test_front_matter_read():
    import json

    got = {t: fm.parsed(t) for t in FRONTS}
    assert {t: (None if g is None else json.loads(g)) for t, g in got.items()} == FRONTS


def test_front_matter_round_trip(spark):
    """What is written is read back as it was, whatever signs it holds."""
    import json

    r = random.Random(6)
    bits = ["a", ": ", "- ", "'", '"', "\n", "é漢", "yes", "12", "1.5", " #c", "[", "]", "{", "}", " ", "\t", "\\", "null", "~", "%", "@", "*", "&", "!", "|", ">", "\n---\n", "\r", "\x85", "\u2028", "\x07", "🙂"]
    texts = [*bits, "", "no", "on", "Off", "2024-01-02", "plain words", "trailing "] + ["".join(r.choice(bits) for _ in range(r.randint(1, 9))) for _ in range(300)]
    rows = [(i, t, [t, "x"], {"k": t}) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i long, t string, l array<string>, m map<string,string>")
    text = fm.join_front_matter({"i": (F.col("i"), "bigint"), "t": (F.col("t"), "string"), "l": (F.col("l"), "array"), "m": (F.col("m"), "map"), "none": (F.lit(None), "string"), "yes": (F.col("i") > 5, "boolean")}, F.col("t"))
    got = df.select("i", fm.split_front_matter(text).alias("f")).select("i", F.to_json("f.front").alias("front"), "f.body").collect()
    for r, (i, t, items, fields) in zip(sorted(got, key=lambda r: r["i"]), rows, strict=True):
        assert json.loads(r["front"]) == {"i": i, "t": t, "l": items, "m": fields, "yes": i > 5} and r["body"] == t, repr(t)


def test_front_matter_of_a_library():
    """What the usual library writes is read."""
    import json

    yaml = pytest.importorskip("yaml")
    r = random.Random(1)
    words = ["a", "b: c", "- x", "'q'", '"d"', "line\nend", "é漢", "yes", "12", "#c", "[x]", " lead", "trail ", "very long " * 12, "\t", "\\n", "null", "http://x/y?z", "%", "|", "multi\n\nline\n", "x" * 100 + " y", "it's", "x #y", "tail\\"]

    def value(depth=0):
        k = r.random()
        if depth < 2 and k < 0.3:
            return [value(depth + 1) for _ in range(r.randint(0, 3))] if k < 0.15 else {r.choice(["k", "deep key", "z:1", "q'"]) + str(i): value(depth + 1) for i in range(r.randint(0, 3))}
        return r.choice([*words, *words, None, True, False, 3, -7, 2.5])

    for _ in range(1_500):
        made = {f"key{k}": value() for k in range(r.randint(1, 5))}
        text = yaml.safe_dump(made, allow_unicode=True, sort_keys=False, default_flow_style=r.choice([False, False, None])).strip()
        assert json.loads(fm.parsed(text) or "null") == made, text


def test_rarest_pieces(spark):
    """Names and topics that all begin alike: under a hundredth of the pairs is compared; the rows are those of brute force."""
    r = random.Random(12)
    names = [f"weekly market outlook {i:04d}" for i in range(3_000)]
    topics = [f"weekly market outlook {i:04d} with {r.choice(['notes', 'guests'])}" for i in range(1_500, 4_500)]
    one, two = (spark.createDataFrame([(x, x) for x in side], f"{c} string, key string") for side, c in ((names, "a"), (topics, "b")))
    assert fuzzy.candidates(one.select("key"), two.select("key")).count() < 90_000
    found = sorted(map(tuple, fuzzy.within(one, two, "a", "b").select("a", "b").collect()))
    assert found == sorted((n, t) for t in topics if (n := t[:26]) in set(names))


@pytest.mark.parametrize("hot", [20_000, 3])
def test_pieces_against_brute_force(spark, monkeypatch, hot):
    """Keys of all lengths, repeated keys, nulls and blanks, pieces that many keys hold."""
    monkeypatch.setattr(fuzzy, "HOT_KEYS", hot)
    r = random.Random(hot)
    word = lambda most: "".join(r.choice("abé") for _ in range(r.randint(0, most)))
    short, long = [(i, word(5)) for i in range(150)] + [(-1, None)], [(i, word(14)) for i in range(150)] + [(-1, None)]
    one, two = (spark.createDataFrame(rows, f"{c} long, key string") for rows, c in ((short, "a"), (long, "b")))
    found = sorted(map(tuple, fuzzy.within(one, two, "a", "b").collect()))
    assert found == sorted((a, b, x == y) for a, x in short if x for b, y in long if y and x in y)
    assert fuzzy.within(one.limit(0), two, "a", "b").count() == 0 == fuzzy.within(one, two.limit(0), "a", "b").count()


def test_python_functions_hold_a_slice_at_a_time(spark):
    import pyarrow as pa

    from callmark.functions import batches

    long = pa.array(["x" * 1000] * 10_000 + [None, "y"])
    parts = list(batches.slices(long))
    assert pa.concat_arrays(parts) == long and max(p.nbytes for p in parts) <= batches.SLICE_BYTES + 1000 * 8 and list(batches.slices(long[:0])) == []
    held = spark.range(3000, numPartitions=1).select("id", batches.each(F.when(F.col("id") % 7 > 0, F.repeat(F.col("id").cast("string"), F.lit(500))), lambda t: t and t[:4], "string").alias("t"))
    assert [r["t"] for r in held.orderBy("id").collect()] == [(str(i) * 500)[:4] if i % 7 else None for i in range(3000)]


def test_names_are_resolved_by_one_pattern(spark):
    """Plans repeat what they push down: a name's look-up stays as small with twenty aliases as with one, and later rules never hide earlier ones."""
    names = [("jd",), ("JD",), (" a  b ",), ("Speaker 2",), ("s.3",), ("sx3",), ("",), (None,)]
    assert values(spark, names, "t string", opinions.resolve_person(F.col("t"), {"jd": "J", "Jd": "K", "s.3": "no"}, generic=("s.3",))) == ["J", "J", "a b", None, None, "sx3", None, None]
    size = lambda n: spark.range(1).select(F.col("id").cast("string").alias("t")).filter(opinions.resolve_person(F.col("t"), {f"a{i}": "x" for i in range(n)}).isNotNull())._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")
    assert size(20) == size(1) <= 2


def test_people_are_written_once(spark):
    """A filter on slugs does not reach the rows that people are counted from: those are read once."""
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        for r in rows:
            seen.add(1)
            yield r

    people = spark.createDataFrame(spark.sparkContext.parallelize([("A B",), ("零",), ("一",)], 1).mapPartitions(counted), "person string")
    assert {r["person"]: r["slug"] for r in opinions.person_slugs(people).collect()} == {"A B": "a-b", "一": "person-001", "零": "person-002"} and seen.value == 3


def test_deep_page_reads_ranges_that_do_not_grow_in_number(spark, tmp_path, monkeypatch):
    from callmark.plans import registry

    monkeypatch.setattr("callmark.plans.listings.work_dir", lambda s: str(tmp_path / "l"))
    assert registry.QUERIES["deep_page"](spark, "/root/testdata/sf0.01").count() == 50
    assert len(list((tmp_path / "l" / "rows").glob("__part=*"))) == 1  # 15,000 items; ranges hold 100,000
