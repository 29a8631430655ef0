"""Queries over whole tables: no row goes for its id, and results grow with the table."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from callmark.operators import search
from callmark.plans import registry
from callmark.plans.listings import items_with_source
from callmark.sources import domain
from tests.oracle import differences

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    """A folder of the smallest tables in which some are replaced."""

    def make(**tables):
        for name in os.listdir(SMALL):
            if name.removesuffix(".parquet") not in tables:
                (tmp_path / name).symlink_to(f"{SMALL}/{name}")
        for name, rows in tables.items():
            rows.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def test_catalog_entries(spark, folder):
    """Ids from 4,900 on: a prefix of ids would leave a tenth of them."""
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("event_id", F.col("event_id") + 4_900)
    where = folder(events=events)
    found = registry.QUERIES["catalog_entries"](spark, where)
    assert differences(found, registry.ORACLES["catalog_entries"], where) == []
    assert found.count() == events.count()


def nearest(items, k=10):
    """a, b, similarity by brute force over {id: vector}."""
    names = sorted(items)
    m = np.array([items[n] for n in names], dtype=float)
    m /= np.sqrt((m**2).sum(1, keepdims=True))
    near = np.round(m @ m.T, 6)
    found = {}
    for i, a in enumerate(names):
        others = sorted((-near[i, j], b) for j, b in enumerate(names) if b != a)
        found |= {(a, b): -s for s, b in others[:k]}
    return found


def agree(rows, want, k):
    """Same similarities by place; pairs may differ only where rounding decides."""
    found = {(r["a"], r["b"]): r["similarity"] for r in rows}
    assert len(found) == len(rows) == len(want)
    for a in {a for a, _ in want}:
        ours, theirs = (sorted((v for (x, _), v in of.items() if x == a), reverse=True) for of in (found, want))
        assert len(ours) == k and np.allclose(ours, theirs, atol=2e-6)
    assert len(found.keys() & want.keys()) > 0.99 * len(want)


def test_item_links(spark, folder):
    """The query over all items, more of them for a larger table, and several shards, against brute force."""
    embeddings = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    twice = embeddings.unionByName(embeddings.withColumn("vec_id", F.col("vec_id") + 500).withColumn("embedding", F.transform("embedding", lambda x: (x * x - 0.3).cast("float"))))
    where = folder(embeddings=twice.select(*embeddings.columns))
    vectors = {}
    for r in twice.collect():
        vectors.setdefault(r["vec_id"] // 5, []).append(r["embedding"])
    want = nearest({k: np.mean(np.array(v, dtype=float), axis=0) for k, v in vectors.items()})
    assert len(vectors) == 200 and len(want) == 2_000
    agree(registry.QUERIES["item_links"](spark, where).collect(), want, 10)
    items = spark.createDataFrame([(k, [float(x) for x in np.mean(np.array(v, dtype=float), axis=0)]) for k, v in vectors.items()], "item long, vector array<double>")
    agree(search.cosine_links(items, shard_rows=16).collect(), want, 10)


def test_versions_of_all_orders(spark):
    assert registry.QUERIES["owner_versions"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()


def test_no_row_goes_for_its_id(spark):
    events, documents, orders = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("events", "documents", "orders"))
    run = lambda name: registry.QUERIES[name](spark, SMALL)
    entities = run("nested_entities")
    assert entities.select("event_id").distinct().count() == events.count()
    assert entities.count() == 2 * events.count() + events.filter("event_id % 7 = 5").count() - events.filter("event_id % 7 = 6").count()  # three records, and a text that is cut off
    assert run("all_facets").agg(F.sum("n")).first()[0] == events.count()
    by_day = events.groupBy("event_type", F.to_date("ts")).count()
    assert run("all_landed_prices").agg(F.sum("volume")).first()[0] == by_day.filter("count % 7 <> 0").agg(F.sum("count")).first()[0]
    gone = spark.read.parquet(f"{SMALL}/labels.parquet").filter("toxic = 1 AND doc_id % 2 = 0").select("doc_id").distinct().count()
    ids = run("set_algebra_of_all").select(F.when(F.col("id") < 0, -1 - F.col("id")).otherwise(F.col("id")).alias("doc_id"))
    assert documents.select("doc_id").distinct().join(ids.distinct(), "doc_id", "left_semi").count() >= documents.select("doc_id").distinct().count() - gone
    assert 0 < run("items_without_calls").first()["total"] < orders.count()
    assert run("catalog_pages").count() == events.count()
    assert run("versions").count() == orders.count()
    assert run("row_counts").count() == 14


def test_whole_queue(spark, folder):
    """More than 1,000 pending pages, in order."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    many = spark.range(1_600).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.lit("").alias("html")).select(*pages.columns)
    where = folder(pages=many.repartition(5))
    found = registry.QUERIES["whole_queue"](spark, where)
    assert differences(found, registry.ORACLES["whole_queue"], where) == []
    assert [r["page_id"] for r in found.collect()] == [i for i in range(1_600) if i % 3]


def test_deep_pages(spark, tmp_path):
    """Every page against a sorted list; an inner page reads one range."""
    import random

    from callmark.operators.listing_store import Listing, write_listing

    r = random.Random(3)
    rows = [(i, r.choice([None, *range(9)])) for i in range(1_000)]
    df, order = spark.createDataFrame(rows, "i long, at long"), [F.desc_nulls_last("at"), F.desc("i")]
    write_listing(df.repartition(5), order, f"{tmp_path}/l", 90)
    listing = Listing(spark, f"{tmp_path}/l", order)
    want = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), -x[0]))
    assert listing.total == 1_000 and len(listing.parts) > 5
    for offset, limit in ((0, 50), (37, 1), (450, 50), (480, 300), (990, 50), (1_000, 5), (5_000, 5), (-3, 2), (10, 0), (0, 2_000)):
        assert [tuple(x) for x in listing.page(offset, limit).collect()] == want[max(0, offset) : max(0, offset) + limit], (offset, limit)
    inner = int(listing.ends[3]) - 20
    assert len({f.split("/")[-2] for f in listing.page(inner, 10).inputFiles()}) == 1
    write_listing(df.limit(0), order, f"{tmp_path}/none", 90)
    empty = Listing(spark, f"{tmp_path}/none", order)
    assert empty.total == 0 and empty.parts == []


def test_links_of_clusters(spark):
    """Clustered items: exact links, and few of the shards asked; trained centroids and the bound for unit vectors ask no more than the sample and the plain bound."""
    from callmark.operators import shards as sh

    rng = np.random.default_rng(5)
    own = rng.normal(size=(30, 16))[rng.integers(0, 30, 1_500)] * 3 + rng.normal(size=(1_500, 16)) * 0.15
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "item long, vector array<double>")
    agree(search.cosine_links(items, shard_rows=50).collect(), nearest(dict(enumerate(own))), 10)
    unit = own / np.sqrt((own**2).sum(1, keepdims=True))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "id long, v array<double>")
    least = np.sort(unit @ unit.T, axis=1)[:, -11]
    asked = {}
    for name, how in {"plain": {}, "unit": {"unit": True}, "trained": {"train": 16, "unit": True}}.items():
        dealt, shards = sh.deal(rows, 50, **how)
        home = {r["id"]: r["shard"] for r in dealt.select("id", "shard").collect()}
        row, shard = shards.away(unit, least - 1e-6, np.array([home[i] for i in range(len(unit))]))
        asked[name] = len(row) / len(unit) / shards.number
        holds = {}
        for i, s in home.items():
            holds.setdefault(s, []).append(i)
        reached = {(q, i) for q, s in zip(row.tolist(), shard.tolist()) if q < 40 for i in holds[s]} | {(q, i) for q in range(40) for i in holds[home[q]]}
        assert all((q, i) in reached for q in range(40) for i in np.flatnonzero(unit @ unit[q] >= least[q]).tolist())
    assert asked["trained"] <= asked["unit"] <= asked["plain"] and asked["trained"] < 0.25, asked
    print(asked)


@pytest.fixture
def shuffled(spark):
    """Joins shuffle as those of large tables do, and shuffles keep their partitions."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_items_without_channel_are_spread(spark, shuffled):
    """They have no key to be joined by, and are not one task's for it."""
    alone = items_with_source(domain.Domain(spark, SMALL)).filter("channel_id IS NULL").groupBy(F.spark_partition_id()).count().collect()
    assert len(alone) > 1 and sum(r["count"] for r in alone) == spark.read.parquet(f"{SMALL}/orders.parquet").filter("o_orderkey % 10 = 0").count()


@pytest.mark.parametrize("name", ["item_detail", "item_entities", "analyst_page", "study_topics"])
def test_tasks_grow_with_items(spark, shuffled, monkeypatch, name):
    """What a task holds is some rows, however many there are; the rows are those of its SQL."""
    monkeypatch.setattr(domain, "ROWS_A_TASK", 500)
    found = registry.QUERIES[name](spark, SMALL)
    assert found.rdd.getNumPartitions() == -(-spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 500) > 4
    assert differences(found, registry.ORACLES[name], SMALL) == []
