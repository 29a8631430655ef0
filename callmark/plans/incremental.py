"""Merges, queues, resume and catalogs over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callmark.operators import counters
from callmark.operators import incremental as op
from callmark.plans.registry import query
from callmark.session import work_dir
from callmark.sources.domain import Domain
from callmark.sources.store import Store


def halves(d: Domain) -> tuple[DataFrame, DataFrame]:
    """What was there (orders not divisible by 3) and what comes (even ones, some of them changed or without a value)."""
    o = d.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("seen_at"))
    new = o.filter("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, F.lit("X")).alias("status"), (F.col("price") + 1).alias("price"), (F.col("seen_at") + F.expr("INTERVAL 1 DAY")).alias("seen_at"))
    return o.filter("id % 3 <> 0"), new


_OLD = "old AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS seen_at FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'X' END AS status, o_totalprice + 1 AS price, o_orderdate + INTERVAL 1 DAY AS seen_at FROM orders WHERE o_orderkey % 2 = 0)"


@query(f"WITH {_OLD} SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)", prelude=False)
def merge_latest(d: Domain) -> DataFrame:
    return op.upsert(*halves(d), ["id"], "seen_at")


def stored(d: Domain, rows: DataFrame, keys: list[str], n_buckets: int = 16) -> Store:
    """A new table in the shared folder that holds rows."""
    store = Store.create(d.spark, work_dir(d.spark), rows.schema, keys, n_buckets)
    store.replace(rows)
    return store


@query(f"WITH {_OLD}, u AS (SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)) SELECT u.*, (SELECT count(*) FROM old) AS n_before, 1::BIGINT AS states_added FROM u", prelude=False)
def stored_latest(d: Domain) -> DataFrame:
    """merge_latest into a table that is kept: only buckets that change are written, the same merge again adds no state, and the state before can still be read."""
    old, new = halves(d)
    store = stored(d, old, ["id"])
    first = store.manifest().number
    for _ in range(2):
        store.merge(new, lambda a, b: op.upsert(a, b, ["id"], "seen_at"))
    return store.read().withColumns({"n_before": F.lit(store.read(first).count()), "states_added": F.lit(store.manifest().number - first).cast("long")})


@query(f"WITH {_OLD}, x AS (SELECT coalesce(new.id, old.id) AS id, coalesce(new.status, old.status) AS status, coalesce(old.price, new.price) AS price, coalesce(new.seen_at, old.seen_at) AS seen_at FROM old FULL JOIN new ON old.id = new.id) SELECT * FROM x", prelude=False)
def stored_filling(d: Domain) -> DataFrame:
    """merge_filling into a table that is kept, in two parts."""
    old, new = halves(d)
    store = stored(d, old, ["id"])
    for part in (F.col("id") < 3_000, F.col("id") >= 3_000):
        store.merge(new.filter(part), lambda a, b: op.upsert_filling(a, b, ["id"], untouched=["price"]))
    return store.read()


@query("+ x AS (SELECT ticker, day, close FROM price) SELECT * FROM x")
def refreshed_prices(d: Domain) -> DataFrame:
    """A table of closes that is made anew in place of what it had (here every close plus one): readers see the old or the new."""
    closes = d.price.select("ticker", "day", "close")
    store = stored(d, closes.withColumn("close", F.col("close") + 1), ["ticker", "day"])
    store.replace(closes)
    return store.read()


_KINDS = {"n": "count", "total": "sum", "first_at": "min", "last_at": "max", "errors": "count"}


@query("SELECT user_id, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total, min(ts) AS first_at, max(ts) AS last_at, count(*) FILTER (WHERE event_type = 'error') AS errors, 0::BIGINT AS n_drifted FROM events GROUP BY user_id", prelude=False)
def kept_counters(d: Domain) -> DataFrame:
    """Counters of each user kept up with four batches of events, the second of which comes twice; held against a recount, of which none differs."""
    events = d.table("events")
    measures = {"n": ("count", F.lit(True)), "total": ("sum", F.round(F.col("value") * 100).cast("long")), "first_at": ("min", F.col("ts")), "last_at": ("max", F.col("ts")), "errors": ("count", F.col("event_type") == "error")}
    states = lambda rows: counters.states(rows, ["user_id"], measures)
    store = Store.create(d.spark, work_dir(d.spark), states(events).schema, ["user_id"], 16)
    for batch in (0, 1, 1, 2, 3):
        counters.add(store, states(events.filter(F.col("event_id") % 4 == batch)), _KINDS, "events", batch)
    drifted = counters.reconciled(store, states(events), _KINDS).count()
    return store.read().withColumn("n_drifted", F.lit(drifted).cast("long"))


@query(f"WITH {_OLD} SELECT coalesce(new.id, old.id) AS id, coalesce(new.status, old.status) AS status, coalesce(old.price, new.price) AS price, coalesce(new.seen_at, old.seen_at) AS seen_at, old.id IS NULL AS inserted FROM old FULL JOIN new ON old.id = new.id", prelude=False)
def merge_filling(d: Domain) -> DataFrame:
    """The price stands for a column that a merge must never touch."""
    return op.upsert_filling(*halves(d), ["id"], untouched=["price"])


@query(f"WITH {_OLD} SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)", prelude=False)
def merge_absent(d: Domain) -> DataFrame:
    return op.insert_absent(*halves(d), ["id"])


@query(f"WITH {_OLD}, o AS (SELECT id, status, seen_at FROM old), n AS (SELECT id, status, seen_at FROM new WHERE status = 'X') SELECT * FROM o WHERE seen_at NOT IN (SELECT seen_at FROM n) UNION ALL SELECT * FROM n", prelude=False)
def replace_runs(d: Domain) -> DataFrame:
    old, new = (x.select("id", "status", "seen_at") for x in halves(d))
    return op.replace_run(old, new.filter("status = 'X'"), "seen_at")


_PAGES = "pages_ AS (SELECT user_id AS run_id, event_id % 23 + CASE WHEN event_id % 7 = 3 THEN 30 ELSE 0 END AS page_num, max(ts) AS ts FROM events GROUP BY ALL)"


def crawl_pages(d: Domain) -> DataFrame:
    """run_id, page_num, ts; every seventh page has a number far behind the others, which leaves gaps."""
    number = F.col("event_id") % 23 + F.when(F.col("event_id") % 7 == 3, 30).otherwise(0)
    return d.table("events").groupBy(F.col("user_id").alias("run_id"), number.alias("page_num")).agg(F.max("ts").alias("ts"))


@query(f"WITH {_PAGES}, n AS (SELECT run_id, page_num, row_number() OVER (PARTITION BY run_id ORDER BY page_num) AS rn FROM pages_ WHERE page_num > 0) SELECT run_id, count(*) AS n_pages FROM n WHERE page_num = rn GROUP BY run_id", prelude=False)
def resume_prefix(d: Domain) -> DataFrame:
    """From which page a crawl can go on: the pages it has from 1 without a gap."""
    return op.longest_prefix(crawl_pages(d).filter("page_num > 0"))


_PREFIX = "n AS (SELECT run_id, page_num, ts, row_number() OVER (PARTITION BY run_id ORDER BY page_num) AS rn FROM pages_ WHERE page_num > 0), k AS (SELECT run_id // 10 AS creator, run_id, page_num, ts FROM n WHERE page_num = rn), s AS (SELECT creator, run_id, count(*) AS n FROM k GROUP BY ALL), best AS (SELECT creator, arg_max(run_id, (n, run_id)) AS run_id FROM s GROUP BY creator)"


@query(f"WITH {_PAGES}, {_PREFIX} SELECT creator, run_id, page_num, ts FROM k JOIN best USING (creator, run_id) WHERE page_num > 1", prelude=False)
def resume_pages(d: Domain) -> DataFrame:
    """Of each creator's runs (ten a creator) the one with most pages from 1 without a gap, the newest of equals: its pages to take over, but for the first, which is fetched anew."""
    return op.best_prefix(crawl_pages(d).filter("page_num > 0").withColumn("creator", F.floor(F.col("run_id") / 10)), "creator").filter("page_num > 1")


@query(f"WITH {_PAGES} SELECT page_num, arg_max(run_id, (ts, run_id)) AS run_id, max(ts) AS ts FROM pages_ GROUP BY page_num", prelude=False)
def newest_pages(d: Domain) -> DataFrame:
    """Of each page the copy of the newest run."""
    return crawl_pages(d).groupBy("page_num").agg(F.max_by("run_id", F.struct("ts", "run_id")).alias("run_id"), F.max("ts").alias("ts"))


@query(f"WITH {_PAGES} SELECT run_id, sha256(string_agg(page_num::VARCHAR, chr(10) ORDER BY page_num)) AS fingerprint FROM pages_ GROUP BY run_id", prelude=False)
def page_fingerprints(d: Domain) -> DataFrame:
    from callmark.functions.text import fingerprint

    ids = F.transform(F.array_sort(F.collect_list("page_num")), lambda x: x.cast("string"))
    return crawl_pages(d).groupBy("run_id").agg(fingerprint(ids).alias("fingerprint"))


@query("""WITH c AS (SELECT page_id AS id, 'a' AS source, page_id % 3 = 0 AS downloaded FROM pages UNION ALL SELECT doc_id, 'b', doc_id % 4 = 0 FROM documents UNION ALL SELECT doc_id, 'a', doc_id % 5 = 0 FROM labels)
SELECT source, count(*) AS total, count(*) FILTER (WHERE downloaded) AS downloaded, count(*) FILTER (WHERE NOT downloaded) AS pending FROM c GROUP BY source""", prelude=False)
def pending_counts(d: Domain) -> DataFrame:
    """Three catalogs summed by source; a source may be in several."""
    part = lambda t, c, s, n: d.table(t).groupBy(F.lit(s).alias("source")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(c) % n == 0).alias("downloaded"))
    both = part("pages", "page_id", "a", 3).unionByName(part("documents", "doc_id", "b", 4)).unionByName(part("labels", "doc_id", "a", 5))
    return both.groupBy("source").agg(F.sum("total").alias("total"), F.sum("downloaded").alias("downloaded"), F.sum(F.col("total") - F.col("downloaded")).alias("pending"))


@query("""WITH t AS (SELECT event_type AS source, sum((props->>'k')::BIGINT)::BIGINT AS total FROM events WHERE (props->>'k') IS NOT NULL GROUP BY event_type
UNION ALL SELECT 'search', sum(n_chars)::BIGINT FROM documents UNION ALL SELECT 'posts', sum(CASE WHEN c_custkey < 0 THEN 1 ELSE 0 END)::BIGINT FROM customer UNION ALL SELECT 'creators', sum(s_suppkey)::BIGINT FROM supplier) SELECT * FROM t WHERE total <> 0""", prelude=False)
def known_totals(d: Domain) -> DataFrame:
    """Totals told in JSON and in two state tables; those that are 0 are left out."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    told = d.table("events").filter(F.get_json_object("props", "$.k").isNotNull()).groupBy(F.col("event_type").alias("source")).agg(F.sum(k).alias("total"))
    one = lambda t, name, of: d.table(t).agg(F.sum(of).cast("long").alias("total")).select(F.lit(name).alias("source"), "total")
    both = told.unionByName(one("documents", "search", F.col("n_chars"))).unionByName(one("customer", "posts", F.when(F.col("c_custkey") < 0, 1).otherwise(0))).unionByName(one("supplier", "creators", F.col("s_suppkey")))
    return both.filter("total <> 0")


def not_downloaded(d: Domain) -> DataFrame:
    docs = d.table("documents").select(F.col("doc_id").alias("page_id"), "lang")
    return d.table("pages").filter("page_id % 3 <> 0").select("page_id", "url").join(docs, "page_id", "left").select("page_id", "url", F.coalesce("lang", F.lit("n/a")).alias("lang"))


@query("""SELECT p.page_id, url, coalesce(lang, 'n/a') AS lang FROM pages p LEFT JOIN documents d ON p.page_id = d.doc_id WHERE p.page_id % 3 <> 0 ORDER BY p.page_id""", prelude=False)
def pending_queue(d: Domain) -> DataFrame:
    """All that is not downloaded, oldest first, missing fields filled from the row beside it."""
    return op.pending(not_downloaded(d), "page_id")


@query("SELECT coalesce(CASE WHEN doc_id % 7 <> 0 THEN 2020 + doc_id % 5 END, 0) AS year, count(*) AS total, count(*) FILTER (WHERE doc_id % 4 = 0) AS downloaded FROM documents GROUP BY ALL", prelude=False)
def catalog_years(d: Domain) -> DataFrame:
    year = F.when(F.col("doc_id") % 7 != 0, 2020 + F.col("doc_id") % 5)
    return d.table("documents").groupBy(F.coalesce(year, F.lit(0)).alias("year")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("doc_id") % 4 == 0).alias("downloaded"))


@query("""WITH u AS (SELECT event_type, event_id // 100 AS page, '["' || string_agg(event_id::VARCHAR, '","' ORDER BY event_id) || '"]' AS ids FROM events GROUP BY ALL),
x AS (SELECT event_type, page, unnest(string_split(replace(replace(replace(ids, '["', ''), '"]', ''), '","', ','), ',')) AS id, unnest(range(0, len(string_split(ids, ',')))) AS ord FROM u)
SELECT x.event_type, x.page, ord, id::BIGINT AS event_id, value FROM x JOIN events ON event_id = id::BIGINT""", prelude=False)
def catalog_pages(d: Domain) -> DataFrame:
    """Ids in a JSON array, in their order, joined with what they name; a page holds the ids of a hundred, whatever the table's size."""
    e, keys = d.table("events"), ["event_type", "page"]
    ids = F.to_json(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")))
    stored = e.withColumn("page", F.floor(F.col("event_id") / 100)).groupBy(*keys).agg(ids.alias("ids"))
    each = stored.select(*keys, F.posexplode(F.from_json("ids", "array<string>")).alias("ord", "id"))
    return each.select(*keys, F.col("ord").cast("long").alias("ord"), F.col("id").cast("long").alias("event_id")).join(e.select("event_id", "value"), "event_id")


@query("""WITH u AS (SELECT user_id, event_type, ts::DATE AS day, '["' || string_agg(event_id::VARCHAR, '","' ORDER BY event_id) || '"]' AS ids FROM events GROUP BY ALL),
x AS (SELECT user_id, event_type, day, unnest(string_split(replace(replace(replace(ids, '["', ''), '"]', ''), '","', ','), ',')) AS id, unnest(range(0, len(string_split(ids, ',')))) AS ord FROM u)
SELECT x.user_id, x.event_type, x.day, ord, id::BIGINT AS event_id, value FROM x JOIN events ON event_id = id::BIGINT""", prelude=False)
def catalog_entries(d: Domain) -> DataFrame:
    """The same by user, type and day."""
    e, keys = d.table("events"), ["user_id", "event_type", "day"]
    ids = F.to_json(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")))
    stored = e.withColumn("day", F.to_date("ts")).groupBy(*keys).agg(ids.alias("ids"))
    each = stored.select(*keys, F.posexplode(F.from_json("ids", "array<string>")).alias("ord", "id"))
    return each.select(*keys, F.col("ord").cast("long").alias("ord"), F.col("id").cast("long").alias("event_id")).join(e.select("event_id", "value"), "event_id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'O' ELSE o_orderstatus END AS status, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END, (SELECT min(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey)) AS dated FROM orders", prelude=False)
def state_repair(d: Domain) -> DataFrame:
    """Stuck states are reset, missing dates filled from what is known of the item otherwise."""
    first = d.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first"))
    stuck = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < "1998-01-01")
    return d.table("orders").join(first, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("id"), F.when(stuck, "O").otherwise(F.col("o_orderstatus")).alias("status"), F.coalesce(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")), "first").alias("dated"))


_STATUS = {"view": "pending", "click": "audio_downloaded", "purchase": "transcribing", "signup": "done", "error": "error"}
_NOW = "2024-01-20 00:00:00"


@query(f"""WITH e AS (SELECT user_id AS item_id, ts, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())} END AS status, CASE WHEN event_type = 'error' THEN 'e' || (event_id % 9) END AS error, CASE WHEN event_id % 3 = 0 THEN 'l' || (event_id % 5) END AS language FROM events),
s AS (SELECT item_id, max((ts, status)) AS s, (max((ts, error)) FILTER (WHERE error IS NOT NULL))[2] AS error, (max((ts, language)) FILTER (WHERE language IS NOT NULL))[2] AS language, max(ts) FILTER (WHERE status = 'done') AS transcribed_at FROM e GROUP BY item_id),
g AS (SELECT *, s[2] IN ('audio_downloaded', 'transcribing') AND s[1] + INTERVAL 6 HOUR <= TIMESTAMP '{_NOW}' AS gone FROM s)
SELECT item_id, CASE WHEN gone THEN 'pending' ELSE s[2] END AS status, CASE WHEN gone THEN s[1] + INTERVAL 6 HOUR ELSE s[1] END AS since, error, language, transcribed_at FROM g""", prelude=False)
def life_cycles(d: Domain) -> DataFrame:
    """Where each item stands at a time by the events told of it: what was stuck is put back, errors and languages stay as last told. callmark.streaming keeps the same up with a stream."""
    from callmark.streaming.lifecycle import settled

    n, kind = F.col("event_id"), F.col("event_type")
    status = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in _STATUS.items()))
    events = d.table("events").select(F.col("user_id").alias("item_id"), F.col("ts").cast("timestamp").alias("at"), status.alias("status"), F.when(kind == "error", F.concat(F.lit("e"), (n % 9).cast("string"))).alias("error"), F.when(n % 3 == 0, F.concat(F.lit("l"), (n % 5).cast("string"))).alias("language"))
    found = settled(events, _NOW)
    return found.select("item_id", "status", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("since", "transcribed_at")), "error", "language")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts DESC, event_id) AS rn FROM events) SELECT user_id, event_id, event_type FROM r WHERE rn = 1""", prelude=False)
def best_copy(d: Domain) -> DataFrame:
    """Of each key the best row: by preference, then the newest, then the smallest id."""
    place = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    w = Window.partitionBy("user_id").orderBy(place, F.desc("ts"), "event_id")
    return d.table("events").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("user_id", "event_id", "event_type")
