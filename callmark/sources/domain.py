"""The domain's tables, projected from the provided ones; ``PRELUDE`` is the same in DuckDB's SQL.

region -> source, customer -> channel, orders -> item, lineitem and part -> call (prediction) and its extraction run,
average prices by brand and day -> price, events -> market view. Every tenth item has no channel, so that outer joins have something to show.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOW = "2000-06-30 00:00:00"
#: What market views say, by number: words that only look like keywords, codes, and both languages.
RATIONALES = (
    "bond yields and rates", "Gold price", "gold against YIELDS", "", None, "Goldman on chips, AI boom", "港股急升 with A股", "^TNX at 5, USDJPY", "S&P 500 and the macroeconomy", "war in Hormuz; post-war warming", "paid in full, said the utility",
    "樓市 and 房價 fall", "SMRs are no smr", "high yield default, junk", "corn, cornered; robotaxi", "騰訊 0700.hk",
)
#: About so many rows are one task's where tasks() is asked.
ROWS_A_TASK = 250_000
TIMEFRAMES = {1: "5d", 2: "2 weeks", 3: "3M", 4: "1Q", 5: "1Y"}


class Domain:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def tasks(self, name: str) -> int:
        """How many tasks share rows as many as a table has, so that one's memory stays as it is when the table grows; its files' footers tell the number."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.table(name).count() // ROWS_A_TASK))

    @cached_property
    def source(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").alias("source_id"), F.col("r_name").alias("source"))

    @cached_property
    def channel(self) -> DataFrame:
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("source_id"))
        return self.table("customer").join(F.broadcast(nation), "c_nationkey").select(F.col("c_custkey").alias("channel_id"), "source_id", F.col("c_name").alias("handle"), F.col("c_mktsegment").alias("segment"))

    @cached_property
    def owned_item(self) -> DataFrame:
        """item, and owner_id: the customer whose order it is, which every item has."""
        o = self.table("orders")
        owner = self.channel.select(F.col("channel_id").alias("o_custkey"), "source_id")
        return o.join(owner, "o_custkey").select(
            F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("channel_id"), "source_id", F.col("o_orderdate").alias("published_at"),
            F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "error").otherwise("pending").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("length"), F.col("o_custkey").alias("owner_id"))

    @cached_property
    def item(self) -> DataFrame:
        """item_id, channel_id (null for every tenth), source_id, published_at, status, priority, price."""
        return self.owned_item.drop("owner_id")

    @cached_property
    def named_item(self) -> DataFrame:
        """item, and its channel's handle. Joined by owner: by channel, all items without one would be a single task's."""
        channel = self.channel.select(F.col("channel_id").alias("__channel"), "handle")
        return self.owned_item.join(channel, (F.col("owner_id") == F.col("__channel")) & F.col("channel_id").isNotNull(), "left").drop("owner_id", "__channel")

    @cached_property
    def call(self) -> DataFrame:
        """call_id (a string of the key columns), item_id, provider, model, ticker, speaker, made_at, direction, action, timeframe."""
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"), F.col("p_name").alias("asset_name"), F.col("p_type").alias("kind"))
        line = F.col("l_linenumber")
        timeframe = F.element_at(F.create_map(*(x for k, v in TIMEFRAMES.items() for x in (F.lit(k), F.lit(v)))), line)
        q = F.col("l_quantity").cast("int") % 3
        return self.table("lineitem").join(part, "l_partkey").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("call_id"), F.col("l_orderkey").alias("item_id"), F.col("l_linestatus").alias("provider"), F.col("l_returnflag").alias("model"),
            "ticker", "asset_name", "kind", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("speaker"), F.col("l_shipdate").alias("made_at"),
            F.when(q == 0, "up").when(q == 1, "down").otherwise("flat").alias("direction"), F.when(line == 7, "buy").when(line == 6, "watch").alias("action"), timeframe.alias("timeframe"))

    @cached_property
    def primary_run(self) -> DataFrame:
        """item_id, provider, model: the smallest run of each item."""
        return self.call.groupBy("item_id").agg(F.min(F.struct("provider", "model")).alias("run")).select("item_id", "run.provider", "run.model")

    @cached_property
    def primary_call(self) -> DataFrame:
        """Calls of each item's primary run: one shuffle by item, no join with the runs."""
        first = F.rank().over(Window.partitionBy("item_id").orderBy("provider", "model"))
        return self.call.withColumn("__place", first).filter("__place = 1").drop("__place")

    @cached_property
    def view(self) -> DataFrame:
        """view_id, item_id, speaker, asset_class, direction, rationale, seen_at: market views, from events; an event's item is the order of its number."""
        e = self.table("events")
        order = self.table("orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("seen_at"))
        why = F.element_at(F.array(*map(F.lit, RATIONALES)), (F.col("event_id") % len(RATIONALES) + 1).cast("int"))
        return e.select(F.col("event_id").alias("view_id"), F.col("event_id").alias("item_id"), F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("speaker"), F.col("event_type").alias("asset_class"),
                        F.when(F.col("value") > 20, "bullish").when(F.col("value") > 8, "bearish").otherwise("mixed").alias("direction"), why.alias("rationale")).join(order, "item_id")

    @cached_property
    def price(self) -> DataFrame:
        """ticker, day, close: a day on which a multiple of seven was sold has no close, and so is a gap."""
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
        rows = self.table("lineitem").join(part, "l_partkey")
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")  # whole numbers add up alike in any order
        sold = F.sum(F.col("l_quantity").cast("long"))
        return rows.groupBy("ticker", F.to_date("l_shipdate").alias("day")).agg(F.when(sold % 7 != 0, F.sum(cents) / sold).alias("close")).filter("close IS NOT NULL")


PRELUDE = f"""
source AS (SELECT r_regionkey AS source_id, r_name AS source FROM region),
channel AS (SELECT c_custkey AS channel_id, n_regionkey AS source_id, c_name AS handle, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey),
item AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS channel_id, source_id, o_orderdate AS published_at,
    CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'error' ELSE 'pending' END AS status, o_orderpriority AS priority, o_totalprice AS length
    FROM orders JOIN channel ON o_custkey = channel.channel_id),
call AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INT AS call_id, l_orderkey AS item_id, l_linestatus AS provider, l_returnflag AS model,
    p_brand AS ticker, p_name AS asset_name, p_type AS kind, 'S' || l_suppkey AS speaker, l_shipdate AS made_at,
    CASE l_quantity::INT % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'flat' END AS direction, CASE l_linenumber WHEN 7 THEN 'buy' WHEN 6 THEN 'watch' END AS action,
    CASE l_linenumber {' '.join(f"WHEN {k} THEN '{v}'" for k, v in TIMEFRAMES.items())} END AS timeframe,
    CASE l_linenumber WHEN 1 THEN 7 WHEN 2 THEN 14 WHEN 5 THEN 365 ELSE 90 END AS horizon,
    CASE WHEN l_quantity::INT % 3 = 0 OR l_linenumber = 7 THEN 1 WHEN l_quantity::INT % 3 = 1 THEN -1 ELSE 0 END AS sign
    FROM lineitem JOIN part ON l_partkey = p_partkey),
primary_run AS (SELECT item_id, min((provider, model)) AS run FROM call GROUP BY item_id),
primary_call AS (SELECT call.* FROM call JOIN primary_run USING (item_id) WHERE provider = run[1] AND model = run[2]),
view AS (SELECT event_id AS view_id, event_id AS item_id, 'S' || user_id AS speaker, event_type AS asset_class, CASE WHEN value > 20 THEN 'bullish' WHEN value > 8 THEN 'bearish' ELSE 'mixed' END AS direction,
    CASE event_id % {len(RATIONALES)} {' '.join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(RATIONALES) if v is not None)} END AS rationale, o_orderdate AS seen_at FROM events JOIN orders ON o_orderkey = event_id),
price AS (SELECT p_brand AS ticker, l_shipdate::DATE AS day, (sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / sum(l_quantity::BIGINT)::DOUBLE) AS close
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING sum(l_quantity::BIGINT) % 7 <> 0),
last_close AS (SELECT ticker, arg_max(close, day) AS last FROM price GROUP BY ticker),
asked AS (SELECT *, made_at::DATE AS call_day, least(TIMESTAMP '{NOW}', made_at + to_days(horizon::INT)) AS eval_at FROM call),
priced AS (SELECT asked.*, coalesce(a.close, l.last) AS p_call, coalesce(e.close, l.last) AS p_eval FROM asked
    ASOF LEFT JOIN price a ON asked.ticker = a.ticker AND asked.call_day <= a.day
    ASOF LEFT JOIN price e ON asked.ticker = e.ticker AND asked.eval_at::DATE <= e.day
    LEFT JOIN last_close l ON l.ticker = asked.ticker),
scored AS (SELECT *, CASE WHEN sign = 0 OR p_call IS NULL OR p_call = 0 THEN NULL ELSE greatest(-1.0, least(1.0, sign * ((p_eval - p_call) / p_call) * 5.0)) END AS score FROM priced),
primary_scored AS (SELECT scored.* FROM scored JOIN primary_run USING (item_id) WHERE provider = run[1] AND model = run[2])
"""
