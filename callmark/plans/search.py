"""Search over documents, links between mean-pooled vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmark.operators import search as vectors
from callmark.operators import text_index as op
from callmark.plans.registry import query
from callmark.session import materialise, shared_dir
from callmark.sources.domain import Domain

#: Indexes written in this application: (application, table's files) -> folder.
_INDEXES: dict[tuple, str] = {}


def indexed(d: Domain) -> DataFrame:
    """The index of documents, written once for an application and state of the table; the title is the first line."""
    docs = d.table("documents")
    stamp = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()  # a row a file
    key = (d.spark.sparkContext.applicationId, *sorted(map(tuple, stamp)))
    if key not in _INDEXES:
        path = f"{shared_dir(d.spark)}/{uuid.uuid4().hex}"
        op.write_index(titled(d), path)
        _INDEXES[key] = path
    return op.read_index(d.spark, _INDEXES[key])


def titled(d: Domain) -> DataFrame:
    """doc_id, title, body, source."""
    return d.table("documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), "source")


def dated(d: Domain) -> DataFrame:
    """doc_id, source, published_at (that of the order of the same number, if there is one), without texts."""
    dates = d.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("published_at"))
    return d.table("documents").select("doc_id", "source").join(dates, "doc_id", "left")


_WORDS = """docs AS (SELECT doc_id, source, o_orderdate AS published_at, text, regexp_extract_all(lower(string_split(coalesce(text, ''), chr(10))[1]), '[\\p{L}\\p{N}_]+') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS b FROM documents LEFT JOIN orders ON o_orderkey = doc_id)"""


def _places(*terms: str) -> str:
    """CTEs w (doc_id, term, p, w: place and weight) and r (doc_id, rank) for two or more words."""
    return f"""w AS (SELECT doc_id, term, p, CASE WHEN p <= n THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS w FROM (SELECT doc_id, len(t) AS n, unnest(t || b) AS term, unnest(range(1, len(t) + len(b) + 1)) AS p FROM docs) WHERE term IN ({', '.join(f"'{x}'" for x in terms)})),
hit AS (SELECT doc_id FROM w GROUP BY doc_id HAVING count(DISTINCT term) = {len(terms)}),
r AS (SELECT doc_id, coalesce(1 - exp(sum(ln(1 - sqrt(x.w * y.w / (1.005 + 0.05 * exp(abs(x.p - y.p) / 1.5::DOUBLE - 2)))))), 0.0) AS rank FROM hit JOIN (SELECT *, p // {op.NEAR + 1} AS blk FROM w) x USING (doc_id) JOIN (SELECT *, unnest([p // {op.NEAR + 1} - 1, p // {op.NEAR + 1}, p // {op.NEAR + 1} + 1]) AS blk FROM w) y USING (doc_id, blk)
    WHERE x.term < y.term AND abs(x.p - y.p) <= {op.NEAR} GROUP BY doc_id),
ranks AS (SELECT doc_id, round(coalesce(rank, 0.0), 6) AS rank FROM hit LEFT JOIN r USING (doc_id))"""


@query(f"WITH {_WORDS}, {_places('the', 'and')} SELECT doc_id, source, published_at, rank FROM ranks JOIN docs USING (doc_id)", prelude=False)
def search(d: Domain) -> DataFrame:
    """Documents with all words of a query, ranked by nearness, then newest first; read from the index and the columns shown alone."""
    found = op.search(indexed(d), "The and").withColumn("rank", F.round("rank", 6))
    return found.join(dated(d), "doc_id").select("doc_id", "source", "published_at", "rank").orderBy(F.desc("rank"), F.desc_nulls_last("published_at"), F.desc("doc_id"))


@query(f"WITH {_WORDS}, {_places('that', 'with', 'from')}, n AS (SELECT count(*) AS total FROM ranks) SELECT doc_id, source, published_at, rank, total FROM ranks JOIN docs USING (doc_id), n ORDER BY rank DESC, published_at DESC NULLS LAST, doc_id DESC LIMIT 25", prelude=False)
def search_page(d: Domain) -> DataFrame:
    """The first page of a query of three words, and the number of all that it finds."""
    found = materialise(op.search(indexed(d), "that WITH from").withColumn("rank", F.round("rank", 6)))
    total = found.agg(F.count(F.lit(1)).alias("total"))  # one row
    page = found.join(dated(d), "doc_id").orderBy(F.desc("rank"), F.desc_nulls_last("published_at"), F.desc("doc_id")).limit(25)
    return page.crossJoin(F.broadcast(total)).select("doc_id", "source", "published_at", "rank", "total")


@query(f"""WITH {_WORDS}, l AS (SELECT doc_id, term, i, n FROM (SELECT doc_id, len(t) AS n, unnest(t || b) AS term, unnest(range(1, len(t) + len(b) + 1)) AS i FROM docs) WHERE term = 'this'),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, CASE WHEN i <= n THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS w FROM l)
SELECT doc_id, round((max(w) + sum(w / (k * k)) - arg_max(w / (k * k), (w, -k))) / (pi() * pi() / 6), 6) AS rank FROM k GROUP BY doc_id""", prelude=False)
def search_word(d: Domain) -> DataFrame:
    """Documents with one word, by its places in title and body."""
    return op.search(indexed(d), " this ").select("doc_id", F.round("rank", 6).alias("rank"))


_IS = "('this', 'with')"


@query(f"""WITH {_WORDS}, c AS (SELECT doc_id, b, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+[^\\p{{L}}\\p{{N}}_]*') AS chunks FROM docs WHERE list_has_all(t || b, ['this', 'with'])),
p AS (SELECT doc_id, b[i] AS term, i AS p, len(b) AS n FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i FROM c) WHERE b[i] IN {_IS}),
win AS (SELECT x.doc_id, x.p AS a, greatest(min(y.p) FILTER (WHERE y.term = 'this'), min(y.p) FILTER (WHERE y.term = 'with')) AS z, any_value(x.n) AS n FROM p x JOIN p y ON x.doc_id = y.doc_id AND y.p >= x.p GROUP BY x.doc_id, x.p HAVING count(DISTINCT y.term) = 2),
cov AS (SELECT doc_id, max(a) AS a, z, any_value(n) AS n FROM win GROUP BY doc_id, z),
st AS (SELECT *, CASE WHEN z - a + 1 >= 30 THEN a ELSE greatest(1, a - (30 - (z - a + 1)) // 2) END AS s0 FROM cov), en AS (SELECT *, CASE WHEN z - a + 1 >= 30 THEN a + 29 ELSE least(n, s0 + 29) END AS e FROM st), fr AS (SELECT *, CASE WHEN z - a + 1 >= 30 THEN a ELSE greatest(1, e - 29) END AS s FROM en),
f1 AS (SELECT doc_id, arg_min((s, e), (z - a, a)) AS f FROM fr GROUP BY doc_id), f2 AS (SELECT fr.doc_id, arg_min((s, e), (z - a, a)) AS f FROM fr JOIN f1 ON f1.doc_id = fr.doc_id WHERE e < f1.f[1] OR s > f1.f[2] GROUP BY fr.doc_id),
fs AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT doc_id, (1, least(8, len(b))) FROM c WHERE doc_id NOT IN (SELECT doc_id FROM f1)),
g AS (SELECT doc_id, f, list_filter(range(f[1], f[2] + 1), lambda i: length(b[i]) > 2 OR b[i] IN {_IS}) AS good, b, chunks FROM fs JOIN c USING (doc_id)),
h AS (SELECT doc_id, f[1] AS began, CASE WHEN len(good) > 0 AND good[-1] - good[1] + 1 >= 8 THEN (good[1], good[-1]) ELSE f END AS f, b, chunks FROM g),
s AS (SELECT doc_id, began, regexp_replace(array_to_string(list_transform(range(f[1], f[2] + 1), lambda i: CASE WHEN b[i] IN {_IS} THEN regexp_replace(chunks[i], '^([\\p{{L}}\\p{{N}}_]+)', '<b>\\1</b>') ELSE chunks[i] END), ''), '(</b>)?([^\\p{{L}}\\p{{N}}_]*)$', '\\1') AS shown FROM h)
SELECT doc_id, string_agg(shown, ' ... ' ORDER BY began) AS headline FROM s GROUP BY doc_id""", prelude=False)
def headlines(d: Domain) -> DataFrame:
    """What is shown of each document with two words: two fragments around the shortest windows with both, words marked."""
    found = op.matches(indexed(d), op.query_words("this with"))
    return op.headlines(found, titled(d), "this with")


@query("SELECT doc_id, source, 0.0::DOUBLE AS rank FROM documents WHERE lang = 'en' ORDER BY doc_id DESC LIMIT 200", prelude=False)
def browse(d: Domain) -> DataFrame:
    """A blank query lists everything, newest first."""
    assert not op.query_words("  ")
    return d.table("documents").filter("lang = 'en'").select("doc_id", "source", F.lit(0.0).alias("rank")).orderBy(F.desc("doc_id")).limit(200)


#: So many neighbouring vectors are one item's, so that items grow with the table.
VECTORS_PER_ITEM = 5


def pooled_items(d: Domain) -> DataFrame:
    return vectors.mean_pool(d.table("embeddings").withColumn("item", F.floor(F.col("vec_id") / VECTORS_PER_ITEM)), "item", "embedding")


_POOLED = f"""pooled AS (SELECT item, list(x ORDER BY i) AS v FROM (SELECT vec_id // {VECTORS_PER_ITEM} AS item, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL) GROUP BY item)"""


@query(f"WITH {_POOLED} SELECT item, i - 1 AS place, round(v[i], 6) AS x FROM pooled, range(1, 65) r(i)", prelude=False)
def mean_pooled(d: Domain) -> DataFrame:
    return pooled_items(d).select("item", F.posexplode("vector").alias("place", "x")).select("item", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


@query(f"""WITH {_POOLED}, s AS (SELECT a.item AS a, b.item AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM pooled a, pooled b WHERE a.item <> b.item)
SELECT a, b, similarity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rn FROM s) WHERE rn <= 10""", prelude=False)
def links(d: Domain) -> DataFrame:
    """Each item's ten nearest by cosine of mean-pooled vectors."""
    return vectors.cosine_links(pooled_items(d))
