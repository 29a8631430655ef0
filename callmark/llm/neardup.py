"""HyperMinHash near-duplicates (operator 7).

A document's set holds the 64-bit hashes of its word shingles. Its sketch has REGISTERS buckets; each keeps, of the least
hash that fell into it, the number of leading zeros and the ten bits after the first one. An empty bucket borrows from a
full one, along a fixed random order. Registers are compressed into bands; documents that agree in a band are candidates.

1. Equal sets are one node from here on, whatever their number.
2. In each band bucket every node is compared with the bucket's smallest: first by the sketches' Jaccard estimate,
   corrected for registers that collide by chance, then on the full sets. This star joins most of a group of copies.
3. What the stars leave apart is compared in full: for buckets that still hold several components, all pairs across
   components, in blocks of bounded size inside tasks that put out only the links that join something new. Members of the
   bucket's largest component are compared with the others only, and sent once for each block of these.
4. Components come from alternating large-star and small-star rounds over the links.

Sets and links are confirmed on 64-bit hashes of shingles: two different shingles of one pair of texts are taken for the same
with a probability of about the product of the sets' sizes over 2^64.

No step writes out the pairs of a group, and buckets and sets that very many rows share meet their one row by broadcast. A pair at the threshold shares no band with probability under MISS, if its sets
are large; of small sets many registers are borrowed, hence the narrow bands. Candidates are never capped. The estimate
rejects a pair only six standard errors below the threshold, by the number of buckets that the smaller set fills.

Defined results: a null or blank text has no shingles, is linked with nothing and kept; a long text's set is made and
compared whole; repeated rows are one node, and each row is reported (``deduplicate`` keeps one of the rows of an id, that
of the least text); rows without doc_id name no component and are kept; an empty table gives no rows; other columns, whatever
their names, are ignored by ``components`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmark.llm.common import few, kept, materialise, name, record, scratch, slices, spread_join, table, whole

REGISTERS, MANTISSA = 192, 10
MISS = 1e-9
#: Members and bytes of sets that a task holds of one side of a block pair.
BLOCK_ROWS, BLOCK_BYTES = 2_048, 16 << 20
#: Members of a star that one task compares with the star's centre.
STAR_ROWS = 2_000
#: Candidates' ids are broadcast up to so many, 8 bytes each; beyond that they are joined by a shuffle.
BROADCAST_IDS = 2_000_000
WORDS_KEPT = 500_000

_U = np.uint64
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_DONORS = (_mix(np.arange(REGISTERS * 64, dtype=np.uint64) + _U(7)) % _U(REGISTERS)).astype(np.int64).reshape(REGISTERS, 64)
_WORDS: dict[bytes, int] = {}


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted different hashes of the text's word shingles; fewer words than width are one shingle."""
    words = text.encode().lower().split()  # of bytes: lowers A-Z alone, splits at \x20 and \x09-\x0D alone
    if not words:
        return np.empty(0, np.uint64)
    if len(_WORDS) > WORDS_KEPT:
        _WORDS.clear()
    for w in set(words):
        if w not in _WORDS:
            _WORDS[w] = xxhash.xxh64_intdigest(w)
    own = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if len(own) < width:
        return np.array([xxhash.xxh64_intdigest(b"\n".join(words), seed=len(words))], np.uint64)
    n = len(own) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = _mix(total + own[k : k + n] * _U(_FACTORS[k % len(_FACTORS)] + 2 * (k // len(_FACTORS))))
    return np.unique(total)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """REGISTERS registers of 6 + MANTISSA bits; the hashes must be sorted and at least one."""
    bucket = ((hashes >> _U(32)) * _U(REGISTERS) >> _U(32)).astype(np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    least = np.minimum.reduceat(_mix(hashes + _U(0x5851F42D4C957F2D)), starts)
    part, bits = np.frexp(np.maximum(least, _U(1)).astype(np.float64))
    out, full = np.zeros(REGISTERS, np.uint16), np.zeros(REGISTERS, bool)
    at = bucket[starts]
    out[at] = ((np.clip(64 - bits, 0, 63) << MANTISSA) | ((part * 2 ** (MANTISSA + 1)).astype(np.int64) - 2**MANTISSA)).astype(np.uint16)
    full[at] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        found = full[_DONORS[empty]]
        first = found.argmax(1)
        donor = np.where(found.any(1), _DONORS[empty, first], at[0])
        out[empty] = out[donor]
    return out


def bands(registers: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of so many registers."""
    own = registers.reshape(-1, rows).astype(np.uint64)
    key = np.arange(len(own), dtype=np.uint64)
    for k in range(rows):
        key = _mix(key * _U(_FACTORS[0]) + own[:, k])
    return key.view(np.int64)


def rows_per_band(percent: int) -> int:
    """The widest bands with which a pair at the threshold is missed with probability under MISS."""
    fit = [r for r in range(1, 13) if REGISTERS % r == 0 and (1 - (percent / 100) ** r) ** (REGISTERS // r) < MISS]
    return max(fit, default=1)


def estimate(one: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Jaccard of one sketch and others, without the registers that are expected to agree by chance."""
    more, less = np.maximum(n, sizes) / REGISTERS, np.minimum(n, sizes) / REGISTERS
    chance = 0.169919487159739093975315012348630288992889 * 4 * (more / np.maximum(less, 1e-9)) / ((1 + more) / np.maximum(less, 1e-9)) ** 2 / 2**MANTISSA
    return ((others == one).mean(1) - chance) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def least_estimate(percent: int, sizes: np.ndarray) -> np.ndarray:
    """Under which estimate no pair is looked at, by the size of its smaller set."""
    t = percent / 100
    filled = REGISTERS * -np.expm1(-sizes / REGISTERS)
    return t - 6 * np.sqrt(t * (1 - t) / filled)


def _features(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """doc_id, n, set_key, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes, keys, own = [], [], []
            for x in part.column("text"):
                s = shingles(x.as_py(), width)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                own.append(bands(sketch(s), rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(own, pa.list_(pa.int64()))], ["doc_id", "n", "set_key", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, set_key binary, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """node, n, registers, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingles(x.as_py(), width) for x in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "registers", "hashes"])

    return docs.mapInArrow(run, "node long, n long, registers binary, hashes binary")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Runs of rows with one key, row by row."""
    from itertools import groupby

    rows = (dict(zip(b.schema.names, x, strict=True)) for b in slices(batches, 64) for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
    yield from groupby(rows, key=lambda r: r[key])


def _links_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (centre, node) that are links. A centre goes once to each salt of its star; its nodes stream past it."""
    salts = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("salts"))
    one = salts.select("centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(sets, F.col("centre") == F.col("node")).withColumn("is_node", F.lit(False))
    many = pairs.join(salts, "centre").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).drop("salts").join(sets, "node").withColumn("is_node", F.lit(True))
    columns = ["star", "is_node", "node", "n", "registers", "hashes"]
    star = F.xxhash64("centre", "salt").alias("star")
    both = one.select(star, "centre", *columns[1:]).unionByName(many.select(star, "centre", *columns[1:]))
    dealt = both.repartition("star").sortWithinPartitions("star", "centre", "is_node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "star"):
            links, centre = [], None
            for r in rows:
                own = np.frombuffer(r["registers"], np.uint16)
                if not r["is_node"]:
                    centre = r["centre"], r["n"], own, np.frombuffer(r["hashes"], np.uint64)
                elif centre and estimate(centre[2], centre[1], own[None], np.array([r["n"]]))[0] >= least_estimate(percent, min(centre[1], r["n"])) and linked(centre[3], np.frombuffer(r["hashes"], np.uint64), percent):
                    links.append((centre[0], r["node"]))
            yield _links_batch(links)

    return dealt.mapInArrow(run, "a long, b long")


def join_blocks(left: list[dict], right: list[dict] | None, percent: int) -> list[tuple[int, int]]:
    """Links that join components, over all pairs of left (right None) or all of left with right.

    Rows: node, component, n, registers, hashes. Pairs within a component, as known so far, are not looked at.
    """
    rows = left + (right or [])
    size = np.array([r["n"] for r in rows])
    registers = np.stack([np.frombuffer(r["registers"], np.uint16) for r in rows])
    names = {c: i for i, c in enumerate(dict.fromkeys(r["component"] for r in rows))}
    component = np.array([names[r["component"]] for r in rows])
    links = []
    # small components first: they meet the large ones in a few vector operations
    weight = np.bincount(component)
    for i in sorted(range(len(left)), key=lambda i: (weight[component[i]], i)):
        others = np.arange(len(left), len(rows)) if right is not None else np.arange(len(rows))
        apart = others[(component[others] != component[i]) & (100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i]))]
        if not len(apart):
            continue
        close = estimate(registers[i], size[i], registers[apart], size[apart])
        least = least_estimate(percent, np.minimum(size[apart], size[i]))
        own = np.frombuffer(rows[i]["hashes"], np.uint64)
        for k in np.argsort(-close, kind="stable"):
            j = apart[k]
            if close[k] >= least[k] and component[j] != component[i] and linked(own, np.frombuffer(rows[j]["hashes"], np.uint64), percent):
                links.append((rows[i]["node"], rows[j]["node"]))
                component[component == component[j]] = component[i]
    return links


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members: bucket, node, component, n (a table). Links across the components of each bucket, found block pair by block pair."""
    by_component = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("hashes"))
    most = F.max_by(F.struct("component", "rows", "hashes"), F.struct("rows", "component"))
    stats = by_component.groupBy("bucket").agg(most.alias("most"), F.sum("rows").alias("rows"), F.sum("hashes").alias("hashes"))
    blocks = lambda rows, hashes: F.greatest(F.lit(1), F.ceil(rows / BLOCK_ROWS), F.ceil(hashes * 8 / BLOCK_BYTES)).cast("int")
    stats = materialise(stats.select("bucket", "rows", F.col("most.component").alias("major"), blocks(F.col("most.rows"), F.col("most.hashes")).alias("of_major"), blocks(F.col("rows") - F.col("most.rows"), F.col("hashes") - F.col("most.hashes")).alias("of_rest")))
    is_major = F.col("component") == F.col("major")
    sized = spread_join(members, stats, "bucket", "rows").withColumn("block", F.pmod(F.xxhash64("node"), F.when(is_major, F.col("of_major")).otherwise(F.col("of_rest"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda kind, a, b, second, alone: F.struct(F.xxhash64("bucket", F.lit(kind), a, b).alias("pair"), second.alias("second"), alone.alias("alone"))
    block, no = F.col("block"), F.lit(False)
    with_rest = F.transform(upto(F.col("of_rest")), lambda o: pair(0, F.least(block, o), F.greatest(block, o), block > o, block == o))
    with_major = F.transform(upto(F.col("of_major")), lambda k: pair(1, block, k, no, no))
    from_major = F.transform(upto(F.col("of_rest")), lambda o: pair(1, o, block, F.lit(True), no))
    dealt = (
        sized.select("node", "component", F.inline(F.when(is_major, from_major).otherwise(F.concat(with_rest, with_major))))
        .join(sets, "node").repartition("pair").sortWithinPartitions("pair")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, "pair"):
            rows = list(group)
            left = sorted((r for r in rows if not r["second"]), key=lambda r: r["node"])
            right = None if rows[0]["alone"] else sorted((r for r in rows if r["second"]), key=lambda r: r["node"])
            if left and len({r["component"] for r in rows}) > 1:
                yield _links_batch(join_blocks(left, right, percent))

    return dealt.mapInArrow(run, "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of links (a, b), by alternating large stars and small stars."""
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("x"), "u", "m")
        edges = materialise(small.filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, a row for each row of docs."""
    docs = docs.select(F.col(name(id_col)).cast("long").alias("doc_id"), whole(name(text_col)).alias("text"))
    with scratch(docs.sparkSession):
        features = kept(_features(docs, width, rows_per_band(percent)))
        of_rows = features.filter("n > 0 AND doc_id IS NOT NULL")
        nodes = materialise(of_rows.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies")))
        in_band = nodes.select("node", "n", F.explode("bands").alias("bucket"))
        buckets = materialise(in_band.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("centre")).filter("members > 1"))
        members = materialise(spread_join(in_band, buckets, "bucket", "members"))
        pairs = members.filter("node <> centre").select("centre", "node").distinct()
        sets = materialise(_sets(_rows_of(docs, members.select("node").distinct()), width))
        stars = materialise(_star_links(pairs, sets, percent))
        joined = connected(stars)

        # buckets of two are settled; of the others, each different list of members that spans components is looked at once
        named = materialise(members.filter("members > 2").select("bucket", "members", "node", "n").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
        open_ = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.col("node").cast("decimal(38,0)")).alias("s")).filter("low < high")
        open_ = materialise(open_.groupBy("size", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket", "size"))
        more = materialise(_block_links(materialise(spread_join(named, open_, "bucket", "size").select("bucket", "node", "component", "n")), sets, percent))
        final = connected(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        ids = kept(nodes.select("set_key", "node", "copies").join(final, "node", "left").select("set_key", "copies", F.coalesce("component", "node").alias("component_id")))

    rest = features.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return spread_join(of_rows.select("set_key", "doc_id", F.col("n").alias("n_shingles")), ids, "set_key", "copies").select("doc_id", "n_shingles", "component_id").unionByName(rest)


def _rows_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of docs for each node."""
    return docs.join(_if_few(nodes.withColumnRenamed("node", "doc_id")), "doc_id", "left_semi")


def _if_few(ids: DataFrame) -> DataFrame:
    """For broadcast, if a count shows that the ids are few."""
    return F.broadcast(ids) if few(ids, BROADCAST_IDS) else ids


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows of other documents than a component's first, and each kept document once."""
    with scratch(docs.sparkSession):
        found = materialise(components(docs, id_col, text_col, width, percent))
        gone = kept(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct())
        repeated = kept(found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("again")).count().filter("count > 1").select("again"))
    rows = record(docs, id=F.col(name(id_col)).cast("long"))
    left = rows.join(_if_few(gone), F.col("id") == F.col("gone"), "left_anti")
    if not repeated.isEmpty():
        again = _if_few(repeated)
        once = left.join(again, F.col("id") == F.col("again"), "left_semi").groupBy("id").agg(F.min_by("record", F.coalesce(F.col(f"record.{name(text_col)}"), F.lit(""))).alias("record"))
        left = left.join(again, F.col("id") == F.col("again"), "left_anti").select("record").unionByName(once.select("record"))
    return left.select(*(F.col(f"record.{name(c)}").alias(c) for c in docs.columns))


def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
