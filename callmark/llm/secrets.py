"""Secret scans with corpus-wide ownership frequency (operator 1).

Every text is scanned for candidate secrets. A candidate's value is hashed, and the hashes are counted over the whole
corpus by distinct repositories and by distinct owners. A value that many owners hold, or that one owner has in many
repositories, is an example that was copied around (a tutorial's key); a value of few owners and repositories that looks
random is taken for a live credential.

Verdicts: ``example`` (at least ``min_owners`` owners or ``min_repos`` repositories), ``live`` (fewer of both, and
random-looking: ``min_entropy`` bits a character, letters and digits both, or a kind with a fixed prefix), ``weak`` (the rest).

Defined results: a null text counts as the empty text and has no findings; a long text is scanned whole, in the task that
reads it; a null owner or repository counts as one owner or repository of its own, null; repeated rows are scanned and
reported each, but count once as a repository; an empty table gives no rows; other columns, whatever their names, are
ignored by the scan and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmark.llm.common import few, materialise, name, record, slices, spread_join, table, whole

# The base kinds, in order, with the least length of what must be long enough.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS = 12
BASE_KINDS = ("assign", "access", "hex")
#: What the method adds: kinds whose prefix or frame names them. Name, text that any match holds, pattern.
ADDED = (
    ("forge", "gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    ("jwt", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("pem", "PRIVATE KEY-----", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,40}PRIVATE KEY-----")),
)
KINDS = (*BASE_KINDS, *(k for k, _, _ in ADDED))
#: Kinds that are live-looking whatever their entropy, for their form is that of issued credentials.
FORMED = ("access", "forge", "jwt", "pem")
WORDS = ("passw", "secret", "token", "api")

MIN_OWNERS, MIN_REPOS = 3, 10
#: A value in more repositories than this is joined by broadcast, if there are at most so many such values.
HOT_REPOS, MOST_HOT = 1_000, 200_000

FINDING = "array<struct<kind:string,start:int,stop:int,value_hash:string,random:boolean>>"
FINDING_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value_hash", pa.string()), ("random", pa.bool_())]))


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, stop, value) in order of start, then kind; leftmost and not overlapping within a kind."""
    found = []
    lower = text.lower() if text.isascii() else text.casefold()
    if any(w in lower for w in WORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    for kind, mark, pattern in ADDED:
        if mark in text:
            found += [(kind, m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def looks_random(kind: str, value: str, min_entropy: float) -> bool:
    if kind in FORMED:
        return True
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    return entropy >= min_entropy and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, min_entropy: float = 3.0) -> DataFrame:
    """doc_id, owner, repo, findings of each row; without repo_col each document is a repository of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [[{"kind": k, "start": a, "stop": b, "value_hash": hashlib.sha256(v.encode()).hexdigest(), "random": looks_random(k, v, min_entropy)} for k, a, b, v in find(x.as_py())] for x in part.column("text")]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "owner", "repo", "text_key")), pa.array(rows, FINDING_ARROW)], ["doc_id", "owner", "repo", "text_key", "findings"])

    docs = docs.select(F.col(name(id_col)).cast("long").alias("doc_id"), F.col(name(owner_col)).cast("string").alias("owner"), F.col(name(repo_col or id_col)).cast("string").alias("repo"), whole(name(text_col)).alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    return docs.mapInArrow(run, f"doc_id long, owner string, repo string, text_key long, findings {FINDING}")


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_repos, n_owners over the whole corpus.

    Rows are reduced within each map task to one for each hash, owner and repository, then to counts by hash and owner:
    a value that a third of the corpus holds is never gathered in one task.
    """
    each = found.select("owner", "repo", F.explode(F.array_distinct(F.col("findings.value_hash"))).alias("value_hash"))
    by_owner = each.distinct().groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("value_hash").agg(F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def judged(each: DataFrame, found: DataFrame, min_owners: int = MIN_OWNERS, min_repos: int = MIN_REPOS) -> DataFrame:
    """each (with value_hash, random) with n_repos, n_owners and verdict of the values over all of found.

    Values of many repositories, which would gather in one task, are few: they meet their counts by broadcast.
    """
    counts = materialise(ownership(found))
    hot = counts.filter(F.col("n_repos") > HOT_REPOS)
    if few(hot, MOST_HOT):
        hot = F.broadcast(hot)
        joined = each.join(hot, "value_hash").unionByName(each.join(hot.select("value_hash"), "value_hash", "left_anti").join(counts.filter(F.col("n_repos") <= HOT_REPOS), "value_hash"))
    else:
        joined = each.join(counts, "value_hash")
    return joined.withColumn("verdict", F.when((F.col("n_owners") >= min_owners) | (F.col("n_repos") >= min_repos), "example").when(F.col("random"), "live").otherwise("weak"))


def verdicts(found: DataFrame, min_owners: int = MIN_OWNERS, min_repos: int = MIN_REPOS) -> DataFrame:
    """doc_id, spans_key, kind, start, stop, value_hash, n_repos, n_owners, verdict: a row for each finding of each different (doc_id, findings)."""
    each = found.filter(F.size("findings") > 0).select("doc_id", spans_key().alias("spans_key"), "findings").distinct().select("doc_id", "spans_key", F.inline("findings"))
    return judged(each, found, min_owners, min_repos).select("doc_id", "spans_key", "kind", "start", "stop", "value_hash", "n_repos", "n_owners", "verdict")


def spans_key():
    return F.xxhash64("findings")


def per_document(found: DataFrame, min_owners: int = MIN_OWNERS, min_repos: int = MIN_REPOS) -> DataFrame:
    """found with n_live, n_example, max_owners and max_repos (of its values), a row for each row of found."""
    judged = verdicts(found, min_owners, min_repos).groupBy(F.col("doc_id").alias("id_"), F.col("spans_key").alias("key_")).agg(
        F.count_if(F.col("verdict") == "live").alias("n_live"), F.count_if(F.col("verdict") == "example").alias("n_example"), F.max("n_owners").alias("max_owners"), F.max("n_repos").alias("max_repos"))
    none = found.filter(F.size("findings") == 0).select("*", *(F.lit(0).cast("long").alias(c) for c in ("n_live", "n_example", "max_owners", "max_repos")))
    some = found.filter(F.size("findings") > 0).join(judged, F.col("doc_id").eqNullSafe(F.col("id_")) & (spans_key() == F.col("key_"))).drop("id_", "key_")
    return none.unionByName(some)


#: Holds in every text with a finding; spares the others the way through Python and through the shuffle.
SUSPECT = r"[0-9a-f]{16}|AKIA[A-Z0-9]{14}|[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk]|gh[pousr]_|eyJ|PRIVATE KEY"


def mask_values(text: str, hashes: set[str], mask: str) -> str:
    """The text with mask for every finding whose value's hash is among hashes; findings that overlap share one mask."""
    out, done = [], 0
    for _, start, stop, value in find(text):
        if hashlib.sha256(value.encode()).hexdigest() in hashes and stop > done:
            if start >= done:
                out += [text[done:start], mask]
            done = stop
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", min_owners: int = MIN_OWNERS, min_repos: int = MIN_REPOS, mask: str = "[SECRET]") -> DataFrame:
    """docs with every live-looking secret in text_col replaced by mask; other rows and columns as they were. What is live is told text by
    text, so rows without an id, or with one id, do not meet; a text that very many rows have meets its findings by broadcast."""
    text = F.col(name(text_col))
    suspect = F.coalesce(text.rlike(SUSPECT), F.lit(False))
    found = materialise(candidates(docs.filter(suspect), id_col, text_col, owner_col))
    texts = materialise(found.groupBy("text_key").agg(F.first("findings").alias("findings"), F.count(F.lit(1)).alias("n")))  # equal texts have equal findings
    live = judged(texts.select("text_key", F.inline("findings")), found, min_owners, min_repos).filter("verdict = 'live'").groupBy("text_key").agg(F.collect_set("value_hash").alias("live"))  # of one text
    texts = texts.select("text_key", "n").join(live, "text_key", "left")

    @F.pandas_udf("string")
    def masked(texts: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([t if h is None else mask_values(t, set(h), mask) for t, h in zip(texts, hashes, strict=True)], dtype=object)

    rows = record(docs.filter(suspect), text_key=F.xxhash64(whole(name(text_col))))
    known = spread_join(rows, texts, "text_key", "n")
    columns = [masked(F.col(f"record.{name(c)}"), "live").alias(c) if c == text_col else F.col(f"record.{name(c)}").alias(c) for c in docs.columns]
    return docs.filter(~suspect).unionByName(known.select(*columns))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = per_document(materialise(candidates(table(spark, sf_dir, "documents"))))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"),
        "n_live", "n_example", "max_owners", "max_repos",
    )
