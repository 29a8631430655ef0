"""Quality classifier: a byte-level convolutional network in numpy (operator 5).

A text's UTF-8 bytes are embedded, beside a channel that says where the last four bytes stood shortly before as well
(stuttering, which no filter over single windows could see), and learned filters slide over the whole document: windows of ``WIDTH`` bytes every
``STRIDE``, so that neighbours overlap. The windows are gathered in overlapping chunks of about a kilobyte; each filter is
max-pooled over a chunk, a chunk's pooled values give its logit, and the logits' mean, weighted by length, gives the
document's one probability. Embedding, filters and weights are learned by Adam on the gradients at the pooled windows.

The model is fitted on a bounded sample of labelled rows: at most ``most_rows`` of them, those of smallest hash, with at
most ``most_chars`` characters each. It has some thousand parameters and goes to the executors by value; scoring is a map.

Defined results: a null text counts as the empty text; the empty text is a window of zero bytes, as a text shorter than a
window is padded with them, and the network scores it like any other; a long text is scored whole, in blocks of chunks;
repeated rows get equal scores; rows with a null label are not learned from; with no labelled rows, or labels of one class
only, every text scores the share of label 1 (0.5 without rows); an empty table gives no rows; other columns, whatever their
names, are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callmark.llm.common import name, slices, table, whole

WIDTH, STRIDE, DEPTH, FILTERS = 12, 4, 8, 24
#: Values of a byte's place: its embedding and the channel of repeats, which looks back so many bytes.
CHANNELS, LOOK_BACK = DEPTH + 1, 24
#: Windows that a chunk holds, and from one chunk's start to the next.
CHUNK, STEP = 256, 240
#: Chunks that are convolved at one time, so that a long text needs no more memory than a short one.
BLOCK = 64


@dataclass
class Model:
    embedding: np.ndarray  # 256 x DEPTH
    filters: np.ndarray  # WIDTH * CHANNELS x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # FILTERS
    offset: float
    constant: float | None = None

    def windows(self, data: np.ndarray) -> np.ndarray:
        """A row of embedded bytes for each window."""
        slide = np.lib.stride_tricks.sliding_window_view
        view = slide(data, WIDTH)[::STRIDE]
        out = np.empty((len(view), WIDTH, CHANNELS), np.float32)
        out[:, :, :DEPTH] = self.embedding[view]
        out[:, :, DEPTH] = slide(repeats(data), WIDTH)[::STRIDE]
        return out.reshape(len(view), WIDTH * CHANNELS)

    def logits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's logit and number of windows."""
        n = n_windows(len(data))
        data = padded(data)
        starts = np.arange(0, max(1, n - (CHUNK - STEP)), STEP)
        out, sizes = [], []
        for at in range(0, len(starts), BLOCK):
            first, last = starts[at], min(n, starts[min(at + BLOCK, len(starts)) - 1] + CHUNK)
            conv = self.windows(data[first * STRIDE : (last - 1) * STRIDE + WIDTH]) @ self.filters
            own = starts[at : at + BLOCK] - first
            stops = np.minimum(own + CHUNK, last - first)
            pairs = np.stack([own, stops], 1).ravel()
            pooled = np.maximum.reduceat(conv, pairs[:-1] if pairs[-1] == len(conv) else pairs, axis=0)[::2]
            out.append(np.maximum(pooled + self.bias, 0) @ self.weights + self.offset)
            sizes.append(stops - own)
        return np.concatenate(out), np.concatenate(sizes)

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        logits, sizes = self.logits(np.frombuffer(text.encode(), np.uint8))
        return float(1 / (1 + np.exp(-np.clip((logits * sizes).sum() / sizes.sum(), -30, 30))))


def repeats(data: np.ndarray) -> np.ndarray:
    """Which bytes end four that also ended 2 to LOOK_BACK bytes before."""
    wide = data.astype(np.uint32)
    grams = wide.copy()
    grams[3:] |= wide[2:-1] << 8 | wide[1:-2] << 16 | wide[:-3] << 24
    found = np.zeros(len(data), bool)
    if len(data) < 4:
        return found
    for lag in range(2, min(LOOK_BACK, len(data) - 4) + 1):
        found[lag:] |= grams[lag:] == grams[:-lag]
    found[:3] = False
    return found


def n_windows(n_bytes: int) -> int:
    return max(1, -(-(n_bytes - WIDTH) // STRIDE) + 1)


def padded(data: np.ndarray) -> np.ndarray:
    return np.pad(data, (0, (n_windows(len(data)) - 1) * STRIDE + WIDTH - len(data)))


def train(texts: list[str], labels: list[int], epochs: int = 5, rate: float = 0.01, batch: int = 16, seed: int = 5) -> Model:
    """The same rows in the same order give the same model."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32), rng.normal(0, 0.15, (WIDTH * CHANNELS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, FILTERS).astype(np.float32), 0.0)
    rows = [(padded(np.frombuffer(t.encode(), np.uint8)), y) for t, y in zip(texts, labels, strict=True)]
    if len({y for _, y in rows}) < 2:
        model.constant = float(np.mean([y for _, y in rows])) if rows else 0.5
        return model
    names = ("embedding", "filters", "bias", "weights", "offset")
    first = {k: np.zeros_like(getattr(model, k), np.float32) for k in names}
    second = {k: np.zeros_like(getattr(model, k), np.float32) for k in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            grads = {k: np.zeros_like(getattr(model, k), np.float32) for k in names}
            for i in order[at : at + batch]:
                _gradient(model, *rows[i], grads, len(order[at : at + batch]))
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                value = getattr(model, k) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(model, k, float(value) if k == "offset" else value.astype(np.float32))
    return model


def _gradient(model: Model, data: np.ndarray, label: int, grads: dict[str, np.ndarray], rows: int) -> None:
    """Adds the gradient of one document's cross entropy; it flows only through the windows that won the pooling."""
    view = np.lib.stride_tricks.sliding_window_view(data, WIDTH)[::STRIDE]
    embedded = model.windows(data)
    conv = embedded @ model.filters
    starts = np.arange(0, max(1, len(view) - (CHUNK - STEP)), STEP)
    best = np.stack([s + conv[s : s + CHUNK].argmax(0) for s in starts])  # chunk x filter
    pre = np.take_along_axis(conv, best, 0) + model.bias
    hidden = np.maximum(pre, 0)
    share = np.minimum(CHUNK, len(view) - starts).astype(np.float32)
    share /= share.sum()
    logit = float(share @ (hidden @ model.weights + model.offset))
    error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label) / rows
    grads["offset"] += np.float32(error)
    grads["weights"] += error * (share @ hidden)
    back = error * share[:, None] * model.weights * (pre > 0)
    grads["bias"] += back.sum(0)
    won = embedded[best]  # chunk x filter x WIDTH * CHANNELS
    grads["filters"] += np.einsum("cf,cfk->kf", back, won)
    to_bytes = (back[:, :, None] * model.filters.T).reshape(-1, CHANNELS)[:, :DEPTH]
    np.add.at(grads["embedding"], view[best].ravel(), to_bytes)


def is_held_out(id_col: str | Column, folds: int = 5) -> Column:
    own = F.col(name(id_col)) if isinstance(id_col, str) else id_col
    return F.crc32(own.cast("string")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 2_000, most_chars: int = 32_768) -> Model:
    """A model of the labelled rows outside the held-out fold; most_rows and most_chars bound what reaches the driver."""
    own, label, text = F.col(name(id_col)), F.col(name(label_col)).cast("int"), whole(name(text_col))
    chosen = labels.filter(label.isNotNull() & ~is_held_out(id_col)).select(own.alias("id_"), label.alias("label_")).distinct().orderBy(F.xxhash64("id_"), "id_", "label_").limit(most_rows)
    rows = docs.filter(F.char_length(text) <= most_chars).select(own.alias("id_"), text.alias("text_")).join(F.broadcast(chosen), "id_")
    rows = rows.orderBy(F.xxhash64("id_"), "id_", "text_", "label_").limit(most_rows).collect()
    return train([r["text_"] for r in rows], [r["label_"] for r in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: the probability of label 1, a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([model.score(x.as_py()) for x in part.column("text")], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(name(id_col)).cast("long").alias("doc_id"), whole(name(text_col)).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs without the rows that score under least."""

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: model.score(x or "") >= least).astype(bool)

    return docs.filter(good(whole(name(text_col))))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(is_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
