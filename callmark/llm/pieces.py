"""SentencePiece BPE over whole texts in vectorised merge rounds (operator 11).

A text is normalised as the model file asks (spaces become U+2581, one more in front) and cut wherever two neighbouring
characters stand side by side in no piece of the vocabulary: no merge can reach over such a place, so what lies between,
a word, is encoded on its own, and equal words once. All new words of a slice of rows are one flat numpy array of symbols.
In each round every word's best pair is found by a segmented minimum of ranks, all its occurrences in the word are merged at
the same time, the leftmost first where they overlap, and the array is compacted; words without a pair leave it. A piece from
which a better pair could arise is merged at the leftmost place of a word only, so that the rounds keep the order in which the
library takes pairs. Words of over LONG_WORD symbols (runs of spaces, say) would need too many rounds; they take the same
merges from a heap. Characters outside the vocabulary become bytes.

Only what BPE models with byte fallback need is here: a model of another kind, with a character map, user-defined or unused
pieces is refused. Defined results: a null text counts as the empty text; an empty text has no ids but begin and end, and decodes to
the empty text; repeated rows and rows without doc_id each get their own result row; an empty table gives no rows; other columns,
whatever their names, are ignored. Rows never leave the task that reads them.
"""

from __future__ import annotations

import codecs
import heapq
import struct
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmark.llm.common import name, slices, table, whole

# What a model file says by number.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
SPACE, UNKNOWN_TEXT = "▁", " ⁇ "
#: Words remembered by a Python worker, and the longest that is remembered.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48
#: Symbols of the longest word that is merged in rounds.
LONG_WORD = 2_048
#: Characters of texts that are one slice, unless one text has more.
SLICE_CHARS = 1 << 20
NONE = np.int32(2**31 - 1)


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 2: None, 5: 4}[key & 7] or varint()
            yield key >> 3, message[at : at + size]
            at += size


class Vocabulary:
    """A model file's pieces as arrays."""

    def __init__(self, model: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number in (2, 3):
                (trainer if number == 2 else normalizer).update(_fields(value))
        plain = trainer.get(3) == BPE and trainer.get(35) and not trainer.get(24) and not normalizer.get(2) and normalizer.get(4, 1) == 0 and normalizer.get(5, 1)
        if not plain or {kind for _, _, kind in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback, without a character map, user-defined or unused pieces")
        self.prefix = bool(normalizer.get(3, 1))
        place = {text: i for i, (text, _, _) in enumerate(pieces)}
        self.begin, self.end = (place[trainer.get(n, b"").decode() or text] for n, text in ((46, "<s>"), (47, "</s>")))
        self.byte_ids = np.array([place[f"<0x{b:02X}>"] for b in range(256)], np.uint32)
        ranks = {s: r for r, s in enumerate(sorted({s for _, s, kind in pieces if kind == NORMAL}, reverse=True))}
        rank = {text: ranks[score] for text, score, kind in pieces if kind == NORMAL}
        # symbols: pieces by id, then characters that are only parts of pieces
        letters = sorted({c for text in rank for c in text})
        symbol = {text: place[text] for text in rank}
        for c in letters:
            symbol.setdefault(c, len(pieces) + len(symbol))
        self.n_pieces, self.n_symbols = len(pieces), len(pieces) + len(symbol) + len(letters)
        self.of_char = np.full(0x110000, -1, np.int32)
        self.of_char[[ord(c) for c in letters]] = [symbol[c] for c in letters]
        # characters by number from 1, and which pairs of them stand side by side in a piece
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.inside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        pairs, early = {}, set()
        for text, r in rank.items():
            codes = self.number[[ord(c) for c in text]]
            self.inside[codes[:-1], codes[1:]] = True
            for cut in range(1, len(text)):
                parts = text[:cut], text[cut:]
                if all(p in symbol for p in parts):
                    pairs[symbol[parts[0]] * self.n_symbols + symbol[parts[1]]] = (r, symbol[text])
                    early.update(rank[p] for p in parts if len(p) > 1 and r <= rank[p])
        order = sorted(pairs)
        self.keys = np.array(order + [2**62], np.int64)
        self.rank = np.array([pairs[k][0] for k in order] + [NONE], np.int32)
        self.made = np.array([pairs[k][1] for k in order] + [-1], np.int32)
        #: Ranks at which a merge may bring about a pair that comes before others of its own rank.
        self.alone = np.zeros(len(ranks) + 1, bool)
        self.alone[sorted(early)] = True
        self.texts = [b"" if kind == CONTROL else UNKNOWN_TEXT.encode() if kind == UNKNOWN else bytes([int(text[3:5], 16)]) if kind == BYTE else text.replace(SPACE, " ").encode() for text, _, kind in pieces]
        self.control = {i for i, (_, _, kind) in enumerate(pieces) if kind == CONTROL}
        self.spaced = {i for i, (text, _, kind) in enumerate(pieces) if kind == NORMAL and text.startswith(SPACE)}
        self.cache: dict[str, bytes] = {}

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The places of these pairs in the tables; the last place where there is none."""
        key = left.astype(np.int64) * self.n_symbols + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def words(self, text: str, ends: Sequence[int] = ()) -> list[int]:
        """Where the words of a normalised text begin, and its end; ends are places where one surely begins."""
        codes = self.number[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = ~self.inside[codes[:-1], codes[1:]]
        cut[list(ends)] = True
        return np.flatnonzero(cut).tolist()

    def normalised(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Each text's ids, without begin and end, as little-endian unsigned 32-bit integers."""
        normal = [self.normalised(t) for t in texts]
        text = "".join(normal)
        if not text:
            return [b""] * len(texts)
        ends = np.cumsum([0, *map(len, normal)])
        starts = self.words(text, ends)
        found = [text[a:b] for a, b in zip(starts, starts[1:])]
        ids = list(map(self.cache.get, found))
        unknown = [i for i, known in enumerate(ids) if known is None]
        if unknown:
            new = list({found[i] for i in unknown})
            if len(self.cache) + len(new) > CACHE_ENTRIES:
                self.cache.clear()
            merged = dict(zip(new, self.merged(new), strict=True))
            for i in unknown:
                ids[i] = merged[found[i]]
            self.cache.update((w, x) for w, x in merged.items() if len(w) <= CACHE_CHARS)
        bounds = np.searchsorted(starts, ends).tolist()
        return [b"".join(ids[a:b]) for a, b in zip(bounds, bounds[1:])]

    def merged(self, words: list[str]) -> list[bytes]:
        """Ids of words that no merge reaches beyond."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        starts = np.cumsum(sizes) - sizes
        at, symbol = np.arange(len(codes)), self.of_char[codes]
        word = np.repeat(np.arange(len(words)), sizes)
        out = []
        for w in np.flatnonzero(sizes > LONG_WORD):
            mine = slice(starts[w], starts[w] + sizes[w])
            kept, merged = self.by_heap(symbol[mine])
            out.append((at[mine][kept], merged))
        short = sizes[word] <= LONG_WORD
        out += self.rounds(at[short], symbol[short], word[short])
        at, symbol = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(at, kind="stable")
        at, symbol = at[order], symbol[order]
        # a symbol that is no piece is one character, and becomes its bytes
        none = (symbol < 0) | (symbol >= self.n_pieces)
        c = codes[at].astype(np.int64)
        n_bytes = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n_bytes]
        bytes_ = np.stack([np.where(n_bytes > k, np.where(k == 0, lead, 0x80) | (c >> 6 * np.maximum(n_bytes - 1 - k, 0)) & np.where((k == 0) & (n_bytes > 1), 0x3F, np.where(n_bytes == 1, 0x7F, 0x3F)), 0) for k in range(4)], 1)
        ids = np.where(none[:, None], self.byte_ids[bytes_], 0).astype("<u4")
        ids[~none, 0] = symbol[~none]
        counts = np.where(none, n_bytes, 1)
        flat = ids[np.arange(4) < counts[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(counts) * 4])[np.searchsorted(at, np.append(starts, len(codes)))].tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def rounds(self, at: np.ndarray, symbol: np.ndarray, word: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(place, symbol) of all words, in parts: merges each word's best pairs until none is left."""
        out, last = [], len(self.keys) - 1
        pair = np.full(len(at), last)
        if len(at):
            same = np.flatnonzero(word[1:] == word[:-1])
            pair[same] = self.pair(symbol[same], symbol[same + 1])
        while len(at):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            rank = self.rank[pair]
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(at))))
            done = least == NONE
            if done.any():
                out.append((at[done], symbol[done]))
                at, symbol, word, pair, rank, least = (x[~done] for x in (at, symbol, word, pair, rank, least))
                if not len(at):
                    break
            hit = np.flatnonzero(rank == least)
            run = np.concatenate([[True], np.diff(hit) > 1])
            take = (hit - np.repeat(hit[run], np.diff(np.append(np.flatnonzero(run), len(hit))))) % 2 == 0
            leftmost = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])
            hit = hit[take & (leftmost | ~self.alone[rank[hit]])]
            symbol[hit] = self.made[pair[hit]]
            keep = np.ones(len(at), bool)
            keep[hit + 1] = False
            now = (np.cumsum(keep) - 1)[hit]
            at, symbol, word, pair = at[keep], symbol[keep], word[keep], pair[keep]
            touched = np.zeros(len(at) + 1, bool)
            touched[now] = touched[now - 1] = True  # the place before the first is the one after the last
            left = np.flatnonzero(touched[:-1])
            pair[left] = last
            left = left[left + 1 < len(at)]
            left = left[word[left] == word[left + 1]]
            pair[left] = self.pair(symbol[left], symbol[left + 1])
        return out

    def by_heap(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and symbols of one long word after the same merges, by a heap of pairs over a linked list."""
        symbol, n, last = symbols.tolist(), len(symbols), len(self.keys) - 1
        table = dict(zip(self.keys[:-1].tolist(), zip(self.rank.tolist(), self.made.tolist())))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[p], i, symbol[i], symbol[i + 1]) for i, p in enumerate(self.pair(symbols[:-1], symbols[1:]).tolist()) if p != last]
        heapq.heapify(heap)
        gone = np.zeros(n, bool)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or symbol[i] != a or symbol[j] != b:
                continue  # one of the two has changed since
            symbol[i] = table[a * self.n_symbols + b][1]
            gone[j] = True
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and symbol[x] >= 0 and symbol[y] >= 0 and (found := table.get(symbol[x] * self.n_symbols + symbol[y])):
                    heapq.heappush(heap, (found[0], x, symbol[x], symbol[y]))
        kept = np.flatnonzero(~gone)
        return kept, np.array(symbol, np.int32)[kept]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, one by one."""
        numbers = ids.tolist()
        runs = (list(run) for control, run in groupby(numbers, self.control.__contains__) if not control) if self.control.intersection(numbers[1:-1]) else [numbers]
        text = "".join(b"".join(map(self.texts.__getitem__, run)).decode("utf-8", "callmark_each_byte") for run in runs)  # no character goes over a control piece
        shown = next((i for i in numbers if i not in self.control), None)
        return text[1:] if self.prefix and shown in self.spaced else text


codecs.register_error("callmark_each_byte", lambda e: ("�" * (e.end - e.start), e.end))
_VOCABULARIES: dict[int, Vocabulary] = {}


def _vocabulary(model: Broadcast) -> Vocabulary:
    """One per Python worker."""
    key = hash(model.value)
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabulary(model.value)
    return _VOCABULARIES[key]


def load_model(spark: SparkSession, model_path: str) -> Broadcast:
    """The model file, at most some megabytes by its nature, for all executors."""
    with open(model_path, "rb") as f:
        model = f.read()
    Vocabulary(model)  # a model that is refused fails here
    return spark.sparkContext.broadcast(model)


def _portions(texts: list[str]) -> Iterator[list[str]]:
    """The texts in portions of about SLICE_CHARS characters."""
    portion, size = [], 0
    for text in texts:
        if portion and size + len(text) > SLICE_CHARS:
            yield portion
            portion, size = [], 0
        portion.append(text)
        size += len(text)
    yield portion


def encode(docs: DataFrame, model: Broadcast, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers), a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model)
        head, tail = (np.array([i], "<u4").tobytes() if wanted else b"" for i, wanted in ((vocabulary.begin, begin), (vocabulary.end, end)))
        for part in slices(batches):
            ids = [head + x + tail for portion in _portions(part.column("text").to_pylist()) for x in vocabulary.encode(portion)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(name(id_col)).cast("long").alias("doc_id"), whole(name(text_col)).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model: Broadcast, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, text. An id outside the vocabulary is an error; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model)
        for part in slices(batches):
            texts = [vocabulary.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in part.column("ids")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select(F.col(name(id_col)).cast("long").alias("doc_id"), F.col(name(ids_col)).alias("ids")).mapInArrow(run, "doc_id long, ids binary, text string")


def digests(docs: DataFrame, model: Broadcast) -> DataFrame:
    both = decode(encode(docs, model), model)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), load_model(spark, public_tokenizers.path("piece_bpe_32k.model")))
