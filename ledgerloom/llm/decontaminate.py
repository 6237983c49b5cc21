"""Benchmark decontamination by latent semantic retrieval, checked by longest common subsequences and answers.

1. Texts become sequences of the benchmark's words (any other word is one and the same filler): words outside
   the benchmark can't match an item. Document frequencies are counted over all documents.
2. A passage is two neighbouring blocks of BLOCK words, one passage for each block. TF-IDF passages of the benchmark
   and of all documents give, by a distributed randomised SVD, RANK latent directions.
3. Every passage of every document is searched against all items' passages by cosine; pairs of at least MIN_COSINE
   are candidates. Of those, the words around the passage have to hold the item's words in order (longest common
   subsequence) and its answer.

Texts are tokenised once. Vocabulary, counts and directions are those of the whole benchmark, however many items there are: a
benchmark of more than ``max_items`` is searched in several passes over the stored words, with the same results.
"""

from __future__ import annotations

import functools
import re
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, stored

BLOCK = 24
RANK = 128
OVERSAMPLE = 16
MIN_COSINE = 0.5
#: Share of an item's words that have to be there in order, and of its last ANSWER words.
MIN_SHARE = 0.7
ANSWER = 5
MIN_ANSWER = 0.6
#: With this share of the item the answer may be missing.
NEARLY_ALL = 0.9
#: Items of fewer words than the first can't be told from chance inside a sentence: a line has to consist of them. Below the second
#: all words have to be there in a row.
LEAST_WORDS = 5
SHORT_WORDS = 8
#: In the fit, all benchmark passages together weigh this much more than all the documents': directions have to tell items apart.
BENCH_WEIGHT = 2.4
#: Items of one search pass: bounds what is sent to a task besides the vocabulary's directions. And passages of items compared at once.
MAX_ITEMS = 20_000
QUERY_BLOCK = 2048
#: Words projected at once.
CHUNK_WORDS = 1 << 14
#: Blocks of one product in the fit, of one look-up there, and how many of the commonest words go through a dense matrix: a column costs
#: less than its places.
FIT_BLOCKS = 2048
SUM_BLOCKS = 64
DENSE_WORDS = 256

#: Characters beyond ASCII that are told apart at once.
CHARS = 1 << 20

_WORD = re.compile(r"[^\W_]+")
_ASCII = {c: chr(c).lower() if chr(c).isalnum() else " " for c in range(128)}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@functools.lru_cache(maxsize=1)
def _alphanumeric() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def spaced_words(text: str | None) -> str:
    """The words of ``words_of`` with blanks between, before and after them."""
    if not text or text.isascii():
        return (text or "").translate(_ASCII)
    text, known = text.lower(), _alphanumeric()
    out = []
    for at in range(0, len(text), CHARS):
        chars = np.frombuffer(text[at : at + CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        out.append(np.where(known[chars], chars, np.uint32(32)).tobytes().decode("utf-32-le"))
    return "".join(out)


def word_numbers(texts: pa.Array, vocabulary: pa.Array) -> pa.Array:
    """The words of each text as 32-bit numbers: their places in the vocabulary, its length for all others."""
    lists = pc.ascii_split_whitespace(pa.array(map(spaced_words, texts.to_pylist()), pa.string(), size=len(texts)))
    words, ends = lists.flatten(), lists.offsets.to_numpy()
    real = np.append(0, np.cumsum(pc.binary_length(words).to_numpy() > 0, dtype=np.int32))  # before, between and after blanks are empty ones
    numbers = pc.fill_null(pc.index_in(words, value_set=vocabulary), len(vocabulary)).to_numpy()[np.diff(real) > 0]
    offsets = (real[ends - ends[0]] * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(numbers.astype(np.uint32))])


def blocks_of(ids: np.ndarray, filler: int) -> np.ndarray:
    n = max(1, -(-len(ids) // BLOCK))
    out = np.full(n * BLOCK, filler, np.int64)
    out[: len(ids)] = ids
    return out.reshape(n, BLOCK)


def passages_of(blocks: np.ndarray, filler: int) -> np.ndarray:
    """Each block with the next one (the last one, if it is not the only one, is in the passage before)."""
    if len(blocks) == 1:
        return np.concatenate([blocks, np.full_like(blocks, filler)], axis=1)
    return np.concatenate([blocks[:-1], blocks[1:]], axis=1)


def common_subsequence(a: list[int], positions: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence, bit-parallel; ``positions``: bit mask of each word of the other side (n words)."""
    row, full = (1 << n) - 1, (1 << n) - 1
    for x in a:
        m = positions.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def bit_masks(ids: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(ids):
        out[x] = out.get(x, 0) | 1 << i
    return out


@dataclass
class Bench:
    """Items: their words (numbers below ``size``, that of the vocabulary) and passages; of tiny ones, the words themselves."""

    ids: list[int]
    words: list[list[int]]
    size: int
    tiny: dict[tuple[str, ...], list[int]]

    def __post_init__(self) -> None:
        self.masks = [bit_masks(w) for w in self.words]
        self.answers = [(bit_masks(w[-ANSWER:]), len(w[-ANSWER:])) for w in self.words]
        parts = [passages_of(blocks_of(np.array(w, np.int64), self.size), self.size) for w in self.words]
        self.passages = np.concatenate([np.zeros((0, 2 * BLOCK), np.int64), *parts])
        self.owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        pairs = [i * (self.size + 1) + np.unique(np.array(w, np.int64)) for i, w in enumerate(self.words)]
        self.item_words = np.concatenate([np.zeros(0, np.int64), *pairs])  # sorted (item, word) numbers

    def part(self, first: int, last: int) -> Bench:
        return Bench(self.ids[first:last], self.words[first:last], self.size, self.tiny if not first else {})

    def shared(self, item: np.ndarray, around: np.ndarray) -> np.ndarray:
        """How many of the words around are the item's, for each row."""
        keys = item[:, None] * (self.size + 1) + around
        at = np.minimum(np.searchsorted(self.item_words, keys), len(self.item_words) - 1)
        return (self.item_words[at] == keys).sum(axis=1)

    def confirm(self, item: int, region: list[int]) -> float | None:
        """The share of the item's words that the region has in order, if that is a leak."""
        n = len(self.words[item])
        if n < SHORT_WORDS:
            w = self.words[item]
            return 1.0 if any(region[i : i + n] == w for i in range(len(region) - n + 1)) else None
        share = common_subsequence(region, self.masks[item], n) / n
        if share < MIN_SHARE:
            return None
        masks, size = self.answers[item]
        if share < NEARLY_ALL and common_subsequence(region, masks, size) / size < MIN_ANSWER:
            return None
        return share


def load_bench(benchmark: DataFrame) -> tuple[Bench, dict[str, int]] | None:
    """All items, and the vocabulary. The benchmark is the query set: it is read by the driver as a whole."""
    rows = sorted((r["item_id"], r["text"]) for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().collect())
    items = [(i, w) for i, t in rows if (w := words_of(t))]
    if not items:
        return None
    tiny: dict[tuple[str, ...], list[int]] = {}
    for i, w in items:
        if len(w) < LEAST_WORDS:
            tiny.setdefault(tuple(w), []).append(i)
    large = [(i, w) for i, w in items if len(w) >= LEAST_WORDS]
    vocabulary = {w: k for k, w in enumerate(sorted({x for _, ws in large for x in ws}))}
    return Bench([i for i, _ in large], [[vocabulary[x] for x in ws] for _, ws in large], len(vocabulary), tiny), vocabulary


def words_column(vocabulary: dict[str, int]) -> Callable[[Column], Column]:
    """The text's words as numbers in the benchmark's vocabulary (its size for all others), 32 bits each."""
    known = pa.array(sorted(vocabulary, key=vocabulary.__getitem__), pa.string())

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        return word_numbers(texts, known)

    return encode


def tiny_column(tiny: dict[tuple[str, ...], list[int]]) -> Callable[[Column], Column]:
    """Ids of the tiny items that a line of the text consists of."""
    longest = max(map(len, tiny), default=0)

    @F.pandas_udf("array<bigint>")
    def lines(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found: set[int] = set()
            for line in (text or "").splitlines():
                words = words_of(line)
                if len(words) <= longest:
                    found.update(tiny.get(tuple(words), ()))
            out.append(sorted(found))
        return pd.Series(out, dtype=object)

    return lines if tiny else lambda text: F.array().cast("array<bigint>")


def encode(docs: DataFrame, bench: Bench, vocabulary: dict[str, int]) -> DataFrame:
    """``doc_id, words, tiny``."""
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), words_column(vocabulary)(docs["text"]).alias("words"), tiny_column(bench.tiny)(docs["text"]).alias("tiny"))


def inverse_frequencies(encoded: DataFrame, bench: Bench) -> np.ndarray:
    """log((documents + 1) / (documents with the word + 1)); the filler's is 0. A row for each word reaches the driver."""
    size = bench.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                df[np.unique(np.frombuffer(raw, np.uint32))] += 1
                n += 1
        df[size] = n  # the filler's place has the number of documents
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(df[seen], pa.int64())], names=["word", "n"])

    df = np.zeros(size + 1)
    for row in map_batches(encoded.select("words"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        df[row["word"]] = row["n"]
    idf = np.log((df[size] + 1) / (df + 1))
    idf[size] = 0
    return idf


def runs_of(ids: np.ndarray, filler: int) -> Iterator[np.ndarray]:
    """Runs of at most FIT_BLOCKS + 1 blocks, each two neighbours of which are one of the text's passages; no passage is in two runs."""
    blocks = blocks_of(ids, filler)
    if len(blocks) == 1:
        blocks = np.concatenate([blocks, np.full_like(blocks, filler)])
    for at in range(0, len(blocks) - 1, FIT_BLOCKS):
        yield blocks[at : at + FIT_BLOCKS + 1]


def _starts(sorted_numbers: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_numbers[1:] != sorted_numbers[:-1]))


def _sums_by_word(words: np.ndarray, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words, and for each the sum of ``rows[at]`` over its places: all first places, then all second ones and so on."""
    order = np.argsort(words, kind="stable")
    words, at = words[order], at[order]
    starts = _starts(words)
    n = np.diff(np.append(starts, len(words)))
    sums, k, left = rows[at[starts]], 1, np.flatnonzero(n > 1)
    while len(left):
        sums[left] += rows[at[starts[left] + k]]
        k += 1
        left = left[n[left] > k]
    return words[starts], sums


class Gram:
    """(A^T A) omega of the TF-IDF matrix A of all passages that are added, its rows of length 1, without the filler's row.

    A block's words are looked up and added; back from the blocks to the words, the commonest go through a dense matrix of counts.
    """

    def __init__(self, idf: np.ndarray, omega: np.ndarray):
        self.size, self.idf = len(omega), idf
        self.table = (np.vstack([omega, np.zeros((1, omega.shape[1]))]) * idf[:, None]).astype(np.float32)
        self.dense = np.argsort(idf[:-1], kind="stable")[:DENSE_WORDS]
        self.rare = len(self.dense)
        self.place = np.full(self.size + 1, self.rare)
        self.place[self.dense] = np.arange(self.rare)
        self.place[self.size] = self.rare + 1
        self.dense_squares = (idf[self.dense] ** 2).astype(np.float32)
        self.total, self.passages = np.zeros(omega.shape), 0
        self.held: list[np.ndarray] = []
        self.blocks = 0

    def add(self, ids: np.ndarray) -> None:
        """A text's passages; those without a word of the benchmark count for nothing."""
        for run in runs_of(ids, self.size):
            self.held.append(run)
            self.blocks += len(run)
            if self.blocks >= FIT_BLOCKS:
                self._flush()

    def _flush(self) -> None:
        blocks = np.concatenate(self.held)
        n, ends = len(blocks), np.cumsum([len(r) for r in self.held]) - 1
        self.held, self.blocks = [], 0
        place = self.place[blocks]
        some = (place <= self.rare).any(axis=1)
        inside = some[:-1] | some[1:]
        inside[ends[:-1]] = False  # from one run to the next is no passage

        counts = np.zeros((n, self.rare), np.float32)
        common = place < self.rare
        np.add.at(counts.reshape(-1), np.nonzero(common)[0] * self.rare + place[common], np.float32(1))
        of, words = np.nonzero(place == self.rare)[0], blocks[place == self.rare]

        sums = np.concatenate([self.table[blocks[at : at + SUM_BLOCKS]].sum(axis=1) for at in range(0, n, SUM_BLOCKS)])
        both = counts[:-1] + counts[1:]
        squares = ((both * both) @ self.dense_squares).astype(np.float64)
        keys = np.sort(np.concatenate([of[of < n - 1] * self.size + words[of < n - 1], (of[of > 0] - 1) * self.size + words[of > 0]]))
        if len(keys):
            at = _starts(keys)
            passage, word = np.divmod(keys[at], self.size)
            squares += np.bincount(passage, (np.diff(np.append(at, len(keys))) * self.idf[word]) ** 2, n - 1)

        y = (sums[:-1] + sums[1:]) * (inside / np.maximum(squares, 1e-18)).astype(np.float32)[:, None]
        back = np.zeros_like(sums)
        back[:-1] += y
        back[1:] += y
        self.total[self.dense] += counts.T @ back
        if len(of):
            word, sums = _sums_by_word(words, back, of)
            self.total[word] += sums
        self.passages += int(inside.sum())

    def product(self) -> np.ndarray:
        if self.held:
            self._flush()
        return self.total * self.idf[:-1, None]


def latent_directions(encoded: DataFrame, bench: Bench, idf: np.ndarray, seed: int = 3) -> np.ndarray:
    """Words x RANK, from ``encoded`` with a column ``words``: right singular vectors of the weighted TF-IDF passages, by a randomised range finder.

    Two distributed passes over all documents: A^T A omega for a random omega, then the same for its orthonormal basis.
    A task sends its sum in rows of one word each, which combine before they reach the driver.
    """
    size, rank = bench.size, min(RANK, bench.size)
    width = min(bench.size, rank + OVERSAMPLE)

    def gram(omega: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = Gram(idf, omega)
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    g.add(np.frombuffer(raw, np.uint32).astype(np.int64))
            total = g.product()
            rows = np.flatnonzero(total.any(axis=1))
            values = np.append(total[rows], np.full((1, width), float(g.passages)), axis=0)  # the last row: the number of passages
            flat = pa.array(values.astype(np.float32).ravel(), pa.float32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * width, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(rows, -1), pa.int64()), lists], names=["word", "v"])

        own = Gram(idf, omega)
        for words in bench.words:
            own.add(np.array(words, np.int64))
        sums = map_batches(encoded.select("words"), run, "word long, v array<float>").groupBy("word").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(omega.shape[1])])
        total, n_seen = np.zeros_like(omega), 0.0
        for row in sums.collect():
            if row[0] < 0:
                n_seen = row[1]
            else:
                total[row[0]] = row[1:]
        return BENCH_WEIGHT * own.product() / len(bench.passages) + total / max(1.0, n_seen)

    basis, _ = np.linalg.qr(gram(np.random.default_rng(seed).standard_normal((size, width))))
    small = basis.T @ gram(basis)
    _, u = np.linalg.eigh((small + small.T) / 2)
    return basis @ u[:, ::-1][:, :rank]


class Search:
    """The items' index: finds them in a document's words."""

    def __init__(self, bench: Bench, idf: np.ndarray, directions: np.ndarray):
        self.bench = bench
        self.table = np.vstack([directions, np.zeros((1, directions.shape[1]))]).astype(np.float32) * idf[:, None].astype(np.float32)
        self.query = self._unit(self.table[bench.passages].sum(axis=1)).T.copy()
        # words of an item that a passage over its middle holds at least, if the item is there in that share
        self.least = np.array([MIN_SHARE * 0.75 * min(len(set(w)), BLOCK) if len(w) >= SHORT_WORDS else 1 for w in bench.words])

    @staticmethod
    def _unit(z: np.ndarray) -> np.ndarray:
        return z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-9)

    def hits(self, ids: np.ndarray) -> dict[int, float]:
        """Number of each leaked item, and the largest share of it found."""
        bench, n_items = self.bench, len(self.bench.words)
        blocks = blocks_of(ids, bench.size)
        step = CHUNK_WORDS // BLOCK
        sums = np.concatenate([self.table[blocks[i : i + step]].sum(axis=1) for i in range(0, len(blocks), step)])
        z = sums if len(sums) == 1 else sums[:-1] + sums[1:]
        found: dict[int, float] = {}
        if not n_items or not (ids < bench.size).any():
            return found
        for at in range(0, len(z), 512):
            unit = self._unit(z[at : at + 512])
            near = [np.nonzero(unit @ self.query[:, q : q + QUERY_BLOCK] >= MIN_COSINE) for q in range(0, self.query.shape[1], QUERY_BLOCK)]
            p = np.concatenate([x[0] for x in near])
            q = np.concatenate([x[1] + k * QUERY_BLOCK for k, x in enumerate(near)])
            if not len(p):
                continue
            p, item = np.divmod(np.unique((p + at) * n_items + bench.owner[q]), n_items)
            around = np.concatenate([blocks[p], blocks[np.minimum(p + 1, len(blocks) - 1)]], axis=1)
            enough = bench.shared(item, around) >= self.least[item]
            for i, k in zip(p[enough].tolist(), item[enough].tolist(), strict=True):
                n = len(bench.words[k])
                share = bench.confirm(k, ids[max(0, i * BLOCK - n) : (i + 2) * BLOCK + n].tolist())
                if share is not None and share > found.get(k, 0.0):
                    found[k] = share
        return found


def search(encoded: DataFrame, index: Search) -> DataFrame:
    """``doc_id, item_id, share``: leaked items of each document, with the largest share found of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc_id, index.bench.ids[k], share) for k, share in sorted(index.hits(np.frombuffer(raw, np.uint32)).items())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "share"])

    return map_batches(encoded.select("doc_id", "words"), run, HITS)


def indexes(encoded: DataFrame, bench: Bench, max_items: int = MAX_ITEMS) -> Iterator[Search]:
    """The index of each ``max_items`` items; all share one vocabulary, its counts and directions."""
    if not bench.ids:
        return
    idf = inverse_frequencies(encoded, bench)
    directions = latent_directions(encoded, bench, idf)
    for first in range(0, len(bench.ids), max_items):
        yield Search(bench.part(first, first + max_items), idf, directions)


HITS = "doc_id long, item_id long, share double"


def leaks(docs: DataFrame, benchmark: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """``doc_id, item_id, share`` of documents that hold benchmark items; clean documents have no row.

    Map-only besides counts: what is sent out is the benchmark's vocabulary with its directions, and ``max_items`` items at a time.
    Null and empty texts hold nothing; null items and items without words match nothing; items below LEAST_WORDS words match lines
    that consist of them. Rows with a null doc_id come out with it. Repeated rows give one result. An empty table or benchmark
    gives no rows. Other columns are ignored.
    """
    loaded = load_bench(benchmark)
    if loaded is None:
        return docs.sparkSession.createDataFrame([], HITS)
    bench, vocabulary = loaded
    encoded = stored(encode(docs, bench, vocabulary), "words")
    out = encoded.select("doc_id", F.explode("tiny").alias("item_id"), F.lit(1.0).alias("share"))
    for index in indexes(encoded, bench, max_items):
        out = out.unionByName(search(encoded, index))
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """The rows that hold no item, with all their columns; rows are judged one by one, so repeated and null ids don't matter.

    The words are stored beside the columns, so that no text is tokenised twice. See ``leaks`` for nulls and small items.
    """
    loaded = load_bench(benchmark)
    if loaded is None:
        return docs
    bench, vocabulary = loaded
    small_batches(docs.sparkSession)
    words, tiny = (f"{name}_{uuid.uuid4().hex}" for name in ("words", "tiny"))  # no column of docs is called so
    with_words = stored(docs.select("*", words_column(vocabulary)(docs["text"]).alias(words), tiny_column(bench.tiny)(docs["text"]).alias(tiny)), "with-words")
    kept = with_words.where(F.size(tiny) == 0)
    for index in indexes(with_words.select(F.col(words).alias("words")), bench, max_items):
        kept = kept.where(~_leaked(index)(F.col(words)))
    return kept.drop(words, tiny)


def _leaked(index: Search) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def leaked(words: pd.Series) -> pd.Series:
        return pd.Series([bool(index.hits(np.frombuffer(raw, np.uint32))) for raw in words], dtype=bool)

    return leaked
