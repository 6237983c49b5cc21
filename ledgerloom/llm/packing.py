"""Lexical retrieval packing: windows filled with the neighbours that a sharded BM25 index finds for a seed."""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored
from .neardup import components

#: Vocabulary in the form that the faster library reads; the ids are those of byte_bpe_50k.json (tested).
RANKS = "byte_bpe_50k.tiktoken"
NAMED = "byte_bpe_50k.json"
VOCABULARY = 50257
END = 0
#: The named pattern in a form that never tries shorter matches of a run: the same splits (tested), found faster.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: The same for texts without white space on end: nothing is looked ahead for, so an automaton without steps back finds the splits.
PLAIN_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: White space in ASCII, as the patterns see it, and the first and second bytes of the UTF-8 of all other white space.
_WHITE = bytes(c in (9, 10, 11, 12, 13, 32) for c in range(256))
_FIRST = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_SECOND = np.isin(np.arange(256), [0x80, 0x81, 0x85, 0x9A, 0xA0])
_WIDE = np.array(sorted(int.from_bytes(chr(c).encode().ljust(3, b"\0")) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Bytes of texts whose words are gathered at once; a longer text goes by itself, as it is.
MAX_BYTES = 8 << 20
#: Texts with so much white space on end go to the named tokenizer itself: the faster one's pattern search runs out of stack there.
LONG_SPACE = 100_000
WINDOW = 1024
#: Pieces of one index shard: bounds a worker's memory and the work of one query.
SHARD_PIECES = 2048
#: Term shards that each piece is in and asks for its best neighbour.
ROUTES = 8
#: A piece's routes are the smallest hashes among this many of its weightiest ids.
ROUTE_TERMS = 16
#: Ids in more than one in this many pieces of a shard are compared as a dense matrix: there a column costs less than its pairs.
COMMON = 32
#: Pairs of postings expanded at once.
MAX_PAIRS = 1 << 21
K1 = 1.2
B = 0.75


@functools.lru_cache(maxsize=1)
def added_tokens() -> dict[str, int]:
    """The markers that the named tokenizer finds in texts before it splits them, and their ids."""
    with open(public_tokenizers.path(NAMED), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


@functools.lru_cache(maxsize=4)
def load_encoder(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added_tokens())


@functools.lru_cache(maxsize=1)
def named_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(NAMED))


@functools.lru_cache(maxsize=1)
def _long_space() -> re.Pattern:
    return re.compile(r"\s{%d}" % LONG_SPACE)


def text_ids(encoder, text: str) -> np.ndarray:
    """The named tokenizer's ids, of whatever length the text or its white space is."""
    if len(text) >= LONG_SPACE and _long_space().search(text):
        return np.array(named_tokenizer().encode(text, add_special_tokens=False).ids, np.uint32)
    return encoder.encode_to_numpy(text, allowed_special="all")


def encode_text(encoder, text: str) -> list[int]:
    return text_ids(encoder, text).tolist()


@functools.lru_cache(maxsize=2)
def id_lengths(path: str) -> np.ndarray:
    """Bytes of each id."""
    encoder = load_encoder(path)
    return np.array([len(encoder.decode_single_token_bytes(i)) for i in range(encoder.max_token_value + 1)])


def words_of(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts start, and which of them have to be split on their own; the texts are ``raw`` cut at ``offsets``.

    A text is cut before each blank between two characters that aren't white space: one always starts a match of the named pattern, and
    no match looks beyond it. Of words that start with a blank, don't end in white space and have none on end, PLAIN_PATTERN finds
    the same splits wherever they stand; the others are told apart.
    """
    n = len(raw)
    raw += bytes(2)
    white, raw = np.frombuffer(bytearray(raw.translate(_WHITE)), bool), np.frombuffer(raw, np.uint8)
    lead = np.flatnonzero(raw >= 0xC2)
    lead = lead[_FIRST[raw[lead]] & _SECOND[raw[lead + 1]]]
    first, second, third = (raw[lead + k].astype(np.int64) for k in range(3))
    third[first == 0xC2] = 0
    wide = np.isin(first << 16 | second << 8 | third, _WIDE)
    for k in range(3):
        white[lead[wide & ((first != 0xC2) | (k < 2))] + k] = True
    cut = raw[: n + 1] == 32
    cut[1:] &= ~white[:n]
    cut &= ~white[1 : n + 2]
    cut[offsets] = True
    cut[n] = False
    starts = np.flatnonzero(cut)
    own = (raw[starts] != 32) | white[np.append(starts[1:], n) - 1]
    pairs = np.flatnonzero(white[:-1] & white[1:])
    own[np.searchsorted(starts, pairs, side="right") - 1] = True
    return starts, own


def _content(values: pa.Array) -> tuple[bytes, np.ndarray]:
    """All bytes of an Arrow column of them, and where each value starts, and the end."""
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(values) + 1, 4 * values.offset)
    n = int(offsets[-1] - offsets[0])
    return (data.slice(int(offsets[0]), n).to_pybytes() if n else b""), offsets - offsets[0]


def ids_of_texts(texts: pa.Array, path: str) -> list[np.ndarray]:
    """The named tokenizer's ids of each text (null: none). Equal words are split and merged once."""
    raw, offsets = _content(texts.cast(pa.binary()))
    if not len(raw):
        return [np.zeros(0, np.uint16)] * len(texts)
    if len(raw) > MAX_BYTES:
        if len(texts) == 1:
            return [text_ids(load_encoder(path), raw.decode()).astype(np.uint16)]
        half = len(texts) // 2
        return ids_of_texts(texts[:half], path) + ids_of_texts(texts[half:], path)
    starts, own = words_of(raw, offsets)
    bounds = np.append(starts, len(raw)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
    of, words = words.indices.to_numpy(), words.dictionary
    alone = np.zeros(len(words), bool)
    alone[of[own]] = True

    encoder = load_encoder(path)
    found = [text_ids(encoder, w.decode()) for w in words.filter(pa.array(alone)).to_pylist()]
    several = words.filter(pa.array(~alone))
    text, ends = _content(several)
    joined = load_encoder(path, PLAIN_PATTERN).encode_to_numpy(text.decode(), allowed_special="all")
    ends = np.searchsorted(np.cumsum(id_lengths(path)[joined]), ends[1:], side="right")
    size = np.zeros(len(words), np.int64)
    size[alone], size[~alone] = [len(x) for x in found], np.diff(ends, prepend=0)
    at = np.zeros(len(words), np.int64)
    at[~alone], at[alone] = ends - size[~alone], len(joined) + np.cumsum(size[alone]) - size[alone]
    ids = np.concatenate([joined, *found]).astype(np.uint16)

    size, at = size[of], at[of]
    ends = np.cumsum(size)
    ids = ids[np.repeat(at - ends + size, size) + np.arange(ends[-1])]
    cuts = np.append(0, ends)[np.searchsorted(starts, offsets)].tolist()
    return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


PIECES = "piece long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_KINDS = [*[pa.int64()] * 6, pa.binary()]
_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4"))


def cut_documents(docs: DataFrame, ranks_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of each document's ids, numbered: whole windows (``ids`` null, they need no neighbours) and the rest, below a window."""
    path = ranks_path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch.column(0).to_pylist(), ids_of_texts(batch.column(1), path), strict=True):
                ids = np.append(found, np.uint16(END))
                n = len(ids)
                for start in range(0, n, window):
                    part = ids[start : start + window]
                    rows.append((number, doc_id, start, len(part), crc_of(part), n, part.tobytes() if len(part) < window else None))
                    number += 1
            for k in range(0, len(rows), 4000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[k : k + 4000], strict=True), _KINDS, strict=True)], names=_NAMES)

    return map_batches(docs.select(docs["doc_id"].cast("long"), docs["text"]), run, PIECES)


def id_counts(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, id, how often) of the distinct ids of each of up to 65536 pieces, in this order."""
    owner = np.repeat(np.arange(len(pieces), dtype=np.uint32), [len(p) for p in pieces])
    keys, tf = np.unique(owner << np.uint32(16) | np.concatenate([np.zeros(0, np.uint16), *pieces]), return_counts=True)
    return (keys >> np.uint32(16)).astype(np.int64), (keys & np.uint32(0xFFFF)).astype(np.uint16), tf


def document_frequencies(pieces: DataFrame) -> tuple[np.ndarray, int, float]:
    """(pieces with each id, pieces, mean length) over all pieces below a window; VOCABULARY rows reach the driver at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(VOCABULARY, np.int64), 0, 0
        for batch in batches:
            _, t, tf = id_counts([np.frombuffer(raw, np.uint16) for raw in batch.column(0).to_pylist()])
            df += np.bincount(t, minlength=VOCABULARY)
            n, total = n + len(batch), total + int(tf.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, [-1, -2]), pa.int64()), pa.array(np.append(df[seen], [n, total]), pa.int64())], names=["token", "n"]
        )

    counts = map_batches(pieces.where("ids is not null").select("ids"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    df, n, total = np.zeros(VOCABULARY, np.int64), 0, 0
    for row in counts.collect():
        if row["token"] >= 0:
            df[row["token"]] = row["n"]
        elif row["token"] == -1:
            n = row["n"]
        else:
            total = row["n"]
    return df, n, total / max(1, n)


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    """Robertson's inverse document frequency; ids in half of all pieces or more weigh nothing."""
    return np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0).astype(np.float32)


def weights_of(t: np.ndarray, tf: np.ndarray, lengths: np.ndarray | int, idf: np.ndarray, mean_length: float) -> np.ndarray:
    """BM25 weights of ids that occur ``tf`` times in pieces of ``lengths``."""
    norm = np.asarray(K1 * (1 - B + B * lengths / max(1e-9, mean_length)), np.float32)
    tf = tf.astype(np.float32)
    return idf[t].astype(np.float32) * (tf * np.float32(K1 + 1) / (tf + norm))


def _orders() -> np.ndarray:
    """For each route the place of each id in a random order."""
    rng = np.random.default_rng(11)
    return np.stack([rng.permutation(VOCABULARY) for _ in range(ROUTES)])


def heaviest_first(owner: np.ndarray, t: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The ids of each of up to 65536 pieces by descending weight, equal ones ascending: one sort of whole numbers.

    The bits of floats that aren't negative are in the floats' order.
    """
    light = np.uint64(0xFFFFFFFF) - weights.astype(np.float32).view(np.uint32).astype(np.uint64)
    keys = owner.astype(np.uint64) << np.uint64(48) | light << np.uint64(16) | t.astype(np.uint64)
    return (np.sort(keys) & np.uint64(0xFFFF)).astype(np.uint16)


def term_vectors(rest: DataFrame, idf: np.ndarray, mean_length: float, shared: np.ndarray) -> DataFrame:
    """``piece, length, terms, counts, routes``: ids that other pieces have too, how often (255 at most), a route for each of ROUTES orders.

    A route has the order's number and the two ids, of the ROUTE_TERMS weightiest, that come first in that order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = np.column_stack([_orders(), np.full((ROUTES, 1), VOCABULARY)])  # no id comes last
        for batch in batches:
            pieces = [np.frombuffer(raw, np.uint16) for raw in batch.column(1).to_pylist()]
            n, lengths = len(pieces), np.array([len(p) for p in pieces], np.int64)
            owner, t, tf = id_counts(pieces)
            keep = shared[t] & (idf[t] > 0)
            owner, t, tf = owner[keep], t[keep], tf[keep]
            bounds = np.searchsorted(owner, np.arange(n + 1))
            heavy = heaviest_first(owner, t, weights_of(t, tf, lengths[owner], idf, mean_length))
            nth = np.arange(len(t)) - bounds[owner]
            top = np.full((n, ROUTE_TERMS), VOCABULARY)
            top[owner[nth < ROUTE_TERMS], nth[nth < ROUTE_TERMS]] = heavy[nth < ROUTE_TERMS]
            first = np.sort(orders[:, top], axis=2)[:, :, :2]
            first[:, :, 1] = np.where(first[:, :, 1] == VOCABULARY, first[:, :, 0], first[:, :, 1])
            routes = ((np.arange(ROUTES)[:, None] << 32) + (first[:, :, 0] << 16) + first[:, :, 1]).T
            tf = np.minimum(tf, 255).astype(np.uint8)
            spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            columns = [
                pa.array(lengths, pa.int32()),
                pa.array([t[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([tf[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([r if b > a else [] for r, (a, b) in zip(routes.tolist(), spans, strict=True)], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["piece", "length", "terms", "counts", "routes"])

    return map_batches(rest.select("piece", "ids"), run, "piece long, length int, terms binary, counts binary, routes array<long>")


def shard_scores(t: np.ndarray, held: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """BM25 of all of a shard's ``n`` pieces (columns) for each as the query (rows).

    From ids, weights and pieces (ascending) of the postings. Ids in more than one piece of COMMON are multiplied as a dense
    matrix, pairs of the others' postings are expanded.
    """
    df = np.bincount(t, minlength=VOCABULARY)
    common = df * COMMON > n
    place, dense = np.cumsum(common) - 1, common[t]
    columns = int(common.sum())
    w = np.zeros((n, columns), np.float32)
    w.reshape(-1)[owner[dense] * columns + place[t[dense]]] = held[dense]
    m = (w > 0).astype(np.float32) @ w.T
    scores = m.reshape(-1)
    t, owner, held = t[~dense], owner[~dense], held[~dense]
    order = np.argsort(t, kind="stable")
    t, owner, held = t[order], owner[order], held[order]
    df[common] = 0
    first, size = (np.cumsum(df) - df)[t], df[t]  # each posting meets all those of its id
    pairs = np.append(0, np.cumsum(size))
    lo = 0
    while lo < len(t):
        hi = max(lo + 1, int(np.searchsorted(pairs, pairs[lo] + MAX_PAIRS, side="right")) - 1)
        at = np.repeat(first[lo:hi] - pairs[lo:hi] + pairs[lo], size[lo:hi]) + np.arange(pairs[hi] - pairs[lo])
        np.add.at(scores, np.repeat(owner[lo:hi] * n, size[lo:hi]) + owner[at], held[at])
        lo = hi
    return m


def equal_rows(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """(the first of each set of equal rows, the number of each row's set)."""
    sets: dict = {}
    of = np.array([sets.setdefault(r, len(sets)) for r in rows], np.int64)
    return np.unique(of, return_index=True)[1], of


def best_in_shard(t: np.ndarray, held: np.ndarray, owner: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece of a shard the first other one of the highest BM25, and that (0: none shares an id).

    Pieces with equal vectors are one in the postings (``owner``) and in the matrix; ``of`` has each piece's vector, numbered
    as they come.
    """
    n = int(of.max()) + 1
    m = shard_scores(t, held, owner, n)
    members = np.argsort(of, kind="stable")
    first = np.searchsorted(of[members], np.arange(n + 1))
    alone = np.flatnonzero(np.diff(first) == 1)
    m[alone, alone] = 0
    best = m.argmax(axis=1)
    score = m[np.arange(n), best].astype(np.float64)[of]
    found = members[first[best[of]]]
    itself = np.flatnonzero(found == np.arange(len(of)))  # the next copy, if there is one
    copies = itself[score[itself] > 0]
    found[copies] = members[first[best[of[copies]]] + 1]
    return found, score


def places(score: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the scores (32-bit floats that aren't negative); equal scores are told apart by 32 bits of ``b``'s hash."""
    tie = b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    return (score.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | tie).astype(np.int64)


def best_neighbours(vectors: DataFrame, idf: np.ndarray, mean_length: float, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``a, b``: each piece and the best neighbour that any of its term shards has for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def search(rows: list[tuple]) -> pa.RecordBatch:
            names, (kept, of) = np.array([r[0] for r in rows], np.int64), equal_rows([r[1:] for r in rows])
            rows = [rows[i] for i in kept.tolist()]
            lengths = np.array([r[1] for r in rows])
            t, tf = np.frombuffer(b"".join(r[2] for r in rows), np.uint16), np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
            owner = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
            best, score = best_in_shard(t, weights_of(t, tf.astype(np.int64), lengths[owner], idf, mean_length), owner, of)
            some = score > 0
            return pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[best[some]]), pa.array(places(score[some], names[best[some]]))], names=["a", "b", "place"])

        for batch in batches:
            held += zip(*[batch.column(c).to_pylist() for c in ("piece", "length", "terms", "counts")], strict=True)
            while len(held) >= shard_pieces:
                yield search(held[:shard_pieces])
                held = held[shard_pieces:]
        if held:
            yield search(held)

    routed = vectors.select("piece", "length", "terms", "counts", F.explode("routes").alias("route"))
    shards = routed.repartitionByRange("route", "piece").sortWithinPartitions("route", "piece").select("piece", "length", "terms", "counts")
    found = map_batches(shards, run, "a long, b long, place long")
    return found.groupBy("a").agg(F.max_by("b", "place").alias("b"))  # on whole numbers alone, which needs no sort


class Shard:
    """A BM25 index of pieces: scores of all of them for each."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean_length: float):
        lengths = np.array([len(p) for p in pieces], np.int64)
        owner, t, tf = id_counts(pieces)
        keep = idf[t] > 0
        owner, t, tf = owner[keep], t[keep], tf[keep]
        self.m = shard_scores(t, weights_of(t, tf, lengths[owner], idf, mean_length), owner, len(pieces))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every piece for all ids of the seed as a query."""
        return self.m[seed]


class Filler:
    """Greedy windows over shards that come one after the other; what doesn't fill a window waits for the next shard."""

    def __init__(self, idf: np.ndarray, mean_length: float, window: int = WINDOW):
        self.idf, self.mean, self.window = idf, mean_length, window
        self.open: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.room = window

    def _add(self, row: tuple, taken: int) -> tuple[int, list[tuple] | None]:
        """Put what fits of a piece after its first ``taken`` ids; returns how many are taken now, and a full window."""
        doc_id, start, ids, total = row
        part = ids[taken : taken + self.room]
        self.open.append((doc_id, start + taken, part, total))
        self.room -= len(part)
        full = None
        if not self.room:
            full, self.open, self.room = self.open, [], self.window
        return taken + len(part), full

    def shard(self, rows: list[tuple]) -> Iterator[list[tuple]]:
        """Full windows; ``rows``: (doc_id, start, ids, doc_tokens). Every id ends in a window, now or later."""
        index = Shard([r[2] for r in rows], self.idf, self.mean)
        unused = np.ones(len(rows), bool)
        taken = [0] * len(rows)
        at, cut = 0, -1
        while True:
            if cut < 0:
                while at < len(rows) and not unused[at]:
                    at += 1
                if at == len(rows):
                    return
                seed = at
            else:
                seed = cut
            unused[seed], cut = False, -1
            taken[seed], full = self._add(rows[seed], taken[seed])
            if full:
                yield full
                cut = seed if taken[seed] < len(rows[seed][2]) else -1
                continue
            scores = np.where(unused, index.scores(seed), 0)
            while scores[j := int(scores.argmax())] > 0:
                scores[j], unused[j] = 0, False
                taken[j], full = self._add(rows[j], taken[j])
                if full:
                    yield full
                    cut = j if taken[j] < len(rows[j][2]) else -1
                    break

    def rest(self) -> Iterator[list[tuple]]:
        """What is left, cut into sequences whose lengths are powers of two, so that none is padded."""
        left = self.window - self.room
        queue = [(r, 0) for r in self.open]
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            out = []
            while size:
                (doc_id, start, ids, total), done = queue.pop(0)
                part = ids[done : done + size]
                out.append((doc_id, start + done, part, total))
                size -= len(part)
                if done + len(part) < len(ids):
                    queue.insert(0, ((doc_id, start, ids, total), done + len(part)))
            yield out
        self.open, self.room = [], self.window


def deal(rest: DataFrame, df: np.ndarray, idf: np.ndarray, mean: float, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``rest`` with ``together``, the same for pieces that best neighbours connect, and ``route``, the smallest of theirs."""
    vectors = stored(term_vectors(rest, idf, mean, df >= 2), "vectors")
    joined = components(best_neighbours(vectors, idf, mean, shard_pieces)).withColumnRenamed("node", "piece").withColumnRenamed("component", "together")
    first = vectors.select("piece", F.get("routes", F.lit(0)).alias("route")).join(joined, "piece", "left").withColumn("together", F.coalesce("together", "piece"))
    route = first.groupBy("together").agg(F.min("route").alias("route"))
    return stored(rest.join(first.select("piece", "together").join(route, "together"), "piece"), "dealt")


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, ranks_path: str | None = None, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row for each piece of each document's ids in its sequence.

    Whole windows of a document are sequences as they are. Each other piece asks ROUTES term shards for its best neighbour;
    pieces that the best answers connect are dealt together (range partitioning, so that a large group is split) into
    index shards of at most ``shard_pieces``. In a shard, a seed's unused neighbours fill its window by descending BM25;
    the last one is cut and seeds the next window; a window that neighbours don't fill takes the next piece.
    Document frequencies and lengths are of all pieces. What a task has left is cut into powers of two: no padding.

    Null text: one end mark. Null ids stay null. Repeated rows are packed each. Empty table: empty result.
    """
    pieces = stored(cut_documents(docs, ranks_path, window), "pieces")
    df, n, mean = document_frequencies(pieces)
    idf = idf_of(df, n)
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler = Filler(idf, mean, window)
        base, count = TaskContext.get().partitionId() << 33, 0

        def emit(windows: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal count
            rows = []
            for full in windows:
                offset = 0
                for doc_id, start, ids, total in full:
                    rows.append((doc_id, start, len(ids), crc_of(ids), total, 2 * (base + count), offset))
                    offset += len(ids)
                count += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in PACKED.split(", ")])

        held: list[tuple] = []
        for batch in batches:
            held += [(r["doc_id"], r["start"], np.frombuffer(r["ids"], np.uint16), r["doc_tokens"]) for r in batch.to_pylist()]
            while len(held) >= shard_pieces:
                yield from emit(filler.shard(held[:shard_pieces]))
                held = held[shard_pieces:]
        if held:
            yield from emit(filler.shard(held))
        yield from emit(filler.rest())

    rest = pieces.where("ids is not null").select("piece", "doc_id", "start", "doc_tokens", "ids")
    dealt = deal(rest, df, idf, mean, shard_pieces).repartitionByRange("route", "together", "piece").sortWithinPartitions("route", "together", "piece")
    packed = map_batches(dealt.select("doc_id", "start", "doc_tokens", "ids"), fill, PACKED)
    whole = pieces.where("ids is null").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(whole)
