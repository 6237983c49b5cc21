"""Removal of repeated substrings: Burrows-Wheeler interval expansion over the places where repeats can be.

A byte goes if a string of LENGTH bytes that covers it also starts earlier, in a smaller doc_id or before in the document.

1. Each window of LENGTH bytes has an anchor: its GRAM bytes of smallest hash, the leftmost of equal ones. Equal windows
   have equal anchors at the same place. A run of windows with one anchor is a context (about 130 bytes).
2. Contexts are dealt by their anchors' hash. Of contexts that are wholly equal, all but the first are covered:
   this leaves one place of each distinct context. Anchors with one distinct context are done.
3. For the others the texts are read again, and blocks of contexts (all contexts of an anchor in one block) get a suffix array
   and a Burrows-Wheeler transform. Breadth-first backward extension of its intervals finds common prefixes by increasing
   length and stops at LENGTH: what it has not split by then are equal windows, of which all but the first are covered.
4. Anchors with more than MAX_CONTEXTS contexts (the edges of a passage that many documents share) go by the windows' own
   hashes instead, one row for each window, combined before they are shuffled.
5. Each document's covered ranges are joined with its text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, small_batches, stored

LENGTH = 100
GRAM = 32
#: Window starts of a document that are looked at together; positions have 20 bits.
PIECE = 1_000_000
#: Contexts of one anchor that go into a block; more go by the windows' hashes.
MAX_CONTEXTS = 1500
#: Bytes of a block.
BLOCK = 1 << 19
#: One in so many documents is looked at for common anchors. These are dealt by their contexts' hash too; this moves rows, it changes no result.
SAMPLE = 64
#: An anchor is common if it is in this share of the sample, and the sample has it this often; the commonest MAX_COMMON are.
COMMON_SHARE = 0.002
COMMON_LEAST = 20
MAX_COMMON = 10_000

_POSITION = np.uint64(0xFFFFF)
_RNG = np.random.default_rng(611)


def _odd() -> np.uint64:
    return _RNG.integers(0, 2**64, dtype=np.uint64) | np.uint64(1)


_BYTE = _RNG.integers(0, 2**64, (2, 256), dtype=np.uint64)
_STEP = [_odd() for _ in range(8)]
_BASE = (_odd(), _odd())


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        done = 1
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
    return out


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _tables() -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses, made once in a worker."""
    if not _POWERS:
        n = PIECE + LENGTH + 2
        _POWERS.extend((_powers(int(b), n), _powers(pow(int(b), -1, 1 << 64), n)) for b in _BASE)
    return _POWERS


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP[6]
    return (x ^ (x >> np.uint64(29))) * _STEP[7]


def range_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of data[lo:hi], the same for equal bytes wherever they are."""
    power, inverse = _tables()[which]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[which][data] * power[: len(data)])])
    x = (sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64) * _STEP[5]
    x = _mixed(x)
    return x ^ (x >> np.uint64(32))


def contexts(data: bytes) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, start, end, anchor's place) of each run of windows; none below LENGTH bytes."""
    x = np.frombuffer(data, np.uint8)
    parts = []
    for at in range(0, len(x) - LENGTH + 1, PIECE):
        part = x[at : at + PIECE + LENGTH - 1]
        g = _BYTE[0][part]
        for j, step in enumerate((1, 2, 4, 8, 16)):
            g = g[:-step] * _STEP[j] + g[step:]
        g = _mixed(g)
        low = (g & ~_POSITION) | np.arange(len(g), dtype=np.uint64)
        width = 1
        while width < LENGTH - GRAM + 1:
            step = min(width, LENGTH - GRAM + 1 - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        place = (low & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:], len(place)) - 1
        lo, hi = first, last + LENGTH
        parts.append((g[place[first]].view(np.int64), range_hashes(part, lo, hi).view(np.int64), lo + at, hi + at, place[first] + at))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


_ROW = "kind int, route long, h long, c long, doc_id long, lo long, hi long, at long"
_ROW_NAMES = [f.split()[0] for f in _ROW.split(", ")]
#: Kinds of rows: covered range; a context among others of its anchor; a context of a common anchor.
COVERED, CONTEXT, COMMON = 1, 2, 3


def _rows(kind, route, h, c, doc, lo, hi, at) -> pa.RecordBatch:
    n = len(h)
    kind = np.full(n, kind, np.int32) if np.isscalar(kind) else np.asarray(kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(np.asarray(x, np.int64)) for x in (route, h, c, doc, lo, hi, at))], names=_ROW_NAMES)


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if doc_id is not None and text is not None:
            yield doc_id, as_bytes(text)


def _ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def common_anchors(docs: DataFrame) -> np.ndarray:
    """Hashes of anchors that very many documents have, sorted; MAX_COMMON at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = [], 0
            for _, data in _documents(batch):
                found.append(np.unique(contexts(data)[0]))
                n += 1
            h = np.concatenate([np.zeros(0, np.int64), *found])
            values, counts = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(values, 0)), pa.array(np.append(counts, 0).astype(np.int64)), pa.array(np.append(np.zeros(len(values), np.int64), n))], names=["h", "n", "docs"])

    sample = _ids_and_texts(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counts = map_batches(sample, run, "h long, n long, docs long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = counts.where((F.col("n") >= COMMON_LEAST) | (F.col("docs") > 0)).orderBy(F.desc("docs"), F.desc("n"), "h").limit(MAX_COMMON + 1).collect()
    total = sum(r["docs"] for r in counts)
    return np.array(sorted(r["h"] for r in counts if r["n"] >= max(COMMON_LEAST, COMMON_SHARE * total)), np.int64)


def _anchored(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """A row for each context; those that equal an earlier one of the same batch are covered at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, owners = [], []
            for doc_id, data in sorted(_documents(batch)):
                found = contexts(data)
                if len(found[0]):
                    parts.append(found)
                    owners.append(np.full(len(found[0]), doc_id, np.int64))
            if not parts:
                continue
            h, c, lo, hi, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            doc = np.concatenate(owners)
            order = np.lexsort((lo, doc, c, h))
            h, c, lo, hi, at, doc = h[order], c[order], lo[order], hi[order], at[order], doc[order]
            again = np.append(False, (h[1:] == h[:-1]) & (c[1:] == c[:-1]))
            # a repeated row's contexts are the first one's own
            first = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
            own = again & (doc == doc[first]) & (lo == lo[first])
            keep = ~own
            h, c, lo, hi, at, doc, again = h[keep], c[keep], lo[keep], hi[keep], at[keep], doc[keep], again[keep]
            often = np.isin(h, common)
            kind = np.where(again, COVERED, np.where(often, COMMON, CONTEXT))
            yield _rows(kind, np.where(often | again, h ^ (c * 31) ^ (np.where(again, doc, 0)), h), h, c, doc, lo, hi, at)

    return map_batches(_ids_and_texts(docs), run, _ROW)


def _first_contexts(rows: DataFrame) -> DataFrame:
    """Covered ranges, and one row for each distinct context of the anchors that have several (or are common).

    Rows come sorted by anchor, context and place, so a row is judged by its neighbours; only an anchor's first row waits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # an anchor's first row, while it has one context
        last: tuple | None = None  # (h, c, doc, lo) of the last first occurrence
        for batch in batches:
            kind, _, h, c, doc, lo, hi, at = (x.to_numpy() for x in batch.columns)
            done = kind == COVERED
            if done.any():
                yield _rows(COVERED, *(x[done] for x in (h, h, c, doc, lo, hi, at)))
                kind, h, c, doc, lo, hi, at = (x[~done] for x in (kind, h, c, doc, lo, hi, at))
            n = len(h)
            if not n:
                continue
            new_h = np.append(last is None or h[0] != last[0], h[1:] != h[:-1])
            new_c = new_h | np.append(last is None or c[0] != last[1], c[1:] != c[:-1])
            first = np.maximum.accumulate(np.where(new_c, np.arange(n), -1))
            f_doc, f_lo = (np.where(first >= 0, x[first], y) for x, y in ((doc, last[2] if last else 0), (lo, last[3] if last else 0)))
            covered = ~new_c & ~((doc == f_doc) & (lo == f_lo))
            if covered.any():
                yield _rows(COVERED, *(x[covered] for x in (h, h, c, doc, lo, hi, at)))
            group = np.cumsum(new_h)
            more = new_c & ~new_h
            several = np.zeros(group[-1] + 1, bool)
            several[group[more]] = True
            out = new_c & (several[group] | (kind == COMMON))
            if several[0] and waiting is not None:
                yield _rows(*([x] for x in waiting))
                waiting = None
            if out.any():
                yield _rows(kind[out], *(x[out] for x in (h, h, c, doc, lo, hi, at)))
            if new_h.any():
                head = int(np.flatnonzero(new_h)[-1])
                waiting = None if out[head] else (kind[head], h[head], h[head], c[head], doc[head], lo[head], hi[head], at[head])
            last = (h[-1], c[-1], f_doc[-1], f_lo[-1])

    dealt = rows.repartition("route").sortWithinPartitions("h", "c", "doc_id", "lo")
    return map_batches(dealt, run, _ROW)


# --------------------------------------------------------------------------- Burrows-Wheeler


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in order of their first ``depth`` symbols at least, by prefix doubling.

    It begins with as many symbols as a 62-bit number holds. Beyond the end are zeros.
    """
    n, bits = len(text), max(1, int(text.max()).bit_length())
    k = max(1, 62 // bits)
    padded = np.append(text.astype(np.int64), np.zeros(k, np.int64))
    key = np.zeros(n, np.int64)
    for j in range(k):
        key = key << bits | padded[j : j + n]
    while True:
        order = np.argsort(key)
        in_order = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, in_order[1:] != in_order[:-1]))
        if k >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        k *= 2


def equal_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix (in order) differs from the one before in its first ``length`` symbols.

    Works on the Burrows-Wheeler transform: the intervals of common prefixes of k symbols, extended backwards by each symbol
    that precedes them, are those of k + 1 symbols. Breadth first, so a boundary appears at its common prefix's length;
    places without a boundary yet are all that is looked at, and extension stops at ``length``.
    """
    bwt = text[order - 1]  # the first suffix is preceded by the last symbol, as in a circle
    source = np.argsort(bwt, kind="stable").astype(np.int32)  # the place whose backward extension each place is
    first = text[order]
    boundary = np.append(True, first[1:] != first[:-1])
    open_ = np.flatnonzero(~boundary)
    left, right = source[open_ - 1], source[open_]
    for _ in range(1, length):
        if not len(open_):
            break
        interval = np.cumsum(boundary, dtype=np.int32)
        split = interval[left] != interval[right]
        if split.any():
            boundary[open_[split]] = True
            stay = ~split
            open_, left, right = open_[stay], left[stay], right[stay]
    return boundary


def covered_windows(texts: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(document, start, end) of the ranges of the texts' windows that also start earlier, among these texts.

    Each text ends in a terminator, a symbol that is in no window.
    """
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1)
    begin = ends - sizes - 1
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    dense = np.zeros(256, np.uint16)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    dense[used] = np.arange(1, len(used) + 1)
    symbols = dense[data]
    symbols[ends - 1] = 0
    order = suffix_array(symbols, length)
    boundary = equal_prefixes(symbols, order, length)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    local = np.arange(len(symbols)) - begin[owner]
    is_window = local <= sizes[owner] - length
    doc_rank = np.unique(docs, return_inverse=True)[1]
    group = np.cumsum(boundary) - 1
    pick = is_window[order]
    at, group = order[pick], group[pick]
    absolute = starts[owner[at]] + local[at]
    low = np.lexsort((absolute, doc_rank[owner[at]], group))
    lead = np.append(True, group[low][1:] != group[low][:-1])
    # the same place can be in two contexts: not a repeat of itself
    first = low[np.maximum.accumulate(np.where(lead, np.arange(len(low)), 0))]
    again = (doc_rank[owner[at[low]]] != doc_rank[owner[at[first]]]) | (absolute[low] != absolute[first])
    hit = at[low[again]]
    flags = np.zeros(len(symbols) + 1, bool)
    flags[hit] = True
    edges = np.flatnonzero(np.diff(np.append(False, flags).astype(np.int8)))
    return [(int(docs[owner[a]]), int(starts[owner[a]] + local[a]), int(starts[owner[a]] + local[a] + (b - a) + length - 1)) for a, b in edges.reshape(-1, 2).tolist()]


def _half_keys(text: bytes, at: int) -> tuple[int, int]:
    """Hashes of the anchor with the bytes that a window must have before it, or after it: each window has one of both."""
    half = (LENGTH - GRAM) // 2
    left = hash((0, text[at - half : at + GRAM])) if at >= half else None
    right = hash((1, text[at : at + GRAM + half])) if at + GRAM + half <= len(text) else None
    return left, right


def _worth(rows: list[tuple]) -> list[tuple]:
    """Those contexts of one anchor that have bytes around it which another one has too: others share no window."""
    keys = [_half_keys(r[3], r[4]) for r in rows]
    counts: dict[int | None, int] = {}
    for pair in keys:
        for k in pair:
            counts[k] = counts.get(k, 0) + 1
    return [r for r, pair in zip(rows, keys, strict=True) if any(k is not None and counts[k] > 1 for k in pair)]


_RANGES = "doc_id long, lo long, hi long"


def _ranges(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["doc_id", "lo", "hi"])


def _by_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, doc_id, lo, text, at) sorted by h: blocks of whole anchors."""
    block: list[tuple] = []
    group: list[tuple] = []
    size = 0

    def solved() -> pa.RecordBatch:
        return _ranges(covered_windows([r[3] for r in block], np.array([r[1] for r in block]), np.array([r[2] for r in block])))

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("h", "doc_id", "lo", "bytes", "at")), strict=True):
            if group and row[0] != group[0][0]:
                block += (kept := _worth(group))
                size += sum(len(r[3]) for r in kept)
                group = []
                if size >= BLOCK:
                    yield solved()
                    block, size = [], 0
            group.append(row)
    block += _worth(group)
    if block:
        yield solved()


# --------------------------------------------------------------------------- the whole


def _squeezed(docs: DataFrame) -> DataFrame:
    """Texts compressed, to be shuffled: ``doc_id, n_bytes, packed``. Null text: no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = [as_bytes(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array([z.compress(d) for d in data], pa.binary())], names=["doc_id", "n_bytes", "packed"])

    return map_batches(_ids_and_texts(docs), run, "doc_id long, n_bytes long, packed binary")


def _unpacked(data: bytes) -> bytes:
    return zstandard.decompress(data)


_BYTE_NAMES = ["kind", "h", "h2", "doc_id", "lo", "at", "bytes"]


def _byte_rows(*columns: Iterable) -> pa.RecordBatch:
    kinds = (pa.int32(), *[pa.int64()] * 5, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c if isinstance(c, np.ndarray) else list(c), t) for c, t in zip(columns, kinds, strict=True)], names=_BYTE_NAMES)


def _distinct_windows(h: np.ndarray, h2: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for the first of the equal windows of a batch, and one for each run of the others, which are covered (``at``: its end)."""
    order = np.lexsort((lo, doc, h2, h))
    h, h2, doc, lo = h[order], h2[order], doc[order], lo[order]
    again = np.append(False, (h[1:] == h[:-1]) & (h2[1:] == h2[:-1]))
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
    repeat = again & ~((doc == doc[first]) & (lo == lo[first]))
    new = ~again
    n = int(new.sum())
    yield _byte_rows(np.full(n, COMMON, np.int32), h[new], h2[new], doc[new], lo[new], np.zeros(n, np.int64), [None] * n)
    doc, lo = doc[repeat], lo[repeat]
    if len(doc):
        order = np.lexsort((lo, doc))
        doc, lo = doc[order], lo[order]
        head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (lo[1:] > lo[:-1] + 1)))
        tail = np.append(head[1:], len(doc)) - 1
        n, zero = len(head), np.zeros(len(head), np.int64)
        yield _byte_rows(np.full(n, COVERED, np.int32), zero, zero, doc[head], lo[head], lo[tail] + LENGTH, [None] * n)


def _with_bytes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``kind, h, h2, doc_id, lo, at, bytes``: contexts with their bytes; of those by windows, a row for each window that is new in
    its batch (h, h2 its hashes) and one for each run of those that are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows: list[tuple] = []
            for doc_id, packed, places in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "packed", "places")), strict=True):
                data = _unpacked(packed)
                parts: list[tuple] = [(CONTEXT, p["h"], 0, doc_id, p["lo"], p["at"] - p["lo"], data[p["lo"] : p["hi"]]) for p in places if p["kind"] == CONTEXT]
                if parts:
                    yield _byte_rows(*zip(*parts, strict=True))
                for p in places:
                    if p["kind"] == COMMON:
                        piece = np.frombuffer(data, np.uint8)[p["lo"] : p["hi"]]
                        lo = np.arange(len(piece) - LENGTH + 1)
                        one, two = (range_hashes(piece, lo, lo + LENGTH, w).view(np.int64) for w in (0, 1))
                        windows.append((one, two, np.full(len(lo), doc_id, np.int64), lo + p["lo"]))
            if windows:
                yield from _distinct_windows(*(np.concatenate(c) for c in zip(*windows, strict=True)))

    places = rows.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "h", "lo", "hi", "at")).alias("places"))
    # repeated ids: one of the rows gives the bytes
    joined = _squeezed(docs).select("doc_id", "packed").join(places, "doc_id")
    return map_batches(joined, run, "kind int, h long, h2 long, doc_id long, lo long, at long, bytes binary")


def covered_ranges(docs: DataFrame, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """``doc_id, lo, hi`` of covered ranges; they overlap, and their union is what goes."""
    rows = stored(_first_contexts(_anchored(docs, common_anchors(docs))), "contexts")
    covered = rows.where(F.col("kind") == COVERED).select("doc_id", "lo", "hi")
    several = rows.where(F.col("kind") != COVERED)
    many = several.where(F.col("kind") == CONTEXT).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_contexts).select("h", F.lit(COMMON).alias("as"))
    several = several.join(many, "h", "left").withColumn("kind", F.coalesce("as", "kind"))
    placed = stored(_with_bytes(docs, several), "context-bytes")
    blocks = placed.where(F.col("kind") == CONTEXT).select("h", "doc_id", "lo", "bytes", "at")
    by_blocks = map_batches(blocks.repartition("h").sortWithinPartitions("h", "doc_id", "lo"), _by_blocks, _RANGES)
    windows = placed.where(F.col("kind") == COMMON).select("h", "h2", "doc_id", "lo")
    firsts = windows.groupBy("h", "h2").agg(F.min(F.struct("doc_id", "lo")).alias("first"), F.max(F.struct("doc_id", "lo")).alias("last")).where(F.col("first") != F.col("last"))
    by_windows = windows.join(firsts, ["h", "h2"]).where(F.struct("doc_id", "lo") != F.col("first")).select("doc_id", "lo", (F.col("lo") + LENGTH).alias("hi"))
    in_batches = placed.where(F.col("kind") == COVERED).select("doc_id", "lo", F.col("at").alias("hi"))
    return covered.unionByName(by_blocks).unionByName(by_windows).unionByName(in_batches)


def _cut(n: int, ranges: Iterable[int] | None) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges (starts and ends in turn), within n bytes."""
    if ranges is None or not len(ranges):
        return []
    pairs = np.minimum(np.asarray(ranges, np.int64).reshape(-1, 2), n)
    pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    if not len(pairs):
        return []
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
    return list(zip(pairs[first, 0].tolist(), reach[np.append(first[1:], len(pairs)) - 1].tolist(), strict=True))


def _without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(data[at:lo])
        at = hi
    kept.append(data[at:])
    return b"".join(kept)


_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _ranges_by_document(docs: DataFrame, max_contexts: int) -> DataFrame:
    """``doc_id, ranges``: starts and ends in turn."""
    return covered_ranges(docs, max_contexts).groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("lo", "hi"))).alias("ranges"))


def remove_repeats(docs: DataFrame, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    Null text has no bytes. Rows with a null doc_id have no place in the order: they are kept whole and cover nothing. Repeated
    rows are one document and get the same result; of rows that share a doc_id but not the text, the ranges found in either
    are cut from each. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, packed, found in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "packed", "ranges")), strict=True):
                data = _unpacked(packed)
                runs = _cut(len(data), found)
                left = _without(data, runs)
                rows.append((doc_id, len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _CUT.split(", ")])

    return map_batches(_squeezed(docs).join(_ranges_by_document(docs, max_contexts), "doc_id", "left").select("doc_id", "packed", "ranges"), run, _CUT)


def _whole_letters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without their first and last bytes that belong to letters which stay in part."""
    out = []
    for lo, hi in runs:
        while lo < hi and data[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi -= 1
        if hi > lo:
            out.append((lo, hi))
    return out


def cut_texts(docs: DataFrame, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """``docs`` with the repeats cut from ``text`` (of letters that a range covers in part, none), and all other columns.

    Rows of which nothing but white space is left by that go. See ``remove_repeats`` for nulls and repeated rows.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, ranges, strict=True):
            if text is None or found is None:
                out.append(text)
                continue
            data = as_bytes(text)
            left = _without(data, _whole_letters(data, _cut(len(data), found))).decode("utf-8", "surrogatepass")
            out.append(left if left.strip() else None)
        return pd.Series(out, dtype=object)

    cut = cut.asNondeterministic()  # else the filter on its result runs it again
    cut_id, found = (f"{name}_{uuid.uuid4().hex}" for name in ("id", "ranges"))  # no column of docs is called so
    ranges = _ranges_by_document(docs, max_contexts).select(F.col("doc_id").alias(cut_id), F.col("ranges").alias(found))
    joined = docs.join(ranges, docs["doc_id"] == F.col(cut_id), "left")
    done = joined.select(*[F.when(F.col(found).isNull(), F.col("text")).otherwise(cut("text", found)).alias("text") if c == "text" else docs[c] for c in docs.columns], found)
    return done.where(F.col(found).isNull() | F.col("text").isNotNull()).drop(found)
