"""Near-duplicate documents: b-bit MinHash signatures, bands for candidates, full sets for links, components.

1. A document's set: its distinct 5-word shingles, hashed to 64 bits. Documents with the same set are one class,
   known by its smallest doc_id (and that one's text); only classes go on.
2. 160 minima make 32 bands of 5 and, by the low 4 bits of each, a packed signature of 80 bytes.
   Two sets of similarity 0.85 share no band with probability 7e-9.
3. The classes of a band value form a bucket, and its smallest class is its pivot. Each class is compared with the pivots of its
   buckets: signatures by bit counts, then the full sets. Links are contracted, so a bucket of copies of one text is done
   in work that grows with its size.
4. What is left of a bucket are the pairs of its classes that no links connect yet: classes outside the pivot's
   component against all others. They are cut into cells, pairs of chunks of at most CHUNK classes, so that no task gets an
   unbounded bucket and each such pair meets in one cell. In a cell, signatures are compared by bit counts, and the texts
   of classes that have any candidate are dealt to their cells, where the full sets decide.
5. Links are contracted to components by rounds of smallest neighbours.

Joins and counts by digest or band value are salted, so that one value's rows are in SALTS tasks.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, stored

WORDS = 5
HASHES = 160
ROWS = 5
BANDS = HASHES // ROWS
BITS = 4
#: Most classes of one chunk of a bucket; a cell has two chunks at most.
CHUNK = 384
#: Most classes, about, that a copy of a pivot is sent to.
PIVOT_CHUNK = 64
#: A candidate's estimate may be this much below the threshold: 4.9 standard deviations of the estimate at 0.8, 5.5 at 0.85.
MARGIN = 0.16
#: Tasks that the rows of one digest or band value are dealt to.
SALTS = 32
#: Bytes hashed at once, up to the end of a word.
BLOCK = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SEEDS = np.random.default_rng(20240229)
_A = _SEEDS.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _SEEDS.integers(0, 2**32, HASHES, dtype=np.uint32)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words, A-Z in lower case; words are what ASCII white space separates."""
    out, at = [], 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            found = _SPACE.search(data, end)
            end = found.start() if found else len(data)
        words = data[at:end].lower().split()
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; the whole sequence is one if it has fewer words; empty without words."""
    h = word_hashes(as_bytes(text))
    if not len(h):
        return h
    k = min(words, len(h))
    n = len(h) - k + 1
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc = (acc ^ (acc >> np.uint64(29))) * _MIX1 + h[j : j + n]
    acc = (acc ^ (acc >> np.uint64(31))) * _MIX2
    return np.unique(acc ^ (acc >> np.uint64(32)))


def minima(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, (_A[:, None] * x[None, at : at + 1024] + _B[:, None]).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = (key ^ (key >> np.uint64(29))) * _MIX1 + rows[:, j]
    return (key ^ (key >> np.uint64(31))).view(np.int64)


def pack_bits(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, two to a byte."""
    x = (low & np.uint32(15)).astype(np.uint8)
    return x[0::2] << 4 | x[1::2]


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarities of packed signatures (n x 10 words of 64 bits), corrected for chance agreement of BITS bits."""
    diff = one[:, None, :] ^ many[None, :, :]
    diff |= diff >> np.uint64(2)
    diff |= diff >> np.uint64(1)
    unlike = np.bitwise_count(diff & np.uint64(0x1111111111111111)).sum(axis=2, dtype=np.int32)
    chance = 2.0**-BITS
    return (1 - unlike / HASHES - chance) / (1 - chance)


_SIG_NAMES = ["doc_id", "text_hash", "n_shingles", "digest", "sig", "bands"]


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_shingles, digest, sig, bands`` of every row; the last three are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, sigs, bands = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text)
                n.append(len(s))
                if not len(s):
                    digests.append(None), sigs.append(None), bands.append(None)
                    continue
                low = minima(s)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sigs.append(pack_bits(low).tobytes())
                bands.append(band_keys(low))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=_SIG_NAMES,
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return map_batches(rows, run, "doc_id long, text_hash long, n_shingles long, digest binary, sig binary, bands array<long>")


def salted(rows: DataFrame, key: str, by: list[str], parts: dict[str, Column], wholes: dict[str, Column]) -> DataFrame:
    """``rows`` with aggregates of their key's group: ``parts`` for each salt, ``wholes`` from those, and back the same way."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    some = rows.groupBy(key, "salt").agg(*[c.alias(name) for name, c in parts.items()])
    whole = some.groupBy(key).agg(*[c.alias(name) for name, c in wholes.items()])
    return rows.join(some.select(key, "salt").join(whole, key), [key, "salt"]).drop("salt")


def bucketed(reps: DataFrame) -> DataFrame:
    """``band, rep, text_hash, n, pivot, pivot_hash``: the classes of all buckets of two or more, the bucket's size and a smallest class."""
    rows = reps.select(F.explode("bands").alias("band"), "rep", "text_hash")
    some = {"n": F.count(F.lit(1)), "pivot": F.min("rep"), "pivot_hash": F.min_by("text_hash", "rep")}
    met = salted(rows, "band", ["rep", "text_hash"], some, {"n": F.sum("n"), "pivot": F.min("pivot"), "pivot_hash": F.min_by("pivot_hash", "pivot")})
    return met.where("n > 1")


IS_PIVOT = "rep = pivot and text_hash = pivot_hash"


def pivot_cells(met: DataFrame) -> DataFrame:
    """``cell, side, rep, text_hash``: each pivot (side 0) with at most about PIVOT_CHUNK of the classes that share a bucket with it."""
    pairs = met.where(f"not ({IS_PIVOT})").groupBy("rep", "text_hash", "pivot", "pivot_hash").agg(F.max("n").alias("n"))
    chunks = F.ceil(F.col("n") / PIVOT_CHUNK).cast("int")
    cell = F.concat_ws("/", *[c.cast("string") for c in (F.col("pivot"), F.col("pivot_hash"), chunks, F.pmod(F.xxhash64("rep", "text_hash"), chunks))])
    pairs = pairs.select(cell.alias("cell"), "rep", "text_hash", "pivot", "pivot_hash")
    own = pairs.select("cell", F.lit(0).alias("side"), F.col("pivot").alias("rep"), F.col("pivot_hash").alias("text_hash")).distinct()
    return own.unionByName(pairs.select("cell", F.lit(1).alias("side"), "rep", "text_hash"))


def cells_of(met: DataFrame, joined: DataFrame) -> DataFrame:
    """``cell, side, rep, text_hash, comp``: what is left of the buckets, given each rep's component (``node, component``) so far.

    Classes outside their pivot's component meet each other and those inside; chunks are by a hash of the class.
    """
    comps = joined.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    known = met.where("n > 2").join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    # a bucket's pivot is in it: the pivot's component is that of the row whose class it is
    known = known.select("band", "rep", "text_hash", "comp", F.when(F.expr(IS_PIVOT), F.col("comp")).alias("own"))
    known = salted(known, "band", ["rep", "text_hash"], {"inner": F.min("own")}, {"inner": F.min("inner")})
    known = known.where("own is null").select("band", "rep", "text_hash", "comp", (F.col("comp") != F.col("inner")).cast("int").alias("is_out"))
    some = {"n": F.count(F.lit(1)), "out": F.sum("is_out")}
    left = salted(known, "band", ["rep", "text_hash"], some, {"n": F.sum("n"), "out": F.sum("out")}).where("out > 0 and n > 1")
    outs, ins = F.ceil(F.col("out") / CHUNK).cast("int"), F.ceil((F.col("n") - F.col("out")) / CHUNK).cast("int")
    outside = F.col("is_out") == 1
    own = F.pmod(F.xxhash64("rep", "text_hash"), F.when(outside, outs).otherwise(ins)).cast("int")
    left = left.select("band", "rep", "text_hash", "comp", outside.alias("outside"), own.alias("own"), outs.alias("outs"), ins.alias("ins"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    others = left.select("*", F.explode(upto("outs")).alias("other"), F.lit(True).alias("other_outside"))
    inside = left.where("outside").select("*", F.explode(upto("ins")).alias("other"), F.lit(False).alias("other_outside"))
    met = others.unionByName(inside)
    both = F.col("outside") & F.col("other_outside")
    low = F.when(both, F.least("own", "other")).when(F.col("outside"), F.col("own")).otherwise(F.col("other"))
    high = F.when(both, F.greatest("own", "other")).when(F.col("outside"), F.col("other")).otherwise(F.col("own"))
    cell = F.concat_ws("/", F.col("band").cast("string"), low.cast("string"), F.concat(F.when(both, F.lit("")).otherwise(F.lit("in")), high.cast("string")))
    side = F.when(both, F.col("own") > F.col("other")).otherwise(~F.col("outside")).cast("int")
    return met.select(cell.alias("cell"), side.alias("side"), "rep", "text_hash", "comp")


def _pivot_candidates(rows: list[dict], threshold: float) -> list[int]:
    """The places of the pivot and of the classes whose signatures may be near it; the pivot comes first."""
    sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint64).reshape(len(rows), -1)
    sizes = np.array([r["n_shingles"] for r in rows], float)
    ok = estimates(sig[:1], sig)[0] >= threshold - MARGIN
    ok &= np.minimum(sizes[0], sizes) >= threshold * np.maximum(sizes[0], sizes) - 1e-9
    ok[0] = True
    found = np.flatnonzero(ok).tolist()
    return found if len(found) > 1 else []


def _alike(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both)


def _pivot_links(rows: list[dict], percent: int) -> Iterator[tuple[int, int]]:
    first = shingles(rows[0]["text"])
    for row in rows[1:]:
        if _alike(first, shingles(row["text"]), percent):
            yield rows[0]["rep"], row["rep"]


class Cell:
    """Classes that meet in a cell, and their pairs that nothing connects yet: across the sides, or all if there is one side.

    A pair that already meets in an earlier band is left to that band's cell.
    """

    def __init__(self, rows: list[dict], threshold: float):
        self.rows, self.n = rows, len(rows)
        sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint64).reshape(self.n, -1)
        bands = np.array([r["bands"] for r in rows], np.int64)
        sides, comps = np.array([r["side"] for r in rows]), np.array([r["comp"] for r in rows], np.int64)
        sizes = np.array([r["n_shingles"] for r in rows], float)
        # the cell's name has both its chunks: of two different ones, only pairs across them are this cell's
        band, low, high = rows[0]["cell"].split("/")
        at = int(np.flatnonzero(bands[0] == int(band))[0])
        firsts, seconds, values = [], [], []
        for i in range(0, self.n, 64):
            est = estimates(sig[i : i + 64], sig)
            ok = est >= threshold - MARGIN
            ok &= np.minimum(sizes[i : i + 64, None], sizes) >= threshold * np.maximum(sizes[i : i + 64, None], sizes) - 1e-9
            ok &= comps[i : i + 64, None] != comps
            ok &= (sides[i : i + 64, None] != sides) if low != high else True
            ok &= np.arange(self.n)[None, :] > np.arange(i, min(self.n, i + 64))[:, None]
            a, b = np.nonzero(ok)
            if at and len(a):
                new = ~(bands[a + i, :at] == bands[b, :at]).any(axis=1)
                a, b = a[new], b[new]
            firsts.append(a + i), seconds.append(b), values.append(est[a, b])
        self.first, self.second, self.value = (np.concatenate(x) for x in (firsts, seconds, values))

    def candidates(self) -> np.ndarray:
        return np.unique(np.concatenate([self.first, self.second]))

    def links(self, percent: int) -> Iterator[tuple[int, int]]:
        """Enough of the confirmed pairs to connect all that confirmed pairs connect, likeliest first."""
        parent = list(range(self.n))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sets: dict[int, np.ndarray] = {}
        for k in np.argsort(-self.value, kind="stable").tolist():
            i, j = int(self.first[k]), int(self.second[k])
            a, b = root(i), root(j)
            if a == b:
                continue
            for x in (i, j):
                if x not in sets:
                    sets[x] = shingles(self.rows[x]["text"])
            if _alike(sets[i], sets[j], percent):
                parent[a] = b
                yield self.rows[i]["rep"], self.rows[j]["rep"]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one cell after the other, from rows sorted by cell."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["cell"] != held[0]["cell"]:
                yield held
                held = []
            if not held or (row["rep"], row["text_hash"]) != (held[-1]["rep"], held[-1]["text_hash"]):  # repeated rows have equal texts
                held.append(row)
    if held:
        yield held


def _links(docs: DataFrame, reps: DataFrame, met: DataFrame, near: Callable, linked: Callable, extra: list[str], name: str) -> DataFrame:
    """``a, b`` of cells of classes: ``near`` picks a cell's classes by signatures alone, ``linked`` has their links by the full sets."""
    kinds = {"cell": pa.string(), "side": pa.int32(), "rep": pa.int64(), "text_hash": pa.int64(), "comp": pa.int64()}
    columns = [c for c in met.columns if c in kinds]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches):
            keep = [rows[i] for i in near(rows)] if len(rows) > 1 else []
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in keep], kinds[c]) for c in columns], names=columns)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches):
            found = list(linked(rows)) if len(rows) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    order = ("cell", "side", "rep", "text_hash")
    sigs = reps.select("rep", "text_hash", "n_shingles", "sig", *extra)
    shown = met.join(sigs, ["rep", "text_hash"]).select(*columns, "n_shingles", "sig", *extra)
    schema = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in columns)
    some = stored(map_batches(shown.repartition("cell").sortWithinPartitions(*order), find, schema), f"{name}-cells")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("text_hash"), "text")
    full = some.join(sigs, ["rep", "text_hash"]).join(texts, ["rep", "text_hash"]).select(*columns, "n_shingles", "sig", *extra, "text")
    return stored(map_batches(full.repartition("cell").sortWithinPartitions(*order), confirm, "a long, b long"), f"{name}-links")


def linked_reps(docs: DataFrame, reps: DataFrame, same: DataFrame, percent: int) -> DataFrame:
    """``node, component`` of the reps that links between classes, or ``same`` (a, b), connect with others."""
    threshold = percent / 100
    met = stored(bucketed(reps), "buckets")
    by_pivot = _links(docs, reps, pivot_cells(met), lambda rows: _pivot_candidates(rows, threshold), lambda rows: _pivot_links(rows, percent), [], "pivot")
    joined = stored(components(by_pivot.unionByName(same)), "by-pivot")
    rest = _links(docs, reps, cells_of(met, joined), lambda rows: Cell(rows, threshold).candidates().tolist(), lambda rows: Cell(rows, threshold).links(percent), ["bands"], "bucket")
    if rest.isEmpty():
        return joined
    return components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest))


def _ends(step: DataFrame) -> DataFrame:
    """Pointers (``node, to``) to smaller nodes, followed to nodes that point at themselves, by doubling."""
    while True:
        ahead = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        jumped = step.join(ahead, "to").select("node", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved"))
        jumped = stored(jumped, "jump")
        step = jumped.select("node", "to")
        if jumped.where("moved").isEmpty():
            return step


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node it is connected with) of the nodes of ``edges (a, b)``; edges to oneself are none.

    Each round points every node at the smallest of itself and its neighbours, follows the pointers to their ends, and contracts
    the edges to those. A node that is left has taken in another one at least, so the nodes that have edges halve; rounds are
    logarithmic, and so are the jumps of each, which double. All tables stay distributed.
    """
    edges = edges.where("a <> b")
    labels = None
    for n in range(max_rounds):
        edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"edges{n}")
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("to"))
        step = _ends(stored(step, f"step{n}"))
        one, two = step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), step.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        edges = edges.join(one, "a").join(two, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b")
        if labels is None:
            labels = step.select("node", F.col("to").alias("component"))
        else:
            moved = step.select(F.col("node").alias("component"), "to")
            labels = stored(labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), f"labels{n}")
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Rows are linked if 100 * shared shingles >= percent * shingles of both; a component is known by its smallest
    doc_id, whose rows are kept. Null and empty texts have no shingles and no links. Rows with a null doc_id have no links
    and a null component, and are kept. Repeated rows give repeated results; rows that share a doc_id but not the text are
    one document, linked by all of its texts (its rows without words stay by themselves). An empty table gives no rows. Other columns are ignored.
    """
    if percent < 80:
        raise ValueError("the bands are laid out for similarities of 0.8 and more")
    sigs = stored(signatures(docs), "signatures")
    linkable = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    members = stored(salted(sigs.where(linkable).select("doc_id", "n_shingles", "digest"), "digest", ["doc_id"], {"rep": F.min("doc_id")}, {"rep": F.min("rep")}), "members")
    firsts = members.where("doc_id = rep").select(F.col("digest").alias("_digest"), "rep").distinct()
    reps = sigs.join(firsts, (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("rep")))
    reps = stored(reps.select("rep", "text_hash", "n_shingles", "sig", "bands", "digest").dropDuplicates(["digest", "rep"]).drop("digest"), "classes")
    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("doc_id", "a")
    same = members.select("doc_id", F.col("rep").alias("b")).join(several, "doc_id").select("a", "b").where("a <> b").distinct()
    found = linked_reps(docs, reps, same, percent).select(F.col("node").alias("rep"), "component")
    out = members.join(found, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = sigs.where(F.col("digest").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, with all their columns; all rows with a null doc_id stay.

    Of repeated rows one stays: the first by text. See ``near_duplicates`` for nulls and empty texts.
    """
    own = {name: f"{name}_{uuid.uuid4().hex}" for name in ("id", "nth")}  # no column of docs is called so
    kept = near_duplicates(docs, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias(own["id"])).distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, docs["doc_id"] == F.col(own["id"])).drop(own["id"])
    first = named.withColumn(own["nth"], F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(own["nth"]) == 1).drop(own["nth"])
    return first.unionByName(docs.where(F.col("doc_id").isNull()))
