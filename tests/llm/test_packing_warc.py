"""Packing and WARC volumes."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from ledgerloom.llm import packing, warc


def test_ids_are_those_of_the_named_tokenizer(hard_rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.load_encoder(public_tokenizers.path(packing.RANKS)).encode_ordinary
    texts = [r[1] or "" for r in hard_rows] + ["it's  we'll\n\n x y \t", "​́", "a" * 3000, "0123456789" * 50, "´`é́"]
    assert [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] == [encode(x) for x in texts]


def test_the_faster_pattern_splits_as_the_named_one():
    rng = random.Random(8)
    parts = ["a", "bc", "É", "́", "日本", "1", "22", "½", "'", "'s", "'ll", "'T", "'vex", "!", "?!", "_", " ", "  ", "\n", "\r\n", "\t", "\u3000", "\u200b", "\x85", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    encoder = packing.load_encoder(public_tokenizers.path(packing.RANKS))
    assert packing.PATTERN != public_tokenizers.PATTERN and encoder._pat_str == packing.PATTERN
    ids = [e.ids for e in packing.named_tokenizer().encode_batch(texts, add_special_tokens=False)]
    assert [packing.encode_text(encoder, x) for x in texts] == ids


@pytest.mark.parametrize("most", [packing.MAX_BYTES, 60])
def test_words_of_a_batch_are_encoded_once(monkeypatch, most):
    """Ids of whole batches, whose equal words are split and merged once, are those of the named tokenizer for each text."""
    rng = random.Random(5)
    parts = ["a", "bc", "É", "́", "日本", "、", "“", "1", "½", "'s", "'T", "'vex", "!", "_", *[" "] * 4, "  ", "\n", "\r\n", "\t", "\u3000", "\u2009", "\u200b", "\x85", "\xa0", "\x1c", "\x00", "<|endoftext|>", "😀"]
    texts = [None, "", " ", "\n", "", *("".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)), "x" * 3000, " "]
    texts += [f"a{chr(c)}a1{chr(c)}1 {chr(c)}!{chr(c)}b's {chr(c)} {chr(c)}y" for c in range(0x3100)]
    want = [e.ids for e in packing.named_tokenizer().encode_batch([x or "" for x in texts], add_special_tokens=False)]
    monkeypatch.setattr(packing, "MAX_BYTES", most)
    path, whole = public_tokenizers.path(packing.RANKS), pa.array(texts, pa.string())
    for at in range(0, len(texts), 700):
        assert [x.tolist() for x in packing.ids_of_texts(whole.slice(at, 700), path)] == want[at : at + 700]
    assert packing.ids_of_texts(whole.slice(0, 2), path)[1].size == 0 and packing.ids_of_texts(whole.slice(0, 0), path) == []


def test_few_words_reach_the_encoder(monkeypatch):
    """A word that comes again costs no second match."""
    class Counting:
        def __init__(self, encoder):
            self.encoder, self.seen, self.max_token_value = encoder, 0, encoder.max_token_value

        def encode_to_numpy(self, text, **options):
            self.seen += len(text)
            return self.encoder.encode_to_numpy(text, **options)

        def decode_single_token_bytes(self, i):
            return self.encoder.decode_single_token_bytes(i)

    path = public_tokenizers.path(packing.RANKS)
    encoder = Counting(packing.load_encoder(path))
    monkeypatch.setattr(packing, "load_encoder", lambda *_: encoder)
    found = packing.ids_of_texts(pa.array([" so it is said again" * 50] * 20), path)
    assert encoder.seen == len(" so it is said again") and len({x.tobytes() for x in found}) == 1


def test_places_are_in_the_order_of_the_scores():
    rng = np.random.default_rng(6)
    score = np.append(rng.exponential(9, 500), [0.1, 0.1, 1e-30, 3e38]).astype(np.float32).astype(np.float64)
    b = rng.permutation(len(score)) << 33
    place = packing.places(score, b)
    assert (np.diff(score[np.argsort(place)]) >= 0).all() and len(set(place.tolist())) == len(place) and (place > 0).all()


def test_markers_get_the_named_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    m = "<|endoftext|>"
    texts = [f"x{m}y", f"a  {m}  b", m * 3, f"it{m}'s\n\n{m}", m[:-1], m.upper(), f"é́{m}😀"]
    want = {i: [*e.ids, packing.END] for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False))}
    rows = packing.cut_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], np.uint16).tolist() for r in rows} == want


@pytest.mark.parametrize("space", [" ", "\n", "\t", " \n", "\u3000"])
def test_very_long_white_space(space):
    """At the length that goes to the named tokenizer and beyond; the faster one fails at a million."""
    encoder = packing.load_encoder(public_tokenizers.path(packing.RANKS))
    for n in (packing.LONG_SPACE // len(space) - 1, packing.LONG_SPACE, 1_200_000):
        for text in (space * n, f"a b{space * n}c  d", f"{space * n}<|endoftext|>{space * 3}x"):
            if n < packing.LONG_SPACE or n > packing.LONG_SPACE and text[0] == "a":
                assert packing.encode_text(encoder, text) == packing.named_tokenizer().encode(text, add_special_tokens=False).ids
            else:
                assert encoder.decode(packing.encode_text(encoder, text)) == text


def test_a_document_of_white_space_is_packed(spark):
    rows = [(1, " " * 1_000_000), (2, "some words here"), (3, "x" + "\n" * 1_000_000 + "y")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3}
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == {r["doc_tokens"] for r in got if r["doc_id"] == 1}.pop()


def check_packed(rows, docs, window=1024):
    encode = packing.load_encoder(public_tokenizers.path(packing.RANKS)).encode_ordinary
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    short = 0
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
        short += at & (at - 1) != 0
    assert short == 0
    want = defaultdict(list)
    for i, text in docs:
        want[i].append([*encode(text or ""), packing.END])
    for i, ids in want.items():
        own = sorted(pieces[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == sum(map(len, ids))
        if len(ids) == 1:
            at = 0
            for r in own:
                part = np.array(ids[0][r["start"] : r["start"] + r["length"]], "<u4")
                assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids[0]), zlib.crc32(part.tobytes()))
                at += r["length"]
    assert set(pieces) == set(want)


def test_packing_covers_each_id_once(spark, hard_docs, hard_rows, no_docs):
    check_packed(packing.pack(hard_docs).collect(), [(r[0], r[1]) for r in hard_rows])
    assert packing.pack(no_docs).count() == 0


def test_packing_with_small_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_packed(packing.pack(docs, shard_pieces=16).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_best_neighbours_come_from_several_shards(spark, sf_dir):
    """Recall of the best BM25 neighbour of all pieces, with shards so small that one of them can't have it."""
    pieces = packing.stored(packing.cut_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")), "pieces").where("ids is not null")
    df, n, mean = packing.document_frequencies(pieces)
    idf = packing.idf_of(df, n)
    rows = pieces.orderBy("piece").collect()
    index = packing.Shard([np.frombuffer(r["ids"], np.uint16) for r in rows], idf, mean)
    np.fill_diagonal(index.m, 0)
    at = {r["piece"]: i for i, r in enumerate(rows)}
    size = max(2, n // 20)
    best = {r["a"]: r["b"] for r in packing.best_neighbours(packing.term_vectors(pieces, idf, mean, df >= 2), idf, mean, size).collect()}
    found = [index.m[i, at[best[p]]] >= index.m[i].max() * 0.999 for p, i in at.items() if p in best]
    dealt = packing.deal(pieces, df, idf, mean, size).collect()
    group = {r["piece"]: r["together"] for r in dealt}
    assert len(dealt) == n and all(group[a] == group[b] for a, b in best.items())
    assert len(found) > 0.9 * n and sum(found) > 0.4 * n


def test_copies_of_a_piece_are_its_neighbours():
    """Equal vectors are one in the search; every piece still has another one of the highest score, by brute force."""
    rng = np.random.default_rng(2)
    kinds = [np.unique(rng.integers(0, 60, rng.integers(1, 30))).astype(np.uint16) for _ in range(12)] + [np.array([99], np.uint16), np.array([77], np.uint16)]
    pieces = [kinds[i] for i in [0, 1, 1, 2, 3, 0, 4, 5, 6, 1, 7, 8, 9, 10, 11, 12, 13, 13]]
    kept, of = packing.equal_rows([p.tobytes() for p in pieces])
    idf = np.linspace(0.5, 3, packing.VOCABULARY * 2)[::2].astype(np.float32) + np.arange(packing.VOCABULARY, dtype=np.float32) % 7
    alone = [pieces[i] for i in kept]
    t, owner = np.concatenate(alone), np.repeat(np.arange(len(alone)), [len(p) for p in alone])
    best, score = packing.best_in_shard(t, idf[t], owner, of)
    for i, p in enumerate(pieces):
        want = [0.0 if i == j else float(idf[np.intersect1d(p, q)].sum()) for j, q in enumerate(pieces)]
        assert abs(score[i] - max(want)) < 1e-3
        assert score[i] == 0 or (best[i] != i and abs(want[best[i]] - max(want)) < 1e-3)
    assert score[15] == 0 and best[16] == 17 and best[17] == 16


def test_shard_scores_are_bm25():
    rng = np.random.default_rng(1)
    pieces = [rng.integers(0, 30, rng.integers(3, 40)).astype(np.uint16) for _ in range(25)]
    df = np.zeros(packing.VOCABULARY, np.int64)
    for p in pieces:
        df[np.unique(p)] += 1
    mean = float(np.mean([len(p) for p in pieces]))
    idf = packing.idf_of(df, len(pieces))
    shard = packing.Shard(pieces, idf, mean)
    for s in range(len(pieces)):
        want = []
        for p in pieces:
            total = 0.0
            for t in np.unique(pieces[s]):
                tf = (p == t).sum()
                total += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(p) / mean)) if tf else 0.0
            want.append(total)
        assert np.allclose(shard.scores(s), want, rtol=1e-4)


def test_neighbours_come_first():
    a = [np.full(100, t, np.uint16) for t in (1, 2, 1, 2)]
    idf = np.zeros(packing.VOCABULARY, np.float32)
    idf[[1, 2]] = 1
    filler = packing.Filler(idf, 100.0, window=200)
    windows = list(filler.shard([(i, 0, x, 100) for i, x in enumerate(a)]))
    assert [[r[0] for r in w] for w in windows] == [[0, 2], [1, 3]]


def records(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        payload = bytes(rng.randrange(256) for _ in range(rng.randrange(0, 1500)))
        import hashlib

        out.append((i, payload, warc.make_record(i, f"http://x/{i}\r\nEvil: 1", payload, hashlib.sha1(payload).hexdigest(), len(payload), None)))
    return out


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_whole(compress):
    made = records(20)
    data = b"".join(warc.gzip_member(r) if compress else r for _, _, r in made)
    found = list(warc.salvage(data))
    assert [f.reason for f in found] == [None] * 20
    rows = [warc._row("v", f, True) for f in found]
    assert [(r[7], r[12]) for r in rows] == [(i, p) for i, p, _ in made]


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("harm", ["flip", "cut", "insert", "front"])
def test_salvage_recovers_later_records_and_logs_the_gap(compress, harm):
    made = records(12, 5)
    parts = [warc.gzip_member(r) if compress else r for _, _, r in made]
    start = sum(map(len, parts[:6]))
    data = bytearray(b"".join(parts))
    if harm == "flip":
        data[start + len(parts[6]) // 2] ^= 0xFF
        lost = {6}
    elif harm == "cut":
        del data[start + 20 : start + 60]
        lost = {6}
    elif harm == "insert":
        data[start:start] = b"\x1f\x8b\x08junk WARC/1.x not one" * 3
        lost = set()
    else:
        data[:3] = b"???"
        lost = {0}
    found = list(warc.salvage(bytes(data)))
    ids = [warc._id(f.headers["warc-record-id"]) for f in found if f.reason is None]
    assert ids == [i for i in range(12) if i not in lost]
    gaps = [f for f in found if f.reason]
    assert len(gaps) == 1
    covered = sorted((f.start, f.end) for f in found)
    at = 0
    for a, b in covered:
        assert a == at
        at = b
    assert at == len(data)


def salvaged(data):
    found = list(warc.salvage(bytes(data)))
    return [warc._id(f.headers["warc-record-id"]) for f in found if f.reason is None], [f for f in found if f.reason]


def text_records(n):
    return [warc.make_record(i, f"http://x/{i}", b" ".join(b"w%d" % ((i * 7 + k * k) % 5000) for k in range(3000)), "0" * 40, 5, None) for i in range(n)]


def test_members_of_many_records_are_salvaged():
    parts = text_records(5)
    whole = warc.gzip_member(b"".join(parts))
    assert salvaged(whole) == ([0, 1, 2, 3, 4], [])
    # cut off: what came out before the end is read, the record that was cut is a gap in the plain bytes
    ids, gaps = salvaged(whole[:-20])
    assert ids == [0, 1, 2, 3, 4][: len(ids)] and len(ids) >= 4 and any("doesn't end" in g.reason for g in gaps)
    ids, gaps = salvaged(whole[: len(whole) // 2])
    assert ids[:2] == [0, 1] and len(gaps) == 2 and {g.inner_start is None for g in gaps} == {True, False}
    # a flipped byte: the records before it, at least, and all of the members that follow
    for at in (0.3, 0.5, 0.7, 0.9):
        data = bytearray(whole)
        data[int(len(whole) * at)] ^= 0x10
        ids, gaps = salvaged(bytes(data) + whole)
        assert ids[-5:] == [0, 1, 2, 3, 4] and ids[: int(5 * at) - 1] == list(range(int(5 * at) - 1)) and gaps
    # only the checksum is wrong
    assert salvaged(whole[:-6] + bytes([whole[-6] ^ 1]) + whole[-5:])[0] == [0, 1, 2, 3, 4]


def test_damage_inside_the_plain_bytes_of_a_valid_member():
    parts = text_records(5)
    parts[3] = parts[3].replace(b"w1", b"W1", 1)
    ids, gaps = salvaged(warc.gzip_member(b"".join(parts)))
    assert ids == [0, 1, 2, 4] and [(g.reason, g.inner_start, g.inner_end) for g in gaps] == [("block digest differs", sum(map(len, parts[:3])), sum(map(len, parts[:4])))]
    ids, gaps = salvaged(b"".join(parts))
    assert ids == [0, 1, 2, 4] and len(gaps) == 1


def test_volumes_of_hard_rows(spark):
    from pyspark.sql import functions as F

    long = "x" * 3_000_000 + " é"
    pages = spark.createDataFrame([(1, "u", long), (2, "u", long), (None, None, None)], "page_id bigint, url string, html string")
    pages = pages.select("*", *[F.lit("z").alias(c) for c in ("payload", "digest", "n_bytes", "keeper", "refers_to", "volume", "content", "gap")])
    volumes = warc.write_volumes(warc.revisits(pages)).withColumn("start", F.lit(5))
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["gap"]) for r in warc.read_volumes(volumes).collect()}
    n = len(long.encode())
    assert got == {1: ("revisit", 2, n, None), 2: ("response", None, n, None), None: ("response", None, 0, None)}
    empty = spark.createDataFrame([(None, None), ("v", b"")], "volume string, content binary")
    assert warc.read_volumes(empty).count() == 0


def test_salvage_of_nothing():
    assert list(warc.salvage(b"")) == []
    only = list(warc.salvage(b"no archive at all"))
    assert len(only) == 1 and (only[0].start, only[0].end) == (0, 17)


def test_revisits(spark):
    big, other, small = "x" * 1000, "é" * 700, "y" * 999
    rows = [(1, "u", big), (2, None, big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""), (7, "u", other), (8, "u", other), (None, "u", big), (9, "u", big), (9, "u", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for compress in (True, False):
        got = warc.read_volumes(warc.write_volumes(warc.revisits(pages), compress)).collect()
        assert all(r["gap"] is None for r in got)
        kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
        assert kinds == [
            (0, "revisit", 9, 1000), (1, "revisit", 9, 1000), (2, "revisit", 9, 1000), (3, "response", None, 999), (4, "response", None, 999), (5, "response", None, 0),
            (6, "response", None, 0), (7, "revisit", 8, 1400), (8, "response", None, 1400), (9, "response", None, 1000), (9, "response", None, 1000),
        ]
    assert warc.read_volumes(warc.write_volumes(warc.revisits(pages.where("page_id < 0")))).count() == 0
