"""Media columns and token counts."""

import cmath
import hashlib
import io
import math
import random
import wave
import zlib

import numpy as np

from ledgerloom.llm import media, token_counts
from ledgerloom.llm.common import as_bytes


def test_round_trip():
    for data in (b"", b"x", bytes(range(256)) * 3, b"a" * 192):
        payload = media.pad(data)
        assert len(payload) % 192 == 0 and len(payload) >= 192 and payload[: len(data)] == data and set(payload[len(data) :]) <= {32}
        with wave.open(io.BytesIO(media.to_wav(payload))) as w:
            assert w.getsampwidth() == 1 and w.getnchannels() == 1
        assert media.from_wav(media.to_wav(payload)) == (payload, media.RATE)


def test_fingerprint_is_of_whole_payload_and_bounded_in_blocks(monkeypatch):
    data = media.pad(bytes(random.Random(4).randrange(256) for _ in range(40_000)))
    whole = media.describe(data)
    monkeypatch.setattr(media, "BLOCK_FRAMES", 17)
    blocks = media.describe(data)
    assert whole[0] == blocks[0] and len(whole[1]) > 50
    assert media.describe(data[:-192])[0] != whole[0]
    assert (whole[1][1:] >= whole[1][:-1]).all()


def test_peaks_equal_a_naive_transform():
    """Each bin of each frame as a sum of cosines and sines, and each neighbourhood looked through."""
    rng = random.Random(8)
    data = media.pad(bytes(int(128 + 60 * math.sin(k / 3) + 40 * math.sin(k * 1.3 + k * k / 40000) + rng.randrange(20)) for k in range(192 * 6)))
    n, half = (len(data) - media.UNIT) // media.HOP + 1, media.UNIT // 2
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / (media.UNIT - 1)) for k in range(media.UNIT)]
    power = []
    for f in range(n):
        x = [(data[f * media.HOP + k] - 128) * window[k] for k in range(media.UNIT)]
        power.append([abs(sum(v * cmath.exp(-2j * math.pi * b * k / media.UNIT) for k, v in enumerate(x))) ** 2 for b in range(1, half + 1)])
    want = []
    for f in range(n):
        for b in range(half):
            around = [power[g][c] for g in range(max(0, f - media.REACH), min(n, f + media.REACH + 1)) for c in range(max(0, b - media.REACH_BINS), min(half, b + media.REACH_BINS + 1))]
            if power[f][b] >= max(around) and power[f][b] > media.LOUD * sum(power[f]) / half:
                want.append((f, b + 1))
    frames, bins = media.spectral_peaks(np.frombuffer(data, np.uint8))
    assert list(zip(frames.tolist(), bins.tolist(), strict=True)) == want and len(want) > 3
    pairs = sorted((want[i][0], want[i][1] << 13 | want[j][1] << 6 | want[j][0] - want[i][0]) for i in range(len(want)) for j in range(i + 1, min(len(want), i + media.FAN + 1)) if want[j][0] - want[i][0] <= media.SPAN)
    t, c = media.fingerprint(np.frombuffer(data, np.uint8))
    assert list(zip(t.tolist(), c.tolist(), strict=True)) == pairs


def test_a_frame_can_have_several_peaks():
    k = np.arange(192 * 8)
    rise = 40 * np.exp(-(((k - 768) / 200) ** 2))
    x = 128 + rise * np.sin(2 * np.pi * 10 * k / 192) + rise * np.sin(2 * np.pi * 60 * k / 192)
    frames, bins = media.spectral_peaks(np.round(x).astype(np.uint8))
    assert {10, 60} <= set(bins.tolist()) and len(set(frames.tolist())) < len(frames)


def test_the_media_table_is_stored(spark, hard_docs, hard_rows):
    table = media.stored(media.media_column(hard_docs), "media")
    assert table.inputFiles() and table.count() == len(hard_rows)
    assert sorted(map(str, media.describe_media(table).collect())) == sorted(map(str, media.media_features(hard_docs).collect()))


def test_query_columns(spark, hard_docs, hard_rows, no_docs):
    got = media.media_features(hard_docs).collect()
    assert len(got) == len(hard_rows)
    texts = {}
    for r in hard_rows:
        texts.setdefault(r[0], set()).add(r[1])
    by_payload = {}
    for r in got:
        want = {hashlib.sha256(media.pad(as_bytes(t))).hexdigest(): as_bytes(t) for t in texts[r["doc_id"]]}
        data = want[r["payload_sha256"]]
        payload = media.pad(data)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(payload), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] == len(media.to_wav(payload)) and r["media_sha256"] == hashlib.sha256(media.to_wav(payload)).hexdigest()
        by_payload.setdefault(r["payload_sha256"], set()).add(r["feature"])
    assert all(len(v) == 1 for v in by_payload.values())
    assert media.media_features(no_docs).count() == 0
    assert media.media_column(hard_docs).count() == len(hard_rows)


def plain(pieces, word, byte):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        top = (best[-1][0] + n * byte, best[-1][1] + n)
        for start in range(end - 1, -1, -1):
            p = pieces.get(word[start:end])
            if p is not None:
                s, c = best[start][0] + p, best[start][1] + 1
                if s > top[0] or (s == top[0] and c <= top[1]):
                    top = (s, c)
        best.append(top)
    return best[-1][1], best[-1][0]


def test_trie_equals_plain_dynamic_programming():
    import public_tokenizers

    pieces = token_counts.load_pieces(public_tokenizers.path(token_counts.MODEL))
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshé日😀.-") for _ in range(rng.randint(1, 20))) for _ in range(400)] + ["the", "there", "thereby"]
    small = token_counts.PrefixTrie(pieces, max_nodes=60)
    large = token_counts.PrefixTrie(pieces)
    for w in words:
        want = plain(pieces, token_counts.MARK + w, large.byte)
        assert small.insert(w) == want == large.insert(w) == large.forward(w)


def test_shared_prefixes_are_scored_once():
    trie = token_counts.PrefixTrie({"ab": -1.0, "a": -2.0, "b": -2.0, "c": -1.0}, prefix="")
    trie.insert("abc")
    n = len(trie.score)
    trie.insert("abb")
    assert len(trie.score) == n + 1 and trie.insert("abc") == (2, -2.0)


def test_counts(spark, hard_docs, hard_rows, no_docs):
    got = token_counts.token_counts(hard_docs).collect()
    assert len(got) == len(hard_rows)
    for r in got:
        if r["doc_id"] in (5, 6, 7):
            assert (r["n_pretokens"], r["n_tokens"], r["log_prob"]) == (0, 0, 0.0)
        if r["doc_id"] == 14:
            assert r["n_pretokens"] == 4
    assert token_counts.token_counts(no_docs).count() == 0
