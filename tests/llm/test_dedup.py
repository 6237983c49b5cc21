"""Near duplicates, repeated substrings, decontamination and the pipeline against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import decontaminate, neardup, suffixdedup

DOCS = "doc_id bigint, text string"


def words(rng, n, size=3000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def near_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, percent):
    sets = {i: near_set(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def mutated(rng, base, n):
    w = list(base)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"m{rng.randrange(10**6)}"
    return w


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("chunk", [4, 384])
def test_near_duplicates(spark, percent, chunk, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rng = random.Random(percent)
    rows, bases = [], [words(rng, 120) for _ in range(4)]
    for k in range(160):
        base = bases[k % 4]
        rows.append((k, " ".join(mutated(rng, base, rng.randrange(0, 6)))))
    chain = words(rng, 200)
    for k in range(160, 175):  # each is near the one before only
        chain = mutated(rng, chain, 3)
        rows.append((k, "\t".join(chain).upper()))
    rows += [(200 + k, " ".join(words(rng, 60))) for k in range(20)] + [(300, "a b c"), (301, "A  b c "), (302, "a b"), (303, ""), (304, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), percent).collect()
    want, sizes = brute_components(rows, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_a_documents_texts_all_link_it(spark, parts):
    """Rows that share a doc_id: each text's links count, however the rows come."""
    rng = random.Random(4)
    a, b, c = (words(rng, 100) for _ in range(3))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(mutated(rng, b, 1))), (3, " ".join(a)), (3, " ".join(c)), (4, " ".join(mutated(rng, c, 1))), (9, " ".join(words(rng, 100))), (1, None)]
    for order in (rows, rows[::-1]):
        got = neardup.near_duplicates(spark.createDataFrame(order, DOCS).repartition(parts)).collect()
        assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}


def test_a_large_bucket_of_copies_needs_no_cells(spark):
    """Copies of one text, near to it: pivots link them all, and no cell of two chunks is left."""
    rng = random.Random(7)
    base = words(rng, 300)
    rows = [(k, " ".join(mutated(rng, base, 1))) for k in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r["component_id"] for r in neardup.near_duplicates(docs).collect()} == {0}
    sigs = neardup.signatures(docs).select(neardup.F.col("doc_id").alias("rep"), "text_hash", "n_shingles", "sig", "bands")
    met = neardup.stored(neardup.bucketed(sigs), "buckets")
    assert neardup.cells_of(met, sigs.selectExpr("rep as node", "0L as component")).count() == 0
    assert neardup.pivot_cells(met).groupBy("cell").count().agg({"count": "max"}).first()[0] <= 2 * neardup.CHUNK


def test_near_duplicates_of_hard_texts(spark, hard_docs, hard_rows, no_docs):
    got = neardup.near_duplicates(hard_docs).collect()
    assert len(got) == len(hard_rows)
    want, sizes = brute_components([(r[0], r[1]) for r in hard_rows], 85)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], sizes[r["doc_id"]])
    assert neardup.near_duplicates(no_docs).count() == 0
    one = neardup.keep_one(hard_docs)
    assert one.columns == hard_docs.columns
    ids = [r["doc_id"] for r in one.collect()]
    assert len(set(i for i in ids if i is not None)) == len([i for i in ids if i is not None]) and ids.count(None) == 2


def test_estimates_are_unbiased():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    for share in (0.5, 0.85, 1.0):
        n = int(1000 * 2 * share / (1 + share))
        a, b = np.unique(pool[:1000]), np.unique(np.concatenate([pool[:n], pool[2000 : 3000 - n]]))
        sig = [neardup.pack_bits(neardup.minima(np.sort(x))).view(np.uint64)[None] for x in (a, b)]
        assert abs(neardup.estimates(*sig)[0, 0] - share) < 0.12


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(x, x) == root(x) for x in parent)
    assert neardup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_cut(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted({(i, t or "") for i, t in rows if i is not None}):
        data = text.encode()
        cover = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                cover[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, c in zip(data, cover, strict=True) if not c)
        spans = sum(1 for k in range(len(cover)) if cover[k] and (not k or not cover[k - 1]))
        out[i] = (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages_corpus(seed):
    rng = random.Random(seed)
    alphabet = "abcdef é日"
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [text(n) for n in (99, 100, 101, 130, 400)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += [text(rng.randrange(0, 80)), rng.choice(shared)]
        rows.append((k * 3, "".join(parts)))
    rows += [(500, "ab" * 300), (501, "a" * 350), (502, "a" * 99), (503, rows[5][1]), (504, None), (505, "")]
    return rows


@pytest.mark.parametrize("max_contexts", [2, 1500])
def test_repeats_are_removed(spark, max_contexts):
    rows = passages_corpus(max_contexts)
    got = suffixdedup.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(4), max_contexts).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_cut(rows)


def test_common_anchors_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "SAMPLE", 1)
    monkeypatch.setattr(suffixdedup, "COMMON_LEAST", 5)
    rows = passages_corpus(8)
    assert len(suffixdedup.common_anchors(spark.createDataFrame(rows, DOCS))) > 0
    got = suffixdedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {i: v[1] for i, v in brute_cut(rows).items()}


def test_repeats_of_hard_texts(spark, hard_docs, hard_rows, no_docs):
    got = suffixdedup.remove_repeats(hard_docs).collect()
    assert len(got) == len(hard_rows)
    want = brute_cut([(r[0], r[1]) for r in hard_rows])
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
    assert suffixdedup.remove_repeats(no_docs).count() == 0
    cut = suffixdedup.cut_texts(hard_docs)
    assert cut.columns == hard_docs.columns
    texts = {}
    for r in cut.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert 2 not in texts and 5 in texts and 6 in texts and len(texts[None]) == 2
    assert suffixdedup.cut_texts(no_docs).count() == 0


def test_letters_stay_whole():
    data = "éé".encode() * 60
    assert suffixdedup._whole_letters(data, [(1, 3)]) == []
    assert suffixdedup._whole_letters(data, [(1, 5)]) == [(2, 4)]
    assert suffixdedup._whole_letters(data, [(0, len(data))]) == [(0, len(data))]


def test_interval_expansion_equals_sorting():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50, 400):
        text = np.append(rng.integers(1, 4, n), 0)
        order = suffixdedup.suffix_array(text, 6)
        boundary = suffixdedup.equal_prefixes(text, order, 6)
        keys = [tuple(text[i : i + 6]) for i in order]
        want = [True] + [keys[k][: 6] != keys[k - 1][: 6] for k in range(1, len(keys))]
        inside = [order[k] + 6 <= len(text) and order[k - 1] + 6 <= len(text) for k in range(1, len(keys))]
        assert all(boundary[k + 1] == want[k + 1] for k in range(len(inside)) if inside[k])
        assert keys == sorted(keys) or len(set(keys)) < len(keys)


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        assert decontaminate.common_subsequence(a, decontaminate.bit_masks(b), len(b)) == brute_lcs(a, b)


def leak_corpus():
    rng = random.Random(9)
    items = [(k, " ".join(words(rng, rng.randrange(15, 60), 900))) for k in range(30)] + [(90, "tiny item"), (91, None), (92, "just six words of an item"), (None, "a b c d e f g h i j")]
    rows = []
    for k in range(150):
        body = words(rng, rng.randrange(0, 400), 900)
        if k % 3 == 0:
            own = items[(k // 3) % 30][1].split()
            if k % 2:  # a paraphrase: a seventh of the words changed, some put in
                own = [w if rng.random() > 1 / 7 else f"p{rng.randrange(99)}" for w in own]
                own.insert(len(own) // 2, "really")
            at = rng.randrange(len(body) + 1)
            body[at:at] = own
        rows.append((k, " ".join(body).title()))
    rows += [(400, "nothing here but Just, six words: of an item!"), (401, "tiny item"), (404, "one line\n Tiny, item!\nand one more"), (405, "a tiny item in a line"), (402, None), (403, "")]
    return rows, items


def brute_leaks(rows, items):
    known = [(i, decontaminate.words_of(t)) for i, t in items if i is not None and t]
    out = set()
    for d, text in rows:
        w = decontaminate.words_of(text)
        for i, own in known:
            n = len(own)
            if n < decontaminate.LEAST_WORDS:
                if any(decontaminate.words_of(line) == own for line in (text or "").splitlines()):
                    out.add((d, i))
                continue
            if n < decontaminate.SHORT_WORDS:
                if any(w[k : k + n] == own for k in range(len(w))):
                    out.add((d, i))
                continue
            for at in range(0, max(1, len(w)), decontaminate.BLOCK):
                region = w[max(0, at - n) : at + 2 * decontaminate.BLOCK + n]
                share = brute_lcs(region, own) / n
                answer = brute_lcs(region, own[-5:]) / 5
                if share >= decontaminate.NEARLY_ALL or (share >= decontaminate.MIN_SHARE and answer >= decontaminate.MIN_ANSWER):
                    out.add((d, i))
                    break
    return out


def test_words_are_numbered_as_the_pattern_finds_them(monkeypatch):
    """Without a match for each word; every character counts as the pattern has it, and chunks change nothing."""
    rng = random.Random(4)
    parts = ["a", "bC", "É", "ΑΣ", "Σ", "İ", "e\u0301", "日本", "½", "7", "_", "'", "-", " ", "  ", "\n", "\x00", "\x1c", "\u3000", "\u200b", "😀"]
    texts = [None, "", "  ", "\n_", *("".join(rng.choice(parts[: rng.choice([2, len(parts)])]) for _ in range(rng.randrange(40))) for _ in range(2000))]
    texts += ["".join(f"x{chr(c)}Y{chr(c)} " for c in range(at, at + 4096) if not 0xD800 <= c < 0xE000) for at in range(0, 0x20000, 4096)]
    vocabulary = {w: k for k, w in enumerate(sorted({w for t in texts[::2] for w in decontaminate.words_of(t)}))}
    want = [[vocabulary.get(w, len(vocabulary)) for w in decontaminate.words_of(t)] for t in texts]
    known = pa.array(list(vocabulary), pa.string())
    for size in (1 << 20, 7):
        monkeypatch.setattr(decontaminate, "CHARS", size)
        for texts_, want_ in ((pa.array(texts), want), (pa.array(texts)[3:90], want[3:90])):
            assert [np.frombuffer(x, np.uint32).tolist() for x in decontaminate.word_numbers(texts_, known).to_pylist()] == want_


def test_passes_over_the_items_change_nothing(spark):
    rows, items = leak_corpus()
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id bigint, text string")
    one, many = (sorted(map(tuple, decontaminate.leaks(docs, bench, n).collect())) for n in (1000, 10))
    assert one == many and len(one) > 50


@pytest.mark.parametrize("max_items", [1000, 10])
def test_leaks(spark, max_items):
    rows, items = leak_corpus()
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench, max_items).collect()}
    want = brute_leaks(rows, items)
    assert got <= want
    assert len(got) >= 0.95 * len(want)
    planted = {(k, (k // 3) % 30) for k in range(0, 150, 3) if not k % 2} | {(400, 92), (401, 90), (404, 90)}
    assert planted <= got
    kept = {r["doc_id"] for r in decontaminate.keep_uncontaminated(docs, bench, max_items).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in got}


def test_leaks_of_hard_texts(spark, hard_docs, hard_rows, no_docs):
    bench = spark.createDataFrame([(1, hard_rows[0][1]), (2, None)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(hard_docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (None, 1)}
    assert decontaminate.leaks(no_docs, bench).count() == 0
    assert decontaminate.leaks(hard_docs, bench.where("item_id = 2")).count() == 0
    assert decontaminate.leaks(hard_docs, bench.where("item_id > 2")).count() == 0
    assert decontaminate.keep_uncontaminated(hard_docs, bench).columns == hard_docs.columns


def test_directions_span_the_benchmark(spark):
    rows, items = leak_corpus()
    bench, vocabulary = decontaminate.load_bench(spark.createDataFrame(items, "item_id bigint, text string"))
    encoded = decontaminate.encode(spark.createDataFrame(rows, DOCS), bench, vocabulary)
    idf = decontaminate.inverse_frequencies(encoded, bench)
    n = len(rows)
    for k, word in enumerate(sorted(vocabulary)[:20]):
        df = sum(word in decontaminate.words_of(t) for _, t in rows)
        assert abs(idf[vocabulary[word]] - np.log((n + 1) / (df + 1))) < 1e-9
    v = decontaminate.latent_directions(encoded, bench, idf)
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-6)


def dense_passages(ids, idf):
    """TF-IDF passages of a text as rows of length 1."""
    passages = decontaminate.passages_of(decontaminate.blocks_of(ids, len(idf) - 1), len(idf) - 1)
    rows = np.stack([np.bincount(p, minlength=len(idf)) for p in passages])[:, :-1] * idf[:-1]
    rows = rows[rows.any(axis=1)]
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


@pytest.mark.parametrize("size", [40, 900])
def test_gram_of_passages(size):
    rng = np.random.default_rng(size)
    lengths = [0, 1, 23, 24, 25, 48, 49, 500, decontaminate.BLOCK * (decontaminate.FIT_BLOCKS * 2 + 3), *rng.integers(1, 200, 300)]
    texts = [np.minimum(rng.geometric(4 / size, n), size) for n in lengths] + [np.full(70, size)]
    idf = np.append(rng.uniform(0.1, 5, size), 0)
    omega = rng.standard_normal((size, 12))
    g = decontaminate.Gram(idf, omega)
    for t in texts:
        g.add(t)
    a = np.concatenate([dense_passages(t, idf) for t in texts])
    want = a.T @ (a @ omega)
    assert np.allclose(g.product(), want, atol=1e-5 * np.abs(want).max()) and g.passages == len(a)


def test_directions_are_those_of_all_documents(spark):
    rng = np.random.default_rng(4)
    size, n = 300, 24_000
    words = [[int(x) for x in rng.integers(0, size, 20)] for _ in range(40)] + [list(range(size))]
    bench = decontaminate.Bench(list(range(len(words))), words, size, {})
    texts = np.minimum(rng.geometric(0.02, (n, 10)), size).astype(np.uint32)
    encoded = spark.createDataFrame([(t.tobytes(),) for t in texts], "words binary").repartition(4)
    idf = decontaminate.inverse_frequencies(encoded, bench)
    items = np.concatenate([dense_passages(np.array(w), idf) for w in words])
    docs = np.concatenate([dense_passages(t.astype(np.int64), idf) for t in texts])
    gram = decontaminate.BENCH_WEIGHT * items.T @ items / len(items) + docs.T @ docs / len(docs)
    basis, _ = np.linalg.qr(gram @ np.random.default_rng(3).standard_normal((size, decontaminate.RANK + decontaminate.OVERSAMPLE)))
    values, u = np.linalg.eigh(basis.T @ gram @ basis)
    v = decontaminate.latent_directions(encoded, bench, idf)
    assert np.allclose(np.diag(v.T @ gram @ v), values[::-1][: decontaminate.RANK], rtol=1e-4)
    want = basis @ u[:, ::-1][:, :40]
    assert np.abs(v[:, :40] @ v[:, :40].T - want @ want.T).max() < 1e-4
