"""Language identification, toxicity and sharding."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import langid, queries, sharding, toxicity


def test_held_out_languages(spark):
    got = queries.op5_langid(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_languages_of_hard_texts(spark, hard_docs, hard_rows, no_docs):
    rng = np.random.default_rng(0)
    windows = rng.integers(97, 122, (64, langid.WINDOW)).astype(np.uint8)
    windows[32:] = rng.integers(110, 122, (32, langid.WINDOW))
    net = langid.train(windows, np.array([0] * 32 + [1] * 32), ["aa", "zz"])
    got = langid.predict(hard_docs, net).collect()
    assert len(got) == len(hard_rows)
    for r in got:
        if r["doc_id"] in (5, 6, 7, 15):
            assert r["lang_pred"] == "und"
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in ("aa", "zz")
    assert langid.predict(no_docs, net).count() == 0
    assert langid.fit(no_docs) is None
    assert {r["lang_pred"] for r in langid.predict(hard_docs, None).collect()} == {"und"}


def test_numbers_are_no_letters(spark):
    rows = [(1, "½ 12"), (2, "Ⅷ ①"), (3, "² ٣ _"), (4, "½ ñ"), (5, "日"), (6, "ª"), (7, None)]
    net = langid.train(np.full((2, langid.WINDOW), 97, np.uint8), np.array([0, 1]), ["aa", "bb"])
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(spark.createDataFrame(rows, "doc_id bigint, text string"), net).collect()}
    assert [i for i in got if got[i] == "und"] == [1, 2, 3, 7]


@pytest.mark.parametrize("texts", [1, 20_000])
def test_fits_read_a_bounded_sample_whatever_repeats(spark, monkeypatch, texts):
    """20,000 rows of two ids, with one text or as many."""
    docs = spark.range(20_000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("some idiot words "), F.col("id") % texts).alias("text"), F.lit("en").alias("lang"))
    seen = []
    monkeypatch.setattr(langid, "train", lambda windows, classes, labels: seen.append(len(windows)))
    langid.fit(docs, max_docs=10)
    assert seen[0] <= 10 * langid.SAMPLE_WINDOWS
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id bigint, toxic int")
    assert toxicity.training_sample(docs, labels, max_docs=10).count() <= 10


def naive_network(net, window):
    """One window through the network, number by number."""
    x = [[0.0] * langid.EMBED if b == 0 else net.embed[b].tolist() for b in window] + [[0.0] * langid.EMBED] * (max(langid.WIDTHS) - 1)
    top = []
    for f in range(net.kernel.shape[1]):
        width = langid.WIDTHS[f // langid.FILTERS]
        best = max(sum(x[i + j][e] * float(net.kernel[j * langid.EMBED + e, f]) for j in range(width) for e in range(langid.EMBED)) for i in range(len(window)))
        top.append(max(0.0, best + float(net.bias[f])))
    z = [sum(t * float(w) for t, w in zip(top, net.out[:, c], strict=True)) + float(net.out_bias[c]) for c in range(len(net.labels))]
    e = [np.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


def test_network_equals_a_naive_convolution():
    rng = np.random.default_rng(4)
    windows = rng.integers(0, 255, (40, langid.WINDOW)).astype(np.uint8)
    net = langid.train(windows, np.arange(40) % 3, ["a", "b", "c"])
    got = net.predict(windows[:3])
    assert np.allclose(got, [naive_network(net, w) for w in windows[:3]], atol=1e-4)


def test_network_gradient_learns():
    rng = np.random.default_rng(2)
    x = rng.integers(1, 255, (200, langid.WINDOW)).astype(np.uint8)
    y = np.arange(200) % 2
    x[y == 1, 100:103] = (7, 8, 9)
    net = langid.train(x, y, ["no", "yes"])
    assert (net.predict(x).argmax(axis=1) == y).mean() > 0.9


def test_windows_cover_whole_text():
    data = bytes(range(256)) * 3 + b"end"
    w = langid.to_windows(data)
    assert w.shape == (4, 256) and w.tobytes().rstrip(b"\0") == data and langid.to_windows(b"").shape == (1, 256)


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    c = Counter((r["toxic"], r["predicted"]) for r in rows)
    assert c[1, 1] / (c[1, 0] + c[1, 1]) > 0.85
    assert c[0, 1] / (c[0, 0] + c[0, 1]) < 0.02
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_label_model_finds_accuracies_and_correlation_without_labels():
    rng = np.random.default_rng(1)
    n = 6000
    y = rng.random(n) < 0.2
    speak = lambda right, wrong: np.where(y, rng.random(n) < right, rng.random(n) < wrong).astype(int)
    a, b, c, d = speak(0.9, 0.02), speak(0.7, 0.05), speak(0.8, 0.03), speak(0.5, 0.1)
    copy = np.where(rng.random(n) < 0.95, d, 1 - d)
    spoken = np.stack([a, b, c, d, copy, speak(0.1, 0.6)], axis=1)
    m = toxicity.fit_label_model(spoken, np.array([True] * 5 + [False]))
    post = m.posterior(spoken)
    right = post @ spoken[:, :3] / post.sum()
    assert right[0] > right[2] > right[1] and abs(m.prior - y.mean()) < 0.03
    assert m.parent[3] == 4 or m.parent[4] == 3
    assert m.information[3, 4] > 10 * m.information[0, 1]
    assert ((m.posterior(spoken) > 0.5) == y).mean() > 0.97


def naive_posterior(m, row):
    odds = [1 - m.prior, m.prior]
    for j, v in enumerate(row):
        s = row[m.parent[j]] if m.parent[j] >= 0 else 0
        for label in (0, 1):
            p = m.speaks[label, j, s]
            odds[label] *= p if v else 1 - p
    return odds[1] / sum(odds)


def test_posterior_equals_the_product_of_its_factors():
    rng = np.random.default_rng(3)
    spoken = rng.integers(0, 2, (300, 6))
    spoken[:, 5] = spoken[:, 4]
    m = toxicity.fit_label_model(spoken, np.array([True, True, False, True, True, True]), rounds=3)
    assert np.allclose(m.posterior(spoken[:40]), [naive_posterior(m, r) for r in spoken[:40]])


def test_score_equals_a_plain_sum():
    """A text's score by its words one by one."""
    voters = toxicity.make_voters(["idiot", "scum", "fool*"])
    vocabulary = {w: i for i, w in enumerate(sorted(voters.known))}
    model = toxicity.Toxicity(voters, vocabulary, np.random.default_rng(1).standard_normal(len(voters.names) + len(vocabulary) + 4))
    text = "You are an idiot, a foolish idiot"
    c, names = model.coefficients, voters.names
    z = sum(c[names.index(f"word:{w}")] for w in ("idiot", "fool*")) + c[names.index("lexicon:0")]
    z += c[names.index("pattern:two words")] + c[names.index("pattern:dense")] + c[names.index("pattern:addressed")]
    z += c[len(names) + vocabulary["idiot"]] + c[len(names) + vocabulary["fool*"]]
    z += c[-4] + c[-3] * np.log1p(3) + c[-2] * 1 + c[-1]
    assert abs(model.score(text) - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_of_hard_texts(spark, hard_docs, hard_rows, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 1), (99, 1), (8, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(hard_docs, labels)
    got = toxicity.predict(hard_docs, model).collect()
    assert len(got) == len(hard_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.predict(no_docs, model).count() == 0
    none = toxicity.fit(hard_docs, labels.where("toxic > 5"))
    assert none.score(None) < 0.5 and none.score("you idiot, you worthless idiot") > 0.5
    kept = toxicity.keep_clean(hard_docs, none)
    assert kept.columns == hard_docs.columns and kept.count() == len(hard_rows)


def sharded(spark, docs, n=24):
    return sharding.shard_records(docs, n).collect()


def test_key_law(spark, hard_docs, hard_rows, sf_dir, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sharded(spark, docs)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in rows) and any(r["grown_shard"] == 24 for r in rows)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    again = {r["doc_id"]: r["shard"] for r in sharded(spark, docs.where("doc_id % 3 = 0").repartition(5))}
    assert all(again[r["doc_id"]] == r["shard"] for r in rows if r["doc_id"] in again)
    hard = sharded(spark, hard_docs)
    assert len(hard) == len(hard_rows) and {r["size"] for r in hard if r["doc_id"] == 5} == {8}
    assert sharded(spark, no_docs) == []


def test_growing_is_starting_with_one_more(spark):
    grown = sharding.grow(sharding.initial_map(spark, 24), 24).select("vslot", "shard").collect()
    assert sorted(map(tuple, grown)) == sorted(map(tuple, sharding.initial_map(spark, 25).select("vslot", "shard").collect()))
    counts = Counter(r["shard"] for r in grown)
    assert len(counts) == 25 and max(counts.values()) < 2 * min(counts.values())


def test_rebalance_by_bytes(spark):
    m = sharding.initial_map(spark, 8)
    loads = spark.range(sharding.SLOTS).select(F.col("id").cast("int").alias("vslot"), F.when(F.col("id") % 16 == 3, 900).otherwise(10).alias("bytes"))
    new = sharding.rebalance(m, loads, 8)
    spread = lambda x: [r[0] for r in x.join(loads, "vslot").groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    before, after = spread(m), spread(new)
    assert len(after) == 8 and sum(after) == sum(before) and max(after) / min(after) < 1.15
    assert {r["version"] for r in new.collect()} == {2} and new.count() == sharding.SLOTS


def test_the_map_is_stored_in_versions_of_edits(spark, tmp_path):
    one = sharding.initial_map(spark, 24)
    maps = sharding.SlotMap(spark, str(tmp_path / "map"))
    assert maps.store(one) == 1 and maps.store(sharding.grow(maps.read(1), 24)) == 2
    loads = spark.range(sharding.SLOTS).select(F.col("id").cast("int").alias("vslot"), (F.col("id") % 97).alias("bytes"))
    want = {r["vslot"]: r["shard"] for r in sharding.rebalance(maps.read(1), loads, 24).collect()}
    assert maps.store(sharding.rebalance(maps.read(1), loads, 24)) == 3
    placed = [{r["vslot"]: r["shard"] for r in maps.read(v).collect()} for v in (1, 2, 3)]
    assert placed[0] == {r["vslot"]: r["shard"] for r in one.collect()} and placed[2] == want
    grown = {r["vslot"]: r["shard"] for r in sharding.grow(one, 24).collect()}
    assert placed[1] == grown and {r["version"] for r in maps.read(2).collect()} == {2}
    edits = spark.read.parquet(f"{maps.path}/v2").collect()
    assert {r["vslot"] for r in edits} == {v for v in grown if grown[v] != placed[0][v]} and len(edits) < 400


def test_the_query_balances_bytes(spark, sf_dir):
    rows = queries.op9_sharding(spark, sf_dir).collect()
    spread = lambda name: [sum(r["size"] for r in rows if r[name] == k) for k in range(24)]
    assert max(spread("balanced_shard")) < max(spread("shard")) and sum(spread("balanced_shard")) == sum(r["size"] for r in rows)


def test_native_plan(spark, sf_dir):
    text = queries.op9_sharding(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
