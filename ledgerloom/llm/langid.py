"""Language identification by a byte convolutional network trained and applied in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches

#: Bytes of a window; the last one of a text is filled up with zeros.
WINDOW = 256
#: Windows that go through the network at once.
BATCH = 64
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
#: Bound of the training sample, in documents, and windows taken from each.
SAMPLE_DOCS = 3000
SAMPLE_WINDOWS = 4
EPOCHS = 8
RATE = 0.004
UNDETERMINED = "und"

_MAYBE_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a character of a letter category is there; number forms like a half or Roman eight are none."""
    return text is not None and any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


@dataclass
class ByteNet:
    """Byte embeddings, filters of several widths over them, max pooling over the window, softmax."""

    labels: list[str]
    embed: np.ndarray  # 256 x EMBED
    kernel: np.ndarray  # max(WIDTHS) * EMBED x filters, zero beyond a filter's width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unfolded embeddings, best position of each filter, its value)."""
        n, w = windows.shape
        k = max(WIDTHS)
        x = self.embed[windows]
        x[windows == 0] = 0
        x = np.concatenate([x, np.zeros((n, k - 1, EMBED), np.float32)], axis=1).reshape(n, -1)
        cols = np.lib.stride_tricks.sliding_window_view(x, k * EMBED, axis=1)[:, ::EMBED]
        cols = cols.reshape(n * w, k * EMBED)
        act = (cols @ self.kernel).reshape(n, w, -1)
        return cols, act, act.max(axis=1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        top = np.maximum(self.pooled(windows)[2] + self.bias, 0)
        z = top @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.probabilities(windows[i : i + BATCH]) for i in range(0, len(windows), BATCH)])


def to_windows(data: bytes) -> np.ndarray:
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def train(windows: np.ndarray, classes: np.ndarray, labels: list[str], seed: int = 7) -> ByteNet:
    """Minibatch Adam on cross entropy; the gradient of max pooling goes to the best position of each filter."""
    rng = np.random.default_rng(seed)
    k, f = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((k, EMBED, f), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
    mask = mask.reshape(k * EMBED, f)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    net = ByteNet(labels, draw(256, EMBED), draw(k * EMBED, f) * mask, np.zeros(f, np.float32), draw(f, len(labels)), np.zeros(len(labels), np.float32))
    params = {p: getattr(net, p) for p in ("embed", "kernel", "bias", "out", "out_bias")}
    m1, m2 = ({p: np.zeros_like(v) for p, v in params.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 32):
            pick = order[at : at + 32]
            x, y, n = windows[pick], classes[pick], len(pick)
            cols, act, best = net.pooled(x)
            where = act.argmax(axis=1)  # n x f
            top = np.maximum(best + net.bias, 0)
            z = top @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y] -= 1
            p /= n
            grad = {"out": top.T @ p, "out_bias": p.sum(axis=0)}
            back = (p @ net.out.T) * (top > 0)
            grad["bias"] = back.sum(axis=0)
            rows = (where + np.arange(n)[:, None] * WINDOW).ravel()
            seen = cols[rows].reshape(n, f, -1)
            grad["kernel"] = np.einsum("nf,nfk->kf", back, seen) * mask
            to_embed = (back[:, :, None] * net.kernel.T[None]).reshape(n * f, k, EMBED)
            at_byte = np.minimum(where[:, :, None] + np.arange(k), WINDOW - 1)
            byte = np.take_along_axis(x[:, None, :], at_byte.reshape(n, 1, -1), axis=2).reshape(-1)
            grad["embed"] = np.zeros_like(net.embed)
            np.add.at(grad["embed"], byte, to_embed.reshape(-1, EMBED))
            step += 1
            for name, g in grad.items():
                m1[name] += 0.1 * (g - m1[name])
                m2[name] += 0.001 * (g * g - m2[name])
                params[name] -= RATE * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(labelled: DataFrame, max_docs: int = SAMPLE_DOCS) -> ByteNet | None:
    """Train on the first ``max_docs`` different rows of (doc_id, text, lang) by a hash of id and text; None if none has text and lang.

    The hashes below twice the share that is wanted nearly always have enough different rows; where rows repeat so much that they
    don't, all are looked at. Equal rows become one before they are shuffled: whatever ids and texts repeat, at most ``max_docs``
    rows of SAMPLE_WINDOWS windows of WINDOW bytes reach the driver.
    """
    place = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit("langid")), 1)
    usable = labelled.where(F.col("lang").isNotNull()).withColumn("_place", place)
    share = 2 * max_docs / max(1, labelled.count())
    for below in ([int(share * (1 << 63))] if share < 1 else []) + [(1 << 63) - 1]:
        within = usable.where((F.col("_place") <= below) & F.col("text").rlike(r"\p{L}"))
        n, last = within.select("_place").distinct().orderBy("_place").limit(max_docs).agg(F.count(F.lit(1)), F.max("_place")).first()
        if n == max_docs:
            break
    rows = within.where(F.col("_place") <= (last or 0)).select("_place", "lang", *_sample_windows("text")).distinct()
    pieces = []
    for row in rows.orderBy("_place", "lang", "w0").limit(max_docs).collect():
        pieces += [(row["lang"], bytes(w)) for w in (row["w0"], row["w1"], row["w2"], row["w3"]) if w]
    if not pieces:
        return None
    pieces.sort()
    labels = sorted({lang for lang, _ in pieces})
    windows = np.concatenate([to_windows(w)[:1] for _, w in pieces])
    return train(windows, np.array([labels.index(lang) for lang, _ in pieces]), labels)


def _sample_windows(text: str) -> list:
    """Windows spread evenly over the whole text, its end included; fewer where it is short."""
    data = F.lower(F.col(text)).cast("binary")
    n = F.octet_length(data)
    out = []
    for i in range(SAMPLE_WINDOWS):
        start = F.floor((n - WINDOW) * i / (SAMPLE_WINDOWS - 1)).cast("int")
        whole = F.when(n > WINDOW, F.substring(data, start + 1, F.lit(WINDOW)))
        out.append((whole if i else F.coalesce(whole, data)).alias(f"w{i}"))
    return out


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of each whole text: the mean softmax of all its windows.

    Texts without a letter (null and empty ones too) are ``und`` with score 1, as is every
    text where there was nothing to learn from (score 0). A null ``doc_id`` stays null,
    repeated rows repeat, other columns are ignored. Only the network (a few KB) is sent out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                if not has_letter(text):
                    langs.append(UNDETERMINED)
                    scores.append(1.0)
                    continue
                if net is None:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                mean = net.predict(to_windows(as_bytes(text.lower()))).mean(axis=0)
                best = int(mean.argmax())
                langs.append(net.labels[best])
                scores.append(float(min(1.0, max(0.0, mean[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_batches(docs.select(docs["doc_id"].cast("long"), docs["text"]), run, "doc_id long, lang_pred string, score double")
