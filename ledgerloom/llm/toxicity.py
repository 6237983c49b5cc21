"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, stored

#: Bounds of the training sample: labelled documents, and others, which only the label model sees.
SAMPLE_DOCS = 8000
UNLABELLED_DOCS = 4000
#: Words are also known by their first letters, as many as these: "idio*" stands for all words that go on so.
STEMS = (4, 5, 6)
#: A word or stem joins the learned lexicon if it is in this many toxic documents of the sample, with this z score and precision.
MIN_TOXIC_DOCS = 3
MIN_Z = 3.5
MIN_PRECISION = 0.6
#: Bounds of the model's size: learned words, by descending z score; those that vote alone; the lexicons that the others vote in.
MAX_WORDS = 300
SINGLE_VOTERS = 24
LEXICONS = 6
#: Two voters are correlated if one tells this many nats about the other beyond what the label tells.
MIN_INFORMATION = 0.002
#: What the label model takes a voter to be before it has seen votes: how often it speaks of each class; weight of that in documents.
SPEAKS_RIGHT, SPEAKS_WRONG, PRIOR_WEIGHT = 0.3, 0.02, 5.0
PRIOR_TOXIC = 0.1
#: Without any toxic label, this many sampled texts have to have a word of abuse for the label model to learn from them.
MIN_HIT_DOCS = 20

# Words of abuse by theme.
BASE_LEXICONS = {
    "mind": ("idiot", "moron", "stupid", "dumb", "imbecile", "fool", "clown"),
    "worth": ("worthless", "loser", "pathetic", "useless", "failure"),
    "disgust": ("scum", "trash", "garbage", "filth", "vermin", "disgusting"),
    "hate": ("hate", "kill", "despise"),
}

_WORD = re.compile(r"[^\W\d_]+")
ABSTAIN, TOXIC = -1, 1


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def terms_of(text: str | None) -> set[str]:
    """Distinct words, and the stems of those that are longer than these."""
    words = set(words_of(text))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


@dataclass
class Voters:
    """The voters, in the order of the columns of a vote matrix."""

    single: list[str]
    lexicons: list[frozenset[str]]

    def __post_init__(self) -> None:
        self.known = set(self.single).union(*self.lexicons)
        self.starts = {w[: STEMS[0]] for w in self.known}
        self.names = [f"word:{w}" for w in self.single] + [f"lexicon:{i}" for i in range(len(self.lexicons))]
        self.names += ["pattern:two words", "pattern:dense", "pattern:addressed"]

    def hits(self, text: str | None) -> tuple[dict[str, int], int, bool]:
        """(known words and stems with counts, number of words, whether "you" stands just before one of them)."""
        words = words_of(text)
        found: dict[str, int] = {}
        addressed = False
        starts, first = self.starts, STEMS[0]
        for i, w in enumerate(words):
            if w[:first] in starts:
                own = [x for x in (w, *(w[:k] + "*" for k in STEMS if len(w) > k)) if x in self.known]
                for x in own:
                    found[x] = found.get(x, 0) + 1
                addressed = addressed or (bool(own) and any(x.startswith("you") for x in words[max(0, i - 3) : i]))
        return found, len(words), addressed

    def votes(self, hits: tuple[dict[str, int], int, bool]) -> list[int]:
        found, n, addressed = hits
        out = [TOXIC if w in found else ABSTAIN for w in self.single]
        out += [TOXIC if not lex.isdisjoint(found) else ABSTAIN for lex in self.lexicons]
        total = sum(found.values())
        out.append(TOXIC if len(found) >= 2 else ABSTAIN)
        out.append(TOXIC if total and total >= 0.01 * n else ABSTAIN)
        out.append(TOXIC if addressed else ABSTAIN)
        return out


def learn_lexicon(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> list[str]:
    """Words and stems in descending order of the z score of their share of toxic and of clean documents."""
    scored = []
    for w, a in toxic.items():
        if a < MIN_TOXIC_DOCS:
            continue
        b = clean.get(w, 0)
        p = (a + b) / (n_toxic + n_clean)
        spread = math.sqrt(p * (1 - p) * (1 / n_toxic + 1 / max(1, n_clean)))
        z = (a / n_toxic - b / max(1, n_clean)) / spread if spread else 0.0
        if z >= MIN_Z and a / (a + b) >= MIN_PRECISION:
            scored.append((-z, w))
    return [w for _, w in sorted(scored)[:MAX_WORDS]]


def make_voters(learned: list[str]) -> Voters:
    rest = learned[SINGLE_VOTERS:]
    lexicons = [frozenset(v) for v in BASE_LEXICONS.values()] + [frozenset(rest[i::LEXICONS]) for i in range(LEXICONS) if rest[i::LEXICONS]]
    return Voters(learned[:SINGLE_VOTERS], lexicons)


@dataclass
class LabelModel:
    """Generative model of the votes: the label, and each voter given the label and one other voter (or none).

    ``speaks[y, j, s]``: probability that voter j does not abstain where the label is y and its parent abstains (s = 0) or speaks (1).
    A voter without a parent has the same in both.
    """

    prior: float
    speaks: np.ndarray  # 2 x voters x 2
    parent: np.ndarray  # of each voter, -1: none
    information: np.ndarray  # voters x voters, given the label

    def log_odds(self, spoken: np.ndarray) -> np.ndarray:
        """Of toxic against clean, for a matrix of which voter speaks."""
        state = np.where(self.parent >= 0, spoken[:, self.parent], 0)
        j = np.arange(spoken.shape[1])
        p1, p0 = self.speaks[1][j, state], self.speaks[0][j, state]
        return math.log(self.prior / (1 - self.prior)) + np.where(spoken == 1, np.log(p1 / p0), np.log((1 - p1) / (1 - p0))).sum(axis=1)

    def posterior(self, spoken: np.ndarray) -> np.ndarray:
        return sigmoid(self.log_odds(spoken))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def conditional_information(spoken: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Mutual information of each two voters given the label, in nats."""
    n, m = spoken.shape
    out = np.zeros((m, m))
    for mass in (1 - post, post):
        total = mass.sum()
        if total < 1:
            continue
        x = spoken.astype(float)
        both = (x * mass[:, None]).T @ x / total
        own = np.diag(both)
        for a, pa in ((1, own), (0, 1 - own)):
            for b, pb in ((1, own), (0, 1 - own)):
                joint = both if a and b else own[:, None] - both if a else own[None, :] - both if b else 1 - own[:, None] - own[None, :] + both
                expected = pa[:, None] * pb[None, :]
                seen = joint > 1e-12
                out += np.where(seen, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(expected, 1e-12)), 0) * total / n
    np.fill_diagonal(out, 0)
    return out


def spanning_parents(information: np.ndarray) -> np.ndarray:
    """The tree of the strongest correlations (Chow and Liu): each voter's parent, -1 where none reaches MIN_INFORMATION."""
    m = len(information)
    parent, joined = np.full(m, -1), np.zeros(m, bool)
    best, by = np.full(m, -1.0), np.full(m, -1)
    for _ in range(m):
        j = int(np.where(joined, -np.inf, best).argmax())
        parent[j] = by[j] if best[j] >= MIN_INFORMATION else -1
        joined[j] = True
        closer = ~joined & (information[j] > best)
        best[closer], by[closer] = information[j][closer], j
    return parent


def fit_label_model(spoken: np.ndarray, toxic_voter: np.ndarray, rounds: int = 20) -> LabelModel:
    """Expectation maximisation on the votes alone: first for independent voters, then with the strongest correlations as factors.

    ``spoken``: documents x voters, 1 where a voter speaks; ``toxic_voter``: whether it speaks for toxic (or for clean).
    What a voter speaks for is all that tells the classes apart at the start; no given label comes in.
    """
    m = spoken.shape[1]
    believed = np.stack([np.where(toxic_voter, SPEAKS_WRONG, SPEAKS_RIGHT), np.where(toxic_voter, SPEAKS_RIGHT, SPEAKS_WRONG)])[:, :, None].repeat(2, axis=2)
    model = LabelModel(PRIOR_TOXIC, believed, np.full(m, -1), np.zeros((m, m)))
    for with_factors in (False, True):
        if with_factors:
            information = conditional_information(spoken, model.posterior(spoken))
            model = LabelModel(model.prior, model.speaks, spanning_parents(information), information)
        for _ in range(rounds):
            post = model.posterior(spoken)
            state = np.where(model.parent >= 0, spoken[:, model.parent], 0)
            speaks = np.zeros((2, m, 2))
            for y, mass in enumerate((1 - post, post)):
                for s in (0, 1):
                    here = mass[:, None] * (state == s) if with_factors else mass[:, None] * np.ones((1, m))
                    speaks[y, :, s] = ((here * spoken).sum(axis=0) + PRIOR_WEIGHT * believed[y, :, s]) / (here.sum(axis=0) + PRIOR_WEIGHT)
            speaks = np.where(model.parent[None, :, None] < 0, speaks[:, :, :1], speaks)
            model = LabelModel(float(np.clip(post.mean(), 0.001, 0.999)), np.clip(speaks, 1e-4, 1 - 1e-4), model.parent, model.information)
    return model


def calibrate(log_odds: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Slope and shift by which the label model's log odds fit given labels best."""
    return train_linear(np.stack([np.clip(log_odds, -30, 30), np.ones(len(log_odds))], axis=1), given, ridge=1e-3)


@dataclass
class Toxicity:
    voters: Voters
    vocabulary: dict[str, int]
    coefficients: np.ndarray

    def features(self, hits: tuple[dict[str, int], int, bool]) -> np.ndarray:
        """Voters' votes, whether each lexicon word is there, log count and share of them, and 1."""
        found, n, _ = hits
        x = np.zeros(len(self.coefficients))
        v = self.voters.votes(hits)
        x[: len(v)] = [t == TOXIC for t in v]
        for w in found:
            x[len(v) + self.vocabulary[w]] = 1
        total = sum(found.values())
        x[-4:] = (bool(total), math.log1p(total), min(1.0, 20 * total / max(1, n)), 1)
        return x

    def score(self, text: str | None) -> float:
        z = float(self.features(self.voters.hits(text)) @ self.coefficients)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last column (the constant) is not shrunk."""
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_sample(docs: DataFrame, labels: DataFrame, max_docs: int = SAMPLE_DOCS, max_unlabelled: int = UNLABELLED_DOCS) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``max_docs`` labelled texts and ``max_unlabelled`` others (``toxic`` null), those first by a hash.

    The ids are picked from the labels alone and sent to the documents; equal rows become one before they are shuffled, and the
    limits are on different (id, text) pairs, so rows that share an id can't exceed them. Of an id's labels the largest counts.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity"))
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = labels.orderBy(order, "doc_id").limit(max_docs)
    share = min(1.0, max_unlabelled / max(1, docs.count()))
    text_hash = F.xxhash64(F.col("text"), F.lit("toxicity"))
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id", "left").where(F.col("toxic").isNotNull() | drawn)
    rows = rows.groupBy("doc_id", text_hash.alias("text_hash")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = stored(rows.select(F.xxhash64(order, "text_hash").alias("place"), "doc_id", "text", "toxic").repartition(8, "place").sortWithinPartitions("place", "doc_id"), "toxicity-drawn")
    last = [rows.where(which).select("place").orderBy("place").limit(n).agg(F.max("place")).first()[0] for which, n in (("toxic is not null", max_docs), ("toxic is null", max_unlabelled))]
    low = -(1 << 63)
    keep = F.when(F.col("toxic").isNotNull(), F.col("place") <= (low if last[0] is None else last[0])).otherwise(F.col("place") <= (low if last[1] is None else last[1]))
    return rows.where(keep).select("doc_id", "text", "toxic")


def _term_counts(sample: DataFrame) -> tuple[Counter, Counter, list[int]]:
    """How many toxic and clean documents have each term (of those with MIN_TOXIC_DOCS toxic ones), and how many of each there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = (Counter(), Counter()), [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic > 0].update(terms_of(text))
                n[toxic > 0] += 1
        names = sorted(counts[0].keys() | counts[1].keys())
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([counts[1][w] for w in part], pa.int64()), pa.array([counts[0][w] for w in part], pa.int64())], names=["term", "toxic", "clean"])
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([n[1]], pa.int64()), pa.array([n[0]], pa.int64())], names=["term", "toxic", "clean"])

    rows = map_batches(sample.where("toxic is not null").select("text", "toxic"), run, "term string, toxic long, clean long")
    rows = rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where((F.col("toxic") >= MIN_TOXIC_DOCS) | (F.col("term") == ""))
    toxic, clean, totals = Counter(), Counter(), [0, 0]
    for row in rows.collect():
        if row["term"]:
            toxic[row["term"]], clean[row["term"]] = row["toxic"], row["clean"]
        else:
            totals = [row["clean"], row["toxic"]]
    return toxic, clean, totals


def _voted(sample: DataFrame, voters: Voters) -> list[tuple[tuple[dict[str, int], int, bool], int | None]]:
    """The hits and the label of each sampled text, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [voters.hits(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([list(h[0]) for h in hits], pa.list_(pa.string())), pa.array([list(h[0].values()) for h in hits], pa.list_(pa.int32())), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits])],
                names=["doc_id", "toxic", "found", "times", "n", "addressed"],
            )

    rows = map_batches(sample.select(F.col("doc_id").cast("long"), "text", F.col("toxic").cast("int")), run, "doc_id long, toxic int, found array<string>, times array<int>, n long, addressed boolean").collect()
    out = [((dict(zip(r["found"], r["times"], strict=True)), r["n"], r["addressed"]), r["toxic"]) for r in rows]
    return sorted(out, key=lambda x: (x[1] is None, x[1] or 0, x[0][1], sorted(x[0][0].items()), x[0][2]))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = SAMPLE_DOCS, max_unlabelled: int = UNLABELLED_DOCS) -> Toxicity:
    """Train on ``training_sample``: given labels (doc_id, toxic) make the lexicons and calibrate; the label model sees the votes alone.

    What reaches the driver are terms of the sample's toxic documents and each sampled document's hits. Rows without a label
    don't count as labelled. Without a toxic label the base lexicons vote and nothing is calibrated; if fewer than MIN_HIT_DOCS sampled
    texts have a word of theirs, the coefficients are fixed ones.
    """
    sample = training_sample(docs, labels, max_docs, max_unlabelled)
    toxic, clean, totals = _term_counts(sample)
    voters = make_voters(learn_lexicon(toxic, clean, totals[1], totals[0]) if totals[1] else [])
    vocabulary = {w: i for i, w in enumerate(sorted(voters.known))}
    model = Toxicity(voters, vocabulary, np.zeros(len(voters.names) + len(vocabulary) + 4))
    drawn = _voted(sample, voters)
    if sum(bool(hits[0]) for hits, _ in drawn) < (1 if totals[1] else MIN_HIT_DOCS):
        model.coefficients[-4:] = (1.0, 0.5, 3.0, -3.0)
        return model
    votes = np.array([voters.votes(h) for h, _ in drawn])
    spoken = (votes != ABSTAIN).astype(np.int64)
    log_odds = fit_label_model(spoken, np.ones(len(voters.names), bool)).log_odds(spoken)
    given = np.array([np.nan if t is None else float(t > 0) for _, t in drawn])
    known = ~np.isnan(given)
    slope, shift = calibrate(log_odds[known], given[known]) if totals[1] and totals[0] else (1.0, 0.0)
    model.coefficients = train_linear(np.array([model.features(h) for h, _ in drawn]), sigmoid(slope * log_odds + shift))
    return model


def predict(docs: DataFrame, model: Toxicity) -> DataFrame:
    """``doc_id, score, predicted`` of each whole text. Map-only; only the model (some KB) is sent out.

    Null and empty texts are scored as texts without words. A null ``doc_id`` stays null,
    repeated rows repeat, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"]
            )

    return map_batches(docs.select(docs["doc_id"].cast("long"), docs["text"]), run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Toxicity) -> DataFrame:
    """The rows with a score below 0.5, with all their columns; rows are judged one by one, so repeated and null ids don't matter."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.where(score(docs["text"]) < 0.5)
