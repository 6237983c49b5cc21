"""Token counts: a trie of distinct pre-tokens with unigram forward scores shared by all that start alike."""

from __future__ import annotations

import functools
import itertools
import math
from array import array
from collections import Counter, deque
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

MODEL = "piece_bpe_32k.model"
#: The word mark that the model's pieces use.
MARK = "▁"
#: A worker's trie starts anew beyond this many nodes (about 250 MB).
MAX_NODES = 1_000_000
#: Longer pre-tokens are scored without the trie, by the same rule, in constant memory.
LONG = 4096
#: Natural-log units by which a byte of an unknown character is less likely than the rarest piece.
BYTE_PENALTY = 10.0


@functools.lru_cache(maxsize=2)
def load_pieces(model_path: str) -> dict[str, float]:
    """Piece -> unigram log probability.

    The file orders its pieces by merge rank and has no probabilities of its own,
    so a piece of rank r (from 0) gets Zipf's 1 / ((r + 2) * H), H normalising.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    ids.sort(key=lambda i: (-sp.get_score(i), i))
    norm = math.log(math.fsum(1 / (r + 2) for r in range(len(ids))))
    return {sp.id_to_piece(i): -math.log(r + 2) - norm for r, i in enumerate(ids)}


class PieceEnds:
    """Which pieces end where: states are the pieces' beginnings, found once for each (state, letter) that occurs.

    A state is the longest end of the text so far that begins a piece.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.begins = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        self.steps: dict[str, tuple[str, tuple[tuple[int, float], ...]]] = {}

    def step(self, text: str) -> tuple[str, tuple[tuple[int, float], ...]]:
        """The state after ``text`` (a state and a letter), and the (length, log probability) of the pieces that end there."""
        found = self.steps.get(text)
        if found is None:
            state = next((text[i:] for i in range(len(text)) if text[i:] in self.begins), "")
            ends = tuple((len(state) - i, self.pieces[state[i:]]) for i in range(len(state) - 1, -1, -1) if state[i:] in self.pieces)
            if len(self.steps) >= MAX_NODES:
                self.steps.clear()
            found = self.steps[text] = (state, ends)
        return found


class PrefixTrie:
    """Best unigram segmentations of all prefixes of the pre-tokens inserted so far.

    A node stands for a prefix and keeps its forward score (the best log probability of
    a segmentation) and that segmentation's token count. A prefix is scored once, when
    its node is made; equal scores go to the fewer tokens, then to the longer last piece.
    """

    def __init__(self, pieces: dict[str, float], max_nodes: int = MAX_NODES, prefix: str = MARK):
        self.ends = PieceEnds(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.byte = min(pieces.values(), default=0.0) - BYTE_PENALTY
        self.max_nodes, self.prefix = max_nodes, prefix
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count, self.state = array("d", [0.0]), array("q", [0]), [""]
        self.terminal: dict[str, tuple[int, float]] = {}

    def forward(self, word: str) -> tuple[int, float]:
        """The same without nodes: keeps only the last prefixes that a piece can reach."""
        last: deque[tuple[float, int]] = deque([(0.0, 0)], maxlen=self.longest)
        state = ""
        for letter in itertools.chain(self.prefix, word):
            n = len(letter.encode("utf-8", "surrogatepass"))
            best, tokens = last[-1][0] + n * self.byte, last[-1][1] + n
            state, ends = self.ends.step(state + letter)
            for back, p in ends:
                s, c = last[-back][0] + p, last[-back][1] + 1
                if s > best or (s == best and c <= tokens):
                    best, tokens = s, c
            last.append((best, tokens))
        return last[-1][1], last[-1][0]

    def insert(self, bare: str) -> tuple[int, float]:
        """(tokens, score) of a pre-token, given without its mark; both are kept at its terminal."""
        found = self.terminal.get(bare)
        if found is not None:
            return found
        if len(bare) > LONG:
            return self.forward(bare)
        word = self.prefix + bare
        if len(self.score) + len(word) > self.max_nodes:
            self.clear()
        child, score, count, states, step = self.child, self.score, self.count, self.state, self.ends.step
        node, path = 0, [0]
        for letter in word:
            key = node << 21 | ord(letter)
            nxt = child.get(key)
            if nxt is None:
                state, ends = step(states[node] + letter)
                if len(ends) == 0 or ends[0][0] > 1:  # the letter alone is no piece: its bytes are
                    n = len(letter.encode("utf-8", "surrogatepass"))
                    best, tokens = score[node] + n * self.byte, count[node] + n
                else:
                    best, tokens = -math.inf, 0
                for back, p in ends:
                    before = path[-back]
                    s = score[before] + p
                    if s >= best:
                        c = count[before] + 1
                        if s > best or c <= tokens:
                            best, tokens = s, c
                nxt = child[key] = len(score)
                score.append(best)
                count.append(tokens)
                states.append(state)
            node = nxt
            path.append(node)
        found = self.terminal[bare] = (count[node], score[node])
        return found


SCHEMA = "doc_id long, n_pretokens long, n_tokens long, log_prob double"


def token_counts(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Tokens of each whole text: white space splits pre-tokens, each gets a leading word mark.

    Map-only: a worker keeps one bounded trie for its partition, so a distinct pre-token
    is scored once for a partition (again after the trie was emptied) and nothing is shuffled.
    Null and empty texts have 0 tokens and log_prob 0; a null ``doc_id`` stays null; repeated
    rows give repeated results; other columns are ignored. Not SQL: tested against plain
    dynamic programming on each pre-token.
    """
    path = model_path or public_tokenizers.path(MODEL)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PrefixTrie(load_pieces(path))
        for batch in batches:
            n_pre, n_tok, log_prob = [], [], []
            for text in batch.column(1).to_pylist():
                words = Counter((text or "").split())
                tokens, score = 0, 0.0
                known = trie.terminal
                for word, times in words.items():
                    found = known.get(word)
                    if found is None:
                        found = trie.insert(word)
                        known = trie.terminal
                    tokens += found[0] * times
                    score += found[1] * times
                n_pre.append(sum(words.values()))
                n_tok.append(tokens)
                log_prob.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_pre, pa.int64()), pa.array(n_tok, pa.int64()), pa.array(log_prob, pa.float64())], names=["doc_id", "n_pretokens", "n_tokens", "log_prob"])

    return map_batches(docs.select(docs["doc_id"].cast("long"), docs["text"]), count, SCHEMA)
