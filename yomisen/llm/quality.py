"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad.  A line's score comes from features of the
line itself and of its neighbours, and neighbouring labels attract one another.
Labels are known for documents only, so training begins with each line labelled
as its document and then lets good lines in bad documents go free (two rounds of
hard expectation-maximisation).  A document's quality is the mean of its lines'
forward-backward marginals weighed by length, calibrated by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import chunks, joined_buffer, range_of, texts_of, unused
from .decontaminate import token_hashes
from .labels import crc32_of_id, training_rows

PER_CLASS = 600
STEPS = 120
ROUNDS = 2
#: Lines of a chain that are walked one after another.
BLOCK = 256

_CLASSES = np.zeros((5, 256), np.int32)
_CLASSES[0, 65:91] = 1  # capitals
_CLASSES[1, [*range(97, 123), *range(128, 256)]] = 1  # other letters
_CLASSES[2, 48:58] = 1  # digits
_CLASSES[3, [ord(c) for c in ".,;:!?'\"()-"]] = 1  # punctuation
_CLASSES[4, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 1  # symbols
_CODE = np.full(256, 5, np.uint8)
for _k in range(5):
    _CODE[_CLASSES[_k] == 1] = _k
OWN = 19


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line with its neighbours', each line's length, and where each text's lines begin.

    Lines are cut at newlines; an empty text has one empty line.
    """
    data, starts = joined_buffer([x + b"\n" for x in texts])
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 10)
    begins = np.append(0, ends[:-1] + 1)
    first = np.searchsorted(begins, starts)
    length = (ends - begins).astype(np.float64)
    size = np.maximum(length, 1)
    # counts of the classes up to each line's end, by one pass for each class
    code = _CODE[raw]
    share = np.stack([np.diff(np.append(0, np.cumsum(code == k, dtype=np.int64)[ends])) for k in range(5)], 1) / size[:, None]
    tokens, place, _ = token_hashes(data)
    line = np.searchsorted(ends, place)
    n_words = np.bincount(line, minlength=len(ends)).astype(np.float64)
    again = np.zeros(len(tokens), bool)
    again[1:] = (tokens[1:] == tokens[:-1]) & (line[1:] == line[:-1])
    repeat = np.bincount(line[again], minlength=len(ends)) / np.maximum(n_words, 1)
    exclaim = np.diff(np.append(0, np.cumsum(raw == 33, dtype=np.int64)[ends])) / np.maximum(n_words, 1)
    mean_word = (share[:, 0] + share[:, 1] + share[:, 2]) * size / np.maximum(n_words, 1)
    last = raw[np.maximum(ends - 1, 0)]
    closes = (length > 0) & np.isin(last, [ord(c) for c in ".!?\"')"])
    symbols = share[:, 4] * size / np.maximum(n_words, 1)  # per word
    own = np.stack(
        [
            share[:, 0], share[:, 1], share[:, 2], share[:, 3], share[:, 4], repeat, np.minimum(exclaim, 2), np.minimum(symbols, 3),
            np.log1p(length) / 5, np.minimum(mean_word, 20) / 10, closes, length == 0, n_words == 1,
            share[:, 0] > 0.3, symbols > 0.2, symbols > 0.8, repeat > 0.1, repeat > 0.5, exclaim > 0.3,
        ], 1,
    ).astype(np.float64)
    edge_up, edge_down = np.zeros(len(ends), bool), np.zeros(len(ends), bool)
    edge_up[first[:-1]] = True
    edge_down[first[1:] - 1] = True
    above = np.where(edge_up[:, None], 0, np.roll(own, 1, 0))
    below = np.where(edge_down[:, None], 0, np.roll(own, -1, 0))
    bias = np.ones((len(own), 1))
    return np.concatenate([own, above, below, edge_up[:, None], edge_down[:, None], bias], 1), length, first


def _walk(emit: np.ndarray, pairs: np.ndarray, at: np.ndarray, n: np.ndarray, before: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Forward messages (in logarithms) of runs of lines, side by side; ``before`` is that of the line before each run that doesn't begin a chain."""
    out = np.zeros_like(emit)
    order = np.argsort(-n, kind="stable")
    at, n, before, begins = at[order], n[order], before[order], begins[order]
    live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")  # runs longer than t
    for t, k in enumerate(live.tolist()):
        here = at[:k] + t
        if t:
            before = out[here - 1]
        step = np.stack([np.logaddexp(before[:k, 0] + pairs[0, y], before[:k, 1] + pairs[1, y]) for y in (0, 1)], 1)
        out[here] = emit[here] + (np.where(begins[:k, None], 0, step) if t == 0 else step)
    return out


def forward(emit: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward messages of many chains of lines, in logarithms.

    Chains are cut into blocks, whose lines are walked side by side.  What a block
    makes of either label before it is found first; then messages go from block to
    block, then through the blocks: a chain of n lines takes n / BLOCK + 2 * BLOCK steps.
    """
    n = np.diff(first)
    pieces = -(-n // BLOCK)
    number = range_of(np.zeros(len(n), np.int64), pieces)
    at = np.repeat(first[:-1], pieces) + number * BLOCK
    size = np.minimum(BLOCK, np.repeat(first[1:], pieces) - at)
    begins = number == 0
    before = np.zeros((len(at), 2))
    if len(number) and number.max():
        ends = at + size - 1
        through = [_walk(emit, pairs, at, size, np.broadcast_to([0.0, -np.inf][:: 1 - 2 * y], (len(at), 2)), begins)[ends] for y in (0, 1)]
        before[begins] = [0.0, -np.inf]
        by_number = np.argsort(number, kind="stable")
        edges = np.searchsorted(number[by_number], np.arange(1, number.max() + 2))
        for a, b in zip(edges, edges[1:], strict=False):
            here = by_number[a:b]
            last = before[here - 1]
            before[here] = np.logaddexp(last[:, :1] + through[0][here - 1], last[:, 1:] + through[1][here - 1])
    return _walk(emit, pairs, at, size, before, begins)


def forward_backward(score: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 (bad) at each line, and the expected counts of neighbouring labels (2 x 2), over many chains at once.

    ``score`` has each line's score of label 1 over label 0, ``pairs`` the score
    of a label after another.
    """
    emit = np.stack([np.zeros(len(score)), score], 1)
    alpha = forward(emit, pairs, first)
    # backward is forward from the other end; it counts the line itself too
    beta = forward(emit[::-1], pairs.T, len(score) - first[::-1])[::-1] - emit
    whole = alpha + beta
    total = np.logaddexp(whole[:, 0], whole[:, 1])
    bad = np.exp(whole[:, 1] - total)
    inner = np.ones(len(score), bool)
    inner[first[:-1]] = False
    k = np.flatnonzero(inner)
    counts = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            counts[a, b] = np.exp(alpha[k - 1, a] + pairs[a, b] + emit[k, b] + beta[k, b] - total[k]).sum()
    return bad, counts


@dataclass
class Model:
    weights: np.ndarray
    pairs: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def line_marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each line, the probability that it is bad."""
        return forward_backward(x @ self.weights, self.pairs, first)[0]

    def goodness(self, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each document, the log odds of its mean marginal, weighed by length."""
        bad = self.line_marginals(x, first)
        weight = length + 1
        mean = np.add.reduceat(bad * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.log(1 - mean) - np.log(mean)


def _fit_chain(x: np.ndarray, y: np.ndarray, first: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest penalised conditional likelihood of line labels, by gradient steps with Adam.

    ``weight`` balances the chains: bad documents are fewer.
    """
    w, pairs = np.zeros(x.shape[1]), np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    k = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[k - 1], y[k]), 1.0)
    m = [np.zeros_like(w), np.zeros_like(pairs)]
    v = [np.zeros_like(w), np.zeros_like(pairs)]
    for step in range(1, STEPS + 1):
        bad, expected = forward_backward(x @ w, pairs, first)
        gw = x.T @ ((y - bad) * weight) / len(y) - 1e-4 * w
        gp = (seen - expected) / len(y) - 1e-3 * pairs
        for i, (p, g) in enumerate(((w, gw), (pairs, gp))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p += 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-9)
    return w, pairs


def train(rows: Sequence[tuple[str, int]], counts: dict[int, int]) -> Model:
    """Fits field and calibration; label 1 of a row is good.  Without both labels all scores are 0.5."""
    label = np.array([y for _, y in rows], np.int64)
    size = OWN * 3 + 3
    if len(set(label.tolist())) < 2:
        return Model(np.zeros(size), np.zeros((2, 2)), 0.0, 0.0)
    x, length, first = line_features([t.encode() for t, _ in rows])
    doc = np.repeat(np.arange(len(rows)), np.diff(first))
    y = (label[doc] == 0).astype(np.int64)
    weight = np.ones(len(y))
    model = Model(*_fit_chain(x, y, first, weight))
    for _ in range(ROUNDS):
        bad = model.line_marginals(x, first)
        worst = np.zeros(len(rows))
        np.maximum.at(worst, doc, bad)
        y = ((label[doc] == 0) & ((bad >= 0.5) | (bad == worst[doc]))).astype(np.int64)
        model = Model(*_fit_chain(x, y, first, weight))
    z = model.goodness(x, length, first)
    share = np.bincount(label, minlength=2)
    per = np.array([counts.get(k, 1) / share[k] for k in (0, 1)])[label]
    per = per / per.sum()
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton steps of a logistic curve, held back by a small penalty
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(per * (label - p) * z).sum() - 1e-3 * (a - 1), (per * (label - p)).sum() - 1e-3 * b])
        r = per * p * (1 - p)
        h = np.array([[(r * z * z).sum() + 1e-3, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-3]])
        move = np.linalg.solve(h, g)
        a, b = a + 0.5 * move[0], b + 0.5 * move[1]
    return Model(model.weights, model.pairs, float(a), float(b))


def learn(docs: DataFrame, labels: DataFrame, train_on, per_class: int = PER_CLASS) -> Model:
    """A model from at most ``per_class`` labelled rows of either label whose doc_id meets ``train_on``."""
    return train(*training_rows(docs, labels, "quality", train_on, per_class))


def score_texts(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Score of each text, and its number of lines more likely bad than good."""
    x, length, first = line_features(texts)
    bad = model.line_marginals(x, first)
    z = model.goodness(x, length, first)
    score = 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -30, 30)))
    return score, np.add.reduceat((bad > 0.5).astype(np.int64), first[:-1])


def _scored(docs: DataFrame, model: Model, score: str, bad_lines: str) -> DataFrame:
    """All columns of ``docs``, and the two named."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=2 << 20):
                scores, bad = score_texts(texts_of(part), shared.value)
                columns = [*part.columns, pa.array(scores), pa.array(bad)]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, score, bad_lines])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(score, "double").add(bad_lines, "long"))


def held_out():
    return F.pmod(crc32_of_id(F.col("doc_id")), F.lit(3)) == 1


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, bad_lines)`` of every row of ``docs(doc_id, text)``.

    Labels are learnt from rows whose crc32(doc_id) mod 3 is not 1.  A null text
    is empty and has one empty line; texts of any length and number of lines are
    read whole; a score of just 0.5 is 1; repeats repeat; no rows give none; without
    labels every score is 0.5; other columns are ignored.
    """
    model = learn(docs, labels, ~held_out())
    some = _scored(docs.select("doc_id", "text"), model, "score", "bad_lines")
    predicted = (F.col("score") >= 0.5).cast("int")
    return some.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"), "bad_lines")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their columns.

    Null and empty texts score as texts of one empty line; a score of just
    ``threshold`` stays; repeated rows stay or go alike; without labels all stay.
    """
    score, bad = unused(docs, "score"), unused(docs, "bad_lines")
    scored = _scored(docs, learn(docs, labels, ~held_out()), score, bad)
    return scored.where(F.col(score) >= threshold).drop(score, bad)
