"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy on every labelled row.

A word's vector is the sum of four hashed embeddings: of the whole word and of
its first 4, 6 and 7 bytes, so that unseen compounds share what is known of their
stem.  Filters of widths 1, 2 and 3 slide over the words of the whole text, each
keeps its maximum, and a logistic layer reads the maxima.  Scores are then moved
so that each language's own threshold, chosen on validation rows, lies at 0.5;
the language is guessed from function words of the text itself.

Training is spread: labelled rows are dealt to blocks by a hash of their id.  In
each round every block takes its rows through steps from a common state, and the
blocks' moves are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, forget_checkpoint, joined_buffer, materialise, texts_of
from .decontaminate import folded
from .labels import crc32_of_id, first_texts, labelled, labelled_blocks

PREFIXES = (4, 6, 7)
BUCKETS = 1 << 15
WIDTH = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PAD = max(WIDTHS) - 1
BATCH = 32
SEED = 7
#: Rows of the embeddings; the last one is the pads'.
ROWS = (1 + len(PREFIXES)) * BUCKETS + 1
#: The other weights: filters and shifts by width, output layer, bias.
DENSE = [(w, WIDTH, FILTERS) for w in WIDTHS] + [(FILTERS,)] * len(WIDTHS) + [(len(WIDTHS) * FILTERS,), (1,)]
#: Labelled rows that are trained on one after another, and the most such blocks, which then are longer.
BLOCK = 8192
MOST_BLOCKS = 256
#: Steps that a block takes in all rounds together, and the least and most rounds.
STEPS = 640
ROUNDS = (2, 8)
#: Words that are looked at together in training, and rows of the embeddings that are added together.
GROUP = 1 << 16
SLICE = 4096
#: Steps of thresholds in 1 of a logit.
GRID = 1 << 10
#: Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the and of to is in that for with was are this from by it as at be on or",
    "fr": "le la les des et une dans est pour que qui pas sur avec par au aux du ce sont",
    "de": "der die das und ist nicht von zu den mit sich auf für ein eine im dem als des auch",
    "es": "el los las una por con para del que se al como más pero sus le ya este sí porque",
}
LANGUAGES = tuple(FUNCTION_WORDS)
#: Validation rows of each label that a language needs for a threshold of its own.
LEAST_ROWS = 8

_RADIX = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _scramble(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (words, 1 + prefixes) and first bytes of the words of a buffer."""
    raw = folded(data)
    word = _WORD[raw]
    first = np.flatnonzero(word & ~np.append(False, word[:-1]))
    if not len(first):
        return np.zeros((0, 1 + len(PREFIXES)), np.uint64), first
    edges = np.append(first, len(raw))
    place = np.arange(len(raw)) - np.repeat(np.append(0, first), np.diff(np.append(0, edges)))
    power = np.full(max(2, int(np.diff(edges).max()) + 1), _RADIX)
    power[0] = 1
    power = np.multiply.accumulate(power)
    value = np.where(word, (raw.astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, len(power) - 1)], np.uint64(0))
    out = [np.add.reduceat(value, first)]
    for n in PREFIXES:
        out.append(np.add.reduceat(np.where(place < n, value, np.uint64(0)), first))
    return np.stack([_scramble(h) for h in out], 1), first


@cache
def _function_words(lang: str) -> np.ndarray:
    return np.sort(word_hashes(FUNCTION_WORDS[lang].encode())[0][:, 0])


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers of all words (with pads before each text), where each text begins, and its language.

    A row of numbers equal to ``4 * BUCKETS`` is a pad: its vector is zero.
    """
    data, starts = joined_buffer([x + b" " for x in texts])
    hashes, first = word_hashes(data)
    edges = np.searchsorted(first, starts)
    ids = (hashes % np.uint64(BUCKETS)).astype(np.int32) + np.arange(hashes.shape[1], dtype=np.int32) * BUCKETS
    padded = np.full((len(ids) + PAD * (len(texts) + 1), ids.shape[1]), ids.shape[1] * BUCKETS, np.int32)
    text = np.repeat(np.arange(len(texts)), np.diff(edges))
    padded[np.arange(len(ids)) + PAD * (text + 1)] = ids
    begins = edges + PAD * np.arange(len(edges))
    counts = np.zeros((len(texts), len(LANGUAGES)), np.int64)
    for k, lang in enumerate(LANGUAGES):
        known = _function_words(lang)
        near = np.minimum(np.searchsorted(known, hashes[:, 0]), len(known) - 1)
        counts[:, k] = np.bincount(text[known[near] == hashes[:, 0]], minlength=len(texts))
    language = np.where(counts.max(1) > 0, counts.argmax(1), len(LANGUAGES))
    return padded, begins, language


@dataclass
class Model:
    """Embeddings (a zero row last), filters by width (place, dimension, filter), output layer and thresholds by language."""

    table: np.ndarray
    filters: list[np.ndarray]
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: float
    cuts: np.ndarray

    def maxima(self, ids: np.ndarray, begins: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each text and, if asked for, the first place that responds so."""
        x = self.table[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x = x + self.table[ids[:, k]]
        n = len(begins) - 1
        best = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        place = np.zeros((n, len(WIDTHS) * FILTERS), np.int64)
        for k, (w, f, shift) in enumerate(zip(WIDTHS, self.filters, self.shifts, strict=True)):
            y = x[: len(x) - w + 1] @ f[0]
            for j in range(1, w):
                y += x[j : len(x) - w + 1 + j] @ f[j]
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            top = np.maximum.reduceat(y, begins[:-1], axis=0)
            best[:, columns] = np.maximum(top + shift, 0)
            if where:
                text = np.repeat(np.arange(n), np.diff(np.append(begins[:-1], len(y))))
                at, column = np.nonzero(y == top[text])
                place[text[at[::-1]], k * FILTERS + column[::-1]] = at[::-1]  # the first is written last
        return best, place

    def logits(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return self.maxima(ids, begins)[0] @ self.out + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class State:
    """What training carries from round to round: embeddings and their squared steps; the other weights with Adam's two means; steps so far."""

    table: np.ndarray
    squares: np.ndarray
    dense: np.ndarray
    steps: float = 0.0

    def model(self) -> Model:
        """A model that shares the arrays of this state, but for the bias."""
        parts, at = [], 0
        for shape in DENSE:
            n = int(np.prod(shape))
            parts.append(self.dense[0, at : at + n].reshape(shape))
            at += n
        n = len(WIDTHS)
        return Model(self.table, parts[:n], parts[n : 2 * n], parts[2 * n], float(parts[-1][0]), np.zeros(len(LANGUAGES) + 1))


def _initial(seen: np.ndarray, totals: np.ndarray) -> State:
    """Random, but for one direction of the embeddings that starts as each bucket's log odds.

    ``seen`` counts the texts of either label that hold a bucket, ``totals`` all texts of either label.
    """
    rng = np.random.default_rng(SEED)
    odds = np.log((seen[:, 1] + 0.5) / (totals[1] + 1)) - np.log((seen[:, 0] + 0.5) / (totals[0] + 1))
    odds *= np.minimum(1, seen.sum(1) / 8)  # rare ones tell little
    table = rng.normal(0, 0.05, (ROWS, WIDTH)).astype(np.float32)
    table[:, 0] = np.clip(odds, -2, 4) / 4
    table[-1] = 0
    state = State(table, np.full(ROWS, 1e-3, np.float32), np.zeros((3, sum(int(np.prod(s)) for s in DENSE)), np.float32))
    model = state.model()
    for f, shift in zip(model.filters, model.shifts, strict=True):
        f[:] = rng.normal(0, 0.2, f.shape)
        f[:, 0, : FILTERS // 2] = 0.7
        shift[:] = 0.1
    model.out[:] = rng.normal(0, 0.1, len(model.out))
    model.out[[k * FILTERS + i for k in range(len(WIDTHS)) for i in range(FILTERS // 2)]] = 0.5
    return state


def _laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of several texts as :func:`features` gives them, from those of each."""
    pad = np.full((PAD, 1 + len(PREFIXES)), ROWS - 1, np.int32)
    ids = np.concatenate([x for text in texts for x in (pad, text)] + [pad])
    return ids, np.cumsum([0] + [PAD + len(text) for text in texts])


def _groups(texts: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``GROUP`` words, one text at least."""
    begin, words = 0, 0
    for i, text in enumerate(texts):
        if i > begin and words + len(text) > GROUP:
            yield begin, i
            begin, words = i, 0
        words += len(text)
    if len(texts) > begin:
        yield begin, len(texts)


def _step(state: State, texts: list[np.ndarray], labels: np.ndarray) -> None:
    """One step on a few texts: Adam for filters and output layer, Adagrad for the embeddings that the maxima read."""
    model = state.model()
    best, around = [], []  # ``around`` has the bucket numbers from each maximum on
    for a, b in _groups(texts):
        ids, begins = _laid(texts[a:b])
        top, place = model.maxima(ids, begins, where=True)
        best.append(top)
        around.append(ids[np.minimum(place[:, :, None] + np.arange(max(WIDTHS)), len(ids) - 1)])
    best, around = np.concatenate(best), np.concatenate(around)
    error = (_sigmoid(best @ model.out + model.bias) - labels).astype(np.float32) / len(texts)
    down = error[:, None] * model.out * (best > 0)
    grads, moved, moves = [], [], []
    for k, w in enumerate(WIDTHS):
        columns = slice(k * FILTERS, (k + 1) * FILTERS)
        g = down[:, columns]
        grad = np.zeros_like(model.filters[k])
        for j in range(w):
            at = around[:, columns, j]
            grad[j] = np.einsum("nf,nfd->df", g, state.table[at].sum(2))
            moved.append(at.reshape(-1, at.shape[-1]))
            moves.append((g[:, :, None] * model.filters[k][j].T[None]).reshape(-1, WIDTH))
        grads.append(grad.ravel())
    grads += [down[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))]
    grads += [error @ best + 1e-4 * model.out, error.sum(keepdims=True)]
    g = np.concatenate(grads)
    moved, moves = np.concatenate(moved), np.concatenate(moves)
    state.steps += 1
    value, first, second = state.dense
    first += 0.1 * (g - first)
    second += 0.001 * (g * g - second)
    value -= 0.01 * (first / (1 - 0.9**state.steps)) / (np.sqrt(second / (1 - 0.999**state.steps)) + 1e-8)
    for k in range(moved.shape[1]):
        bucket, inverse = np.unique(moved[:, k], return_inverse=True)
        g = np.zeros((len(bucket), WIDTH), np.float32)
        np.add.at(g, inverse, moves)
        state.squares[bucket] += (g * g).mean(1)
        state.table[bucket] -= 0.02 * g / np.sqrt(state.squares[bucket])[:, None]
    state.table[-1] = 0


PREPARED = "block int, checks boolean, y int, language int, words binary"
PARTIAL = "slice int, block int, rows binary, figures binary"


def _prepare(rows: DataFrame) -> DataFrame:
    """Bucket numbers, guessed language and label of every row of some blocks, stored; each partition is one block, in a fixed order.

    A hash of the id chooses block, place and whether a row checks, so nothing depends on order or layout of the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in first_texts(batches):
            for part in chunks(batch, limit=1 << 20):
                ids, begins, language = features(texts_of(part))
                ids = (ids % BUCKETS).astype("<u2")
                words = [ids[a + PAD : b].tobytes() for a, b in zip(begins, begins[1:], strict=False)]
                checks = (_scramble(part.column("spot").to_numpy().astype(np.uint64)) >> np.uint64(8)) % np.uint64(5) == 0
                columns = [part.column("block"), pa.array(checks), part.column("y"), pa.array(language.astype(np.int32)), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "checks", "y", "language", "words"])

    return materialise(rows.mapInArrow(run, PREPARED))


def _words(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Bucket numbers of the texts of prepared rows."""
    n = 1 + len(PREFIXES)
    offsets = np.arange(n, dtype=np.int32) * BUCKETS
    return [np.frombuffer(x.as_buffer(), "<u2").reshape(-1, n) + offsets for x in batch.column("words")]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of prepared rows of about ``GROUP`` words."""
    for batch in batches:
        yield from chunks(batch, "words", GROUP * 2 * (1 + len(PREFIXES)))


def _partial(block: int, at: np.ndarray, figures: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
    """Figures of some numbered rows, in slices of ``SLICE`` rows; ``first`` is added to the slices' numbers."""
    cuts = np.searchsorted(at, np.arange(0, int(at[-1]) + SLICE + 1, SLICE)) if len(at) else np.zeros(1, int)
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if b > a:
            rows, part = at[a:b].astype("<i4").tobytes(), figures[a:b].astype("<f4").tobytes()
            yield pa.RecordBatch.from_pylist([{"slice": first + k, "block": block, "rows": rows, "figures": part}], _PARTIAL)


_PARTIAL = pa.schema([("slice", pa.int32()), ("block", pa.int32()), ("rows", pa.binary()), ("figures", pa.binary())])
#: Number of the first slice of figures that don't belong to the table.
ASIDE = 1 << 20


def _added(partials: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By slice, its rows, the sums of their figures over all blocks, and how many blocks had them; added on the executors, block by block."""

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        parts = [(np.frombuffer(r, "<i4"), np.frombuffer(f, "<f4")) for r, f in zip(table.column("rows").to_pylist(), table.column("figures").to_pylist(), strict=True)]
        at = np.unique(np.concatenate([r for r, _ in parts]))
        total = np.zeros((len(at), len(parts[0][1]) // len(parts[0][0])))
        times = np.zeros(len(at))
        for rows, figures in parts:
            k = np.searchsorted(at, rows)
            total[k] += figures.reshape(len(rows), -1)
            times[k] += 1
        row = {"slice": table.column("slice")[0].as_py(), "rows": at.astype("<i4").tobytes(), "total": total.tobytes(), "times": times.tobytes()}
        return pa.Table.from_pylist([row], pa.schema([("slice", pa.int32()), ("rows", pa.binary()), ("total", pa.binary()), ("times", pa.binary())]))

    out = {}
    for r in partials.groupBy("slice").applyInArrow(add, "slice int, rows binary, total binary, times binary").collect():
        rows = np.frombuffer(r["rows"], "<i4")
        out[r["slice"]] = rows, np.frombuffer(r["total"]).reshape(len(rows), -1), np.frombuffer(r["times"])
    return out


def _counts(rows: DataFrame) -> np.ndarray:
    """In how many texts of either label each bucket occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, block = np.zeros((ROWS, 2)), None
        for part in _parts(batches):
            for text, y in zip(_words(part), part.column("y").to_pylist(), strict=True):
                seen[np.unique(text), y] += 1
            block = part.column("block")[0].as_py()
        if block is not None:
            at = np.flatnonzero(seen.any(1))
            yield from _partial(block, at, seen[at])

    seen = np.zeros((ROWS, 2))
    for at, total, _ in _added(rows.mapInArrow(run, PARTIAL)).values():
        seen[at] = total
    return seen


def _round(rows: DataFrame, state: State) -> State:
    """All rows once: each block goes on from ``state`` by itself, then every figure moves by the mean over the blocks that moved it."""
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, block = shared.value, None
        new = State(old.table.copy(), old.squares.copy(), old.dense.copy(), old.steps)
        texts: list[np.ndarray] = []
        labels: list[int] = []
        for part in _parts(batches):
            block = part.column("block")[0].as_py()
            texts += _words(part)
            labels += part.column("y").to_pylist()
            at = 0
            while len(texts) - at >= 2 * BATCH:
                _step(new, texts[at : at + BATCH], np.array(labels[at : at + BATCH]))
                at += BATCH
            texts, labels = texts[at:], labels[at:]
        if block is None:
            return
        _step(new, texts, np.array(labels))  # up to two batches are left
        moved = np.concatenate([new.table - old.table, (new.squares - old.squares)[:, None]], 1)
        at = np.flatnonzero(moved.any(1))
        yield from _partial(block, at, moved[at])
        dense = np.append((new.dense - old.dense).ravel(), new.steps - old.steps)
        yield from _partial(block, np.arange(len(dense)), dense[:, None], ASIDE)

    new = State(state.table.copy(), state.squares.copy(), state.dense.copy(), state.steps)
    flat = np.append(new.dense.ravel(), 0)
    for k, (at, total, times) in _added(rows.mapInArrow(run, PARTIAL)).items():
        mean = (total / times[:, None]).astype(np.float32)
        if k >= ASIDE:
            flat[at] += mean[:, 0]
        else:
            new.table[at] += mean[:, :WIDTH]
            new.squares[at] += mean[:, WIDTH]
    shared.destroy()
    new.dense[:] = flat[:-1].reshape(new.dense.shape)
    new.steps += float(flat[-1])
    return new


def _thresholds(rows: DataFrame, model: Model) -> np.ndarray:
    """The threshold of each language, and of the other texts, from the logits of all rows in steps of 1 / ``GRID``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            texts = _words(part)
            logits = np.concatenate([shared.value.logits(*_laid(texts[a:b])) for a, b in _groups(texts)]).astype(np.float64)
            cells = pa.array(np.floor(np.clip(logits, -30, 30) * GRID).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("language"), cells, part.column("y")], names=["language", "cell", "y"])

    found = rows.mapInArrow(run, "language int, cell int, y int").groupBy("language", "cell")
    cells = found.agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1")).collect()
    shared.destroy()
    table = np.array([tuple(r) for r in cells], np.int64).reshape(-1, 4)
    everyone = _threshold(table[:, 1], table[:, 2:])
    cuts = np.full(len(LANGUAGES) + 1, everyone)
    for k in range(len(cuts)):
        own = table[table[:, 0] == k]
        if own[:, 2:].sum(0).min() >= LEAST_ROWS:
            cuts[k] = _threshold(own[:, 1], own[:, 2:])
    return cuts


def _threshold(cells: np.ndarray, counts: np.ndarray) -> float:
    """The cut with the best F1, in the middle of the gap around it; ``counts`` has the rows of either label in each cell."""
    values, inverse = np.unique(cells, return_inverse=True)
    if not len(values):
        return 0.0
    sums = np.zeros((len(values), 2))
    np.add.at(sums, inverse, counts)
    above = sums[::-1].cumsum(0)[::-1]  # rows at or above each value
    f1 = 2 * above[:, 1] / np.maximum(above.sum(1) + sums[:, 1].sum(), 1)
    cuts = np.append(values[0] - GRID, (values[:-1] + 1 + values[1:]) / 2) / GRID
    return float(cuts[np.flatnonzero(f1 >= f1.max() - 1e-9)].mean())


def learn(docs: DataFrame, labels: DataFrame, train_on) -> Model:
    """A model from every labelled row whose doc_id meets ``train_on``; without both labels all scores are 0.5."""
    known = labelled(labels, "toxic", train_on)
    n = known.count()
    blocks = max(1, min(MOST_BLOCKS, -(-n // BLOCK)))
    rows = _prepare(labelled_blocks(docs, known, n, train_on, blocks))
    try:
        return _fitted(rows, blocks)
    finally:
        forget_checkpoint(rows)


def _fitted(rows: DataFrame, blocks: int) -> Model:
    """Four prepared rows in five fit the network, the fifth sets the thresholds; where either part has fewer than ``LEAST_ROWS`` rows of a label, all do both."""
    parts = np.zeros((2, 2))
    for r in rows.groupBy("checks", "y").count().collect():
        parts[int(r["checks"]), r["y"]] = r["count"]
    if not parts.sum(0).all():
        model = _initial(np.zeros((ROWS, 2)), np.zeros(2)).model()
        model.out[:] = 0
        return model
    apart = parts.min() >= LEAST_ROWS
    fit, check = (rows.where(~F.col("checks")), rows.where("checks")) if apart else (rows, rows)
    totals = parts[0] if apart else parts.sum(0)
    state = _initial(_counts(fit), totals)
    for _ in range(int(np.clip(np.ceil(STEPS * BATCH * blocks / totals.sum()), *ROUNDS))):
        state = _round(fit, state)
    model = state.model()
    model.cuts = _thresholds(check, model)
    return model


SCORED = "doc_id long, score double, predicted int, language string"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted, language)`` of every row, from the whole text alone; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*LANGUAGES, "other"])
        for batch in batches:
            for part in chunks(batch, limit=1 << 20):
                ids, begins, language = features(texts_of(part))
                logits = model.logits(ids, begins).astype(np.float64) - model.cuts[language]
                score = _sigmoid(logits)
                columns = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(names[language].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "score", "predicted", "language"])

    return docs.select("doc_id", "text").mapInArrow(run, SCORED)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, language)`` of every row of ``docs(doc_id, text)``.

    Labels are learnt from rows whose crc32(doc_id) mod 5 is not 0.  Empty and
    null texts have no words and get the score of none; texts of any length are
    read whole; a score of just 0.5 is 1; repeats repeat; no rows give none; without
    labels every score is 0.5; other columns are ignored.
    """
    held_out = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(5)) == 0
    model = learn(docs, labels, ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "language")
