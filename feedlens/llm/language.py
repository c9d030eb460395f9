"""Language identification with a bidirectional gated recurrent network over bytes.

Every byte of a text is read in both directions and labelled with a probability
per language; a document's probabilities are the mean over its bytes. Texts are
cut into segments which run side by side, so a step is a few array operations
over thousands of segments. Arrays are laid out ``(units, segments)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Units per direction, bytes per segment, segments that run side by side.
UNITS, SEGMENT, SIDE_BY_SIDE = 6, 64, 8192
#: The symbol after the end of a text.
PAD = 256
#: Bound of the training sample: documents, and segments cut from each.
TRAIN_DOCS, TRAIN_CUTS = 2048, 3
UPDATES, BATCH, RATE, SEED = 192, 256, 0.02, 11
UNKNOWN = "und"
#: Documents below this probability are rejected by ``keep_identified``.
LEAST_SCORE = 0.4


@dataclass
class Direction:
    """Weights of one direction: ``inputs`` per symbol (with the bias), ``state``
    from the last state. Rows are the update gate, the reset gate, the candidate."""

    inputs: np.ndarray
    state: np.ndarray


@dataclass
class Network:
    """Two directions, the output layer and the languages it tells apart."""

    languages: list[str]
    ahead: Direction
    back: Direction
    output: np.ndarray
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.inputs, self.ahead.state, self.back.inputs, self.back.state, self.output, self.bias]


def new_network(languages: list[str], rng: np.random.Generator, units: int = UNITS) -> Network:
    def normal(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    def direction() -> Direction:
        return Direction(normal(3 * units, PAD + 1, scale=0.3), normal(3 * units, units, scale=0.3))

    return Network(languages, direction(), direction(), normal(len(languages), 2 * units, scale=0.3), np.zeros((len(languages), 1), np.float32))


def _squash(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place; ``exp`` is the cheapest way to it."""
    np.negative(x, out=x)
    np.exp(np.minimum(x, 80, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _step(weights: Direction, symbols: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Next state, and what the gradient needs."""
    units = len(h)
    given = np.take(weights.inputs, symbols, axis=1, mode="clip")
    recurrent = weights.state @ h
    gates = given[: 2 * units]
    gates += recurrent[: 2 * units]
    _squash(gates)
    update, reset = gates[:units], gates[units:]
    memory = recurrent[2 * units :]
    candidate = reset * memory
    candidate += given[2 * units :]
    candidate *= 2
    _squash(candidate)
    candidate *= 2
    candidate -= 1  # tanh
    after = h - candidate
    after *= update
    after += candidate
    return after, (symbols, h, update, reset, memory, candidate)


def _run(weights: Direction, symbols: np.ndarray, backwards: bool, trace: list | None = None) -> np.ndarray:
    """States after every byte, ``(steps, units, segments)``."""
    units = weights.state.shape[1]
    h = np.zeros((units, symbols.shape[1]), np.float32)
    states = np.empty((len(symbols), *h.shape), np.float32)
    for t in reversed(range(len(symbols))) if backwards else range(len(symbols)):
        h, seen = _step(weights, symbols[t], h)
        states[t] = h
        if trace is not None:
            trace.append((t, seen))
    return states


def _probabilities(network: Network, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Per language and segment, for one step."""
    units = len(ahead)
    scores = network.output[:, :units] @ ahead
    scores += network.output[:, units:] @ back
    scores += network.bias
    scores -= scores.max(axis=0)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=0)
    return scores


def label_sums(network: Network, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of the byte probabilities of every segment, ``(languages, segments)``."""
    back = _run(network.back, symbols, True)
    ahead = _run(network.ahead, symbols, False)
    total = np.zeros((len(network.languages), symbols.shape[1]))
    for t in range(len(symbols)):
        total += _probabilities(network, ahead[t], back[t]) * (t < lengths)
    return total


def _backward(weights: Direction, trace: list, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``inputs`` and ``state``, through time."""
    inputs, state = np.zeros_like(weights.inputs), np.zeros_like(weights.state)
    units = weights.state.shape[1]
    later = np.zeros(gradient.shape[1:], np.float32)
    for t, (symbols, h, update, reset, memory, candidate) in reversed(trace):
        later = later + gradient[t]
        pre = np.empty((3 * units, h.shape[1]), np.float32)
        from_candidate = later * (1 - update) * (1 - candidate**2)
        pre[:units] = later * (h - candidate) * update * (1 - update)
        pre[units : 2 * units] = from_candidate * memory * reset * (1 - reset)
        pre[2 * units :] = from_candidate
        for row, values in zip(inputs, pre):
            row += np.bincount(symbols, values, PAD + 1)
        pre[2 * units :] *= reset
        state += pre @ h.T
        later = later * update + weights.state.T @ pre
    return inputs, state


def gradients(network: Network, symbols: np.ndarray, lengths: np.ndarray, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all bytes and its gradients, by backpropagation through time."""
    traces: tuple[list, list] = [], []
    ahead = _run(network.ahead, symbols, False, traces[0])
    back = _run(network.back, symbols, True, traces[1])
    units, n = ahead.shape[1], max(1, int(lengths.sum()))
    output, bias, loss = np.zeros_like(network.output), np.zeros_like(network.bias), 0.0
    to_ahead, to_back = np.zeros_like(ahead), np.zeros_like(back)
    columns = np.arange(symbols.shape[1])
    for t in range(len(symbols)):
        p = _probabilities(network, ahead[t], back[t])
        valid = (t < lengths).astype(np.float32)
        loss -= float((np.log(p[truth, columns] + 1e-9) * valid).sum())
        p[truth, columns] -= 1
        p *= valid / n
        output[:, :units] += p @ ahead[t].T
        output[:, units:] += p @ back[t].T
        bias += p.sum(axis=1, keepdims=True)
        to_ahead[t] = network.output[:, :units].T @ p
        to_back[t] = network.output[:, units:].T @ p
    return loss / n, [*_backward(network.ahead, traces[0], to_ahead), *_backward(network.back, traces[1], to_back), output, bias]


def symbols_of(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``(SEGMENT, segments)`` symbols of byte ranges of ``buffer``."""
    steps = np.arange(SEGMENT)[:, None]
    symbols = np.take(buffer, starts + steps, mode="clip") if len(buffer) else np.zeros((SEGMENT, len(starts)))
    return np.where(steps < lengths, symbols, PAD).astype(np.int64)


def train(texts: list[tuple[str, str]], updates: int = UPDATES, seed: int = SEED) -> Network:
    """Fit a network on ``(language, text)`` pairs, a segment from each text's start."""
    rng = np.random.default_rng(seed)
    languages = sorted({language for language, _ in texts})
    network = new_network(languages, rng)
    pieces = [text.encode()[:SEGMENT] for _, text in texts]
    truth = np.array([languages.index(language) for language, _ in texts], dtype=np.int64)
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    symbols = symbols_of(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(lengths) - lengths, lengths)
    weights = network.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    order = np.zeros(0, np.int64)
    for update in range(1, updates + 1):
        if len(order) < BATCH:  # the next round through the sample
            order = np.concatenate([order, rng.permutation(len(texts))])
        chosen, order = order[:BATCH], order[BATCH:]
        _, slopes = gradients(network, symbols[:, chosen], lengths[chosen], truth[chosen])
        rate = RATE * (1 - (update - 1) / updates)
        for w, g, m, v in zip(weights, slopes, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**update)) / (np.sqrt(v / (1 - 0.99**update)) + 1e-8)
    return network


def predict(network: Network, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language number and pooled probability per text; every byte is read.
    A text without bytes gets number 0 and probability 0."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    counts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), counts)
    within = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * SEGMENT
    starts, lengths = offsets[owner] + within, np.minimum(SEGMENT, sizes[owner] - within)
    pooled = np.zeros((len(network.languages), len(texts)))
    for low in range(0, len(owner), SIDE_BY_SIDE):
        part = slice(low, low + SIDE_BY_SIDE)
        sums = label_sums(network, symbols_of(buffer, starts[part], lengths[part]), lengths[part])
        for language, values in enumerate(sums):
            pooled[language] += np.bincount(owner[part], values, len(texts))
    pooled /= np.maximum(sizes, 1)
    best = pooled.argmax(axis=0) if len(network.languages) else np.zeros(len(texts), np.int64)
    return best, np.clip(pooled[best, np.arange(len(texts))], 0, 1)


def is_held_out(key: Column) -> Column:
    """Every third document is never learned from; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, text: str, label: str, key: str, limit: int = TRAIN_DOCS, cuts: int = TRAIN_CUTS) -> list[tuple[str, str]]:
    """Labelled cuts of at most ``limit`` documents, chosen by a hash of key and
    text among those that are not held out and have a key, a text and a label."""
    usable = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(label).isNotNull() & ~is_held_out(F.col(key)))
    places = [F.substring(F.col(text), (F.length(text) * i / cuts).cast("int") + 1, F.lit(SEGMENT)) for i in range(cuts)]
    cut = usable.select(F.xxhash64(key, text).alias("draw"), F.col(label).alias("label"), F.array(*places).alias("cuts"))
    share = min(1.0, 4 * limit / max(1, usable.count()))  # draws are even, so only the lowest need to be sorted
    cut = cut.where(F.col("draw") <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1))
    rows = cut.orderBy("draw", "label").limit(limit).collect()
    return [(row["label"], piece) for row in rows for piece in row["cuts"] if piece]


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", limit: int = TRAIN_DOCS) -> Network | None:
    """A network from a bounded sample of labelled rows; None without any."""
    sample = training_sample(docs, text, label, key, limit)
    return train(sample) if sample else None


def identify(docs: DataFrame, network: Network | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: ``row``, a struct of the ``carry`` columns (all by
    default), ``lang_pred`` and ``score``.

    Null texts, and texts without a letter, are ``und`` with score 0, and so is
    everything if there was nothing to learn from. Languages are predicted from
    the bytes of the whole text alone; copies get the same prediction.
    """
    rows = docs.select(
        F.struct(*[F.col(c) for c in carry or docs.columns]).alias("row"),
        F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).otherwise(F.lit("")).alias("text"),
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if network is None:
                best, score, languages = np.zeros(len(batch), np.int64), np.zeros(len(batch)), [UNKNOWN]
            else:
                best, score = predict(network, batch.column(1))
                languages = network.languages
            names = np.array(languages, dtype=object)[best]
            names[score == 0] = UNKNOWN
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    schema = StructType([rows.schema["row"]]).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(scan, schema)


def keep_identified(docs: DataFrame, network: Network | None, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The documents in a language the network tells with at least ``least``
    probability, as whole rows."""
    kept = identify(docs, network, text).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
