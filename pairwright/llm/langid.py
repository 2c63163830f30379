"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows, forwards and backwards, and gives every
position a probability for each language; a document's probabilities are the mean over all its
positions, and its score is the largest. It is trained here, in numpy, by backpropagation
through time, on windows of at most ``DOCS_PER_LANG`` documents of each language (those with
the smallest hash of their id), which is all that reaches the driver. Prediction sees the text
only and reads all of it.

Activations are x / (1 + |x|), and half of one plus that for gates: as good here as the usual
ones, and several times cheaper to compute.

A text that is null or has no letter is ``und`` with score 0. Rows without a language or text
are not learned from. With no such rows at all every text is ``und``. Ties of probabilities go
to the first language in alphabetical order. Rows that repeat are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.columns import text_slices, utf8

WINDOW = 64
HIDDEN = 8
# The bound of the training sample: documents per language and windows per document.
DOCS_PER_LANG = 400
WINDOWS_PER_DOC = 4
EPOCHS = 5
BATCH = 128
RATE = 0.02
# Windows worked on together in prediction.
STEP_WINDOWS = 8192
UNKNOWN = "und"
FOLDS = 5


def held_out(key: str):
    """Every fifth document by the checksum of its id is never learned from."""
    return F.crc32(F.col(key).cast("string")) % FOLDS == 0


def _fold_case() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


CASE = _fold_case()


def softsign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


@dataclass
class Network:
    """Weights of both directions, columns of positions side by side.

    ``inputs`` has a row of gate inputs (update, reset, candidate) for each byte.
    """

    langs: list[str]
    inputs: list[np.ndarray]  # (3 * hidden, 256)
    recurrent: list[np.ndarray]  # (3 * hidden, hidden)
    outputs: list[np.ndarray]  # (langs, hidden)
    bias: np.ndarray  # (langs, 1)

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)

        def some(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * 0.3).astype(np.float32)

        return cls(
            langs,
            [some(3 * hidden, 256) for _ in range(2)],
            [some(3 * hidden, hidden) for _ in range(2)],
            [some(len(langs), hidden) for _ in range(2)],
            np.zeros((len(langs), 1), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, *self.outputs, self.bias]

    def logits(self, data: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """(positions, langs, windows) for bytes (positions, windows); ``inside`` marks the
        positions that are text rather than filling."""
        steps, windows = data.shape
        hidden = self.recurrent[0].shape[1]
        out = np.empty((steps, len(self.langs), windows), np.float32)
        gates = np.empty((3 * hidden, windows), np.float32)
        size = np.empty_like(gates)
        own = np.empty_like(gates)
        for way, order in enumerate((range(steps), range(steps - 1, -1, -1))):
            inputs, recurrent, output = self.inputs[way], self.recurrent[way], self.outputs[way]
            state = np.zeros((hidden, windows), np.float32)
            for t in order:
                np.take(inputs, data[t], axis=1, out=gates, mode="clip")
                np.matmul(recurrent, state, out=own)
                both = gates[: 2 * hidden]
                both += own[: 2 * hidden]
                scale = np.abs(both, out=size[: 2 * hidden])
                scale += 1
                both /= scale
                both *= 0.5
                both += 0.5
                update, reset = both[:hidden], both[hidden:]
                reset *= own[2 * hidden :]
                new = gates[2 * hidden :]
                new += reset
                scale = np.abs(new, out=size[2 * hidden :])
                scale += 1
                new /= scale
                state -= new
                state *= update
                state += new
                if inside is not None:
                    state *= inside[t]
                if way == 0:
                    np.matmul(output, state, out=out[t])
                else:
                    out[t] += output @ state
        out += self.bias
        return out

    def probabilities(self, data: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """The language probabilities of every position."""
        out = self.logits(data, inside)
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """(texts, langs): the mean of the probabilities of all positions, 0 for empty texts."""
        data, offsets = utf8(texts)
        sizes = np.diff(offsets)
        per_text = -(-sizes // WINDOW)
        firsts = np.cumsum(per_text) - per_text
        text_of = np.repeat(np.arange(len(sizes)), per_text)
        nth = np.arange(len(text_of)) - firsts[text_of]
        begin = offsets[:-1][text_of] + nth * WINDOW
        length = np.minimum(sizes[text_of] - nth * WINDOW, WINDOW)
        data = np.concatenate([CASE[data], np.zeros(WINDOW, np.uint8)])
        sums = np.zeros((len(text_of), len(self.langs)), np.float64)
        cut = length < WINDOW
        for partial in (False, True):
            chosen = np.flatnonzero(cut == partial)
            for first in range(0, len(chosen), STEP_WINDOWS):
                some = chosen[first : first + STEP_WINDOWS]
                place = np.arange(WINDOW)[:, None]
                block = data[begin[some][None, :] + place]
                inside = None
                if partial:
                    inside = (place < length[some]).astype(np.float32)
                likely = self.probabilities(block, inside)
                if partial:
                    likely *= inside[:, None, :]
                sums[some] = likely.sum(axis=0).T
        out = np.zeros((len(sizes), len(self.langs)))
        filled = per_text > 0
        if filled.any():
            out[filled] = np.add.reduceat(sums, firsts[filled], axis=0) / sizes[filled, None]
        return out


def gradients(
    net: Network, data: np.ndarray, inside: np.ndarray, labels: np.ndarray
) -> tuple[float, list[np.ndarray]]:
    """Mean loss over positions and its gradients, by backpropagation through time."""
    steps, windows = data.shape
    hidden = net.recurrent[0].shape[1]
    kept: list[list] = [[None] * steps, [None] * steps]
    logits = np.repeat(net.bias[None], steps, 0).repeat(windows, 2)
    orders = (list(range(steps)), list(range(steps - 1, -1, -1)))
    for way, order in enumerate(orders):
        state = np.zeros((hidden, windows), np.float32)
        for t in order:
            x = net.inputs[way][:, data[t]]
            own = net.recurrent[way] @ state
            gate = softsign(x[: 2 * hidden] + own[: 2 * hidden]) * 0.5 + 0.5
            update, reset = gate[:hidden], gate[hidden:]
            new = softsign(x[2 * hidden :] + reset * own[2 * hidden :])
            before = state
            state = (new + update * (before - new)) * inside[t]
            kept[way][t] = (before, gate, new, own[2 * hidden :], state)
            logits[t] += net.outputs[way] @ state
    logits -= logits.max(axis=1, keepdims=True)
    likely = np.exp(logits)
    likely /= likely.sum(axis=1, keepdims=True)
    count = inside.sum()
    at = np.arange(windows)
    loss = -(np.log(likely[:, labels, at] + 1e-9) * inside).sum() / count
    likely[:, labels, at] -= 1
    error = likely * (inside / count)[:, None, :]

    d_inputs, d_recurrent, d_outputs = [], [], []
    for way, order in enumerate(orders):
        d_in = np.empty((3 * hidden, steps, windows), np.float32)
        d_rec = np.zeros_like(net.recurrent[way])
        d_out = np.zeros_like(net.outputs[way])
        d_state = np.zeros((hidden, windows), np.float32)
        for t in reversed(order):
            before, gate, new, own, state = kept[way][t]
            d_out += error[t] @ state.T
            d_state = (d_state + net.outputs[way].T @ error[t]) * inside[t]
            update, reset = gate[:hidden], gate[hidden:]
            d_new = d_state * (1 - update) * (1 - np.abs(new)) ** 2
            d_gate = np.concatenate([d_state * (before - new), d_new * own])
            d_gate *= 0.5 * (1 - np.abs(2 * gate - 1)) ** 2
            d_in[: 2 * hidden, t], d_in[2 * hidden :, t] = d_gate, d_new
            d_own = np.concatenate([d_gate, d_new * reset])
            d_rec += d_own @ before.T
            d_state = d_state * update + net.recurrent[way].T @ d_own
        flat = data.ravel()
        d_inputs.append(
            np.stack([np.bincount(flat, row.ravel(), 256) for row in d_in]).astype(np.float32)
        )
        d_recurrent.append(d_rec)
        d_outputs.append(d_out)
    d_bias = error.sum(axis=(0, 2))[:, None]
    return float(loss), [*d_inputs, *d_recurrent, *d_outputs, d_bias]


def trained(windows: list[tuple[str, bytes]], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network for labelled windows of text."""
    langs = sorted({lang for lang, _ in windows})
    net = Network.fresh(langs, seed=seed)
    number = {lang: i for i, lang in enumerate(langs)}
    labels = np.array([number[lang] for lang, _ in windows])
    sizes = np.array([min(len(w), WINDOW) for _, w in windows])
    data = np.zeros((WINDOW, len(windows)), np.uint8)
    for i, (_, window) in enumerate(windows):
        data[: sizes[i], i] = np.frombuffer(window[:WINDOW], np.uint8)
    data = CASE[data]
    inside = (np.arange(WINDOW)[:, None] < sizes).astype(np.float32)
    rng = np.random.default_rng(seed)
    params = net.parameters()
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step, total = 0, epochs * -(-len(windows) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for begin in range(0, len(order), BATCH):
            some = order[begin : begin + BATCH]
            _, grads = gradients(net, data[:, some], inside[:, some], labels[some])
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = RATE * (1 - step / (total + 1))
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g = g / max(1.0, norm)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                corrected = np.sqrt(v / (1 - 0.99**step)) + 1e-6
                p -= (rate * (m / (1 - 0.9**step)) / corrected).astype(np.float32)
    return net


def training_windows(
    documents: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> list[tuple[str, bytes]]:
    """Labelled windows of a bounded number of documents that are not held out.

    Only the windows are ranked and moved, and each task sends on at most ``DOCS_PER_LANG``
    documents of a language.
    """
    learn = documents.filter(
        ~held_out(key) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")
    )
    span = F.greatest(F.length(text) - WINDOW, F.lit(1)).cast("long")
    places = [F.pmod(F.xxhash64(F.col(key), F.lit(n)), span) + 1 for n in range(WINDOWS_PER_DOC)]
    windows = F.array(*[F.substring(F.col(text), p.cast("int"), F.lit(WINDOW)) for p in places])
    ranked = learn.select(
        F.col(lang).alias("label"),
        F.xxhash64(F.col(key)).alias("draw"),
        windows.alias("windows"),
    )
    ranked = ranked.withColumn(
        "nth", F.row_number().over(Window.partitionBy("label").orderBy("draw", "windows"))
    )
    rows = ranked.filter(F.col("nth") <= DOCS_PER_LANG).orderBy("label", "nth").collect()
    return [
        (row.label, raw) for row in rows for raw in dict.fromkeys(w.encode() for w in row.windows)
        if raw
    ]


def predict(
    documents: DataFrame, net: Network | None, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, held_out, lang_pred, score`` of every row's whole text."""
    slim = documents.select(
        F.col(key),
        F.coalesce(held_out(key), F.lit(False)).alias("held_out"),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("readable"),
        F.col(text).alias("content"),
    )
    schema = slim.select(key, "held_out").schema.add("lang_pred", "string").add("score", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, "content", STEP_WINDOWS * WINDOW):
            best, score = labelled(
                rows.column("content"), rows.column("readable").to_numpy(zero_copy_only=False), net
            )
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(best), pa.array(score)],
                names=schema.names,
            )

    return slim.mapInArrow(work, schema)


def labelled(
    texts: pa.Array, readable: np.ndarray, net: Network | None
) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    if net is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    pooled = net.pooled(texts)
    best = pooled.argmax(axis=1)
    names = [net.langs[b] if r else UNKNOWN for b, r in zip(best, readable, strict=True)]
    return names, np.where(readable, np.minimum(pooled.max(axis=1), 1.0), 0.0)


def learned(documents: DataFrame, **columns: str) -> Network | None:
    """A network trained on the table's labelled documents; None where there are none."""
    windows = training_windows(documents, **columns)
    return trained(windows) if windows else None


def keep_known(documents: DataFrame, net: Network | None) -> DataFrame:
    """All columns of the documents whose text is in one of the learned languages.

    Rejected are texts without a letter, and null ones. Where nothing could be learned, all texts
    with a letter stay. There is no floor on the score: some clean texts score lower than
    texts in no learned language.
    """
    rows = documents.select(
        F.struct("*").alias("row"),
        F.col("text").alias("content"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("readable"),
    )
    schema = rows.select("row").schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in text_slices(batches, "content", STEP_WINDOWS * WINDOW):
            names, _ = labelled(
                some.column("content"), some.column("readable").to_numpy(zero_copy_only=False), net
            )
            keep = pa.array([name != UNKNOWN for name in names], pa.bool_())
            yield some.select(["row"]).filter(keep)

    kept = rows.filter("readable") if net is None else rows.mapInArrow(work, schema)
    return kept.select(*[F.col("row")[c].alias(c) for c in documents.columns])
