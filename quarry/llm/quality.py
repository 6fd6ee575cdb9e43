"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad.  Its evidence is its own shape (length, case,
symbols, bars, digits, repeated words, ...) and that of the lines before and after
it; a learned transition says how lines follow each other.  Forward-backward gives
each line's probability of being good, and the mean of these, weighted by the
lines' lengths, is the document's score.

Training labels every line with its document's label and climbs the conditional
likelihood in numpy, on the whole texts of a bounded sample: of each label the first
``per_class`` documents in order of a hash of their ids, as many as have
``max_lines`` lines together.  Scoring takes whole texts of any number of lines; the
features are made for ``BLOCK`` lines at a time and only three numbers a line are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import U64, blob, held_out, pieces, range_hash, running_sum, word_ranges
from quarry.llm.toxicity import first_by_hash

PER_CLASS = 2000
#: Lines of the training documents of one label.
MAX_LINES = 100_000
#: Lines whose features are held at once while scoring.
BLOCK = 1 << 16
#: Lines of a chain that are worked through one after the other.
SPAN = 1024
#: The fit goes back to its best step if the last one has a line's label this much less likely (mean logarithm).
SWING = 0.05
_CLASS = np.zeros(256, dtype=np.int64)  # 0 other
for _lo, _hi, _k in ((97, 122, 1), (65, 90, 2), (48, 57, 3), (128, 255, 4)):
    _CLASS[_lo:_hi + 1] = _k
for _c in b"#*$%&<>@^~=+{}[]\\_/":
    _CLASS[_c] = 5
for _c in b"|":
    _CLASS[_c] = 6
for _c in b"!?":
    _CLASS[_c] = 7
for _c in b".,;:'\"()-":
    _CLASS[_c] = 8
for _c in b" \t\n\r\x0b\x0c":
    _CLASS[_c] = 9
N_SHAPE = 19


def lines_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the newline-separated lines; an empty text is one empty line."""
    cut = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([off[:-1], cut + 1]))
    row = np.sort(np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, cut, side="right") - 1]))
    end = np.append(start[1:], off[-1])
    newline = np.append(row[1:] == row[:-1], False)
    return start, end - newline, row


def shapes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its length in bytes, its row)."""
    start, end, row = lines_of(data, off)
    return _shapes(data, start, end, np.append(start, off[-1])), end - start, row


def evidence(data: np.ndarray, off: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight of 'good' of each line from itself and its neighbours, its length in bytes, its row)."""
    start, end, row = lines_of(data, off)
    edges, parts = np.append(start, off[-1]), emit.reshape(3, N_SHAPE).T
    told = np.empty((len(start), 3))  # what a line says of itself, of the line after it and of the line before it
    for a in range(0, len(start), BLOCK):
        b = min(a + BLOCK, len(start))
        lo, hi = edges[a], edges[b]
        told[a:b] = _shapes(data[lo:hi], start[a:b] - lo, end[a:b] - lo, edges[a:b + 1] - lo) @ parts
    good, same = told[:, 0].copy(), row[1:] == row[:-1]
    good[1:][same] += told[:-1, 1][same]
    good[:-1][same] += told[1:, 2][same]
    return good, end - start, row


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray, edges: np.ndarray) -> np.ndarray:
    n, size = len(start), end - start
    counts = np.zeros((n, 10))
    if len(data):
        owner = np.repeat(np.arange(n), np.diff(edges))
        counts = np.bincount(owner * 10 + _CLASS[data], minlength=n * 10).reshape(n, 10).astype(float)
        counts[:, 9] -= np.diff(edges) - size  # the newline itself
    chars = np.maximum(1, size - counts[:, 9])[:, None]
    ws, we, _ = word_ranges(data, edges)
    line = np.searchsorted(edges, ws, side="right") - 1
    words = np.bincount(line, minlength=n).astype(float)
    wordy = np.maximum(1, words)
    h = range_hash(running_sum(data), ws, we) if len(ws) else np.zeros(0, U64)
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    key = np.lexsort((h, line))
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[key][1:] != h[key][:-1]) | (line[key][1:] != line[key][:-1])
    distinct = np.bincount(line[key][fresh], minlength=n)
    last = np.where(size > 0, _CLASS[data[np.maximum(end - 1, 0)]] if len(data) else 0, 0)
    odd_end = np.isin(_CLASS[data[we - 1]], (5, 6, 7)) if len(ws) else np.zeros(0, bool)
    return np.column_stack([
        np.ones(n), size == 0, np.log1p(size) / 5, np.log1p(words) / 3, size < 40,
        counts[:, [1, 2, 3, 4, 5, 6, 7, 8]] / chars,
        np.bincount(line, weights=again, minlength=n) / wordy, 1 - distinct / wordy,
        np.bincount(line, weights=odd_end, minlength=n) / wordy, (size - counts[:, 9]) / wordy / 10,
        counts[:, 2] > counts[:, 1], last == 8]).astype(float)


def with_neighbours(shape: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Own features, then those of the line before and after (zero at a text's ends)."""
    before, after = np.zeros_like(shape), np.zeros_like(shape)
    same = row[1:] == row[:-1]
    before[1:][same] = shape[:-1][same]
    after[:-1][same] = shape[1:][same]
    return np.hstack([shape, before, after])


@dataclass
class Crf:
    """Weights of 'good' over 'bad' for a line's features, and of each transition."""

    emit: np.ndarray
    move: np.ndarray  # 2 x 2, from state to state; state 1 is good

    def marginals(self, good: np.ndarray, row: np.ndarray) -> np.ndarray:
        return forward_backward(np.clip(good, -30, 30), row, self.move, moves=False)[0]


def forward_backward(good: np.ndarray, row: np.ndarray, move: np.ndarray, moves: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected transitions of all chains (2 x 2; zeros without ``moves``).

    Chains are cut into blocks of ``SPAN`` lines, and all blocks are worked on side by side, one
    place in the block at a time.  Where a chain has several, each block's steps are first
    multiplied into one 2 x 2 matrix; these carry the messages from block to block.
    """
    n = len(good)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    size = np.diff(np.append(start, n))
    blocks = -(-size // SPAN)  # of each chain
    last = np.cumsum(blocks) - 1
    first = last - blocks + 1
    chain = np.repeat(np.arange(len(size)), blocks)
    number = np.arange(len(chain)) - first[chain]
    length = np.minimum(SPAN, size[chain] - number * SPAN)
    order = np.argsort(-length, kind="stable")
    live = np.searchsorted(-length[order], -np.arange(1, length.max() + 1), side="right")
    start, head = (start[chain] + number * SPAN)[order], (number == 0)[order]
    e = np.exp(np.column_stack([np.zeros(n), good]) - np.maximum(0, good)[:, None])
    t = np.exp(move - move.max())
    enter, leave = np.ones((len(chain), 2)), np.ones((len(chain), 2))
    if blocks.max() > 1:
        steps = np.tile(np.eye(2), (len(chain), 1, 1))
        for k, m in enumerate(live):
            step = t * e[start[:m] + k][:, None, :]
            if k == 0:
                step[head] = np.eye(2) * e[start[head]][:, None, :]
            steps[:m] = steps[:m] @ step
            steps[:m] /= steps[:m].sum(axis=(1, 2), keepdims=True)
        steps[order] = steps.copy()
        most = np.argsort(-blocks, kind="stable")
        for k in range(1, int(blocks.max())):
            c = most[:np.searchsorted(-blocks[most], -k)]
            b = first[c] + k
            a = (enter[b - 1][:, None, :] @ steps[b - 1])[:, 0]
            enter[b] = a / a.sum(axis=1, keepdims=True)
            b = last[c] - k
            a = (steps[b + 1] @ leave[b + 1][:, :, None])[:, :, 0]
            leave[b] = a / a.sum(axis=1, keepdims=True)
    enter, leave = enter[order], leave[order]
    fwd, bwd = np.empty((n, 2)), np.empty((n, 2))
    for k, m in enumerate(live):
        at = start[:m] + k
        a = (np.where(head[:, None], enter, enter @ t) if k == 0 else fwd[at - 1] @ t) * e[at]
        fwd[at] = a / a.sum(axis=1, keepdims=True)
    for k in range(len(live) - 1, -1, -1):
        at = start[:live[k]] + k
        b = leave[:live[k]].copy()
        more = live[k + 1] if k + 1 < len(live) else 0
        if more:
            nxt = at[:more] + 1
            b[:more] = (e[nxt] * bwd[nxt]) @ t.T
        bwd[at] = b / b.sum(axis=1, keepdims=True)
    p = fwd * bwd
    p /= p.sum(axis=1, keepdims=True)
    if not moves:
        return p[:, 1], np.zeros((2, 2))
    inner = np.flatnonzero(row[1:] == row[:-1]) + 1
    pair = fwd[inner - 1][:, :, None] * t[None] * (e[inner] * bwd[inner])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return p[:, 1], pair.sum(axis=0)


def fit(shape: np.ndarray, row: np.ndarray, label: np.ndarray, steps: int = 250, rate: float = 0.08, decay: float = 1e-4) -> Crf:
    """Climb the conditional log likelihood of the lines' labels (Adam, all chains at once).

    On long chains of equal lines a step can overshoot by the whole chain, and where the climb ends is
    then chance.  The last step stands unless an earlier one told the lines' labels clearly better.
    """
    x = with_neighbours(shape, row)
    model = Crf(np.zeros(x.shape[1]), np.zeros((2, 2)))
    if not len(x):
        return model
    inner = np.flatnonzero(row[1:] == row[:-1]) + 1
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner - 1], label[inner]), 1)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    best, top = theta, -np.inf
    for step in range(1, steps + 2):
        p, moves = forward_backward(np.clip(x @ theta[:-4], -30, 30), row, theta[-4:].reshape(2, 2))
        told = np.log(np.maximum(np.where(label == 1, p, 1 - p), 1e-12)).mean()
        if told > top:
            best, top = theta.copy(), told
        if step > steps:
            break
        grad = np.concatenate([x.T @ (label - p), (seen - moves).ravel()]) / len(x) - decay * theta
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        theta += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    if told < top - SWING:
        theta = best
    return Crf(theta[:-4], theta[-4:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, per_class: int = PER_CLASS,
          max_lines: int = MAX_LINES) -> Crf:
    """Fit on labelled rows that are not held out.  Of several labels of a document the worst counts.

    The sample is bounded by ``per_class`` documents and ``max_lines`` lines of each label and holds
    whole texts: a document that would bring more lines than are left is passed over.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")) \
        .where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out("doc_id", mod, rest)) \
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = first_by_hash(marks.where("quality = 0"), per_class).unionByName(first_by_hash(marks.where("quality = 1"), per_class))

    def run(batches):
        for rb in pieces(batches):
            shape, _, row = shapes(*blob(rb.column("text")))
            cut = np.searchsorted(row, np.arange(rb.num_rows + 1)).astype(np.int32) * N_SHAPE
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), rb.column("quality"), pa.ListArray.from_arrays(pa.array(cut), pa.array(shape.astype(np.float32).ravel()))],
                ["doc_id", "quality", "shape"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    counted = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality") \
        .agg(F.sum(F.coalesce(n_lines, F.lit(1)).cast("long")).alias("lines")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # 2 x per_class rows at most
    left, sample = {0: max_lines, 1: max_lines}, []
    for r in counted:
        if r["lines"] <= left[r["quality"]]:
            left[r["quality"]] -= r["lines"]
            sample.append((r["doc_id"], r["quality"]))
    fitting = docs.sparkSession.createDataFrame(sample, "doc_id long, quality int")
    rows = texts.join(F.broadcast(fitting), "doc_id").select("doc_id", "quality", "text") \
        .mapInArrow(run, "doc_id long, quality int, shape array<float>").orderBy("doc_id").toArrow()
    if not rows.num_rows:
        return Crf(np.zeros(3 * N_SHAPE), np.zeros((2, 2)))
    parts = [x.values.to_numpy().reshape(-1, N_SHAPE) for x in rows.column("shape")]
    row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    return fit(np.concatenate(parts).astype(float), row, rows.column("quality").to_numpy().astype(int)[row])


def score_documents(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, threshold: float = 0.7,
                    per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_lines, n_bad_lines) of every row.

    Null and empty texts are one empty line, which counts with weight one; other
    empty lines weigh nothing.  Without labels every score is 0.5.  A null doc_id
    is not held out and trains nothing; repeated rows each give a row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, mod, rest, per_class))

    def run(batches):
        model = sent.value
        for rb in pieces(batches):
            good, size, row = evidence(*blob(rb.column("text")), model.emit)
            p = model.marginals(good, row)
            n = rb.num_rows
            weight = np.where(np.bincount(row, weights=size, minlength=n)[row] > 0, size, 1.0)
            value = np.bincount(row, weights=p * weight, minlength=n) / np.bincount(row, weights=weight, minlength=n)
            value = np.clip(value, 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), rb.column("held_out"), pa.array(value), pa.array((value >= threshold).astype(np.int32)),
                 pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row[p < 0.5], minlength=n))],
                ["doc_id", "held_out", "score", "predicted", "n_lines", "n_bad_lines"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", mod, rest).alias("held_out"),
                       F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_lines long, n_bad_lines long")
