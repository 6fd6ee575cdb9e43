"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all other training text,
toxic or not, is the unlabelled set.  With class prior p and the logistic loss l, the
risk of a classifier g is  p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)]):
the bracket is the risk on negatives, estimated without any, and it is kept from
going below zero, where it would only reward overfitting.

Three linear classifiers in numpy, over hashed features that a document has or has
not: its words, the beginnings of its words, and both.  Their mean probability is the
score.  Training takes at most ``positives`` and ``unlabelled`` documents (the
first in order of a hash of their ids), scoring takes all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import U64, ascii_lower, blob, held_out, pieces, range_hash, running_sum

BITS = 20
BEGINNINGS = (5, 6, 7, 8, 10)
POSITIVES, UNLABELLED = 3000, 6000
#: A feature is kept when this share of the positives (and three of them) have it, and
#: it is ``TELLING`` times as common among them as among the unlabelled.
MIN_SHARE, TELLING = 0.02, 3


def word_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row, view): 0 for whole words, 1 for their beginnings of some bytes."""
    data = ascii_lower(data)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128) | ((data >= 48) & (data <= 57))
    if not letter.any():
        z = np.zeros(0, np.int64)
        return z, z, z
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    edge = off[1:-1][off[1:-1] < len(data)]
    first[edge] = letter[edge]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    last[edge[edge > 0] - 1] = letter[edge[edge > 0] - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(off, s, side="right") - 1
    sums = running_sum(data)
    shift = U64(64 - BITS)
    out = [((range_hash(sums, s, e) >> shift).astype(np.int64), row, np.zeros(len(s), np.int64))]
    for n in BEGINNINGS:
        at = np.flatnonzero(e - s >= n)
        salt = U64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        out.append(((range_hash(sums, s[at], s[at] + n) + salt >> shift).astype(np.int64), row[at], np.ones(len(at), np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out))


@dataclass
class Model:
    """One dense weight table for each classifier, nearly all zero."""

    tables: list[tuple[int, np.ndarray, np.ndarray, float]]  # view (2: both), buckets, weights, bias

    def dense(self) -> list[tuple[int, np.ndarray, float]]:
        out = []
        for view, bucket, weight, bias in self.tables:
            full = np.zeros((2, 1 << BITS), dtype=np.float32)
            full[bucket >> BITS, bucket & (1 << BITS) - 1] = weight
            out.append((view, full, bias))
        return out


def score_rows(dense: list, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean probability of the classifiers for each row."""
    n = len(off) - 1
    bucket, row, view = word_features(data, off)
    used = np.zeros(len(bucket), dtype=bool)
    for _, full, _ in dense:
        used |= full[view, bucket] != 0
    key = np.unique((row[used] << (BITS + 1)) | (view[used] << BITS) | bucket[used])
    row, view, bucket = key >> (BITS + 1), key >> BITS & 1, key & (1 << BITS) - 1
    total = np.zeros(n)
    for _, full, bias in dense:
        margin = bias + np.bincount(row, weights=full[view, bucket], minlength=n)
        total += 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
    return total / max(1, len(dense))


def fit(p_sets: list[np.ndarray], u_sets: list[np.ndarray], prior: float, steps: int = 300,
        rate: float = 0.1, decay: float = 2e-3) -> Model:
    """nnPU training of the three classifiers on sets of features (view << BITS | bucket)."""
    tables = []
    for view in (0, 1, 2):
        pick = lambda sets: [x if view == 2 else x[x >> BITS == view] for x in sets]
        p, u = pick(p_sets), pick(u_sets)
        names = _frequent(p)
        P, U = _matrix(p, names), _matrix(u, names)
        rate_p, rate_u = _count(P, len(names)) / max(1, len(p)), _count(U, len(names)) / max(1, len(u))
        good = np.flatnonzero(rate_p > TELLING * rate_u)
        names = names[good]
        P, U = _matrix(p, names), _matrix(u, names)
        w, b = np.zeros(len(names)), np.array(-2.0)
        state = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros(()), np.zeros(())]]
        for step in range(1, steps + 1):
            gp, gu = _margin(P, w, b, len(p)), _margin(U, w, b, len(u))
            sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean() if len(u) and len(p) else 0.0
            if negative >= 0:
                parts = ((P, np.full(len(p), -prior / max(1, len(p)))), (U, su / max(1, len(u))))  # both terms
            else:
                parts = ((P, prior * sp / max(1, len(p))), (U, -su / max(1, len(u))))  # climb back to a risk of zero
            grad_w = sum(np.bincount(m[1], weights=d[m[0]], minlength=len(names)) for m, d in parts) + decay * w / max(1, len(names)) ** 0.5
            grad_b = sum(d.sum() for _, d in parts)
            for k, (x, g) in enumerate(((w, grad_w), (b, grad_b))):
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        tables.append((view, names, w, float(b)))
    return Model(tables)


def _matrix(sets: list[np.ndarray], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the features that are among ``names``."""
    if not sets or not len(names):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
    ok = names[at] == flat
    return row[ok], at[ok]


def _count(m: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    return np.bincount(m[1], minlength=n)


def _margin(m: tuple[np.ndarray, np.ndarray], w: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    return np.clip(b + np.bincount(m[0], weights=w[m[1]], minlength=n), -50, 50)


def _frequent(sets: list[np.ndarray]) -> np.ndarray:
    """The features that enough of the positives have."""
    names, seen = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.int64), np.zeros(0))
    return names[seen >= max(3, MIN_SHARE * len(sets))]


def _sets(docs: DataFrame, names: np.ndarray | None = None) -> list[np.ndarray]:
    """Feature sets of a bounded sample, in order of id; ``names``: of these features only."""

    def run(batches):
        for rb in pieces(batches):
            bucket, row, view = word_features(*blob(rb.column("text")))
            key = np.unique(row << (BITS + 1) | view << BITS | bucket)
            if names is not None:
                key = key[np.isin(key & (1 << BITS + 1) - 1, names)]
            cut = np.searchsorted(key, np.arange(rb.num_rows + 1) << (BITS + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), pa.ListArray.from_arrays(pa.array(cut), pa.array((key & (1 << BITS + 1) - 1).astype(np.int32)))],
                ["doc_id", "features"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, features array<int>").orderBy("doc_id").toArrow()
    return [x.values.to_numpy().astype(np.int64) for x in rows.column("features")]


def first_by_hash(ids: DataFrame, n: int) -> DataFrame:
    """At most n ids, the same whatever the partitions."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, positives: int = POSITIVES,
          unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """Fit on rows that are not held out.  A document with several labels is toxic if any says so.

    ``prior``: the share of toxic text, by default that among the labelled training rows.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out("doc_id", mod, rest)) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = marks.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    prior = prior if prior is not None else min(0.5, max(0.01, share or 0.01))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .where(F.col("doc_id").isNotNull()).where(~held_out("doc_id", mod, rest))
    known = first_by_hash(marks.where("toxic = 1").select("doc_id"), positives)
    any_text = first_by_hash(texts.select("doc_id"), unlabelled)
    p_sets = _sets(texts.join(F.broadcast(known), "doc_id", "left_semi"))
    return fit(p_sets, _sets(texts.join(F.broadcast(any_text), "doc_id", "left_semi"), _frequent(p_sets)), prior)


def score_documents(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, threshold: float = 0.5, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts have no features and the score of the biases alone;
    without any positive example the score stays under the threshold; a null
    doc_id is not held out and trains nothing; repeated rows each give a row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, mod, rest, **how))

    def run(batches):
        dense = sent.value.dense()
        for rb in pieces(batches):
            value = score_rows(dense, *blob(rb.column("text")))
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("held_out"), pa.array(value),
                                              pa.array((value >= threshold).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", mod, rest).alias("held_out"),
                       F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
