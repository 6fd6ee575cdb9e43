"""SentencePiece encoding by forward filtering and backward sampling; lossless decoding.

The lattice of a text has its byte positions as nodes and every vocabulary piece
that fits as an edge (``▁`` of a piece stands for the space; a character without
a piece of its own is spelt in byte pieces, a ``▁`` in the text among them).
Forward filtering sums the weight of all paths to each node; backward sampling
then walks from the end, choosing each last piece in proportion to the paths
through it, so a segmentation is drawn exactly from its distribution.

No piece holds a space behind another character, so the lattice falls apart at
the spaces, and bytes of no longer piece stand alone.  Filtering runs once over the
distinct segments of a batch; sampling runs over all occurrences at once, each
with random numbers made from (seed, row key, place in the row): the same key and
text give the same pieces on any cluster.

Weights: a unigram model's log probabilities; a BPE model's scores are merge
ranks, taken as a Zipf law, 1 / (rank + 2); ``theta`` sharpens or flattens both.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.base import U64, blob, mix, pieces, range_hash, running_sum

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Weight of a byte piece; it competes with nothing, its character has no piece.
BYTE_WEIGHT = 1e-5
#: Segments are filtered as plain products while their least likely path stays above
#: this; longer ones byte by byte in logarithms.
LEAST_PRODUCT = 1e-300
#: Text sampled at once.  More shares more segments, but the lattice takes some 100 bytes
#: for each byte, in every task of an executor at the same time.
SAMPLE_BYTES = 512 << 10


class Vocabulary:
    """Pieces as bytes and the trie of their reversals, in arrays that can be sent."""

    def __init__(self, piece: list[bytes], weight: list[float], normal: list[bool], byte_id: list[int]):
        self.byte_id = np.array(byte_id, dtype=np.int32)
        self.blob = np.frombuffer(b"".join(piece), dtype=np.uint8)
        self.size = np.array([len(p) for p in piece], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.weight = np.array(weight)
        trie: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for k, p in enumerate(piece):
            if normal[k]:
                node = 0
                for b in reversed(p):
                    node = trie[node].setdefault(b, len(trie))
                    if node == len(trie):
                        trie.append({})
                ends.setdefault(node, k)
        order = sorted(range(len(trie)), key=lambda n: (not trie[n], n))  # inner nodes first
        number = {n: i for i, n in enumerate(order)}
        self.inner = sum(bool(t) for t in trie)
        self.edges = np.array([(number[n], b, number[c]) for n, t in enumerate(trie) for b, c in t.items()], dtype=np.int32)
        self.piece_of = np.full(len(trie), -1, dtype=np.int32)
        for n, k in ends.items():
            self.piece_of[number[n]] = k
        inside = {b for k, p in enumerate(piece) if normal[k] and len(p) > 1 for b in p}
        self.alone = np.array([b not in inside for b in range(256)])
        self.words = not any(b" " in p.lstrip(b" ") for k, p in enumerate(piece) if normal[k])
        chars = {p for k, p in enumerate(piece) if normal[k] and len(p) <= 4 and _one_char(p)}
        self.chars = np.array(sorted(int.from_bytes(p, "big") for p in chars), dtype=np.int64)

    @classmethod
    def load(cls, path: str = MODEL, theta: float = 1.0) -> "Vocabulary":
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        is_byte = [sp.is_byte(i) for i in range(n)]
        if sum(is_byte) != 256:
            raise ValueError("the model has no byte pieces: unknown characters would be lost")
        normal = [not (is_byte[i] or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        piece = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if is_byte[i] else
                 sp.id_to_piece(i).replace("▁", " ").encode() if normal[i] else b"" for i in range(n)]
        byte_id = [0] * 256
        for i in range(n):
            if is_byte[i]:
                byte_id[piece[i][0]] = i
        score = [sp.get_score(i) for i in range(n)]
        own = sorted((i for i in range(n) if normal[i]), key=lambda i: (-score[i], i))
        ranks = all(score[i] == round(score[i]) for i in own)  # merge ranks, not log probabilities
        weight = [BYTE_WEIGHT] * n
        for r, i in enumerate(own):
            weight[i] = (1 / (r + 2)) ** theta if ranks else float(np.exp(theta * score[i]))
        return cls(piece, weight, normal, byte_id)

    def ready(self) -> "Vocabulary":
        """With the dense table of transitions (made in the task, not sent)."""
        if not hasattr(self, "next"):
            self.next = np.full((self.inner + 1, 256), -1, dtype=np.int32)
            self.next[self.edges[:, 0], self.edges[:, 1]] = self.edges[:, 2]
            known = np.where(self.piece_of >= 0, self.piece_of, 0)
            self.gain = np.where(self.piece_of >= 0, self.weight[known], 0.0)
            # no path over this many bytes weighs less than LEAST_PRODUCT: a piece has a byte at least
            least = min(float(self.gain[self.gain > 0].min(initial=1.0)), BYTE_WEIGHT, 0.5)
            self.linear = int(np.log(LEAST_PRODUCT) / np.log(least))
            self.step, self.ids = memoryview(self.next.ravel()), self.piece_of.tolist()
            with np.errstate(divide="ignore"):
                self.logs = np.log(self.gain).tolist()
        return self


def _one_char(p: bytes) -> bool:
    try:
        return len(p.decode()) == 1
    except UnicodeDecodeError:
        return False


def segments(v: Vocabulary, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the stretches that no piece can cross; a character without a piece is one of its own."""
    cut = np.zeros(len(data), dtype=bool)
    cut[off[:-1][off[:-1] < len(data)]] = True
    if v.words:
        space = data == 0x20
        cut[1:] |= space[1:] & ~space[:-1]
    lone = v.alone[data]
    cut |= lone
    cut[1:] |= lone[:-1]
    unknown = spelt(v, data)
    cut |= unknown & ((data & 0xC0) != 0x80)
    cut[1:] |= unknown[:-1] & ~unknown[1:]
    return np.flatnonzero(cut)


def spelt(v: Vocabulary, data: np.ndarray) -> np.ndarray:
    """Bytes of characters that have no piece."""
    head = (data & 0xC0) != 0x80
    head[0] = True
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, len(data)))
    code = np.zeros(len(start), dtype=np.int64)
    for k in range(4):
        more = size > k
        code[more] = code[more] << 8 | data[start[more] + k]
    place = np.minimum(np.searchsorted(v.chars, code), len(v.chars) - 1)
    return np.repeat((v.chars[place] != code) | (size > 4), size)


def filter_forward(v: Vocabulary, text: np.ndarray, lone: np.ndarray, base: np.ndarray, length: np.ndarray,
                   total: np.ndarray, which: np.ndarray) -> None:
    """Fill in ``total`` the weight of all paths to each node of the chosen segments.

    Segment s has its nodes at ``base[s] + s`` onwards, one more than its bytes.
    """
    pick = np.flatnonzero(which)
    if not len(pick):
        return
    order = pick[np.argsort(-length[pick], kind="stable")]
    at, size, node = base[order], length[order], (base + np.arange(len(base)))[order]
    total[node] = 1.0
    for r in range(1, int(size[0]) + 1):
        n = int(np.searchsorted(-size, -r, side="right"))
        end, nd = at[:n] + r, node[:n] + r
        acc = np.zeros(n)
        low = np.flatnonzero(lone[end - 1])
        acc[low] = total[nd[low] - 1] * BYTE_WEIGHT
        who = np.flatnonzero(~lone[end - 1])
        state = np.zeros(len(who), dtype=np.int32)
        for k in range(1, r + 1):
            state = v.next[state, text[end[who] - k]]
            ok = state >= 0
            who, state = who[ok], state[ok]
            if not len(who):
                break
            hit = v.piece_of[state] >= 0
            w, s = who[hit], state[hit]
            acc[w] += total[nd[w] - k] * v.gain[s]
            inner = state < v.inner
            who, state = who[inner], state[inner]
        total[nd] = acc


def filter_long(v: Vocabulary, text: bytes) -> list[float]:
    """Logarithm of the weight of all paths to each node of one segment of known characters."""
    step, ids, logs, inner = v.step, v.ids, v.logs, v.inner
    total = [0.0] * (len(text) + 1)
    for r in range(1, len(text) + 1):
        state, k, terms = 0, r - 1, []
        while k >= 0:
            state = step[state << 8 | text[k]]
            if state < 0:
                break
            if ids[state] >= 0 and total[k] > -math.inf:
                terms.append(total[k] + logs[state])
            if state >= inner:
                break
            k -= 1
        if len(terms) < 2:
            total[r] = terms[0] if terms else -math.inf
        else:
            top = max(terms)
            total[r] = top + math.log(sum(math.exp(t - top) for t in terms))
    return total


def sample_long(v: Vocabulary, text: bytes, total: list[float], u: list[float]) -> list[int]:
    """Piece ids of one segment, drawn backwards; ``u[n]``: the number drawn with n bytes left."""
    step, ids, logs, inner = v.step, v.ids, v.logs, v.inner
    out, left = [], len(text)
    while left:
        state, k, acc, got, to = 0, left - 1, 0.0, -1, left
        while k >= 0:
            state = step[state << 8 | text[k]]
            if state < 0:
                break
            if ids[state] >= 0 and total[k] > -math.inf:
                acc += math.exp(total[k] + logs[state] - total[left])
                got, to = ids[state], k  # stands unless a longer piece is reached
                if acc > u[left]:
                    break
            if state >= inner:
                break
            k -= 1
        if got < 0:
            raise ValueError("a known character has no piece")
        out.append(got)
        left = to
    return out[::-1]


def sample(v: Vocabulary, data: np.ndarray, off: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all rows, n + 1 offsets of the rows in them)."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    v.ready()
    start = segments(v, data, off)
    size = np.diff(np.append(start, len(data)))
    row = np.searchsorted(off, start, side="right") - 1
    _, first, kind = np.unique(range_hash(running_sum(data), start, start + size), return_index=True, return_inverse=True)

    # the distinct segments side by side, and the weights to their nodes
    at = start[first]
    length = size[first]
    base = np.cumsum(length) - length
    text = data[np.repeat(at - base, length) + np.arange(int(length.sum()))]
    lone = spelt(v, text)
    total = np.zeros(len(text) + len(base))
    unknown = lone[base]  # the first byte tells: such a character is a segment of its own
    long = (length > v.linear) & ~unknown
    filter_forward(v, text, lone, base, length, total, ~long)

    # backward sampling over all occurrences
    node_of = base + np.arange(len(base))
    with np.errstate(over="ignore"):
        stream = mix(keys.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed))[row] + (start - off[row]).astype(U64) * U64(0xD1B54A32D192ED03)

    def drawn(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(stream[at] + left.astype(U64)) >> U64(11)).astype(np.float64) * 2.0 ** -53

    count = np.zeros(len(start), dtype=np.int64)
    slow: dict[int, list[int]] = {}
    for k in np.flatnonzero(long).tolist():
        part = text[base[k]:base[k] + length[k]].tobytes()
        logs = filter_long(v, part)
        for o in np.flatnonzero(kind == k).tolist():
            slow[o] = sample_long(v, part, logs, drawn(np.full(len(part) + 1, o), np.arange(len(part) + 1)).tolist())
            count[o] = len(slow[o])

    active = np.argsort(kind, kind="stable")  # equal segments together: near reads
    active = active[~long[kind[active]]]
    left = size.copy()
    ids, owners = [], []
    while len(active):
        k0 = kind[active]
        end, nd = base[k0] + left[active], node_of[k0] + left[active]
        goal = drawn(active, left[active]) * total[nd]
        got, took = np.full(len(active), -1, dtype=np.int32), np.ones(len(active), dtype=np.int64)
        low = np.flatnonzero(lone[end - 1])
        got[low] = v.byte_id[text[end[low] - 1]]
        who = np.flatnonzero(~lone[end - 1])
        state = np.zeros(len(who), dtype=np.int32)
        acc = np.zeros(len(who))
        k = 1
        while len(who):
            state = v.next[state, text[end[who] - k]]
            ok = state >= 0
            who, state, acc = who[ok], state[ok], acc[ok]
            hit = np.flatnonzero(v.piece_of[state] >= 0)
            w, s = who[hit], state[hit]
            part = total[nd[w] - k] * v.gain[s]
            real = part > 0
            hit, w, s = hit[real], w[real], s[real]
            acc[hit] += part[real]
            got[w], took[w] = v.piece_of[s], k  # stands unless a longer piece is reached
            done = np.zeros(len(who), dtype=bool)
            done[hit] = acc[hit] > goal[w]
            k += 1
            go = ~done & (state < v.inner) & (left[active[who]] >= k)
            who, state, acc = who[go], state[go], acc[go]
        if (got < 0).any():
            raise ValueError("a known character has no piece")
        ids.append(got)
        owners.append(active)
        left[active] -= took
        active = active[left[active] > 0]

    for o in owners:
        count[o] += 1
    last = np.cumsum(count) - 1
    out = np.zeros(int(last[-1]) + 1, dtype=np.int32)
    for step, (o, i) in enumerate(zip(owners, ids)):
        out[last[o] - step] = i
    for o, i in slow.items():
        out[last[o] - len(i) + 1:last[o] + 1] = i
    per_row = np.bincount(row, weights=count, minlength=len(off) - 1).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(per_row)])


def spell(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes of the pieces one after another."""
    size = v.size[ids]
    base = np.cumsum(size) - size
    return v.blob[np.repeat(v.at[ids] - base, size) + np.arange(int(size.sum()))]


def encode(docs: DataFrame, model: str = MODEL, seed: int = 42, theta: float = 1.0,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, pieces, lossless): one sampled segmentation of each text.

    ``lossless``: the pieces spell the text's bytes again.  Null and empty texts
    have no pieces; rows of equal id and text have equal pieces; a null id is a
    key of its own; an empty table gives no rows; a very long text is worked on whole,
    in time proportional to it.  ``model`` is read on the driver and sent to the tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model, theta))

    def run(batches):
        v = sent.value
        for rb in pieces(batches, "text", SAMPLE_BYTES):
            data, off = blob(rb.column("text"))
            keys = rb.column("key").to_numpy(zero_copy_only=False)
            ids, cut = sample(v, data, off, keys, seed)
            again = spell(v, ids) if len(ids) else data[:0]
            if len(again) == len(data):
                bad = np.searchsorted(off, np.flatnonzero(again != data), side="right") - 1
                good = np.ones(rb.num_rows, dtype=bool)
                good[bad] = False
            else:
                good = np.zeros(rb.num_rows, dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), pa.array(np.diff(cut)),
                 pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids)), pa.array(good)],
                ["doc_id", "n_pieces", "pieces", "lossless"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col)).alias("key"),
                       F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, n_pieces long, pieces array<int>, lossless boolean")


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """(doc_id, text) from the pieces (null pieces: null text)."""
    sent = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches):
        v = sent.value
        for rb in batches:
            texts = [None if ids is None else spell(v, np.array(ids, dtype=np.int64)).tobytes().decode("utf-8", "replace")
                     for ids in rb.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(pieces_col).alias("pieces")) \
        .mapInArrow(run, "doc_id long, text string")
