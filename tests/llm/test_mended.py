"""Cases that once went wrong: underflow, equal ids with different texts, colliding windows, hot slices."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import base, language, lm, rules, sentencepiece, simhash

PROSE = "the cat sat on the mat and looked at the moon over the quiet old harbour town"


# ------------------------------------------------------------------ 10 pieces

@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece.Vocabulary.load().ready()


def round_trip(v, texts):
    data, off = base.blob(pa.array(texts, pa.string()))
    ids, cut = sentencepiece.sample(v, data, off, np.arange(len(texts)), 42)
    assert len(ids) == 0 or ids.min() >= 0
    for t, a, b in zip(texts, cut, cut[1:]):
        assert sentencepiece.spell(v, ids[a:b]).tobytes() == t.encode() if a < b else t == ""


def test_unknown_characters_and_spaceless_texts_are_lossless(vocabulary):
    rng = random.Random(10)
    odd = ["龘" * 25 + "abc", "\U00010330" * 30 + "hello", "\U00010000" * 48 + "end", "龘a" * 500, "a" * 9999, "的是不" * 3000, "́" * 300]
    ranges = [(0x20, 0x7E), (0xC0, 0x24F), (0x400, 0x4FF), (0x4E00, 0x9FFF), (0x10330, 0x1034A), (0x1F600, 0x1F64F), (1, 0x2FFF)]
    for _ in range(300):
        lo, hi = rng.choice(ranges)
        odd.append("".join(chr(rng.randint(lo, hi) if rng.random() < 0.9 else 0x20) for _ in range(int(10 ** rng.uniform(0, 3.5)))))
    round_trip(vocabulary, odd)


def test_long_and_short_segments_have_one_distribution(vocabulary):
    """The logarithmic path draws as the plain one does."""
    word = " there"
    data, off = base.blob(pa.array([word] * 20000))
    seen = []
    keep = vocabulary.linear
    try:
        for vocabulary.linear in (keep, 0):
            ids, cut = sentencepiece.sample(vocabulary, data, off, np.arange(20000), 5)
            seen.append([tuple(ids[a:b].tolist()) for a, b in zip(cut, cut[1:])])
    finally:
        vocabulary.linear = keep
    assert sum(x != y for x, y in zip(*seen)) < 5


def test_a_megabyte_without_spaces_takes_seconds(vocabulary):
    rng = random.Random(4)
    text = "".join(rng.choice("的一是不了人我在有他这中大来上国个到说们") for _ in range(350000))
    began = time.time()
    round_trip(vocabulary, [text])
    assert time.time() - began < 60


# ------------------------------------------------------------------ pipeline stages

def test_equal_ids_with_different_texts_are_kept_by_group(spark):
    other = "completely different words stand here and nothing of it is said twice anywhere else today"
    docs = spark.createDataFrame([(5, PROSE, "b"), (5, other, "a"), (6, PROSE, "c"), (7, PROSE, "d"), (5, PROSE, "e"), (8, None, "f"),
                                  (9, "", "g"), (None, PROSE, "h")], "doc_id long, text string, root string")
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs.drop("root")))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept.collect()) == sorted([(5, PROSE), (5, other), (8, ""), (0, PROSE)])


def test_accepted_language_is_written(spark, sf_smoke):
    docs = spark.read.parquet(f"{sf_smoke}/documents.parquet")
    found = language.identify(language.from_documents(docs), key="doc_id")
    told = {r.doc_id: r.language for r in found.collect() if r.accepted}
    wrong = docs.withColumn("lang", language.F.lit("xx"))
    kept = language.keep_accepted(wrong, found)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.lang for r in kept.collect()} == told


# ------------------------------------------------------------------ 7 rules

def test_windows_that_share_a_hash_are_told_apart(spark):
    """With four bits of hash left, nearly all windows meet; the counts stay exact."""
    rng = random.Random(7)
    texts = [[rng.choice("abc") if k % 2 else f"w{rng.randrange(60)}" for _ in range(rng.randrange(90))] for k in range(40)]
    got = spark.createDataFrame([(k, w) for k, w in enumerate(texts)], "k int, words array<string>") \
        .selectExpr("*", f"{rules._windows(60)} AS windows").selectExpr("*", f"{rules._again(60)} AS again") \
        .selectExpr("k", f"{rules._COVERED} AS n").collect()
    for r in got:
        w = [tuple(texts[r.k][i:i + 3]) for i in range(len(texts[r.k]) - 2)]
        assert r.n == len({i + j for i, x in enumerate(w) if w.count(x) > 1 for j in range(3)})


def test_a_repeated_trusted_id_is_dealt_over_tasks(spark):
    docs = spark.createDataFrame([(1, f"word{i} and more") for i in range(200)] + [(2, "not trusted at all"), (None, "nor this")], "doc_id long, text string")
    got = rules.target_grams(docs, spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")).collect()
    assert sum(r.target for r in got) == 200 * 5
    plan = rules.target_grams(docs, spark.createDataFrame([(1,)], "doc_id long"))._jdf.queryExecution().toString()
    assert "hashpartitioning(doc_id" in plan and "salt" in plan


# ------------------------------------------------------------------ 8 language model

def test_slices_follow_the_tokens():
    assert [lm.filter_slices(n) for n in (0, 1, lm.SLICE_TOKENS, 100 * lm.SLICE_TOKENS, 10**5 * lm.SLICE_TOKENS)] == [16, 16, 16, 128, 1 << 17]


def test_scores_do_not_depend_on_pieces_slices_and_partitions(spark, sf_smoke, monkeypatch):
    docs = spark.read.parquet(f"{sf_smoke}/documents.parquet")
    want = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    monkeypatch.setattr(lm, "PIECE", 20000)
    monkeypatch.setattr(lm, "SLICE_TOKENS", 1000)
    got = {r.doc_id: r for r in lm.score_documents(docs.repartition(40), head=50).collect()}
    assert got.keys() == want.keys()
    for d, r in want.items():
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (r.n_tokens, r.n_known, r.train_tokens)
        assert abs(got[d].base_score - r.base_score) < 1e-6 * max(1, abs(r.base_score))
        assert abs(got[d].score - r.score) <= 0.05 * r.n_tokens


def test_encoding_a_large_batch_holds_a_bounded_lattice(spark, monkeypatch):
    """A task's lattice is that of a small piece of its batch: two run side by side in an executor."""
    rng = np.random.default_rng(4)
    words = np.array(["".join(rng.choice(list("abcdefghijklmno"), 6)) for _ in range(50000)])
    texts = [" ".join(rng.choice(words, 800)) for _ in range(700)]  # 3.9 MB
    docs = spark.createDataFrame([(0, "x")], "doc_id long, text string")
    held = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: held.append(f))
    sentencepiece.encode(docs)
    batch = pa.record_batch([pa.array(range(700), pa.int64()), pa.array(range(700), pa.int64()), pa.array(texts)], ["doc_id", "key", "text"])
    list(held[0]([batch.slice(0, 1)]))  # tables of the vocabulary
    tracemalloc.start()
    try:
        assert sum(rb.num_rows for rb in held[0]([batch])) == 700
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()
