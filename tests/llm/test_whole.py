"""Whole jobs: nothing is capped, cut or dropped where inputs grow or cases pile up."""

import base64
import gzip
import math
from collections import Counter

from quarry.llm import lm, rules, secrets
from quarry.llm.queries import QUERIES


def held(doc_id, mod, rest):
    import zlib
    return zlib.crc32(str(doc_id).encode()) % mod == rest


# ------------------------------------------------------------------ 8 language model

def test_filter_grows_with_the_corpus():
    for tokens in (10**6, 10**9, 5 * 10**9):
        assert lm.filter_words(tokens) * 64 >= tokens * 12


def test_lm_scores_stay_near_exact_counts(spark, sf_smoke):
    docs = spark.read.parquet(f"{sf_smoke}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op8_lm_score"](spark, sf_smoke).collect()}
    text = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in docs}
    one, two = Counter(), Counter()
    for d, w in text.items():
        if not held(d, 7, 2):
            one.update(w)
            two.update(zip(w, w[1:]))
    n, v = sum(one.values()), len(one)
    gap = []
    for d, w in text.items():
        p = [(one[t] + 1) / (n + v + 1) for t in w]
        for i in range(1, len(w)):
            p[i] = lm.LAMBDA * two[(w[i - 1], w[i])] / max(1, one[w[i - 1]]) + (1 - lm.LAMBDA) * p[i]
        gap.append(abs(sum(map(math.log10, p)) - got[d].score) / len(w))
    assert sum(gap) / len(gap) < 0.1


def test_rare_words_meet_their_slice_of_the_filter(spark, sf_smoke):
    docs = spark.read.parquet(f"{sf_smoke}/documents.parquet")
    whole, rare = ({r.doc_id: r for r in lm.score_documents(docs, head=h).collect()} for h in (1 << 18, 1))
    for d, r in whole.items():
        assert r.n_known == rare[d].n_known and math.isclose(r.base_score, rare[d].base_score, rel_tol=1e-9)
        assert abs(r.score - rare[d].score) <= 0.05 * r.n_tokens


# ------------------------------------------------------------------ 6 secrets

def test_every_encoded_copy_is_found_and_redacted():
    secret = b'password = "correct-horse-9"'
    once, packed = base64.b64encode(secret).decode(), base64.b64encode(gzip.compress(secret)).decode()
    text = f"first {once} again {once} packed {packed} and {packed} end"
    spans = secrets.scan(text)[1]
    at = [m for m in range(len(text)) if text.startswith((once, packed), m)]
    assert len(at) == 4 and all(any(a <= s < a + len(packed) for s, _, _ in spans) for a in at)
    clean = secrets.redact(text, spans)
    assert clean.count("[assign]") == 4 and secrets.scan(clean)[1] == []


# ------------------------------------------------------------------ 7 rules

def test_all_good_documents_are_trusted(spark):
    labels = spark.range(60000).selectExpr("id AS doc_id", "IF(id % 6 = 5, 0, 1) AS quality")
    assert rules.trusted_ids(labels).count() == 50000 and rules.trusted_ids(labels.withColumn("quality", labels.quality * 0 + 1)).count() == 60000
