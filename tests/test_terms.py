import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.functions import lexicon
from quarry.functions import text as T
from quarry.operators import terms


@pytest.mark.parametrize("tf,dl,sat,weight", [
    (1, 2, 1.363881, 1.363881),
    (1, 5.75, 1.0, 1.0),
    (2, 3, 1.588697, 3.177394),
    (1, 150, 0.088788, 0.088788),
    (3, 150, 0.246469, 0.739406),
])
def test_bm25_worked_values(spark, tf, dl, sat, weight):
    df = spark.createDataFrame([(tf, float(dl))], "tf long, dl double")
    s = T.bm25_saturation("tf", "dl", 1.2, 0.75, 5.75)
    r = df.select(F.round(s, 6).alias("s"), F.round(F.col("tf") * s, 6).alias("w")).first()
    assert r.s == pytest.approx(sat, abs=1e-6)
    assert r.w == pytest.approx(weight, abs=1e-6)


def test_repeated_term_weight(spark):
    df = spark.createDataFrame([(1, 0, "alpha alpha beta")], "doc_id long, chunk_no int, content string")
    p = terms.embed(df, settings=Settings(stemming=False)).collect()
    by = {r.term: r for r in p}
    assert by["alpha"].tf == 2 and by["alpha"].dl == 3
    assert round(by["alpha"].weight, 6) == 3.177394


def test_every_chunk_gets_an_embedding(spark):
    # the reference's embedding test: both chunks receive a vector
    df = spark.createDataFrame([(1, 0, "hello world"), (2, 0, "bye world")],
                               "doc_id long, chunk_no int, content string")
    v = terms.sparse_vectors(terms.folded_weights(terms.embed(df))).collect()
    assert sorted(r.doc_id for r in v) == [1, 2]
    assert all(len(r.indices) > 0 for r in v)


def test_tokens_fold_accents(spark):
    df = spark.createDataFrame([("Héllo, WÖRLD! Straße 12ab",)], "t string")
    assert df.select(T.tokens("t").alias("x")).first().x == ["hello", "world", "strasse", "12ab"]


def test_composed_and_decomposed_accents_give_one_token(spark):
    import unicodedata
    text = "Élève ça naïve Größe año Čeština győr Việt Σίσυφος йод ǽ İstanbul ﬁ 12é"
    forms = [(unicodedata.normalize(f, text),) for f in ("NFC", "NFD")]
    composed, apart = (r.x for r in spark.createDataFrame(forms, "t string").select(T.tokens("t").alias("x")).collect())
    assert composed == apart
    assert composed[:9] == ["eleve", "ca", "naive", "grosse", "ano", "cestina", "gyor", "viet", "σισυφος"]
    assert [lexicon.fold(w) for w in unicodedata.normalize("NFD", text).split()][:8] == composed[:8]


def test_language_vote(spark):
    df = spark.createDataFrame([
        (1, "the cat and the dog are in the house"),
        (2, "le chat et le chien sont dans la maison"),
        (3, "der Hund und die Katze sind nicht im Haus"),
        (4, "el perro y el gato están en la casa con los niños"),
        (5, "zzz qqq"),
    ], "query_id long, query string")
    an = {r.query_id: (r.lang_detected, r.lang) for r in terms.analyze(df, ["query_id"], "query").collect()}
    assert an[1] == ("en", "en")
    assert an[2] == ("fr", "fr")
    assert an[3] == ("de", "de")
    assert an[4] == ("es", "es")
    assert an[5] == (None, "en")


def test_stopwords_are_spark_ml_lists():
    from pyspark.ml.feature import StopWordsRemover  # noqa: F401  (same resource)
    en = lexicon.stopwords("en")
    assert "the" in en and "and" in en
    assert all("'" not in w for w in en)


@pytest.mark.parametrize("lang,word,stem", [
    ("en", "queries", "query"), ("en", "boxes", "boxe"), ("en", "cats", "cat"),
    ("en", "class", "class"), ("en", "bus", "bus"), ("en", "bees", "bee"),
    ("fr", "chevaux", "cheval"), ("fr", "maisons", "maison"),
    ("es", "luces", "luz"), ("es", "flores", "flor"), ("es", "casas", "casa"),
    ("de", "kindern", "kind"), ("de", "hunde", "hund"),
])
def test_stem_rules(spark, lang, word, stem):
    df = spark.createDataFrame([(lang, word)], "lang string, w string")
    assert df.select(T.stem("w", "lang").alias("s")).first().s == stem


def test_term_index_is_md5_prefix(spark):
    df = spark.createDataFrame([("alpha",), ("été",)], "t string")
    got = [r.i for r in df.select(T.term_index("t").alias("i")).collect()]
    want = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in ("alpha", "été")]
    assert got == want


def test_sparse_vector_indices_ascending(spark, sf_smoke):
    from quarry.plans.retrieval import build_index
    docs = spark.read.parquet(f"{sf_smoke}/documents.parquet")
    idx = build_index(docs)
    v = terms.sparse_vectors(idx.vectors)
    bad = v.where(F.expr("exists(sequence(2, greatest(size(indices), 2)), i -> "
                         "size(indices) >= i AND indices[i - 1] <= indices[i - 2])")).count()
    assert bad == 0
    # nested and long forms agree
    n_long = idx.vectors.count()
    n_nested = v.select(F.sum(F.size("indices"))).first()[0]
    assert n_long == n_nested


def test_term_pipeline_single_exchange(spark, sf_smoke):
    from quarry.plans.retrieval import build_index
    docs = spark.read.parquet(f"{sf_smoke}/documents.parquet")
    plan = build_index(docs).postings._jdf.queryExecution().executedPlan().toString()
    # round-robin spread of the single-file scan + the chunk-key exchange, nothing else
    assert plan.count("Exchange") <= 2, plan
