"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from quarry.llm import decontaminate, language, lm, quality, rules, secrets, sentencepiece, simhash, suffix, toxicity

PROSE = "the cat sat on the mat and looked at the moon over the quiet old harbour town"
LONG = " ".join(f"word{i % 977} and then" for i in range(20000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, PROSE, "en", "a.example.com"), (2, None, None, None), (3, "", "", ""), (4, LONG, "en", "a.example.com"),
            (5, PROSE, "en", None), (5, PROSE, "en", None), (None, PROSE, "en", "b"), (None, None, None, None),
            (6, "é\x00\n\n \t▁ 日本", "de", "c.de"), (7, "!", "en", "a.example.com")]
    return spark.createDataFrame([(*r, len(r[1] or ""), 9, "x", 1, 2) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, "
                                 "key int, fp string, slice int, held_out int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, 1, 0), (5, 0, 0), (None, 1, 1), (7, None, None), (99, 0, 1)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PROSE), (1, PROSE), (2, None), (3, ""), (4, "too short"), (None, PROSE)], "item_id long, text string")


RUNS = {
    "language": lambda d, lab, it: language.identify(language.from_documents(d), key="doc_id"),
    "simhash": lambda d, lab, it: simhash.near_duplicates(d),
    "suffix": lambda d, lab, it: suffix.remove_repeats(d, length=20, gram=8),
    "quality": lambda d, lab, it: quality.score_documents(d, lab),
    "toxicity": lambda d, lab, it: toxicity.score_documents(d, lab),
    "secrets": lambda d, lab, it: secrets.find_secrets(d),
    "rules": lambda d, lab, it: rules.judge(d, rules.trusted_ids(lab)),
    "lm": lambda d, lab, it: lm.score_documents(d),
    "sentencepiece": lambda d, lab, it: sentencepiece.encode(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_every_row_has_its_result(name, docs, labels, items):
    out = RUNS[name](docs, labels, items)
    got = sorted(out.select("doc_id").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [1, 2, 3, 4, 5, 5, 6, 7, None, None]
    assert len(set(out.columns)) == len(out.columns)


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables_give_no_rows(name, docs, labels, items):
    assert RUNS[name](docs.limit(0), labels.limit(0), items.limit(0)).collect() == []


@pytest.mark.parametrize("name", RUNS)
def test_no_labels_and_null_texts_only(name, docs, labels, items):
    only = docs.where("text IS NULL")
    assert RUNS[name](only, labels.limit(0), items.limit(0)).count() == only.count()


def test_decontamination_edges(docs, items):
    got = decontaminate.contaminated_pairs(docs, items).select("doc_id", "item_id", "coverage").collect()
    assert sorted((r.doc_id or 0, r.item_id or 0, r.coverage) for r in got) == \
        sorted((d, i, 1.0) for d in (0, 1, 5, 5) for i in (0, 1))
    assert decontaminate.contaminated_pairs(docs, items.limit(0)).count() == 0
    assert decontaminate.contaminated_pairs(docs.limit(0), items).count() == 0
    clean = decontaminate.clean_documents(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in clean.select("doc_id").collect()) == [0, 2, 3, 4, 6, 7]


def test_null_and_letterless_texts_are_undetermined(docs):
    got = {(r.doc_id, r.language) for r in language.identify(language.from_documents(docs), key="doc_id").collect()}
    assert {(2, "und"), (3, "und"), (7, "und"), (1, "en"), (4, "en")} <= got


def test_equal_texts_share_component_and_empty_ones_too(docs):
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    of = {d: (fp, c) for d, fp, c in got if d is not None}
    assert of[1] == of[5] and of[5][1] == 1
    assert of[2] == of[3] == (0, 2)


def test_repeated_rows_are_copies_for_suffixes(docs):
    got = {r.doc_id: r for r in suffix.remove_repeats(docs, length=20, gram=8).collect() if r.doc_id is not None}
    assert got[5].n_removed == got[5].n_bytes == len(PROSE) and got[5].n_spans == 1
    assert got[2].n_bytes == got[3].n_bytes == 0 and got[2].kept_sha256 == got[3].kept_sha256


def test_pipeline_stages_keep_the_columns(spark, docs, items, tmp_path):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert last.where("NOT lossless").count() == 0
    assert sorted(r.doc_id for r in last.where("doc_id IS NOT NULL").collect()) == [4, 6]
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
