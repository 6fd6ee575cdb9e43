import random

import pytest
from pyspark.sql import functions as F

from quarry.operators.chunking import chunk_documents, chunk_stats


def chunks_of(spark, text, size, delimiters="\n.?"):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = chunk_documents(df, size=size, delimiters=delimiters).orderBy("chunk_no").collect()
    return [r.content for r in rows]


def sequential_cuts(data: bytes, size: int, delims: bytes) -> list[bytes]:
    """Independent model of the cut rule, one position at a time."""
    out, p = [], 0
    while p < len(data):
        if len(data) - p <= size:
            out.append(data[p:])
            break
        window = data[p:p + size]
        last = max(window.rfind(bytes([d])) for d in delims)
        cut = last + 1 if last >= 0 else size
        out.append(data[p:p + cut])
        p += cut
    return out


@pytest.mark.parametrize("text,size,expect", [
    ("", 8, []),                                     # empty text: no chunk
    ("abcdefgh", 8, ["abcdefgh"]),                   # exactly size bytes
    ("a.b.cdefgh", 6, ["a.b.", "cdefgh"]),           # last delimiter wins
    ("abcdefghij", 4, ["abcd", "efgh", "ij"]),       # no delimiter: hard cut
    ("aéz", 2, ["a�", "�z"]),              # cut inside a 2-byte char
    ("One-chunk.", 1024, ["One-chunk."]),            # short text unchanged
    ("This is a one-chunk text.", 1024, ["This is a one-chunk text."]),
    ("x\ny?z", 2, ["x\n", "y?", "z"]),
])
def test_cut_rule_cases(spark, text, size, expect):
    assert chunks_of(spark, text, size) == expect


def test_null_text_gives_no_chunk(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert chunk_documents(df, size=4).count() == 0


def test_three_byte_char_cut(spark):
    # '€' is 3 bytes: a cut after its first byte leaves one U+FFFD before and
    # one per stray continuation byte after
    assert chunks_of(spark, "a€", 2) == ["a�", "��"]


def test_matches_sequential_model(spark):
    rng = random.Random(7)
    alphabet = ["a", "b", "c", " ", ".", "?", "\n", "é", "€", "😀", "ß"]
    for size in (1, 2, 3, 5, 8, 13, 64):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(40)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {}
        for r in chunk_documents(df, size=size).collect():
            got.setdefault(r.doc_id, []).append((r.chunk_no, r.n_bytes, r.content))
        for i, t in enumerate(texts):
            model = sequential_cuts(t.encode(), size, b"\n.?")
            rows = sorted(got.get(i, []))
            assert [n for _, n, _ in rows] == [len(m) for m in model], (size, t)
            assert [c for _, _, c in rows] == [m.decode("utf-8", "replace") for m in model], (size, t)
            assert [no for no, _, _ in rows] == list(range(len(model)))


def test_corpus_invariants(spark, sf_smoke):
    docs = spark.read.parquet(f"{sf_smoke}/documents.parquet")
    ch = chunk_documents(docs)
    assert ch.where(F.col("n_bytes") > 1024).count() == 0
    stats = chunk_stats(ch).select("doc_id", "total_bytes")
    sizes = docs.select("doc_id", F.octet_length("text").alias("nb"))
    bad = stats.join(sizes, "doc_id").where(F.col("total_bytes") != F.col("nb")).count()
    assert bad == 0
    # without a cut inside a character the chunks concatenate back to the text
    whole = (ch.groupBy("doc_id")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "content"))),
                                             lambda x: x["content"]), "").alias("joined")))
    diff = whole.join(docs, "doc_id").where((F.col("joined") != F.col("text"))
                                            & ~F.col("joined").contains("�")).count()
    assert diff == 0


def test_chunker_plan_has_one_text_exchange(spark, sf_smoke):
    docs = spark.read.parquet(f"{sf_smoke}/documents.parquet")
    plan = chunk_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
