"""Quality rules in native expressions: shape counts and an n-gram likelihood ratio.

One- and two-word n-grams are hashed into ``BUCKETS`` buckets.  Two multinomials are
counted over them, of trusted target texts and of the whole raw corpus; the weight
of a bucket is the log ratio of its smoothed probabilities.  A document's ratio is
the sum of its n-grams' weights divided by their number, and the verdict a fixed
threshold on it.

Everything is DataFrame expressions, by one plan at every size.  Raw counts come from
the scan, added up where it is read.  The trusted ids, all of them, first make a blocked
Bloom filter of at most ``FILTER_WORDS`` words, which is broadcast; only documents
that pass it are shuffled, as arrays of buckets, to meet the ids themselves.  The
weights (``BUCKETS`` doubles) become one array in the plan, so a document is judged
where it is read and no text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import save

BUCKETS = 1 << 17
SMOOTHING = 1.0
THRESHOLD = -0.15
WORD = r"[^\\x20\\x09-\\x0D]+"
FILTER_WORDS = 1 << 20
SALTS = 16


def words_of(text: str = "text") -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{WORD}', 0)"


def _windows(place: int) -> str:
    return f"""sort_array(transform(slice(words, 1, greatest(size(words) - 2, 0)), (w, i) ->
    (xxhash64(w, words[i + 1], words[i + 2]) & ~{(1 << place) - 1}L) | i))"""


def _again(place: int) -> str:
    mask = f"{(1 << place) - 1}L"

    def meet(other: str) -> str:
        return f"shiftrightunsigned(x ^ {other}, {place}) = 0"

    def same(other: str) -> str:
        return " AND ".join([meet(other), *(f"words[int(x & {mask}) + {k}] = words[int({other} & {mask}) + {k}]" for k in range(3))])

    before, after = "windows[i - 1]", "windows[i + 1]"
    return f"""sort_array(transform(filter(windows, (x, i) ->
    CASE WHEN NOT ((i > 0 AND {meet(before)}) OR (i < size(windows) - 1 AND {meet(after)})) THEN false
         WHEN i > 0 AND {same(before)} THEN true
         WHEN i < size(windows) - 1 AND {same(after)} THEN true
         ELSE exists(windows, y -> y <> x AND {same('y')}) END),
    x -> x & {mask}))"""


#: The base counts, from the columns text and words.  Three-word windows are packed as (hash,
#: place) in one long and sorted: equal windows become neighbours.  Where hashes meet the words
#: themselves are compared; should different windows share a hash, each is looked for among all.
#: A place has 27 bits, and 31 (the longest array) in a text of more words than that.
PLACES = (27, 31)
_FEW = f"size(words) < {1 << PLACES[0]}"
_WINDOWS = f"IF({_FEW}, {_windows(PLACES[0])}, {_windows(PLACES[1])})"
_AGAIN = f"IF({_FEW}, {_again(PLACES[0])}, {_again(PLACES[1])})"
_COVERED = "aggregate(again, named_struct('n', 0L, 'to', 0L), (a, x) -> named_struct('n', a.n + x + 3 - greatest(x, a.to), 'to', x + 3L)).n"


def base_counts(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` (with words) plus the five base counts and the base verdict."""
    return docs.selectExpr(
        "*", "size(words) AS n_words_", "split(coalesce(text, ''), '\\n', -1) AS lines", f"{_WINDOWS} AS windows") \
        .selectExpr("*", f"{_AGAIN} AS again", r"filter(lines, x -> x RLIKE '[^\\x20\\x09-\\x0D]') AS full_lines") \
        .selectExpr(
            "*", "CAST(n_words_ AS LONG) AS n_words",
            "CAST(char_length(array_join(words, '')) AS LONG) AS word_chars",
            "CAST(regexp_count(coalesce(text, ''), '[#*$%&|<>]') AS LONG) AS n_symbols",
            "CAST(size(full_lines) - size(array_distinct(full_lines)) AS LONG) AS n_dup_lines",
            f"{_COVERED} AS n_repeat_words") \
        .withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")) \
        .drop("n_words_", "lines", "windows", "again", "full_lines")


#: Buckets of all one- and two-word n-grams of the column words.
GRAMS = f"""concat(transform(words, w -> int(pmod(xxhash64(w), {BUCKETS}))),
    transform(slice(words, 1, greatest(size(words) - 1, 0)), (w, i) -> int(pmod(xxhash64(w, words[i + 1]), {BUCKETS}))))"""


def _slot(key: str = "doc_id"):
    """Word and bits of an id in the filter: four bits of one 64-bit word."""
    h = f"xxhash64({key}, 7)"
    bits = " | ".join(f"shiftleft(1L, CAST(shiftrightunsigned({h}, {20 + 6 * k}) & 63 AS INT))" for k in range(4))
    return F.expr(f"{h} & {FILTER_WORDS - 1}").alias("word"), F.expr(bits).alias("mask")


def target_grams(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, target): n-grams of the trusted documents.

    A repeated id is dealt over ``SALTS`` tasks; an id counts once for each of its rows.
    """
    ids = trusted.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    seen = ids.select(*_slot()).groupBy("word").agg(F.expr("bit_or(mask)").alias("bits"))  # FILTER_WORDS rows at most
    near = docs.where("doc_id IS NOT NULL").select("doc_id", "text", *_slot()).join(F.broadcast(seen), "word").where("bits & mask = mask")
    arrays = near.select("doc_id", "text", F.expr(f"pmod(xxhash64(text), {SALTS})").alias("salt")) \
        .selectExpr("doc_id", "salt", f"{words_of()} AS words").selectExpr("doc_id", "salt", f"{GRAMS} AS buckets")
    keys = ids.select("doc_id", F.expr(f"explode(sequence(0L, {SALTS - 1}L)) AS salt"))
    met = arrays.join(keys.hint("shuffle_merge"), ["doc_id", "salt"], "left_semi")
    # explode_outer: no filter on the arrays' size is inferred, which would cut the words again below the join
    return met.select(F.explode_outer("buckets").alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("target"))


def ratio_weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, weight): log ratio of the trusted to the raw probability of each bucket.

    ``docs``: doc_id and text of the whole raw corpus; ``trusted``: the ids of its
    trusted documents.
    """
    raw_counts = docs.selectExpr(f"{words_of()} AS words").selectExpr(f"explode({GRAMS}) AS bucket").groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"))
    counts = save(raw_counts.join(target_grams(docs, trusted), "bucket", "left").select("bucket", "raw", F.coalesce("target", F.lit(0)).alias("target")),
                  "rules-grams")
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    raw, target = total.raw or 0, total.target or 0
    if not target:
        return counts.select("bucket", F.lit(0.0).alias("weight"))
    # the smoothing follows the raw distribution: an unseen bucket is as unlikely as its size says
    mass = SMOOTHING * BUCKETS
    smooth = F.log((F.col("target") + mass * F.col("raw") / raw) / (target + mass))
    return counts.select("bucket", (smooth - F.log(F.col("raw") / raw)).alias("weight"))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept).

    Null texts have no words and fail the base rules; without trusted texts every
    ratio is 0 and the base rules decide; a null doc_id is never trusted; repeated
    rows each give a row; an empty table gives no rows; a very long text is one row of work,
    in memory proportional to its words.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weight = [0.0] * BUCKETS
    for r in ratio_weights(texts, trusted).collect():  # BUCKETS rows at most
        weight[r.bucket] = r.weight
    table = F.split(F.lit(",".join(map(repr, weight))), ",").cast("array<double>")  # a constant: one array of the plan
    counted = base_counts(texts.withColumn("words", F.expr(words_of())).withColumn("grams", F.expr(GRAMS)))
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get(table, b))
    ratio = F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0)
    return counted.withColumn("ratio", ratio).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio",
        (~F.col("base_failed") & (F.col("ratio") >= threshold)).alias("kept"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents whose every label says good."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg(F.min("quality").alias("quality")).where("quality = 1")
    return good.select("doc_id")
