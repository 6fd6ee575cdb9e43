"""Language identification by Bayesian evidence fusion.

For a record with text, declared markup language, address suffix and host, the
posterior of language l is proportional to

    P(text | l) ** t  *  P(markup | l)  *  P(suffix | l)  *  P(l | host)

* P(text | l): a multinomial over hashed byte trigrams of the words, its counts
  summed over all labelled records; t tempers it, since neighbouring trigrams
  are not independent.
* P(markup | l), P(suffix | l): how often each value is declared among the records
  whose text says l, counted over all records, smoothed with a fixed share for
  the value that names l itself.
* P(l | host): the languages that the texts of a host say, smoothed towards its
  domain, that towards all records (Dirichlet smoothing of fixed weight at each
  level).  A record's own vote is taken out of its host's counts first.

All of these are grouped aggregations with map-side sums.  Missing evidence
multiplies by one.  A record is rejected when its text has no letter, or when its
best posterior stays under ``least``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import ascii_lower, blob, pieces, save

BUCKETS = 1 << 14
SPAN = 3
#: Trigrams that count in full; more of them weigh no more.
INDEPENDENT = 60
#: Smoothing weights: pseudo-counts of a domain's and a host's prior, and of the
#: share that a declared value has for the language it names.
WEIGHT, OWN_SHARE = 10.0, 0.8
#: Address suffixes that name a language where it is the main one (fixed values).
SUFFIX_LANGUAGE = {"uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "de": "de", "at": "de",
                   "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es",
                   "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja",
                   "kr": "ko", "cn": "zh", "se": "sv", "no": "no", "dk": "da", "fi": "fi", "tr": "tr", "cz": "cs"}


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every byte trigram of lower-cased letters, one space between words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = ascii_lower(data)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    # one gap character stands before each word and after the last of a row
    gap = ~letter
    keep = letter.copy()
    keep[1:] |= gap[1:] & letter[:-1] & (row[1:] == row[:-1])
    chars = np.where(letter, low, 32)[keep].astype(np.uint32)
    rows = row[keep]
    if len(chars) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = chars[:-2] << 16 | chars[1:-1] << 8 | chars[2:]
    same = rows[:-2] == rows[2:]
    code = code[same].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(64 - 14)).astype(np.int64), rows[:-2][same]


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def markup_language(text: str) -> Column:
    """The first language subtag declared in the text's markup."""
    return F.lower(F.regexp_extract(text, r"""(?i)<html[^>]{0,400}?\slang\s*=\s*["']?([A-Za-z]{2,3})""", 1))


def records(df: DataFrame, key: Column, text: Column, label: Column, markup: Column, host: Column) -> DataFrame:
    """The columns that ``identify`` works on; empty strings count as missing."""
    none = lambda c: F.when(c != "", c)
    host = none(host)
    # a space at both ends: the first and last word have their edges too
    return df.select(key.alias("key"), F.concat(F.lit(" "), text, F.lit(" ")).alias("text"), none(label).alias("label"), none(markup).alias("markup"),
                     host.alias("host")) \
        .withColumn("suffix", F.when(F.col("host").contains("."), F.regexp_extract("host", r"\.([a-z]{2,})$", 1))) \
        .withColumn("domain", F.coalesce(none(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)), "host")) \
        .withColumn("suffix", none(F.col("suffix")))


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents: ``source`` is the host, ``lang`` the label, markup as it stands in the text."""
    text = F.col("text").cast("string")
    return records(docs.select("doc_id", "text", "lang", "source"), F.col("doc_id").cast("long"), text,
                   F.col("lang").cast("string"), markup_language("text"), F.lower(F.col("source").cast("string")))


def from_pages(pages: DataFrame) -> DataFrame:
    """Raw pages: host and suffix from the address; tags, scripts and styles are no text."""
    visible = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return records(pages.select("page_id", "url", "html"), F.col("page_id").cast("long"), visible,
                   F.lit(None).cast("string"), markup_language("html"), _host("url"))


@dataclass
class TextModel:
    """Log likelihood of each trigram bucket under each language."""

    languages: list[str]
    log_p: np.ndarray  # buckets x languages

    def score(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(summed log likelihoods, trigrams) of each row."""
        n = len(off) - 1
        bucket, row = trigrams(data, off)
        count = np.bincount(row, minlength=n)
        out = np.zeros((n, len(self.languages)))
        full = np.flatnonzero(count)
        if len(full):
            start = (np.cumsum(count) - count)[full]
            for j in range(len(self.languages)):
                out[full, j] = np.add.reduceat(self.log_p[bucket, j], start)
        return out, count


def fit_text(labelled: DataFrame) -> TextModel:
    """Trigram counts of every language over all labelled records.

    The driver gets one row for each language and bucket that occurs: at most
    languages x ``BUCKETS``; labels are two- or three-letter codes.
    """

    def run(batches):
        for rb in pieces(batches):
            data, off = blob(rb.column("text"))
            bucket, row = trigrams(data, off)
            names = rb.column("label").to_pylist()
            order = sorted(set(names))
            code = np.array([order.index(x) for x in names])
            count = np.bincount(code[row] * BUCKETS + bucket, minlength=len(order) * BUCKETS)
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array([order[k] for k in (at // BUCKETS).tolist()], pa.string()), pa.array(at % BUCKETS), pa.array(count[at])],
                ["label", "bucket", "n"])

    rows = labelled.where("label RLIKE '^[a-z]{2,3}$'").select("label", "text") \
        .mapInArrow(run, "label string, bucket long, n long") \
        .groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    label = np.array(rows.column("label").to_pylist(), dtype=object)
    names = sorted(set(label.tolist()))
    count = np.full((BUCKETS, len(names)), 0.5)
    column = np.array([names.index(x) for x in label], dtype=np.int64)
    count[rows.column("bucket").to_numpy(), column] += rows.column("n").to_numpy()
    return TextModel(names, np.log(count / count.sum(axis=0, keepdims=True)))


def text_evidence(recs: DataFrame, model: TextModel) -> DataFrame:
    """Records without their texts, with tempered log likelihoods and their best language."""
    sent = recs.sparkSession.sparkContext.broadcast(model)
    kept = ["key", "markup", "suffix", "domain", "host"]

    def run(batches):
        model = sent.value
        for rb in pieces(batches):
            data, off = blob(rb.column("text"))
            like, n = model.score(data, off)
            like *= (np.minimum(n, INDEPENDENT) / np.maximum(n, 1))[:, None]
            flat = pa.array(like.ravel())
            ends = pa.array(np.arange(rb.num_rows + 1, dtype=np.int32) * like.shape[1])
            best = pa.array(np.argmax(like, axis=1).astype(np.int32), mask=n == 0) if like.shape[1] else pa.nulls(rb.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in kept), pa.ListArray.from_arrays(ends, flat), best, pa.array(n)],
                                             [*kept, "like", "best", "n_grams"])

    return recs.select(*kept, "text").mapInArrow(
        run, "key long, markup string, suffix string, domain string, host string, like array<double>, best int, n_grams long")


def _tally(df: DataFrame, by: str, n: int, name: str) -> DataFrame:
    """How many records of each value say each language: (by, array of n counts)."""
    return df.where(F.col(by).isNotNull() & F.col("best").isNotNull()).groupBy(by) \
        .agg(F.array(*[F.sum((F.col("best") == j).cast("double")) for j in range(n)]).alias(name))


def _log_declared(df: DataFrame, by: str, names: list[str], meaning: Column, out: str) -> DataFrame:
    """(by, log P(value | language) up to a constant, for each language)."""
    n = len(names)
    seen = _tally(df, by, n, "seen")
    total = F.array(*[F.lit(0.0)] * n)
    totals = df.where(F.col(by).isNotNull() & F.col("best").isNotNull()).agg(
        *[F.sum((F.col("best") == j).cast("double")).alias(f"t{j}") for j in range(n)]).first()
    total = F.array(*[F.lit(float(totals[j] or 0.0)) for j in range(n)])
    own = F.array(*[F.when(meaning == name, F.lit(OWN_SHARE)).otherwise(F.lit((1 - OWN_SHARE) / max(1, n))) for name in names])
    return seen.select(by, F.transform(F.arrays_zip("seen", total.alias("total"), own.alias("own")),
                                       lambda x: F.log((x["seen"] + WEIGHT * x["own"]) / (x["total"] + WEIGHT))).alias(out))


def identify(recs: DataFrame, key: str = "key", least: float = 0.5, model: TextModel | None = None) -> DataFrame:
    """(key, language, posterior, text_language, accepted) for every record.

    Without labels anywhere (or an empty table) no language is known and every
    record is rejected; null or letterless texts are rejected as ``und``; a null
    host, markup or suffix is no evidence; repeated rows each give a row; ties go
    to the alphabetically first language.
    """
    model = model or fit_text(recs)
    names = model.languages
    n = len(names)
    if not n:
        return recs.select(F.col("key").alias(key), F.lit("und").alias("language"), F.lit(0.0).alias("posterior"),
                           F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("accepted"))
    at = save(text_evidence(recs, model), "language-evidence")
    zero = F.array(*[F.lit(0.0)] * n)
    markup = _log_declared(at, "markup", names, F.col("markup"), "log_markup")
    named = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])
    suffix = _log_declared(at, "suffix", names, F.coalesce(F.element_at(named, F.col("suffix")), F.lit("")), "log_suffix")

    # prior of all records, then of each domain and host, each smoothed towards the one above
    every = at.where("best IS NOT NULL").agg(*[F.sum((F.col("best") == j).cast("double")).alias(f"t{j}") for j in range(n)]).first()
    count = np.array([float(every[j] or 0.0) for j in range(n)]) + 1.0
    top = F.array(*[F.lit(float(x)) for x in count / count.sum()])
    domains = _tally(at, "domain", n, "domain_seen")
    hosts = _tally(at, "host", n, "host_seen")
    own = F.array(*[F.coalesce((F.col("best") == j).cast("double"), F.lit(0.0)) for j in range(n)])

    def smoothed(seen: str, above: Column) -> Column:
        left = F.zip_with(F.coalesce(F.col(seen), zero), F.col("own"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
        mass = F.aggregate(left, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(left, above, lambda a, b: (a + WEIGHT * b) / (mass + WEIGHT))

    # rows without a value find nothing; a made-up key each spreads them over the tasks
    joined = at.withColumn("own", own)
    for by, found in (("markup", markup), ("suffix", suffix), ("domain", domains), ("host", hosts)):
        spread = F.coalesce(by, F.concat(F.lit("\0"), F.pmod(F.xxhash64("key", "n_grams"), F.lit(4096)).cast("string")))
        joined = joined.withColumn(by, spread).join(found, by, "left")
    joined = joined \
        .withColumn("prior", smoothed("host_seen", smoothed("domain_seen", top)))
    score = F.zip_with(F.zip_with("like", F.transform("prior", lambda x: F.log(x)), lambda a, b: a + b),
                       F.zip_with(F.coalesce("log_markup", zero), F.coalesce("log_suffix", zero), lambda a, b: a + b),
                       lambda a, b: a + b)
    high = F.array_max("score")
    out = joined.select(F.col("key").alias(key), "best", "n_grams", score.alias("score")) \
        .withColumn("posterior", 1.0 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("score")))) \
        .withColumn("top", F.array_position("score", high).cast("int"))
    label = F.array(*[F.lit(x) for x in names])
    accepted = (F.col("n_grams") > 0) & (F.col("posterior") >= least)
    return out.select(key, F.when(accepted, F.element_at(label, F.col("top"))).otherwise("und").alias("language"),
                      F.when(F.col("n_grams") > 0, F.col("posterior")).otherwise(0.0).alias("posterior"),
                      F.when(F.col("best").isNotNull(), F.element_at(label, F.col("best") + 1)).alias("text_language"),
                      accepted.alias("accepted"))


def keep_accepted(docs: DataFrame, found: DataFrame, key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The documents without those whose every row was rejected; ``lang`` becomes the language found.

    Rows that share an id get the likeliest accepted language among them; rows without
    id stay as they are.  An empty table stays empty.
    """
    told = found.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max("accepted").alias("_any"), F.max_by(F.when(F.col("accepted"), F.col("language")), F.when(F.col("accepted"), F.col("posterior"))).alias("_lang"))
    kept = docs.join(told, key, "left").where("_any IS NULL OR _any")
    if lang in docs.columns:
        kept = kept.withColumn(lang, F.coalesce("_lang", F.col(lang)))
    return kept.select(*docs.columns)
