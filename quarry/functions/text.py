"""Column expressions for text: chunk cutting, normalisation, tokens, terms.

All of them are built-in Spark SQL expressions (no Python UDF), so they run
inside the JVM next to the scan.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import lexicon


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# Chunk cutting
# ---------------------------------------------------------------------------
def delimiter_split_pattern(delimiters: str) -> str:
    """Regex that splits a text right after every delimiter character."""
    return "(?<=[" + "".join(re.escape(d) for d in delimiters) + "])"


# Pieces per inner fold of the cutter (see pack_pieces).
CUT_GROUP = 256


def byte_pieces(text, size: int, delimiters: str) -> Column:
    """Pieces of ``text`` as binaries of at most ``size`` bytes.

    Split right after each delimiter; a segment that fits stays whole, a
    longer one is cut into ``size``-byte pieces plus a remainder through its
    hex form (one regex pass per long segment), so the work is linear in the
    text and never re-reads the whole text per piece.
    """
    if size <= 0:
        raise ValueError("chunk size must be positive")
    segs = F.split(_col(text), delimiter_split_pattern(delimiters))
    pattern = "[0-9A-F]{1," + str(2 * size) + "}"

    def cut(seg):
        b = F.encode(seg, "UTF-8")
        return F.when(F.octet_length(b) <= size, F.array(b)).otherwise(
            F.transform(F.regexp_extract_all(F.hex(b), F.lit(pattern), F.lit(0)), lambda h: F.unhex(h)))

    return F.filter(F.flatten(F.transform(segs, cut)), lambda p: F.octet_length(p) > 0)


def piece_lengths(pieces_col) -> Column:
    return F.transform(_col(pieces_col), lambda x: F.octet_length(x))


def pack_pieces(pieces, size: int, group: int = CUT_GROUP) -> Column:
    """Index of the first piece of every chunk, from piece byte lengths.

    Cut rule: from position p, if the rest fits in ``size`` bytes it is the
    last chunk; otherwise cut right after the last delimiter inside the next
    ``size`` bytes, or at exactly ``size`` bytes when there is none.  Packing
    whole pieces greedily into at most ``size`` bytes is the same rule.  The
    fold runs over groups of ``group`` pieces (an inner fold per group, an
    outer fold that carries the state and appends one array per group), so
    appends stay short even for very long documents.  ``pieces`` must be a
    column of an earlier projection: the group lambda reads it per group.
    """
    pieces = _col(pieces)
    n_groups = F.floor((F.size(pieces) + F.lit(group - 1)) / F.lit(group)).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.greatest(n_groups - 1, F.lit(0))),
                         lambda g: F.slice(pieces, g * group + 1, group))

    def state(starts, cs, pos, ci, i):
        return F.struct(starts.alias("starts"), cs.alias("cs"), pos.alias("pos"),
                        ci.alias("ci"), i.alias("i"))

    def step(acc, n):
        grown = acc["pos"] + n
        nxt = acc["i"] + 1
        return F.when(
            grown - acc["cs"] > F.lit(size),
            state(F.concat(acc["starts"], F.array(acc["ci"])), acc["pos"], grown, acc["i"], nxt),
        ).otherwise(state(acc["starts"], acc["cs"], grown, acc["ci"], nxt))

    def outer(acc, grp):
        inner = F.aggregate(grp, state(F.array().cast("array<int>"), acc["cs"], acc["pos"],
                                       acc["ci"], acc["i"]), step)
        return F.struct(F.concat(acc["parts"], F.array(inner["starts"])).alias("parts"),
                        inner["cs"].alias("cs"), inner["pos"].alias("pos"),
                        inner["ci"].alias("ci"), inner["i"].alias("i"))

    def finish(acc):
        last = F.when(acc["pos"] > acc["cs"], F.array(acc["ci"])).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.concat(acc["parts"], F.array(last)))

    init = F.struct(F.array().cast("array<array<int>>").alias("parts"), F.lit(0).alias("cs"),
                    F.lit(0).alias("pos"), F.lit(0).alias("ci"), F.lit(0).alias("i"))
    return F.aggregate(groups, init, outer, finish)


def join_pieces(pieces_col, starts) -> Column:
    """Chunk bytes: the pieces from each start index up to the next, joined
    (a chunk holds at most ``size`` bytes, so the join is bounded).  Both
    arguments must be columns of an earlier projection."""
    pc, starts = _col(pieces_col), _col(starts)
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(pc)))
    empty = F.lit(bytearray())
    return F.zip_with(starts, ends, lambda a, b: F.aggregate(F.slice(pc, a + 1, b - a), empty,
                                                            lambda acc, x: F.concat(acc, x)))


def lossy_text(binary) -> Column:
    """UTF-8 decode; each invalid byte sequence becomes U+FFFD."""
    return F.make_valid_utf8(_col(binary).cast("string"))


# ---------------------------------------------------------------------------
# Normalisation and tokens
# ---------------------------------------------------------------------------
def normalize(text) -> Column:
    out = F.translate(F.lower(_col(text)), lexicon.FOLD_FROM, lexicon.FOLD_TO)
    for src, dst in lexicon.FOLD_EXPAND:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


def tokens(text) -> Column:
    return F.regexp_extract_all(normalize(text), F.lit(lexicon.TOKEN_PATTERN), F.lit(0))


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


@functools.lru_cache(maxsize=None)
def _in_list(words: tuple[str, ...]) -> str:
    return ", ".join(_sql_str(w) for w in words)


def stopwords_present(token_array: str) -> Column:
    """Distinct tokens that are a stop word of any supported language."""
    every = tuple(sorted({w for c in lexicon.language_codes() for w in lexicon.stopwords(c)}))
    return F.expr(f"filter(array_distinct({token_array}), t -> t IN ({_in_list(every)}))")


def vote_count(present: str, code: str) -> Column:
    """How many of the ``present`` stop words belong to language ``code``."""
    return F.expr(f"size(filter({present}, t -> t IN ({_in_list(lexicon.stopwords(code))})))")


def pick_language(counts: dict[str, str]) -> Column:
    """Language with the highest count column; ties go to the alphabetically
    first code; NULL when every count is 0."""
    codes = sorted(counts)
    best = F.greatest(*[F.col(counts[c]) for c in codes])
    out = F.when(best == 0, F.lit(None).cast("string"))
    for c in codes:
        out = out.when(F.col(counts[c]) == best, F.lit(c))
    return out


@functools.lru_cache(maxsize=None)
def _stopword_sql(token: str, lang: str) -> str:
    whens = " ".join(f"WHEN {lang} = '{c}' THEN {token} IN ({_in_list(lexicon.stopwords(c))})"
                     for c in lexicon.language_codes())
    return f"CASE {whens} ELSE false END"


def effective_language(detected) -> Column:
    return F.coalesce(_col(detected), F.lit(lexicon.FALLBACK_LANGUAGE))


@functools.lru_cache(maxsize=None)
def _stem_sql(term: str, lang: str) -> str:
    outer = []
    for code, rules in lexicon.STEM_RULES.items():
        whens = []
        for suffix, repl, min_len, blockers in rules:
            cond = [f"endswith({term}, {_sql_str(suffix)})", f"char_length({term}) >= {min_len}"]
            cond += [f"NOT endswith({term}, {_sql_str(b)})" for b in blockers]
            whens.append(f"WHEN {' AND '.join(cond)} THEN "
                         f"concat(substr({term}, 1, char_length({term}) - {len(suffix)}), {_sql_str(repl)})")
        outer.append(f"WHEN {lang} = '{code}' THEN CASE {' '.join(whens)} ELSE {term} END")
    shortest = min(r[2] for rules in lexicon.STEM_RULES.values() for r in rules)
    return f"CASE WHEN char_length({term}) < {shortest} THEN {term} {' '.join(outer)} ELSE {term} END"


def stem(term: str, lang: str) -> Column:
    """Light suffix stripping by language (rules in ``lexicon.STEM_RULES``)."""
    return F.expr(_stem_sql(term, lang))


def term_index(term) -> Column:
    """32-bit term id: the first 8 hex digits of md5(term), as BIGINT."""
    return F.conv(F.substring(F.md5(_col(term)), 1, 8), 16, 10).cast("bigint")


def bm25_saturation(tf, dl, k1: float, b: float, avgdl) -> Column:
    tf, dl = _col(tf).cast("double"), _col(dl).cast("double")
    return tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / F.lit(avgdl)))
