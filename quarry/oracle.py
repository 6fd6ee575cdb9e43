"""SQL (DuckDB dialect) text that recomputes each registered query independently.

Written as plain SQL over the driver's views (``documents``, ``benchmark``,
``conversations``, ``events`` ...).  The fixed word lists and rules come from
``quarry.functions.lexicon`` so both engines use the same values; the logic
is written separately here.
"""

from __future__ import annotations

from quarry.config import (BM25_AVGDL, BM25_B, BM25_K1, CONTEXT_SEPARATOR, DEFAULT_CHUNK_SIZE,
                           DEFAULT_DELIMITERS, DEFAULT_MODEL, DEFAULT_SEARCH_LIMIT,
                           NO_RESPONSE_DETAIL, PROMPT_HEAD, PROMPT_MIDDLE, PROMPT_TAIL)
from quarry.functions import lexicon
from quarry.sources.tables import (BAD_UTF8, CHANGED_FILE_MTIME, DERIVED_FILE_MTIME, DOCUMENT_EXTENSIONS,
                                   REQUEST_LIMITS, REQUEST_MODELS)

CONV_QUERY_ID = "CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)"


def q(s: str) -> str:
    """SQL string literal (escape quotes, keep newlines via chr(10))."""
    parts = s.split("\n")
    lits = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(lits) if len(lits) > 1 else lits[0]


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


# ---------------------------------------------------------------------------
# Chunks
# ---------------------------------------------------------------------------
def _cut_len(pos: str, size: int, delimiters: str) -> str:
    delim_hex = "|".join(f"{ord(d):02X}" for d in delimiters)
    window = f"substr(h, 2 * ({pos}) + 1, {2 * size})"
    last = f"length(regexp_extract({window}, '^((?:[0-9A-F]{{2}})*(?:{delim_hex}))', 1)) // 2"
    return (f"CASE WHEN nb - ({pos}) <= {size} THEN nb - ({pos}) "
            f"ELSE coalesce(nullif({last}, 0), {size}) END")


def chunks_cte(source: str = "documents", size: int = DEFAULT_CHUNK_SIZE,
               delimiters: str = DEFAULT_DELIMITERS, key: str = "doc_id",
               text_col: str = "text", name: str = "chunks") -> str:
    """CTEs ending in ``{name}(doc_id, chunk_no, content, n_bytes)`` (no WITH keyword)."""
    return f"""
{name}_src AS (
  SELECT {key} AS doc_id, hex(encode({text_col})) AS h, strlen({text_col}) AS nb
  FROM {source} WHERE {text_col} IS NOT NULL AND length({text_col}) > 0
),
{name}_cut(doc_id, chunk_no, p, n, h, nb) AS (
  SELECT doc_id, 0, 0, {_cut_len('0', size, delimiters)}, h, nb FROM {name}_src
  UNION ALL
  SELECT doc_id, chunk_no + 1, p + n, {_cut_len('p + n', size, delimiters)}, h, nb
  FROM {name}_cut WHERE p + n < nb
),
{name}_hex AS (
  SELECT doc_id, chunk_no, n AS n_bytes, substr(h, 2 * p + 1, 2 * n) AS x FROM {name}_cut
),
{name}_edges AS (
  SELECT doc_id, chunk_no, n_bytes, x,
         length(regexp_extract(x, '^((?:[89AB][0-9A-F])*)', 1)) // 2 AS k_head,
         length(regexp_extract(x, '((?:[CD][0-9A-F])|(?:E[0-9A-F](?:[89AB][0-9A-F])?)|(?:F[0-7](?:[89AB][0-9A-F]){{0,2}}))$', 1)) // 2 AS k_tail
  FROM {name}_hex
),
{name} AS (
  SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no,
         repeat(chr(65533), CAST(k_head AS BIGINT))
           || decode(unhex(substr(x, 2 * k_head + 1, length(x) - 2 * k_head - 2 * k_tail)))
           || CASE WHEN k_tail > 0 THEN chr(65533) ELSE '' END AS content,
         CAST(n_bytes AS INTEGER) AS n_bytes
  FROM {name}_edges
)"""


# ---------------------------------------------------------------------------
# Terms
# ---------------------------------------------------------------------------
def normalize_sql(col: str) -> str:
    out = f"translate(lower({col}), {q(lexicon.FOLD_FROM)}, {q(lexicon.FOLD_TO)})"
    for src, dst in lexicon.FOLD_EXPAND:
        out = f"replace({out}, {q(src)}, {q(dst)})"
    return out


def tokens_sql(col: str) -> str:
    return f"regexp_extract_all({normalize_sql(col)}, '{lexicon.TOKEN_PATTERN}', 0)"


def _list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def vote_sql(tok: str = "tokens") -> str:
    codes = lexicon.language_codes()
    counts = {c: f"len(list_intersect({tok}, {_list(lexicon.stopwords(c))}))" for c in codes}
    best = "greatest(" + ", ".join(counts.values()) + ")"
    whens = " ".join(f"WHEN {counts[c]} = {best} THEN '{c}'" for c in codes)
    return f"CASE WHEN {best} = 0 THEN NULL {whens} END"


def stopword_sql(tok: str, lang: str) -> str:
    parts = [f"({lang} = '{c}' AND {tok} IN ({', '.join(q(w) for w in lexicon.stopwords(c))}))"
             for c in lexicon.language_codes()]
    return "(" + " OR ".join(parts) + ")"


def stem_sql(term: str, lang: str) -> str:
    outer = []
    for code, rules in lexicon.STEM_RULES.items():
        whens = []
        for suffix, repl, min_len, blockers in rules:
            cond = [f"{term} LIKE {q('%' + suffix)}", f"length({term}) >= {min_len}"]
            cond += [f"{term} NOT LIKE {q('%' + b)}" for b in blockers]
            whens.append(f"WHEN {' AND '.join(cond)} THEN substr({term}, 1, length({term}) - {len(suffix)}) || {q(repl)}")
        outer.append(f"WHEN {lang} = '{code}' THEN (CASE {' '.join(whens)} ELSE {term} END)")
    return f"(CASE {' '.join(outer)} ELSE {term} END)"


def term_index_sql(term: str) -> str:
    return f"CAST(CAST('0x' || substr(md5({term}), 1, 8) AS UBIGINT) AS BIGINT)"


def weight_sql(tf: str = "tf", dl: str = "dl", fold: str = "occurrence", avgdl: str = dbl(BM25_AVGDL)) -> str:
    t, d = f"CAST({tf} AS DOUBLE)", f"CAST({dl} AS DOUBLE)"
    sat = (f"({t} * {dbl(BM25_K1 + 1.0)} / ({t} + {dbl(BM25_K1)} * ({dbl(1.0 - BM25_B)} + "
           f"{dbl(BM25_B)} * {d} / {avgdl})))")
    return f"({t} * {sat})" if fold == "occurrence" else sat


def analyzed_cte(name: str, source: str, keys: list[str], text_col: str) -> str:
    """``{name}(keys..., tokens, lang_detected, lang)``."""
    k = ", ".join(keys)
    return f"""
{name}_tok AS (SELECT {k}, {tokens_sql(text_col)} AS tokens FROM {source}),
{name} AS (
  SELECT {k}, tokens, lang_detected, coalesce(lang_detected, '{lexicon.FALLBACK_LANGUAGE}') AS lang
  FROM (SELECT {k}, tokens, {vote_sql('tokens')} AS lang_detected FROM {name}_tok)
)"""


def postings_cte(name: str, source: str, keys: list[str], text_col: str,
                 stemming: bool = True, fold: str = "occurrence", avgdl: str = dbl(BM25_AVGDL)) -> str:
    """``{name}(keys..., lang, term, tf, dl, term_index, weight)`` plus helper CTEs."""
    k = ", ".join(keys)
    term = stem_sql("token", "lang") if stemming else "token"
    return analyzed_cte(f"{name}_an", source, keys, text_col) + f""",
{name}_tk AS (
  SELECT {k}, lang, token FROM (SELECT {k}, lang, unnest(tokens) AS token FROM {name}_an)
  WHERE NOT {stopword_sql('token', 'lang')}
),
{name}_tf AS (
  SELECT {k}, lang, {term} AS term, count(*) AS tf FROM {name}_tk GROUP BY ALL
),
{name} AS (
  SELECT {k}, lang, term, tf, dl, {term_index_sql('term')} AS term_index, {weight_sql('tf', 'dl', fold, avgdl)} AS weight
  FROM (SELECT *, sum(tf) OVER (PARTITION BY {k}) AS dl FROM {name}_tf)
)"""


def vectors_cte(name: str, postings: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    return f"""
{name} AS (SELECT {k}, term_index, sum(weight) AS weight FROM {postings} GROUP BY {k}, term_index)"""


def benchmark_queries_cte(name: str = "queries") -> str:
    return f"""
{name} AS (SELECT item_id AS query_id, text AS query, CAST(NULL AS BIGINT) AS "limit",
                  CAST(NULL AS VARCHAR) AS model FROM benchmark)"""


def _by_remainder(values: tuple, kind: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {q(v) if isinstance(v, str) else v}" for k, v in enumerate(values) if v is not None)
    return f"CAST(CASE (conv_id + turn) % {len(values)} {whens} END AS {kind})"


def conversation_queries_cte(name: str = "queries") -> str:
    return f"""
{name} AS (SELECT {CONV_QUERY_ID} AS query_id, text AS query, {_by_remainder(REQUEST_LIMITS, 'BIGINT')} AS "limit",
                  {_by_remainder(REQUEST_MODELS, 'VARCHAR')} AS model FROM conversations WHERE role = 'user')"""


def conversation_answers_cte(name: str = "answers") -> str:
    return f"""
{name} AS (
  SELECT CAST(u.conv_id AS VARCHAR) || ':' || CAST(u.turn AS VARCHAR) AS query_id, a.text AS response
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


# Mean length of the chunks that have terms (of the terms of dpost, before they are weighted).
CORPUS_AVGDL = "(SELECT avg(l) FROM (SELECT sum(tf) AS l FROM dpost_tf GROUP BY doc_id, chunk_no))"
# Document frequency by term index, and ln(1 + (N - df + 1/2) / (df + 1/2)) of a row with df.
FREQUENCY_CTES = """
held AS (SELECT DISTINCT doc_id, chunk_no, term_index FROM dpost),
freq AS (SELECT term_index, count(*) AS df FROM held GROUP BY term_index),
corpus AS (SELECT count(*) AS n_chunks FROM (SELECT DISTINCT doc_id, chunk_no FROM held))"""
IDF_SQL = "ln(1 + ((SELECT n_chunks FROM corpus) - df + 0.5) / CAST(df + 0.5 AS DOUBLE))"


def search_ctes(queries: str = "queries", source: str = "documents", idf: bool = False,
                avgdl: str = dbl(BM25_AVGDL)) -> str:
    """From ``{queries}`` and ``{source}(doc_id, text)``: chunks, postings, vectors, scores, hits."""
    qvec = f"""{FREQUENCY_CTES}, {vectors_cte('qraw', 'qpost', ['query_id'])},
qvec AS (SELECT query_id, term_index, weight * {IDF_SQL} AS weight FROM qraw JOIN freq USING (term_index))"""
    return ",".join([
        chunks_cte(source=source),
        postings_cte("dpost", "chunks", ["doc_id", "chunk_no"], "content", avgdl=avgdl),
        vectors_cte("dvec", "dpost", ["doc_id", "chunk_no"]),
        postings_cte("qpost", queries, ["query_id"], "query", avgdl=avgdl),
        qvec if idf else vectors_cte("qvec", "qpost", ["query_id"]),
        f"""
qdef AS (SELECT query_id, query, coalesce("limit", {DEFAULT_SEARCH_LIMIT}) AS "limit",
                coalesce(model, '{DEFAULT_MODEL}') AS model FROM {queries} WHERE coalesce("limit", 0) >= 0),
scores AS (
  SELECT q.query_id, d.doc_id, d.chunk_no, round(sum(q.weight * d.weight), 6) AS score
  FROM qvec q JOIN dvec d ON q.term_index = d.term_index
  GROUP BY q.query_id, d.doc_id, d.chunk_no
),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.doc_id, s.chunk_no) AS rank
  FROM scores s
),
hits AS (
  SELECT r.query_id, CAST(r.rank AS INTEGER) AS rank, r.doc_id, r.chunk_no, r.score, c.content
  FROM ranked r JOIN qdef USING (query_id) JOIN chunks c USING (doc_id, chunk_no)
  WHERE r.rank <= qdef."limit"
)"""])


def prompt_sql(context: str, query: str) -> str:
    return f"{q(PROMPT_HEAD)} || {context} || {q(PROMPT_MIDDLE)} || {query} || {q(PROMPT_TAIL)}"


SEPARATOR_SQL = q(CONTEXT_SEPARATOR)
NO_RESPONSE_SQL = q(NO_RESPONSE_DETAIL)


# ---------------------------------------------------------------------------
# Files derived from the tables
# ---------------------------------------------------------------------------
def files_ctes(name: str = "files", changed: bool = False) -> str:
    """``{name}(path, mtime, length, ext, route, ok, body)`` and ``{name}_parsed(doc_id, path, ext, text, ...)``."""
    more, bad, text, mtime = "doc_id % 3 = 0", f"doc_id % 50 = {BAD_UTF8}", "text", q(DERIVED_FILE_MTIME)
    if changed:
        spoilt = f"(NOT ({more}) AND doc_id % 7 = 0)"
        bad, text = f"({bad} OR {spoilt})", f"CASE WHEN {more} THEN text || ' Amended.' ELSE text END"
        mtime = f"CASE WHEN {more} OR {spoilt} THEN {q(CHANGED_FILE_MTIME)} ELSE {mtime} END"
    ext = " ".join(f"WHEN {k} THEN {q(v)}" for k, v in DOCUMENT_EXTENSIONS.items())
    return f"""
{name}_raw AS (
  SELECT 'corpus/' || source || '/doc-' || CAST(doc_id AS VARCHAR) || CASE doc_id % 50 {ext} ELSE '.txt' END AS path,
         {mtime} AS mtime, {text} AS body, NOT {bad} AS ok FROM documents
  UNION ALL
  SELECT 'web/page-' || CAST(page_id AS VARCHAR) || '.html', {q(DERIVED_FILE_MTIME)}, html, true FROM pages
),
{name} AS (
  SELECT *, CAST(strlen(body) + CASE WHEN ok THEN 0 ELSE 1 END AS BIGINT) AS length,
         CASE WHEN ext = '' THEN 'no_extension' WHEN ext IN ('md', 'txt') THEN 'text'
              WHEN ext = 'pdf' THEN 'no_extractor' ELSE 'unsupported' END AS route
  FROM (SELECT *, regexp_extract(path, '\\.([^./]+)$', 1) AS ext FROM {name}_raw)
),
{name}_parsed AS (
  SELECT md5(path) AS doc_id, path, ext, body AS text, length AS n_bytes, sha256(body) AS content_sha, mtime
  FROM {name} WHERE route = 'text' AND ok
)"""


def points_ctes(source: str, name: str) -> str:
    """``{name}(doc_id, chunk_no, n_entries)``: the points of ``source(doc_id, text)``."""
    return f"""{chunks_cte(source=source, name=f'{name}_ch')},
{postings_cte(f'{name}_po', f'{name}_ch', ['doc_id', 'chunk_no'], 'content')},
{vectors_cte(f'{name}_ve', f'{name}_po', ['doc_id', 'chunk_no'])},
{name} AS (SELECT doc_id, chunk_no, count(*) AS n_entries FROM {name}_ve GROUP BY doc_id, chunk_no)"""


def numbered(source: str, after: str = "0") -> str:
    return f"SELECT {after} + row_number() OVER (ORDER BY doc_id, chunk_no) AS point_id, * FROM {source}"
