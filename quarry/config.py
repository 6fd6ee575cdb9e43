"""Defaults and fixed values of the engine."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values that results depend on (they must not drift between releases).
# ---------------------------------------------------------------------------
DEFAULT_CHUNK_SIZE = 1024          # bytes per chunk, upper bound
DEFAULT_DELIMITERS = "\n.?"        # a chunk is preferably cut right after one of these
BM25_K1 = 1.2
BM25_B = 0.75
BM25_AVGDL = 5.75                  # fixed average length, used for chunks and queries
DEFAULT_SEARCH_LIMIT = 10
DEFAULT_FIELD = "text"             # name of the stored and searched vector field
DEFAULT_MODEL = "gpt-4.1"
CONTEXT_SEPARATOR = "\n\n---\n\n"
PROMPT_TEMPLATE = "Based on this context:\n\n```text\n{context}\n```\n\n, reply to this query:\n\n```text\n{query}\n```"
NO_RESPONSE_DETAIL = "No response was generated by the language model"
BAD_LIMIT_DETAIL = "limit must be a non-negative integer"
SEARCH_FAILED = "Could not retrieve results because of "
REQUEST_FAILED = "Could not generate a request because of "
RESPONSE_FAILED = "Could not generate a response because of "
NO_QUERY_TEXT = "a query without text"
NO_MODEL_NAME = "a model without a name"
DEFAULT_RATE_LIMIT_PER_MINUTE = 100
SCORE_DECIMALS = 6
# The template around the two inserted values (derived, not separate values).
PROMPT_HEAD, _rest = PROMPT_TEMPLATE.split("{context}")
PROMPT_MIDDLE, PROMPT_TAIL = _rest.split("{query}")
del _rest

# Text that one task of the term path takes: its memory grows with this and not with the input.
SPREAD_BYTES = 8 << 20

# Queries whose term rows stay under this count are broadcast to the postings scan.
BROADCAST_QUERY_TERMS_MAX_ROWS = 2_000_000
# Batches of more queries are scored in blocks, which hold no row for a pair of a query and a chunk.
PAIR_ROWS_MAX_QUERIES = 250
# What a block takes: so many postings of chunks on one side, so many queries on the other.
BLOCK_POSTINGS, BLOCK_QUERIES = 1_000_000, 2_048
# Texts of hits: so many a task holds, read in stored blocks of so many bytes.
BLOCK_TEXTS, BLOCK_TEXT_BYTES = 250_000, 8 << 20
# Hits (queries x k) under this count are broadcast to the chunk table for content lookup.
BROADCAST_HITS_MAX_ROWS = 5_000_000
# Shuffle-join path: a term is "hot" when it holds more than 1/MAX_HOT_TERMS of all
# postings, so at most MAX_HOT_TERMS terms can be hot (a proven broadcast bound).
MAX_HOT_TERMS = 10_000
# Documents hit under this count are broadcast to the corpus, to cut only them again.
BROADCAST_FOUND_MAX_ROWS = 1_000_000
# Versions of files under this count are broadcast to the files.
BROADCAST_FILES_MAX_ROWS = 250_000
# Salt buckets a query's candidates are ranked in before its final ranking.
RANK_SALTS = 32
# Salt buckets a hot term's postings are spread over.
HOT_TERM_SALTS = 32
# Term buckets of a stored postings table.
DEFAULT_TERM_BUCKETS = 64
# A batch with at most this many query-term rows pushes its term list into the
# scan of a stored postings table (bucket pruning + parquet row-group skipping).
PUSHDOWN_MAX_QUERY_TERMS = 1_000


@dataclass(frozen=True)
class Settings:
    """Parameters of the load and serve pipelines."""

    chunk_size: int = DEFAULT_CHUNK_SIZE
    delimiters: str = DEFAULT_DELIMITERS
    k1: float = BM25_K1
    b: float = BM25_B
    # a fixed length, or "corpus": the mean length of the corpus' chunks that have terms
    avgdl: float | str = BM25_AVGDL
    # query weights times the inverse document frequency
    idf: bool = False
    # "occurrence": weight = tf * sat(tf, dl) (one entry per occurrence, summed);
    # "distinct": weight = sat(tf, dl).
    fold: str = "occurrence"
    stemming: bool = True
    default_limit: int = DEFAULT_SEARCH_LIMIT
    default_model: str = DEFAULT_MODEL

    @property
    def corpus_length(self) -> bool:
        return self.avgdl == "corpus"

    @property
    def uses_statistics(self) -> bool:
        return self.idf or self.corpus_length
