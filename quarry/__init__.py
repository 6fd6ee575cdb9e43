"""quarry: a PySpark engine for preparing and searching text corpora.

Documents are cut into byte-bounded chunks, turned into BM25-weighted sparse
term vectors (a postings table), and whole batches or streams of queries are
answered with top-k retrieval, context assembly and prompt building.  Every
stage is a DataFrame transformation that Catalyst and adaptive execution plan.
"""

from quarry.config import Settings

__all__ = ["Settings"]
