"""Language resources: stop words, accent folding, suffix rules.

The stop-word lists are Spark ML's own default lists (the resources behind
``StopWordsRemover.loadDefaultStopWords``), read from the Spark ML jar so that
the Spark plans and the SQL oracle use exactly the same words.
"""

from __future__ import annotations

import functools
import glob
import os
import unicodedata
import zipfile

import regex

# ---------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------
# Detected languages, in tie-break order (alphabetical), with the name of the
# Spark ML stop-word list for each.
LANGUAGES = (("da", "danish"), ("de", "german"), ("en", "english"), ("es", "spanish"), ("fi", "finnish"),
             ("fr", "french"), ("hu", "hungarian"), ("it", "italian"), ("nl", "dutch"), ("no", "norwegian"),
             ("pt", "portuguese"), ("ru", "russian"), ("sv", "swedish"), ("tr", "turkish"))
# Language assumed when no stop word of any language occurs in a text.
FALLBACK_LANGUAGE = "en"
# Accent folding, applied after lower-casing: letters that expand to two (the one-to-one
# letters follow from a rule, below).
FOLD_EXPAND = (("ß", "ss"), ("œ", "oe"), ("æ", "ae"))
# A token is a maximal run of letters and digits.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
# Light suffix stripping per language: ordered (suffix, replacement,
# minimum word length, endings that block the rule); the first rule that
# applies wins, at most one rule per word.
STEM_RULES = {
    "en": (("ies", "y", 4, ("eies", "aies")),
           ("es", "e", 4, ("aes", "ees", "oes")),
           ("s", "", 4, ("us", "ss"))),
    "fr": (("aux", "al", 5, ()),
           ("s", "", 4, ("ss",)),
           ("x", "", 4, ())),
    "es": (("ces", "z", 5, ()),
           ("es", "", 5, ()),
           ("s", "", 4, ("ss",))),
    "de": (("ern", "", 6, ()),
           ("em", "", 5, ()),
           ("en", "", 5, ()),
           ("er", "", 5, ()),
           ("es", "", 5, ()),
           ("e", "", 4, ()),
           ("n", "", 4, ()),
           ("s", "", 4, ())),
}



def _accented(first: int, last: int) -> list[tuple[str, str]]:
    """The letters of a range that are a base letter and combining marks, with that letter."""
    out = []
    for c in map(chr, range(first, last + 1)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0].isalpha() and all(p in COMBINING_MARKS for p in parts[1:]):
            out.append((c, parts[0]))
    return out


# One-to-one folding: an accented Latin, Greek or Cyrillic letter becomes its base letter, and
# the marks that a decomposed form writes after it are deleted, so that both forms of a
# letter give one token.
COMBINING_MARKS = "".join(map(chr, range(0x300, 0x370)))
_ACCENTED = _accented(0xC0, 0x52F) + _accented(0x1E00, 0x1FFF)
FOLD_FROM = "".join(a for a, _ in _ACCENTED) + COMBINING_MARKS
FOLD_TO = "".join(b for _, b in _ACCENTED)

_TOKEN_RE = regex.compile(TOKEN_PATTERN)
_FOLD_TABLE = {**str.maketrans(dict(_ACCENTED)), **dict.fromkeys(map(ord, COMBINING_MARKS))}


def fold(text: str) -> str:
    """Python twin of the Spark folding expression (used for word lists)."""
    out = text.lower().translate(_FOLD_TABLE)
    for src, dst in FOLD_EXPAND:
        out = out.replace(src, dst)
    return out


def _read_spark_list(name: str) -> list[str]:
    import pyspark
    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            entry = f"org/apache/spark/ml/feature/stopwords/{name}.txt"
            if entry in z.namelist():
                return z.read(entry).decode("utf-8").split()
    # Without a local jar (e.g. a thin client) ask the JVM.
    from pyspark.ml.feature import StopWordsRemover
    return list(StopWordsRemover.loadDefaultStopWords(name))


@functools.lru_cache(maxsize=None)
def stopwords(lang: str) -> tuple[str, ...]:
    """Folded stop words of ``lang`` that can occur as tokens, sorted."""
    name = dict(LANGUAGES)[lang]
    words = {fold(w) for w in _read_spark_list(name)}
    return tuple(sorted(w for w in words if _TOKEN_RE.fullmatch(w)))


def language_codes() -> tuple[str, ...]:
    return tuple(code for code, _ in LANGUAGES)
