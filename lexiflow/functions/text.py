"""String and text column functions (word split, pre-tokens, path pieces)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.functions._util import col_of

# ---- fixed values (must equal the reference's behaviour) --------------------
# Whitespace that Python's ``str.split()`` splits on: ASCII controls 0x09-0x0D,
# 0x1C-0x1F, space, NEL, NBSP and the Unicode space separators.  Written out so
# that Java regex and RE2 (the DuckDB oracle) read the same class.
WHITESPACE_CLASS = (
    "[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
# Word characters of the pre-tokenizer: letters, marks, decimal digits, connector
# punctuation.  A pre-token is a run of word characters or a run of characters
# that are neither word characters nor whitespace.
WORD_CHARS = "\\p{L}\\p{M}\\p{Nd}\\p{Pc}"
PRETOKEN_PATTERN = f"[{WORD_CHARS}]+|[^{WORD_CHARS}{WHITESPACE_CLASS[1:-1]}]+"
# ------------------------------------------------------------------------------
# The same for Java's engine, which tries the members of a class in turn: most characters are told by the first look.
_WHITESPACE = f"(?![!-~]){WHITESPACE_CLASS}+"


def words(c) -> Column:
    """Whitespace word split; leading/trailing whitespace yields no empty word."""
    return F.array_remove(F.split(col_of(c), _WHITESPACE), "")


def split_words(c) -> Column:
    """``words`` by Python's ``str.split`` in Arrow batches (``session.text_batches`` bounds their rows)."""
    def split(text: pa.Array) -> pa.Array:
        flat, starts = [], []
        for t in text.to_pylist():
            starts.append(None if t is None else len(flat))
            flat += (t or "").split()
        return pa.ListArray.from_arrays(pa.array([*starts, len(flat)], pa.int32()), pa.array(flat, pa.string()))
    return F.arrow_udf(split, T.ArrayType(T.StringType()))(col_of(c))


def first_word(c) -> Column:
    """First of ``words``, NULL if there is none; the text is split no further."""
    return F.try_element_at(F.array_remove(F.split(col_of(c), _WHITESPACE, 3), ""), F.lit(1))


def n_words(c) -> Column:
    return F.size(words(c))


def pretokenize(c) -> Column:
    """Runs of word characters or runs of punctuation (BPE pre-tokens)."""
    return F.regexp_extract_all(col_of(c), F.lit(PRETOKEN_PATTERN), 0)


def is_blank(c) -> Column:
    """True for empty or whitespace-only text (NULL stays NULL)."""
    return ~col_of(c).rlike("[^" + WHITESPACE_CLASS[1:-1] + "]")


def strip_prefix(c, n: int) -> Column:
    """Drop the first ``n`` code points; NULL stays NULL."""
    c = col_of(c)
    return F.substring(c, n + 1, 2147483647)


def build_path(root, *parts) -> Column:
    """Path key = constant root + directory + file name (NULL in, NULL out)."""
    cols = [F.lit(root) if isinstance(root, str) else root] + [col_of(p) for p in parts]
    return F.concat(*cols)


def file_extension(c) -> Column:
    """Text after the last dot (whole text if there is no dot)."""
    return F.substring_index(col_of(c), ".", -1)


def reader_format(path) -> Column:
    """Reader name from a path column: csv and raw read as CSV, any other
    extension is the format name itself (lower-cased)."""
    ext = F.lower(file_extension(path))
    return F.when(ext.isin("csv", "raw"), F.lit("csv")).otherwise(ext)
