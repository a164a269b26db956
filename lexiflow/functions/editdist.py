"""Word-level edit distance for long texts.

Bit-parallel Levenshtein (the bit-vector method for edit distance published by
Myers, 1999, in the form for global distance given by Hyyrö, 2003): one column
of the dynamic-programming table is held as two bit vectors over the reference
words, so each hypothesis word costs a constant number of big-integer
operations.  Time is O(n * m / w) with machine word w instead of O(n * m) cell
updates.  It runs inside an Arrow-batched pandas UDF; Spark partitions the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from operator import ne

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def place_by_place(h: Sequence, r: Sequence) -> list[int] | None:
    """The places where two sequences of one length differ, if replacing the items there is a best way to turn one into the
    other: nothing is cheaper than the items that one has and the other has not.  None where that does not tell."""
    if len(h) != len(r):
        return None
    at = [i for i, differ in enumerate(map(ne, h, r)) if differ]
    left = Counter([h[i] for i in at])
    left.subtract([r[i] for i in at])
    return at if sum(n for n in left.values() if n > 0) == len(at) else None


def word_edit_distance(h: list, r: list) -> int:
    replaced = place_by_place(h, r)
    if replaced is not None:
        return len(replaced)
    # Equal words at both ends cost nothing in some best alignment.
    lo, n = 0, min(len(h), len(r))
    while lo < n and h[lo] == r[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and h[-1 - hi] == r[-1 - hi]:
        hi += 1
    h, r = h[lo:len(h) - hi], r[lo:len(r) - hi]
    m = len(r)
    if m == 0 or not h:
        return max(m, len(h))
    peq: dict = {}
    for j, w in enumerate(r):
        peq[w] = peq.get(w, 0) | (1 << j)
    mask = (1 << m) - 1
    top = 1 << (m - 1)
    vp, vn, dist = mask, 0, m
    for w in h:
        eq = peq.get(w, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn)
        hp = vn | (~(d0 | vp) & mask)
        hn = vp & d0
        if hp & top:
            dist += 1
        elif hn & top:
            dist -= 1
        x = ((hp << 1) | 1) & mask
        vn = x & d0
        vp = (((hn << 1) & mask) | (~(x | d0) & mask))
    return dist


_OUT = T.StructType([T.StructField("errors", T.LongType()), T.StructField("ref_words", T.LongType())])


@F.pandas_udf(_OUT)
def _errors_udf(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    errs, refs = [], []
    for h, r in zip(hyp, ref):
        if h is None or r is None:
            errs.append(None)
            refs.append(None)
            continue
        rw = r.split()
        errs.append(word_edit_distance(h.split(), rw))
        refs.append(len(rw))
    return pd.DataFrame({"errors": pd.array(errs, dtype="Int64"), "ref_words": pd.array(refs, dtype="Int64")})


def errors_and_words(hyp: Column, ref: Column) -> Column:
    """struct(errors, ref_words) with Python ``str.split()`` word boundaries."""
    return _errors_udf(hyp, ref)

