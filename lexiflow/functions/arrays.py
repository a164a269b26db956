"""Array column functions over token-id sequences and score vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.functions._util import col_of, let

# ---- fixed values: special-token ids of the tokenizer ------------------------
UNK, CLS, SEP, PAD, MASK, BOS, EOS = 0, 1, 2, 3, 4, 5, 6
SPECIAL_TOKENS = ["[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]", "<s>", "</s>"]
# ------------------------------------------------------------------------------


def add_bos_eos(ids, bos: int = BOS, eos: int = EOS) -> Column:
    return F.concat(F.array(F.lit(bos)), col_of(ids), F.array(F.lit(eos)))


def strip_bos_eos(ids, eos: int = EOS) -> Column:
    """Drop the first id, and the last one only when it is EOS (a decode that
    stopped on the length limit keeps its last real token)."""
    a = col_of(ids)
    n = F.size(a)
    keep = F.when(F.try_element_at(a, F.lit(-1)) == F.lit(eos), n - 2).otherwise(n - 1)
    return F.when(n <= 1, F.array().cast("array<int>")).otherwise(F.slice(a, 2, F.greatest(keep, F.lit(0))))


def pad_mask(ids, pad: int = PAD) -> Column:
    return F.transform(col_of(ids), lambda x: x == F.lit(pad))


def strip_pad(ids, pad: int = PAD) -> Column:
    return F.array_remove(col_of(ids), pad)


def shift_pairs(labels) -> Column:
    """Teacher forcing: struct(decoder_input = all but last, target = all but first)."""
    a = col_of(labels)
    k = F.greatest(F.size(a) - 1, F.lit(0))
    return F.struct(F.slice(a, 1, k).alias("decoder_input"), F.slice(a, 2, k).alias("target"))


def argmax(v) -> Column:
    """0-based index of the first maximum."""
    a = col_of(v)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def ctc_collapse(frames, blank: int = 0) -> Column:
    """Argmax per frame, collapse runs of the same id, drop the blank id."""
    best = F.transform(col_of(frames), lambda fr: (F.array_position(fr, F.array_max(fr)) - 1).cast("int"))

    def collapse(ids):
        runs = F.filter(ids, lambda x, i: (i == 0) | (x != F.element_at(ids, F.greatest(i, F.lit(1)))))
        return F.filter(runs, lambda x: x != F.lit(blank))
    return let(best, collapse)


def one_hot(c, k: int) -> Column:
    """Dense one-hot vector of width ``k`` (``one_hot_sparse`` for wide ones)."""
    x = col_of(c)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == x).cast("int"))


def one_hot_sparse(c, k: int) -> Column:
    """One-hot vector of any width as struct(size, indices, values); an id outside 0..k-1 or NULL has no entry."""
    x = col_of(c)
    inside = F.coalesce((x >= 0) & (x < k), F.lit(False))
    return F.struct(F.lit(k).alias("size"), F.when(inside, F.array(x.cast("int"))).otherwise(F.array().cast("array<int>")).alias("indices"),
                    F.when(inside, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("values"))


def cross_entropy(logits, target) -> Column:
    """-log softmax(logits)[target], computed with the maximum subtracted first."""
    v = col_of(logits)
    t = col_of(target)

    def body(m):
        lse = F.log(F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + F.exp(x.cast("double") - m))) + m
        return lse - F.element_at(v, t + 1).cast("double")
    return let(F.array_max(v).cast("double"), body)


def position_vector(pos, d: int) -> Column:
    """Sinusoidal position features: even slots sin, odd slots cos of
    pos * 10000^(-2i/d), where 2i is the slot rounded down to even."""
    p = col_of(pos).cast("double")
    scale = -math.log(10000.0) / d

    def slot(i):
        ang = p * F.exp((i - F.pmod(i, F.lit(2))).cast("double") * F.lit(scale))
        return F.when(F.pmod(i, F.lit(2)) == 0, F.sin(ang)).otherwise(F.cos(ang))
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), slot)


def add_vectors(a, b) -> Column:
    return F.zip_with(col_of(a), col_of(b), lambda x, y: x.cast("double") + y.cast("double"))


def insert_at(ids, pos, val) -> Column:
    """Insert ``val`` before 0-based index ``pos``."""
    a = col_of(ids)
    p = col_of(pos) if not isinstance(pos, int) else F.lit(pos)
    v = col_of(val) if not isinstance(val, int) else F.lit(val)
    return F.concat(F.slice(a, 1, p), F.array(v), F.slice(a, p + 1, F.greatest(F.size(a) - p, F.lit(0))))


def ids_text(ids) -> Column:
    """Comma-joined text of an array (stable form for comparisons)."""
    return F.array_join(F.transform(col_of(ids), lambda x: x.cast("string")), ",")


# ---- ids on the way through a shuffle ---------------------------------------------
_PACKED = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("planes", T.BinaryType())])


def _flat_ids(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows and the rows' ends in them."""
    ids = pa.concat_arrays([ids])
    return ids.flatten().to_numpy(zero_copy_only=False).astype("<i4"), np.cumsum([0, *(n or 0 for n in pa.compute.list_value_length(ids).to_pylist())])


def pack_ids(ids) -> Column:
    """struct(n, planes) of an array of ids (none NULL): their number, and the ids byte by byte (all low bytes first) compressed."""
    @F.arrow_udf(_PACKED)
    def pack(ids: pa.Array) -> pa.Array:
        flat, ends = _flat_ids(ids)
        rows = [None if not v else pa.compress(flat[a:b].view("u1").reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)
                for a, b, v in zip(ends, ends[1:], ids.is_valid().to_pylist())]
        sizes = pa.compute.list_value_length(ids).cast(pa.int32())
        return pa.StructArray.from_arrays([sizes, pa.array(rows, pa.binary())], ["n", "planes"], mask=ids.is_null())
    return pack(col_of(ids))


def unpack_ids(packed, width=None, fill: int = PAD) -> Column:
    """The array of ``pack_ids``, filled up with ``fill`` to ``width`` ids."""
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def unpack(packed: pa.Array, width: pa.Array) -> pa.Array:
        parts, starts, size = [], [], 0
        for row, w in zip(packed.to_pylist(), width.to_pylist()):
            starts.append(None if row is None else size)
            if row is not None:
                ids = np.full(max(w or 0, row["n"]), fill, "<i4")
                ids[:row["n"]] = np.frombuffer(pa.decompress(row["planes"], 4 * row["n"], "zstd"), "u1").reshape(4, -1).T.copy().view("<i4").ravel()
                parts.append(ids)
                size += len(ids)
        flat = pa.array(np.concatenate(parts) if parts else np.empty(0, "<i4"), pa.int32())
        return pa.ListArray.from_arrays(pa.array([*starts, size], pa.int32()), flat)
    return unpack(col_of(packed), F.lit(None).cast("int") if width is None else col_of(width))
