"""Global row order without a single-task window.

``with_row_index`` is a two-pass index: range-partition on the order key, sort
inside each partition, tag each row with (partition, position), write that
once with a reliable checkpoint (so a retried task cannot see other partition
boundaries), count rows per partition, turn the counts into offsets on that
tiny table, and add offset + position.  No task ever holds more than its
range partition, the broadcast table has one row per partition (bounded by the
partition count), and the order key must be unique for a deterministic index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lexiflow.functions import rng
from lexiflow.functions.arrays import PAD, unpack_ids
from lexiflow.session import ensure_checkpoint_dir

#: Rows of a bucket of the batch shuffle, about.
ROWS_PER_BUCKET = 20_000
_ROW_BITS = 33  # monotonically_increasing_id = partition << 33 | row in partition


def key_index(df: DataFrame, order: Sequence[str], out: str = "idx", n_parts: int | None = None,
              with_total: bool = False) -> DataFrame:
    """(order columns, ``out``): the dense 0-based index of every key, written once.

    The order columns must tell all rows apart (NULL is a value like others and
    comes first); repeated keys raise, since no index of theirs is reproducible."""
    return _key_index(df, order, out, n_parts, with_total)[0]


def _key_index(df: DataFrame, order: Sequence[str], out: str, n_parts: int | None, with_total: bool) -> tuple[DataFrame, bool]:
    """The index, and whether a key holds a NULL (both checks read the narrow stored table)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = list(order)
    tagged = (df.select(*keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), _ROW_BITS))
              .checkpoint())
    null = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    seen = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n"), F.max(null)).first()
    if (seen[0] or 0) > 1:
        raise ValueError(f"rows repeat the order key {keys}; add columns that tell them apart")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # At most ``n`` rows: the running sum runs on one task by design.
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"),
                            F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_total"))
    idx = tagged.join(F.broadcast(offsets), "_pid").select(
        *keys, (F.col("_off") + F.col("_pos")).alias(out), *(["_total"] if with_total else []))
    return idx, bool(seen[1])


def with_row_index(df: DataFrame, order: Sequence[str], out: str = "idx",
                   n_parts: int | None = None, with_total: bool = False) -> DataFrame:
    """Dense 0-based index in ``order`` (columns that tell all rows apart; see ``key_index``).

    Only the key columns go through the range shuffle and the checkpoint; the
    index comes back to the full rows with one join on the key, null-safe where a
    key holds a NULL (a plain join leaves the rows dealt by the key for what follows)."""
    keys = list(order)
    idx, null = _key_index(df, keys, out, n_parts, with_total)
    if set(df.columns) == set(keys):
        return idx
    if not null:
        return df.join(idx, keys)
    idx = idx.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in idx.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(idx[f"_k_{k}"])
    return df.join(idx, cond).drop(*[f"_k_{k}" for k in keys])


def with_bucketed_index(df: DataFrame, bucket: Column, order: Sequence[str | Column], out: str = "idx") -> DataFrame:
    """Global index when an order-preserving bucket of the key is known (for
    instance the leading bits of a hash key, which are uniform): rows are
    numbered inside each bucket by a window partitioned on the bucket, and the
    bucket's offset comes from the counts per bucket (one row per bucket: the
    caller bounds their number).  Deterministic,
    so no checkpoint is needed."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    b = df.withColumn("_b", bucket)
    counts = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    ranked = b.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*cols)) - 1)
    return ranked.join(F.broadcast(offsets), "_b").withColumn(out, F.col("_off") + F.col("_r")) \
        .drop("_b", "_off", "_r")


def hash_bucket(key: Column, bits: int = 12) -> Column:
    """Leading ``bits`` bits of a hex digest: order-preserving and uniform."""
    digits = (bits + 3) // 4
    return F.shiftright(F.conv(F.substring(key, 1, digits), 16, 10).cast("bigint"), digits * 4 - bits)


def positional_split(df: DataFrame, order: Sequence[str], bounds=(12000, 15000),
                     names=("train", "valid", "test"), out: str = "split", numbered: bool = True) -> DataFrame:
    """Rows [0, b1) -> names[0], [b1, b2) -> names[1], the rest -> names[2], in
    the given order.  Bounds below 1 are fractions of the row count (the count
    comes from the index pass, no extra scan).

    Without the number ``idx`` (``numbered=False``) the rows stay in their scan: only the keys
    are ordered, and a row's key is compared with the first keys of the second and later parts."""
    if not numbered:
        return _split_by_first_keys(df, list(order), bounds, names, out)
    idx = with_row_index(df, order, "_idx", with_total=True)
    label = split_label(F.col("_idx"), F.col("_total"), bounds, names)
    return idx.withColumn(out, label).drop("_total").withColumnRenamed("_idx", "idx")


def _split_by_first_keys(df: DataFrame, keys: list[str], bounds, names, out: str) -> DataFrame:
    idx, _ = _key_index(df, keys, "_idx", None, True)
    # A struct orders like the sort of its fields, NULL first; a part whose first key is missing has no rows.
    firsts = [F.max(F.when(F.col("_idx") == F.greatest(b, F.lit(0)), F.struct(*keys))).alias(f"_first{i}") for i, b in enumerate(_bounds(F.col("_total"), bounds))]
    rows = df.crossJoin(F.broadcast(idx.agg(*firsts).checkpoint()))  # one row
    label = None
    for i, name in enumerate(names[:len(firsts)]):
        before = F.coalesce(F.struct(*keys) < F.col(f"_first{i}"), F.lit(True))
        label = F.when(before, F.lit(name)) if label is None else label.when(before, F.lit(name))
    return rows.withColumn(out, label.otherwise(F.lit(names[-1]))).drop(*[f"_first{i}" for i in range(len(firsts))])


def _bounds(total: Column, bounds) -> list[Column]:
    """Bounds that are all fractions apply to ``total``."""
    fractional = all(isinstance(b, float) and b < 1 for b in bounds)
    return [F.floor(F.lit(float(b)) * total) if fractional else F.lit(int(b)) for b in bounds]


def split_label(idx: Column, total: Column, bounds, names) -> Column:
    """names[0] for numbers below bounds[0], and so on; bounds that are all fractions apply to ``total``."""
    bcols = _bounds(total, bounds)
    label = F.when(idx < bcols[0], F.lit(names[0]))
    for b, name in zip(bcols[1:], names[1:-1]):
        label = label.when(idx < b, F.lit(name))
    return label.otherwise(F.lit(names[-1]))


def offset_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Rows after the first ``n`` in the given order (a distributed OFFSET)."""
    return with_row_index(df, order, "_idx").where(F.col("_idx") >= F.lit(n)).drop("_idx")


def shuffle_order(seed: int, epoch, row_id: str = "row_id") -> list[Column]:
    """Sort key of a reproducible shuffle: keyed hash, then the row id."""
    return [rng.shuffle_key(seed, epoch, row_id), F.col(row_id)]


def assign_batches(df: DataFrame, size: int, seed: int = 1234, epoch: int = 0, row_id: str = "row_id",
                   by: str | None = None) -> DataFrame:
    """Shuffle with a keyed hash and cut into batches of ``size`` (the last may
    be short).  With ``by`` (e.g. the split column) each group is batched on its
    own; batch ids are then unique within the group."""
    ep = F.lit(epoch)
    keyed = df.withColumn("_k", rng.shuffle_key(seed, ep, row_id))
    if by:
        idx = with_row_index(keyed, [by, "_k", row_id], "_g")
        first = idx.groupBy(by).agg(F.min("_g").alias("_first"))
        # one row per group value: small by construction
        idx = idx.join(F.broadcast(first), by).withColumn("_idx", F.col("_g") - F.col("_first")).drop("_g", "_first", "_k")
    else:
        # Buckets of some ten thousand rows, at least 2 and at most 2**20 (the offsets are one row per bucket).
        bits = min(20, max(1, (keyed.count() // ROWS_PER_BUCKET).bit_length()))
        idx = with_bucketed_index(keyed, hash_bucket(F.col("_k"), bits), ["_k", row_id], "_idx").drop("_k")
    return (idx.withColumn("epoch", ep.cast("int"))
            .withColumn("batch_id", F.floor(F.col("_idx") / F.lit(size)).cast("bigint"))
            .withColumn("batch_pos", (F.col("_idx") % F.lit(size)).cast("int")).drop("_idx"))


def pad_batches(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("epoch", "batch_id"),
                pad: int = PAD) -> DataFrame:
    """Pad each array column to the longest array of its batch, separately per
    column.  The window is partitioned by batch, so groups are batch-sized.  Columns of ``pack_ids``
    go through it packed and come out as padded arrays."""
    w = Window.partitionBy(*keys)
    out = df
    packed = [c for c in cols if isinstance(df.schema[c].dataType, StructType)]
    for c in cols:
        m = F.max(F.col(c)["n"] if c in packed else F.size(c)).over(w)
        if c in packed:
            out = out.withColumn(f"_width_{c}", m)
        else:
            out = out.withColumn(c, F.concat(F.col(c), F.array_repeat(F.lit(pad), (m - F.size(c)).cast("int"))))
    for c in packed:
        out = out.withColumn(c, unpack_ids(c, f"_width_{c}", pad)).drop(f"_width_{c}")
    return out
