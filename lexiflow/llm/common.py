"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.session import ensure_checkpoint_dir, text_batches  # noqa: F401 - text_batches is used from here

#: Whitespace of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")


def finite_vector(vec: Column) -> Column:
    """True for a vector that is not NULL and holds neither NULL nor non-finite entries."""
    return F.coalesce(F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"


#: Compression of intermediate files: small, at little time.
COMPACT = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, so a
    lost executor only costs the tasks it ran, and non-deterministic columns
    (row ids) are fixed from here on."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.options(**COMPACT).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def process_cache(name: str, make: Callable):
    """``make()`` once per Python worker process (functions are shipped by value, so
    module globals do not outlive a task; an entry of ``sys.modules`` does)."""
    holder = sys.modules.setdefault("_lexiflow_llm_cache", types.ModuleType("_lexiflow_llm_cache"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows kept from learning: crc32 of the id as text, modulo 3, is 1 (NULL id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


# -- hot keys ---------------------------------------------------------------

def hot_keys(rows: DataFrame, key: str, share: float = 0.005) -> list:
    """Keys that hold more than ``share`` of the rows: at most ``1 / share`` values, whatever the input."""
    n = rows.count()
    return [r[0] for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
            .where((F.col("__n") > max(8.0, n * share)) & F.col(key).isNotNull()).select(key).collect()]


def skew_join(rows: DataFrame, table: DataFrame, key: str | Sequence[str], salt: Sequence[str], how: str = "left",
              hot: list | None = None, salts: int = 64) -> DataFrame:
    """Join ``rows`` (any number per key) with ``table`` (one row per key); of several key columns the first tells hot keys.

    The rows of a hot key are dealt over ``salts`` partitions by the columns
    ``salt`` and only the few table rows of hot keys are repeated ``salts``
    times; all other keys join as usual.  Pass ``hot`` to reuse a list."""
    on = [key] if isinstance(key, str) else list(key)
    hot = hot_keys(rows, on[0]) if hot is None else hot
    if not hot:
        return rows.join(table, on, how)
    is_hot = F.coalesce(F.col(on[0]).isin(hot), F.lit(False))
    left = rows.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*salt), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    right = table.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


# -- constant-size filters over 64-bit keys ----------------------------------
# A filter is a bit table of 2**17 words of 64 bits; its size does not depend on the
# data.  A key that was put in always tests true; others may test true by
# collision, so a filter only ever decides which rows *skip* further work.

FILTER_WORDS = 1 << 17


def _word(key: Column) -> Column:
    return F.pmod(F.shiftright(key, 6), F.lit(FILTER_WORDS)).cast("int")


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """At most ``FILTER_WORDS`` rows (__word, __bits) that hold the keys (mixed 64-bit hashes)."""
    k = F.col(key)
    return (keys.where(k.isNotNull()).groupBy(_word(k).alias("__word"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{key}` & 63L as int))")).alias("__bits")))


def test_filter(rows: DataFrame, key: Column, filt: DataFrame, out: str) -> DataFrame:
    """Add boolean ``out``: false only if ``key`` is certainly not in the filter.
    The broadcast side has at most 2**17 rows of 12 bytes, a size fixed by the filter."""
    keyed = rows.withColumn("__k", key)
    joined = keyed.join(F.broadcast(filt.select(F.col("__word").alias("__w"), "__bits")), _word(F.col("__k")) == F.col("__w"), "left")
    bit = F.expr("shiftright(coalesce(__bits, 0L), cast(__k & 63L as int)) & 1L") == 1
    return joined.withColumn(out, F.coalesce(bit, F.lit(False))).drop("__k", "__w", "__bits")


test_filter.__test__ = False  # not a test case, whatever its name looks like to a collector


def bit_table(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """The keys' low ``bits`` bits as a packed bit table for Arrow tasks (``2**bits`` bits, fixed size)."""
    words = 1 << (bits - 6)
    rows = (keys.groupBy(F.pmod(F.shiftright(F.col(key), 6), F.lit(words)).cast("int").alias("w"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{key}` & 63L as int))")).alias("b")).toArrow())
    table = np.zeros(words, dtype=np.uint64)
    table[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return table


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys.view(np.uint64)
    return (table[(k >> np.uint64(6)) & np.uint64(len(table) - 1)] >> (k & np.uint64(63))) & np.uint64(1) == 1


# -- decisions back to rows ---------------------------------------------------

def text_key(text: str = "text") -> Column:
    """Tells apart rows that share a ``doc_id``."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def row_key(*cols: str | Column) -> Column:
    """Deals and filters rows; two rows may share it, so identity is always compared on the columns themselves."""
    return F.xxhash64(*cols)


def drop_rejected(docs: DataFrame, judged: DataFrame, by: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judged`` (id_col, tkey, the columns ``by``, kept; one verdict for rows equal in all but the last) keeps.

    Repeated rows stay repeated; NULLs in id, text or the columns ``by`` are values like others; an empty table gives no rows.
    Only rows that the constant-size filter cannot clear are shuffled with their texts."""
    keys = [id_col, "tkey", *by]
    bad = judged.where(~F.col("kept")).select(*[F.col(f"`{c}`").alias(f"__m{i}") for i, c in enumerate(keys)]).distinct()
    bad = stored(bad.withColumn("__rk", row_key(*[f"__m{i}" for i in range(len(keys))])), "rejected")
    own = [F.col(f"`{id_col}`"), text_key(text_col), *[F.col(f"`{c}`") for c in by]]
    rows = test_filter(docs.withColumn("__rid", row_key(*own)), F.col("__rid"), key_filter(bad, "__rk"), "__maybe")
    same = F.col("__rid") == F.col("__rk")
    for i, c in enumerate(own):
        same = same & c.eqNullSafe(F.col(f"__m{i}"))
    clear, met = rows.where(~F.col("__maybe")), rows.where("__maybe").join(bad, same, "left_anti")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return clear.select(*cols).unionByName(met.select(*cols))


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``decided`` (id_col, tkey, kept) keeps, with the columns of ``docs``.

    Of rows equal in id and text one stays.  Only rows that the constant-size
    filter cannot clear are shuffled with their texts; all others stay in their scan."""
    from pyspark.sql import Window

    marks = (decided.groupBy(F.col(id_col).alias("__id"), F.col("tkey").alias("__tkey"))
             .agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__n"))
             .where(~F.col("__kept") | (F.col("__n") > 1)))
    marks = stored(marks.withColumn("__rk", row_key("__id", "__tkey")), "marks")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn("__own", F.col(f"`{id_col}`")).withColumn("__text", text_key(f"`{text_col}`"))
    rows = test_filter(rows.withColumn("__rid", row_key("__own", "__text")), F.col("__rid"), key_filter(marks, "__rk"), "__maybe")
    same = (F.col("__rid") == F.col("__rk")) & F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__tkey"))
    met = rows.where("__maybe").join(marks, same, "left")
    unmarked = met.where(F.col("__rk").isNull()).select(*cols)
    # Rows equal in id and text (repeated rows): a window over just those.
    again = (met.where(F.col("__kept"))
             .withColumn("__first", F.row_number().over(Window.partitionBy("__own", "__text").orderBy("__rid")))
             .where("__first = 1").select(*cols))
    return rows.where("not __maybe").select(*cols).unionByName(unmarked).unionByName(again)
