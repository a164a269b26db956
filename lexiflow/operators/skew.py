"""Many-to-many inner join in which a few keys hold a large share of the rows.

Heavy keys are found in a sample of both sides.  The rows of such a key are dealt over a
grid: each left row goes to one line and every column of it, each right row to one column and
every line, so every pair meets in exactly one cell.  All other keys have a grid of one cell."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a side that heavy keys are sought in, about.
SAMPLE_ROWS = 1_000_000
#: Lines, and columns, of a key's grid at most; more rows than these hold make cells larger.
MAX_SIDE = 512


def heavy_keys(df: DataFrame, on: Sequence[str], share: float, sample_rows: int = SAMPLE_ROWS) -> dict[tuple, float]:
    """{key: share of all rows} of the keys that hold more than ``share`` of a sample: at most 1 / ``share`` keys.
    A key that the sample misses or overrates changes the layout of the join and not its rows."""
    rows = df.select(*on).where(F.forall(F.array(*[F.col(c).isNotNull() for c in on]), lambda x: x))
    n = rows.count()
    if n > sample_rows:
        rows = rows.sample(sample_rows / n, 7)
    rows = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    seen = min(n, sample_rows)
    found = rows.where(F.col("_n") > max(2.0, share * seen)).collect()
    return {tuple(r[c] for c in on): r["_n"] / seen for r in found}


def join_skewed(left: DataFrame, right: DataFrame, on: str | Sequence[str], share: float = 0.01, tasks: int | None = None,
                left_salt: Sequence[str] | None = None, right_salt: Sequence[str] | None = None) -> DataFrame:
    """``left.join(right, on)``, heavy keys spread over about ``tasks`` (shuffle partitions) times their share.

    Lines and columns are chosen by a hash of the columns ``left_salt`` and ``right_salt`` (all columns): give ones that
    differ between the rows of a key.  NULL keys match nothing."""
    on = [on] if isinstance(on, str) else list(on)
    spark = left.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines, columns = (heavy_keys(side, on, min(share, 1 / tasks)) for side in (left, right))
    heavy = {k: (min(MAX_SIDE, ceil(2 * tasks * lines.get(k, 0)) or 1), min(MAX_SIDE, ceil(2 * tasks * columns.get(k, 0)) or 1)) for k in lines.keys() | columns.keys()}
    if not heavy:
        return left.join(right, on)
    schema = T.StructType([*[T.StructField(c, left.schema[c].dataType) for c in on], T.StructField("_lines", T.IntegerType()), T.StructField("_columns", T.IntegerType())])
    grid = F.broadcast(spark.createDataFrame([(*k, a, b) for k, (a, b) in heavy.items()], schema))  # at most 2 / share rows

    def dealt(side: DataFrame, salt, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(*(salt or side.columns)), F.coalesce(own, F.lit(1))).cast("int")
        rows = side.join(grid, on, "left").withColumn("_own", mine)
        rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        line, column = ("_own", "_other") if own == "_lines" else ("_other", "_own")
        return rows.withColumn("_cell", F.col(line) * F.coalesce("_columns", F.lit(1)) + F.col(column)).drop("_lines", "_columns", "_own", "_other")

    return dealt(left, left_salt, "_lines", "_columns").join(dealt(right, right_salt, "_columns", "_lines"), [*on, "_cell"]).drop("_cell")
