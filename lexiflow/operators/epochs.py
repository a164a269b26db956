"""Shuffled epochs without a sort: a keyed bijection on the row numbers 0 .. n - 1.

A row's slot in an epoch is a formula of its number, and a slot's row the inverse formula,
so one index pass serves every epoch.  The bijection is a Feistel network on pairs
(left, right) with left < a, right < b, a * b >= n; values of n and above walk on until
they fall below n."""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.functions._util import col_of, let
from lexiflow.operators.index import with_row_index

# ---- fixed values of the mixing function -------------------------------------
MASK, FACTOR, SHIFT = 0xFFFFFFFF, 0x45D9F3B, 16
ROUNDS = 6
#: Steps of a walk.  Up to this many values lie above n, or all but b ** -WALK of the walks end sooner.
WALK = 32
# ------------------------------------------------------------------------------


def _mix(x: Column) -> Column:
    """32 mixed bits of a whole number; products stay below 2**60."""
    def turn(v):
        return ((v.bitwiseXOR(F.shiftright(v, SHIFT))) * F.lit(FACTOR).cast("bigint")).bitwiseAND(F.lit(MASK).cast("bigint"))
    low = x.cast("bigint").bitwiseAND(F.lit(MASK).cast("bigint"))
    return let(low, lambda v: let(turn(v), lambda w: let(turn(w), lambda z: z.bitwiseXOR(F.shiftright(z, SHIFT)))))


@dataclass(frozen=True)
class Permutation:
    """The shuffles of ``n`` rows under a seed, one per epoch."""

    n: int
    seed: int = 1234

    @property
    def sides(self) -> tuple[int, int]:
        a = isqrt(max(self.n, 1) - 1) + 1
        return a, -(-max(self.n, 1) // a)

    def _network(self, x: Column, epoch: Column, inverse: bool) -> Column:
        a, b = self.sides
        sign = -1 if inverse else 1

        def step(acc, r):
            key = _mix(F.lit(self.seed).cast("bigint") * F.lit(1_000_003).cast("bigint") + epoch * F.lit(64) + r)
            left = F.struct(F.pmod(acc["l"] + sign * (_mix(acc["r"].bitwiseXOR(key)) % a), F.lit(a).cast("bigint")).alias("l"), acc["r"].alias("r"))
            right = F.struct(acc["l"].alias("l"), F.pmod(acc["r"] + sign * (_mix(acc["l"].bitwiseXOR(key)) % b), F.lit(b).cast("bigint")).alias("r"))
            return F.when(r % 2 == 0, left).otherwise(right)

        start = F.struct(F.call_function("div", x, F.lit(b).cast("bigint")).alias("l"), (x % b).cast("bigint").alias("r"))
        turns = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
        turns = F.array(*[F.lit(r).cast("bigint") for r in turns])
        return F.aggregate(turns, start, step, lambda acc: acc["l"] * F.lit(b).cast("bigint") + acc["r"])

    def _walk(self, x: Column, epoch: Column, inverse: bool) -> Column:
        n, ep = F.lit(self.n).cast("bigint"), epoch.cast("bigint")
        first = self._network(x.cast("bigint"), ep, inverse)
        done = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda v, _: F.when(v < n, v).otherwise(self._network(v, ep, inverse)))
        return let(done, lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("a walk did not end: choose another seed")).cast("bigint")))

    def slot(self, idx, epoch) -> Column:
        """Place of row number ``idx`` in ``epoch``."""
        return self._walk(col_of(idx), epoch if isinstance(epoch, Column) else F.lit(epoch), False)

    def row(self, slot, epoch) -> Column:
        """Number of the row that stands at ``slot`` in ``epoch``."""
        return self._walk(col_of(slot), epoch if isinstance(epoch, Column) else F.lit(epoch), True)


def batch_columns(indexed: DataFrame, perm: Permutation, size: int, epochs, idx: str = "idx") -> DataFrame:
    """Rows of every epoch with epoch, batch_id and batch_pos, from rows with a dense number: no shuffle, no sort."""
    rows = indexed.withColumn("epoch", F.explode(F.array(*[F.lit(int(e)) for e in epochs])))
    rows = rows.withColumn("_slot", perm.slot(idx, F.col("epoch")))
    return (rows.withColumn("batch_id", F.expr(f"_slot div {size}")).withColumn("batch_pos", (F.col("_slot") % size).cast("int")).drop("_slot"))


def epoch_batches(df: DataFrame, order, size: int, epochs, seed: int = 1234) -> DataFrame:
    """Batches of every epoch after one index pass over ``order`` (columns that tell all rows apart)."""
    indexed = with_row_index(df, order, "_idx", with_total=True).checkpoint()
    n = (indexed.select("_total").first() or [0])[0]
    return batch_columns(indexed.drop("_total"), Permutation(n, seed), size, epochs, "_idx").drop("_idx")


def batch_rows(indexed: DataFrame, perm: Permutation, size: int, epoch: int, batch: int, idx: str = "idx") -> DataFrame:
    """The rows of one batch with their batch_pos, by the inverse formula: ``size`` numbers and a join."""
    slots = indexed.sparkSession.range(batch * size, max(batch * size, min(perm.n, (batch + 1) * size))).withColumnRenamed("id", "_slot")
    wanted = slots.select(perm.row("_slot", epoch).alias(idx), (F.col("_slot") % size).cast("int").alias("batch_pos"))
    return indexed.join(F.broadcast(wanted), idx)  # at most ``size`` rows
