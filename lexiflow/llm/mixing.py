"""Mixing sources to target weights with Pfair windows and earliest deadline first.

Rows pass through DataFrame and SQL functions only.  The driver deals a bounded number of
blocks to slots; the plan goes to the shared folder and documents find their slot by a join on
(lane, block), a lane being a source or a pool of small ones."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from fractions import Fraction
from heapq import heappop, heappush
from itertools import islice
from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import COMPACT, scratch_path, skew_join, stored, text_key

#: Slots that the driver holds at a time.
CHUNK = 1 << 20


def deal(blocks: Mapping, weights: Mapping, period: int = 256) -> Iterator[tuple]:
    """(source, block, slot, release, deadline, stretch) of every block, by slot.

    In the ideal mix every source that still has blocks flows at weight / (weights of all such
    sources); after t slots it has given f(t) blocks.  Block k is released at floor(f^-1(k)) and due at
    ceil(f^-1(k + 1)).  Each slot goes to the released block with the earliest deadline (ties: source
    order).  The flows sum to one, so no window is missed and every source is less than one
    block from its flow after every slot, also across the ends of sources.

    With integer weights w (exact multiples of the given floats) and v the amount per weight that
    has flowed, t(v) = (blocks of the sources that have ended) + v * (weights of the others)."""
    names = sorted((s for s, n in blocks.items() if n), key=lambda s: (s is not None, s))
    exact = [Fraction(weights[s]) for s in names]
    unit = lcm(*[x.denominator for x in exact])
    w, n = [int(x * unit) for x in exact], [blocks[s] for s in names]
    ends = sorted(range(len(names)), key=lambda i: Fraction(n[i], w[i]))
    ended, flowing = [0], [sum(w)]
    for i in ends:
        ended.append(ended[-1] + n[i])
        flowing.append(flowing[-1] - w[i])
    over = [ended[j] + flowing[j] * n[i] // w[i] for j, i in enumerate(ends)]  # whole slots until each end
    at = [0] * len(names)  # sources that end before this source's next block is due

    def window(i, k):
        """Release and deadline of block k of source i; k only grows."""
        j = at[i]
        release = ended[j] + flowing[j] * k // w[i]
        while n[ends[j]] * w[i] < (k + 1) * w[ends[j]]:
            j += 1
        at[i] = j
        return release, ended[j] - (-flowing[j] * (k + 1) // w[i])

    waiting, ready, stretch = [], [], 0
    for i in range(len(names)):
        release, due = window(i, 0)
        heappush(waiting, (release, due, i, 0))
    for slot in range(sum(n)):
        while waiting and waiting[0][0] <= slot:
            release, due, i, k = heappop(waiting)
            heappush(ready, (due, i, k, release))
        due, i, k, release = heappop(ready)
        if slot % period == 0:
            while stretch < len(over) and over[stretch] < slot + period:
                stretch += 1
        yield names[i], k, slot, release, due, stretch
        if k + 1 < n[i]:
            release, due = window(i, k + 1)
            heappush(waiting, (release, due, i, k + 1))


def _schedule(spark, dealt: Iterator[tuple]) -> DataFrame:
    """What ``deal`` gives as a table in the shared folder, one row per block."""
    import pyarrow as pa

    kinds = {"source": pa.string(), **dict.fromkeys(("block", "slot", "release", "deadline"), pa.int64()), "stretch": pa.int32()}
    path = scratch_path(spark, "slots")
    while chunk := list(islice(dealt, CHUNK)):
        table = pa.table([pa.array(c, t) for c, t in zip(zip(*chunk), kinds.values())], names=list(kinds))
        spark.createDataFrame(table).write.mode("append").options(**COMPACT).parquet(path)
    return spark.read.schema("source string, block long, slot long, release long, deadline long, stretch int").parquet(path)


#: Tables of at most so many rows, one per source or lane, are broadcast.
BROADCAST_SOURCES, BROADCAST_LANES = 4096, 1 << 18
#: Weight classes per doubling of the weight, of the pools of small sources.
POOLS_PER_DOUBLING = 8


def _lanes(per_source: DataFrame, weights: Mapping | None, alpha: float, block_chars: int, own: bool) -> DataFrame:
    """Adds lane and weight to (key, source, n, chars): a source is a lane of its own if ``own`` or if it has more than a
    block; smaller ones share a lane with those of like weight."""
    if weights is None:
        rows = per_source.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(alpha)))
    else:
        given = per_source.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "__s string, __w double")
        rows = per_source.join(given, F.col("source").eqNullSafe(F.col("__s")), "left")
        rows = rows.withColumn("weight", F.coalesce("__w", F.lit(float(min(weights.values()))))).drop("__s", "__w")
    pool = F.concat(F.lit("~"), F.floor(F.log2("weight") * POOLS_PER_DOUBLING).cast("string"))
    return rows.withColumn("lane", F.col("key") if own else F.when(F.col("chars") > block_chars, F.col("key")).otherwise(pool))


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, alpha: float = 0.5, block_chars: int = 65_536,
                period: int = 256, max_sources: int | None = None, max_blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """One row per input row: id_col, tkey, source, block, start, slot, release, deadline, stretch.

    Documents of a source are put in a fixed pseudo-random order (hash of the id) and cut
    into blocks of ``block_chars`` characters (a document belongs to the block it starts in).
    Blocks get Pfair windows from the source's target weight and an earliest-deadline-first slot (see ``deal``);
    reading by (slot, start) gives the mix.  ``weights`` maps sources to positive numbers; without them
    a source weighs its characters to the power ``alpha``.  Weights are not rounded.  Sources without a weight
    get the smallest one.  When a source runs out, the others go on in the same proportions: every row is placed.
    ``stretch`` is the number of sources that run out before the slot's ``period`` slots are over.

    One rule holds at every size: blocks of ``block_chars`` characters, each source dealt on its own.  The driver deals
    blocks, not documents, ``CHUNK`` at a time; its memory grows with the sources, its time with the blocks.
    A caller may bound both.  Of inputs that have more than ``max_blocks`` blocks, blocks are then as much larger.  Of more
    than ``max_sources`` sources, those of at most one block are dealt together with others of like weight (block,
    release, deadline and stretch then count the blocks of such a lane; no placing of a single block is a block
    off its source's flow).  So every source is less than one block off.

    Running sums take two levels: buckets of about sqrt(rows) rows of one lane (at least 512), then
    bucket totals; no task sees a whole source.  Tables of one row per source or lane are broadcast while they are
    proven small and joined by shuffle beyond, with the same rows.

    NULL text counts as empty (one character, so that each row has a place); NULL source is a source of
    its own; NULL and repeated ids are placed like others (rows equal in all of these are
    interchangeable).  An empty table gives no rows; other columns are not read."""
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    rows = docs.select(F.col(id_col), text_key(text_col).alias("tkey"), F.col(source_col).cast("string").alias("source"),
                       (F.length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("long").alias("__size"),
                       F.xxhash64(F.col(id_col), F.lit(0)).alias("__h"))
    rows = stored(rows.withColumn("key", key), "mix")
    per_source = stored(rows.groupBy("key", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("chars")), "sources")
    n_sources, n, chars = per_source.agg(F.count(F.lit(1)), F.sum("n"), F.sum("chars")).first()
    out_cols = [id_col, "tkey", "source", "block", "start", "slot", "release", "deadline", "stretch"]
    if not n_sources:
        empty = rows.select(id_col, "tkey", "source", *[F.lit(0).cast("long").alias(c) for c in ("block", "start", "slot", "release", "deadline")],
                            F.lit(0).alias("stretch"))
        return empty.select(out_cols)
    if max_blocks is not None:
        block_chars = max(block_chars, -(-chars // max_blocks))
    lanes = stored(_lanes(per_source, weights, alpha, block_chars, max_sources is None or n_sources <= max_sources), "lanes")
    stats = lanes.groupBy("lane").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("weight").alias("weight")).collect()
    plan = _schedule(spark, deal({r["lane"]: -(-r["chars"] // block_chars) for r in stats}, {r["lane"]: r["weight"] for r in stats}, period))

    per_bucket = max(512, int(n ** 0.5))
    counts = spark.createDataFrame([(r["lane"], -(-r["n"] // per_bucket)) for r in stats], "lane string, __buckets int")
    rows = (rows.join(F.broadcast(lanes.select("key", "lane")), "key") if n_sources <= BROADCAST_SOURCES
            else skew_join(rows, lanes.select("key", "lane"), "key", ["__h", "tkey"], "inner")).drop("key")
    rows = rows.join(F.broadcast(counts), "lane") if len(stats) <= BROADCAST_LANES else skew_join(rows, counts, "lane", ["__h", "tkey"], "inner")
    rows = rows.withColumn("__bucket", F.pmod(F.shiftrightunsigned("__h", 20), F.col("__buckets").cast("long")).cast("int"))
    totals = rows.groupBy("lane", "__bucket").agg(F.sum("__size").alias("__sum"))
    before = Window.partitionBy("lane").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("lane", "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("lane", "__bucket").orderBy("__h", id_col, "tkey").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    rows = rows.join(totals, ["lane", "__bucket"]).withColumn("start", F.col("__before") + F.col("__in"))
    rows = rows.withColumn("block", F.expr(f"start div {block_chars}"))
    return rows.join(plan.withColumnRenamed("source", "lane"), ["lane", "block"]).select(out_cols)


def in_mixed_order(docs: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` sorted over all partitions by their place in the mix, columns unchanged.

    Rows equal in id and text share the first place of any of them; NULL ids and texts are matched like others;
    rows that ``placed`` lacks come first; an empty table gives no rows."""
    at = placed.groupBy(F.col(id_col).alias("__id"), F.col("tkey").alias("__t")).agg(F.min(F.struct("slot", "start")).alias("__at"))
    rows = docs.withColumn("__key", text_key(text_col))
    rows = rows.join(at, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__t")), "left")
    return rows.orderBy("__at.slot", "__at.start", "__key").select(*[F.col(f"`{c}`") for c in docs.columns])
