"""Document quality rules and verdicts per host, in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import hot_keys, skew_join, stored, text_key

#: Documents of fewer words fail.
MIN_WORDS = 50
#: Percent of words that may stand in repeated 3-word windows.
MAX_REPEAT_PERCENT = 50
#: A document also counts as a failure of its host with more symbols than this per 100 words ...
MAX_SYMBOL_PERCENT = 50
#: ... or with more repeated lines than this per 100 lines.
MAX_DUP_LINE_PERCENT = 30
#: A host whose failure rate exceeds STRICT_TIMES the mean of all rows, or STRICT if that is less, loses the documents that
#: fail any rule; one whose rate exceeds REJECT loses all.  Exceeds: with a chance of 95 % by its posterior (CERTAIN deviations).
STRICT_TIMES, STRICT, REJECT, CERTAIN = 1.5, 0.25, 0.75, 1.645
#: Bounds of the prior's strength (pseudo-documents).
PRIOR_BOUNDS = (2.0, 1000.0)


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None) -> DataFrame:
    """Per row: id_col, tkey, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    A NULL or empty text has zero counts; a row without a host keeps NULL there.  An empty table gives no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    host = F.lit(None).cast("string") if host is None else host
    # Each step is a projection that later ones use more than once, so that no lambda computes it again.
    d = docs.select(F.col(id_col), text.alias("__t"), text_key(text_col).alias("tkey"), host.cast("string").alias("host"))
    d = d.withColumn("__w", F.expr(r"array_remove(split(translate(__t, '\t\n\u000b\u000c\r', '     '), ' '), '')"))
    d = d.withColumn("__lines", F.expr(r"filter(split(__t, '\n'), x -> length(translate(x, ' \t\u000b\u000c\r', '')) > 0)"))
    d = d.select(
        id_col, "tkey", "host", F.size("__w").cast("long").alias("n_words"),
        F.expr(r"cast(length(translate(__t, ' \t\n\u000b\u000c\r', '')) as long)").alias("word_chars"),
        F.expr("cast(length(__t) - length(translate(__t, '#*$%&|<>', '')) as long)").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"))
    windows = """if(n_words < 3, cast(array() as array<bigint>),
        transform(sequence(0, greatest(size(__h) - 3, 0)), i -> xxhash64(get(__h, i), get(__h, i + 1), get(__h, i + 2))))"""
    d = d.withColumn("__g", F.expr(windows))
    # Sorted by window, equal ones are neighbours; only texts that repeat a window are sorted.
    d = d.withColumn("__s", F.expr("""if(size(array_distinct(__g)) = size(__g), cast(array() as array<struct<g:bigint,i:int>>),
        sort_array(transform(__g, (g, i) -> named_struct('g', g, 'i', i))))"""))
    d = d.withColumn("__p", F.expr("""sort_array(transform(filter(__s, (x, j) ->
        coalesce(get(__s, j - 1).g = x.g, false) or coalesce(get(__s, j + 1).g = x.g, false)), x -> x.i))"""))
    # A window adds the words that the next repeated window does not start before.
    d = d.withColumn("n_repeat_words", F.expr("aggregate(transform(__p, (p, j) -> least(3, coalesce(get(__p, j + 1) - p, 3))), 0L, (a, x) -> a + x)"))
    return d.drop("__h", "__g", "__s", "__p")


def host_verdicts(failures: DataFrame) -> DataFrame:
    """(host, n, rate, shrunk, sure, verdict) from rows (host, failed 0/1).

    The beta prior has the mean of all rows.  Its strength comes from how much the hosts' rates vary beyond what
    chance alone makes them vary: with Q the sum of n (rate - mean)^2 / (mean (1 - mean)) over H hosts of N rows, chance alone
    gives H - 1, and the rest is the correlation of rows of one host,
    (Q - (H - 1)) / (N - sum of n^2 / N - (H - 1)) = 1 / (1 + strength).  Large hosts so weigh more, and hosts that
    differ by chance only (or one host) give the strongest prior allowed.  The posterior of a host is
    beta(failures + a, passes + b); ``shrunk`` is its mean and ``sure`` the rate that it exceeds with a chance of 95 %
    (normal approximation); verdicts compare ``sure`` with the cuts."""
    per = failures.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("failed").alias("f"))
    per = per.withColumn("rate", F.col("f") / F.col("n"))
    total = per.agg(F.sum("n").cast("double").alias("all"), (F.sum("f") / F.sum("n")).alias("m"))
    spread = per.crossJoin(F.broadcast(total)).groupBy("all", "m").agg(  # one row
        F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n") * (F.col("rate") - F.col("m")) * (F.col("rate") - F.col("m"))).alias("d"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"))
    chance = F.col("m") * (1 - F.col("m"))
    rows = F.nullif(F.col("all") - F.col("n2") / F.col("all") - (F.col("hosts") - 1), F.lit(0.0))
    share = F.coalesce((F.col("d") / F.nullif(chance, F.lit(0.0)) - (F.col("hosts") - 1)) / rows, F.lit(0.0))
    low, high = (1 / (1 + x) for x in PRIOR_BOUNDS)
    spread = spread.select("m", (1 / F.greatest(F.lit(high), F.least(F.lit(low), share)) - 1).alias("strength"))
    per = per.crossJoin(F.broadcast(spread))  # one row
    per = per.withColumn("shrunk", (F.col("f") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength")))
    per = per.withColumn("sure", F.col("shrunk") - CERTAIN * F.sqrt(F.col("shrunk") * (1 - F.col("shrunk")) / (F.col("n") + F.col("strength") + 1)))
    strict = (F.col("sure") > F.least(F.lit(STRICT), STRICT_TIMES * F.col("m"))) & (F.col("sure") > 0)
    return per.select("host", "n", "rate", "shrunk", "sure",
                      F.when(F.col("sure") > REJECT, "reject").when(strict, "strict").otherwise("pass").alias("verdict"))


def quality_rules(docs: DataFrame, host: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, tkey, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, rule_failed, shrunk, verdict, kept.

    Counts cover whole texts and are written to the shared folder; hosts are counted
    with partial aggregation, and verdicts come back through a join with salted hot hosts.
    kept: not base_failed, and not (host verdict is reject), and not (strict and rule_failed).

    NULL text counts as empty (it fails for want of words); rows without a host get no host verdict.
    Repeated rows and NULL ids are judged like others.  An empty table gives no rows; other
    columns are not read."""
    host = F.col("source") if host is None else host
    d = rule_counts(docs, id_col, text_col, host)
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    d = d.withColumn("rule_failed", F.col("base_failed") | (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"))
                     | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines")))
    d = stored(d.drop("n_lines"), "rules")
    verdicts = host_verdicts(d.select("host", F.col("rule_failed").cast("int").alias("failed"))).select("host", "shrunk", "verdict")
    d = skew_join(d, verdicts, "host", [id_col, "tkey"], "left", hot_keys(d, "host"))
    verdict = F.coalesce("verdict", F.lit("pass"))
    kept = ~F.col("base_failed") & (verdict != "reject") & ~((verdict == "strict") & F.col("rule_failed"))
    return d.select(id_col, "tkey", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "rule_failed", "shrunk", verdict.alias("verdict"), kept.alias("kept"))
