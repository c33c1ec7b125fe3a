"""Aggregates, windows, checks, ranking and comparisons over filings and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import percent_change


def coverage(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Whole percent of rows in which each column is filled."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *(F.round(100 * F.count(c) / F.count("*"), 0).cast("long").alias(f"{c}_pct") for c in columns))


def frequent(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.agg((F.count("*") - F.count_distinct(key)).alias("duplicates"))


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return rows.join(parents.select(key).distinct(), key, "left_anti")


def length_percentiles(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.percentile(column, F.lit(0.5)).alias("p50"), F.percentile(column, F.lit(0.95)).alias("p95"), F.max(column).alias("longest"), F.count("*").alias("n"))


def depth_shares(chunks: DataFrame) -> DataFrame:
    """Path depth: chunks, characters and their share of all."""
    by = chunks.groupBy((F.regexp_count("path", F.lit(">")) + 1).alias("depth")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return by.withColumn("share", F.round(100 * F.col("chars") / F.sum("chars").over(Window.partitionBy(F.lit(1))), 2))


def first_per(rows: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def tied_best(rows: DataFrame, by: str, score: str) -> DataFrame:
    """How many rows share the best score, by key."""
    best = Window.partitionBy(by)
    return rows.withColumn("_best", F.max(score).over(best)).groupBy(by).agg(F.max(score).alias("best"), F.count_if(F.col(score) == F.col("_best")).alias("ties"))


def aligned_changes(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Chunks of a correction and its predecessor at the same place whose texts differ; pairs: old_doc, new_doc."""
    place = ["path", "document_sequence", "block_start", "block_end"]
    old = chunks.select(F.col("doc_id").alias("old_doc"), *place, F.col("text").alias("old_text"), F.col("chunk_id").alias("old_chunk"))
    new = chunks.select(F.col("doc_id").alias("new_doc"), *place, F.col("text").alias("new_text"), F.col("chunk_id").alias("new_chunk"))
    return pairs.join(old, "old_doc").join(new, ["new_doc", *place]).filter(F.trim("old_text") != F.trim("new_text"))


def differing_pairs(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The first value of each group in the order and the first after it that differs."""
    # where each value comes first; the second of these values is the first that differs
    firsts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(order).alias("_at"))
    two = first_per(firsts.withColumn("_k", F.col(value)), by, ["_at", "_k"], 2)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_at", "_k"))
    at = lambda i: F.max(F.when(F.col("_n") == i, F.col(value)))
    return two.withColumn("_n", place).groupBy(*by).agg(at(1).alias("first_value"), at(2).alias("other_value")).filter("other_value IS NOT NULL")


def stable_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows in the order of the key's SHA-256: the same ones every time."""
    return rows.orderBy(F.sha2(F.col(key), 256), key).limit(n)


def random_sample(rows: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n rows in a random order; other ones every time, unless a seed is given and the rows' partitions are the same."""
    return rows.orderBy(F.rand(seed)).limit(n)


def split_groups(groups: DataFrame, key: str, sizes: dict[str, int], by: str) -> DataFrame:
    """Disjoint splits by place in hash order within `by`: the first sizes go to the first split, and so on."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.sha2(F.col(key), 256), key))
    rows, low, split = groups.withColumn("_p", place), 0, None
    for name, n in sizes.items():
        here = (F.col("_p") > low) & (F.col("_p") <= low + n)
        split = F.when(here, name) if split is None else split.when(here, name)
        low += n
    return rows.withColumn("split", split).filter("split IS NOT NULL").drop("_p")


def recall_at(hits: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """Share of the cases in which an acceptable identity is among the first k; hits: case_id, identity, rank."""
    found = gold.join(hits.filter(F.col("rank") <= k).select("case_id", "identity"), ["case_id", "identity"], "left_semi").select("case_id").distinct().withColumn("hit", F.lit(1))
    return gold.select("case_id").distinct().join(found, "case_id", "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count("*").alias("cases"))


def runs_of_equal(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Adjacent equal values as one row with first, last and number."""
    w = Window.partitionBy(by).orderBy(order)
    rows = rows.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(order).over(w).isNull()).cast("int"))
    rows = rows.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(by, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def growth(rows: DataFrame, by: list[str], year: str, value: str) -> DataFrame:
    """Change against the year before, null without one."""
    w = Window.partitionBy(*by).orderBy(year)
    before = F.when(F.lag(year).over(w) == F.col(year) - 1, F.lag(value).over(w))
    return rows.withColumn("previous", before).withColumn("growth_pct", percent_change(F.col("previous"), F.col(value)))


def fourth_quarter(rows: DataFrame, key: list[str], month: str, value: str) -> DataFrame:
    """Annual less the nine months; both must share the key."""
    part = lambda m, n: rows.filter(F.col(month) == m).select(*key, F.col(value).alias(n))
    return part(12, "annual").join(part(9, "nine_months"), key).withColumn("q4", F.col("annual") - F.col("nine_months"))


def ratio_ranks(rows: DataFrame, by: str | None, numerator: str, denominator: str, tie: str) -> DataFrame:
    """Ranks by exact ratio: integer part, then the remainder's exact fraction at 38 digits; never by a rounded ratio.

    With whole or two-place operands of at most 18 digits, n / d differs from another ratio by at least 1 / (d1 d2),
    so quotient and remainder scaled to 19 places part any two ratios whose denominators have nine digits or fewer; beyond, cross products do (see calculate.rank_ratio).
    """
    n, d = F.col(numerator).cast("decimal(18,2)"), F.col(denominator).cast("decimal(18,2)")
    whole = F.floor(n / d)
    rest = (n - whole * d).cast("decimal(18,2)")
    fine = (rest.cast("decimal(20,2)") / d).cast("decimal(38,18)")
    w = Window.partitionBy(by if by else F.lit(1)).orderBy(whole.desc(), fine.desc(), tie)
    return rows.filter(d > 0).withColumn("rank", F.row_number().over(w))


def requested_totals(totals: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Every requested key with its total, or marked as absent; absence isn't zero."""
    return asked.join(totals, key, "left").withColumn("state", F.when(F.col("total").isNull(), "absent").otherwise("present"))


def grounded(answer: Column, evidence: Column) -> Column:
    """All numbers of the answer are numbers of the evidence."""
    return F.size(F.array_except(answer, evidence)) == 0


def exact_dedup(rows: DataFrame, source: str, text: str, order: list) -> DataFrame:
    return first_per(rows.withColumn("_sha", F.sha2(F.col(text), 256)), [source, "_sha"], order).drop("_sha")


def checks(named: dict[str, DataFrame]) -> DataFrame:
    """check, n: the number of offending rows of each."""
    return reduce(DataFrame.unionByName, (f.agg(F.lit(k).alias("check"), F.count("*").alias("n")) for k, f in named.items()))
