"""Evaluation: ranking metrics, percentiles, pass rates, quality scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


PARTS = 64  # ranges a group is cut into for percentiles
BROADCAST_GROUPS = 10_000


def relevant(path: Column, symbol: Column, files: Column, symbols: Column) -> Column:
    """Is a hit relevant? An expected file stands in its path (with / for \\), or its symbol is expected."""
    clean = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    by_file = F.exists(F.coalesce(files, F.array().cast("array<string>")), lambda f: (f != "") & F.contains(clean, F.replace(f, F.lit("\\"), F.lit("/"))))
    return by_file | F.coalesce(F.array_contains(symbols, symbol), F.lit(False))


def ranking(hits: DataFrame, case: str = "query_id", at: tuple[int, ...] = (1, 3, 5, 10), gain_at: tuple[int, ...] = (5, 10)) -> DataFrame:
    """hits(case, rank, rel) -> one row a case: mrr, hit_k, ndcg_k. The ideal of nDCG are the relevant hits found in the first k."""
    r = F.col("rel")
    aggs = [F.coalesce(1 / F.min(F.when(r, F.col("rank"))), F.lit(0.0)).alias("mrr")]
    aggs += [F.coalesce(F.max((r & (F.col("rank") <= k)).cast("int")), F.lit(0)).cast("double").alias(f"hit_{k}") for k in at]
    for k in gain_at:
        aggs.append(F.coalesce(F.sum(F.when(r & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias(f"_g{k}"))
        aggs.append(F.count_if(r & (F.col("rank") <= k)).cast("int").alias(f"_n{k}"))
    one = hits.groupBy(case).agg(*aggs)
    for k in gain_at:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col(f"_n{k}"), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
        one = one.withColumn(f"ndcg_{k}", F.when(F.col(f"_n{k}") == 0, 0.0).otherwise(F.col(f"_g{k}") / ideal)).drop(f"_g{k}", f"_n{k}")
    return one


def mean_over_cases(scores: DataFrame, cases: DataFrame, case: str = "query_id") -> DataFrame:
    """Means over all cases; a case without scores counts as zero, no case at all gives zeros."""
    names = [c for c in scores.columns if c != case]
    full = cases.select(case).distinct().join(scores, case, "left")
    return full.agg(F.count("*").alias("cases"), *[(F.coalesce(F.sum(n), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))).alias(n) for n in names])


def mean_positive(c: Column) -> Column:
    """Mean of the values above zero, 0 if there are none."""
    return F.coalesce(F.avg(F.when(c > 0, c)), F.lit(0.0))


def percentile(df: DataFrame, by: list[str], value: str, *ps: int) -> DataFrame:
    """Nearest-rank percentiles sorted[min(floor(n p / 100), n - 1)], without interpolation.

    The values are counted first, so equal ones move as one row a task. Each group is then cut into `PARTS` ranges of about equally
    many distinct values (at approximate quantiles; where they lie doesn't matter for the result), ranks are counted within a
    range and set off by the sizes of the ranges below, so a group with a third of all rows is the work of many tasks.
    """
    from pyspark.sql import Window as W

    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    at = counts.groupBy(*by).agg(F.percentile_approx(value, [k / PARTS for k in range(1, PARTS)], 1000).alias("_q"))
    if at.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        at = F.broadcast(at)  # a row of PARTS numbers a group, groups counted
    cut = counts.join(at, by).withColumn("_p", F.size(F.filter("_q", lambda q: q < F.col(value)))).drop("_q")
    w = W.partitionBy(*by)
    sizes = cut.groupBy(*by, "_p").agg(F.sum("_c").alias("_s"))
    sizes = sizes.select(*by, "_p", (F.sum("_s").over(w.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)) - F.col("_s")).alias("_off"), F.sum("_s").over(w).alias("_n"))
    run = cut.withColumn("_to", F.sum("_c").over(W.partitionBy(*by, "_p").orderBy(value).rowsBetween(W.unboundedPreceding, 0))).join(sizes, [*by, "_p"])
    pick = []
    for p in ps:
        rank = F.least(F.floor(F.col("_n") * p / 100), F.col("_n") - 1) + 1
        pick.append(F.min(F.when(F.col("_off") + F.col("_to") >= rank, F.col(value))).alias(f"p{p}"))
    return run.groupBy(*by).agg(*pick)


def profile(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))


def quality(scores: DataFrame, doc: str, criteria: list[str], least_overall: float = 3.5, least_each: float = 2) -> DataFrame:
    """Overall = mean of the criteria, rounded to 2 places; passed if it is high enough and no criterion too low."""
    total = sum((F.col(c) for c in criteria[1:]), F.col(criteria[0])) / len(criteria)
    low = F.least(*[F.col(c) for c in criteria]) if len(criteria) > 1 else F.col(criteria[0])
    return scores.select(doc, F.round(total, 2).alias("overall"), ((total >= least_overall) & (low >= least_each)).alias("passed"))


def pass_rate(df: DataFrame, passed: str) -> DataFrame:
    return df.agg(F.coalesce(F.avg(F.col(passed).cast("double")), F.lit(0.0)).alias("pass_rate"))


def thresholds(means: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(metric, value, threshold, passed) for each limit a column of the one-row means must reach."""
    return means.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("threshold")) for k, v in limits.items()])).alias("x")).select(
        "x.*", (F.col("x.value") >= F.col("x.threshold")).alias("passed")
    )


def review_passed(scores: Column, overall: Column, flag: Column) -> Column:
    """Explicit flag, else all criteria at least 3 and overall at least 4."""
    return F.coalesce(flag, F.forall(F.map_values(scores), lambda v: v >= 3) & (overall >= 4), F.lit(False))


def assertions(answers: DataFrame) -> DataFrame:
    """answers(query_id, answer, must_contain, must_not_contain, confidence, min_confidence) -> passed, without regard to case."""
    low = F.lower(F.coalesce("answer", F.lit("")))
    has = F.forall(F.coalesce("must_contain", F.array().cast("array<string>")), lambda s: F.contains(low, F.lower(s)))
    hasnt = ~F.exists(F.coalesce("must_not_contain", F.array().cast("array<string>")), lambda s: F.contains(low, F.lower(s)))
    return answers.select("query_id", (has & hasnt & (F.coalesce("confidence", F.lit(0.0)) >= F.coalesce("min_confidence", F.lit(0.0)))).alias("passed"))


def matched(hits: DataFrame, case: str, value: str) -> DataFrame:
    """hits(case, rank, rel, value) -> (case, matched): the distinct filled values of relevant hits in the order they were first seen."""
    first = hits.filter(F.col("rel") & (F.coalesce(F.col(value), F.lit("")) != "")).groupBy(case, value).agg(F.min("rank").alias("_r"))
    return first.groupBy(case).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda x: x[value]).alias("matched"))
