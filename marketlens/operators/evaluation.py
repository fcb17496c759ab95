"""Ranking, multi-label, agreement and latency metrics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import scalar as S


def ranking_metrics(results: DataFrame, relevant: DataFrame, k: int, counts: DataFrame | None = None) -> DataFrame:
    """Per query: precision, recall, hit, reciprocal rank and nDCG at k. ``results``: query_id, doc_id, rank.
    ``relevant``: query_id, doc_id. With ``counts`` (query_id, n_relevant), ``relevant`` need hold found pairs only."""
    rel = relevant.select("query_id", "doc_id", F.lit(1).alias("rel"))
    n = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant")) if counts is None else counts
    hits = results.join(rel, ["query_id", "doc_id"], "left")
    top = F.col("rank") <= k
    per = hits.groupBy("query_id").agg(
        F.count_if(top & F.col("rel").isNotNull()).alias("hits"),
        F.max(F.when(F.col("rel").isNotNull(), 1.0 / F.col("rank")).otherwise(0.0)).alias("reciprocal_rank"),
        F.sum(F.when(top & F.col("rel").isNotNull(), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    out = per.join(n, "query_id", "left").fillna(0, ["n_relevant"])
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n_relevant"), F.lit(k))).cast("int")), lambda r: 1.0 / F.log2(r + 1.0)), F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "query_id", (F.col("hits") / k).alias("precision"), F.coalesce(S.rate(F.col("hits"), F.col("n_relevant")), F.lit(0.0)).alias("recall"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"), "reciprocal_rank", F.when(F.col("n_relevant") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
    )


def multilabel_counts(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, support) from (id, label) rows."""
    e, p = expected.select("id", "label", F.lit(1).alias("e")).distinct(), predicted.select("id", "label", F.lit(1).alias("p")).distinct()
    return e.join(p, ["id", "label"], "full_outer").groupBy("label").agg(
        F.count_if(F.col("e").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"), F.count("e").alias("support")
    )


def multilabel_metrics(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per-label precision, recall and F1, with a row ``macro`` (their means over labels) and one ``micro`` (from summed
    counts)."""
    c = multilabel_counts(expected, predicted)
    micro = c.agg(F.lit("micro").alias("label"), *[F.sum(x).cast("long").alias(x) for x in ("tp", "fp", "fn", "support")])
    each = c.unionByName(micro)
    p, r = F.coalesce(S.rate(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(S.rate(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    rows = each.select("label", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), "support")
    macro = rows.where("label <> 'micro'").agg(F.lit("macro").alias("label"), *[F.coalesce(F.avg(x), F.lit(0.0)).alias(x) for x in ("precision", "recall", "f1")], F.sum("support").cast("long").alias("support"))
    return rows.unionByName(macro)


def macro_average(per_query: DataFrame, *by: str) -> DataFrame:
    """Means of all numeric columns but the id, over queries; missing values don't count."""
    names = [c for c, t in per_query.dtypes if t in ("double", "float", "int", "bigint") and c not in ("query_id", *by)]
    return per_query.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), *[F.avg(c).alias(c) for c in names])


def exact_match(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: share of ids whose label sets are equal."""
    sets = lambda d, n: d.groupBy("id").agg(S.sorted_set(F.col("label")).alias(n))
    both = sets(expected, "e").join(sets(predicted, "p"), "id", "full_outer")
    return both.agg(F.avg(F.when(F.col("e").eqNullSafe(F.col("p")), 1.0).otherwise(0.0)).alias("exact_match"))


def kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Agreement and Cohen's kappa of two 0/1 columns; kappa 1 where chance agreement is 1."""
    n = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"), F.sum(a).alias("sa"), F.sum(b).alias("sb"))
    n = n.select("n", *[F.col(c).cast("double") for c in ("same", "sa", "sb")])
    agree = F.col("same") / F.col("n")
    chance = (F.col("sa") * F.col("sb") + (F.col("n") - F.col("sa")) * (F.col("n") - F.col("sb"))) / (F.col("n") * F.col("n"))
    return n.select(F.col("n").alias("pairs"), agree.alias("agreement"), F.when(chance == 1, 1.0).otherwise((agree - chance) / (1 - chance)).alias("kappa"))


def latency_summary(rows: DataFrame, by: str, value: str, fraction: float = 0.95) -> DataFrame:
    """n, mean, median and nearest-rank percentile (position round((n - 1) * fraction), half to even).

    Equal values are counted before the shuffle, and how many of a group are below a value is summed over ranges of about
    as many distinct values, so neither a group's rows nor its values meet in one task.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    total = counted.groupBy(by).agg(F.sum("c").alias("n"), S.exact_mean(F.sum(F.col("v").cast("decimal(18,2)") * F.col("c")).cast("decimal(18,2)"), F.sum("c")).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))
    part = F.when(F.col("most") > F.col("least"), F.floor((F.col("v") - F.col("least")) / (F.col("most") - F.col("least")) * 1000)).otherwise(0)
    placed = counted.join(total, by).withColumn("part", part.cast("int"))
    parts = placed.groupBy(by, "part").agg(F.sum("c").alias("c"))
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # 1001 rows a group
    parts = parts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).select(by, "part", "before")
    inside = Window.partitionBy(by, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(parts, [by, "part"]).withColumn("upto", F.col("before") + F.sum("c").over(inside))
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("v")))  # noqa: E731  the k-th smallest
    n = F.col("n")
    out = ranked.groupBy(by, "n", "mean").agg(at(F.floor((n + 1) / 2)).alias("low"), at(F.floor(n / 2) + 1).alias("high"), at(F.bround((n - 1) * fraction, 0) + 1).alias("p95"))
    return out.select(by, "n", "mean", ((F.col("low") + F.col("high")) / 2).alias("median"), "p95")


def precision_bounds(results: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """Known hits over k, and with all unjudged counted as hits; share judged. ``judged``: query_id, doc_id, rel."""
    top = results.where(F.col("rank") <= k).join(judged, ["query_id", "doc_id"], "left")
    return top.groupBy("query_id").agg((F.sum(F.coalesce("rel", F.lit(0))) / k).alias("lower"), (F.sum(F.coalesce("rel", F.lit(1))) / k).alias("upper"), S.rate(F.count("rel"), F.count(F.lit(1))).alias("coverage"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, x, y): the scores of two (query_id, score) tables, of the queries of both."""
    return a.select("query_id", F.col("score").alias("x")).join(b.select("query_id", F.col("score").alias("y")), "query_id")


def paired_outcomes(pairs: DataFrame) -> DataFrame:
    """Wins, ties and losses of the first of two scores (``paired``), and the mean difference."""
    d = pairs.withColumn("d", F.col("x") - F.col("y"))
    return d.agg(F.count_if(F.expr("d > 0")).alias("wins"), F.count_if(F.expr("d = 0")).alias("ties"), F.count_if(F.expr("d < 0")).alias("losses"), F.avg("d").alias("mean_difference"))


#: Draws that one hash of (seed, group of draws, query) gives weights for.
LANES = 4


def poisson_limits(most: int = 12) -> list[int]:
    """32-bit limits of a query's weight in a draw: k where the hash reaches the first k of them. Weights are then Poisson
    distributed with mean 1, as multinomial ones nearly are."""
    limits, term, total = [], math.exp(-1), 0.0
    for k in range(most):
        total += term
        limits.append(int(total * 2**32))
        term /= k + 1
    return limits


def bootstrap(scores: DataFrame, *by: str, draws: int = 10_000, seed: int = 42, query_id: str = "query_id", score: str = "score") -> DataFrame:
    """(by, queries, mean, low, high): the mean of the scores and its 95 % interval to four decimals.

    Each draw weighs every query by a hash of (seed, draw, query), so a draw needs no order, no random state and no list:
    executors sum weights and weighted scores for all draws before the shuffle, and ``draws`` means are all that meets in one
    task, for each group. The work is queries x draws, spread over the queries' partitions. Null scores don't count; draws
    in which nothing is drawn are left out; a group without scores has an interval of 0 to 0, and no scores give one such row
    where nothing is grouped. Scores are taken to nine decimals and summed exactly.
    """
    rows = scores.select(*by, F.coalesce(F.col(query_id).cast("string"), F.lit("")).alias("_q"), F.col(score).cast("decimal(18,9)").alias("_v"))
    groups = F.explode(F.sequence(F.lit(0), F.lit(-(-draws // LANES) - 1)))
    hashed = rows.withColumn("_g", groups).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_g").cast("string"), "_q").cast("binary")))
    weight = {}
    for k in range(LANES):
        u = F.conv(F.substring("_h", 1 + 8 * k, 8), 16, 10).cast("long")
        weight[f"_w{k}"] = F.when(F.col("_v").isNotNull(), sum((F.when(u >= limit, 1).otherwise(0) for limit in poisson_limits()), F.lit(0)))
    sums = hashed.select(*by, "_g", "_v", *[w.alias(n) for n, w in weight.items()]).groupBy(*by, "_g").agg(
        F.count("_v").alias("_n"), F.sum("_v").cast("decimal(38,9)").alias("_t"),
        *[F.sum(F.col("_v") * F.col(n)).cast("decimal(38,9)").alias(n.replace("w", "s")) for n in weight], *[F.sum(n).alias(n) for n in weight],
    )
    mean = lambda k: F.when(F.col("_g") * LANES + k < draws, F.try_divide(F.col(f"_s{k}").cast("double"), F.col(f"_w{k}").cast("double")))
    means = F.array_compact(F.array(*[mean(k) for k in range(LANES)]))
    drawn = sums.groupBy(*by).agg(F.coalesce(F.max("_n"), F.lit(0)).alias("queries"), F.max("_t").alias("_t"), F.sort_array(F.flatten(F.collect_list(means))).alias("_m"))
    at = lambda share: F.round(F.get("_m", F.greatest(F.floor(F.size("_m") * share) - 1, F.lit(0)).cast("int")), 4)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return drawn.select(*by, "queries", zero(F.round(F.try_divide(F.col("_t").cast("double"), F.col("queries").cast("double")), 4)).alias("mean"), zero(at(0.025)).alias("low"), zero(at(0.975)).alias("high"))


def overlap_at_k(results: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """(query_id, overlap): share of the first k that the reference's first k hold too."""
    ids = reference.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("there")).distinct()
    return results.where(F.col("rank") <= k).join(ids, ["query_id", "doc_id"], "left").groupBy("query_id").agg((F.count("there") / k).alias("overlap"))


def pooled(runs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, methods): what any method has among its first k, once, with the methods that do. ``runs``:
    method, query_id, doc_id, rank."""
    return runs.where(F.col("rank") <= k).groupBy("query_id", "doc_id").agg(S.sorted_set(F.col("method")).alias("methods"))


def new_pairs(pool: DataFrame, judged: DataFrame) -> DataFrame:
    """Pairs of the pool that no one has judged."""
    return pool.join(judged.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")


def blind_order(pool: DataFrame) -> DataFrame:
    """The pool with ``place``: within a query by a hash of the pair, so that no place tells of a method or rank."""
    key = F.sha2(F.concat_ws(":", F.col("query_id").cast("string"), F.col("doc_id").cast("string")), 256)
    return pool.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(key, "doc_id")))


def adjudicated(runs: DataFrame, known: DataFrame, labelled: DataFrame, k: int) -> DataFrame:
    """(query_id, method, hits, precision, recall, hit) of each method's first k, with the relevant pairs of both judgements
    that any method found as the whole.

    ``known`` and ``labelled``: query_id, doc_id, rel (0 or 1); the labelled pairs must be those of the pool that ``known``
    lacks, no more and no fewer, else ValueError.
    """
    pool = pooled(runs, k)
    asked = new_pairs(pool, known)
    keys = ["query_id", "doc_id"]
    if labelled.groupBy(*keys).agg(F.countDistinct("rel").alias("n")).where("n > 1").count():
        raise ValueError("a pair has two labels")
    missing, extra = asked.join(labelled, keys, "left_anti").count(), labelled.select(*keys).distinct().join(asked, keys, "left_anti").count()
    if missing or extra:
        raise ValueError(f"{missing} pairs have no label, {extra} labels have no pair")
    # dealt anew: Spark 4.1 may take a union's sides for equally partitioned where adaptive execution has made them differ
    both = known.select(*keys, "rel").unionByName(labelled.select(*keys, "rel")).where("rel = 1").repartition(*keys)
    relevant = both.select(*keys).distinct().join(pool, keys, "left_semi")
    n = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    per = runs.where(F.col("rank") <= k).join(relevant.withColumn("rel", F.lit(1)), keys, "left").groupBy("query_id", "method").agg(F.count("rel").alias("hits"))
    per = per.join(n, "query_id", "left")
    return per.select("query_id", "method", "hits", (F.col("hits") / k).alias("precision"), F.coalesce(S.rate(F.col("hits"), F.col("n")), F.lit(0.0)).alias("recall"), (F.col("hits") > 0).cast("double").alias("hit"))


def combined_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Means of precision, recall, hit, reciprocal_rank and ndcg over queries to four decimals (missing values don't count),
    and how many queries have or lack a relevant document. ``rows``: query_id, n_relevant, the metrics, and ``by`` (such as
    variant and aspect)."""
    metrics = [c for c in ("precision", "recall", "hit", "reciprocal_rank", "ndcg") if c in rows.columns]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in metrics],
        F.count_if(F.col("n_relevant") > 0).alias("with_relevant"), F.count_if(F.col("n_relevant") == 0).alias("without_relevant"),
    )


def paired_interval(pairs: DataFrame, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """(queries, mean_difference, low, high) of pairs of scores (``paired``): ``bootstrap`` of their differences."""
    differences = pairs.select("query_id", (F.col("x").cast("decimal(18,9)") - F.col("y").cast("decimal(18,9)")).cast("decimal(18,9)").alias("score"))
    return bootstrap(differences, draws=draws, seed=seed).withColumnRenamed("mean", "mean_difference")


def theme_sample_score(sample: DataFrame, annotated: DataFrame) -> DataFrame:
    """``multilabel_metrics`` of a sample's predicted themes against its annotated ones, for the pilot and the whole (column
    ``part``). ``sample``: id, pilot, themes; ``annotated``: id, themes. ValueError unless both hold the same ids."""
    left, right = sample.select("id"), annotated.select("id")
    if left.join(right, "id", "left_anti").count() or right.join(left, "id", "left_anti").count():
        raise ValueError("the annotations do not cover the sample")
    truth = annotated.join(sample.select("id", "pilot"), "id").select("id", "pilot", F.explode("themes").alias("label"))
    said = sample.select("id", "pilot", F.explode("themes").alias("label"))
    whole = multilabel_metrics(truth, said).withColumn("part", F.lit("final"))
    return multilabel_metrics(truth.where("pilot"), said.where("pilot")).withColumn("part", F.lit("pilot")).unionByName(whole)


def theme_errors(sample: DataFrame, annotated: DataFrame) -> DataFrame:
    """(id, false_positive, false_negative): sorted themes said but not meant, and meant but not said, of rows that have
    any."""
    both = sample.select("id", F.col("themes").alias("said")).join(annotated.select("id", F.col("themes").alias("meant")), "id")
    out = both.select("id", F.sort_array(F.array_except("said", "meant")).alias("false_positive"), F.sort_array(F.array_except("meant", "said")).alias("false_negative"))
    return out.where((F.size("false_positive") > 0) | (F.size("false_negative") > 0))


#: Columns of a measured case that count tokens.
TOKENS = ("input_tokens", "cached_input_tokens", "output_tokens")


def token_cost(prices: dict[str, float]) -> F.Column:
    """Dollars of a row's tokens at prices for a million: ``input``, ``cached_input`` and ``output``; cached ones are part of
    the input."""
    n = [F.coalesce(F.col(c), F.lit(0)) for c in TOKENS]
    fresh = F.greatest(n[0] - n[1], F.lit(0))
    return (fresh * prices["input"] + n[1] * prices["cached_input"] + n[2] * prices["output"]) / 1_000_000


def llm_run_summary(cases: DataFrame, prices: dict[str, float], *by: str) -> DataFrame:
    """Cases, checks passed, how answers came about, seconds, tokens and cost. ``cases``: verification_passed, generation_status
    (null: no generation), generation_seconds, end_to_end_seconds and the token columns."""
    made = F.col("generation_status").isNotNull()
    seconds = F.when(made, F.col("generation_seconds"))
    return cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("verification_passed").alias("verification_passed"),
        *[F.count_if(F.coalesce(F.col("generation_status") == s, F.lit(False))).alias(s) for s in ("llm_generated_validated", "validated_fallback")],
        F.count_if(~made).alias("insufficient_evidence"), F.avg(seconds).alias("mean_generation_seconds"), F.median(seconds).alias("median_generation_seconds"),
        F.avg("end_to_end_seconds").alias("mean_end_to_end_seconds"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKENS], F.sum(token_cost(prices)).alias("estimated_cost"),
    )


def qualitative_averages(rows: DataFrame, scores: list[str], flags: list[str], threshold: float, fidelity: str = "fidelity") -> DataFrame:
    """One row: means of the scores, share of rows with at least ``threshold`` fidelity, and each flag's share of the rows in
    which it is known."""
    return rows.agg(
        F.count(F.lit(1)).alias("sample_size"), *[F.avg(c).alias(c) for c in scores], F.avg((F.col(fidelity) >= threshold).cast("double")).alias("acceptable_rate"),
        *[F.avg(F.col(c).cast("double")).alias(c) for c in flags],
    )


def ablation(runs: DataFrame, judged: DataFrame, k: int, base: str) -> DataFrame:
    """(strategy, queries, precision, hit, precision_gain): each strategy's means over all its queries, and what it gains on
    ``base``. ``runs``: strategy, query_id, doc_id, rank; ``judged``: query_id, doc_id, rel."""
    good = judged.where("rel = 1").select("query_id", "doc_id", F.lit(1).alias("good")).distinct()
    per = runs.where(F.col("rank") <= k).join(good, ["query_id", "doc_id"], "left").groupBy("strategy", "query_id").agg(F.count("good").alias("hits"))
    out = per.groupBy("strategy").agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("hits") / k).alias("precision"), F.avg((F.col("hits") > 0).cast("double")).alias("hit"))
    own = out.where(F.col("strategy") == base).select(F.col("precision").alias("base_precision"))
    return out.join(F.broadcast(own)).select("strategy", "queries", "precision", "hit", (F.col("precision") - F.col("base_precision")).alias("precision_gain"))  # one row


def dominant(parts: DataFrame, name: str, size: str) -> DataFrame:
    """One row: the largest part; of equally large ones the first by name."""
    return parts.orderBy(F.desc(size), name).limit(1).select(F.col(name).alias("dominant"))
