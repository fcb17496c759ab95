"""Scaled replicas, benchmark workloads and their validation."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.functions import scalar as S
from marketlens.operators import manifests
from marketlens.sources.connectors import is_complete, size_bytes


def replicate(df: DataFrame, factor: int, ids: list[str]) -> DataFrame:
    """``factor`` copies of every row, id columns (and ids inside arrays) marked by replica so that keys stay aligned.
    The replica numbers are a broadcast range."""
    mark = F.concat(F.lit("__copy_"), F.col("replica").cast("string"))
    kinds = dict(df.dtypes)
    new = {c: F.transform(c, lambda x: F.concat(x.cast("string"), mark)) if kinds[c].startswith("array") else F.concat(F.col(c).cast("string"), mark) for c in ids}
    numbers = df.sparkSession.range(factor).select(F.col("id").alias("replica"))
    return df.crossJoin(F.broadcast(numbers)).withColumns(new)


#: Id columns of the curated tables, marked together so that their keys stay aligned.
KEYS = {
    "orders_enriched": ["order_id", "customer_id", "customer_unique_id"], "reviews_enriched": ["review_id", "linked_order_ids"],
    "review_order_links": ["review_id", "order_id"], "review_themes": ["review_id"],
}
#: What must be unique in each table, and which keys of one table must be found in another.
UNIQUE = {"orders_enriched": ["order_id"], "reviews_enriched": ["review_id"], "review_order_links": ["review_id", "order_id"], "review_themes": ["review_id", "theme", "classifier_version"]}
PARENTS = [("review_order_links", "order_id", "orders_enriched"), ("review_order_links", "review_id", "reviews_enriched"), ("review_themes", "review_id", "reviews_enriched")]


def scaled(df: DataFrame, dataset: str, factor: int) -> DataFrame:
    """A curated table ``factor`` times with aligned keys; ValueError for another table."""
    if dataset not in KEYS:
        raise ValueError(f"unsupported dataset {dataset}")
    return replicate(df, factor, [c for c in KEYS[dataset] if c in df.columns]).drop("replica")


def relationship_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, violations): groups of rows that share a key, for each table, and distinct keys without a parent."""
    found = []
    for name, keys in UNIQUE.items():
        groups = tables[name].groupBy(*[k for k in keys if k in tables[name].columns]).count()
        found.append(groups.agg(F.count_if(F.col("count") > 1).alias("violations")).withColumn("check", F.lit(f"duplicate {name}")))
    for child, key, parent in PARENTS:
        lost = tables[child].select(key).where(F.col(key).isNotNull()).distinct().join(tables[parent].select(key), key, "left_anti")
        found.append(lost.agg(F.count(F.lit(1)).alias("violations")).withColumn("check", F.lit(f"orphan {child} {key}")))
    return reduce(DataFrame.unionByName, found).select("check", "violations")


def generate(tables: dict[str, DataFrame], root: str, factors: list[int], force: bool = False) -> list[dict[str, object]]:
    """Write each table at each factor below ``root`` and check keys; a manifest row for each, ``reused`` where a complete
    one of as many rows is there already. ValueError for another number of rows, another schema or broken keys."""
    spark, out = next(iter(tables.values())).sparkSession, []
    base = {name: df.count() for name, df in tables.items()}
    for factor in factors:
        for name, df in tables.items():
            path, made = f"{root}/{factor}x/{name}", "reused"
            if force or not is_complete(spark, path) or spark.read.parquet(path).count() != base[name] * factor:
                scaled(df, name, factor).write.mode("overwrite").parquet(path)
                made = "generated"
            back = spark.read.parquet(path)
            rows = back.count()
            if rows != base[name] * factor:
                raise ValueError(f"{name} {factor}x: {rows} rows, {base[name] * factor} expected")
            plain = lambda s: [(f.name, f.dataType.simpleString()) for f in s.fields if f.name not in KEYS[name]]  # noqa: B023, E731
            if plain(back.schema) != plain(df.schema):
                raise ValueError(f"{name} {factor}x: another schema")
            out.append({"factor": factor, "dataset": name, "path": path, "operation": made, "rows": rows, "size_bytes": size_bytes(spark, path)})
        broken = relationship_checks({name: spark.read.parquet(f"{root}/{factor}x/{name}") for name in tables}).where("violations > 0").collect()
        if broken:
            raise ValueError(f"{factor}x: " + ", ".join(f"{r['check']}: {r['violations']}" for r in broken))
    return out


def logical_rows(counts: DataFrame) -> DataFrame:
    """(workload, rows): how many rows each workload reads. ``counts``: dataset, row_count."""
    reads = [("A", ["orders_enriched"]), ("B", ["orders_enriched", "reviews_enriched", "review_order_links"]), ("C", list(KEYS))]
    per = [F.sum(F.when(F.col("dataset").isin(names), F.col("row_count")).otherwise(0)).cast("long").alias(w) for w, names in reads]
    one = counts.agg(*per)
    return one.selectExpr("stack(3, 'A', A, 'B', B, 'C', C) as (workload, rows)")


def workload_a(orders: DataFrame) -> DataFrame:
    """Count, value and late rate by year, month and category, then totals."""
    g = orders.groupBy("purchase_year", "purchase_month", "order_category").agg(F.count(F.lit(1)).alias("n"), F.sum("order_value").cast("decimal(18,2)").alias("value"), F.count_if("is_late").alias("late"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").cast("long").alias("orders"), F.sum("value").cast("decimal(18,2)").cast("double").alias("value"), F.sum("late").cast("long").alias("late"))


def workload_b(orders: DataFrame, links: DataFrame, reviews: DataFrame) -> DataFrame:
    """Three tables joined, scores by state and status, then totals."""
    j = links.join(orders.select("order_id", "customer_state", "order_status"), "order_id").join(reviews.select("review_id", "review_score"), "review_id")
    g = j.groupBy("customer_state", "order_status").agg(F.count(F.lit(1)).alias("n"), F.sum("review_score").alias("scores"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").cast("long").alias("links"), F.sum("scores").cast("long").alias("scores"))


def workload_c(orders: DataFrame, links: DataFrame, reviews: DataFrame) -> DataFrame:
    """Orders, links, reviews and their themes (``themes.annotated``) joined with features, five keys, distinct counts, then
    totals. A review's themes come with it, so no text and no fourth table is joined."""
    bucket = F.when(F.col("is_late"), "late").when(F.col("is_late").isNull(), "unknown").otherwise("on_time")
    known = reviews.select("review_id", "themes", ((F.col("review_score") <= 2) & F.col("text_is_eligible")).alias("signal"))
    j = links.join(orders.select("order_id", "customer_state", bucket.alias("bucket"), "order_category", "purchase_year"), "order_id").join(known, "review_id")
    j = j.select("purchase_year", "customer_state", "order_category", "bucket", F.explode_outer("themes").alias("theme"), "review_id", "order_id", "signal")
    g = j.groupBy("purchase_year", "customer_state", "order_category", "bucket", "theme").agg(F.countDistinct("review_id").alias("r"), F.countDistinct("order_id").alias("o"), F.count_if("signal").alias("s"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.sum("r").cast("long").alias("reviews"), F.sum("o").cast("long").alias("orders"), F.sum("s").cast("long").alias("signals"))


def benchmark(spark: SparkSession, workloads: dict[str, Callable[[int], DataFrame]], factors: list[int], rows: dict[str, dict[int, int]], runs: int = 3, warm_up: int = 1) -> list[dict[str, object]]:
    """A record for each measured run: factor, workload, seconds, rows read, throughput and a checksum of the result. The
    first ``warm_up`` runs of each are not measured, the cache is cleared before each; factor 1 must be among them."""
    if 1 not in factors:
        raise ValueError("factor 1 is what others are compared with")
    out = []
    for factor in factors:
        for name, build in workloads.items():
            for k in range(warm_up + runs):
                spark.catalog.clearCache()
                began = time.perf_counter()
                found = manifests.content(build(factor)).first()
                took = time.perf_counter() - began
                if k >= warm_up:
                    checksum = hashlib.sha256(repr(tuple(found)).encode()).hexdigest()
                    out.append({"factor": factor, "workload": name, "seconds": took, "rows": rows[name][factor], "throughput": rows[name][factor] / took, "checksum": checksum})
    return out


def run_summary(runs: DataFrame) -> DataFrame:
    """Mean, sample deviation and throughput per factor and workload, and growth against the smallest factor."""
    g = runs.groupBy("workload", "factor").agg(F.avg("seconds").alias("mean_seconds"), F.stddev_samp("seconds").alias("stddev_seconds"), F.avg(F.col("rows") / F.col("seconds")).alias("throughput"))
    w = Window.partitionBy("workload").orderBy("factor")
    first = F.first("mean_seconds").over(w)
    return g.withColumn("time_growth", F.col("mean_seconds") / first).withColumn("factor_growth", F.col("factor") / F.first("factor").over(w))


def linearity(results: DataFrame) -> DataFrame:
    """Per workload: repeated checksums equal, and measure over factor constant within 1e-9."""
    per = results.withColumn("unit", F.col("measure") / F.col("factor"))
    return per.groupBy("workload").agg((F.max("unit") - F.min("unit") <= 1e-9).alias("is_linear"), (F.countDistinct("factor", "checksum") == F.countDistinct("factor")).alias("is_repeatable"))


def speedup(local: DataFrame, cloud: DataFrame) -> DataFrame:
    """Local over cloud seconds where both have the configuration."""
    return local.select("factor", "workload", F.col("seconds").alias("l")).join(cloud.select("factor", "workload", F.col("seconds").alias("c")), ["factor", "workload"]).select("factor", "workload", S.rate(F.col("l"), F.col("c")).alias("speedup"))
