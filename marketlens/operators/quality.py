"""Data-quality operators: null profile, key and foreign-key checks, payload consistency, guarded joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, null_count, total, null_rate), one pass over the table."""
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    long = one.selectExpr("total", f"stack({len(columns)}, {pairs}) as (column_name, null_count)")
    return long.select("column_name", "null_count", "total", F.coalesce(F.col("null_count") / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("null_rate"))


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows with a null key part, and groups of rows that share a key."""
    missing = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    grouped = df.where(~missing).groupBy(*keys).count()
    dup = grouped.agg(F.count_if(F.col("count") > 1).alias("duplicate_keys"))
    null = df.agg(F.count_if(missing).alias("null_keys"))
    return null.crossJoin(F.broadcast(dup))  # one row each


def require_unique(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``df``, or ValueError if a key is null or repeated."""
    row = key_violations(df, keys).first()
    if row["null_keys"] or row["duplicate_keys"]:
        raise ValueError(f"{label}: {row['null_keys']} null keys, {row['duplicate_keys']} duplicate keys")
    return df


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Distinct non-null child keys without a parent."""
    keys = child.select(F.col(child_key).alias("orphan_key")).where(F.col("orphan_key").isNotNull()).distinct()
    return keys.join(parent.select(F.col(parent_key).alias("orphan_key")), "orphan_key", "left_anti")


def require_parents(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, label: str) -> None:
    if n := orphans(child, child_key, parent, parent_key).count():
        raise ValueError(f"{label}: {n} keys without a parent")


def payloads(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, payloads): number of different contents among the rows of a key; null fields count as content."""
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return df.groupBy(key).agg(F.countDistinct(body).alias("payloads"))


def join_without_fanout(left: DataFrame, right: DataFrame, on: str | list[str], label: str, record: list[dict[str, object]] | None = None) -> DataFrame:
    """Left join that keeps the number of left rows: the right key is proven unique first, by one aggregate. With
    ``record``, the rows before and after the join are counted and appended to it, passed or not."""
    if record is not None:
        n = fanout_report(left, right, on).first()
        record.append({"check": label, "rows_before": n["rows_before"], "rows_after": n["rows_after"], "passed": n["rows_before"] == n["rows_after"]})
    keys = [on] if isinstance(on, str) else on
    present = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    if not right.where(present).groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"Fan-out detected: {label}")
    return left.join(right, keys, "left")


def write_guarded(left: DataFrame, right: DataFrame, on: str | list[str], path: str, label: str) -> dict[str, object]:
    """Write ``left`` joined with ``right`` (left join) to ``path``, a new one, and tell (check, rows_before, rows_after,
    null_keys, passed): rows are counted by the job that writes them, and no other job runs where nothing multiplies. A lost
    executor can let rows be counted twice, so a difference is confirmed by ``fanout_report`` before the written table is
    deleted and ValueError raised."""
    keys = [on] if isinstance(on, str) else on
    before, after = Observation(), Observation()
    missing = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    seen = left.observe(before, F.count(F.lit(1)).alias("rows_before"), F.count_if(missing).alias("null_keys"))
    seen.join(right, keys, "left").observe(after, F.count(F.lit(1)).alias("rows_after")).write.mode("errorifexists").parquet(path)
    found = before.get | after.get
    if found["rows_before"] != found["rows_after"]:
        found |= fanout_report(left, right, on).first().asDict()
    passed = found["rows_before"] == found["rows_after"]
    if not passed:
        spark = left.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        raise ValueError(f"Fan-out detected: {label}: {found['rows_before']} rows became {found['rows_after']}")
    return {"check": label, **{c: found[c] for c in ("rows_before", "rows_after", "null_keys")}, "passed": passed}


def fanout_report(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """(rows_before, rows_after) of a left join, from key counts alone."""
    on = [on] if isinstance(on, str) else on
    n = right.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    per = left.join(n, on, "left").select(F.coalesce("n", F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("rows_before"), F.sum("n").cast("long").alias("rows_after"))
