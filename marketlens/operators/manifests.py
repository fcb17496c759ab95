"""Content manifests: what a dataset holds, told by one scan and without an order, so that two environments can be compared."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


@dataclass(frozen=True)
class Contract:
    """What a dataset promises: types by column (more columns may follow), columns without nulls, and SQL conditions by name
    that hold for every row (null counts as kept)."""

    types: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    rules: dict[str, str] = field(default_factory=dict)

    def broken_types(self, df: DataFrame) -> list[str]:
        found = dict(df.dtypes)
        return sorted(c for c, kind in self.types.items() if found.get(c) != kind)

    def violations(self, df: DataFrame) -> Column:
        """Rows that break a rule, or have a null where none may be; a missing column breaks its types only."""
        there = [F.col(c).isNull() for c in self.required if c in df.columns]
        broken = there + [~F.coalesce(F.expr(rule), F.lit(True)) for rule in self.rules.values()]
        return F.count_if(reduce(Column.__or__, broken, F.lit(False)))


def row_hash(df: DataFrame) -> Column:
    """A row's 64-bit hash over its columns by name. Nulls count where they are; a map counts as its sorted entries."""
    names = sorted(df.columns)
    plain = lambda f: F.array_sort(F.map_entries(F.col(f"`{f.name}`"))) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`")
    values = [plain(df.schema[c]) for c in names]
    return F.xxhash64(F.concat_ws("", *[F.when(v.isNull(), "0").otherwise("1") for v in values]), *values)


def content(df: DataFrame, *by: str, more: dict[str, Column] | None = None) -> DataFrame:
    """(by, row_count, hash_sum, hash_xor) of the rows as a multiset: equal for equal rows in any order and partitioning, and
    what parts have adds up to what the whole has. ``by`` are partition columns, where parts are told apart."""
    hashed = df.withColumn("_hash", row_hash(df))
    sums = [F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(F.col("_hash").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("hash_sum"), F.coalesce(F.bit_xor("_hash"), F.lit(0)).alias("hash_xor")]
    return hashed.groupBy(*by).agg(*sums, *[v.alias(c) for c, v in (more or {}).items()])


def manifest(frames: dict[str, DataFrame], contracts: dict[str, Contract] | None = None, layer: str = "curated") -> DataFrame:
    """(layer, dataset, row_count, hash_sum, hash_xor, schema_json, broken_types, violations), a row a dataset. Nothing runs
    before the manifest is read or written, and then each dataset is scanned once."""
    if not frames:
        raise ValueError("a manifest needs datasets")
    rows = []
    for name, df in frames.items():
        contract = (contracts or {}).get(name, Contract())
        one = content(df, more={"violations": contract.violations(df)})
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        rows.append(one.select(F.lit(layer).alias("layer"), F.lit(name).alias("dataset"), "row_count", "hash_sum", "hash_xor", F.lit(columns).alias("schema_json"), F.lit(",".join(contract.broken_types(df))).alias("broken_types"), "violations"))
    return reduce(DataFrame.unionByName, rows)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(layer, dataset, verdict, present_in_both, schema_compatible, row_count_equal, content_equal, contract_kept,
    first_rows, second_rows) of two manifests: the verdict names the first check that fails, or compatible."""
    sides = [m.select("layer", "dataset", *[F.col(c).alias(f"{c}_{k}") for c in m.columns if c not in ("layer", "dataset")]) for k, m in enumerate((a, b))]
    both = sides[0].join(sides[1], ["layer", "dataset"], "full_outer")
    same = lambda *names: reduce(Column.__and__, [F.coalesce(F.col(f"{c}_0") == F.col(f"{c}_1"), F.lit(False)) for c in names])
    kept = lambda k: (F.col(f"violations_{k}") == 0) & (F.col(f"broken_types_{k}") == "")
    checks = {
        "present_in_both": F.col("row_count_0").isNotNull() & F.col("row_count_1").isNotNull(), "schema_compatible": same("schema_json"), "row_count_equal": same("row_count"),
        "content_equal": same("row_count", "hash_sum", "hash_xor"), "contract_kept": F.coalesce(kept(0) & kept(1), F.lit(False)),
    }
    out = both.withColumns(checks)
    names = {"present_in_both": "missing", "schema_compatible": "schema", "row_count_equal": "count", "content_equal": "content", "contract_kept": "contract"}
    verdict = reduce(lambda c, n: c.when(~F.col(n), names[n]), names, F.when(F.lit(False), F.lit(None).cast("string"))).otherwise("compatible")
    return out.select("layer", "dataset", verdict.alias("verdict"), *checks, F.col("row_count_0").alias("first_rows"), F.col("row_count_1").alias("second_rows"))
