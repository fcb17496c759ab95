"""Repeatable samples: by a hash of the id, round robin over strata, and balanced over overlapping groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(doc_id: str, seed: str = "42") -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256)


def hash_sample(df: DataFrame, n: int, doc_id: str, seed: str = "42") -> DataFrame:
    """``n`` rows (1 to 10,000) in the order of a hash of the id."""
    if not 1 <= n <= 10_000:
        raise ValueError("a sample has 1 to 10,000 rows")
    return df.orderBy(hash_order(doc_id, seed), doc_id).limit(n)


def round_robin(df: DataFrame, n: int, stratum: str, doc_id: str, seed: str = "42") -> DataFrame:
    """``n`` rows, one of each stratum in turn, in the order of a hash of the id. No more than ``n`` of a stratum can be
    among them, so each partition keeps its first ``n`` before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(doc_id, seed), doc_id))
    return df.withColumn("rn", rank).where(F.col("rn") <= n).orderBy("rn", stratum).limit(n).drop("rn")


def assigned(choices: dict[str, list], per: int) -> dict[str, list]:
    """``per`` rows of each group's choices, none twice, or ValueError where there is no such assignment.

    Groups take rows in turn, each the first free ones of its choices. A group that runs short takes a row from another group
    that finds a replacement (an augmenting path, the shortest one), so an assignment is found whenever one exists, and where
    taking alone gives one it is that.
    """
    owner: dict[object, str] = {}
    for group, rows in choices.items():
        for row in [r for r in rows if r not in owner][:per]:
            owner[row] = group
        while sum(g == group for g in owner.values()) < per:
            # breadth first over groups: each reached by the row that it would give away
            came: dict[str, tuple[str, object] | None] = {group: None}
            queue, end = [group], None
            for at in queue:
                for row in choices[at]:
                    held = owner.get(row)
                    if held is None:
                        end = (at, row)
                        break
                    if held not in came:
                        came[held] = (at, row)
                        queue.append(held)
                if end:
                    break
            if end is None:
                raise ValueError(f"not enough distinct rows for {group}")
            while end:
                at, row = end
                owner[row] = at
                end = came[at]
    place = {g: {r: k for k, r in enumerate(rows)} for g, rows in choices.items()}
    return {g: sorted((r for r, at in owner.items() if at == g), key=place[g].__getitem__) for g in choices}


def balanced(df: DataFrame, groups: list[str], per: int, member: str, doc_id: str, seed: str = "42", pilot: int = 3) -> DataFrame:
    """(doc_id, stratum, stratum_rank, pilot): ``per`` rows of each group, none twice. ``member``: array of a row's groups.

    Each group offers its first rows in the order of a hash of the id, as many as all groups want together: the others can't
    take more of them, so what lies behind never decides whether a sample exists. Groups take rows in the order given;
    ``assigned`` exchanges rows where one runs short. ValueError where no sample exists. The driver sees the offered ids only:
    the square of the number of groups, times ``per``. Rows that are repeated count once, rows without an id don't.
    """
    some = df.where(F.col(doc_id).isNotNull()).select(doc_id, F.explode(member).alias("stratum")).where(F.col("stratum").isin(groups)).distinct()
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(hash_order(doc_id, seed), doc_id))
    first = some.withColumn("rn", rank).where(F.col("rn") <= per * len(groups)).orderBy("rn").collect()
    choices: dict[str, list] = {g: [] for g in groups}
    for r in first:
        choices[r["stratum"]].append(r[doc_id])
    rows = [(i, g, k, k <= pilot) for g, ids in assigned(choices, per).items() for k, i in enumerate(ids, 1)]
    return df.sparkSession.createDataFrame(rows, f"`{doc_id}` {dict(df.dtypes)[doc_id]}, stratum string, stratum_rank int, pilot boolean")
