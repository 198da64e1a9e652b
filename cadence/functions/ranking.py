"""Row numbers within a group without putting a whole group in one task.

``row_number() OVER (PARTITION BY g ORDER BY …)`` shuffles every row of a
group to one task; when one group holds a third of the data, that task is
the job. Here the order is refined by *levels*, expressions that are
monotone in it (say day, then minute, then a block of ids). Rows are counted
by group and levels (partial aggregation), the counts before each cell are
summed one level at a time, and only the rows of one finest cell are sorted
together. Cells come from the data alone, so a retried task numbers its
rows identically.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_number_by_group(df: DataFrame, group: str, order: list[Column], levels: list[list[tuple[Column, bool]]], out: str = "idx") -> DataFrame:
    """Adds ``out``, the row's number in its group by ``order``.

    ``levels``, coarse to fine, are lists of (expression, ascending); ordering
    by all of them and then by ``order`` must equal ordering by ``order``.
    NULLs come last when ascending and first when descending; a NULL group is
    a group.
    """
    named = [[(f"_l{k}_{i}", e, asc) for i, (e, asc) in enumerate(level)] for k, level in enumerate(levels)]
    names = [[n for n, _, _ in level] for level in named]
    every = [n for level in names for n in level]
    cells = df.withColumns({n: e for level in named for n, e, _ in level})
    located = cells.groupBy(group, *every).agg(F.count(F.lit(1)).alias("_n"))
    counts, before = located, F.lit(0)
    for k, level in enumerate(named):
        outer = [group, *(n for x in names[:k] for n in x)]
        by = [F.col(n).asc_nulls_last() if asc else F.col(n).desc_nulls_first() for n, _, asc in level]
        w = Window.partitionBy(*outer).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        if k == len(named) - 1:
            located = located.withColumn(f"_b{k}", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        else:
            sums = counts.groupBy(*outer, *names[k]).agg(F.sum("_n").alias("_s"))
            sums = sums.select(*outer, *names[k], F.coalesce(F.sum("_s").over(w), F.lit(0)).alias(f"_b{k}"))
            located = _join(located, sums, [*outer, *names[k]])
        before = before + F.col(f"_b{k}")
    located = located.select(group, *every, before.alias("_before"))
    w = Window.partitionBy(group, *every).orderBy(*order)
    numbered = cells.withColumn("_i", F.row_number().over(w))
    return _join(numbered, located, [group, *every]).withColumn(out, (F.col("_before") + F.col("_i")).cast("long")).drop("_before", "_i", *every)


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which NULL keys meet."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on).drop(*[f"_r_{k}" for k in keys])
