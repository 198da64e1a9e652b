"""Merges of bucketed tables: the existing side is not moved, and the result is the plain merge's."""

import uuid

import pytest
from pyspark.sql import functions as F

from cadence.operators import upsert
from cadence.plans.inputs import tables
from cadence.sources import buckets
from tests.conftest import SMOKE_DIR

SPEC = upsert.ISSUE_SPEC


def as_of():
    return F.lit("2030-01-02").cast("timestamp")


@pytest.fixture
def named(spark, tmp_path):
    made = []

    def make(label):
        name = f"{label}_{uuid.uuid4().hex}"
        made.append(name)
        return name, str(tmp_path / name)

    yield make
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def split(spark):
    i = tables(spark, SMOKE_DIR).issues
    changed = F.concat(F.lit("Changed "), F.col("id").cast("string"))
    batch = i.where((F.col("id") % 2 == 0) | (F.col("id") % 3 == 0)).withColumn("summary", changed).withColumn("status", changed)
    return i.where(F.col("id") % 3 != 0), batch


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def children(plan):
    """The two sides of the plan's only sort-merge join, as text."""
    below = plan[plan.index("SortMergeJoin"):].splitlines()[1:]
    at = {n: line.index("+- ") for n, line in enumerate(below) if "+- " in line}
    second = max(n for n, place in at.items() if place == min(at.values()))
    return "\n".join(below[:second]), "\n".join(below[second:])


def test_merge_moves_only_the_batch(spark, named):
    existing, batch = split(spark)
    first, path = named("issues")
    table = buckets.write_bucketed(existing, first, SPEC.key, 6, path)
    assert buckets.buckets_of(spark, first) == (SPEC.key, 6)
    plan = buckets.merge_plan(spark, first, batch, SPEC, as_of())._jdf.queryExecution().executedPlan().toString()
    left, right = children(plan)
    assert "Exchange" not in left and "Bucketed: true" in left, plan
    assert "Exchange hashpartitioning(jira_issue_id" in right, plan
    second, path = named("issues")
    merged = buckets.merge_bucketed(spark, first, batch, SPEC, as_of(), second, path=path)
    assert rows(merged) == rows(upsert.merge(existing, batch, SPEC, as_of()))
    assert merged.columns[: len(table.columns)] == table.columns


def test_new_version_is_bucketed_again_without_a_shuffle(spark, named):
    existing, batch = split(spark)
    (first, a), (second, b), (third, c) = named("issues"), named("issues"), named("issues")
    buckets.write_bucketed(existing, first, SPEC.key, 4, a)
    merged = buckets.merge_bucketed(spark, first, batch, SPEC, as_of(), second, path=b)
    # A file a bucket at most, and every key where a fresh deal would put it.
    files = [r.f for r in merged.select(F.input_file_name().alias("f")).distinct().collect()]
    assert 1 < len(files) <= 4
    where = merged.select(SPEC.key, F.regexp_extract(F.input_file_name(), r"_(\d{5})\.c", 1).cast("int").alias("is"), F.pmod(F.hash(SPEC.key), F.lit(4)).alias("due"))
    assert where.where("is <> due or is is null").isEmpty()
    again = buckets.merge_bucketed(spark, second, batch, SPEC, as_of(), third, path=c)
    assert rows(again) == rows(upsert.merge(upsert.merge(existing, batch, SPEC, as_of()), batch, SPEC, as_of()))


def test_batch_with_many_versions_and_empty_sides(spark, named):
    existing, batch = split(spark)
    (first, a), (second, b), (third, c) = named("issues"), named("issues"), named("issues")
    buckets.write_bucketed(existing.limit(0), first, SPEC.key, 3, a)
    twice = batch.withColumn("seq", F.lit(1)).unionByName(batch.withColumn("status", F.lit("Later")).withColumn("seq", F.lit(2)))
    merged = buckets.merge_bucketed(spark, first, twice, SPEC, as_of(), second, seq="seq", path=b)
    assert rows(merged) == rows(upsert.upsert(existing.limit(0), twice, SPEC, as_of=as_of()))
    assert merged.where("status <> 'Later'").isEmpty()
    same = buckets.merge_bucketed(spark, second, batch.limit(0), SPEC, as_of(), third, path=c)
    assert rows(same) == rows(merged)


def test_other_keys_and_plain_tables_are_refused(spark, named):
    existing, batch = split(spark)
    (first, a), (second, b) = named("issues"), named("issues")
    buckets.write_bucketed(existing, first, "id", 2, a)
    with pytest.raises(ValueError, match="bucketed by id"):
        buckets.merge_bucketed(spark, first, batch, SPEC, as_of(), second, path=b)
    existing.write.option("path", b).saveAsTable(second)
    with pytest.raises(ValueError, match="not bucketed"):
        buckets.merge_bucketed(spark, second, batch, SPEC, as_of(), first)
