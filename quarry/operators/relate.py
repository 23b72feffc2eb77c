"""Joins and ordered computations over regions, events and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of the same key at or before it.

    Both sides are united, ordered within their key, and the last values carried
    forward: one shuffle, and no pairs.
    """
    tagged = left.select(F.col(by).alias("_by"), F.col(left_time).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))
    other = right.select(F.col(by).alias("_by"), F.col(right_time).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(tagged.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_v"))
    w = Window.partitionBy("_by").orderBy("_at", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    carried = tagged.unionByName(other).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return carried.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def bucketed_interval_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the ranges [start, end) that hold them, as an equi-join on buckets of ``width``."""
    p = points.withColumn("_bucket", F.floor(F.col(point) / width))
    r = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return p.join(r, "_bucket").where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bucket")


def interval_counts(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, width: int) -> DataFrame:
    """``ranges`` with ``n``, how many points [start, end) holds, without those that hold none.

    No pairs are made: equal positions and equal ranges are counted together, and in each bucket of ``width`` a range holds
    the points before its end less those before its start.
    """
    at = points.where(F.col(point).isNotNull()).groupBy(F.col(point).alias("_at")).agg(F.count("*").alias("_n"))
    held = at.select(F.floor(F.col("_at") / width).alias("_bucket"), "_at", F.lit(1).alias("_side"), "_n", F.lit(None).alias("_range"), F.lit(0).alias("_sign"))
    spans = ranges.where(F.col(end) > F.col(start)).select(F.struct(F.col(start).alias("start"), F.col(end).alias("end")).alias("_range")).distinct()
    spread = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_range.start") / width), F.floor((F.col("_range.end") - 1) / width))))
    sides = F.array(F.struct(F.col("_range.start").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("_range.end").alias("at"), F.lit(1).alias("sign")))
    edges = spread.select("_bucket", "_range", F.explode(sides).alias("_e")).select("_bucket", F.col("_e.at").alias("_at"), F.lit(0).alias("_side"), F.lit(0).cast("bigint").alias("_n"), "_range", F.col("_e.sign").alias("_sign"))
    w = Window.partitionBy("_bucket").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    before = held.unionByName(edges).withColumn("_before", F.sum("_n").over(w)).where("_side = 0")
    counts = before.groupBy("_range").agg(F.sum(F.col("_sign") * F.col("_before")).alias("n")).where("n > 0")
    return ranges.join(counts.select(F.col("_range.start").alias(start), F.col("_range.end").alias(end), "n"), [start, end])


def overlaps_before(regions: DataFrame, key: str, offset: str = "offset", size: str = "size") -> DataFrame:
    """``regions`` with ``overlaps``: whether a region begins before all earlier ones have ended."""
    w = Window.partitionBy(key).orderBy(offset, size).rowsBetween(Window.unboundedPreceding, -1)
    return regions.withColumn("overlaps", F.coalesce(F.max(F.col(offset) + F.col(size)).over(w) > F.col(offset), F.lit(False)))


def greedy_disjoint(finds: Column) -> Column:
    """Of (offset, size) structs those that a scan which resumes after each find would meet."""
    ordered = F.array_sort(finds)
    empty = F.filter(finds, lambda _: F.lit(False))
    start = F.struct(F.lit(0).cast("bigint").alias("end"), empty.alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        take = x["offset"] >= acc["end"]
        return F.struct(F.when(take, (x["offset"] + x["size"]).cast("bigint")).otherwise(acc["end"]).alias("end"), F.when(take, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(ordered, start, step, lambda acc: acc["kept"])


def first_by_priority(candidates: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    return candidates.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def resolve_conflicts(names: DataFrame, key: str, name: str = "name", index: str = "index") -> DataFrame:
    """``names`` with ``target``: the first of names that differ in case only keeps it, later ones get a numbered marker."""
    w = Window.partitionBy(key, F.lower(name)).orderBy(index)
    n = F.row_number().over(w)
    return names.withColumn("target", F.when(n == 1, F.col(name)).otherwise(F.concat(name, F.lit("~xx-"), F.lpad(F.lower(F.hex(F.col(index).cast("bigint"))), 8, "0"))))


def forward_fill(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def running_offsets(fields: DataFrame, key: str, order: str, size: str = "size") -> DataFrame:
    """``offset`` of each field: the sizes before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return fields.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("bigint"))


def islands(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Runs of consecutive positions: key, start, end, length."""
    w = Window.partitionBy(key).orderBy(position)
    return rows.withColumn("_run", F.col(position) - F.row_number().over(w)).groupBy(key, "_run").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.count("*").alias("length")).drop("_run")


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int = 16, hot_rows: int = 1_000_000) -> DataFrame:
    """An inner join whose hot keys are spread: left rows by a hash of the row, right rows to all salts.

    Hot are the keys of more than ``hot_rows`` left rows; all others are joined as they are, and no right row is copied for them.
    """
    hot = left.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(on, F.lit(True).alias("_hot"))
    luck = F.pmod(F.xxhash64(*left.columns), F.lit(salts))
    a = left.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), luck).otherwise(F.lit(0).cast("bigint"))).drop("_hot")
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    c = right.join(hot, on, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0).cast("bigint"))))).drop("_hot")
    return a.join(c, [on, "_salt"]).drop("_salt")


def tree_paths(nodes: DataFrame) -> DataFrame:
    """``(id, depth, path)`` of an ordered tree given as id, parent_id, ordinal; a recursive query.

    A tree deeper than the session's ``spark.sql.cteRecursionLevelLimit`` is an error, not a shorter answer.
    """
    spark = nodes.sparkSession
    nodes.select("id", "parent_id", "ordinal").createOrReplaceTempView("_tree_nodes")
    return spark.sql("""
        WITH RECURSIVE walk(id, depth, path) AS (
          SELECT id, 0, array(ordinal) FROM _tree_nodes WHERE parent_id IS NULL
          UNION ALL
          SELECT n.id, w.depth + 1, array_append(w.path, n.ordinal) FROM _tree_nodes n JOIN walk w ON n.parent_id = w.id)
        SELECT id, depth, path FROM walk""")
