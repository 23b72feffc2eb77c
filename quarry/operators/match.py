"""Joins of facts about contents with tables of rules, as equi-joins; and sets of types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def const_matches(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """``facts`` that hold both values of a rule: rules are ``(name, value1, value2)``; null values match nothing."""
    return facts.join(rules, ["value1", "value2"])


def _token(name: Column, number: Column) -> Column:
    """A name if there is one, else a number, so that both kinds meet in one equi-join."""
    return F.when(name.isNotNull(), F.concat(F.lit("n:"), name)).when(number.isNotNull(), F.concat(F.lit("i:"), number.cast("string")))


def resource_matches(resources: DataFrame, rules: DataFrame) -> DataFrame:
    """``resources`` with the rules for their type and item, each given by name or by number.

    Both sides have ``type_name, type_id, item_name, item_id``; a name counts before a number.
    """
    columns = ("type_name", "type_id", "item_name", "item_id")
    tokens = [_token(F.col(a), F.col(b)) for a, b in (("type_name", "type_id"), ("item_name", "item_id"))]
    keyed = resources.withColumns({"_type": tokens[0], "_item": tokens[1]})
    wanted = rules.withColumns({"_type": tokens[0], "_item": tokens[1]}).drop(*columns)
    return keyed.join(wanted, ["_type", "_item"]).drop("_type", "_item")


def named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with what a table says about their ``(name, kind)``; null where it says nothing."""
    return rows.join(names, ["name", "kind"], "left")


def tool_matches(rich: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Keys whose rich header (``tools``, an array of id and build) has a rule's tool: in any build if its ``build`` is null."""
    probes = F.explode(F.flatten(F.transform("tools", lambda t: F.array(F.struct(t["id"].alias("tool"), t["build"].alias("build")), F.struct(t["id"].alias("tool"), F.lit(None).cast("int").alias("build"))))))
    probed = rich.select(key, probes.alias("p")).select(key, F.col("p.tool").alias("_tool"), F.col("p.build").alias("_build")).distinct()
    return probed.join(rules, (F.col("_tool") == F.col("tool")) & F.col("_build").eqNullSafe(F.col("build"))).select(key, "rule").distinct()


def with_member(contents: DataFrame, listed: DataFrame, key: str, names: list[str], absent: bool = False) -> DataFrame:
    """``contents`` that list a member of one of ``names`` (or, if ``absent``, those that don't)."""
    return contents.join(listed.where(F.col("name").isin(*names)).select(key), key, "left_anti" if absent else "left_semi")


def available(requested: Column, present: Column) -> Column:
    """The requested types that are there, in the order asked for."""
    return F.array_intersect(requested, present)


def without_inspection(types: Column, inspected: Column) -> Column:
    """Types without those that are only looked at."""
    return F.array_except(types, inspected)


def detected(contents: DataFrame, key: str, data: str = "content") -> DataFrame:
    """One row for each type whose check fits a content."""
    from quarry.operators.detect import type_set

    return contents.select(key, F.explode(type_set(F.col(data))).alias("file_type"))


def information(listed: DataFrame, key: str) -> DataFrame:
    """A line about each container: its type, members, sizes and first member."""
    facts = listed.groupBy(key, "container").agg(F.count("*").alias("n"), F.sum("uncompressed_size").alias("size"), F.min_by("name", "index").alias("first"))
    return facts.select(key, F.format_string("%s: %d members, %d bytes, first %s", "container", "n", "size", "first").alias("line"))
