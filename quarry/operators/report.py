"""Scan results: options, order, grouping, limits and output forms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScanOptions:
    """What a report shows; the defaults show all, sorted."""

    show_type: bool = True
    show_version: bool = True
    show_info: bool = True
    sort: bool = True
    limit: int = 0
    kinds: tuple[str, ...] = ("main", "custom")
    recursive: bool = False


def project(detections: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """The columns that the options ask for."""
    if options.recursive:
        raise ValueError("a region scan does not recurse; open containers first")
    shown = {"type": options.show_type, "version": options.show_version, "info": options.show_info}
    rows = detections.where(F.col("kind").isin(*options.kinds)) if "kind" in detections.columns else detections
    return rows.select(*[c for c in rows.columns if shown.get(c, True)])


def ordered(detections: DataFrame, options: ScanOptions = ScanOptions(), by: tuple[str, ...] = ("group", "name_order", "name")) -> DataFrame:
    rows = detections.orderBy(*[c for c in by if c in detections.columns]) if options.sort else detections
    return rows.limit(options.limit) if options.limit else rows


def limited(rows: DataFrame, n: int, *order: str) -> tuple[DataFrame, Column]:
    """The first ``n`` rows and an expression over ``n + 1`` rows that tells whether there were more."""
    return rows.orderBy(*order).limit(n), F.count("*") > n


def groups_of(rows: DataFrame, value: str, member: str) -> DataFrame:
    """Distinct members of each value, and how many groups of values there are."""
    per = rows.groupBy(value).agg(F.countDistinct(member).alias("members"))
    return per.select(value, "members")


def record_name(token: Column, names: dict[str, tuple[str, int]]) -> tuple[Column, Column]:
    """Display name and order of a token; ``Unknown`` and last for others."""
    pairs = [x for t, (d, o) in sorted(names.items()) for x in (F.lit(t), F.struct(F.lit(d).alias("d"), F.lit(o).alias("o")))]
    hit = F.try_element_at(F.create_map(*pairs), token)
    return F.coalesce(hit["d"], F.lit("Unknown")), F.coalesce(hit["o"], F.lit(2**31 - 1))


def as_text(detections: DataFrame) -> DataFrame:
    """One line a row: ``type: name(version)[info]``."""
    has = set(detections.columns)
    part = lambda c, a, z: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(a), F.col(c), F.lit(z))).otherwise("") if c in has else F.lit("")
    return detections.select(F.concat(part("type", "", ": "), F.col("name"), part("version", "(", ")"), part("info", "[", "]")).alias("value"))


def as_json(detections: DataFrame) -> DataFrame:
    return detections.select(F.to_json(F.struct(*detections.columns)).alias("value"))


def as_csv(detections: DataFrame, separator: str = ";") -> DataFrame:
    return detections.select(F.to_csv(F.struct(*detections.columns), {"sep": separator}).alias("value"))


def as_xml(detections: DataFrame, row: str = "detect") -> DataFrame:
    return detections.select(F.to_xml(F.struct(*detections.columns), {"rowTag": row}).alias("value"))


WRITERS = {"text": as_text, "json": as_json, "csv": as_csv, "xml": as_xml}


def write(detections: DataFrame, path: str, form: str = "json") -> None:
    WRITERS[form](detections).write.mode("overwrite").text(path)


#: Colours by category for consoles.
COLOURS = {"executable": 31, "archive": 33, "image": 35, "document": 36, "audio": 32, "video": 32}


def coloured(text: Column, category: Column) -> Column:
    pairs = [F.lit(x) for k, v in COLOURS.items() for x in (k, str(v))]
    code = F.try_element_at(F.create_map(*pairs), F.lower(category))
    return F.when(code.isNotNull(), F.concat(F.lit("\u001b["), code, F.lit("m"), text, F.lit("\u001b[0m"))).otherwise(text)


def observe(rows: DataFrame, name: str, size: str) -> DataFrame:
    """``rows`` with the numbers of records and bytes observed as they pass."""
    return rows.observe(name, F.count("*").alias("records"), F.sum(size).alias("bytes_scanned"))
