"""Finding formats inside other content: anchors, candidates, validation, resumption."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.udf import per_value
from quarry.operators.members import READERS, _listed

RECORD = "struct<offset:bigint,size:bigint,file_type:string,members:int>"


@dataclass(frozen=True)
class Anchor:
    """A signature that stands ``offset`` bytes into its format."""

    kind: str
    magic: bytes
    offset: int = 0


ANCHORS = tuple(Anchor(k, bytes.fromhex(m), o) for k, (m, o, _) in READERS.items() if len(m) >= 6)


#: Bytes behind the last member that belong to a format.
TRAILERS = {"GZIP": 8}


def find_embedded(data: bytes, anchors: tuple[Anchor, ...] = ANCHORS, limit: int = 0) -> list[dict]:
    """Validated formats in a content, first come first served, going on after the end of each.

    ``limit`` 0 is unlimited.
    """
    starts = sorted({(m.start() - a.offset, k) for k, a in enumerate(anchors) for m in re.finditer(b"(?=" + re.escape(a.magic) + b")", data) if m.start() >= a.offset})
    out, resume = [], 0
    for start, k in starts:
        if start < resume:
            continue
        members = _listed(data[start:], anchors[k].kind)
        if not members:
            continue
        size = max(m.offset + m.compressed for m in members) + TRAILERS.get(anchors[k].kind, 0)
        out.append({"offset": start, "size": size, "file_type": anchors[k].kind, "members": len(members)})
        resume = start + max(size, 1)
        if limit and len(out) >= limit:
            break
    return out


def embedded(data: Column, anchors: tuple[Anchor, ...] = ANCHORS, limit: int = 0) -> Column:
    """An array of records; contents without any anchor stay out of Python."""

    @per_value(f"array<{RECORD}>")
    def run(content: bytes):
        return find_embedded(content, anchors, limit)

    some = F.lit(False)
    for a in anchors:
        some = some | (F.position(F.unhex(F.lit(a.magic.hex())), data) > 0)
    return F.when(some, run(data)).otherwise(F.array().cast(f"array<{RECORD}>"))


def carve(contents: DataFrame, key: str, data: str = "content", limit: int = 0) -> DataFrame:
    """One row for each embedded format with its bytes and a name to dump it under."""
    found = contents.select(key, F.col(data).alias("_data"), F.explode(embedded(F.col(data), limit=limit)).alias("r")).select(key, "_data", "r.*")
    part = F.substring(F.col("_data"), (F.col("offset") + 1).cast("int"), F.col("size").cast("int"))
    return found.withColumn("content", part).drop("_data").withColumn("dump_name", dump_name(F.col("file_type"), F.col("offset"), F.col("content"), F.lower("file_type")))


def dump_name(name: Column, offset: Column, content: Column, extension: Column) -> Column:
    clean = F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")
    return F.concat(F.concat_ws("_", clean, F.lower(F.hex(offset.cast("bigint"))), F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0")), F.lit("."), extension)
