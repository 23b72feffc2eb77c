"""Engines and scans: what is registered under a name, and the one entry that runs it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quarry.operators import detect, members

ABI = 1


@dataclass(frozen=True)
class Engine:
    """An engine: what types it takes and how it scans contents."""

    name: str
    scan: Callable[[DataFrame, str, str], DataFrame]
    types: tuple[str, ...] = ("BINARY",)
    abi: int = ABI


ENGINES: dict[str, Engine] = {}


def register_engine(engine: Engine) -> None:
    if engine.abi != ABI:
        raise ValueError(f"engine {engine.name!r} is for interface {engine.abi}, not {ABI}")
    ENGINES[engine.name] = engine


def _rule_scan(contents: DataFrame, key: str, data: str) -> DataFrame:
    return detect.best_type(detect.match_rules(contents, detect.rule_table(contents.sparkSession), key, data), key)


register_engine(Engine("rules", _rule_scan))
register_engine(Engine("members", lambda contents, key, data: members.list_members(contents, key, data), tuple(members.READERS)))


def scan(engine: str, contents: DataFrame, key: str, data: str = "content", file_type: str | None = None) -> DataFrame:
    """Run an engine; a forced type must be one that it takes."""
    found = ENGINES[engine]
    if file_type is not None and file_type not in found.types:
        raise ValueError(f"engine {engine!r} does not take {file_type}")
    return found.scan(contents, key, data)


def capabilities(spark) -> DataFrame:
    """Which formats can be read, extracted and created."""
    rows = [(k, True, k.lower() in members.PACKERS) for k in sorted(members.READERS)]
    return spark.createDataFrame(rows, "format string, read boolean, create boolean")
