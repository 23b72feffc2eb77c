"""Streaming forms: event windows, and scans of contents that arrive in chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def tumbling_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Events by window and type; works on streams (with a watermark) and on tables."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    return rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sliding_counts(events: DataFrame, time: str = "ts", width: str = "2 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    return rows.groupBy(F.window(time, width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "2 hours", by: str = "user_id") -> DataFrame:
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    return rows.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_events(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "2 hours") -> DataFrame:
    """Without repeated events; a stream forgets keys that are older than the watermark."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


class ChunkDigest(StatefulProcessor):
    """Digests of contents that arrive as (key, chunk, content, last) rows, in any order of chunks.

    State holds the chunks that can't be used yet and those that were, until the last one is there.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "chunk int", "content binary, last boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        for part in rows:
            for r in part.itertuples():
                self.chunks.updateValue((int(r.chunk),), (bytes(r.content), bool(r.last)))
        have = {k[0]: v for k, v in self.chunks.iterator()}
        end = [k for k, v in have.items() if v[1]]
        if end and all(k in have for k in range(end[0] + 1)):
            digest, size = hashlib.sha256(), 0
            for k in range(end[0] + 1):
                digest.update(have[k][0])
                size += len(have[k][0])
            self.chunks.clear()
            yield pd.DataFrame({"key": [key[0]], "size": [size], "sha256": [digest.hexdigest()]})

    def close(self) -> None:
        pass


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """``(key, size, sha256)`` as contents become whole."""
    return chunks.groupBy("key").transformWithStateInPandas(statefulProcessor=ChunkDigest(), outputStructType="key string, size long, sha256 string", outputMode="append", timeMode="none")


def chunk_strings(chunks: DataFrame, minimum: int = 4) -> DataFrame:
    """ASCII strings of chunked contents, runs across chunk borders included.

    ``chunks`` has key, chunk, content.  Each chunk gives its inner runs and the
    open ends; ends of neighbouring chunks are joined in order, by window.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("chunk")
    shown = chunks.withColumn("s", F.decode("content", "ISO-8859-1")).withColumn("at", F.coalesce(F.sum(F.octet_length("content")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # A chunk that is one printable run goes on with the run before it; others begin a new group at their last break.
    piece = r"[\x20-\x7E]+"
    parts = shown.select("key", "chunk", "at", F.explode(F.expr("sequence(1, greatest(1, size(split(s, '(?<=[^ -~])(?=[ -~])|(?<=[ -~])(?=[^ -~])'))))")).alias("k"), F.split("s", r"(?<=[^\x20-\x7E])(?=[\x20-\x7E])|(?<=[\x20-\x7E])(?=[^\x20-\x7E])").alias("p"))
    runs = parts.select("key", "chunk", "k", F.element_at("p", F.col("k")).alias("text")).withColumn("solid", F.col("text").rlike(f"^{piece}$"))
    order = Window.partitionBy("key").orderBy("chunk", "k")
    grouped = runs.withColumn("breaks", F.sum((~F.col("solid")).cast("int")).over(order)).where("solid")
    return grouped.groupBy("key", "breaks").agg(F.sort_array(F.collect_list(F.struct("chunk", "k", "text"))).alias("x")).select("key", F.array_join(F.transform("x", lambda r: r["text"]), "").alias("text")).where(F.length("text") >= minimum)
