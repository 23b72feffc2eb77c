"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

A document's size is its number of words.  Sources in code point order, null
last, weigh 1, 2, 3, 1, ... and share 100% of all sizes by weight; no target
exceeds ``MAX_EPOCHS`` times its source's size, and what a source leaves goes
to the others by weight until no target is above.

A source is dealt into shards of about ``SHARD_WORDS`` words by a hash of its
documents, and each shard is cut into equal blocks (to a word) of at most
``BLOCK_WORDS`` words; sources of fewer than ``LEAST_BLOCKS`` such blocks are cut
finer, into single words at the end.  A block is a seat.  The house has as many
seats as the targets hold blocks, and they go to the sources by Sainte-Laguë's
method: one after the other to the highest quotient claim / (2 seats + 1), ties
to the first in order, none beyond ``MAX_EPOCHS`` times a source's blocks.  A
source's seats go to its groups of ``GROUP`` shards in the same way, and a
group's to its shards.

The method is computed by its divisor: all claims over one divisor, rounded, are
the seats but for a remainder, which is awarded (or taken back) by ranking the
next quotients, of which a party needs few (see ``apportion``).

A quota of q among n blocks takes every block q div n times, and q mod n blocks
once more, chosen by a seeded hash.  A shard fits one task whatever the share
of its source; nothing is collected.

Defined cases: a null or empty text has size 0 and takes nothing; very long texts
are cut into blocks like any other; a null source is a source of its own; rows
that share a doc_id are separate documents; equal rows are told apart by their
place only; rows without doc_id are dealt by their text; an empty table gives an
empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, quoted

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
SHARD_WORDS = 200_000
BLOCK_WORDS = 128
LEAST_BLOCKS = 256
GROUP = 1024
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``(sid, source, source_size, weight, target)`` of ``sizes(source, size)``.

    With m(i) = cap / weight in ascending order, the capped sources are a prefix:
    source i is capped if its share of what the sources before it leave, by
    weight, is at least its cap.  One window over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    per = per.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", ((F.col("sid") - 1) % 3 + 1).cast("double"))
    per = per.withColumn("cap", (F.lit(MAX_EPOCHS) * F.col("source_size")).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    upto = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    per = per.withColumn("open", F.when(F.col("cap") < F.col("level") * F.col("weight"), F.lit(None)).otherwise(F.col("level")))
    # The first source that is not capped sets the level of all that follow.
    per = per.withColumn("final", F.first("open", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return per.select("sid", "source", "source_size", "weight", F.when(F.col("open").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def apportion(parties: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``parties(claim, cap, house)`` with ``seats``, by Sainte-Laguë's method within each ``by``; ties go by ``order``.

    With n parties and U the claims below their cap, the rounded seats differ from the house by r, and no party gets or
    loses more than claim / U * (|r| + n) + 1 of the rest: so many quotients of each are ranked, about 2.5 n rows in all.
    """
    whole, claim = Window.partitionBy(*(by or [F.lit(0)])), F.col("claim")
    rounded = parties.withColumn("_all", F.sum("claim").over(whole)).withColumn("_seats", F.least(F.col("cap"), F.floor(F.coalesce(claim / F.nullif(F.col("_all"), F.lit(0.0)) * F.col("house"), F.lit(0.0)) + 0.5)))
    rounded = rounded.withColumn("_rest", F.col("house") - F.sum("_seats").over(whole))
    rounded = rounded.withColumn("_open", F.sum(F.when((F.col("_rest") < 0) | (F.col("_seats") < F.col("cap")), claim).otherwise(0.0)).over(whole)).withColumn("_n", F.count("*").over(whole))
    needed = F.when((F.col("_rest") == 0) | (F.col("_open") <= 0), 0).otherwise(F.floor(claim / F.col("_open") * (F.abs("_rest") + F.col("_n"))) + 1)
    room = F.when(F.col("_rest") > 0, F.col("cap") - F.col("_seats")).otherwise(F.col("_seats"))
    # Row 0 stands for the party itself; rows 1 to needed are its next quotients.
    tried = rounded.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(needed, room).cast("long"))))
    quotient = F.when(F.col("_rest") > 0, -claim / (2 * (F.col("_seats") + F.col("_k")) - 1)).otherwise(claim / (2 * (F.col("_seats") - F.col("_k")) + 1))
    tried = tried.withColumn("_quotient", F.when(F.col("_k") > 0, quotient))
    place = F.row_number().over(whole.orderBy(F.col("_quotient").isNull(), "_quotient", *[F.when(F.col("_rest") > 0, F.col(c)).asc() for c in order], *[F.col(c).desc() for c in order], "_k"))
    won = tried.withColumn("_won", ((F.col("_k") > 0) & (place <= F.abs("_rest"))).cast("long"))
    own = Window.partitionBy(*by, *order)
    return won.withColumn("seats", F.col("_seats") + F.signum("_rest").cast("long") * F.sum("_won").over(own)).where("_k = 0").drop("_all", "_seats", "_rest", "_open", "_n", "_k", "_quotient", "_won")


def sized(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, source, th, size)`` of ``docs(row, doc_id, source, text)``."""
    return docs.select("row", "doc_id", "source", F.xxhash64("text").alias("th"), word_count(F.col("text")).alias("size"))


def dealt(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents with words and their shards: ``(sid, source, shard, row, size, luck, key, th)``."""
    plan = plan.select("sid", F.col("source").alias("_source"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).alias("shards"))
    key = F.coalesce("doc_id", "th")
    met = sizes.where("size > 0").join(plan, F.col("source").eqNullSafe(F.col("_source")))
    return met.select("sid", "source", "row", "size", "th", F.xxhash64(key, F.lit(SEED + 1)).alias("luck"), key.alias("key"), F.pmod(F.xxhash64(key, F.lit(SEED)), F.col("shards")).alias("shard"))


def quotas(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``(sid, shard, shard_size, blocks, quota)`` of ``dealt`` documents: every shard's blocks, and how many the mix takes."""
    plan = plan.select("sid", "source_size", "target", F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("source_size") / LEAST_BLOCKS))).alias("words"))
    shards = docs.groupBy("sid", "shard").agg(F.sum("size").alias("shard_size")).join(plan, "sid")
    shards = materialize(shards.select("sid", F.floor(F.col("shard") / GROUP).alias("grp"), "shard", "shard_size", F.ceil(F.col("shard_size") / F.col("words")).alias("blocks"), (F.col("target") / F.col("source_size")).alias("rate")), "shards")
    groups = shards.groupBy("sid", "grp").agg(F.sum("blocks").alias("blocks"), F.first("rate").alias("rate"))
    sources = groups.groupBy("sid").agg(F.sum("blocks").alias("blocks"), F.first("rate").alias("rate"))

    def parties(table: DataFrame) -> DataFrame:
        return table.withColumn("claim", F.col("blocks") * F.col("rate")).withColumn("cap", (F.col("blocks") * MAX_EPOCHS).cast("long"))

    house = F.round(F.sum(F.col("blocks") * F.col("rate")).over(Window.partitionBy(F.lit(0)))).cast("long")
    sources = apportion(parties(sources).withColumn("house", house), [], ["sid"]).select("sid", F.col("seats").alias("house"))
    groups = apportion(parties(groups).join(sources, "sid"), ["sid"], ["grp"]).select("sid", "grp", F.col("seats").alias("house"))
    return apportion(parties(shards).join(groups, ["sid", "grp"]), ["sid", "grp"], ["shard"]).select("sid", "shard", "shard_size", "blocks", F.col("seats").alias("quota"))


def pieces(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Each document's stretches of words and how often the mix takes them.

    ``(sid, shard, row, from_word, n_words, times)``; documents lie in a shard
    in the order of a seeded hash of their id.
    """
    docs = dealt(sizes, plan)
    plan = materialize(quotas(docs, plan), "quotas")
    shard = Window.partitionBy("sid", "shard")
    upto = shard.orderBy("luck", "key", "size", "th", "row").rowsBetween(Window.unboundedPreceding, 0)
    laid = docs.hint("merge").join(plan, ["sid", "shard"]).withColumn("end", F.sum("size").over(upto)).withColumn("begin", F.col("end") - F.col("size"))
    # Block k holds the words from floor(k * shard_size / blocks) on.
    first = F.expr("((begin + 1) * blocks - 1) div shard_size")
    last = F.expr("(`end` * blocks - 1) div shard_size")
    cut = laid.select("*", F.explode(F.sequence(first, last)).alias("block"))
    cut = cut.withColumn("rank", F.dense_rank().over(shard.orderBy(F.xxhash64("source", "shard", "block", F.lit(SEED + 2)), "block")))
    start = F.greatest(F.col("begin"), F.expr("block * shard_size div blocks"))
    stop = F.least(F.col("end"), F.expr("(block + 1) * shard_size div blocks"))
    times = F.floor(F.col("quota") / F.col("blocks")) + (F.col("rank") <= F.col("quota") % F.col("blocks")).cast("long")
    return cut.select("sid", "shard", "row", (start - F.col("begin")).cast("int").alias("from_word"), (stop - start).cast("int").alias("n_words"), times.cast("int").alias("times"))


def _with_row(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` written with a key for each row, so that the key holds for all that follows."""
    return docs.select(F.monotonically_increasing_id().alias("row"), *columns)


def mix(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs(doc_id, source, text)``."""
    sizes = materialize(sized(_with_row(docs, "doc_id", "source", "text")), "sizes")
    plan = materialize(targets(sizes), "targets")
    taken = pieces(sizes, plan).groupBy("sid", "shard", "row").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken")).select("row", "taken")
    named = sizes.join(plan.select(F.col("source").alias("_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_source")))
    return named.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each text holds the words taken, repeats included.

    A text that is taken several times follows itself on a new line; documents of
    which nothing is taken are dropped.  Other columns stay.
    """
    names = docs.columns
    rows = materialize(docs.select(F.struct(*[F.col(quoted(n)) for n in names]).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    sizes = materialize(sized(rows.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), F.col("doc.text").alias("text"))), "sizes")
    plan = materialize(targets(sizes), "targets")
    parts = pieces(sizes, plan).where("times > 0").groupBy("sid", "shard", "row").agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words", "times"))).alias("parts")).select("row", "parts")
    met = rows.hint("merge").join(parts, "row")
    words = F.regexp_extract_all(F.col("doc.text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))

    def epoch(tokens: Column, k: Column) -> Column:
        return F.array_join(F.transform(F.filter("parts", lambda p: p["times"] >= k), lambda p: F.array_join(F.slice(tokens, p["from_word"] + 1, p["n_words"]), "")), "")

    # The one-element array binds the words once for all pieces.
    text = F.transform(F.array(words), lambda tokens: F.array_join(F.transform(F.sequence(F.lit(1), F.array_max(F.transform("parts", lambda p: p["times"]))), lambda k: epoch(tokens, k)), "\n"))[0]
    return met.select(*[text.alias(n) if n == "text" else F.col("doc." + quoted(n)).alias(n) for n in names])
