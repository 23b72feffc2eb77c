"""Small text files that steer a scan: translations, settings and rules."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import search


def parse_po(text: str) -> list[tuple[str | None, str, str | None, list[str]]]:
    """Entries of a gettext catalogue: context, message, plural, translations."""
    out, entry, last = [], {}, None

    def done() -> None:
        if "msgid" in entry:
            forms = [entry[k] for k in sorted(entry) if k.startswith("msgstr")]
            out.append((entry.get("msgctxt"), entry["msgid"], entry.get("msgid_plural"), forms))
        entry.clear()

    for line in [*text.splitlines(), ""]:
        line = line.strip()
        if not line:
            done()
            last = None
            continue
        if line.startswith("#"):
            continue
        m = re.match(r'(msgctxt|msgid_plural|msgid|msgstr(?:\[\d+\])?)\s+(".*")$', line)
        if m:
            if m.group(1) in ("msgctxt", "msgid") and any(k.startswith("msgstr") for k in entry):
                done()
            last = m.group(1)
            entry[last] = ast.literal_eval(m.group(2))
        elif last and re.match(r'".*"$', line):
            entry[last] += ast.literal_eval(line)
    return out


def po_table(spark: SparkSession, text: str) -> DataFrame:
    """``context, msgid, plural, forms`` of a catalogue, without its header."""
    rows = [r for r in parse_po(text) if r[1] and any(r[3])]
    return spark.createDataFrame(rows, "context string, msgid string, plural string, forms array<string>")


def translate(rows: DataFrame, message: str, catalogue: DataFrame, context: str | None = None) -> DataFrame:
    """``rows`` with ``translated``; a message without a translation is itself."""
    own = catalogue.where(F.col("context").eqNullSafe(F.lit(context))).select(F.col("msgid").alias("_m"), F.col("forms")[0].alias("_t"))
    return rows.join(own, F.col(message) == F.col("_m"), "left").withColumn("translated", F.coalesce("_t", message)).drop("_m", "_t")


def plural(forms: Column, single: Column, many: Column, n: Column) -> Column:
    """ngettext for languages with two forms."""
    return F.coalesce(F.when(n == 1, F.get(forms, F.lit(0))).otherwise(F.get(forms, F.lit(1))), F.when(n == 1, single).otherwise(many))


def settings(lines: DataFrame, column: str = "value") -> DataFrame:
    """``section, key, value`` of INI lines given in order as ``(n, value)``."""
    from pyspark.sql import Window

    v = F.trim(column)
    rows = lines.withColumn("_s", F.when(v.rlike(r"^\[.*\]$"), F.regexp_extract(v, r"^\[(.*)\]$", 1)))
    rows = rows.withColumn("section", F.last("_s", ignorenulls=True).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    pairs = rows.where(v.rlike(r"^[^;#\[=]+="))
    return pairs.select("section", F.trim(F.regexp_extract(v, "^([^=]+)=", 1)).alias("key"), F.trim(F.regexp_extract(v, "^[^=]+=(.*)$", 1)).alias("value"))


def signature_table(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as (name, file type, signature) with their normal form, validity, and a regex where one will do."""
    made = [(n, t, s, search.normalize(s), search.is_valid(s), search.as_regex(s)) for n, t, s in rows]
    return spark.createDataFrame(made, "name string, file_type string, signature string, normal string, is_valid boolean, regex string")


def scan_signatures(contents: DataFrame, key: str, rules: list[tuple[str, str, str]], data: str = "content") -> DataFrame:
    """``(key, name, file_type)`` of every valid signature that fits: one pass over the contents for all rules."""
    good = [(n, t, s) for n, t, s in rules if search.is_valid(s)]
    hits = F.array(*[F.when(search.matches(F.col(data), s), F.struct(F.lit(n).alias("name"), F.lit(t).alias("file_type"))) for n, t, s in good])
    return contents.select(key, F.explode(F.array_compact(hits)).alias("h")).select(key, "h.*")
