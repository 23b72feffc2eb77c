"""Printable strings in binary content.

ASCII runs are a regular expression in the JVM where only the texts are wanted;
with offsets, and for UTF-8 and UTF-16, an Arrow UDF returns the records of a
row, to be exploded.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.bytes import latin1
from quarry.functions.udf import per_value

RECORD = "array<struct<offset:bigint,byte_size:bigint,characters:bigint,encoding:string,text:string,truncated:boolean>>"
ASCII, UTF8, UTF16LE, UTF16BE = "ASCII", "UTF8", "UTF16LE", "UTF16BE"
MAX_TEXT = 1 << 20


def ascii_texts(data: Column, minimum: int = 4) -> Column:
    """The runs of at least ``minimum`` printable ASCII bytes, in order."""
    return F.regexp_extract_all(latin1(data), F.lit(rf"[\x20-\x7E]{{{minimum},}}"), F.lit(0))


def _printable(c: str) -> bool:
    return c == " " or unicodedata.category(c)[0] not in "CZ"


def _runs(chars, minimum: int):
    """(first, end, text) of runs among (position, end, character or None) triples."""
    first, end, text = None, 0, []
    for at, stop, c in chars:
        if c is not None and _printable(c):
            first = at if first is None else first
            end = stop
            text.append(c)
        elif first is not None:
            if len(text) >= minimum:
                yield first, end, "".join(text)
            first, text = None, []
    if first is not None and len(text) >= minimum:
        yield first, end, "".join(text)


def _utf8_chars(data: bytes):
    at = 0
    while at < len(data):
        b = data[at]
        n = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        try:
            c = data[at : at + n].decode() if n else None
        except UnicodeDecodeError:
            c = None
        step = n if c else 1
        yield at, at + step, c
        at += step


def _utf16_chars(data: bytes, order: str, start: int):
    at = start
    while at + 2 <= len(data):
        u = int.from_bytes(data[at : at + 2], order)
        if 0xD800 <= u < 0xDC00 and at + 4 <= len(data) and 0xDC00 <= (v := int.from_bytes(data[at + 2 : at + 4], order)) < 0xE000:
            yield at, at + 4, chr(0x10000 + ((u - 0xD800) << 10) + v - 0xDC00)
            at += 4
        else:
            yield at, at + 2, chr(u) if not 0xD800 <= u < 0xE000 else None
            at += 2


def find_strings(data: bytes, minimum: int = 4, encodings: tuple[str, ...] = (ASCII,), offset: int = 0, length: int = -1, max_text: int = MAX_TEXT, wide_needs_ascii: bool = False) -> list[dict]:
    """String records of a content, by offset and encoding.  Both UTF-16 alignments are scanned.

    ``wide_needs_ascii`` keeps a UTF-16 run only with a byte order mark before it
    or ``minimum`` ASCII characters in a row, against chance hits.
    """
    part = data[offset : None if length < 0 else offset + length]
    found = []
    for enc in encodings:
        if enc == ASCII:
            runs = [(m.start(), m.end(), m.group().decode()) for m in re.finditer(rb"[\x20-\x7e]{%d,}" % minimum, part)]
        elif enc == UTF8:
            runs = list(_runs(_utf8_chars(part), minimum))
        else:
            order = "little" if enc == UTF16LE else "big"
            runs = [r for start in (0, 1) for r in _runs(_utf16_chars(part, order, start), minimum)]
            if wide_needs_ascii:
                mark = b"\xff\xfe" if enc == UTF16LE else b"\xfe\xff"
                runs = [r for r in runs if part[max(0, r[0] - 2) : r[0]] == mark or re.search(r"[\x20-\x7e]{%d,}" % minimum, r[2])]
        for first, end, text in runs:
            raw = text.encode()
            found.append({"offset": offset + first, "byte_size": end - first, "characters": len(text), "encoding": enc, "text": raw[:max_text].decode("utf-8", "ignore"), "truncated": len(raw) > max_text})
    return sorted(found, key=lambda r: (r["offset"], r["encoding"]))


def strings(data: Column, minimum: int = 4, encodings: tuple[str, ...] = (ASCII,), **options) -> Column:
    """An array of string records; see ``find_strings``."""

    @per_value(RECORD)
    def run(content: bytes):
        return find_strings(content, minimum, encodings, **options)

    return run(data)


def scan_strings(contents: DataFrame, key: str, data: str = "content", **options) -> DataFrame:
    """One row for each string of each content."""
    return contents.select(key, F.explode(strings(F.col(data), **options)).alias("s")).select(key, "s.*")
