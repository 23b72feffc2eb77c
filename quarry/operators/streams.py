"""What a format publishes besides members: imports, exports, symbols, resources, metadata.

Each is a child table of the contents: one function parses a content into an
array of records, ``stream`` explodes it.  Sentinels of the formats become null.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.udf import per_value
from quarry.operators import formats

IMPORT = "array<struct<library:string,name:string,ordinal:int>>"
EXPORT = "array<struct<name:string,ordinal:int,address:bigint>>"
SYMBOL = "array<struct<name:string,address:bigint,size:bigint,kind:string>>"
METADATA = "array<struct<key:string,value:string>>"
LIMIT = 65_536


class _Pe:
    """Sections and directories of a PE content."""

    def __init__(self, data: bytes):
        at = struct.unpack_from("<I", data, 0x3C)[0]
        if data[at : at + 4] != b"PE\0\0":
            raise ValueError
        n, optional = struct.unpack_from("<H", data, at + 6)[0], struct.unpack_from("<H", data, at + 20)[0]
        self.data, self.wide = data, struct.unpack_from("<H", data, at + 24)[0] == 0x20B
        self.directories = at + 24 + (112 if self.wide else 96)
        self.sections = [struct.unpack_from("<8xIIII", data, at + 24 + optional + 40 * k) for k in range(n)]

    def directory(self, k: int) -> tuple[int, int]:
        return struct.unpack_from("<II", self.data, self.directories + 8 * k)

    def place(self, rva: int) -> int:
        for size, va, raw, at in self.sections:
            if va <= rva < va + max(size, raw):
                return rva - va + at
        raise ValueError

    def text(self, rva: int) -> str:
        at = self.place(rva)
        return self.data[at : self.data.index(b"\0", at)].decode("latin-1")


@per_value(IMPORT)
def pe_imports(data: bytes):
    try:
        pe, out = _Pe(data), []
        at = pe.place(pe.directory(1)[0])
        while any(row := struct.unpack_from("<5I", data, at)) and len(out) < LIMIT:
            library, thunk = pe.text(row[3]), pe.place(row[0] or row[4])
            form, top = ("<Q", 1 << 63) if pe.wide else ("<I", 1 << 31)
            while (value := struct.unpack_from(form, data, thunk)[0]) and len(out) < LIMIT:
                named = not value & top
                out.append({"library": library, "name": pe.text((value & 0x7FFFFFFF) + 2) if named else None, "ordinal": None if named else value & 0xFFFF})
                thunk += struct.calcsize(form)
            at += 20
        return out
    except (struct.error, ValueError):
        return []


@per_value(EXPORT)
def pe_exports(data: bytes):
    try:
        pe = _Pe(data)
        at = pe.place(pe.directory(0)[0])
        base, functions, names, to_functions, to_names, to_ordinals = struct.unpack_from("<6I", data, at + 16)
        name_of = {struct.unpack_from("<H", data, pe.place(to_ordinals) + 2 * k)[0]: pe.text(struct.unpack_from("<I", data, pe.place(to_names) + 4 * k)[0]) for k in range(min(names, LIMIT))}
        addresses = [struct.unpack_from("<I", data, pe.place(to_functions) + 4 * k)[0] for k in range(min(functions, LIMIT))]
        return [{"name": name_of.get(k), "ordinal": base + k, "address": a} for k, a in enumerate(addresses) if a]
    except (struct.error, ValueError):
        return []


_KINDS = {0: "none", 1: "object", 2: "function", 3: "section", 4: "file", 6: "tls"}


@per_value(SYMBOL)
def elf_symbols(data: bytes):
    """The symbol tables of an ELF content, static and dynamic."""
    if data[:4] != b"\x7fELF" or len(data) < 52:
        return []
    order, wide = "<" if data[5] == 1 else ">", data[4] == 2
    try:
        table = struct.unpack_from(order + ("Q" if wide else "I"), data, 40 if wide else 32)[0]
        width, n, _ = struct.unpack_from(order + "HHH", data, 58 if wide else 46)
        rows = [struct.unpack_from(order + ("IIQQQQIIQQ" if wide else "10I"), data, table + k * width) for k in range(n)]
        out = []
        for row in rows:
            if row[1] not in (2, 11):
                continue
            names, entry = rows[row[6]][4], 24 if wide else 16
            for k in range(1, min(row[5] // entry, LIMIT)):
                if wide:
                    name, info, _, _, address, size = struct.unpack_from(order + "IBBHQQ", data, row[4] + k * entry)
                else:
                    name, address, size, info, _, _ = struct.unpack_from(order + "IIIBBH", data, row[4] + k * entry)
                text = data[names + name : data.index(b"\0", names + name)].decode("latin-1")
                out.append({"name": text or None, "address": address or None, "size": size, "kind": _KINDS.get(info & 15, "other")})
        return out
    except (struct.error, ValueError, IndexError):
        return []


def _png_metadata(data: bytes) -> list[tuple[str, str]]:
    out, at = [], 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR" and size >= 13:
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            out += [("width", str(width)), ("height", str(height)), ("depth", str(depth)), ("colour", str(colour))]
        elif kind == b"tEXt" and b"\0" in body:
            out.append(tuple(x.decode("latin-1") for x in body.split(b"\0", 1)))
        elif kind == b"zTXt" and b"\0" in body:
            key, rest = body.split(b"\0", 1)
            try:
                out.append((key.decode("latin-1"), zlib.decompressobj().decompress(rest[1:], 1 << 20).decode("latin-1")))
            except zlib.error:
                pass
        at += 12 + size
    return out


def _wav_metadata(data: bytes) -> list[tuple[str, str]]:
    out, at = [], 12
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"fmt " and size >= 16 and at + 24 <= len(data):
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            out += [("format", str(form)), ("channels", str(channels)), ("rate", str(rate)), ("bits", str(bits))]
        at += 8 + size + size % 2
    return out


def _id3_metadata(data: bytes) -> list[tuple[str, str]]:
    size = sum((b & 127) << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
    at, end, out = 10, min(10 + size, len(data)), []
    while at + 10 <= end and data[at : at + 4].strip(b"\0"):
        kind, n = data[at : at + 4].decode("latin-1"), struct.unpack_from(">I", data, at + 4)[0]
        body = data[at + 10 : at + 10 + n]
        if kind[0] == "T" and body:
            codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            out.append((kind, body[1:].decode(codec, "replace").rstrip("\0")))
        at += 10 + n
    return out


def _gif_metadata(data: bytes) -> list[tuple[str, str]]:
    width, height = struct.unpack_from("<HH", data, 6)
    return [("width", str(width)), ("height", str(height)), ("version", data[3:6].decode("latin-1"))]


_METADATA: tuple[tuple[bytes, Callable[[bytes], list[tuple[str, str]]]], ...] = ((b"\x89PNG", _png_metadata), (b"RIFF", _wav_metadata), (b"ID3", _id3_metadata), (b"GIF8", _gif_metadata))


@per_value(METADATA)
def metadata(data: bytes):
    """Key and value pairs of images and sounds."""
    for magic, read in _METADATA:
        if data.startswith(magic):
            try:
                return [{"key": k, "value": v} for k, v in read(data)]
            except (struct.error, ValueError):
                return []
    return []


STREAMS: dict[str, Callable[[Column], Column]] = {"imports": pe_imports, "exports": pe_exports, "symbols": elf_symbols, "resources": formats.pe_resources, "metadata": metadata, "sections": formats.elf_sections}


def stream(contents: DataFrame, kind: str, key: str, data: str = "content") -> DataFrame:
    """One row for each record that contents publish."""
    return contents.select(key, F.explode(STREAMS[kind](F.col(data))).alias("r")).select(key, "r.*")


def facts(contents: DataFrame, key: str, data: str = "content") -> DataFrame:
    """Metadata as one row a content: maps of the numbers and of the texts."""
    rows = stream(contents, "metadata", key, data).withColumn("n", F.col("value").try_cast("bigint"))
    numbers = F.map_from_entries(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("key", "n"))))
    texts = F.map_from_entries(F.collect_list(F.when(F.col("n").isNull(), F.struct("key", "value"))))
    return rows.groupBy(key).agg(numbers.alias("numbers"), texts.alias("texts"))
