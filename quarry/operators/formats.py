"""What scripts ask of a content, by type: executables, documents, images, bytecode.

Each function takes a BINARY column and gives a column; all are null or false
where the content is not of the type.
"""

from __future__ import annotations

import hashlib
import re
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import bytes as b
from quarry.functions.udf import per_value
from quarry.operators import layout

# ---- DOS and PE


def pe_header(data: Column) -> Column:
    """The COFF header behind a PE signature."""
    return b.bound(b.u32le(data, 0x3C), lambda at: F.when(b.part(data, at, 4) == b.literal("50450000"), layout.COFF.project(data, at + 4)))


def pe_sections(data: Column) -> Column:
    def sections(p: Column) -> Column:
        return F.when(p["n"].between(1, 96), F.filter(layout.SECTION.records(data, p["first"], p["n"]), lambda s: s.isNotNull()))

    def table(at: Column) -> Column:
        place = F.struct(b.u16le(data, at + 6).alias("n"), (at + 24 + b.u16le(data, at + 20)).alias("first"))
        return F.when(b.part(data, at, 4) == b.literal("50450000"), b.bound(place, sections))

    return b.bound(b.u32le(data, 0x3C), table)


def has_section(data: Column, name: str) -> Column:
    return F.coalesce(F.exists(pe_sections(data), lambda s: s["name"] == name), F.lit(False))


@per_value("array<struct<id:int,build:int,count:bigint>>")
def rich_header(data: bytes):
    """The linker's list of tools: pairs of a tool id with build, and a count, under one key."""
    end = data.find(b"Rich", 0x40, 0x1000)
    if end < 0 or end + 8 > len(data):
        return []
    key = struct.unpack_from("<I", data, end + 4)[0]
    words, at = [], end - 4
    while at >= 0x40:
        w = struct.unpack_from("<I", data, at)[0] ^ key
        if w == 0x536E6144:  # "DanS"
            break
        words.append(w)
        at -= 4
    else:
        return []
    words = words[::-1][3:]
    return [{"id": words[k] >> 16, "build": words[k] & 0xFFFF, "count": words[k + 1]} for k in range(0, len(words) - 1, 2)]


def rich_matches(rich: Column, tool: int, build: int | None = None) -> Column:
    """Whether a rich header names a tool, in any build or in one."""
    return F.exists(rich, lambda r: (r["id"] == tool) & (F.lit(True) if build is None else r["build"] == build))


def dos_stub(data: Column) -> Column:
    """Offset and size of the program between the DOS header and the extended one."""
    at, end = b.u16le(data, 8) * 16, b.u32le(data, 0x3C)
    return F.when(b.at(data, 0, "4D5A") & (end > at), F.struct(at.alias("offset"), (end - at).alias("size")))


def is_extended(data: Column, kind: str) -> Column:
    """NE, LE or LX."""
    at = b.u32le(data, 0x3C)
    return F.coalesce(b.at(data, 0, "4D5A") & (b.part(data, at, 2) == b.literal(kind.encode().hex().upper())), F.lit(False))


@per_value("array<struct<path:string,offset:bigint,size:bigint>>")
def pe_resources(data: bytes):
    """Leaves of the resource directory with absolute offsets, at most 65,536 of them."""
    try:
        pe = struct.unpack_from("<I", data, 0x3C)[0]
        if data[pe : pe + 4] != b"PE\0\0":
            return []
        n, optional = struct.unpack_from("<H", data, pe + 6)[0], struct.unpack_from("<H", data, pe + 20)[0]
        wide = struct.unpack_from("<H", data, pe + 24)[0] == 0x20B
        rva = struct.unpack_from("<I", data, pe + 24 + (112 if wide else 96) + 16)[0]
        sections = [struct.unpack_from("<8xIIII", data, pe + 24 + optional + 40 * k) for k in range(n)]

        def place(address: int) -> int:
            for size, va, raw, at in sections:
                if va <= address < va + max(size, raw):
                    return address - va + at
            raise ValueError

        root, out = place(rva), []

        def walk(at: int, path: tuple[str, ...]) -> None:
            named, ids = struct.unpack_from("<HH", data, at + 12)
            for k in range(named + ids):
                name, to = struct.unpack_from("<II", data, at + 16 + 8 * k)
                if name >> 31:
                    p = root + (name & 0x7FFFFFFF)
                    label = data[p + 2 : p + 2 + 2 * struct.unpack_from("<H", data, p)[0]].decode("utf-16-le", "replace")
                else:
                    label = str(name)
                if len(path) < 3 and len(out) < 65536:
                    if to >> 31:
                        walk(root + (to & 0x7FFFFFFF), (*path, label))
                    else:
                        where, size = struct.unpack_from("<II", data, root + to)
                        if place(where) + size <= len(data):
                            out.append({"path": "/".join((*path, label)), "offset": place(where), "size": size})

        if rva:
            walk(root, ())
        return out
    except (struct.error, ValueError, IndexError):
        return []


# ---- Mach-O


@per_value("struct<cpu:int,commands:int,sections:array<struct<segment:string,name:string,offset:bigint,size:bigint>>,libraries:array<struct<name:string,version:string>>>")
def mach_object(data: bytes):
    order = {b"\xfe\xed\xfa\xce": ">", b"\xce\xfa\xed\xfe": "<", b"\xfe\xed\xfa\xcf": ">", b"\xcf\xfa\xed\xfe": "<"}.get(data[:4])
    if not order:
        return None
    wide = b"\xcf" in data[:4]
    cpu, _, _, n = struct.unpack_from(order + "iIII", data, 4)
    at, sections, libraries = 32 if wide else 28, [], []
    text = lambda raw: raw.split(b"\0")[0].decode("latin-1")
    try:
        for _ in range(n):
            kind, size = struct.unpack_from(order + "II", data, at)
            if size < 8 or at + size > len(data):
                break
            if kind in (1, 0x19):
                count = struct.unpack_from(order + "I", data, at + (64 if kind == 0x19 else 48))[0]
                base, step = (at + 72, 80) if kind == 0x19 else (at + 56, 68)
                for k in range(count):
                    p = base + k * step
                    length, where = struct.unpack_from(order + ("8xQI" if kind == 0x19 else "4xII"), data, p + 32)
                    sections.append({"segment": text(data[p + 16 : p + 32]), "name": text(data[p : p + 16]), "offset": where, "size": length})
            elif kind & 0x7FFFFFFF in (0xC, 0x18, 0x1F):
                name, _, version = struct.unpack_from(order + "III", data, at + 8)
                libraries.append({"name": text(data[at + name : at + size]), "version": f"{version >> 16}.{version >> 8 & 255}.{version & 255}"})
            at += size
    except struct.error:
        pass
    return {"cpu": cpu, "commands": n, "sections": sections, "libraries": libraries}


# ---- ELF


@per_value("array<struct<name:string,type:bigint,offset:bigint,size:bigint>>")
def elf_sections(data: bytes):
    if data[:4] != b"\x7fELF" or len(data) < 52:
        return None
    order, wide = "<" if data[5] == 1 else ">", data[4] == 2
    try:
        at = struct.unpack_from(order + ("Q" if wide else "I"), data, 40 if wide else 32)[0]
        size, n, names = struct.unpack_from(order + "HHH", data, 58 if wide else 46)
        rows = [struct.unpack_from(order + ("IIQQQQ" if wide else "IIIIII"), data, at + k * size) for k in range(n)]
        base = rows[names][4]
        return [{"name": data[base + r[0] :].split(b"\0", 1)[0].decode("latin-1"), "type": r[1], "offset": r[4], "size": r[5]} for r in rows]
    except (struct.error, IndexError):
        return None


# ---- PDF

PDF_PARTS = 20


def pdf_values(data: Column, key: str, parts: int = PDF_PARTS) -> Column:
    """The values that follow ``/key``, at most ``parts`` of them."""
    found = F.regexp_extract_all(b.latin1(data), F.lit(rf"/{re.escape(key)}\s*(\([^)]*\)|<[0-9A-Fa-f\s]*>|\[[^\]]*\]|/?[^\s/<>\[\]()]+)"), F.lit(1))
    return F.slice(found, 1, parts)


def pdf_strings(data: Column, key: str) -> Column:
    """Those values that are strings, without their brackets."""
    return F.transform(F.filter(pdf_values(data, key), lambda v: v.startswith("(")), lambda v: F.substring(v, F.lit(2), F.length(v) - 2))


def pdf_values_are_hex(data: Column, key: str) -> Column:
    v = pdf_values(data, key)
    return (F.size(v) > 0) & F.forall(v, lambda x: x.rlike("^<[0-9A-Fa-f\\s]*>$"))


def pdf_is_encrypted(data: Column) -> Column:
    return b.latin1(data).rlike(r"/Encrypt\s+\d+\s+\d+\s+R")


def pdf_permissions(data: Column) -> Column:
    return F.regexp_extract(b.latin1(data), r"/P\s+(-?\d+)", 1).try_cast("bigint")


def pdf_header_comment(data: Column) -> Column:
    """The bytes of the comment after the version line, in hex."""
    comment = F.regexp_extract(b.latin1(data), r"(?s)\A%PDF-[^\r\n]*[\r\n]+%([^\r\n]*)", 1)
    return F.when(b.at(data, 0, "25504446"), F.lower(F.hex(F.encode(comment, "ISO-8859-1"))))


# ---- JPEG


@per_value("array<struct<marker:int,offset:bigint,size:int>>")
def jpeg_segments(data: bytes):
    if data[:2] != b"\xff\xd8":
        return None
    out, at = [], 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        out.append({"marker": marker, "offset": at + 4, "size": size - 2})
        at += 2 + size
        if marker == 0xDA:
            break
    return out


@per_value("string")
def jpeg_table_md5(data: bytes):
    """MD5 of all quantisation tables, in order."""
    segments = jpeg_segments.of(data)
    if segments is None:
        return None
    return hashlib.md5(b"".join(data[s["offset"] : s["offset"] + s["size"]] for s in segments if s["marker"] == 0xDB), usedforsecurity=False).hexdigest()


@per_value("string")
def jpeg_comment(data: bytes):
    for s in jpeg_segments.of(data) or ():
        if s["marker"] == 0xFE:
            return data[s["offset"] : s["offset"] + s["size"]].split(b"\0")[0].decode("utf-8", "replace")
    return None


@per_value("string")
def exif_camera(data: bytes):
    """The camera model of an Exif block."""
    for s in jpeg_segments.of(data) or ():
        raw = data[s["offset"] : s["offset"] + s["size"]]
        if s["marker"] == 0xE1 and raw[:6] == b"Exif\0\0":
            t = raw[6:]
            order = "<" if t[:2] == b"II" else ">"
            try:
                at = struct.unpack_from(order + "I", t, 4)[0]
                for k in range(struct.unpack_from(order + "H", t, at)[0]):
                    tag, _, n, where = struct.unpack_from(order + "HHII", t, at + 2 + 12 * k)
                    if tag == 0x110:
                        start = where if n > 4 else at + 2 + 12 * k + 8
                        return t[start : start + n].split(b"\0")[0].decode("latin-1")
            except struct.error:
                return None
    return None


# ---- DEX


@per_value("array<string>")
def dex_strings(data: bytes):
    if data[:4] != b"dex\n" or len(data) < 112:
        return None
    n, at = struct.unpack_from("<II", data, 56)
    out = []
    try:
        for k in range(n):
            p = struct.unpack_from("<I", data, at + 4 * k)[0]
            while data[p] & 128:
                p += 1
            end = data.index(b"\0", p + 1)
            out.append(data[p + 1 : end].replace(b"\xc0\x80", b"\0").decode("utf-8", "replace"))
    except (struct.error, IndexError, ValueError):
        return out
    return out


@per_value("string")
def dex_map_md5(data: bytes):
    """MD5 of the types in the map list, in order."""
    if data[:4] != b"dex\n" or len(data) < 112:
        return None
    try:
        at = struct.unpack_from("<I", data, 52)[0]
        kinds = [struct.unpack_from("<H", data, at + 4 + 12 * k)[0] for k in range(struct.unpack_from("<I", data, at)[0])]
    except struct.error:
        return None
    return hashlib.md5(struct.pack(f"<{len(kinds)}H", *kinds), usedforsecurity=False).hexdigest()


# ---- ISO 9660 and DEXA


def iso_identifier(data: Column, which: str) -> Column:
    """``application`` or ``preparer`` of the primary volume descriptor."""
    at = {"preparer": 446, "application": 574}[which]
    return F.when(b.at(data, 0x8001, "4344303031"), F.rtrim(b.latin1(b.part(data, 0x8000 + at, 128))))


@per_value("array<struct<index:int,palette:binary,pixels:binary>>")
def dexa_frames(data: bytes):
    """Frames of a DEXA video: key frames, XOR deltas, repeats, and palettes that stay until replaced."""
    import zlib

    if data[:4] != b"DEXA" or len(data) < 19:
        return None
    n, _, width, height = struct.unpack_from(">xHIHH", data, 4)
    at, palette, pixels, out = 15, None, None, []
    area = width * height
    try:
        for k in range(n):
            if data[at : at + 4] == b"CMAP":
                palette, at = data[at + 4 : at + 772], at + 772
                if len(palette) != 768:
                    return None
            elif data[at : at + 4] == b"NULL":
                at += 4
            else:
                return None
            tag = data[at : at + 4]
            if tag == b"FRAM":
                method, size = data[at + 4], struct.unpack_from(">I", data, at + 5)[0]
                raw = data[at + 9 : at + 9 + size]
                at += 9 + size
                got = zlib.decompress(raw)
                if len(raw) != size or len(got) != area or method not in (2, 3) or method == 3 and pixels is None:
                    return None
                pixels = got if method == 2 else bytes(x ^ y for x, y in zip(pixels, got, strict=True))
            elif tag == b"NULL" and pixels is not None:
                at += 4
            else:
                return None
            if palette is None:
                return None
            out.append({"index": k, "palette": palette, "pixels": pixels})
    except (zlib.error, struct.error, IndexError):
        return None
    return out if at == len(data) else None
