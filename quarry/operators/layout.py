"""Declared byte layouts as nested columns.

A layout is a list of fields; the record is cut out of the content once, and each
field becomes an expression over its bytes or their hex digits.  A field's place
follows from the sizes before it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import bytes as b
from quarry.functions.transforms import octal_field

ID, VA, OFFSET, SIZE, COUNT, POINTER, FLAGS, TIMESTAMP, STRING, RESERVED, SIGNATURE, CHECKSUM = (1 << k for k in range(12))


@dataclass(frozen=True)
class Field:
    """A field: name, kind (u8, u16 ... u64, i8 ... i64, bytes, char, octal), byte count, byte order, role."""

    name: str
    kind: str
    length: int = 0
    big: bool = False
    role: int = 0
    display: Callable[[Column], Column] | None = None

    @property
    def width(self) -> int:
        return self.length or int(self.kind[1:]) // 8

    def read(self, record: Column, digits: Column, at: int) -> Column:
        """The value at a place of a record, of which there are also the hex digits."""
        raw = F.substring(record, at + 1, self.width)
        if self.kind == "bytes":
            return raw
        if self.kind == "char":  # up to the first zero
            return F.substring_index(b.latin1(raw), "\u0000", 1)
        if self.kind == "octal":
            return octal_field(raw, 0, self.width)
        value = b.unsigned_digits(digits, at, self.width, self.big)
        return b.as_signed(value, self.width) if self.kind[0] == "i" else value


@dataclass(frozen=True)
class Layout:
    """A named record of fields with a guard that says whether a content has it."""

    name: str
    fields: tuple[Field, ...]
    guard: Callable[[Column, Column], Column] | None = None

    @property
    def size(self) -> int:
        return sum(f.width for f in self.fields)

    def offsets(self) -> dict[str, int]:
        out, at = {}, 0
        for f in self.fields:
            out[f.name] = at
            at += f.width
        return out

    def project(self, data: Column, at: Column | int = 0) -> Column:
        """A struct of all fields; null where the record is not wholly inside or its guard fails."""
        offsets, record = self.offsets(), b.part(data, at, self.size)
        if self.guard is not None:
            record = F.when(self.guard(data, at), record)

        def fields(r: Column) -> Column:
            return F.when(r["record"].isNotNull(), F.struct(*[f.read(r["record"], r["digits"], offsets[f.name]).alias(f.name) for f in self.fields]))

        return b.bound(record, lambda x: b.bound(F.struct(x.alias("record"), F.hex(x).alias("digits")), fields))

    def shown(self, data: Column, at: Column | int = 0) -> Column:
        """A struct of all fields as texts: bytes in hex, numbers in decimal, and what a field's ``display`` makes of its value."""

        def text(f: Field, value: Column) -> Column:
            if f.display is not None:
                return f.display(value).cast("string")
            return F.hex(value) if f.kind == "bytes" else value.cast("string")

        return b.bound(self.project(data, at), lambda row: F.when(row.isNotNull(), F.struct(*[text(f, row[f.name]).alias(f.name) for f in self.fields])))

    def records(self, data: Column, at: Column | int, count: Column) -> Column:
        """An array of ``count`` records that follow each other."""

        def rows(p: Column) -> Column:
            return F.when(p["n"] > 0, F.transform(F.sequence(F.lit(0), (p["n"] - 1).cast("int")), lambda i: self.project(data, p["at"] + i * self.size))).otherwise(F.array())

        return b.bound(F.struct((F.lit(at) if isinstance(at, int) else at).alias("at"), count.alias("n")), rows)

    def field_rows(self, data: Column, at: Column | int = 0) -> Column:
        """An array of (name, type, offset, size, role, raw), one for each field, for a generic view."""
        at = F.lit(at) if isinstance(at, int) else at
        offsets = self.offsets()
        return F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.kind).alias("type"), (at + offsets[f.name]).cast("bigint").alias("offset"), F.lit(f.width).alias("size"), F.lit(f.role).alias("role"), b.part(data, at + offsets[f.name], f.width).alias("raw")) for f in self.fields])


def _starts(hexes: str):
    return lambda data, at: b.part(data, at, len(hexes) // 2) == b.literal(hexes)


GZIP = Layout("gzip_header", (Field("id", "bytes", 2, role=SIGNATURE), Field("method", "u8", 1), Field("flags", "u8", 1, role=FLAGS), Field("mtime", "u32", 4, role=TIMESTAMP), Field("extra_flags", "u8", 1), Field("os", "u8", 1)), _starts("1F8B"))
TAR = Layout(
    "tar_header",
    (
        Field("name", "char", 100, role=STRING), Field("mode", "octal", 8, role=FLAGS), Field("uid", "octal", 8, role=ID), Field("gid", "octal", 8, role=ID), Field("size", "octal", 12, role=SIZE),
        Field("mtime", "octal", 12, role=TIMESTAMP), Field("checksum", "octal", 8, role=CHECKSUM), Field("typeflag", "char", 1), Field("linkname", "char", 100, role=STRING), Field("magic", "char", 6, role=SIGNATURE),
        Field("version", "bytes", 2), Field("uname", "char", 32, role=STRING), Field("gname", "char", 32, role=STRING), Field("devmajor", "octal", 8), Field("devminor", "octal", 8), Field("prefix", "char", 155, role=STRING), Field("padding", "bytes", 12, role=RESERVED),
    ),
    lambda data, at: b.part(data, at + 257, 5) == b.literal("7573746172"),
)
AR_MEMBER = Layout("ar_member", (Field("name", "char", 16, role=STRING), Field("date", "char", 12, role=TIMESTAMP), Field("uid", "char", 6, role=ID), Field("gid", "char", 6, role=ID), Field("mode", "char", 8), Field("size", "char", 10, role=SIZE), Field("end", "bytes", 2, role=SIGNATURE)), lambda data, at: b.part(data, at + 58, 2) == b.literal("600A"))
BZIP2 = Layout("bzip2_header", (Field("id", "bytes", 3, role=SIGNATURE), Field("level", "char", 1), Field("block_id", "bytes", 6, role=SIGNATURE), Field("block_crc", "u32", 4, True, role=CHECKSUM)), _starts("425A68"))
ZIP_LOCAL = Layout("zip_local", (Field("id", "bytes", 4, role=SIGNATURE), Field("version", "u16", 2), Field("flags", "u16", 2, role=FLAGS), Field("method", "u16", 2), Field("time", "u16", 2), Field("date", "u16", 2), Field("crc32", "u32", 4, role=CHECKSUM), Field("compressed", "u32", 4, role=SIZE), Field("uncompressed", "u32", 4, role=SIZE), Field("name_length", "u16", 2, role=SIZE), Field("extra_length", "u16", 2, role=SIZE)), _starts("504B0304"))
DOS = Layout("dos_header", (Field("e_magic", "char", 2, role=SIGNATURE), *[Field(n, "u16", 2) for n in ("e_cblp", "e_cp", "e_crlc", "e_cparhdr", "e_minalloc", "e_maxalloc", "e_ss", "e_sp", "e_csum", "e_ip", "e_cs", "e_lfarlc", "e_ovno")], Field("e_res", "bytes", 8, role=RESERVED), Field("e_oemid", "u16", 2), Field("e_oeminfo", "u16", 2), Field("e_res2", "bytes", 20, role=RESERVED), Field("e_lfanew", "u32", 4, role=OFFSET)), _starts("4D5A"))
COFF = Layout("coff_header", (Field("machine", "u16", 2), Field("sections", "u16", 2, role=COUNT), Field("timestamp", "u32", 4, role=TIMESTAMP), Field("symbols_at", "u32", 4, role=POINTER), Field("symbols", "u32", 4, role=COUNT), Field("optional_size", "u16", 2, role=SIZE), Field("characteristics", "u16", 2, role=FLAGS)))
SECTION = Layout("section_header", (Field("name", "char", 8, role=STRING), Field("virtual_size", "u32", 4, role=SIZE), Field("virtual_address", "u32", 4, role=VA), Field("raw_size", "u32", 4, role=SIZE), Field("raw_at", "u32", 4, role=OFFSET), Field("relocations_at", "u32", 4, role=POINTER), Field("lines_at", "u32", 4, role=POINTER), Field("relocations", "u16", 2, role=COUNT), Field("lines", "u16", 2, role=COUNT), Field("characteristics", "u32", 4, role=FLAGS)))
ELF64 = Layout("elf64_header", (Field("ident", "bytes", 16, role=SIGNATURE), Field("type", "u16", 2), Field("machine", "u16", 2), Field("version", "u32", 4), Field("entry", "u64", 8, role=VA), Field("ph_at", "u64", 8, role=OFFSET), Field("sh_at", "u64", 8, role=OFFSET), Field("flags", "u32", 4, role=FLAGS), Field("eh_size", "u16", 2, role=SIZE), Field("ph_size", "u16", 2, role=SIZE), Field("ph_count", "u16", 2, role=COUNT), Field("sh_size", "u16", 2, role=SIZE), Field("sh_count", "u16", 2, role=COUNT), Field("sh_names", "u16", 2)), _starts("7F454C46"))
BMP = Layout("bmp_header", (Field("id", "char", 2, role=SIGNATURE), Field("file_size", "u32", 4, role=SIZE), Field("reserved", "u32", 4, role=RESERVED), Field("pixels_at", "u32", 4, role=OFFSET), Field("info_size", "u32", 4, role=SIZE), Field("width", "i32", 4), Field("height", "i32", 4), Field("planes", "u16", 2), Field("bits", "u16", 2), Field("compression", "u32", 4)), _starts("424D"))
WAV = Layout("wav_header", (Field("riff", "char", 4, role=SIGNATURE), Field("size", "u32", 4, role=SIZE), Field("wave", "char", 4, role=SIGNATURE), Field("fmt", "char", 4), Field("fmt_size", "u32", 4, role=SIZE), Field("format", "u16", 2), Field("channels", "u16", 2), Field("rate", "u32", 4), Field("bytes_a_second", "u32", 4), Field("block", "u16", 2), Field("bits", "u16", 2)), _starts("52494646"))
DBF = Layout("dbf_header", (Field("version", "u8", 1), Field("year", "u8", 1), Field("month", "u8", 1), Field("day", "u8", 1), Field("records", "u32", 4, role=COUNT), Field("header_size", "u16", 2, role=SIZE), Field("record_size", "u16", 2, role=SIZE), Field("reserved", "bytes", 20, role=RESERVED)))
NE = Layout("ne_header", (Field("id", "char", 2, role=SIGNATURE), Field("linker", "u8", 1), Field("linker_minor", "u8", 1), Field("entry_at", "u16", 2, role=OFFSET), Field("entry_size", "u16", 2, role=SIZE), Field("crc", "u32", 4, role=CHECKSUM), Field("flags", "u16", 2, role=FLAGS), Field("auto_data", "u16", 2), Field("heap", "u16", 2, role=SIZE), Field("stack", "u16", 2, role=SIZE), Field("cs_ip", "u32", 4, role=POINTER), Field("ss_sp", "u32", 4, role=POINTER), Field("segments", "u16", 2, role=COUNT), Field("modules", "u16", 2, role=COUNT)), _starts("4E45"))
LE = Layout("le_header", (Field("id", "char", 2, role=SIGNATURE), Field("byte_order", "u8", 1), Field("word_order", "u8", 1), Field("level", "u32", 4), Field("cpu", "u16", 2), Field("os", "u16", 2), Field("module_version", "u32", 4), Field("module_flags", "u32", 4, role=FLAGS), Field("pages", "u32", 4, role=COUNT)), _starts("4C45"))
MACHO = Layout("mach_header", (Field("magic", "u32", 4, role=SIGNATURE), Field("cpu", "i32", 4), Field("subtype", "i32", 4), Field("type", "u32", 4), Field("commands", "u32", 4, role=COUNT), Field("commands_size", "u32", 4, role=SIZE), Field("flags", "u32", 4, role=FLAGS)))
CLASS = Layout("java_class", (Field("magic", "u32", 4, True, SIGNATURE), Field("minor", "u16", 2, True), Field("major", "u16", 2, True), Field("constants", "u16", 2, True, COUNT)), _starts("CAFEBABE"))
DEX = Layout("dex_header", (Field("magic", "bytes", 8, role=SIGNATURE), Field("checksum", "u32", 4, role=CHECKSUM), Field("sha1", "bytes", 20, role=CHECKSUM), Field("file_size", "u32", 4, role=SIZE), Field("header_size", "u32", 4, role=SIZE), Field("endian", "u32", 4), Field("link_size", "u32", 4, role=SIZE), Field("link_at", "u32", 4, role=OFFSET), Field("map_at", "u32", 4, role=OFFSET), Field("strings", "u32", 4, role=COUNT), Field("strings_at", "u32", 4, role=OFFSET)), _starts("6465780A"))
PNG_HEADER = Layout("png_header", (Field("signature", "bytes", 8, role=SIGNATURE), Field("size", "u32", 4, True, SIZE), Field("type", "char", 4), Field("width", "u32", 4, True), Field("height", "u32", 4, True), Field("depth", "u8", 1), Field("colour", "u8", 1), Field("compression", "u8", 1), Field("filter", "u8", 1), Field("interlace", "u8", 1)), _starts("89504E470D0A1A0A"))
GIF = Layout("gif_header", (Field("id", "char", 6, role=SIGNATURE), Field("width", "u16", 2), Field("height", "u16", 2), Field("flags", "u8", 1, role=FLAGS), Field("background", "u8", 1), Field("aspect", "u8", 1)), _starts("474946"))
FLAC_INFO = Layout("flac_stream_info", (Field("id", "char", 4, role=SIGNATURE), Field("block", "u32", 4, True), Field("least_block", "u16", 2, True), Field("most_block", "u16", 2, True), Field("least_frame", "bytes", 3), Field("most_frame", "bytes", 3), Field("packed", "u64", 8, True), Field("md5", "bytes", 16, role=CHECKSUM)), _starts("664C6143"))
SQLITE = Layout("sqlite_header", (Field("magic", "char", 16, role=SIGNATURE), Field("page_size", "u16", 2, True, SIZE), Field("write_version", "u8", 1), Field("read_version", "u8", 1), Field("reserved", "u8", 1, role=RESERVED), Field("fractions", "bytes", 3), Field("changes", "u32", 4, True, COUNT), Field("pages", "u32", 4, True, COUNT)), _starts("53514C69746520666F726D6174203300"))
CAB = Layout("cab_header", (Field("id", "char", 4, role=SIGNATURE), Field("reserved1", "u32", 4, role=RESERVED), Field("size", "u32", 4, role=SIZE), Field("reserved2", "u32", 4, role=RESERVED), Field("files_at", "u32", 4, role=OFFSET), Field("reserved3", "u32", 4, role=RESERVED), Field("minor", "u8", 1), Field("major", "u8", 1), Field("folders", "u16", 2, role=COUNT), Field("files", "u16", 2, role=COUNT), Field("flags", "u16", 2, role=FLAGS), Field("set", "u16", 2, role=ID), Field("number", "u16", 2)), _starts("4D534346"))
WAD = Layout("wad_header", (Field("id", "char", 4, role=SIGNATURE), Field("lumps", "u32", 4, role=COUNT), Field("directory_at", "u32", 4, role=OFFSET)))
PCAP = Layout("pcap_header", (Field("magic", "u32", 4, role=SIGNATURE), Field("major", "u16", 2), Field("minor", "u16", 2), Field("zone", "i32", 4), Field("accuracy", "u32", 4), Field("snap_length", "u32", 4, role=SIZE), Field("link", "u32", 4)), _starts("D4C3B2A1"))
MBR_ENTRY = Layout("mbr_entry", (Field("active", "u8", 1, role=FLAGS), Field("first_chs", "bytes", 3), Field("type", "u8", 1), Field("last_chs", "bytes", 3), Field("first_sector", "u32", 4, role=OFFSET), Field("sectors", "u32", 4, role=COUNT)))
FAT_BOOT = Layout("fat_boot", (Field("jump", "bytes", 3), Field("oem", "char", 8), Field("sector", "u16", 2, role=SIZE), Field("cluster", "u8", 1), Field("reserved", "u16", 2, role=COUNT), Field("fats", "u8", 1, role=COUNT), Field("root_entries", "u16", 2, role=COUNT), Field("sectors", "u16", 2, role=COUNT), Field("media", "u8", 1), Field("fat_sectors", "u16", 2, role=SIZE)))
EXT_SUPER = Layout("ext_super", (Field("inodes", "u32", 4, role=COUNT), Field("blocks", "u32", 4, role=COUNT), Field("reserved", "u32", 4, role=COUNT), Field("free_blocks", "u32", 4, role=COUNT), Field("free_inodes", "u32", 4, role=COUNT), Field("first_block", "u32", 4), Field("block_shift", "u32", 4)))
ELF32 = Layout("elf32_header", (Field("ident", "bytes", 16, role=SIGNATURE), Field("type", "u16", 2), Field("machine", "u16", 2), Field("version", "u32", 4), Field("entry", "u32", 4, role=VA), Field("ph_at", "u32", 4, role=OFFSET), Field("sh_at", "u32", 4, role=OFFSET), Field("flags", "u32", 4, role=FLAGS), Field("eh_size", "u16", 2, role=SIZE), Field("ph_size", "u16", 2, role=SIZE), Field("ph_count", "u16", 2, role=COUNT), Field("sh_size", "u16", 2, role=SIZE), Field("sh_count", "u16", 2, role=COUNT), Field("sh_names", "u16", 2)), _starts("7F454C4601"))


def from_spec(name: str, fields: list[dict], magic: str | None = None) -> Layout:
    """A layout declared as data: dictionaries with name, kind, and optionally length, big, role; pads have no name."""
    made = tuple(Field(f.get("name") or f"_pad{k}", f["kind"], f.get("length", 0), f.get("big", False), f.get("role", 0)) for k, f in enumerate(fields))
    return Layout(name, made, _starts(magic) if magic else None)


LAYOUTS = {x.name: x for x in (GZIP, TAR, AR_MEMBER, BZIP2, ZIP_LOCAL, DOS, COFF, SECTION, ELF64, BMP, WAV, DBF, NE, LE, MACHO, CLASS, DEX, PNG_HEADER, GIF, FLAC_INFO, SQLITE, CAB, WAD, PCAP, MBR_ENTRY, FAT_BOOT, EXT_SUPER, ELF32)}
