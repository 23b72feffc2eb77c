"""Content types: a table of signature rules, a ladder of structural checks, and a choice by priority.

Rules are rows.  Joining contents with them is an equi-join: each content gives
one probe for each distinct (offset, length) of the rule table, and the probes
meet the rules on (offset, length, bytes), so the cost does not grow with the
number of rules.  The rule table is small by construction and its size is
checked before it is broadcast.  Every other check is an expression over the
content's first bytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import bytes as b
from quarry.functions.udf import per_value

#: Well-known signatures: type, family, offset, bytes, priority (the lower is tried first).
RULES = (
    ("PNG", "image", 0, "89504E470D0A1A0A", 10),
    ("JPEG", "image", 0, "FFD8FF", 10),
    ("GIF", "image", 0, "474946383961", 10),
    ("GIF", "image", 0, "474946383761", 10),
    ("TIFF", "image", 0, "49492A00", 10),
    ("TIFF", "image", 0, "4D4D002A", 10),
    ("BMP", "image", 0, "424D", 80),
    ("ICO", "image", 0, "00000100", 85),
    ("PSD", "image", 0, "38425053", 10),
    ("WEBP", "image", 8, "57454250", 15),
    ("PDF", "document", 0, "25504446", 10),
    ("RTF", "document", 0, "7B5C727466", 10),
    ("CFBF", "document", 0, "D0CF11E0A1B11AE1", 10),
    ("PS", "document", 0, "25215053", 20),
    ("DJVU", "document", 0, "41542654464F524D", 10),
    ("ZIP", "archive", 0, "504B0304", 20),
    ("ZIP", "archive", 0, "504B0506", 20),
    ("GZIP", "archive", 0, "1F8B08", 20),
    ("BZIP2", "archive", 0, "425A68", 30),
    ("XZ", "archive", 0, "FD377A585A00", 10),
    ("7ZIP", "archive", 0, "377ABCAF271C", 10),
    ("RAR", "archive", 0, "526172211A0700", 10),
    ("RAR5", "archive", 0, "526172211A070100", 5),
    ("ZSTD", "archive", 0, "28B52FFD", 20),
    ("LZ4", "archive", 0, "04224D18", 20),
    ("LZIP", "archive", 0, "4C5A4950", 20),
    ("LZMA", "archive", 0, "5D000080", 60),
    ("COMPRESS", "archive", 0, "1F9D", 50),
    ("CAB", "archive", 0, "4D53434600000000", 10),
    ("AR", "archive", 0, "213C617263683E0A", 10),
    ("CPIO_NEWC", "archive", 0, "303730373031", 20),
    ("CPIO_ODC", "archive", 0, "303730373037", 20),
    ("TAR", "archive", 257, "7573746172", 20),
    ("ARJ", "archive", 0, "60EA", 70),
    ("ACE", "archive", 7, "2A2A4143452A2A", 10),
    ("SZDD", "archive", 0, "535A444488F02733", 10),
    ("WARC", "archive", 0, "574152432F", 20),
    ("XAR", "archive", 0, "78617221", 20),
    ("ELF", "executable", 0, "7F454C46", 20),
    ("MSDOS", "executable", 0, "4D5A", 90),
    ("MACHO", "executable", 0, "FEEDFACE", 20),
    ("MACHO", "executable", 0, "CEFAEDFE", 20),
    ("MACHO", "executable", 0, "FEEDFACF", 20),
    ("MACHO", "executable", 0, "CFFAEDFE", 20),
    ("DEX", "executable", 0, "6465780A", 20),
    ("WASM", "executable", 0, "0061736D", 20),
    ("LUA", "executable", 0, "1B4C7561", 20),
    ("ISO9660", "filesystem", 32769, "4344303031", 20),
    ("EXT", "filesystem", 1080, "53EF", 60),
    ("SQUASHFS", "filesystem", 0, "68737173", 20),
    ("SQLITE", "database", 0, "53514C69746520666F726D6174203300", 5),
    ("DBF", "database", 0, "03", 99),
    ("PARQUET", "database", 0, "50415231", 20),
    ("ORC", "database", 0, "4F5243", 40),
    ("AVRO", "database", 0, "4F626A01", 20),
    ("WAV", "audio", 8, "57415645", 15),
    ("AIFF", "audio", 8, "41494646", 15),
    ("FLAC", "audio", 0, "664C6143", 10),
    ("OGG", "audio", 0, "4F676753", 10),
    ("MP3_ID3", "audio", 0, "494433", 30),
    ("MIDI", "audio", 0, "4D546864", 10),
    ("AVI", "video", 8, "41564920", 15),
    ("MP4", "video", 4, "66747970", 20),
    ("MKV", "video", 0, "1A45DFA3", 20),
    ("FLV", "video", 0, "464C5601", 20),
    ("TTF", "font", 0, "0001000000", 40),
    ("OTF", "font", 0, "4F54544F", 20),
    ("WOFF", "font", 0, "774F4646", 20),
    ("WOFF2", "font", 0, "774F4632", 20),
    ("HTML", "document", 0, "3C21444F4354595045", 60),
    ("HTML", "document", 0, "3C68746D6C", 60),
    ("XML", "document", 0, "3C3F786D6C", 60),
    ("FASTA", "science", 0, "3E", 99),
    ("HDF5", "science", 0, "894844460D0A1A0A", 10),
    ("FITS", "science", 0, "53494D504C4520203D", 10),
)
RULE_SCHEMA = "file_type string, family string, offset int, magic binary, priority int"
UNKNOWN = "BINARY"
#: Rules beyond this many bytes are joined without a broadcast.
BROADCAST_BYTES = 8 << 20


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(t, f, o, bytearray.fromhex(h), p) for t, f, o, h, p in rules], RULE_SCHEMA)


def match_rules(contents: DataFrame, rules: DataFrame, key: str, data: str = "content") -> DataFrame:
    """``(key, file_type, family, offset, priority)`` for every rule that fits a content."""
    shapes = sorted((r["offset"], r["n"], r["b"]) for r in rules.groupBy("offset", F.octet_length("magic").alias("n")).agg(F.count("*").alias("b")).collect())
    probes = F.array(*[F.struct(F.lit(o).alias("offset"), F.substring(F.col(data), o + 1, n).alias("magic")) for o, n, _ in shapes])
    probed = contents.select(key, F.explode(probes).alias("p")).select(key, "p.offset", "p.magic")
    small = sum(n * k for _, n, k in shapes) + 64 * sum(k for *_, k in shapes) <= BROADCAST_BYTES
    return probed.join(F.broadcast(rules) if small else rules, ["offset", "magic"]).select(key, "file_type", "family", "offset", "priority")


def best_type(matched: DataFrame, key: str) -> DataFrame:
    """One row for each key: the type with the least priority, ties by name."""
    return matched.groupBy(key).agg(F.min_by(F.struct("file_type", "family"), F.struct("priority", "file_type")).alias("t")).select(key, "t.file_type", "t.family")


def pe_type(data: Column) -> Column:
    """PE32, PE64 or null: the header offset is at most 1 MiB and its magic is there."""
    o = b.u32le(data, 0x3C)

    def kind(head: Column) -> Column:
        magic = F.substring(head, 25, 2)
        return F.when(b.at(head, 0, "50450000"), F.when(magic == b.literal("0B01"), "PE32").when(magic == b.literal("0B02"), "PE64"))

    return F.when(o <= 1 << 20, b.bound(b.part(data, o, 26), kind))


def elf_type(data: Column) -> Column:
    elf = (b.size(data) >= 16) & b.at(data, 0, "7F454C46")
    return F.when(elf & (b.u8(data, 4) == 1), "ELF32").when(elf & (b.u8(data, 4) == 2), "ELF64")


def mach_type(data: Column) -> Column:
    narrow = b.at(data, 0, "FEEDFACE") | b.at(data, 0, "CEFAEDFE")
    wide = b.at(data, 0, "FEEDFACF") | b.at(data, 0, "CFFAEDFE")
    return F.when(narrow & (b.size(data) >= 28), "MACHO32").when(wide & (b.size(data) >= 32), "MACHO64")


def _slice_check(data: Column, n: Column, record: int, big: bool, wide: bool):
    """How to read a record of a fat header, and whether it names a slice behind the table, aligned and inside the file."""
    width = 8 if wide else 4

    def read(i: Column) -> Column:
        row = F.substring(data, i * record + 9, F.lit(record))
        return F.struct(b.unsigned(row, 0, 4, big).alias("cpu"), b.unsigned(row, 8, width, big).alias("offset"), b.unsigned(row, 8 + width, width, big).alias("size"), b.unsigned(row, 8 + 2 * width, 4, big).alias("align"))

    def good(r: Column) -> Column:
        offset, align = r["offset"], r["align"]
        inside = (offset >= 8 + record * n) & (offset + r["size"] <= b.size(data))
        aligned = (align <= 63) & (offset % F.pow(F.lit(2.0), F.least(align, F.lit(63)).cast("double")).cast("decimal(20,0)") == 0)
        return (r["cpu"] != 0) & (r["size"] >= 4) & aligned & inside & F.hex(F.substring(data, (offset + 1).try_cast("int"), F.lit(4))).isin("FEEDFACE", "CEFAEDFE", "FEEDFACF", "CFFAEDFE")

    return read, good


def fat_type(data: Column) -> Column:
    """A fat Mach-O, each of whose 1 to 4,096 slices lies behind the table, aligned, and holds a Mach-O."""

    def kind(magics: tuple[str, str], record: int, wide: bool, name: str) -> Column:
        out = F.lit(None).cast("string")
        for k, magic in enumerate(magics):
            big = k == 0
            n = b.unsigned(data, 4, 4, big)
            fits = b.at(data, 0, magic) & n.between(1, 4096) & (8 + record * n <= b.size(data))
            read, good = _slice_check(data, n, record, big, wide)
            records = F.transform(F.sequence(F.lit(0), F.greatest(F.least(n, F.lit(4096)) - 1, F.lit(0)).cast("int")), read)
            out = F.when(fits & F.coalesce(F.forall(records, good), F.lit(False)), name).otherwise(out)
        return out

    return F.coalesce(kind(("CAFEBABE", "BEBAFECA"), 20, False, "MACHOFAT"), kind(("CAFEBABF", "BFBAFECA"), 32, True, "MACHOFAT64"))


def java_type(data: Column) -> Column:
    return F.when((b.size(data) >= 24) & b.at(data, 0, "CAFEBABE") & (b.u16be(data, 6) >= 45), "JAVACLASS")


def dex_type(data: Column) -> Column:
    return F.when((b.size(data) >= 8) & b.at(data, 0, "6465780A") & b.at(data, 7, "00"), "DEX")


def pdf_type(data: Column) -> Column:
    """``%PDF`` at the start, or ``%PDF-`` somewhere from 1 to 1,024."""
    later = F.position(b.literal("255044462D"), F.substring(data, 2, 1024 + 4)) > 0
    return F.when((b.size(data) > 4) & (b.at(data, 0, "25504446") | later), "PDF")


def image_type(data: Column) -> Column:
    return F.when(b.at(data, 0, "89504E470D0A1A0A"), "PNG").when(b.at(data, 0, "FFD8FF"), "JPEG")


def amiga_atari_iso_type(data: Column) -> Column:
    return F.when(b.at(data, 0, "000003F3") | b.at(data, 0, "000003E7"), "AMIGAHUNK").when(b.at(data, 0, "601A") & (b.size(data) >= 28), "ATARIST").when((b.size(data) >= 0x8006) & b.at(data, 0x8001, "4344303031"), "ISO9660")


def _extended(data: Column, magic: str) -> Column:
    o = b.u32le(data, 0x3C)
    return b.at(data, 0, "4D5A") & (b.size(data) >= 64) & (o >= 64) & (b.part(data, o, 2) == b.literal(magic))


def _ne_fits(data: Column) -> Column:
    """Whether the header and the segment table of a 16-bit executable lie inside the file."""
    o = b.u32le(data, 0x3C)
    segments, table = b.u16le(data, o + 0x1C), b.u16le(data, o + 0x22)
    return (o + 64 <= b.size(data)) & segments.between(1, 254) & (table >= 64) & (o + table + 8 * segments <= b.size(data))


def _linear_fits(data: Column) -> Column:
    """Whether a linear executable is little-endian, with a known processor, whole pages and an object table inside the file."""
    o = b.u32le(data, 0x3C)
    page, table, objects = b.u32le(data, o + 0x28), b.u32le(data, o + 0x40), b.u32le(data, o + 0x44)
    sane = (b.u16le(data, o + 2) == 0) & b.u16le(data, o + 8).between(1, 6) & page.isin(512, 1024, 2048, 4096, 8192, 16384, 32768, 65536)
    return (o + 0xAC <= b.size(data)) & sane & objects.between(1, 4096) & (table >= 0xAC) & (o + table + 24 * objects <= b.size(data))


def dos_type(data: Column) -> Column:
    """Extended executables, the first that fits, and plain MSDOS."""
    checks = (("4E45", "NE", _ne_fits), ("4C45", "LE", _linear_fits), ("4C58", "LX", _linear_fits))
    fits = [F.when(_extended(data, m) & F.coalesce(check(data), F.lit(False)), n) for m, n, check in checks]
    stub = F.substring(data, 1, 4096)
    extenders = [F.when(b.at(data, 0, "4D5A") & (F.position(F.encode(F.lit(t), "UTF-8"), stub) > 0), n) for t, n in (("DOS/4G", "DOS4G"), ("DOS/16M", "DOS16M"))]
    return F.coalesce(*fits, *extenders, F.when(b.at(data, 0, "4D5A") | b.at(data, 0, "5A4D"), "MSDOS"))


def rib_spis_type(data: Column) -> Column:
    """The two disk-image headers that pass for archives."""
    limit = 512 << 20
    full, packed = b.u32le(data, 4), b.u32le(data, 8)
    rib = b.at(data, 0, "52494200") & (full <= limit) & (packed <= full) & ((full == 0) == (packed == 0))
    method = F.decode(F.substring(data, 6, 3), "ISO-8859-1")
    spis = b.at(data, 0, "535049531A") & method.isin("NON", "RLE", "LZH", "CUS", "LH5") & b.u32le(data, 8).between(1, limit) & (b.u8(data, 12) <= 1) & b.at(data, 17, "00000000")
    return F.when(rib, "RIB").when(spis, "SPIS")


#: Magic numbers of compiled Python by version: first, last, version.
PYC_MAGICS = (
    (20121, 20121, "1.5"), (50428, 50428, "1.6"), (50823, 50823, "2.0"), (60202, 60202, "2.1"), (60717, 60717, "2.2"), (62011, 62021, "2.3"), (62041, 62061, "2.4"), (62071, 62131, "2.5"), (62151, 62161, "2.6"), (62171, 62211, "2.7"),
    (3000, 3131, "3.0"), (3141, 3151, "3.1"), (3160, 3180, "3.2"), (3190, 3230, "3.3"), (3250, 3310, "3.4"), (3320, 3351, "3.5"), (3360, 3379, "3.6"), (3390, 3394, "3.7"), (3400, 3413, "3.8"), (3420, 3425, "3.9"),
    (3430, 3439, "3.10"), (3450, 3495, "3.11"), (3500, 3531, "3.12"), (3550, 3571, "3.13"),
)


def pyc_version(data: Column) -> Column:
    """The Python version of compiled code; null if it is none."""
    magic, out = b.u16le(data, 0), F.lit(None).cast("string")
    for low, high, version in PYC_MAGICS:
        out = F.when(magic.between(low, high), version).otherwise(out)
    return F.when((b.size(data) >= 4) & b.at(data, 2, "0D0A"), out)


def pyc_type(data: Column) -> Column:
    return F.when(pyc_version(data).isNotNull(), "PYC")


@per_value("string")
def _archive_kind(data: bytes):
    """ZIP by what its members are named, and a gzip stream by whether it is a package's tar."""
    import io
    import tarfile
    import zipfile
    import zlib

    if data[:2] == b"PK":
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = set(z.namelist())
        except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError):
            return None
        if "AndroidManifest.xml" in names:
            return "APK"
        if any(n.startswith("Payload/") and ".app/" in n for n in names):
            return "IPA"
        return "JAR" if "META-INF/MANIFEST.MF" in names else "ZIP"
    try:
        head = zlib.decompressobj(31).decompress(data, 1 << 20)
    except zlib.error:
        return None
    try:
        with tarfile.open(fileobj=io.BytesIO(head), mode="r:") as t:
            for m in t:
                if m.name == "package/package.json":
                    return "NPM"
    except (tarfile.TarError, EOFError, ValueError):
        pass
    return "GZIP"


def archive_type(data: Column) -> Column:
    """APK, IPA, JAR, ZIP, NPM or GZIP for archives that can be read; other contents never reach Python."""
    return _archive_kind(F.when(b.at(data, 0, "504B0304") | b.at(data, 0, "504B0506") | b.at(data, 0, "1F8B08"), data))


def com_type(data: Column, name: Column) -> Column:
    return F.when(F.lower(name).like("%.com") & (F.octet_length(data).between(1, 65280)), "COM")


STEPS = (pe_type, elf_type, fat_type, mach_type, java_type, dex_type, pyc_type, pdf_type, image_type, amiga_atari_iso_type, rib_spis_type, dos_type)


def ladder(data: Column, name: Column | None = None) -> Column:
    """The type by structure, in order; ``BINARY`` if nothing fits.  ``archive_type`` opens what this leaves."""
    return F.coalesce(*[s(data) for s in STEPS], *([com_type(data, name)] if name is not None else []), F.lit(UNKNOWN))


def type_set(data: Column) -> Column:
    """All types whose check fits, sorted."""
    found = [s(data) for s in STEPS]
    return F.array_sort(F.array_compact(F.array(*found)))


#: Which types a rule for one type also covers.
PARENTS = {"PE32": "PE", "PE64": "PE", "PE": "MSDOS", "NE": "MSDOS", "LE": "MSDOS", "LX": "MSDOS", "DOS4G": "MSDOS", "DOS16M": "MSDOS", "ELF32": "ELF", "ELF64": "ELF", "MACHO32": "MACHO", "MACHO64": "MACHO", "JAR": "ZIP", "APK": "JAR", "IPA": "ZIP", "NPM": "GZIP", "MSDOS": "BINARY", "ELF": "BINARY", "MACHO": "BINARY", "ZIP": "BINARY"}


def ancestors(file_type: str) -> list[str]:
    out = [file_type]
    while out[-1] in PARENTS:
        out.append(PARENTS[out[-1]])
    return out if out[-1] == UNKNOWN else [*out, UNKNOWN]


def applies(rule_type: Column, file_type: Column) -> Column:
    """Whether rules for ``rule_type`` apply to contents of ``file_type``."""
    known = sorted({*PARENTS, *PARENTS.values()})
    pairs = [F.lit(x) if isinstance(x, str) else x for t in known for x in (t, F.array(*map(F.lit, ancestors(t))))]
    return F.array_contains(F.coalesce(F.try_element_at(F.create_map(*pairs), file_type), F.array(file_type, F.lit(UNKNOWN))), rule_type)


def tags_allow(tags: Column, include: list[str], exclude: list[str]) -> Column:
    """Tag filters, in any ASCII case, trimmed: some included tag (if any are asked for) and no excluded one."""
    clean = F.transform(tags, lambda t: F.lower(F.trim(t)))
    lists = [F.array(*[F.lit(t.strip().lower()) for t in x]) if x else None for x in (include, exclude)]
    ok = F.lit(True) if lists[0] is None else F.arrays_overlap(clean, lists[0])
    return ok if lists[1] is None else ok & ~F.arrays_overlap(clean, lists[1])


#: Labels of types that are not shown by their own name.
DISPLAY = {"ZIP64": "ZIP", "PE32": "PE", "PE64": "PE+", "MACHO32": "Mach-O", "MACHO64": "Mach-O64", "MACHOFAT": "Mach-O FAT", "JAVACLASS": "Java Class", "BINARY": "Binary"}


def display_name(file_type: Column) -> Column:
    pairs = [F.lit(x) for kv in DISPLAY.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), file_type), file_type, F.lit("Unknown"))


def union_rules(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, c: a.unionByName(c, allowMissingColumns=True), tables)
