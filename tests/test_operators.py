"""Operators over constructed contents: valid ones, mutations, shifts and truncations."""

import gzip
import io
import struct
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.operators import carve, detect, formats, layout, members, registry, relate, report, strings_scan


def frame(spark, *contents):
    return spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(contents)], "id long, content binary")


def pe(magic=0x10B, section=b".text", offset=128):
    data = bytearray(1024)
    data[:2], data[60:64], data[offset : offset + 4] = b"MZ", struct.pack("<I", offset), b"PE\0\0"
    struct.pack_into("<HHIIIHH", data, offset + 4, 0x14C, 1, 0, 0, 0, 224, 0)
    struct.pack_into("<H", data, offset + 24, magic)
    data[offset + 24 + 224 : offset + 24 + 232] = section.ljust(8, b"\0")
    struct.pack_into("<II", data, offset + 24 + 224 + 16, 512, 512)
    return bytes(data)


def cab(payload=b"hello"):
    name = b"t.txt\0"
    files_at, body = 44, 44 + 16 + len(name)
    head = struct.pack("<4sIIIIIBBHHHHH", b"MSCF", 0, body + 8 + len(payload), 0, files_at, 0, 3, 1, 1, 1, 0, 0, 0)
    entry = struct.pack("<IIHHHH", len(payload), 0, 0, 0, 0, 0) + name
    return head + struct.pack("<IHH", body, 1, 0) + entry + struct.pack("<IHH", 0, len(payload), len(payload)) + payload


def test_ladder(spark):
    fat = struct.pack(">II", 0xCAFEBABE, 1) + struct.pack(">IIIII", 7, 3, 64, 32, 6)
    fat = fat.ljust(64, b"\0") + bytes.fromhex("CEFAEDFE") + bytes(28)
    cases = [
        (pe(), "PE32"), (pe(0x20B), "PE64"), (pe(0x107), "MSDOS"), (pe()[:63], "MSDOS"), (b"\x7fELF\x01" + bytes(11), "ELF32"), (b"\x7fELF\x02" + bytes(10), "BINARY"), (b"\x7fELF\x02" + bytes(11), "ELF64"), (fat, "MACHOFAT"), (fat[:90], "BINARY"),
        (bytes.fromhex("CAFEBABE00000034") + bytes(16), "JAVACLASS"), (bytes.fromhex("CAFEBABE0000002C") + bytes(16), "BINARY"), (b"dex\n035\0", "DEX"), (b"x" * 100 + b"%PDF-1.4", "PDF"), (b"x" * 1025 + b"%PDF-1.4", "BINARY"), (b"%PDF", "BINARY"), (b"\xff\xd8\xff", "JPEG"),
        (bytes(0x8001) + b"CD001", "ISO9660"), (b"RIB\0" + struct.pack("<II", 10, 5), "RIB"), (b"RIB\0" + struct.pack("<II", 5, 10), "BINARY"), (b"", "BINARY"),
    ]
    got = frame(spark, *[c for c, _ in cases]).select("id", detect.ladder(F.col("content")).alias("t")).collect()
    assert {r.id: r.t for r in got} == dict(enumerate(t for _, t in cases))


def extended(kind, **changes):
    """A DOS program with an NE, LE or LX header at 64."""
    data = bytearray(512)
    data[:2], data[64:66] = b"MZ", kind
    struct.pack_into("<I", data, 60, 64)
    fields = {"NE": {0x1C: ("<H", 2), 0x22: ("<H", 64)}}.get(kind.decode(), {8: ("<H", 2), 0x28: ("<I", 4096), 0x40: ("<I", 0xAC), 0x44: ("<I", 3)})
    for at, (form, value) in fields.items():
        struct.pack_into(form, data, 64 + at, changes.get(f"x{at:x}", value))
    return bytes(data)


def test_extended_programs_are_checked(spark):
    cases = [(extended(b"NE"), "NE"), (extended(b"NE", x1c=0), "MSDOS"), (extended(b"NE", x22=500), "MSDOS"), (extended(b"LE"), "LE"), (extended(b"LX"), "LX"), (extended(b"LX", x8=9), "MSDOS"), (extended(b"LE", x28=1000), "MSDOS"), (extended(b"LX", x44=4000), "MSDOS"), (extended(b"LE")[:100], "MSDOS")]
    got = frame(spark, *[c for c, _ in cases]).select("id", detect.ladder(F.col("content")).alias("t")).collect()
    assert {r.id: r.t for r in got} == dict(enumerate(t for _, t in cases))


def test_archives_by_their_members(spark):
    def zipped(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, b"x")
        return out.getvalue()

    cases = [(zipped("a"), "ZIP"), (zipped("META-INF/MANIFEST.MF", "a"), "JAR"), (zipped("META-INF/MANIFEST.MF", "AndroidManifest.xml"), "APK"), (zipped("Payload/a.app/b"), "IPA"), (gzip.compress(b"plain"), "GZIP")]
    cases += [(gzip.compress(members.pack_tar([("package/package.json", b"{}")])), "NPM"), (gzip.compress(members.pack_tar([("b", b"")])), "GZIP"), (b"PK\x03\x04broken", None), (b"\x1f\x8b\x08broken", None), (b"other", None)]
    got = frame(spark, *[c for c, _ in cases]).select("id", detect.archive_type(F.col("content")).alias("t")).collect()
    assert {r.id: r.t for r in got} == dict(enumerate(t for _, t in cases))
    versions = frame(spark, b"\x5c\x0d\x0d\x0a", b"\x5c\x0d\x0d", b"\x00\x00\x0d\x0a", b"\x03\xf3\x0d\x0a").select("id", detect.pyc_version(F.col("content")).alias("v")).collect()
    assert {r.id: r.v for r in versions} == {0: "3.9", 1: None, 2: None, 3: "2.7"}


def test_listings_are_whole_or_say_that_they_are_not(spark):
    tar = members.pack_tar([(f"n{k}", b"x") for k in range(5)])
    rows = frame(spark, tar, members.pack_tar([("one", b"1"), ("two", b"2")]))
    got = sorted((r.id, r.name, r.truncated) for r in members.list_members(rows, "id", limit=2).collect())
    assert got == [(0, "n0", True), (0, "n1", True), (1, "one", False), (1, "two", False)]
    assert members.list_members(rows, "id").count() == 7
    broken = bytearray(members.pack_zip([("a", b"abc" * 50)]))
    broken[33] ^= 0xFF
    assert [(r.content, r.status) for r in members.extract(frame(spark, bytes(broken)), "id").collect()] == [(None, "failed")]
    large = gzip.compress(bytes(40 << 20), 9)
    assert [(m.size, m.offset + m.compressed + 8) for m in members.gzip_members(large + large)] == [(40 << 20, len(large)), (40 << 20, 2 * len(large))]


def test_hot_keys_are_salted(spark):
    left = spark.createDataFrame([(k % 3 if k % 10 else 7, k) for k in range(500)], "k int, v int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (7, "d"), (9, "e")], "k int, w string")
    want = sorted((r.k, r.v, r.w) for r in left.join(right, "k").collect())
    for hot in (0, 60, 10**6):
        assert sorted((r.k, r.v, r.w) for r in relate.salted_join(left, right, "k", salts=4, hot_rows=hot).select("k", "v", "w").collect()) == want


def test_rules_and_priority(spark):
    rows = frame(spark, b"\x89PNG\r\n\x1a\n", b"MZ", b"PK\x03\x04", b"Rar!\x1a\x07\x01\x00", b"nothing")
    best = detect.best_type(detect.match_rules(rows, detect.rule_table(spark), "id"), "id")
    assert {r.id: r.file_type for r in best.collect()} == {0: "PNG", 1: "MSDOS", 2: "ZIP", 3: "RAR5"}
    assert detect.ancestors("PE32") == ["PE32", "PE", "MSDOS", "BINARY"]


def test_containers(spark):
    two = gzip.compress(b"first", mtime=0) + gzip.compress(b"second" * 1000, mtime=5)
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w") as f:
        for name, data in (("a", b"1"), ("d/b", b"22")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            f.addfile(info, io.BytesIO(data))
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("x", b"zip content")
        f.writestr("dir/", b"")
    ar = b"!<arch>\n" + b"n.txt/".ljust(16) + b"0".ljust(12) + b"0".ljust(6) * 2 + b"644".ljust(8) + b"3".ljust(10) + b"`\nabc\n"
    fasta = b">s1 first\nACGT\nAC\n>s2\nGG\n"
    dbf = struct.pack("<BBBBIHH", 3, 24, 1, 1, 2, 65, 4).ljust(32, b"\0") + b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([3]) + bytes(15) + b"\r" + b" abc" + b"*def" + b"\x1a"
    rows = frame(spark, two, t.getvalue(), z.getvalue(), ar, members.pack_cpio([("c", b"cpio")]), fasta, dbf, cab(), b"plain")
    got = {}
    for r in members.extract(rows, "id").orderBy("id", "index").collect():
        got.setdefault((r.id, r.container), []).append((r.name, bytes(r.content)))
    assert got == {
        (0, "GZIP"): [(None, b"first"), (None, b"second" * 1000)], (1, "TAR"): [("a", b"1"), ("d/b", b"22")], (2, "ZIP"): [("x", b"zip content")], (3, "AR"): [("n.txt", b"abc")], (4, "CPIO"): [("c", b"cpio")],
        (5, "FASTA"): [("s1", b"ACGT\nAC\n"), ("s2", b"GG\n")], (6, "DBF"): [("record0", b" abc"), ("record1", b"*def")], (7, "CAB"): [("t.txt", b"hello")],
    }


@pytest.mark.parametrize("at", range(0, 30))
def test_truncated_gzip_lists_nothing(at):
    whole = gzip.compress(b"some content that is compressed", mtime=0)
    assert list(members.gzip_members(whole)) and not list(members.gzip_members(whole[: len(whole) - 1 - at]))


def test_cab_mutations():
    good = cab()
    assert [(m.name, m.size) for m in members.cab_members(good)] == [("t.txt", 5)]
    for at, by in ((0, b"X"), (8, b"\xff\xff"), (30, b"\x07")):
        bad = good[:at] + by + good[at + len(by) :]
        assert not list(members.cab_members(bad))


def test_embedded_formats_move_with_their_content(spark):
    body = gzip.compress(b"payload" * 10, mtime=0)
    rows = frame(spark, body, bytes(17) + body, bytes(17) + body + b"--" + cab(), b"MSCF" + bytes(40))
    got = {r.id: [(x.offset, x.file_type) for x in r.r] for r in rows.select("id", carve.embedded(F.col("content")).alias("r")).collect()}
    assert got[0] == [(0, "GZIP")] and got[1] == [(17, "GZIP")] and got[2] == [(17, "GZIP"), (17 + len(body) + 2, "CAB")] and got[3] == []


def test_recursion(spark):
    inner = members.pack_zip([("in.txt", b"deep")])
    rows = frame(spark, gzip.compress(members.pack_tar([("a.zip", inner), ("b.txt", b"flat")]), mtime=0))
    got = {(tuple(r.path), r.name): bytes(r.content) for r in members.recurse(rows, "id").collect()}
    assert got[((0, 0), "a.zip")] == inner and got[((0, 1), "b.txt")] == b"flat" and got[((0, 0, 0), "in.txt")] == b"deep" and len(got) == 5


def warc(records):
    out = b""
    for k, (kind, uri, body) in enumerate(records):
        out += f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:test:{k}>\r\nWARC-Target-URI: <{uri}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    return out


def test_warc():
    base = "http://example"
    data = warc([("response", f"{base}/a", b"one"), ("resource", f"{base}/a/b", b"two"), ("response", f"{base}/a/", b"three"), ("response", f"{base}/A", b"four"), ("response", f"{base}/a", b"five"), ("response", base, b"six"), ("warcinfo", f"{base}/info", b"m"), ("response", f"{base}/../escape", b"unsafe")])
    found = list(members.warc_members(data))
    names = [m.name for m in found]
    assert len(found) == 6 and len(set(names)) == 6 and names[1] == "a/b" and all(names[k].startswith("records/") for k in (0, 2, 4))
    assert [data[m.offset : m.offset + m.size] for m in found] == [b"one", b"two", b"three", b"four", b"five", b"six"]
    assert not list(members.warc_members(data[:-1]))


def dexa():
    palette = bytes(range(256)) * 3
    z = lambda d: zlib.compress(d)
    fram = lambda method, d: b"FRAM" + bytes([method]) + struct.pack(">I", len(z(d))) + z(d)
    head = b"DEXA\0" + struct.pack(">HIHH", 4, 66, 3, 2)
    return head + b"CMAP" + palette + fram(2, b"abcdef") + b"NULL" + fram(3, b"\x01" * 6) + b"NULLNULL" + b"CMAP" + palette[::-1] + b"NULL", palette


def test_dexa_frames():
    data, palette = dexa()
    got = formats.dexa_frames.of(data)
    assert [g["pixels"] for g in got] == [b"abcdef", b"`cbedg", b"`cbedg", b"`cbedg"]
    assert [g["palette"] for g in got] == [palette] * 3 + [palette[::-1]]
    assert all(formats.dexa_frames.of(data[:k]) is None for k in range(len(data)))


def test_formats(spark):
    rows = frame(spark, pe(section=b"_cabinet"))
    got = rows.select(formats.has_section(F.col("content"), "_cabinet").alias("a"), formats.pe_header(F.col("content")).alias("h"), formats.is_extended(F.col("content"), "NE").alias("ne")).first()
    assert got.a and got.h.sections == 1 and not got.ne
    key = 0x12345678
    rich = struct.pack("<4I", 0x536E6144 ^ key, key, key, key) + struct.pack("<2I", (0x105 << 16 | 27) ^ key, 3 ^ key) + b"Rich" + struct.pack("<I", key)
    assert formats.rich_header.of(bytes(128) + rich + bytes(64)) == [{"id": 0x105, "build": 27, "count": 3}]
    jpeg = b"\xff\xd8\xff\xdb\x00\x05abc\xff\xfe\x00\x06note\xff\xda\x00\x02"
    assert formats.jpeg_comment.of(jpeg) == "note" and formats.jpeg_table_md5.of(jpeg) == "900150983cd24fb0d6963f7d28e17f72"
    pdf = b"%PDF-1.4\n%\xe2\xe3\n<< /Title (Hello) /ID <AB01> /P -44 /Encrypt 5 0 R >>"
    r = frame(spark, pdf).select(formats.pdf_strings(F.col("content"), "Title").alias("t"), formats.pdf_values_are_hex(F.col("content"), "ID").alias("h"), formats.pdf_is_encrypted(F.col("content")).alias("e"), formats.pdf_permissions(F.col("content")).alias("p"), formats.pdf_header_comment(F.col("content")).alias("c")).first()
    assert (r.t, r.h, r.e, r.p, r.c) == (["Hello"], True, True, -44, "e2e3")


def test_strings():
    data = b"\x00\x01hello world\xffabc\x00\x00\x00" + "wide текст".encode("utf-16-le") + b"\x00\x00"
    ascii_ = strings_scan.find_strings(data, 5)
    assert [(s["offset"], s["text"]) for s in ascii_] == [(2, "hello world")]
    wide = strings_scan.find_strings(data, 5, (strings_scan.UTF16LE,))
    assert any(s["text"] == "wide текст" and s["offset"] == 20 and s["byte_size"] == 20 for s in wide)
    assert strings_scan.find_strings("ünïcode".encode(), 4, (strings_scan.UTF8,))[0]["characters"] == 7
    assert strings_scan.find_strings(b"abcdefgh", 4, max_text=3)[0]["truncated"]


def test_layouts(spark):
    rows = frame(spark, members.pack_tar([("n", b"12345")]), b"\x1f\x8b" + bytes(7), gzip.compress(b"", mtime=7))
    got = rows.select("id", layout.TAR.project(F.col("content")).alias("t"), layout.GZIP.project(F.col("content")).alias("g")).orderBy("id").collect()
    assert (got[0].t.name, got[0].t.size, got[0].g) == ("n", 5, None) and got[1].g is None and (got[2].g.mtime, got[2].g.method, got[2].t) == (7, 8, None)
    assert layout.TAR.size == 512 and layout.ELF64.size == 64 and layout.DOS.size == 64 and layout.SECTION.size == 40


def test_greedy_and_reports(spark):
    finds = spark.sql("select array(named_struct('offset', 5L, 'size', 10L), named_struct('offset', 0L, 'size', 6L), named_struct('offset', 6L, 'size', 2L), named_struct('offset', 8L, 'size', 1L)) f")
    assert [(x.offset, x.size) for x in finds.select(relate.greedy_disjoint(F.col("f")).alias("x")).first().x] == [(0, 6), (6, 2), (8, 1)]
    rows = spark.createDataFrame([("a", "1", "t"), ("b", None, None)], "name string, version string, type string")
    assert [r.value for r in report.as_text(rows.orderBy("name")).collect()] == ["t: a(1)", "b"]
    assert report.project(rows, report.ScanOptions(show_version=False)).columns == ["name", "type"]
    with pytest.raises(ValueError):
        report.project(rows, report.ScanOptions(recursive=True))


def test_registry(spark):
    rows = frame(spark, b"\x89PNG\r\n\x1a\n")
    assert registry.scan("rules", rows, "id").first().file_type == "PNG"
    with pytest.raises(ValueError):
        registry.scan("rules", rows, "id", file_type="PE32")
    with pytest.raises(ValueError):
        registry.register_engine(registry.Engine("old", lambda *a: a[0], abi=0))


def chunk(tag, data):
    return struct.pack(">I", len(data)) + tag + data + bytes(4)


def directory(names):
    return {m.name: m.size for m in names}


def test_declared_readers():
    from quarry.operators import readers

    read = {n: f for n, _, _, f in readers.FORMATS}
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")
    assert directory(read["PNG"](png)) == {"IHDR": 13, "IDAT": 1, "IEND": 0}
    assert directory(read["MIDI"](b"MThd\0\0\0\6" + bytes(6) + b"MTrk\0\0\0\2ab")) == {"MThd": 6, "MTrk": 2}
    assert directory(read["WAD"](readers.pack_wad([("MAP01", b"abc")]))) == {"MAP01": 3}
    assert directory(read["QUAKE_PAK"](readers.pack_pak([("a/b", b"abcd")]))) == {"a/b": 4}
    assert directory(read["RIFF"](readers.pack_riff([("odd ", b"abc"), ("even", b"ab")]))) == {"odd": 3, "even": 2}
    assert directory(read["BUILD_GRP"](b"KenSilverman" + struct.pack("<I", 2) + struct.pack("<12sI12sI", b"A", 1, b"B", 2) + b"xyy")) == {"A": 1, "B": 2}
    assert directory(read["BIGF"](b"BIGF" + bytes(4) + struct.pack(">II", 1, 0) + struct.pack(">II", 26, 2) + b"n\0" + b"ok")) == {"n": 2}
    assert directory(read["DESCENT_HOG"](b"DHF" + struct.pack("<13sI", b"f.txt", 2) + b"hi")) == {"f.txt": 2}
    assert directory(read["TTF"](b"\0\1\0\0" + struct.pack(">HHHH", 1, 0, 0, 0) + struct.pack(">4sIII", b"cmap", 0, 28, 4) + bytes(4))) == {"cmap": 4}
    assert directory(read["MP4"](struct.pack(">I4s", 12, b"ftyp") + b"isom" + struct.pack(">I4s", 8, b"mdat"))) == {"ftyp": 4, "mdat": 0}
    assert directory(read["FLAC"](b"fLaC\x80\0\0\2ab" + b"zz")) == {"block0": 2, "frames": 2}
    assert directory(read["WASM"](b"\0asm\1\0\0\0\1\3abc")) == {"section1": 3}
    assert directory(read["GIF"](b"GIF89a" + bytes(7) + b"\x21\xfe\x01a\0" + b"\x2c" + bytes(9) + b"\x02\x01z\0\x3b")) == {"extensionfe": 5, "image": 14}
    assert directory(read["PCAP"](b"\xd4\xc3\xb2\xa1" + bytes(20) + struct.pack("<IIII", 5, 0, 2, 2) + b"ab")) == {"packet0": 2}
    assert directory(read["MBOX"](b"From a\nx\n\nFrom b\ny\n")) == {"message0": 10, "message1": 9}
    assert directory(read["ARC"](b"\x1a\x02" + b"f".ljust(13, b"\0") + struct.pack("<IHHHI", 3, 0, 0, 0, 3) + b"abc\x1a\0")) == {"f": 3}
    lha = bytes([23, 0]) + b"-lh0-" + struct.pack("<III", 3, 3, 0) + b" \0" + b"\x01f" + bytes(2)
    assert directory(read["LHA"](lha + b"abc\0")) == {"f": 3}
    card = lambda s: s.ljust(80).encode()
    assert directory(read["FITS"](b"".join(map(card, ("SIMPLE  = T", "BITPIX  = 16", "NAXIS   = 1", "NAXIS1  = 3", "END "))).ljust(2880) + bytes(2880))) == {"unit0": 6}


def test_readers_survive_any_cut():
    from quarry.operators import readers

    samples = [readers.pack_wad([("A", b"abc")]), readers.pack_riff([("abcd", b"xyz")]), b"GIF89a" + bytes(30), b"fLaC" + bytes(30), bytes(0x8001) + b"CD001" + bytes(3000), cab(), members.pack_cpio([("c", b"x")])]
    for data in samples:
        for _, _, read in members.READERS.values():
            for n in {0, 1, 5, 12, 20, len(data) // 2, len(data) - 1, len(data)}:
                assert all(m.offset + m.compressed <= max(n, 0) for m in read(data[:n]))


def test_streams(spark):
    from quarry.operators import streams

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"Author\0me")
    rows = frame(spark, png, b"nothing")
    got = {(r.key, r.value) for r in streams.stream(rows, "metadata", "id").collect()}
    assert {("width", "3"), ("height", "2"), ("Author", "me")} <= got
    fact = streams.facts(rows, "id").first()
    assert fact.numbers["width"] == 3 and fact.texts == {"Author": "me"}
    image = bytearray(pe().ljust(1536, b"\0"))
    struct.pack_into("<II", image, 128 + 24 + 224 + 8, 512, 0x1000)  # virtual size and address of the section at 512
    struct.pack_into("<II", image, 128 + 24 + 96 + 8, 0x1000, 40)
    struct.pack_into("<5I", image, 512, 0x1040, 0, 0, 0x1080, 0x1040)
    struct.pack_into("<III", image, 512 + 0x40, 0x1060, 0x80000007, 0)
    image[512 + 0x62 : 512 + 0x66], image[512 + 0x80 : 512 + 0x85] = b"Func", b"a.dll"
    assert streams.pe_imports.of(bytes(image)) == [{"library": "a.dll", "name": "Func", "ordinal": None}, {"library": "a.dll", "name": None, "ordinal": 7}]
    assert streams.pe_imports.of(b"") == [] and streams.elf_symbols.of(b"\x7fELF") == [] and streams.pe_exports.of(pe()) == []
    names, symbols = b"\0main\0", struct.pack("<IBBHQQ", 0, 0, 0, 0, 0, 0) + struct.pack("<IBBHQQ", 1, 2, 0, 0, 0x400000, 16)
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0, 0, 64, 0, 64, 0, 0, 64, 3, 2)
    at = 64 + 3 * 64
    section = lambda kind, where, size, link: struct.pack("<IIQQQQIIQQ", 0, kind, 0, 0, where, size, link, 0, 0, 0)
    elf = head + section(0, 0, 0, 0) + section(2, at + len(names), len(symbols), 2) + section(3, at, len(names), 0) + names + symbols
    assert streams.elf_symbols.of(elf) == [{"name": "main", "address": 0x400000, "size": 16, "kind": "function"}]


def test_packets(spark):
    from quarry.functions import packets, search

    udp = struct.pack(">HHHH", 53, 1024, 8 + 4, 0) + b"data"
    head = bytearray(struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(udp), 7, 0, 64, 17, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])))
    total = sum(struct.unpack(">10H", head))
    total = (total & 0xFFFF) + (total >> 16)
    struct.pack_into(">H", head, 10, ~total & 0xFFFF)
    rows = frame(spark, bytes(head) + udp, bytes(head[:11]) + b"\0" + bytes(head[12:]) + udp)
    got = rows.select(packets.ipv4(F.col("content")).alias("p")).withColumn("u", packets.udp(F.col("p.payload"))).collect()
    assert (got[0].p.source, got[0].p.target, got[0].p.protocol, got[0].u.target, bytes(got[0].u.payload)) == ("10.0.0.1", "10.0.0.2", 17, 1024, b"data") and got[1].p is None
    assert spark.range(1).select(packets.sequence_after(F.lit(5), F.lit(2**32 - 5)).alias("x")).first().x
    found = frame(spark, b"k=1\nK=22").select(search.captures(F.col("content"), r"^(k)=(\d+)$", ignore_case=True, multi_line=True).alias("m")).first().m
    assert [(m.start, m.end, m.groups) for m in found] == [(0, 3, ["k=1", "k", "1"]), (4, 8, ["K=22", "K", "22"])]


def test_layouts_from_specs(spark):
    own = layout.from_spec("own", [{"name": "a", "kind": "u16", "big": True}, {"kind": "bytes", "length": 1}, {"name": "b", "kind": "i8"}], "0102")
    got = frame(spark, b"\1\2\0\xff", b"\1\2\0", b"\2\2\0\0").select(own.project(F.col("content")).alias("x")).collect()
    assert (got[0].x.a, got[0].x.b, got[1].x, got[2].x) == (0x0102, -1, None, None)
    sizes = {"cab_header": 36, "elf32_header": 52, "mach_header": 28, "png_header": 29, "pcap_header": 24, "mbr_entry": 16, "wad_header": 12, "gif_header": 13, "sqlite_header": 32}
    assert {n: layout.LAYOUTS[n].size for n in sizes} == sizes


def test_contents_made_in_python_are_made_once(spark):
    """Listing and extracting add one Python step to those that make a content; contents of no type have no members."""
    files = spark.createDataFrame([(k, ["a", "b"], [b"1", b"2"]) for k in range(3)], "id long, names array<string>, files array<binary>")
    packed = files.select("id", F.when(F.col("id") < 2, members.pack(F.col("names"), F.col("files"), "tar")).when(F.col("id") == 2, F.lit(b"none")).alias("content"))
    for rows in (members.list_members(packed, "id"), members.extract(packed, "id"), members.list_members(packed, "id", limit=1)):
        assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 2
        assert {(r.id, r.container) for r in rows.collect()} == {(0, "TAR"), (1, "TAR")}


def named(rows, what):
    return rows._jdf.queryExecution().executedPlan().toString().split("Scan")[0].count(what)


def test_a_record_is_cut_out_once(spark):
    """A field reads the record's bytes, not the content again; places that are read from the content are read once."""
    rows = frame(spark, pe(), b"BM" + struct.pack("<I", 9) + bytes(8) + struct.pack("<IiiHH", 40, 7, -7, 1, 24) + bytes(4), b"BM")
    assert named(rows.select(layout.BMP.project(F.col("content")).alias("h")), "content#") <= 12
    assert named(rows.select(formats.pe_sections(F.col("content")).alias("s")), "content#") <= 60
    got = rows.select(layout.BMP.project(F.col("content")).alias("h"), formats.pe_sections(F.col("content")).alias("s"), layout.BMP.shown(F.col("content")).alias("t")).collect()
    assert [r.h and (r.h.file_size, r.h.width, r.h.height, r.h.bits) for r in got] == [None, (9, 7, -7, 24), None]
    assert [r.s and [(s.name, s.raw_size, s.raw_at) for s in r.s] for r in got] == [[(".text", 512, 512)], None, None]
    assert [r.t and (r.t.width, r.t.height) for r in got] == [None, ("7", "-7"), None]


def test_interval_counts_make_no_pairs(spark):
    """Against counting; ranges that are equal, empty, long, or hold nothing, and positions that occur many times."""
    points = [*range(0, 100, 7), *[35] * 50, *[36] * 20, -5, 1000, None]
    spans = [(0, 10), (0, 10), (35, 36), (36, 36), (35, 37), (-100, 2000), (200, 300), (29, 31), (9, 5), (None, 4), (99, 1001)]
    p = spark.createDataFrame([(x,) for x in points], "t long")
    r = spark.createDataFrame([(k, *s) for k, s in enumerate(spans)], "id long, start long, end long")
    counts = relate.interval_counts(p, r, "t", "start", "end", 10)
    joins = [x for x in counts._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert joins and not any("_bucket" in x for x in joins)
    want = {k: sum(x is not None and a is not None and a <= x < b for x in points) for k, (a, b) in enumerate(spans)}
    assert {x.id: x.n for x in counts.collect()} == {k: n for k, n in want.items() if n}


def test_error_hours_are_counted_without_pairs(spark):
    from quarry.plans import catalog

    plan = catalog.queries()["event_interval"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any("_bucket" in x for x in plan.splitlines() if "Join" in x)
