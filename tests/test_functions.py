"""Functions of single values against published vectors and plain Python."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import bytes as b
from quarry.functions import codecs, digests, net, search, stats, text, transforms


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


CHECK = b"123456789"


@pytest.mark.parametrize(
    ("name", "value"),
    [("crc8", "f4"), ("crc8_maxim", "a1"), ("crc16_arc", "bb3d"), ("crc16_ccitt_false", "29b1"), ("crc16_xmodem", "31c3"), ("crc16_kermit", "2189"), ("crc16_modbus", "4b37"), ("crc16_x25", "906e"), ("crc32", "cbf43926"), ("crc32_bzip2", "fc891918"), ("crc32_posix", "765e7680"), ("crc32c", "e3069283"), ("crc64_ecma", "6c40df5f0b497347"), ("crc64_xz", "995dc9bbdf1939fa")],
)
def test_crc_check_values(name, value):
    spec = digests.CRCS[name]
    assert f"{digests.crc_of(spec, CHECK):0{spec.width // 4}x}" == value


@pytest.mark.parametrize("name", sorted(digests.CRCS))
def test_crcs_of_whole_batches(name):
    rng, spec = np.random.default_rng(1), digests.CRCS[name]
    rows = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 2, 3, 7, 8, 9, 255, 256, 257, 1000, 5000, 0, 512)]
    offsets = np.cumsum([3, *map(len, rows)])
    got = digests.crc_rows(spec, np.frombuffer(b"xyz" + b"".join(rows), np.uint8), offsets)
    assert got.tolist() == [digests.crc_of(spec, r) for r in rows]


def test_digest_vectors():
    assert digests.md2_of(b"") == "8350e5a3e24c153df2275c9f80692773"
    assert digests.md2_of(b"abc") == "da853b0d3f88d99b30283a69e6ded6bb"
    assert digests.ripemd256_of(b"") == "02ba4c4e5f8ecd1877fc52d64d30e37a2d9774fb1e5d026380ae0168e3c5522d"
    assert digests.blake2sp_of(b"") == "dd0e891776933f43c7d032b08a917e25741f8aa9a12c12e1cac8801500f2ca4f"


def test_digests_in_spark(spark):
    data = bytearray(b"hello" * 50)
    made = {k: one(spark, c, d=data) for k, c in digests.builtin(F.col("d")).items()}
    assert made["sha384"] == hashlib.sha384(data).hexdigest() and made["crc32"] == zlib.crc32(data)
    assert one(spark, digests.adler32(F.col("d")), d=data) == zlib.adler32(data)
    assert one(spark, digests.crc("crc32c")(F.col("d")), d=bytearray(CHECK)) == "e3069283"
    assert one(spark, digests.sha512_256(F.col("d")), d=data) == hashlib.new("sha512_256", data).hexdigest()


def test_statistics_edges(spark):
    counts = stats.histogram(F.col("d"))
    assert one(spark, stats.mode(counts), d=bytearray(b"bbaa")) == ord("a")
    assert one(spark, stats.entropy(counts), d=bytearray(b"")) == 0.0
    assert one(spark, stats.mean(counts), d=bytearray(b"")) is None
    assert one(spark, stats.monte_carlo_pi(F.col("d")), d=bytearray(b"12345")) is None
    assert one(spark, stats.serial_correlation(stats.serial_sums(F.col("d")), F.octet_length("d")), d=bytearray(b"aaaa")) == -100000.0


@pytest.mark.parametrize(
    ("signature", "valid"),
    [("4D5A", True), ("4d 5a", True), ("'MZ'", True), ("'MZ", False), ("4", False), ("4D..5A", True), ("4.5A", False), ("4D?? 5A", True), ("**", True), ("***", False), ("%%", True), ("%&", True), ("%", False), ("!%", True), ("_%", True), ("!", False), ("+4D5A", True), ("+", False), ("+4", False), ("$$", True), ("$", False), ("$$$$$$", False), ("####", True), ("####[400000]", True), ("##[", False), ("#[10]#", True), ("#[10]", False), ("zz", False), ("", False)],
)
def test_signature_rules(signature, valid):
    assert search.is_valid(signature) is valid


def test_signature_matching(spark):
    data = b"MZ\x04\x00\x00\x00skip!!text"
    for signature, fits in (("4D5A", True), ("'MZ'04", True), ("4D5B", False), ("'MZ' $$$$$$$$ '!!'", True), ("+'text'", True), ("+'none'", False), ("'MZ'!%", True), ("'MZ'%%", False), ("'MZ'_%_%", False)):
        assert search.match_bytes(data, signature) is fits, signature
        assert one(spark, search.matches(F.col("d"), signature), d=bytearray(data)) is fits, signature
    assert search.match_bytes(bytes(4) + b"\x06\x00AB", "##[0]", 4) and not search.match_bytes(b"\x50", "##")


def test_searches(spark):
    data = bytearray(b"xxTheTHE the")
    assert search.mask_find(bytes(data), 0, 9, [(0, 0xDF, 0x54), (1, 0xDF, 0x48)]) == 2
    assert search.mask_find(b"abc", 0, 3, [(0, 0xFF, 1)]) is None and search.mask_find(b"abc", 0, 1, [(0, 0x0F, 0x10)]) is None
    assert one(spark, search.nocase_position(F.col("d"), "tHE"), d=data) == 2
    assert one(spark, search.byteset_position(F.col("d"), b"E h"), d=data) == 3
    hits = one(spark, search.literal_hits(F.col("d"), [b"the", b"xx", b"x"]), d=data)
    assert [(h.offset, h.literal) for h in hits] == [(0, 1), (0, 2), (1, 2), (9, 0)]


def test_byte_transforms():
    rng = random.Random(1)
    for width in (1, 2, 4, 8):
        data, mask = rng.randbytes(8 * 5), (1 << 8 * width) - 1
        for big in (False, True):
            order = "big" if big else "little"
            words = [int.from_bytes(data[k : k + width], order) for k in range(0, len(data), width)]
            by, turn = rng.getrandbits(64), None
            turn = by % (8 * width)
            plain = {"xor": lambda v: v ^ by, "and": lambda v: v & by, "or": lambda v: v | by, "not": lambda v: ~v, "add": lambda v: v + by, "subtract": lambda v: v - by, "rotate_left": lambda v: v << turn | v >> (8 * width - turn), "rotate_right": lambda v: v >> turn | v << (8 * width - turn)}
            for kind, f in plain.items():
                want = b"".join((f(w) & mask).to_bytes(width, order) for w in words)
                assert transforms.transform_bytes(data, kind, width, by, big) == want, (kind, width, big)
            assert transforms.transform_bytes(transforms.transform_bytes(data, "swap_endian", width), "swap_endian", width) == data
    assert transforms.transform_bytes(b"12345", "xor", 2, 1) is None and transforms.transform_bytes(b"", "nope") is None
    assert transforms.transform_bytes(bytes(5), "fill", pattern=b"abc", phase=2) == b"cabca"


@pytest.mark.parametrize("raw", [b"", b"a", b"ab", b"abc", b"\xff\xfe\xfd\xfc"])
def test_base64(spark, raw):
    plain = base64.b64encode(raw).decode().rstrip("=")
    assert transforms.encode64(raw, pad=False) == plain
    assert one(spark, transforms.base64_decode_strict(F.col("t")), t=plain) == raw


@pytest.mark.parametrize("bad", ["YQ==", "Y", "YR", "YWJ=", "YW*j", "YWK"])
def test_base64_refuses(spark, bad):
    assert one(spark, transforms.base64_decode_strict(F.col("t")), t=bad) is None


def test_numbers(spark):
    assert one(spark, transforms.uleb128(F.col("d"), F.lit(0))["value"], d=bytearray(b"\xe5\x8e\x26")) == 624485
    assert transforms.sleb128.of(b"\x9b\xf1\x59", 0) == {"value": -624485, "length": 3}
    assert transforms.base128_be.of(b"\x81\x00", 0)["value"] == 128 and transforms.uleb128.of(b"\x80", 0) is None
    assert one(spark, transforms.nastran_real(F.lit("-2.5-3"))) == -0.0025
    assert one(spark, transforms.fortran_real(F.lit("1.5D+03"))) == 1500.0
    assert one(spark, transforms.ascii_number(F.lit("0000644\0"), 8)) == 0o644
    assert one(spark, transforms.float_at(F.col("d"), F.lit(0), F.lit("<f")), d=bytearray(b"\0\0\x80?")) == 1.0
    assert one(spark, transforms.ones_complement(F.lit(0xFE), 8)) == -1
    assert one(spark, b.signed(F.col("d"), 0, 8), d=bytearray(b"\xff" * 8)) == -1
    assert one(spark, b.unsigned(F.col("d"), 0, 8), d=bytearray(b"\xff" * 8)) == 2**64 - 1
    assert one(spark, b.u16le(F.col("d"), 1), d=bytearray(b"\xff\xff")) is None
    assert one(spark, transforms.is_ordered(F.array(F.lit(1.0), F.lit(1.0), F.lit(2.0)))) is True


def test_text(spark):
    assert one(spark, text.trim_white(F.lit("\u00a0\u2003 a b \u3000"))) == "a b"
    assert one(spark, F.lower(F.lit("ΑΣ"))) == "ας"
    assert text.display_width.of("a漢e\u0301") == 4 and text.escape_debug.of("a\tb\u0301\u200b") == "a\\tb\\u{301}\\u{200b}"
    assert text.decode_page.of(b"\x80", 1252) == "€" and text.encode_page.of("漢", 1252) is None and text.codec(999999) is None
    assert one(spark, text.lossy(F.col("d")), d=bytearray(b"a\xffb")) == "a\ufffdb"
    assert text.toml_json.of("a = 1\n[b]\nc = [1, 2]") == '{"a": 1, "b": {"c": [1, 2]}}' and text.toml_json.of("a =") is None
    assert one(spark, text.json_kind(F.lit("[1]"))) == "array" and one(spark, text.json_kind(F.lit("{"))) is None
    assert one(spark, text.js_replace(F.lit("aXbX"), "X", "-")) == "a-bX"
    assert one(spark, text.translate_message(F.lit("yes"), {"yes": "ja"})) == "ja"


NAMES = [
    (b"A\xa5\x8f\x8fEU\x8f\xa5.SAM", 437, 0, "AÑÅÅEUÅÑ.SAM"), (b"Fran\xe7ais.mbm", 1252, 0, "Français.mbm"), (b"Portugu\xeas/amftp.catalog", 28591, 0, "Português/amftp.catalog"), (b"_\xd7Link.txt", 1252, 0, "_×Link.txt"),
    ("Français.mbm".encode(), 1252, 0, "Français.mbm"), (b"bad\x81.txt", 1252, 0, "bad%81.txt"), (b"x%3A.txt", 0, 0, "x%253A.txt"), (b"file~xx-00000000", 0, 0, "file%7Exx-00000000"), (b"\\folder\\file", 0, 1, "folder/file"), (b":patch.c", 0, 0, ":patch.c"),
    (b"../outside", 1252, 0, None), (b"safe/../../outside", 1252, 0, None), (b"safe\\..\\outside", 1252, 0, None), (b"/../outside", 1252, 1, None), (b"C:\\..\\outside", 1252, 2, None), (b"C:outside", 1252, 0, None), (b"/outside", 1252, 0, None), (b"\\outside", 1252, 0, None),
    (b"\\\\server\\share\\file", 1252, 1, None), (b"//?/C:/file", 1252, 3, None), (b"bad\nname", 1252, 0, None),
]


@pytest.mark.parametrize(("raw", "page", "flags", "want"), NAMES)
def test_output_names(raw, page, flags, want):
    assert text.output_name.of(raw, page, flags) == want


def test_net(spark):
    assert net.ip_in_range.of("10.1.2.3", "10.0.0.0/8") and not net.ip_in_range.of("010.1.2.3", "10.0.0.0/8") and net.ip_in_range.of("::1", "::/64") and not net.ip_in_range.of("x", "y")
    assert one(spark, net.ipv4_in(F.lit("192.168.3.4"), "192.168.0.0/16")) is True and one(spark, net.ipv4_number(F.lit("1.2.3.256"))) is None
    assert one(spark, net.is_netmask(F.lit(0xFFFFFF00))) is True and one(spark, net.is_netmask(F.lit(0xFF00FF00))) is False
    assert net.split_domain("www.example.co.uk") == {"prefix": None, "subdomain": "www", "domain": "example", "tld": "co.uk"}
    kinds = {"gooogle.com": net.TYPO, "g00gle.com": net.HOMOGLYPH, "goo-gle.com": net.HYPHENATION, "g.oogle.com": net.SUBDOMAIN, "foogle.com": net.BITSQUATTING, "other.com": 0, "google.com": 0}
    for name, kind in kinds.items():
        got = net.permutation_kind(name, "google.com")
        assert got & kind == kind and (kind or not got), name


CODED = [m for m in codecs.ENCODERS]


@pytest.mark.parametrize("method", CODED)
def test_codecs(method):
    rng = random.Random(2)
    for data in (b"", b"a", b"abcabcabc" * 1000, rng.randbytes(5000)):
        packed = codecs.ENCODERS[method](data)
        assert codecs.decode_bytes(packed, method) == data
        if len(data) > 100 and method not in ("store", "ascii85", "base32", "snappy"):
            assert codecs.decode_bytes(packed[: len(packed) // 2], method) is None
            assert codecs.decode_bytes(packed, method, limit=len(data) - 1) is None


def test_salvage_keeps_the_beginning():
    data = b"".join(b"line %d\n" % k for k in range(5000))
    kept = codecs.decode_bytes(zlib.compress(data)[:-2000], "zlib", salvage=True)
    assert kept and data.startswith(kept)


def test_old_codecs():
    assert codecs.decode_bytes(bytes.fromhex("1006000000616263000003")[:8] + b"", "lz10") is None
    assert codecs.decode_bytes(b"\x10\x06\x00\x00\x10abc\x00\x02", "lz10") == b"abcabc"
    assert codecs.decode_bytes(b"a\x90\x04b\x90\x00", "rle90") == b"aaaab\x90"
    assert codecs.decode_bytes(b"\x02abc\xfed", "packbits") == b"abcddd"
    assert codecs.decode_bytes(b"\x07abc\xee\xf0", "lzss")[:3] == b"abc"
    assert codecs.decode_bytes(bytes.fromhex("535A444488F02733") + b"A\0" + b"\x03\0\0\0" + b"\x07abc", "szdd") == b"abc"
    assert codecs.decode_bytes(b"Yaz0\0\0\0\x06" + bytes(8) + b"\xe0abc\x10\x02", "yaz0") == b"abcabc"
    assert codecs.decode_bytes(bytes.fromhex("05b0") + b"\x08abc\x00\x20", "lznt1") == b"abcabc"
    assert codecs.decode_bytes(b"\x30abc\x03\x00\x50abcde", "lz4_block")[:7] == b"abcabca"
    first = zlib.compressobj(9, zlib.DEFLATED, -15)
    assert codecs.decode_bytes(b"CK" + first.compress(b"hello") + first.flush(), "mszip") == b"hello"
    assert codecs.decode_bytes(b"#86)C\n", "uuencode") == b"abc" and codecs.decode_bytes(bytes(b + 42 for b in b"abc"), "yenc") == b"abc"
    assert codecs.decode_bytes(b"a=3Db", "quoted_printable") == b"a=b" and codecs.decode_bytes(b"!!!", "base32") is None


def test_crypto(spark):
    from quarry.functions import crypto

    p, q, e = 2**521 - 1, 2**607 - 1, 65537
    n, d = p * q, pow(e, -1, (p - 1) * (q - 1))
    size = (n.bit_length() + 7) // 8
    info = bytes.fromhex(crypto.DIGEST_INFO["sha256"]) + hashlib.sha256(b"msg").digest()
    padded = b"\0\1" + b"\xff" * (size - len(info) - 3) + b"\0" + info
    sign = lambda m: pow(int.from_bytes(m, "big"), d, n).to_bytes(size, "big")
    assert crypto.rsa_pkcs1_holds(n, e, sign(padded), b"msg", "sha256") and not crypto.rsa_pkcs1_holds(n, e, sign(padded), b"msh", "sha256")
    raw = {"m": bytearray(b"msg"), "s": bytearray(sign(padded)), "n": bytearray(n.to_bytes(size, "big")), "e": bytearray(b"\1\0\1")}
    assert one(spark, crypto.rsa_verify(*[F.col(c) for c in "msne"]), **raw) is True
    h, salt, bits = hashlib.sha256(b"msg").digest(), b"s" * 32, n.bit_length() - 1
    digest, em = hashlib.sha256(bytes(8) + h + salt).digest(), -(-bits // 8)
    db = bytes(em - 32 - 32 - 2) + b"\1" + salt
    masked = bytearray(x ^ y for x, y in zip(db, crypto._mask(digest, len(db), "sha256"), strict=True))
    masked[0] &= 0xFF >> (8 * em - bits)
    assert crypto.rsa_pss_holds(n, e, sign(bytes(masked) + digest + b"\xbc"), b"msg", "sha256") and not crypto.rsa_pss_holds(n, e, sign(bytes(masked) + digest + b"\xbc"), b"other", "sha256")
    c, secret, k = crypto.P256, 12345678901234567890, 987654321987654321
    public, r = c.times(secret, (c.gx, c.gy)), c.times(k, (c.gx, c.gy))[0] % c.n
    z = int.from_bytes(h, "big")
    s = pow(k, -1, c.n) * (z + r * secret) % c.n
    assert c.holds(public) and c.times(c.n, (c.gx, c.gy)) is None
    assert crypto.ecdsa_holds(c, public, r, s, h) and not crypto.ecdsa_holds(c, public, r, s + 1, h)
    dq, dp = 101, 607  # 607 = 6 * 101 + 1
    g = pow(2, 6, dp)
    y, kk = pow(g, 57, dp), 33
    rr = pow(g, kk, dp) % dq
    ss = pow(kk, -1, dq) * (int.from_bytes(b"\x2a", "big") % 128 + 57 * rr) % dq
    assert crypto.dsa_holds(dp, dq, g, y, rr, ss, b"\x15") == (pow(g, 21 * pow(ss, -1, dq) % dq, dp) * pow(y, rr * pow(ss, -1, dq) % dq, dp) % dp % dq == rr)
    assert one(spark, crypto.big_power_modulo(F.col("a"), F.col("b"), F.col("c")), a=bytearray(b"\5"), b=bytearray(b"\3"), c=bytearray(b"\x0d")) == bytes([5**3 % 13])
    hidden = bytes(b ^ b"key"[k % 3] for k, b in enumerate(b"MZ\x90\0\3\0\0\0\4\0"))
    assert one(spark, crypto.known_plaintext(F.col("d"), b"MZ\x90\0\3\0\0\0"), d=bytearray(hidden)) == b"key"
    sealed = crypto.aes_encrypt_cbc(F.col("d"), F.lit(b"0" * 16), F.lit(b"1" * 16))
    assert one(spark, crypto.aes_decrypt_cbc(sealed, F.lit(b"0" * 16)), d=bytearray(b"text")) == b"text"


def test_catalogues(spark):
    from quarry.sources import catalogues

    po = 'msgid ""\nmsgstr "Header: x\\n"\n\n# note\nmsgctxt "menu"\nmsgid "Open"\nmsgstr "Öffnen"\n\nmsgid "file"\nmsgid_plural "files"\nmsgstr[0] "Datei"\nmsgstr[1] ""\n"Dateien"\n'
    table = catalogues.po_table(spark, po)
    assert [tuple(r) for r in table.collect()] == [("menu", "Open", None, ["Öffnen"]), (None, "file", "files", ["Datei", "Dateien"])]
    rows = spark.createDataFrame([("Open",), ("Close",)], "m string")
    assert {r.m: r.translated for r in catalogues.translate(rows, "m", table, "menu").collect()} == {"Open": "Öffnen", "Close": "Close"}
    forms = F.array(F.lit("Datei"), F.lit("Dateien"))
    assert [one(spark, catalogues.plural(forms, F.lit("a"), F.lit("b"), F.lit(n))) for n in (1, 2)] == ["Datei", "Dateien"]
    lines = spark.createDataFrame([(0, "; c"), (1, "[a]"), (2, "x = 1"), (3, "[b]"), (4, "y=2=3")], "n int, value string")
    assert sorted(map(tuple, catalogues.settings(lines).collect())) == [("a", "x", "1"), ("b", "y", "2=3")]
    data = spark.createDataFrame([(1, bytearray(b"MZ..")), (2, bytearray(b"PK"))], "id int, content binary")
    rules = [("dos", "MSDOS", "'MZ'"), ("bad", "X", "4"), ("zip", "ZIP", "504B"), ("any", "BINARY", "..")]
    assert sorted((r.id, r.name) for r in catalogues.scan_signatures(data, "id", rules).collect()) == [(1, "any"), (1, "dos"), (2, "any"), (2, "zip")]
    assert [r.is_valid for r in catalogues.signature_table(spark, rules).collect()] == [True, False, True, True]


def test_records_of_a_batch_are_objects_a_few_at_a_time(spark):
    """The records of some pages exist as Python objects at once, not those of the whole batch."""
    import tracemalloc

    from quarry.functions import udf
    from quarry.operators import strings_scan

    kind = udf.to_arrow_type(udf.T._parse_datatype_string(strings_scan.RECORD))
    pages = [(b"line %06d\n" % k) * 400 for k in range(500)]
    run = udf._batched(lambda content: strings_scan.find_strings(content, 6), kind)
    tracemalloc.start()
    got = run(udf.pa.array([*pages, None]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 501 and not got[500].is_valid and [len(got[k]) for k in (0, 499)] == [400, 400]
    assert got[499][399].as_py() == {"offset": 399 * 12, "byte_size": 11, "characters": 11, "encoding": "ASCII", "text": "line 000499", "truncated": False}
    assert peak < 30e6


def test_batch_functions_of_rows_at_once():
    """Slices give what the whole batch gives, with nulls, without rows, and with a row longer than a slice."""
    from quarry.functions import udf

    double = udf._batched(lambda content: content * 2, udf.pa.binary())
    rows = [b"ab", None, b"x" * (udf.SLICE_BYTES + 1), b"", *[b"%d" % k for k in range(3 * udf.SLICE_ROWS)]]
    assert double(udf.pa.array(rows)).to_pylist() == [r and r * 2 if r is not None else None for r in rows]
    assert double(udf.pa.array([], udf.pa.binary())).to_pylist() == []
    parts = list(udf._slices((udf.pa.array(rows, udf.pa.binary()),)))
    assert len(parts) > 3 and [x for (p,) in parts for x in p.to_pylist()] == rows
