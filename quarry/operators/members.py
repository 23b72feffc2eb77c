"""Members of containers, and regions within regions.

``list_members`` turns a container into rows (index, name, offset, sizes,
method, checksum); ``extract`` adds the decoded bytes and a status.  Both run as
Arrow UDFs behind the signature of the type, so a content that has the wrong
first bytes never reaches Python.  ``recurse`` opens containers in containers, all
levels of a content in one call.  Listings are whole unless a limit is asked for,
and then say whether there was more.
"""

from __future__ import annotations

import io
import itertools
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import bytes as b
from quarry.functions.codecs import DECODERS, ENCODERS, decode_bytes
from quarry.functions.udf import per_value

MEMBER = "struct<index:int,name:string,offset:bigint,compressed_size:bigint,uncompressed_size:bigint,method:string,crc32:bigint,mtime:bigint>"
#: What a BINARY value of Spark can hold; longer members are listed, and extracted as ``failed``.
MAX_MEMBER_SIZE = (1 << 31) - 64
STEP = 1 << 16


@dataclass(frozen=True)
class Member:
    name: str | None
    offset: int
    compressed: int
    size: int | None
    method: str = "store"
    crc: int | None = None
    mtime: int | None = None


def gzip_members(data: bytes) -> Iterator[Member]:
    """Each member of a gzip file, by decoding: a stream's end is not written anywhere else."""
    at = 0
    while data[at : at + 2] == b"\x1f\x8b" and len(data) - at >= 18:
        flags, mtime = data[at + 3], struct.unpack_from("<I", data, at + 4)[0]
        p, name = at + 10, None
        if flags & 4:
            p += 2 + struct.unpack_from("<H", data, p)[0]
        for bit in (8, 16):
            if flags & bit:
                end = data.find(b"\0", p)
                if end < 0:
                    return
                name = data[p:end].decode("latin-1") if bit == 8 else name
                p = end + 1
        p += 2 * bool(flags & 2)
        # Some input and 1 MiB of output at a time: a member's size is not bounded, and nothing of it is kept.
        d, size, fed = zlib.decompressobj(-15), 0, p
        try:
            while fed < len(data) and not d.eof:
                rest = data[fed : fed + STEP]
                fed += len(rest)
                while rest and not d.eof:
                    size += len(d.decompress(rest, 1 << 20))
                    rest = d.unconsumed_tail
        except zlib.error:
            return
        end = fed - len(d.unused_data)
        if not d.eof or end + 8 > len(data):
            return
        crc, length = struct.unpack_from("<II", data, end)
        if length != size & 0xFFFFFFFF:
            return
        yield Member(name, p, end - p, size, "deflate", crc, mtime)
        at = end + 8


def zip_members(data: bytes) -> Iterator[Member]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                if i.is_dir():
                    continue
                name, extra = struct.unpack_from("<HH", data, i.header_offset + 26)
                method = {0: "store", 8: "deflate", 12: "bzip2", 14: "lzma_zip", 93: "zstd"}.get(i.compress_type, str(i.compress_type))
                yield Member(i.filename, i.header_offset + 30 + name + extra, i.compress_size, i.file_size, method, i.CRC)
    except (zipfile.BadZipFile, struct.error, OSError, ValueError, NotImplementedError):
        return


def tar_members(data: bytes) -> Iterator[Member]:
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
            for i in t:
                if i.isfile():
                    yield Member(i.name, i.offset_data, i.size, i.size, mtime=int(i.mtime))
    except (tarfile.TarError, ValueError, OSError):
        return


def ar_members(data: bytes) -> Iterator[Member]:
    if data[:8] != b"!<arch>\n":
        return
    at, names = 8, b""
    while at + 60 <= len(data):
        head = data[at : at + 60]
        if head[58:] != b"`\n" or not head[48:58].strip().isdigit():
            return
        size, name = int(head[48:58]), head[:16].rstrip()
        start = at + 60
        if start + size > len(data):
            return
        if name == b"//":
            names = data[start : start + size]
        elif name not in (b"/", b"__.SYMDEF"):
            shift = 0
            if name[:1] == b"/" and name[1:].isdigit():
                name = names[int(name[1:]) :].split(b"\n")[0]
            elif name[:3] == b"#1/" and name[3:].isdigit():
                shift = int(name[3:])
                name = data[start : start + shift].rstrip(b"\0")
            yield Member(name.rstrip(b"/").decode("utf-8", "replace"), start + shift, size - shift, size - shift, mtime=int(head[16:28].strip() or 0))
        at = start + size + size % 2


def cpio_members(data: bytes) -> Iterator[Member]:
    at = 0
    while at < len(data):
        magic = data[at : at + 6]
        try:
            if magic in (b"070701", b"070702"):
                f = [int(data[at + 6 + 8 * k : at + 14 + 8 * k], 16) for k in range(13)]
                size, mtime, name_size, start = f[6], f[5], f[11], at + 110
                body = at + (110 + name_size + 3) // 4 * 4
                after = body + (size + 3) // 4 * 4
                mode = f[1]
            elif magic == b"070707":
                head = data[at : at + 76]
                size, mtime, name_size, mode, start = int(head[65:76], 8), int(head[48:59], 8), int(head[59:65], 8), int(head[18:24], 8), at + 76
                body = start + name_size
                after = body + size
            else:
                return
        except ValueError:
            return
        name = data[start : start + name_size].rstrip(b"\0").decode("utf-8", "replace")
        if name == "TRAILER!!!" or body + size > len(data):
            return
        if mode & 0o170000 == 0o100000:
            yield Member(name, body, size, size, mtime=mtime)
        at = after


def _warc_names(records: list[tuple[str, int, int]]) -> Iterator[Member]:
    """The path of a record's address if no other record claims it or lies below it, else ``records/<n>``."""
    paths = []
    for uri, _, _ in records:
        rest = uri.split("://", 1)[-1].split("?")[0].split("#")[0]
        path = rest.split("/", 1)[1] if "/" in rest else ""
        paths.append(path if path and not path.endswith("/") else "")
    folded = [p.lower() for p in paths]
    for k, (_, at, size) in enumerate(records):
        p = folded[k]
        clash = not p or folded.count(p) > 1 or any(q.startswith(p + "/") for q in folded)
        yield Member(f"records/{k:08d}" if clash else paths[k], at, size, size)


def warc_members(data: bytes) -> Iterator[Member]:
    """Content records of a WARC file; the whole file must be well formed."""
    at, records = 0, []
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            return
        head = dict(line.split(b":", 1) for line in data[at:end].split(b"\r\n")[1:] if b":" in line)
        fields = {k.strip().lower(): v.strip() for k, v in head.items()}
        length = fields.get(b"content-length", b"")
        if not length.isdigit() or b"warc-type" not in fields:
            return
        body, size = end + 4, int(length)
        if data[body + size : body + size + 4] != b"\r\n\r\n":
            return
        uri = fields.get(b"warc-target-uri", b"").strip(b"<>").decode("utf-8", "replace")
        if fields[b"warc-type"] in (b"response", b"resource", b"conversion") and ".." not in uri.split("/"):
            records.append((uri, body, size))
        at = body + size + 4
    yield from _warc_names(records)


def fasta_members(data: bytes) -> Iterator[Member]:
    """Sequences of a FASTA file: at most 4,096 records and 16,777,216 letters."""
    if not data.startswith(b">"):
        return
    found, letters, at = [], 0, 0
    while at < len(data):
        line = data.find(b"\n", at)
        line = len(data) if line < 0 else line
        name = data[at + 1 : line].split()[:1]
        nxt = data.find(b"\n>", line)
        end = len(data) if nxt < 0 else nxt + 1
        body = data[line + 1 : end]
        bases = sum(map(len, body.split()))
        if not name or not bases or not all(c in b"ABCDEFGHIKLMNPQRSTUVWXYZabcdefghiklmnpqrstuvwxyz*-. \r\n\t" for c in set(body)):
            return
        letters += bases
        found.append(Member(name[0].decode("utf-8", "replace"), line + 1, len(body), bases))
        at = end
    if len(found) <= 4096 and letters <= 1 << 24:
        yield from found


def dbf_members(data: bytes) -> Iterator[Member]:
    """Records of a dBASE table."""
    if len(data) < 33:
        return
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields = (head - 33) // 32
    if head < 33 or head > len(data) or data[head - 1] != 0x0D or size != 1 + sum(data[32 + 32 * k + 16] for k in range(fields)) or head + n * size > len(data):
        return
    for k in range(n):
        yield Member(f"record{k}", head + k * size, size, size, "deleted" if data[head + k * size] == 0x2A else "store")


def cab_members(data: bytes) -> Iterator[Member]:
    """Files of a cabinet; those of uncompressed folders can be read in place."""
    if data[:4] != b"MSCF" or len(data) < 36:
        return
    total, files_at, folders, files, flags = struct.unpack_from("<I", data, 8)[0], struct.unpack_from("<I", data, 16)[0], *struct.unpack_from("<HHH", data, 26)
    if total > len(data) or flags & 7:
        return
    try:
        folder = [struct.unpack_from("<IHH", data, 36 + 8 * k) for k in range(folders)]
        at = files_at
        for _ in range(files):
            size, start, which = struct.unpack_from("<IIH", data, at)
            end = data.index(b"\0", at + 16)
            name, at = data[at + 16 : end].decode("latin-1"), end + 1
            block, _, method = folder[which]
            stored = method & 15 == 0
            if stored and block + 8 + start + size > total:
                return
            yield Member(name, block + 8 + start if stored else block, size, size, "store" if stored else {1: "mszip", 2: "quantum", 3: "lzx"}.get(method & 15, "unknown"))
    except (struct.error, ValueError, IndexError):
        return


def _whole(method: str) -> Callable[[bytes], Iterator[Member]]:
    """A format that wraps one stream."""

    def run(data: bytes) -> Iterator[Member]:
        out = decode_bytes(data, method, MAX_MEMBER_SIZE)
        if out is not None:
            yield Member(None, 0, len(data), len(out), method, zlib.crc32(out))

    return run


READERS: dict[str, tuple[str, int, Callable[[bytes], Iterator[Member]]]] = {
    "GZIP": ("1F8B08", 0, gzip_members),
    "ZIP": ("504B", 0, zip_members),
    "TAR": ("7573746172", 257, tar_members),
    "AR": ("213C617263683E0A", 0, ar_members),
    "CPIO": ("30373037", 0, cpio_members),
    "WARC": ("574152432F", 0, warc_members),
    "FASTA": ("3E", 0, fasta_members),
    "DBF": ("03", 0, dbf_members),
    "CAB": ("4D534346", 0, cab_members),
    "BZIP2": ("425A68", 0, _whole("bzip2")),
    "XZ": ("FD377A585A00", 0, _whole("xz")),
    "ZSTD": ("28B52FFD", 0, _whole("zstd")),
    "COMPRESS": ("1F9D", 0, _whole("compress")),
    "SZDD": ("535A444488F02733", 0, _whole("szdd")),
}


def register_reader(name: str, magic: str, offset: int, read: Callable[[bytes], Iterator[Member]]) -> None:
    """Add a format: what it begins with, and how its members are listed."""
    READERS[name] = (magic, offset, read)


def container_type(data: Column) -> Column:
    """The first reader whose signature fits."""
    out = F.lit(None).cast("string")
    for name, (magic, offset, _) in reversed(READERS.items()):
        out = F.when(b.at(data, offset, magic), name).otherwise(out)
    return out


def kind_of(data: bytes) -> str | None:
    """The first reader whose signature fits."""
    return next((k for k, (magic, offset, _) in READERS.items() if data.startswith(bytes.fromhex(magic), offset)), None)


def _listed(data: bytes, kind: str, limit: int = 0) -> list[Member]:
    """All members, or the first ``limit`` of them."""
    return list(itertools.islice(READERS[kind][2](data), limit or None))


def _row(k: int, m: Member) -> dict:
    return {"index": k, "name": m.name, "offset": m.offset, "compressed_size": m.compressed, "uncompressed_size": m.size, "method": m.method, "crc32": m.crc, "mtime": m.mtime}


def member_bytes(data: bytes, m: Member) -> bytes | None:
    raw = data[m.offset : m.offset + m.compressed]
    if m.method == "deleted":
        return raw
    out = decode_bytes(raw, m.method, MAX_MEMBER_SIZE) if m.method in DECODERS else None
    return None if out is not None and m.crc is not None and zlib.crc32(out) != m.crc else out


@per_value(f"array<{MEMBER}>")
def _members(data: bytes, kind: str, limit: int):
    return [_row(k, m) for k, m in enumerate(_listed(data, kind, limit))]


@per_value("array<struct<index:int,name:string,content:binary,status:string>>")
def _extracted(data: bytes, kind: str):
    rows = [(k, m, member_bytes(data, m)) for k, m in enumerate(_listed(data, kind))]
    return [{"index": k, "name": m.name, "content": c, "status": "failed" if c is None else "ok"} for k, m, c in rows]


def _typed(contents: DataFrame, data: str, kind: str | None) -> DataFrame:
    """``contents`` with their reader, null for those that have none.

    These are not filtered out: a filter would be pushed below the columns, and what makes a content, Python as well, would run twice.
    """
    return contents.withColumn("container", F.lit(kind) if kind else container_type(F.col(data)))


def _container(data: str) -> Column:
    """The content if it has a reader; else null, which has no members."""
    return F.when(F.col("container").isNotNull(), F.col(data))


def list_members(contents: DataFrame, key: str, data: str = "content", kind: str | None = None, limit: int = 0) -> DataFrame:
    """One row for each member of each container, in the container's order.

    With a ``limit``, the first so many of each container, and a column ``truncated`` that tells whether there are more.
    """
    typed = _typed(contents, data, kind)
    found = _members(_container(data), F.col("container"), F.lit(limit + 1 if limit else 0))
    if not limit:
        return typed.select(key, "container", F.explode(found).alias("m")).select(key, "container", "m.*")
    listed = typed.select(key, "container", found.alias("f"))
    return listed.select(key, "container", F.explode(F.slice("f", 1, limit)).alias("m"), (F.size("f") > limit).alias("truncated")).select(key, "container", "m.*", "truncated")


def extract(contents: DataFrame, key: str, data: str = "content", kind: str | None = None) -> DataFrame:
    """One row for each member with its decoded bytes; null, and ``failed``, where decoding or a checksum fails."""
    return _typed(contents, data, kind).select(key, "container", F.explode(_extracted(_container(data), F.col("container"))).alias("m")).select(key, "container", "m.*")


def is_valid(data: Column, kind: str) -> Column:
    """Whether a content has the format's signature and at least one readable member."""
    magic, offset, _ = READERS[kind]
    return F.when(b.at(data, offset, magic), F.size(_members(data, F.lit(kind), F.lit(1))) > 0).otherwise(False)


REGION = "struct<path:array<int>,depth:int,name:string,content:binary>"


@per_value(f"array<{REGION}>")
def _regions(data: bytes, max_depth: int):
    out, level = [], [([], data)]
    for depth in range(1, max_depth + 1):
        inner = []
        for path, content in level:
            kind = kind_of(content)
            for k, m in enumerate(_listed(content, kind) if kind else ()):
                got = member_bytes(content, m)
                if got is not None:
                    out.append({"path": [*path, k], "depth": depth, "name": m.name, "content": got})
                    inner.append(([*path, k], got))
        level = inner
    return out


def recurse(contents: DataFrame, key: str, data: str = "content", max_depth: int = 4) -> DataFrame:
    """All regions reachable through containers: key, path of member numbers, depth, name, content.

    Every content is opened once, with all its levels; contents that are no container stay out of Python.
    """
    rows = contents.select(F.col(key), F.col(data).alias("_data"))
    whole = F.struct(F.array().cast("array<int>").alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("name"), F.col("_data").alias("content")).cast(REGION)
    inner = _regions(F.when(container_type(F.col("_data")).isNotNull(), F.col("_data")), F.lit(max_depth))
    return rows.select(key, F.explode(F.concat(F.array(whole), F.coalesce(inner, F.array().cast(f"array<{REGION}>")))).alias("r")).select(key, "r.*")


def pack_tar(rows: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name, data in rows:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def pack_zip(rows: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in rows:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def pack_cpio(rows: list[tuple[str, bytes]]) -> bytes:
    out = bytearray()
    for k, (name, data) in enumerate([*rows, ("TRAILER!!!", b"")]):
        raw = name.encode() + b"\0"
        head = "070701" + "".join(f"{v:08X}" for v in (k, 0o100644, 0, 0, 1, 0, len(data), 0, 0, 0, 0, len(raw), 0))
        out += head.encode() + raw
        out += bytes(-len(out) % 4) + data
        out += bytes(-len(out) % 4)
    return bytes(out)


def _compressed_tar(kind: str) -> Callable[[list[tuple[str, bytes]]], bytes]:
    def run(rows: list[tuple[str, bytes]]) -> bytes:
        return ENCODERS[kind](pack_tar(rows))

    return run


PACKERS = {"tar": pack_tar, "zip": pack_zip, "cpio": pack_cpio, **{f"tar_{k}": _compressed_tar(m) for k, m in (("gz", "gzip"), ("bz2", "bzip2"), ("xz", "xz"), ("zstd", "zstd"))}}
#: Readers by the extension of a file's name.
EXTENSIONS = {
    "gz": "GZIP", "tgz": "GZIP", "zip": "ZIP", "jar": "ZIP", "apk": "ZIP", "tar": "TAR", "a": "AR", "deb": "AR", "cpio": "CPIO", "warc": "WARC", "fa": "FASTA", "fasta": "FASTA", "dbf": "DBF", "cab": "CAB", "bz2": "BZIP2", "xz": "XZ", "zst": "ZSTD", "z": "COMPRESS",
}


def reader_for(data: Column, name: Column | None = None, file_type: Column | None = None) -> Column:
    """The reader of a content: by its type if that has one, else by its signature, else by its name's extension."""
    by_type = F.when(file_type.isin(*READERS), file_type) if file_type is not None else F.lit(None).cast("string")
    pairs = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    by_name = F.try_element_at(pairs, F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))) if name is not None else F.lit(None).cast("string")
    return F.coalesce(by_type, container_type(data), by_name)


def pack(names: Column, contents: Column, kind: str) -> Column:
    """A container made of parallel arrays of names and contents."""

    @per_value("binary")
    def run(n: list, c: list):
        return PACKERS[kind](list(zip(n, c, strict=True)))

    return run(names, contents)


from quarry.operators import readers as _readers  # noqa: E402  the declared formats register themselves

PACKERS |= {"wad": _readers.pack_wad, "quake_pak": _readers.pack_pak, "riff": _readers.pack_riff}
