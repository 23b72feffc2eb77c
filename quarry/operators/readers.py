"""More member readers: chunked files, archives with a table, and simple streams of records.

Most formats of these kinds differ in a signature, a byte order and the fields
of an entry, so they are declared; a few need a loop of their own.
"""

from __future__ import annotations

import binascii
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from quarry.operators.members import Member, register_reader


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1").rstrip()


# ---- chunks: a tag, a size and a body, one after the other


@dataclass(frozen=True)
class Chunks:
    """Where chunks begin, how their head reads (tag and size), and what comes after a body."""

    start: int
    head: str
    align: int = 1
    trailer: int = 0
    size_has_head: bool = False
    tag_last: bool = False
    end: bytes | None = None  # the tag of the last chunk, which must be there

    def __call__(self, data: bytes) -> Iterator[Member]:
        at, width = self.start, struct.calcsize(self.head)
        while at + width <= len(data):
            a, b = struct.unpack_from(self.head, data, at)
            tag, size = (b, a) if self.tag_last else (a, b)
            body = at + width
            size -= width if self.size_has_head else 0
            if size < 0 or body + size > len(data):
                return
            yield Member(_text(tag) if isinstance(tag, bytes) else str(tag), body, size, size)
            if self.end is not None and tag == self.end:
                return
            at = body + size + self.trailer
            at += -at % self.align


# ---- tables: a directory of entries with a name, a place and a size


@dataclass(frozen=True)
class Table:
    """Where the number of entries and the first entry are found, and how an entry reads.

    ``count`` and ``first`` are (format, offset), or a number; ``entry`` is a
    struct format with the positions of name, place and size in it.  Entries
    without a place lie one after the other behind the table.
    """

    count: tuple[str, int]
    first: tuple[str, int] | int
    entry: str
    name: int | None
    place: int | None
    size: int
    count_in_bytes: bool = False
    base: int = 0

    def __call__(self, data: bytes) -> Iterator[Member]:
        try:
            n = struct.unpack_from(self.count[0], data, self.count[1])[0]
            at = self.first if isinstance(self.first, int) else struct.unpack_from(self.first[0], data, self.first[1])[0]
            width = struct.calcsize(self.entry)
            n = n // width if self.count_in_bytes else n
            if at + n * width > len(data):
                return
            follow = at + n * width
            for k in range(n):
                e = struct.unpack_from(self.entry, data, at + k * width)
                size = e[self.size]
                place = follow if self.place is None else e[self.place] + self.base
                follow += size if self.place is None else 0
                if place + size > len(data):
                    return
                yield Member(str(k) if self.name is None else _text(e[self.name]), place, size, size)
        except struct.error:
            return


def big_members(data: bytes) -> Iterator[Member]:
    """EA's BIG archives: big-endian places and sizes with zero-ended names."""
    at = 16
    try:
        for _ in range(struct.unpack_from(">I", data, 8)[0]):
            place, size = struct.unpack_from(">II", data, at)
            end = data.index(b"\0", at + 8)
            if place + size > len(data):
                return
            yield Member(data[at + 8 : end].decode("latin-1"), place, size, size)
            at = end + 1
    except (struct.error, ValueError):
        return


def inline_members(entry: str, start: int):
    """Heads with a name and a size, each right before its body, to the end of the file."""

    def run(data: bytes) -> Iterator[Member]:
        at, width = start, struct.calcsize(entry)
        while at + width <= len(data):
            name, size = struct.unpack_from(entry, data, at)
            if at + width + size > len(data):
                return
            yield Member(_text(name), at + width, size, size)
            at += width + size

    return run


def gif_members(data: bytes) -> Iterator[Member]:
    """Images and extensions of a GIF, each with its sub-blocks."""
    try:
        at = 13 + (3 << (data[10] & 7) + 1 if data[10] & 128 else 0)
        while data[at] != 0x3B:
            kind, start = data[at], at
            if kind == 0x2C:
                flags = data[at + 9]
                at += 11 + (3 << (flags & 7) + 1 if flags & 128 else 0)
            elif kind == 0x21:
                at += 2
            else:
                return
            while data[at]:
                at += data[at] + 1
            at += 1
            yield Member("image" if kind == 0x2C else f"extension{data[start + 1]:02x}", start, at - start, at - start)
    except IndexError:
        return


def flac_members(data: bytes) -> Iterator[Member]:
    at = 4
    while at + 4 <= len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if at + 4 + size > len(data):
            return
        yield Member(f"block{kind & 127}", at + 4, size, size)
        at += 4 + size
        if kind & 128:
            yield Member("frames", at, len(data) - at, len(data) - at)
            return


def ogg_members(data: bytes) -> Iterator[Member]:
    at, k = 0, 0
    while data[at : at + 4] == b"OggS" and at + 27 <= len(data):
        lengths = data[at + 27 : at + 27 + data[at + 26]]
        body, size = at + 27 + len(lengths), sum(lengths)
        if body + size > len(data):
            return
        yield Member(f"page{k}", body, size, size)
        at, k = body + size, k + 1


def wasm_members(data: bytes) -> Iterator[Member]:
    at = 8
    while at < len(data):
        kind, at, size, shift = data[at], at + 1, 0, 0
        while at < len(data):
            b, at = data[at], at + 1
            size |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        if at + size > len(data):
            return
        yield Member(f"section{kind}", at, size, size)
        at += size


def mp4_members(data: bytes) -> Iterator[Member]:
    at = 0
    while at + 8 <= len(data):
        size, kind, head = *struct.unpack_from(">I4s", data, at), 8
        if size == 1 and at + 16 <= len(data):
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = len(data) - at if size == 0 else size
        if size < head or at + size > len(data):
            return
        yield Member(_text(kind), at + head, size - head, size - head)
        at += size


def pcap_members(data: bytes) -> Iterator[Member]:
    order = "<" if data[:4] in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
    at, k = 24, 0
    while at + 16 <= len(data):
        when, _, size, full = struct.unpack_from(order + "IIII", data, at)
        if at + 16 + size > len(data):
            return
        yield Member(f"packet{k}", at + 16, size, size, mtime=when)
        at, k = at + 16 + size, k + 1


def mbox_members(data: bytes) -> Iterator[Member]:
    starts = [0, *(m.start() + 1 for m in re.finditer(rb"\nFrom ", data))]
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(data)], strict=True)):
        yield Member(f"message{k}", a, b - a, b - a)


def iso_members(data: bytes) -> Iterator[Member]:
    """Files of an ISO 9660 volume, directories first to last."""
    if data[0x8001:0x8006] != b"CD001":
        return
    queue, seen = [("", *struct.unpack_from("<I4xI", data, 0x8000 + 156 + 2))], set()
    while queue:
        path, extent, size = queue.pop(0)
        if extent in seen or extent * 2048 + size > len(data):
            continue
        seen.add(extent)
        at, end = extent * 2048, extent * 2048 + size
        while at < end:
            length = data[at]
            if not length:
                at += 2048 - at % 2048
                continue
            place, n = struct.unpack_from("<I4xI", data, at + 2)
            raw = data[at + 33 : at + 33 + data[at + 32]]
            if raw not in (b"\0", b"\1"):
                name = path + raw.split(b";")[0].decode("latin-1").rstrip(".")
                if data[at + 25] & 2:
                    queue.append((name + "/", place, n))
                elif place * 2048 + n <= len(data):
                    yield Member(name, place * 2048, n, n)
            at += length


def arc_members(data: bytes) -> Iterator[Member]:
    """SEA's ARC: stored and run-length members are readable."""
    at = 0
    while at + 29 <= len(data) and data[at] == 0x1A and data[at + 1]:
        method = data[at + 1]
        size, _, _, _ = struct.unpack_from("<IHHH", data, at + 15)
        full = struct.unpack_from("<I", data, at + 25)[0] if method > 1 else size
        body = at + (29 if method > 1 else 25)
        if body + size > len(data):
            return
        yield Member(_text(data[at + 2 : at + 15]), body, size, full, {1: "store", 2: "store", 3: "rle90"}.get(method, f"arc{method}"))
        at = body + size


def lha_members(data: bytes) -> Iterator[Member]:
    """LHA headers of levels 0, 1 and 2; ``-lh0-`` and ``-lz4-`` members are stored."""
    at = 0
    while at + 22 <= len(data) and data[at]:
        method, size, full, level = data[at + 2 : at + 7], *struct.unpack_from("<II", data, at + 7), data[at + 20]
        if method[:1] + method[-1:] != b"--":
            return
        if level == 2:
            head = struct.unpack_from("<H", data, at)[0]
            name, p = "", at + 24
            while p + 2 <= len(data) and (n := struct.unpack_from("<H", data, p)[0]):
                name = data[p + 3 : p + n].decode("latin-1") if data[p + 2] == 1 else name
                p += n
            body = at + head
        else:
            head, n = data[at] + 2, data[at + 21]
            name, body = data[at + 22 : at + 22 + n].decode("latin-1"), at + head
            if level == 1:
                p = at + head - 2
                while p + 2 <= len(data) and (n := struct.unpack_from("<H", data, p)[0]):
                    p, body, size = p + n, body + n, size - n
        if size < 0 or body + size > len(data):
            return
        if method != b"-lhd-":
            yield Member(name, body, size, full, "store" if method in (b"-lh0-", b"-lz4-") else method.decode("latin-1").strip("-"))
        at = body + size


def uu_members(data: bytes) -> Iterator[Member]:
    """Uuencoded files; a member is its encoded lines."""
    for m in re.finditer(rb"^begin [0-7]{3,4} ([^\r\n]+)\r?\n(.*?)^end", data, re.M | re.S):
        try:
            size = sum(len(binascii.a2b_uu(line)) for line in m.group(2).splitlines() if line.strip())
        except binascii.Error:
            continue
        yield Member(m.group(1).decode("latin-1"), m.start(2), len(m.group(2)), size, "uuencode")


def fits_members(data: bytes) -> Iterator[Member]:
    """Header and data units of a FITS file."""
    at, k = 0, 0
    while at + 2880 <= len(data):
        cards, p = {}, at
        while p + 80 <= len(data):
            card = data[p : p + 80].decode("latin-1")
            p += 80
            if card.startswith("END "):
                break
            if card[8:10] == "= ":
                cards[card[:8].strip()] = card[10:].split("/")[0].strip()
        body = at + -(-(p - at) // 2880) * 2880
        try:
            axes = [int(cards[f"NAXIS{j + 1}"]) for j in range(int(cards.get("NAXIS", "0")))]
            size = abs(int(cards.get("BITPIX", "8"))) // 8
        except (KeyError, ValueError):
            return
        for x in axes:
            size *= x
        size = size if axes else 0
        if body + size > len(data):
            return
        yield Member(cards.get("EXTNAME", f"'unit{k}'").strip("' "), body, size, size)
        at, k = body + -(-size // 2880) * 2880, k + 1


#: name, signature, its offset, reader
FORMATS = (
    ("PNG", "89504E470D0A1A0A", 0, Chunks(8, ">I4s", tag_last=True, trailer=4, end=b"IEND")),
    ("RIFF", "52494646", 0, Chunks(12, "<4sI", align=2)),
    ("IFF", "464F524D", 0, Chunks(12, ">4sI", align=2)),
    ("MIDI", "4D546864", 0, Chunks(0, ">4sI")),
    ("ICNS", "69636E73", 0, Chunks(8, ">4sI", size_has_head=True)),
    ("MP4", "66747970", 4, mp4_members),
    ("GIF", "474946", 0, gif_members),
    ("FLAC", "664C6143", 0, flac_members),
    ("OGG", "4F676753", 0, ogg_members),
    ("WASM", "0061736D", 0, wasm_members),
    ("PCAP", "D4C3B2A1", 0, pcap_members),
    ("PCAP_BE", "A1B2C3D4", 0, pcap_members),
    ("MBOX", "46726F6D20", 0, mbox_members),
    ("ISO9660", "4344303031", 0x8001, iso_members),
    ("FITS", "53494D504C4520203D", 0, fits_members),
    ("WAD", "50574144", 0, Table(("<I", 4), ("<I", 8), "<II8s", 2, 0, 1)),
    ("IWAD", "49574144", 0, Table(("<I", 4), ("<I", 8), "<II8s", 2, 0, 1)),
    ("WAD2", "57414432", 0, Table(("<I", 4), ("<I", 8), "<IIIBBH16s", 6, 0, 1)),
    ("WAD3", "57414433", 0, Table(("<I", 4), ("<I", 8), "<IIIBBH16s", 6, 0, 1)),
    ("QUAKE_PAK", "5041434B", 0, Table(("<I", 8), ("<I", 4), "<56sII", 0, 1, 2, count_in_bytes=True)),
    ("BUILD_GRP", "4B656E53696C7665726D616E", 0, Table(("<I", 12), 16, "<12sI", 0, None, 1)),
    ("BIGF", "42494746", 0, big_members),
    ("BIG4", "42494734", 0, big_members),
    ("DESCENT_HOG", "444846", 0, inline_members("<13sI", 3)),
    ("TTF", "0001000000", 0, Table((">H", 4), 12, ">4sIII", 0, 2, 3)),
    ("OTF", "4F54544F", 0, Table((">H", 4), 12, ">4sIII", 0, 2, 3)),
    ("WOFF", "774F4646", 0, Table((">H", 12), 44, ">4sIIII", 0, 1, 2)),
    ("ICO", "00000100", 0, Table(("<H", 4), 6, "<BBBBHHII", None, 7, 6)),
    ("CUR", "00000200", 0, Table(("<H", 4), 6, "<BBBBHHII", None, 7, 6)),
    ("UUENCODE", "626567696E20", 0, uu_members),
    ("LHA", "2D6C68", 2, lha_members),
    ("LZS", "2D6C7A", 2, lha_members),
    ("ARC", "1A", 0, arc_members),
)

for _row in FORMATS:
    register_reader(*_row)


def pack_wad(rows: list[tuple[str, bytes]]) -> bytes:
    body, table = bytearray(12), b""
    for name, data in rows:
        table += struct.pack("<II8s", len(body), len(data), name.encode("latin-1")[:8])
        body += data
    struct.pack_into("<4sII", body, 0, b"PWAD", len(rows), len(body))
    return bytes(body) + table


def pack_pak(rows: list[tuple[str, bytes]]) -> bytes:
    body, table = bytearray(12), b""
    for name, data in rows:
        table += struct.pack("<56sII", name.encode("latin-1")[:56], len(body), len(data))
        body += data
    struct.pack_into("<4sII", body, 0, b"PACK", len(body), len(table))
    return bytes(body) + table


def pack_riff(rows: list[tuple[str, bytes]]) -> bytes:
    body = b"LIST"
    for name, data in rows:
        body += struct.pack("<4sI", name.encode("latin-1")[:4].ljust(4), len(data)) + data + bytes(len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body
