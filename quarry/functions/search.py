"""Finding byte patterns: masks, literals, byte sets, and the signature notation.

A signature is read once, on the driver.  One that only compares and skips
becomes a regular expression over the latin-1 view of the content, so it runs
in the JVM; one that searches or jumps runs as an Arrow UDF.

Notation (blanks and case don't matter, ``?`` reads as ``.``):

==========  ============================================================
``4D5A``    these bytes, two digits each
``'MZ'``    these characters
``..``      any byte; ``**`` likewise
``%%``      a printable ASCII character; ``%&`` an ASCII digit
``!%``      no printable character; ``_%`` nor zero
``+4D5A``   go on to where these bytes stand next
``$$$$``    a signed offset of 1, 2, 4 or 8 bytes to jump by from its end
``####[b]`` an address of 1, 2, 4 or 8 bytes to jump to, less base ``b`` (hex)
==========  ============================================================
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bytes import latin1
from .udf import per_value

_TOKEN = re.compile(r"(?P<hex>[0-9a-f]+)|(?P<any>\.+|\*+)|(?P<cls>%%|%&|!%|_%)|(?P<find>\++[0-9a-f]+)|(?P<jump>\$+)|(?P<addr>#+(?:\[[0-9a-f]*\]#*)?)")
_CLASSES = {"%%": r"[\x20-\x7e]", "%&": r"[0-9]", "!%": r"[^\x20-\x7e]", "_%": r"[^\x00\x20-\x7e]"}
_SIZES = (1, 2, 4, 8)


def normalize(signature: str) -> str:
    """One notation for all: lower case, no blanks, quoted text as hex; an open quote gives the empty string."""
    parts = signature.split("'")
    if len(parts) % 2 == 0:
        return ""
    out = []
    for k, part in enumerate(parts):
        out.append(part.encode("latin-1", "replace").hex() if k % 2 else re.sub(r"\s+", "", part).lower().replace("?", "."))
    return "".join(out)


@dataclass(frozen=True)
class Step:
    """One step: bytes (as a regex), find, jump or address."""

    kind: str
    pattern: bytes = b""
    size: int = 0
    base: int = 0


def parse(signature: str) -> list[Step] | None:
    """The steps of a signature, or None if it is not valid."""
    text, at, steps = normalize(signature), 0, []
    if not text:
        return None
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return None
        kind, got = m.lastgroup, m.group()
        if kind in ("hex", "any"):
            if len(got) % 2:
                return None
            steps.append(Step("bytes", "".join(rf"\x{got[k : k + 2]}" if kind == "hex" else r"[\x00-\xff]" for k in range(0, len(got), 2)).encode()))
        elif kind == "cls":
            steps.append(Step("bytes", _CLASSES[got].encode()))
        elif kind == "find":
            digits = got.lstrip("+")
            if len(digits) % 2:
                return None
            steps.append(Step("find", bytes.fromhex(digits)))
        elif kind in ("jump", "addr"):
            marks = got.count("$") + got.count("#")  # a base may stand between or behind the marks
            if marks % 2 or marks // 2 not in _SIZES:
                return None
            base = got[got.index("[") + 1 : got.index("]")] if "[" in got else ""
            steps.append(Step(kind, size=marks // 2, base=int(base, 16) if base else 0))
        at += len(got)
    return steps


def is_valid(signature: str) -> bool:
    return parse(signature) is not None


def as_regex(signature: str) -> str | None:
    """A Java regex anchored at the start, or None if the signature searches, jumps or is not valid."""
    steps = parse(signature)
    if steps is None or any(s.kind in ("jump", "addr") for s in steps):
        return None
    return r"(?s)\A" + "".join(s.pattern.decode() if s.kind == "bytes" else ".*?" + "".join(rf"\x{b:02x}" for b in s.pattern) for s in steps)


def match_bytes(data: bytes, signature: str, offset: int = 0) -> bool:
    """Whether ``signature`` fits at ``offset``."""
    steps = parse(signature)
    if steps is None or not 0 <= offset <= len(data):
        return False
    at = offset
    for s in steps:
        if s.kind == "bytes":
            m = re.compile(s.pattern, re.S).match(data, at)
            if not m:
                return False
            at = m.end()
        elif s.kind == "find":
            at = data.find(s.pattern, at)
            if at < 0:
                return False
            at += len(s.pattern)
        else:
            if at + s.size > len(data):
                return False
            value = int.from_bytes(data[at : at + s.size], "little", signed=s.kind == "jump")
            at = at + s.size + value if s.kind == "jump" else value - s.base
            if not 0 <= at <= len(data):
                return False
    return True


@per_value("boolean")
def _match(data: bytes, signature: str, offset: int):
    return match_bytes(data, signature, offset)


def matches(data: Column, signature: str, offset: int = 0) -> Column:
    """Whether ``signature`` fits ``data`` at ``offset``, in the JVM where it can be."""
    regex = as_regex(signature)
    if regex is None:
        return _match(data, signature, offset) if is_valid(signature) else F.lit(False)
    return F.coalesce(latin1(F.substring(data, offset + 1, 2**31 - 1 - offset)).rlike(regex), F.lit(False))


MAX_PROBES = 4


def mask_find(data: bytes, first: int, last: int, probes: list[tuple[int, int, int]]) -> int | None:
    """The lowest position from ``first`` to ``last`` where every (offset, mask, value) probe holds."""
    if not 0 < len(probes) <= MAX_PROBES or first > last or any(v & ~m & 255 or last + o >= len(data) for o, m, v in probes):
        return None
    b = np.frombuffer(data, np.uint8)
    ok = np.ones(last - first + 1, bool)
    for o, m, v in probes:
        ok &= b[first + o : last + o + 1] & m == v
    hit = np.flatnonzero(ok)
    return first + int(hit[0]) if len(hit) else None


def masked_position(data: Column, probes: list[tuple[int, int, int]]) -> Column:
    """Where all probes first hold; null if nowhere."""
    reach = max((o for o, _, _ in probes), default=0)

    @per_value("bigint")
    def run(content: bytes):
        return mask_find(content, 0, len(content) - 1 - reach, probes)

    return run(data)


def literal_hits(data: Column, literals: list[bytes]) -> Column:
    """``array<struct<offset,literal>>`` of all, also overlapping, occurrences, by offset, then by number."""
    pattern = [re.compile(b"(?=" + re.escape(x) + b")") for x in literals]

    @per_value("array<struct<offset:bigint,literal:int>>")
    def run(content: bytes):
        return [{"offset": o, "literal": k} for o, k in sorted((m.start(), k) for k, p in enumerate(pattern) for m in p.finditer(content))]

    return run(data)


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def nocase_position(data: Column, needle: str) -> Column:
    """Where ``needle`` first stands, in any ASCII case; null if nowhere."""
    p = F.instr(ascii_lower(latin1(data)), needle.lower())
    return F.when(p > 0, p - 1)


def byteset_position(data: Column, values: bytes) -> Column:
    """Where a byte of the set first stands; null if nowhere."""
    cls = "".join(rf"\x{b:02x}" for b in sorted(set(values)))
    p = F.regexp_instr(latin1(data), F.lit(f"[{cls}]"))
    return F.when(p > 0, p - 1)


def guarded_rlike(text: Column, literal: str, pattern: str) -> Column:
    """A regex that only runs where a literal it needs occurs."""
    return F.when(F.contains(text, F.lit(literal)), text.rlike(pattern)).otherwise(False)


def any_name_matches(names: Column, pattern: str, literal: str | None = None) -> Column:
    """Whether some name has a non-empty match.

    With a ``literal`` that every match holds, the regex runs on names with it only, so that names which are built to
    make it go back cost one search.
    """

    def hit(n: Column) -> Column:
        found = F.length(F.regexp_extract(n, pattern, 0)) > 0
        return found if literal is None else F.when(F.contains(n, F.lit(literal)), found).otherwise(False)

    return F.exists(names, hit)


def captures(data: Column, pattern: str, ignore_case: bool = False, multi_line: bool = False, first_only: bool = False) -> Column:
    """All matches of a regex over bytes with their groups: ``array<struct<start,end,groups>>``, offsets in bytes."""
    compiled = re.compile(pattern.encode("latin-1"), (re.I if ignore_case else 0) | (re.M if multi_line else 0))

    @per_value("array<struct<start:bigint,end:bigint,groups:array<string>>>")
    def run(content: bytes):
        out = []
        for m in compiled.finditer(content):
            out.append({"start": m.start(), "end": m.end(), "groups": [g if g is None else g.decode("latin-1") for g in (m.group(), *m.groups())]})
            if first_only:
                break
        return out

    return run(data)
