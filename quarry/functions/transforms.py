"""Transforms of bytes and numbers: word operations, base64, variable-length and textual numbers."""

from __future__ import annotations

import base64
import math
import re
import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bytes import latin1
from .udf import per_value

KINDS = ("fill", "xor", "and", "or", "not", "add", "subtract", "rotate_left", "rotate_right", "swap_endian")


def transform_bytes(data: bytes, kind: str, width: int = 1, operand: int = 0, big_endian: bool = False, pattern: bytes = b"", phase: int = 0) -> bytes | None:
    """``kind`` applied to each word of ``width`` bytes, modulo its size; None where it is not defined."""
    if kind not in KINDS:
        return None
    if kind == "fill":
        if not pattern:
            return None
        return bytes(np.resize(np.roll(np.frombuffer(pattern, np.uint8), -(phase % len(pattern))), len(data)))
    if width not in (1, 2, 4, 8) or len(data) % width:
        return None
    words = np.frombuffer(data, f"{'>' if big_endian else '<'}u{width}")
    if kind == "swap_endian":
        return words.byteswap().tobytes()
    native, bits = words.astype(f"u{width}"), 8 * width
    by, turn = native.dtype.type(operand & ((1 << bits) - 1)), operand % bits
    with np.errstate(over="ignore"):
        if kind in ("rotate_left", "rotate_right"):
            turn = turn if kind == "rotate_left" else -turn % bits
            native = native << native.dtype.type(turn) | native >> native.dtype.type(bits - turn) if turn else native
        else:
            native = {"xor": lambda: native ^ by, "and": lambda: native & by, "or": lambda: native | by, "not": lambda: ~native, "add": lambda: native + by, "subtract": lambda: native - by}[kind]()
    return native.astype(words.dtype).tobytes()


def byte_transform(data: Column, kind: str, width: int = 1, operand: int = 0, big_endian: bool = False, pattern: bytes = b"", phase: int = 0) -> Column:
    @per_value("binary")
    def run(content: bytes):
        return transform_bytes(content, kind, width, operand, big_endian, pattern, phase)

    return run(data)


STANDARD = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def base64_encode(data: Column, alphabet: str = STANDARD, pad: bool = True) -> Column:
    """Base64 in any alphabet of 64 characters, without line breaks."""
    plain = F.regexp_replace(F.base64(data), "[\r\n]", "")
    plain = plain if pad else F.rtrim(plain, F.lit("="))
    return plain if alphabet == STANDARD else F.translate(plain, STANDARD, alphabet)


def base64_decode_strict(text: Column, alphabet: str = STANDARD) -> Column:
    """Unpadded base64; null for other characters, a single last character, or stray bits."""
    plain = text if alphabet == STANDARD else F.translate(text, alphabet, STANDARD)
    clean = text.rlike("^[" + re.escape(alphabet).replace("/", r"\/") + "]*$") & (F.length(text) % 4 != 1)
    bits = F.instr(F.lit(STANDARD), F.right(plain, F.lit(1))) - 1
    stray = F.when(F.length(text) % 4 == 2, bits % 16 != 0).when(F.length(text) % 4 == 3, bits % 4 != 0).otherwise(False)
    return F.when(clean & ~stray, F.unbase64(F.concat(plain, F.repeat(F.lit("="), ((4 - F.length(text) % 4) % 4).cast("int")))))


def encode64(data: bytes, alphabet: str = STANDARD, pad: bool = True) -> str:
    text = base64.b64encode(data).decode()
    return (text if pad else text.rstrip("=")).translate(str.maketrans(STANDARD, alphabet))


@per_value("struct<value:decimal(20,0),length:int>")
def uleb128(data: bytes, offset: int):
    """A little-endian base-128 number of up to 64 bits."""
    value = shift = 0
    for k, b in enumerate(data[offset : offset + 10]):
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return {"value": _decimal(value), "length": k + 1} if value < 1 << 64 else None
    return None


@per_value("struct<value:bigint,length:int>")
def sleb128(data: bytes, offset: int):
    value = shift = 0
    for k, b in enumerate(data[offset : offset + 10]):
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            value -= (1 << shift) if b & 64 else 0
            return {"value": value, "length": k + 1} if -(1 << 63) <= value < 1 << 63 else None
    return None


@per_value("struct<value:decimal(20,0),length:int>")
def base128_be(data: bytes, offset: int):
    """A big-endian base-128 number, as in MIDI and ASN.1."""
    value = 0
    for k, b in enumerate(data[offset : offset + 9]):
        value = value << 7 | b & 127
        if b < 128:
            return {"value": _decimal(value), "length": k + 1}
    return None


def _decimal(value: int):
    from decimal import Decimal

    return Decimal(value)


def zigzag(value: Column) -> Column:
    """The signed number behind a zigzag code."""
    v = value.cast("bigint")
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-v.bitwiseAND(F.lit(1).cast("bigint")))


def ones_complement(value: Column, bits: int) -> Column:
    return F.when(value >= 1 << (bits - 1), value - ((1 << bits) - 1)).otherwise(value)


def biased(value: Column, bias: int = 33) -> Column:
    return value - bias


def pdp_endian(value: Column) -> Column:
    """A 32-bit number whose 16-bit halves stand in the other order."""
    v = value.cast("bigint")
    return F.shiftleft(v.bitwiseAND(F.lit(0xFFFF).cast("bigint")), 16).bitwiseOR(F.shiftrightunsigned(v, 16).bitwiseAND(F.lit(0xFFFF).cast("bigint")))


@per_value("double")
def float_at(data: bytes, offset: int, form: str):
    """A float in one of struct's formats (``<f``, ``>d``, ``<e``); null outside."""
    size = struct.calcsize(form)
    return struct.unpack_from(form, data, offset)[0] if 0 <= offset and offset + size <= len(data) else None


def is_finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(math.inf)), F.lit(False))


def is_positive(value: Column) -> Column:
    return is_finite(value) & (value > 0)


def is_ordered(values: Column) -> Column:
    """Whether an array of numbers is finite and does not fall."""
    return F.forall(values, is_finite) & F.forall(F.zip_with(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: a <= b), lambda ok: ok)


def ascii_number(text: Column, base: int = 10) -> Column:
    """A blank- or zero-padded number in ASCII digits; null if it is none."""
    digits = F.regexp_replace(F.trim(F.replace(text, F.lit("\u0000"), F.lit(" "))), "^\\+", "")
    shape = {8: "^[0-7]{1,21}$", 10: "^-?[0-9]{1,18}$", 16: "^[0-9A-Fa-f]{1,15}$"}[base]
    return F.when(digits.rlike(shape), F.conv(digits, base, -10).cast("bigint"))


def octal_field(data: Column, offset: int, length: int) -> Column:
    """A tar or cpio number: octal digits ended by blank or zero."""
    return ascii_number(latin1(F.substring(data, offset + 1, length)), 8)


def fortran_real(text: Column) -> Column:
    """``1.5D+03`` and ``1.5Q3`` as doubles."""
    return F.regexp_replace(F.upper(F.trim(text)), "[DQ]", "E").try_cast("double")


def nastran_real(text: Column) -> Column:
    """``1.5+3`` and ``-2.-4``: an exponent without its letter."""
    t = F.upper(F.trim(text))
    return F.regexp_replace(F.regexp_replace(t, "D", "E"), "(?<=[0-9.])([+-][0-9]+)$", "E$1").try_cast("double")


def internet_checksum(data: Column) -> Column:
    """The ones' complement of the ones' complement sum of 16-bit words; odd content gets a zero byte."""
    raw = F.hex(data)
    even = F.concat(raw, F.when(F.length(raw) % 4 == 2, F.lit("00")).otherwise(F.lit("")))
    words = F.transform(F.regexp_extract_all(even, F.lit("(....)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("bigint"))
    total = F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, w: acc + w)
    fold = lambda v: v % 65536 + F.floor(v / 65536)
    return F.lit(65535) - fold(fold(fold(total)))
