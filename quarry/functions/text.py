"""Text functions: case, white space, width, encodings, names, documents in JSON, XML and TOML."""

from __future__ import annotations

import codecs
import json
import tomllib
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import per_value


def lossy(data: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def is_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


_WHITE = r"\p{IsWhite_Space}"


def trim_white(text: Column) -> Column:
    """Without the Unicode white space at both ends."""
    return F.regexp_replace(text, f"^{_WHITE}+|{_WHITE}+$", "")


def fold(text: Column) -> Column:
    """Trimmed and in lower case, by the full Unicode mappings."""
    return F.lower(trim_white(text))


def icontains(text: Column, needle: Column) -> Column:
    return F.contains(F.lower(text), F.lower(needle))


def istarts(text: Column, needle: Column) -> Column:
    return F.startswith(F.lower(text), F.lower(needle))


def iends(text: Column, needle: Column) -> Column:
    return F.endswith(F.lower(text), F.lower(needle))


def iequals(text: Column, other: Column) -> Column:
    return F.lower(text) == F.lower(other)


def has_lower(text: Column) -> Column:
    """Whether upper case would change the text."""
    return F.upper(text) != text


def is_alphabetic(text: Column) -> Column:
    return text.rlike(r"^\p{IsAlphabetic}+$")


def is_numeric(text: Column) -> Column:
    return text.rlike(r"^\p{N}+$")


def is_decimal(text: Column) -> Column:
    return text.rlike(r"^\p{Nd}+$")


@per_value("int")
def display_width(text: str):
    """Columns that a text takes on a terminal: none for marks and controls, two for wide characters."""
    width = 0
    for c in text:
        kind = unicodedata.category(c)
        if kind in ("Mn", "Me", "Cf", "Cc") and c != "\u00ad":
            continue
        width += 2 if unicodedata.east_asian_width(c) in "WF" else 1
    return width


def debug_escaped(code: int) -> bool:
    """Whether a character would be written as an escape: controls, marks, separators and what is unassigned."""
    if code < 0x80:
        return code < 0x20 or code == 0x7F
    return unicodedata.category(chr(code)) in ("Cc", "Cf", "Cn", "Co", "Cs", "Mn", "Me", "Zl", "Zp", "Zs")


@per_value("string")
def escape_debug(text: str):
    """The text with escapes for what can't be shown."""
    named = {"\t": "\\t", "\n": "\\n", "\r": "\\r", "\0": "\\0", '"': '\\"', "'": "\\'", "\\": "\\\\"}
    return "".join(named.get(c) or (f"\\u{{{ord(c):x}}}" if debug_escaped(ord(c)) else c) for c in text)


#: Code page numbers whose Python codec has another name than ``cp<number>``.
_CODECS = {
    0: "utf-8", 708: "iso8859-6", 874: "cp874", 932: "cp932", 936: "gbk", 949: "cp949", 950: "big5", 1200: "utf-16-le", 1201: "utf-16-be", 10000: "mac-roman", 10004: "mac-arabic", 10005: "mac-cyrillic",
    10006: "mac-greek", 10007: "mac-cyrillic", 10029: "mac-latin2", 10079: "mac-iceland", 10081: "mac-turkish", 20127: "ascii", 20866: "koi8-r", 20932: "euc-jp", 21866: "koi8-u", 50220: "iso2022_jp",
    51949: "euc-kr", 52936: "hz", 54936: "gb18030", 65000: "utf-7", 65001: "utf-8", 12000: "utf-32-le", 12001: "utf-32-be",
}


def codec(page: int) -> str | None:
    """The Python codec of a Windows, IBM, Mac or ISO code page number; None if there is none."""
    name = _CODECS.get(page) or (f"iso8859-{page - 28590}" if 28591 <= page <= 28606 else f"cp{page}")
    try:
        return codecs.lookup(name).name
    except LookupError:
        return None


@per_value("string")
def decode_page(data: bytes, page: int):
    """Bytes of a code page as text, U+FFFD for what it does not define; null for an unknown page."""
    name = codec(page)
    return name and data.decode(name, "replace")


@per_value("binary")
def encode_page(text: str, page: int):
    """Text in a code page; null if it has characters that the page lacks."""
    name = codec(page)
    try:
        return text.encode(name) if name else None
    except UnicodeEncodeError:
        return None


ROOTED, DRIVE = 1, 2
_MARK = "\ue000"  # stands for the percent sign of an escape until the end


@per_value("string")
def output_name(raw: bytes, page: int, flags: int):
    """An archive's member name as a safe relative path in UTF-8; null if it must be refused.

    UTF-8 is taken as it is, other bytes by the code page, and bytes that it
    lacks as ``%XX``.  A percent sign before two hex digits, and the marker that
    conflict names use, are escaped.  Control characters, ``..``, drives, absolute
    and network paths are refused; flags allow one leading slash or a drive.
    """
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        name = codec(page) if page else None
        text = "".join(_one_byte(b, name) for b in raw)
    if any(ord(c) < 0x20 or ord(c) == 0x7F for c in text):
        return None
    text = text.replace("\\", "/")
    if text.startswith("//"):
        return None
    if text[1:2] == ":" and text[0].isascii() and text[0].isalpha():
        if not flags & DRIVE or text[2:3] != "/":
            return None
        text = text[3:]
    elif text.startswith("/"):
        if not flags & ROOTED:
            return None
        text = text[1:]
    parts = [p for p in text.split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        return None
    return "/".join(map(_escaped, parts))


def _one_byte(b: int, name: str | None) -> str:
    try:
        return bytes([b]).decode(name or "ascii")
    except UnicodeDecodeError:
        return f"{_MARK}{b:02X}"  # kept apart from a percent sign of the name


def _escaped(part: str) -> str:
    out = []
    for k, c in enumerate(part):
        pair = part[k + 1 : k + 3]
        if c == "%" and len(pair) == 2 and all(h in "0123456789abcdefABCDEF" for h in pair):
            out.append("%25")
        elif c == "~" and part[k + 1 : k + 4] == "xx-":
            out.append("%7E")
        else:
            out.append("%" if c == _MARK else c)
    return "".join(out)


@per_value("string")
def toml_json(text: str):
    """A TOML document as JSON; null if it is not valid."""
    try:
        return json.dumps(tomllib.loads(text), default=str, sort_keys=True)
    except tomllib.TOMLDecodeError:
        return None


def json_value(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


def json_kind(text: Column) -> Column:
    """object, array, string, number, boolean or null; SQL null if it is no JSON."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")


def xml_escape(text: Column) -> Column:
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(c), F.lit(e))
    return text


def xml_text(text: Column, path: str) -> Column:
    return F.xpath_string(text, F.lit(path))


def manifest_value(text: Column, key: str) -> Column:
    """The value of a ``Key: value`` line; null if there is none."""
    found = F.regexp_extract(text, rf"(?m)^{key}: ?(.*?)\r?$", 1)
    return F.when(text.rlike(rf"(?m)^{key}:"), found)


def package_value(text: Column, key: str) -> Column:
    return F.get_json_object(text, f"$.{key}")


def js_index_of(text: Column, needle: Column) -> Column:
    """0-based position of ``needle``, -1 if absent."""
    return F.position(needle, text) - 1


def js_search(text: Column, pattern: str) -> Column:
    """0-based position of a regex's first match, -1 if none."""
    return F.regexp_instr(text, F.lit(f"({pattern})")) - 1


def js_match_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def js_replace(text: Column, needle: str, by: str) -> Column:
    """The first occurrence replaced, as a string."""
    p = F.instr(text, needle)
    return F.when(p > 0, F.concat(F.substring(text, F.lit(1), p - 1), F.lit(by), F.substring(text, p + len(needle), F.length(text)))).otherwise(text)


def translate_message(text: Column, catalogue: dict[str, str]) -> Column:
    """gettext: the translation of a message, or the message."""
    pairs = [F.lit(x) for kv in sorted(catalogue.items()) for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), text) if pairs else text
