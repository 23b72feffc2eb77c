"""Format-preserving pseudonyms for personal numbers, dates and addresses, in DataFrame operations only.

Every value that passes its validation is replaced by another valid value of
the same format, chosen by a keyed Feistel permutation of the format's values.
Within a format no two values get the same pseudonym, and a value gets the same
one in every document, so records stay linked.

========  ============================================  =====================================
kind      accepted                                      permuted
========  ============================================  =====================================
email     local part, @, host with a dot                letters and digits of the local part,
                                                        each within its alphabet (``ALPHABETS``)
iban      ISO 13616: country's length, check digits     the account number; new check digits
date      2001-02-03 (also before a time), 2001/02/03,  the day, among the 72,900 days of its
          03.02.2001, 02/03/2001 (month first if it     era; 1900-01-01 begins one, and years
          can be), years 0001 to 9999                   1 to 9999 are covered
ipv4      four numbers up to 255                        the 32 bits
ssn       123-45-6789 with valid parts                  area and group, and serial
phone     10 digits with separators, or + and a         of ten digits all; else the digits after
          country code in use; not all digits equal     country code and first digit
card      13 to 19 digits, plain or in groups, Luhn     all but the last, a new check digit
========  ============================================  =====================================

Ten-digit numbers, and those of +1, are permuted among numbers whose area and
exchange are as valid as theirs (2 to 9 first, not 11 last), so valid ones stay
valid.  Slashed dates that can only be read day first (day above 12) are
permuted among their like: days 13 to 28 by year and day, 29 to 31 by year and
day, and 29 February among leap years; two written dates never meet.

What looks alike but fails validation (a number with a wrong check digit, a
version number) stays as it is.  Emails differ in case only link as well; one
whose local part has no letter or digit of ``ALPHABETS`` stays.

The strings of a value are cut in two halves, and in each round one half's
characters are shifted, each within its class, by a stream hashed from key,
kind, round and the other half.  Pairs of numbers do the same with modular
addition.

Each text is handled in its own row: one scan, no shuffle, no Python.

Defined cases: a null text stays null, an empty one empty; very long texts are
read whole; repeated rows get equal results; an empty table stays empty; extra
columns are kept.  The key is a literal of the plan, so plans and event logs
must be guarded as the key is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, quoted

ROUNDS = 10
DAYS_SIDE = 270  # 270 x 270 days in an era; one begins at 1900-01-01
DAYS_BEFORE, DAYS_AFTER = 693_595, 2_958_464  # days of the years 1 to 1899, and 1900 to 9999
#: Letters that stay among their like: the first code point of each alphabet, and how many it has.
ALPHABETS = (
    (0x30, 10), (0x41, 26), (0x61, 26), (0xC0, 23), (0xD8, 7), (0xE0, 23), (0xF8, 7), (0x391, 17), (0x3A3, 7), (0x3B1, 17), (0x3C3, 7), (0x410, 32), (0x430, 32), (0x531, 38), (0x561, 38),
    (0x5D0, 27), (0x621, 26), (0x641, 10), (0x905, 53), (0xE01, 46), (0x10D0, 33), (0x3041, 86), (0x30A1, 90), (0x4E00, 20902), (0xAC00, 11172),
)
_LETTERS = "".join(f"\\x{{{a:x}}}-\\x{{{a + n - 1:x}}}" for a, n in ALPHABETS)
#: Lengths of account numbers by country, from the public IBAN registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Country codes in use: two of one digit, those of two digits, and all others of three.
COUNTRY_CODE = r"^(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|35|37|38|42|50|59|67|68|69|85|88|96|97|99)[0-9])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?!(?!T[0-9])[0-9A-Za-z]|[./-][0-9])"
IPV4 = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])|(?<![0-9A-Za-z+])\+[0-9]{11,13}(?![0-9A-Za-z])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
_GROUPED = CARD.replace(r"([ -])", "[ -]").replace(r"\1", "[ -]")
ANY = "|".join([EMAIL, IBAN, DATE, IPV4, SSN, PHONE, _GROUPED])


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once: a lambda variable stands for it."""
    return F.transform(F.array(value), then)[0]


def _number(hexes: Column, at, width: int = 4) -> Column:
    return F.conv(F.substring(hexes, at, F.lit(width)), 16, 10).cast("long")


def _stream(key: Column, kind: str, turn: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(kind), turn.cast("string"), F.lower(other)), 512)


def _character(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _shift(half: Column, stream: Column, ascii_only: bool) -> Column:
    """Each character moved within its alphabet; ``stream`` gives 32 steps, then again."""
    ranges = F.expr("array(" + ", ".join(f"named_struct('low', {a}L, 'size', {n}L)" for a, n in ALPHABETS[3:]) + ")")

    def move(c: Column, i: Column) -> Column:
        step, code = _number(stream, (i % 32) * 4 + 1), F.ascii(c).cast("long")

        def within(low: str, size: int) -> Column:
            return F.char((code - ord(low) + step) % size + ord(low))

        plain = F.when(c.rlike("^[0-9]$"), within("0", 10)).when(c.rlike("^[a-z]$"), within("a", 26)).when(c.rlike("^[A-Z]$"), within("A", 26))
        if ascii_only:
            return plain.otherwise(c)
        wide = F.transform(F.filter(ranges, lambda r: (code >= r["low"]) & (code < r["low"] + r["size"])), lambda r: _character((code - r["low"] + step) % r["size"] + r["low"]))
        return plain.when(code < 128, c).otherwise(F.coalesce(F.get(wide, F.lit(0)), c))

    return F.array_join(F.transform(F.split(half, ""), move), "")


def permute_text(value: Column, kind: str, key: Column, ascii_only: bool = True) -> Column:
    """A permutation of the strings with the same classes of characters; ``ascii_only`` leaves all others alone."""
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("a"), F.substring(value, cut + 1, F.length(value)).alias("b"))

    def turn(acc: Column, r: Column) -> Column:
        even = r % 2 == 0

        def moved(half: Column, other: Column) -> Column:
            return _shift(half, _stream(key, kind, r, other), ascii_only)

        return F.struct(F.when(even, moved(acc["a"], acc["b"])).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(moved(acc["b"], acc["a"])).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: F.concat(acc["a"], acc["b"]))


def permute_pair(a: Column, b: Column, size_a: int | Column, size_b: int | Column, kind: str, key: Column) -> Column:
    """A permutation of pairs of numbers below ``size_a`` and ``size_b``; a struct (a, b)."""

    def step(r: Column, other: Column, size: int | Column) -> Column:
        return _number(_stream(key, kind, r, other.cast("string")), F.lit(1), 12) % size

    def turn(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(F.when(even, (acc["a"] + step(r, acc["b"], size_a)) % size_a).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise((acc["b"] + step(r, acc["a"], size_b)) % size_b).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(layout: Column, digits: Column) -> Column:
    """``layout`` with its digits replaced, in order."""

    def fill(c: Column, i: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), F.substring(digits, F.length(_digits(F.substring(layout, F.lit(1), i + 1))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(layout, ""), fill), "")


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum; counted from the right, digits at odd (1) or even (0) places count double."""

    def part(c: Column, i: Column) -> Column:
        d = F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))
        return F.when(i % 2 == doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda acc, x: acc + x)


def _iban_rest(text: Column) -> Column:
    """The remainder by 97 of an IBAN whose first four characters were moved to its end."""

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(c == "", acc).when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _email(m: Column, key: Column) -> Column:
    moved = _once(F.substring_index(m, "@", 1), lambda local: F.when(local.rlike(f"[{_LETTERS}]"), permute_text(local, "email", key, False)))
    return F.concat(moved, F.lit("@"), F.substring_index(m, "@", -1))


def _iban(m: Column, key: Column) -> Column:
    def solve(s: Column) -> Column:
        country, account = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))
        length = F.expr("map(" + ", ".join(f"'{c}', {n}" for c, n in IBAN_LENGTHS.items()) + ")")[country]
        good = F.coalesce(F.length(s) == length, F.lit(False)) & (_iban_rest(F.concat(account, F.substring(s, 1, 4))) == 1)

        def build(new: Column) -> Column:
            check = F.lit(98) - _iban_rest(F.concat(new, country, F.lit("00")))
            plain = F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)
            # Blanks go back to where they were.
            return F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c == " ", c).when(c == "", c).otherwise(F.substring(plain, F.length(F.replace(F.substring(m, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")

        return F.when(good, _once(permute_text(account, "iban", key), build))

    return _once(F.replace(m, F.lit(" "), F.lit("")), solve)


def _permute_day(day: Column, key: Column) -> Column:
    """Another day (from 1900-01-01 on) of the same era; the first and the last era are shorter."""
    whole = DAYS_SIDE * DAYS_SIDE
    early, late = DAYS_BEFORE % whole, DAYS_AFTER // whole * whole
    size_a = F.when(day < early - DAYS_BEFORE, 5).when(day >= late, 32).otherwise(DAYS_SIDE)
    size_b = F.when(day < early - DAYS_BEFORE, early // 5).when(day >= late, (DAYS_AFTER - late) // 32).otherwise(DAYS_SIDE)
    first = F.when(day < early - DAYS_BEFORE, F.lit(-DAYS_BEFORE)).otherwise(F.floor(day / whole) * whole)

    def build(x: Column) -> Column:
        pair = permute_pair(F.floor((day - x["first"]) / x["b"]), (day - x["first"]) % x["b"], x["a"], x["b"], "date", key)
        return _once(pair, lambda p: (x["first"] + p["a"] * x["b"] + p["b"]).cast("int"))

    return _once(F.struct(first.alias("first"), size_a.cast("long").alias("a"), size_b.cast("long").alias("b")), build)


def _day_first(m: Column, key: Column) -> Column:
    """A slashed date whose day is above 12, among its like."""

    def build(x: Column) -> Column:
        d, mo, y = x["d"], x["m"], x["y"]
        low, years = F.when(y < 1900, 1).when(y < 2100, 1900).otherwise(2100), F.when(y < 1900, 1899).when(y < 2100, 200).otherwise(7900)
        leap_day = (d == 29) & (mo == 2)
        # Days 29 to 31 in order: eleven 29ths, eleven 30ths, seven 31sts.
        months = F.expr("array(1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 1, 3, 5, 7, 8, 10, 12)")
        base = F.when(d == 29, 0).when(d == 30, 11).otherwise(22)
        late = base + F.array_position(F.slice(months, base + 1, 11), mo) - 1
        early = permute_pair(y - low, (mo - 1) * 16 + d - 13, years, 192, "day", key)
        ends = permute_pair(y - low, late, years, 29, "end", key)
        place = F.when(y % 400 == 0, F.floor(y / 400) - 1).otherwise(F.floor(y % 100 / 4) - 1)
        leap = permute_pair(F.floor(place / 6), place % 6, 4, 6, "leap", key)

        def show(day: Column, month: Column, year: Column) -> Column:
            return F.format_string("%02d/%02d/%04d", day.cast("int"), month.cast("int"), year.cast("int"))

        leap_year = _once(leap, lambda p: F.when(y % 400 == 0, (p["a"] * 6 + p["b"] + 1) * 400).otherwise(F.floor(y / 100) * 100 + (p["a"] * 6 + p["b"] + 1) * 4))
        return (
            F.when(leap_day, show(d, mo, leap_year))
            .when(d > 28, _once(ends, lambda p: show(F.when(p["b"] < 11, 29).when(p["b"] < 22, 30).otherwise(31), F.element_at(months, (p["b"] + 1).cast("int")), low + p["a"])))
            .otherwise(_once(early, lambda p: show(p["b"] % 16 + 13, F.floor(p["b"] / 16) + 1, low + p["a"])))
        )

    parts = F.struct(F.substring(m, 1, 2).cast("int").alias("d"), F.substring(m, 4, 2).cast("int").alias("m"), F.substring(m, 7, 4).cast("int").alias("y"))
    valid = F.try_to_timestamp(m, F.lit("dd/MM/yyyy")).isNotNull() & (F.substring(m, 1, 2).cast("int") > 12) & (F.substring(m, 7, 4) > "0000")
    return F.when(valid, _once(parts, build))


def _date(m: Column, key: Column) -> Column:
    origin = F.lit("1900-01-01").cast("date")
    form = F.when(m.rlike("^....-"), "yyyy-MM-dd").when(m.rlike("^..../"), "yyyy/MM/dd").when(m.rlike(r"^..\."), "dd.MM.yyyy").otherwise("MM/dd/yyyy")
    day = F.datediff(F.try_to_timestamp(m, form).cast("date"), origin).cast("long")

    def build(x: Column) -> Column:
        moved = F.call_function("date_format", F.date_add(origin, _permute_day(x["day"], key)), x["form"])
        return F.when(x["day"].between(-DAYS_BEFORE, DAYS_AFTER - 1), moved).when(x["day"].isNull() & (x["form"] == "MM/dd/yyyy"), _day_first(m, key))

    return _once(F.struct(day.alias("day"), form.alias("form")), build)


def _ipv4(m: Column, key: Column) -> Column:
    def solve(o: Column) -> Column:
        good = F.forall(o, lambda x: x <= 255)
        pair = permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ipv4", key)
        return F.when(good, _once(pair, lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)])))

    return _once(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), solve)


def _ssn(m: Column, key: Column) -> Column:
    def solve(o: Column) -> Column:
        area, group, serial = o[0], o[1], o[2]
        good = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        place = F.when(area > 666, area - 2).otherwise(area - 1)
        pair = permute_pair(place * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn", key)

        def build(p: Column) -> Column:
            new = F.floor(p["a"] / 99).cast("int")
            return F.format_string("%03d-%02d-%04d", F.when(new >= 665, new + 2).otherwise(new + 1), (p["a"] % 99 + 1).cast("int"), (p["b"] + 1).cast("int"))

        return F.when(good, _once(pair, build))

    return _once(F.transform(F.split(m, "-"), lambda x: x.cast("int")), solve)


def _ten_digits(d: Column, key: Column) -> Column:
    """Another number of ten digits whose area and exchange are as valid as those of ``d``."""

    def valid(x: Column) -> Column:
        return (x >= 200) & (x % 100 != 11)

    def place(x: Column) -> Column:
        # Among the 792 valid ones (two of each hundred's last digits come before 11), or the 208 others.
        within = x % 100 - F.when(x % 100 > 11, 1).otherwise(0)
        return F.when(valid(x), (F.floor(x / 100) - 2) * 99 + within).when(x < 200, x).otherwise(198 + F.floor(x / 100))

    def back(k: Column, good: Column) -> Column:
        within = k % 99 + F.when(k % 99 >= 11, 1).otherwise(0)
        return F.when(good, (F.floor(k / 99) + 2) * 100 + within).when(k < 200, k).otherwise((k - 198) * 100 + 11)

    def build(x: Column) -> Column:
        area, exchange, line = x["a"], x["e"], x["l"]
        good_a, good_e = valid(area), valid(exchange)
        sizes = [F.when(g, 792 * 100).otherwise(208 * 100) for g in (good_a, good_e)]
        pair = permute_pair(place(area) * 100 + F.floor(line / 100), place(exchange) * 100 + line % 100, *sizes, "phone", key)
        return _once(pair, lambda p: F.format_string("%03d%03d%04d", back(F.floor(p["a"] / 100), good_a).cast("int"), back(F.floor(p["b"] / 100), good_e).cast("int"), (p["a"] % 100 * 100 + p["b"] % 100).cast("int")))

    return _once(F.struct(F.substring(d, 1, 3).cast("long").alias("a"), F.substring(d, 4, 3).cast("long").alias("e"), F.substring(d, 7, 4).cast("long").alias("l")), build)


def _phone(m: Column, key: Column) -> Column:
    def build(d: Column) -> Column:
        local, size = ~m.startswith("+"), F.length(d)
        here = F.concat(F.left(d, size - 10), _ten_digits(F.right(d, F.lit(10)), key))
        code = F.regexp_extract(d, COUNTRY_CODE, 1)
        kept = F.length(code) + 1
        abroad = F.concat(F.left(d, kept), permute_text(F.substring(d, kept + 1, size), "phone", key))
        own = F.right(d, F.lit(10))
        useful = F.regexp_replace(own, F.substring(own, 1, 1), F.lit("")) != ""
        new = F.when((local & (size == 10)) | (d.startswith("1") & (size == 11)), here).when(~local & (code != "") & (code != "1") & (size - kept >= 6), abroad)
        return _once(F.when(useful, new), lambda x: F.when(x.isNotNull(), _refill(m, x)))

    return _once(_digits(m), build)


def _card(m: Column, key: Column) -> Column:
    def solve(d: Column) -> Column:
        def build(new: Column) -> Column:
            return _refill(m, F.concat(new, ((10 - _luhn(new, 0) % 10) % 10).cast("string")))

        return F.when(_luhn(d, 1) % 10 == 0, _once(permute_text(F.left(d, F.length(d) - 1), "card", key), build))

    return _once(_digits(m), solve)


KINDS = (("email", EMAIL, _email), ("iban", IBAN, _iban), ("date", DATE, _date), ("ipv4", IPV4, _ipv4), ("ssn", SSN, _ssn), ("phone", PHONE, _phone), ("card", CARD, _card))


def pseudonym(m: Column, key: Column) -> Column:
    """``STRUCT<kind, value>`` of a match; null kind if it fails validation."""
    out = F.lit(None)
    for kind, pattern, make in reversed(KINDS):
        hit = m.rlike(rf"\A(?:{pattern})\z")
        out = F.when(hit, F.struct(F.lit(kind).alias("kind"), make(m, key).alias("value"))).otherwise(out)
    return _once(out, lambda p: F.struct(F.when(p["value"].isNotNull(), p["kind"]).alias("kind"), F.coalesce(p["value"], m).alias("value")))


def pseudonymize(docs: DataFrame, name: str = "pii", text_col: str = "text", *, key: str) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced, and an array column of the kinds replaced, in order.

    It is called ``name``, with underscores before it if a column has that name.  Whoever has ``key`` can undo the
    pseudonyms, so there is none by default.
    """
    text, name_ = F.col(text_col), free_name(docs, name)
    found = docs.withColumn(name_, F.when(text.rlike("[0-9@]"), F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: pseudonym(m, F.lit(key)))).otherwise(F.array().cast("array<struct<kind:string,value:string>>")))
    between = F.split(text, ANY, -1)
    whole = F.when(F.size(name_) > 0, F.array_join(F.zip_with(between, F.col(name_), lambda a, p: F.concat(a, F.coalesce(p["value"], F.lit("")))), "")).otherwise(text)
    kinds = F.transform(F.filter(name_, lambda p: p["kind"].isNotNull()), lambda p: p["kind"])
    return found.select(*[whole.alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns], kinds.alias(name_))
