"""Addresses, domains and links."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import per_value

TYPO, HOMOGLYPH, HYPHENATION, SUBDOMAIN, BITSQUATTING = 1, 2, 4, 8, 16
ALL_KINDS = 31

#: Neighbours on a QWERTY keyboard: rows of keys, each shifted half a key.
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
#: Letters that look alike in Latin, Cyrillic and Greek.
_ALIKE = {"a": "аα", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "і1l", "j": "ј", "l": "1iі", "o": "о0ο", "p": "р", "q": "ԛ", "s": "ѕ", "u": "υ", "v": "ν", "w": "ԝ", "x": "х", "y": "у", "0": "o", "1": "l"}
#: Public suffixes of two labels that the short rule needs; pass a longer list where it matters.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.za")
_HOSTS = ("www", "ftp", "m", "mail", "webmail", "ns1", "ns2")


def _neighbours() -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for r, row in enumerate(_ROWS):
        for k, c in enumerate(row):
            near = {row[j] for j in (k - 1, k + 1) if 0 <= j < len(row)}
            for other, shift in ((r - 1, (0, 1)), (r + 1, (-1, 0))):
                if 0 <= other < len(_ROWS):
                    near |= {_ROWS[other][k + s] for s in shift if 0 <= k + s < len(_ROWS[other])}
            out[c] = near
    return out


_NEAR = _neighbours()


@per_value("boolean")
def ip_in_range(ip: str, cidr: str):
    """Whether an address lies in a network; false if either can't be read.  Octets have no leading zeros."""
    try:
        address, network = ipaddress.ip_address(ip), ipaddress.ip_network(cidr, strict=False)
    except ValueError:
        return False
    return "/" in cidr and address.version == network.version and address in network


def ipv4_number(text: Column) -> Column:
    """A dotted address as a number; null if it is none."""
    octets = F.transform(F.split(text, r"\."), lambda x: x.try_cast("int"))
    good = text.rlike(r"^(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})$") & F.forall(octets, lambda x: x <= 255)
    return F.when(good, F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x))


def ipv4_in(text: Column, cidr: str) -> Column:
    """The same for IPv4 as arithmetic in the JVM."""
    network = ipaddress.ip_network(cidr, strict=False)
    span = network.num_addresses
    return F.coalesce(ipv4_number(text).between(int(network.network_address), int(network.network_address) + span - 1), F.lit(False))


def is_netmask(value: Column) -> Column:
    """Whether a 32-bit number is ones followed by zeros."""
    flipped = F.lit(0xFFFFFFFF).cast("bigint").bitwiseXOR(value.cast("bigint"))
    return flipped.bitwiseAND(flipped + 1) == 0


def split_domain(name: str, suffixes: frozenset[str] = frozenset(SUFFIXES)) -> dict[str, str | None] | None:
    """prefix, subdomain, domain and tld of a host name; None without a registrable part."""
    labels = name.rstrip(".").split(".")
    if len(labels) < 2 or not all(labels):
        return None
    n = 2 if len(labels) > 2 and ".".join(labels[-2:]).lower() in suffixes else 1
    tld, domain, rest = ".".join(labels[-n:]), labels[-n - 1], labels[: -n - 1]
    host = rest.pop(0) if len(rest) > 0 and rest[0].lower() in _HOSTS and len(rest) == 1 else None
    return {"prefix": ".".join(rest[:-1]) or None if len(rest) > 1 else None, "subdomain": rest[-1] if rest else host, "domain": domain, "tld": tld}


@per_value("struct<prefix:string,subdomain:string,domain:string,tld:string>")
def domain_parts(name: str):
    return split_domain(name)


def _typos(word: str) -> set[str]:
    out = set()
    for k, c in enumerate(word):
        out.add(word[:k] + word[k + 1 :])
        out.add(word[:k] + c + word[k:])
        if k + 1 < len(word):
            out.add(word[:k] + word[k + 1] + c + word[k + 2 :])
        for n in _NEAR.get(c, ()):
            out |= {word[:k] + n + word[k + 1 :], word[:k] + n + word[k:], word[: k + 1] + n + word[k + 1 :]}
        if c in "aeiou":
            out |= {word[:k] + v + word[k + 1 :] for v in "aeiou"}
    return out - {word}


def permutation_kind(domain: str, target: str, kinds: int = ALL_KINDS) -> int:
    """The kinds of lookalike of ``target`` that ``domain`` is, as bits; 0 for none."""
    a, b = split_domain(domain), split_domain(target)
    if not a or not b or domain == target:
        return 0
    have, want, found = a["domain"], b["domain"], 0
    if have in _typos(want):
        found |= TYPO
    if len(have) == len(want) and have != want and all(x == y or x in _ALIKE.get(y, "") for x, y in zip(have, want, strict=True)) or have != want and have.replace("rn", "m").replace("vv", "w") == want:
        found |= HOMOGLYPH
    if have.replace("-", "", 1) == want and "-" in have.strip("-"):
        found |= HYPHENATION
    if ".".join(x for x in (a["prefix"], a["subdomain"], have) if x).replace(".", "") == want and a["subdomain"]:
        found |= SUBDOMAIN
    if len(have) == len(want) and sum(x != y for x, y in zip(have, want, strict=True)) == 1 and any(x != y and bin(ord(x) ^ ord(y)).count("1") == 1 and re.fullmatch("[a-z0-9-]", x) for x, y in zip(have, want, strict=True)):
        found |= BITSQUATTING
    return found & kinds


def is_permutation(domain: Column, target: str, kinds: int = ALL_KINDS) -> Column:
    """Whether a domain looks like ``target``; far names never reach Python."""

    @per_value("boolean")
    def run(name: str):
        return permutation_kind(name, target, kinds) != 0

    # A lookalike has a label about as long as the target's, or is so short that its labels together may be.
    n = len((split_domain(target) or {"domain": target})["domain"])
    near = F.exists(F.split(domain, r"\."), lambda label: F.length(label).between(n - 1, 2 * n)) | (F.length(domain) <= 2 * n + 24)
    return F.coalesce(run(F.when(near, domain)), F.when(domain.isNotNull(), False))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def links(html: Column) -> Column:
    """The targets of ``href`` attributes, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))


def strip_tags(html: Column) -> Column:
    """The text of a page: no scripts, styles, comments and tags, and single blanks."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))
