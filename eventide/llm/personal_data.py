"""Personal data in texts: regular expressions propose, validators confirm, nearby words adjust the score.

Every rule has a pattern over the UTF-8 bytes of a whole text, a validator and words that make the find likelier when they
stand near it. The four base rules (email, ip, card, phone) keep every find that their check confirms. The other rules carry
a checksum (mod 97, mod 11, mod 23, double SHA-256, ...) or a format check; what does not reach THRESHOLD with its context is
dropped, and so is what overlaps a base find or a likelier one. Most texts have few digits or none, so a rule reads a text only if the text
holds a piece that all its finds hold, such as 000-00-0000 with any digits. Patterns use possessive repeats or start where no earlier
start can succeed, so the time is linear in the text. One narrow pass; memory is one document and its finds.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm import text_kernel as tk

#: A find that no base rule made needs this score.
THRESHOLD = 0.5
#: Bytes before and after a find in which context words count.
BEFORE, AFTER = 64, 32
_CONTEXT_GAIN = 0.35

# The kinds in the order of the digest, the letters of the Spanish id, IBAN lengths by country, base-58 digits.
BASE_KINDS = ("email", "ip", "card", "phone")
DNI_LETTERS = b"TRWAGMYFPDXBNJZSQVHLCKE"
IBAN_LENGTHS = {
    b"AT": 20, b"BE": 16, b"CH": 21, b"CY": 28, b"CZ": 24, b"DE": 22, b"DK": 18, b"EE": 20, b"ES": 24, b"FI": 18, b"FR": 27, b"GB": 22,
    b"GR": 27, b"HR": 21, b"HU": 28, b"IE": 22, b"IT": 27, b"LT": 20, b"LU": 20, b"LV": 21, b"MC": 27, b"MT": 31, b"NL": 18, b"NO": 15,
    b"PL": 28, b"PT": 25, b"RO": 24, b"SE": 24, b"SI": 19, b"SK": 24, b"TR": 26,
}
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

SPAN = pa.struct([
    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("score", pa.float64()), ("base", pa.bool_()),
])
_NOT_DIGIT = bytes(set(range(256)) - set(b"0123456789"))
_DIGITS_AS_0 = bytes.maketrans(b"123456789", b"000000000")
_LOCAL = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._%+-"


def digits_of(found: bytes) -> bytes:
    return found.translate(None, _NOT_DIGIT)


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def card_number(found: bytes) -> bool:
    digits = digits_of(found)
    return 14 <= len(digits) <= 19 and luhn(digits)


def phone_number(found: bytes) -> bool:
    return 10 <= len(digits_of(found)) <= 15


def ip_address(found: bytes) -> bool:
    # a part of very many digits is too large unless its leading digits are zeros
    return all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in found.split(b"."))


def iban(found: bytes) -> bool:
    code = found.replace(b" ", b"")
    return len(code) == IBAN_LENGTHS.get(code[:2]) and int("".join(str(int(chr(c), 36)) for c in code[4:] + code[:4])) % 97 == 1


def social_security(found: bytes) -> bool:
    area, group, serial = found.split(b"-")
    return area not in (b"000", b"666") and area < b"900" and group != b"00" and serial != b"0000"


def routing_number(found: bytes) -> bool:
    d = [c - 48 for c in found]
    return any(d) and (3 * (d[0] + d[3] + d[6]) + 7 * (d[1] + d[4] + d[7]) + d[2] + d[5] + d[8]) % 10 == 0


def nhs_number(found: bytes) -> bool:
    d = [c - 48 for c in digits_of(found)]
    return (11 - sum((10 - i) * d[i] for i in range(9)) % 11) % 11 == d[9] and any(d)


def spanish_id(found: bytes) -> bool:
    number = found[:-1].replace(b"-", b"").translate(bytes.maketrans(b"XYZ", b"012"))
    return DNI_LETTERS[int(number) % 23] == found[-1]


def french_id(found: bytes) -> bool:
    d = digits_of(found)
    return len(d) == 15 and 97 - int(d[:13]) % 97 == int(d[13:])


def german_tax_id(found: bytes) -> bool:
    """ISO 7064, mod 11,10."""
    product = 10
    for c in found[:10]:
        product = ((c - 48 + product) % 10 or 10) * 2 % 11
    return (11 - product) % 10 == found[10] - 48


def ipv6(found: bytes) -> bool:
    try:
        return found.count(b":") >= 3 and ipaddress.IPv6Address(found.decode()).is_global
    except ValueError:
        return False


def bitcoin_address(found: bytes) -> bool:
    number = 0
    for c in found:
        number = number * 58 + BASE58.index(c)
    if number >> 200:
        return False
    raw = number.to_bytes(25, "big")
    return hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


def calendar_date(found: bytes) -> bool:
    parts = [int(p) for p in re.split(rb"[./-]", found)]
    year, month, day = parts if parts[0] > 31 else parts[::-1]
    try:
        return date(year, month, day).year >= 1900
    except ValueError:
        return False


def random_looking(found: bytes) -> bool:
    """Letters and digits mixed, at least 3 bits a character."""
    counts = Counter(found)
    entropy = -sum(n / len(found) * math.log2(n / len(found)) for n in counts.values())
    return entropy >= 3 and any(48 <= c < 58 for c in counts) and any(c > 64 for c in counts)


@dataclass(frozen=True)
class Rule:
    """A kind of find. `pieces`: every find holds one of them, 0 standing for any digit. `needs_context`: without a context word nearby the
    score stays below the threshold. Texts without a piece, or without any word that is needed, are skipped."""

    kind: str
    pattern: re.Pattern[bytes]
    check: Callable[[bytes], bool]
    score: float
    words: tuple[bytes, ...]
    pieces: tuple[bytes, ...]

    @property
    def needs_context(self) -> bool:
        return self.score < THRESHOLD


def _rule(kind: str, pattern: bytes, check: Callable[[bytes], bool], score: float, words: str, pieces: str) -> Rule:
    return Rule(kind, re.compile(pattern), check, score, *(tuple(w.encode() for w in x.split()) for x in (words, pieces)))


#: The part of an address from the @ on; what stands before is found backwards, so that a long run of letters is read once.
_FROM_AT = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
BASE_RULES = (
    _rule("email", _FROM_AT.pattern, lambda found: True, 0.65, "mail contact write reply kontakt correo courriel", "@"),
    _rule("ip", rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ip_address, 0.6, "ip host server address login adresse direcci", "0.0"),
    _rule("card", rb"[0-9](?:[ -]?[0-9])++", card_number, 0.65, "card visa credit payment karte carte tarjeta", "0"),
    _rule("phone", rb"\+[0-9][ ().0-9-]+[0-9]", phone_number, 0.6, "phone call tel mobile fax telefon handy", "+0"),
)
MORE_RULES = (
    _rule("iban", rb"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", iban, 0.65, "iban account bank konto compte cuenta", "00"),
    _rule("french_id", rb"\b[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}\b", french_id, 0.55, "insee secu nir", "000"),
    _rule("ipv6", rb"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]{4,34}(?![0-9A-Za-z:.])", ipv6, 0.55, "ip host server address", ":"),
    _rule("mac", rb"\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b", lambda found: True, 0.5, "mac device adapter hardware", ": -"),
    _rule("bitcoin", rb"\b[13][1-9A-HJ-NP-Za-km-z]{25,34}\b", bitcoin_address, 0.65, "bitcoin btc wallet", "0"),
    _rule("us_ssn", rb"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", social_security, 0.5, "ssn social security", "000-00-0000"),
    _rule("spanish_id", rb"\b(?:[0-9]{8}|[XYZ]-?[0-9]{7})-?[A-Z]\b", spanish_id, 0.5, "dni nie nif identidad", "0000000"),
    _rule("us_routing", rb"\b[0-9]{9}\b", routing_number, 0.3, "routing aba", "000000000"),
    _rule("nhs", rb"\b[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4}\b", nhs_number, 0.3, "nhs", "000"),
    _rule("german_tax_id", rb"\b[1-9][0-9]{10}\b", german_tax_id, 0.3, "steuer idnr tax", "00000000000"),
    _rule("birth_date", rb"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})\b", calendar_date, 0.3, "born birth dob geboren naci", "0000"),
    _rule("secret", rb"\b[0-9A-Za-z_-]{20,}+", random_looking, 0.3, "token secret password passwort passwd apikey api_key bearer", "0"),
)
_RANK = {rule.kind: i for i, rule in enumerate((*BASE_RULES, *MORE_RULES))}


def _emails(raw: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: each takes all local characters before its @ that no earlier address took."""
    free = 0
    for m in _FROM_AT.finditer(raw):
        before = raw[free : m.start()]
        start = free + len(before.rstrip(_LOCAL))
        if start < m.start():
            yield start, m.end()
            free = m.end()
        else:
            free = m.start() + 1


def _trimmed(kind: str, found: bytes) -> bytes:
    """An IBAN's pattern may run into the next word; the country says how long it is."""
    if kind != "iban":
        return found
    left = IBAN_LENGTHS.get(found[:2], 0)
    for i, c in enumerate(found):
        left -= c != 0x20
        if left == 0:
            return found[: i + 1]
    return b""


def finds(raw: bytes) -> list[tuple[str, int, int, float, bool]]:
    """(kind, first byte, end byte, score, base rule) of one text, by start, then kind."""
    outline = raw.translate(_DIGITS_AS_0)
    base_rules, more_rules = ([r for r in rules if any(p in outline for p in r.pieces)] for rules in (BASE_RULES, MORE_RULES))
    if not base_rules and not more_rules:
        return []
    low = raw.lower()

    def score(rule: Rule, start: int, end: int) -> float:
        around = low[max(0, start - BEFORE) : start] + b"\n" + low[end : end + AFTER]
        return rule.score + _CONTEXT_GAIN * any(w in around for w in rule.words)

    out = []
    for rule in base_rules:
        spans = _emails(raw) if rule.kind == "email" else (m.span() for m in rule.pattern.finditer(raw))
        out += [(rule.kind, s, e, score(rule, s, e), True) for s, e in spans if rule.check(raw[s:e])]
    more = []
    for rule in more_rules:
        if rule.needs_context and not any(w in low for w in rule.words):
            continue
        for m in rule.pattern.finditer(raw):
            found = _trimmed(rule.kind, m[0])
            if found and rule.check(found):
                s, e = m.start(), m.start() + len(found)
                if (likely := score(rule, s, e)) >= THRESHOLD:
                    more.append((rule.kind, s, e, likely, False))
    return sorted(out + _apart(out, more), key=lambda f: (f[1], _RANK[f[0]]))


def _apart(base: list[tuple], more: list[tuple]) -> list[tuple]:
    """The finds of `more` that overlap neither a base find nor a kept one with a higher score (then: longer, earlier, first rule)."""
    if not more:
        return []
    edges = sorted({x for _, s, e, *_ in base + more for x in (s, e)})
    place = {x: i for i, x in enumerate(edges)}
    taken = np.zeros(len(edges), bool)
    for _, s, e, *_ in base:
        taken[place[s] : place[e]] = True
    kept = []
    for find in sorted(more, key=lambda f: (-f[3], f[1] - f[2], f[1], _RANK[f[0]])):
        here = slice(place[find[1]], place[find[2]])
        if not taken[here].any():
            taken[here] = True
            kept.append(find)
    return kept


def _spans(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, list<SPAN>) per chunk of documents; positions in code points."""
    for first, end, data, offsets in tk.chunks(column):
        rows, ends = [], [0]
        for i in range(end - first):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            at = points = 0
            for kind, s, e, likely, base in finds(raw):
                points += len(raw[at:s].decode())
                at = s
                rows.append((kind, points, points + e - s, raw[s:e].decode(), likely, base))
            ends.append(len(rows))
        columns = list(zip(*rows, strict=True)) or [()] * len(SPAN)
        values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SPAN, strict=True)], fields=list(SPAN))
        yield first, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id and `spans`, an array of (kind, start, end, value, score, base) by start, then kind.

    Positions are code points, end exclusive. A null or empty text has an empty array; null ids and repeated rows stay rows of
    their own; an empty table gives an empty table; other columns of docs are not read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, spans in _spans(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(spans)), spans], ["doc_id", "spans"])

    span = "array<struct<kind:string,start:long,end:long,value:string,score:double,base:boolean>>"
    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {span}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans and all spans as text, per row of `personal_data`."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    top = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), top.alias("top_score"))
