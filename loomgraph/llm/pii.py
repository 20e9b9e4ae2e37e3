"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their check (Luhn, IBAN mod 97, octets up to 255, a
day that exists) and e-mail names are permuted within their format by an
alternating Feistel network keyed with blake2b.  A permutation has no
collisions and needs no table: equal values get equal pseudonyms in every
document, and unequal ones stay unequal.  The separators of a number are not
part of its value, so that two ways of writing it stay linked.

Defined results
* null doc_id: kept and treated like any other row.  Null text: stays null, nothing replaced.  Empty text: stays empty.
* very long texts: whole.  A text without a digit or @ is not touched by Python's re.
* a number that fails its check may have swallowed what stands beside it: shorter ends at the borders of its digit groups
  are tried, then the search goes on from its next group.  A card may then be one group, or groups of four digits and
  more of which the last may be shorter; such a card,
  and an IBAN in one group, goes before a match of another shape around it.
* a number for which that finds nothing is left alone.
* rows that repeat: each is treated alike, so they stay equal.
* empty table: no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import datetime
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import _text as T

KEY = b"loomgraph pseudonyms, key 1"
ROUNDS = 8
KINDS = ("email", "iban", "date", "ip", "ssn", "phone", "card")
_FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days

_FIND = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]*\w[\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?<!\w)(?:(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"
    r"|(?P<date>\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})"
    r"|(?P<ip>\d{1,3}(?:\.\d{1,3}){3}(?!\.\d))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{1,4})(?:[ .-]?\d){5,11}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})"
    r"|(?P<card>\d(?:[ -]?\d){12,18}))(?!\w)"
)


def permute(value: int, left: int, right: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of 0 .. left * right - 1."""
    a, b = divmod(value, right)
    for r in range(ROUNDS):
        x, m = (b, left) if r % 2 == 0 else (a, right)
        size = max(1, (max(left, right).bit_length() + 7) // 8)
        h = hashlib.blake2b(bytes([r]) + tweak + x.to_bytes(size, "big"), key=key, digest_size=min(64, (m.bit_length() + 7) // 8 + 8)).digest()
        f = int.from_bytes(h, "big")
        if r % 2 == 0:
            a = (a + f) % left
        else:
            b = (b + f) % right
    return a * right + b


def digits(s: str, key: bytes, kind: str) -> str:
    """Permute the decimal strings of the length of s."""
    h = len(s) // 2
    return str(permute(int(s), 10**h, 10 ** (len(s) - h), key, f"{kind}{len(s)}".encode())).zfill(len(s))


def luhn(s: str) -> bool:
    d = [int(x) for x in s[::-1]]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def lay(template: str, new: str) -> str:
    """The digits of `new` in the layout of `template`."""
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in template)


def _card(s: str, key: bytes) -> str:
    d = "".join(c for c in s if c.isdigit())
    if not luhn(d):
        return s
    body = digits(d[:-1], key, "card")
    return lay(s, body + next(c for c in "0123456789" if luhn(body + c)))


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban(s: str, key: bytes) -> str:
    flat = s.replace(" ", "")
    if _mod97(flat) != 1:
        return s
    old = "".join(c for c in flat[4:] if c.isdigit())
    body = lay(flat[4:], digits(old, key, "iban")) if old else flat[4:]
    new = iter(flat[:2] + f"{98 - _mod97(flat[:2] + '00' + body):02d}" + body)
    return "".join(c if c == " " else next(new) for c in s)


def _date(s: str, key: bytes) -> str:
    sep = next(c for c in s if not c.isdigit())
    p = s.split(sep)
    orders = {"-": [(0, 1, 2)], ".": [(2, 1, 0)], "/": [(2, 0, 1), (2, 1, 0)]}[sep]
    for y, m, d in orders:
        try:
            n = datetime.date(int(p[y]), int(p[m]), int(p[d])).toordinal() - _FIRST
        except ValueError:
            continue
        if not 0 <= n < _DAYS:
            return s
        left = int(_DAYS**0.5) + 1
        while True:  # cycle-walk: the domain of the network is a little larger than the days
            n = permute(n, left, left, key, b"date")
            if n < _DAYS:
                break
        t = datetime.date.fromordinal(n + _FIRST)
        out = [""] * 3
        out[y], out[m], out[d] = f"{t.year:04d}", f"{t.month:02d}", f"{t.day:02d}"
        return sep.join(out)
    return s


def _ip(s: str, key: bytes) -> str:
    o = [int(x) for x in s.split(".")]
    if max(o) > 255:
        return s
    n = permute(int.from_bytes(bytes(o), "big"), 1 << 16, 1 << 16, key, b"ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


def _ssn(s: str, key: bytes) -> str:
    area, group, serial = s.split("-")
    good = lambda a, g, n: a not in ("000", "666") and a < "900" and g != "00" and n != "0000"
    if not good(area, group, serial):
        return s
    n = area + group + serial
    while True:
        n = digits(n, key, "ssn")
        if good(n[:3], n[3:5], n[5:]):
            return lay(s, n)


def _phone(s: str, key: bytes) -> str:
    d = "".join(c for c in s if c.isdigit())
    keep = 0
    if s[0] == "+":  # the country code stays
        keep = len(re.match(r"\+(\d+?)(?:\D|$)", s)[1]) if re.match(r"\+\d{1,3}\D", s) else min(len(d) - 10, 3) if len(d) > 10 else 1
        keep = max(1, keep)
    return lay(s, d[:keep] + digits(d[keep:], key, "phone"))


_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7), "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)]
_CLASS = {c: a for a in _ALPHABETS for c in a}


def _email(s: str, key: bytes) -> str:
    name, at, domain = s.rpartition("@")
    kinds = [_CLASS.get(c) for c in name]
    radix = [len(a) if a else 1 for a in kinds]
    half = len(name) // 2
    value, left, right = 0, 1, 1
    for k, (c, a, r) in enumerate(zip(name, kinds, radix)):
        value = value * r + (a.index(c) if a else 0)
        left, right = (left * r, right) if k < half else (left, right * r)
    value = permute(value, left, right, key, b"email" + str(radix).encode())
    out = []
    for c, a, r in zip(reversed(name), reversed(kinds), reversed(radix)):
        value, x = divmod(value, r)
        out.append(a[x] if a else c)
    return "".join(reversed(out)) + at + domain


_CHANGE = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


_GROUP = re.compile(r"\w+|.")
_CARD = re.compile(r"\d(?:[ -]?\d){12,18}(?!\w)")


def _passing(kind: str, s: str, start: int, text: str, inner: bool = False) -> int:
    """Where in the text the part of s that passes its check ends, or 0; it begins where s does, at `start`."""
    groups = [(g.start(), g.end()) for g in re.finditer(r"\w+", s)]
    flat = lambda e: re.sub(r"\W", "", s[:e])
    if kind == "iban":
        until = min([a for a, b in groups[1:] if 15 <= b - a <= 34 and re.match("[A-Z]{2}[0-9]{2}", s[a:b]) and _mod97(s[a:b]) == 1], default=len(s))
        good = [e for _, e in groups if e <= until and s[:e].isascii() and (15 <= len(flat(e)) <= 34 or e == len(s)) and _mod97(flat(e)) == 1]
        return start + (good[0] if good and good[0] == groups[0][1] else good[-1]) if good else 0
    alone = [x for x in groups if 13 <= x[1] - x[0] <= 19 and s[x[0] : x[1]].isascii() and luhn(s[x[0] : x[1]])]
    if alone:
        return start + alone[0][1] if alone[0][0] == 0 else 0
    for k in range(len(groups), 0, -1):
        e = groups[k - 1][1]
        shaped = all(b - a >= 4 for a, b in groups[: k - 1])
        if (shaped or k == len(groups) and not inner) and s[:e].isascii() and 13 <= len(flat(e)) <= 19 and luhn(flat(e)):
            if not shaped and any((m := _CARD.match(text, start + a)) and _passing("card", m.group(), start + a, text, True) for a, _ in groups[1:]):
                return 0  # a number of the usual shape begins inside
            return start + e
    return 0


def pseudonymise(text: str, key: bytes = KEY) -> tuple[str, dict[str, int]]:
    """The text with its personal data replaced, and how many of each kind."""
    count: dict[str, int] = {}

    out, last, pos = [], 0, 0
    while m := _FIND.search(text, pos):
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind in ("card", "iban"):
            end = _passing(kind, m.group(), start, text)
        new = None
        if end and (kind == "email" or m.group().isascii() or kind in ("card", "iban")):  # \d also knows the digits of other scripts
            new = _CHANGE[kind](text[start:end], key)
            count[kind] = count.get(kind, 0) + (new != text[start:end])
        if new is None or new == text[start:end] and kind in ("date", "ip", "ssn"):
            if kind in ("date", "ip", "ssn") and (c := _CARD.match(text, start)) and (end := _passing("card", c.group(), start, text)):
                new, kind = _card(text[start:end], key), "card"
                count[kind] = count.get(kind, 0) + (new != text[start:end])
            else:
                pos = start + len(_GROUP.match(text, start).group())
                continue
        out += [text[last:start], new]
        last = pos = end
    return "".join(out) + text[last:], count


def _apply(key: bytes):
    def run(batches):
        for batch in batches:
            null = np.asarray(batch.column("text").is_null())
            at = 0
            for piece in T.slices(batch):
                text = piece.column("text")
                raw, off = T.utf8_parts(text)
                hit = np.zeros(len(raw) + 1, np.int64)
                np.cumsum((raw == 64) | ((raw >= 48) & (raw <= 57)), out=hit[1:])
                rows = np.flatnonzero(hit[off[1:]] > hit[off[:-1]])
                counts = np.zeros((len(piece), len(KINDS)), np.int32)
                gone = null[at : at + len(piece)]
                at += len(piece)
                changed = {}
                for r in rows.tolist():
                    new, n = pseudonymise(text[r].as_py(), key)
                    if n:
                        changed[r] = new
                        for k, v in n.items():
                            counts[r, KINDS.index(k)] = v
                if changed or gone.any():
                    values = text.to_pylist() if len(changed) * 4 > len(piece) else None
                    if values is None:  # few: splice slices of the column
                        parts, last = [], 0
                        for r in sorted(changed):
                            parts += [text.slice(last, r - last), pa.array([changed[r]], pa.string())]
                            last = r + 1
                        text = pa.concat_arrays([*parts, text.slice(last)])
                    else:
                        for r, v in changed.items():
                            values[r] = v
                        text = pa.array(values, pa.string())
                    if gone.any():
                        text = pc.if_else(pa.array(gone), pa.scalar(None, pa.string()), text)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), text, *(pa.array(counts[:, k]) for k in range(len(KINDS)))], ["doc_id", "text", *(f"n_{k}" for k in KINDS)]
                )

    return run


def pseudonyms(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """(doc_id, text, n_email .. n_card): every document with its personal data replaced; see the module for edge cases."""
    docs = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"])
    return docs.mapInArrow(_apply(key), "doc_id bigint, text string, " + ", ".join(f"n_{k} int" for k in KINDS))
