"""Format-preserving pseudonyms: a keyed Feistel permutation of validated numbers, dates and addresses within their format.

A value is mapped to an integer below the size of its format's domain, permuted there, and written back in its own
layout. The permutation depends on the key and the kind alone, so equal values stay equal in every document, different
values stay different, and the key's owner can invert it. No row meets another: there is no shuffle and no table of names.
"""

from __future__ import annotations

import bisect
import datetime as dt
import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

ROUNDS = 8


class Feistel:
    """A keyed permutation of range(n): alternating additions on the two digits of a mixed radix, walked back into the range."""

    def __init__(self, key: bytes, kind: str, n: int):
        self.key, self.tag, self.n = hashlib.blake2b(key, digest_size=32).digest(), f"{kind}/{n}/".encode(), n
        self.a = max(1, math.isqrt(max(0, n - 1)) + 1)
        self.b = -(-n // self.a)
        self.wide = (max(self.a, self.b).bit_length() + 7) // 8 + 8

    def _f(self, i: int, x: int) -> int:
        size = min(64, self.wide)
        return int.from_bytes(hashlib.blake2b(self.tag + b"%d/%d" % (i, x), key=self.key, digest_size=size).digest(), "big")

    def _once(self, x: int, sign: int) -> int:
        l, r = divmod(x, self.b)
        for i in range(ROUNDS) if sign > 0 else reversed(range(ROUNDS)):
            if i % 2:
                r = (r + sign * self._f(i, l)) % self.b
            else:
                l = (l + sign * self._f(i, r)) % self.a
        return l * self.b + r

    def apply(self, x: int, valid: Callable[[int], bool] = lambda _: True, sign: int = 1) -> int:
        """The image of a valid x among the valid members of the range."""
        while True:
            x = self._once(x, sign)
            if x < self.n and valid(x):
                return x


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _check_digit(body: str) -> str:
    return next(c for c in "0123456789" if luhn(body + c))


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def refill(layout: str, chars: str, where: Callable[[str], bool] = str.isdigit) -> str:
    """The layout with its digits (or what ``where`` says) replaced in order."""
    it = iter(chars)
    return "".join(next(it) if where(c) else c for c in layout)


@functools.lru_cache(1024)
def _domain(key: bytes, kind: str, n: int) -> Feistel:
    return Feistel(key, kind, n)


def _digits(key: bytes, kind: str, digits: str, sign: int, valid: Callable[[str], bool] = lambda _: True) -> str:
    n = len(digits)
    return f"{_domain(key, kind, 10**n).apply(int(digits), lambda x: valid(f'{x:0{n}d}'), sign):0{n}d}"


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _by_class(key: bytes, kind: str, s: str, sign: int, classes: tuple[str, ...] = _CLASSES) -> str:
    """Each digit and letter becomes one of its own class; the whole is permuted as one mixed-radix number."""
    own = [next((k for k in classes if c in k), "") for c in s]
    n = math.prod(len(k) for k in own if k)
    if n < 2:
        return s
    x = 0
    for c, k in zip(s, own, strict=True):
        if k:
            x = x * len(k) + k.index(c)
    layout = "".join(str(classes.index(k)) if k else "-" for k in own)
    x, out = _domain(key, f"{kind}/{layout}", n).apply(x, sign=sign), []
    for c, k in zip(reversed(s), reversed(own), strict=True):
        if k:
            x, i = divmod(x, len(k))
            c = k[i]
        out.append(c)
    return "".join(reversed(out))


def _card(m: re.Match, key: bytes, sign: int) -> str | None:
    s = re.sub(r"\D", "", m[0])
    if not luhn(s) or len(set(s)) == 1:
        return None
    body = s[0] + _digits(key, f"card/{s[0]}", s[1:-1], sign)
    return refill(m[0], body + _check_digit(body))


def _iban(m: re.Match, key: bytes, sign: int) -> str | None:
    s = m[0].replace(" ", "")
    if not 15 <= len(s) <= 34 or _mod97(s[4:] + s[:4]) != 1:
        return None
    bban = _by_class(key, f"iban/{s[:2]}", s[4:], sign)
    return refill(m[0], f"{s[:2]}{98 - _mod97(bban + s[:2] + '00'):02d}{bban}", str.isalnum)


def _area_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(m: re.Match, key: bytes, sign: int) -> str | None:
    s = m[0].replace("-", "")
    return refill(m[0], _digits(key, "ssn", s, sign, _area_ok)) if _area_ok(s) else None


def _nanp_ok(d: str) -> bool:
    return d[0] > "1" and d[3] > "1"


def _phone(m: re.Match, key: bytes, sign: int) -> str | None:
    """Ten national digits, with area and exchange codes that begin with 2 to 9; a leading country code stays."""
    s = re.sub(r"\D", "", m["national"])
    if not _nanp_ok(s):
        return None
    return m[0][: m.start("national") - m.start()] + refill(m["national"], _digits(key, "phone", s, sign, _nanp_ok))


def _abroad(m: re.Match, key: bytes, sign: int) -> str | None:
    """+ and 8 to 15 digits: the first two stay; but a valid national number after +1 is that number in any layout."""
    s = re.sub(r"\D", "", m[0])
    if not 8 <= len(s) <= 15:
        return None
    if s[0] != "1" or len(s) != 11:
        return refill(m[0], s[:2] + _digits(key, f"phone/{s[:2]}", s[2:], sign))
    if _nanp_ok(s[1:]):
        return refill(m[0], "1" + _digits(key, "phone", s[1:], sign, _nanp_ok))
    return refill(m[0], s[:2] + _digits(key, f"phone/{s[:2]}", s[2:], sign, lambda d: not _nanp_ok(s[1] + d)))


def _ip(m: re.Match, key: bytes, sign: int) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255 or not 0 < parts[0] < 224:
        return None
    x = _domain(key, "ipv4", 1 << 32).apply(int.from_bytes(bytes(parts), "big"), lambda v: 0 < v >> 24 < 224, sign)
    return ".".join(map(str, x.to_bytes(4, "big")))


#: Dates are permuted among the days of these years.
FIRST, LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def _date(order: str) -> Callable:
    """A day's image is the same in every layout. Days after the 12th stay among each other, so that a month-first date,
    which is known by such a day, can be read as one again; so do the others."""

    def replace(m: re.Match, key: bytes, sign: int) -> str | None:
        try:
            day = dt.date(int(m["y"]), int(m["m"]), int(m["d"]))
        except ValueError:
            return None
        if not FIRST <= day.toordinal() <= LAST or order == "mdy" and day.day <= 12:
            return None
        alike = lambda x: (dt.date.fromordinal(FIRST + x).day > 12) == (day.day > 12)
        new = dt.date.fromordinal(FIRST + _domain(key, "date", LAST - FIRST + 1).apply(day.toordinal() - FIRST, alike, sign))
        return m["s"].join({"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}[c] for c in order)

    return replace


def _email(m: re.Match, key: bytes, sign: int) -> str | None:
    """The local part, permuted in lower case and written in the old cases, as mail goes by the letters; the host stays."""
    new = _by_class(key, "email", m["local"].lower(), sign)
    return "".join(c.upper() if old.isupper() else c for c, old in zip(new, m["local"], strict=True)) + f"@{m['host']}"


_HEX = ("0123456789abcdef",)


def _secret(m: re.Match, key: bytes, sign: int) -> str | None:
    """The value after a password or token label: hexadecimal stays so, anything else keeps its classes."""
    v = m["value"]
    new = _by_class(key, "secret/hex", v, sign, _HEX) if re.fullmatch(r"[0-9a-f]+", v) else _by_class(key, "secret", v, sign)
    return m[0][: m.start("value") - m.start()] + new + m[0][m.end("value") - m.start() :]


def _access(m: re.Match, key: bytes, sign: int) -> str | None:
    return m[0][:4] + _by_class(key, "access", m[0][4:], sign, ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",)) if re.fullmatch(r"[A-Z2-7]+", m[0][4:]) else m[0][:4] + _by_class(key, "access/any", m[0][4:], sign, (_CLASSES[0], _CLASSES[2]))


#: Kinds in the order they are tried; at one place the first kind whose value is valid wins.
KINDS: list[tuple[str, str, Callable]] = [
    ("email", r"(?P<local>[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63})@(?P<host>[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24})(?![A-Za-z0-9])", _email),
    ("secret", r"(?i:password|passwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?P<value>[A-Za-z0-9_\-+/.]{8,200})", _secret),
    ("access", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", _access),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", _iban),
    ("date", r"(?<![\d.\-/])(?P<y>\d{4})(?P<s>[\-/.])(?P<m>\d{2})(?P=s)(?P<d>\d{2})(?![\d\-/])", _date("ymd")),
    ("date", r"(?<![\d.\-/])(?P<d>\d{2})(?P<s>[\-/.])(?P<m>\d{2})(?P=s)(?P<y>\d{4})(?![\d\-/])", _date("dmy")),
    ("date", r"(?<![\d.\-/])(?P<m>\d{2})(?P<s>/)(?P<d>\d{2})(?P=s)(?P<y>\d{4})(?![\d\-/])", _date("mdy")),
    ("card", r"(?<![\d.\-])\d(?:[ \-]?\d){12,18}(?![\d\-])", _card),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])", _ssn),
    ("phone", r"(?<![\w+.])(?:\+?1[ .\-]?)?(?P<national>\(\d{3}\)[ ]?\d{3}[ .\-]\d{4}|\d{3}[ .\-]\d{3}[ .\-]\d{4})(?![\w\-])", _phone),
    ("phone", r"(?<![\w+])\+[1-9](?:[ .\-()]{0,2}\d){7,14}(?!\d)", _abroad),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", _ip),
]

_ANY = re.compile(r"[0-9@=:]").search
_PATTERNS = [(kind, re.compile(p, re.ASCII), f) for kind, p, f in KINDS]


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether [a, b) meets none of the sorted, disjoint spans."""
    i = bisect.bisect_left(taken, (b,))
    return i == 0 or taken[i - 1][1] <= a


def _matches(pattern: re.Pattern, m: re.Match) -> Iterator[re.Match]:
    """The match, then the pattern's matches from the same start to the ends of its earlier groups, longest first."""
    yield m
    for end in range(m.end() - 1, m.start(), -1):
        if m.string[end] in " -" and (shorter := pattern.fullmatch(m.string, m.start(), end)):
            yield shorter


def _near(text: str) -> str:
    """Kinds that can't occur are left out by a character they all need."""
    return "".join(c for c in "@+=:" if c in text)


def pseudonymise(text: str, key: bytes, sign: int = 1) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its values replaced, and (kind, start, end) of each in the old text. sign -1 inverts."""
    if not _ANY(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    signs = _near(text)
    digits = re.search(r"\d", text) is not None
    for kind, pattern, replace in _PATTERNS:
        if kind == "email" and "@" not in signs or kind == "secret" and not ("=" in signs or ":" in signs) or kind not in ("email", "secret", "access") and not digits or replace is _abroad and "+" not in signs or kind == "access" and "AKIA" not in text and "ASIA" not in text:
            continue
        own, at = [], 0
        while whole := pattern.search(text, at):
            at = whole.start() + 1
            for m in _matches(pattern, whole) if kind in ("card", "iban") else (whole,):
                if _free(taken, m.start(), m.end()) and (new := replace(m, key, sign)) is not None:
                    own.append((m.start(), m.end(), kind, new))
                    at = m.end()
                    break
        found += own
        taken = sorted([*taken, *(x[:2] for x in own)])
    if not found:
        return text, []
    found.sort()
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(kind, a, b) for a, b, kind, _ in found]


def pseudonymise_documents(docs: DataFrame, key: str, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, the text with pseudonyms, and the spans that were replaced (offsets in the input text).

    A null text stays null with no spans; empty texts and texts without a valid value come back unchanged. Very long
    texts are searched whole. Of two kinds that could stand at one place the first of ``KINDS`` with a valid value wins.
    Null ids and repeated rows give results like any others; other columns are ignored, whatever their names; an empty
    table gives no rows. The key is a secret of the caller's. What a format needs stays in clear: the hosts of e-mail
    addresses, country codes, the first digit of a card, the prefix of an access key.
    """
    ship(docs.sparkSession)
    secret = key.encode()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(None, []) if t is None else pseudonymise(t, secret) for t in batch.column(len(keep)).to_pylist()]
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([r[0] for r in rows], pa.string()), pa.array(spans, span)], names=[*keep, "clean_text", "spans"])

    return docs.select(*keep, docs[text].alias("__pii_text")).mapInArrow(run, f"{fields}, clean_text string, spans array<struct<kind:string,start:long,end:long>>")
