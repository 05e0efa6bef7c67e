"""Personal data replaced by format-preserving pseudonyms.

Emails, phone numbers, card numbers (Luhn), IPv4 addresses, US social security
numbers, IBANs (mod 97), calendar dates and quoted credentials are found,
validated, and permuted within their own format by a keyed Feistel network. The
permutation depends on the key, the kind and the format only, so equal values
have equal pseudonyms in every document, different values different ones, and
``reveal`` undoes it. No value is its own pseudonym: the permutation is
P^-1(P(x) + 1), one cycle through the whole format; values that aren't valid
(a 31st of April, a check digit that fails) are walked past.

What looks like a value but isn't valid is searched again from its second
character, and for shorter ends. Runs of digits and separators may hold cards
beside other digits (expiry dates, CVVs, other cards): every start and end at a
separator is tried, 4-4-4-4 groups first, then what an issuer's prefix and length
allow, the longest first; a run as a whole needs the check digit only. Where a run can be
read in several ways, ``reveal`` may read a pseudonym otherwise than the value was read.

The key is the caller's. ``session_key`` is LUMENQ_PII_KEY, or, where that is
unset, drawn at random for the session: pseudonyms are then linked within it only.

Edges: a null text stays null; texts without personal data come back as they
are, byte for byte; rows that repeat are rewritten alike; every other column is
carried, and ``n_chars``, if there, is counted again where a text has changed.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import os
import re
import secrets
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm.shared import table

ROUNDS = 8

_CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"]
_CLASS = {ch: c for c in _CLASSES for ch in c}
_INDEX = {ch: k for c in _CLASSES for k, ch in enumerate(c)}

PATTERN = re.compile(
    r"""(?P<email>(?<![\w.+-])[\w](?:[\w.+-]*[\w+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})
    |(?:token|secret|password|api[_-]?key|access[_-]?key)\s*[=:]\s*(?:["'](?P<secret>[A-Za-z0-9+/_-]{16,128})["']|(?P<bare>[A-Za-z0-9+/_-]{16,128})(?![\w+/-]))
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<ip>(?<![\w.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![\w]|\.[0-9]))
    |(?P<iso>(?<![\w-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w-]))
    |(?P<day>(?<![\w/.])[0-9]{1,2}(?P<sep>[/.])[0-9]{1,2}(?P=sep)[0-9]{4}(?![\w/]))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<phone>(?<![\w.+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w])|(?<![\w.+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?![\w]))""",
    re.VERBOSE | re.IGNORECASE,
)
KINDS = ("email", "secret", "bare", "iban", "ip", "iso", "day", "ssn", "phone")
#: Digits with single separators, 13 at least, none of them part of a word or a longer number.
_RUN = re.compile(r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,}(?!\w)")
_QUADS = re.compile(r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}")
#: Lengths of the countries' IBANs (ISO 13616).
_IBAN = {
    x[:2]: int(x[2:])
    for x in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28
    LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20""".split()
}


class Permutation:
    """A keyed permutation of 0 .. n-1 without fixed points (n > 1)."""

    def __init__(self, n: int, tweak: str, key: bytes):
        self.n, self.a = n, max(1, math.isqrt(max(0, n - 1)) + 1)
        self.b = -(-n // self.a)
        self.key = hashlib.blake2b(tweak.encode(), key=hashlib.sha256(key).digest(), digest_size=32).digest()
        self.size = 16 + (n.bit_length() + 7) // 8

    def _f(self, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(i.to_bytes(1, "big") + x.to_bytes(self.size, "big"), key=self.key, digest_size=min(64, self.size)).digest(), "big")

    def _forth(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in range(0, ROUNDS, 2):
                left = (left + self._f(i, right)) % self.a
                right = (right + self._f(i + 1, left)) % self.b
            x = left * self.b + right
            if x < self.n:
                return x

    def _back(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in range(ROUNDS - 2, -1, -2):
                right = (right - self._f(i + 1, left)) % self.b
                left = (left - self._f(i, right)) % self.a
            x = left * self.b + right
            if x < self.n:
                return x

    def step(self, x: int, by: int = 1) -> int:
        return self._back((self._forth(x) + by) % self.n)


@lru_cache(maxsize=4096)
def _permutation(n: int, tweak: str, key: bytes) -> Permutation:
    return Permutation(n, tweak, key)


def permute(value: str, kind: str, key: bytes, by: int = 1, valid: Callable[[str], bool] | None = None) -> str:
    """The value with its letters and digits permuted within their classes, on to the next valid one."""
    classes = [_CLASS.get(ch) for ch in value]
    n = math.prod(len(c) for c in classes if c)
    if n < 2:
        return value
    # the classes are part of the tweak: a format is a permutation of its own
    p = _permutation(n, kind + ":" + "".join(str(_CLASSES.index(c)) if c else "x" for c in classes), key)
    x = 0
    for ch, c in zip(value, classes, strict=True):
        if c:
            x = x * len(c) + _INDEX[ch]
    while True:
        x = p.step(x, by)
        out, rest = [], x
        for ch, c in zip(reversed(value), reversed(classes), strict=True):
            if c:
                rest, k = divmod(rest, len(c))
                out.append(c[k])
            else:
                out.append(ch)
        made = "".join(reversed(out))
        if valid is None or valid(made):
            return made


def _refill(value: str, chars: str) -> str:
    """``value`` with its letters and digits replaced, in order, by ``chars``, in its own case."""
    it = iter(chars)
    return "".join((next(it).lower() if ch.islower() else next(it)) if ch.isalnum() else ch for ch in value)


def luhn_digit(body: str) -> str:
    total = sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(int(ch) for ch in reversed(body)))
    return str(-total % 10)


def luhn_ok(digits: str) -> bool:
    return len(set(digits)) > 1 and luhn_digit(digits[:-1]) == digits[-1]


def issued(digits: str) -> bool:
    """Whether an issuer's prefix and length allow the number."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    if digits[0] == "4":
        return n in (13, 16, 19)
    if 51 <= two <= 55 or 2221 <= four <= 2720:
        return n == 16
    if two in (34, 37):
        return n == 15
    if two in (30, 36, 38, 39):
        return n in (14, 16, 19)
    return (two in (35, 62, 64, 65) or four == 6011) and 16 <= n <= 19


def _mod97(iban: str) -> int:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(ch, 36)) for ch in s)) % 97


def _date(y: int, m: int, d: int) -> datetime.date | None:
    try:
        return datetime.date(y, m, d) if 1900 <= y <= 2099 else None
    except ValueError:
        return None


_DAY0 = datetime.date(1900, 1, 1)
_DAYS = (datetime.date(2099, 12, 31) - _DAY0).days + 1


def _shift_date(day: datetime.date, key: bytes, by: int) -> datetime.date:
    return _DAY0 + datetime.timedelta(days=_permutation(_DAYS, "date", key).step((day - _DAY0).days, by))


def _ssn_ok(s: str) -> bool:
    d = s.replace("-", "")
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def pseudonym(kind: str, value: str, key: bytes, by: int = 1) -> str | None:
    """The pseudonym of a value of a kind (``by=-1``: the value of a pseudonym); None if the value isn't valid."""
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels, _, last = domain.rpartition(".")
        return f"{permute(local, 'local', key, by)}@{permute(labels, 'domain', key, by, lambda s: '--' not in s)}.{last}"
    if kind == "bare" and not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
        return None
    if kind in ("secret", "bare"):
        # hexadecimal stays hexadecimal
        hexes = "0123456789ABCDEF" if re.fullmatch("[0-9A-F]+", value) else "0123456789abcdef" if re.fullmatch("[0-9a-f]+", value) else None
        if hexes is None:
            return permute(value, "secret", key, by, lambda s: bool(re.search("[0-9]", s) and re.search("[A-Za-z]", s)) or kind == "secret")
        made = _permutation(16 ** len(value), f"hex:{len(value)}", key).step(int(value, 16), by)
        return "".join(hexes[int(ch, 16)] for ch in f"{made:0{len(value)}x}")
    if kind == "iban":
        flat = value.replace(" ", "").upper()
        if not 15 <= len(flat) <= 34 or len(flat) != _IBAN.get(flat[:2], len(flat)) or not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]+", flat) or _mod97(flat) != 1:
            return None
        body = permute(flat[4:], "iban" + flat[:2], key, by)
        return _refill(value, flat[:2] + f"{98 - _mod97(flat[:2] + '00' + body):02d}" + body)
    if kind == "ip":
        parts = value.split(".")
        if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
            return None
        return str(ipaddress.IPv4Address(_permutation(1 << 32, "ip", key).step(int(ipaddress.IPv4Address(value)), by)))
    if kind == "iso":
        day = _date(*map(int, value.split("-")))
        return None if day is None else _shift_date(day, key, by).isoformat()
    if kind == "day":
        sep = "/" if "/" in value else "."
        a, b, y = value.split(sep)
        swapped = int(b) > 12  # month first where only that is a date
        day = _date(int(y), int(a), int(b)) if swapped else _date(int(y), int(b), int(a))
        if day is None:
            return None
        # the days that would be read the other way round, or written in another width, are walked past
        while True:
            day = _shift_date(day, key, by)
            x, z = (day.month, day.day) if swapped else (day.day, day.month)
            if (day.day > 12 or not swapped) and (len(a) == 2 or x < 10) and (len(b) == 2 or z < 10):
                return f"{x:0{len(a)}d}{sep}{z:0{len(b)}d}{sep}{day.year}"
    if kind == "ssn":
        return permute(value, "ssn", key, by, _ssn_ok) if _ssn_ok(value) else None
    if kind == "phone":
        digits = re.sub(r"\D", "", value)
        if not 8 <= len(digits) <= 15:
            return None
        head = re.match(r"\+[0-9]{1,3}(?=[ .(-])", value)
        keep = head.end() if head else 2 if value[0] == "+" else 0
        return value[:keep] + permute(value[keep:], "phone" + value[:keep], key, by)
    if kind in ("card", "run"):
        digits = re.sub(r"\D", "", value)
        if not luhn_ok(digits) or not (kind == "run" or issued(digits)):
            return None
        body = permute(digits[:-1], kind, key, by, lambda s: len(set(s)) > 1 and issued(s + luhn_digit(s)) == issued(digits))
        return _refill(value, body + luhn_digit(body))
    raise ValueError(f"unknown kind {kind!r}")


def _cards(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the cards among a run of digits and separators, none of which overlap."""
    pieces = [(start + m.start(), start + m.end()) for m in re.finditer("[0-9]+", text[start:end])]
    found = []
    for i, (s, _) in enumerate(pieces):
        n = 0
        for a, e in pieces[i:]:
            n += e - a
            if n > 19:
                break
            if n >= 13:
                digits = re.sub(r"\D", "", text[s:e])
                if issued(digits) and luhn_ok(digits):
                    found.append((not _QUADS.fullmatch(text, s, e), -n, s, e))
    taken: list[tuple[int, int, str]] = []
    free = bytearray(end - start)
    for _, _, s, e in sorted(found):
        if not any(free[s - start : e - start]):
            free[s - start : e - start] = b"x" * (e - s)
            taken.append((s, e, "card"))
    if not taken and sum(e - s for s, e in pieces) <= 19 and luhn_ok(re.sub(r"\D", "", text[start:end])):
        taken.append((start, end, "run"))
    return sorted(taken)


def _spans(text: str, key: bytes, by: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, pseudonym) of the values but cards, in order."""
    at = 0
    while m := PATTERN.search(text, at):
        kind = next(k for k in KINDS if m.group(k) is not None)
        s, e = m.span(kind)
        new = pseudonym(kind, text[s:e], key, by)
        if new is None and kind in ("iban", "phone"):
            for cut in range(e - 1, s + 7, -1):  # shorter ends, at the end of a word or number
                if text[cut - 1].isalnum() and not text[cut].isalnum() and (x := PATTERN.match(text, s, cut)) and x.group(kind) == text[s:cut] and (new := pseudonym(kind, text[s:cut], key, by)) is not None:
                    e = cut
                    break
        if new is None:
            at = m.start() + 1
        else:
            yield s, e, new
            at = e


def rewrite(text: str, key: bytes, by: int = 1) -> tuple[str, int]:
    """The text with its personal data replaced, and how many values that were."""
    found = list(_spans(text, key, by))
    gaps = zip([0, *(e for _, e, _ in found)], [*(s for s, _, _ in found), len(text)], strict=True)
    for a, z in gaps if re.search("(?:[0-9][ -]?){13}", text) else ():
        for m in _RUN.finditer(text, a, z):
            for s, e, kind in _cards(text, *m.span()):
                if (new := pseudonym(kind, text[s:e], key, by)) is not None:
                    found.append((s, e, new))
    out, at = [], 0
    for s, e, new in sorted(found):
        out += [text[at:s], new]
        at = e
    return ("".join([*out, text[at:]]), len(found)) if found else (text, 0)


def reveal(text: str, key: bytes) -> str:
    return rewrite(text, key, -1)[0]


_drawn = secrets.token_bytes(32)


def session_key() -> bytes:
    """LUMENQ_PII_KEY, or a key of this session."""
    own = os.environ.get("LUMENQ_PII_KEY")
    return own.encode() if own else _drawn


def _rows(columns: list[str], key: bytes, by: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            some = pc.fill_null(pc.match_substring_regex(text, "[0-9@]|[=:]\\s*[\"']"), False).to_numpy(zero_copy_only=False)
            counts, changed, new = [0] * len(text), [False] * len(text), []
            for i in some.nonzero()[0].tolist():
                made, counts[i] = rewrite(text[i].as_py(), key, by)
                if counts[i]:
                    changed[i] = True
                    new.append(made)
            cols = {c: b.column(c) for c in columns}
            if new:
                mask = pa.array(changed)
                cols["text"] = pc.replace_with_mask(text, mask, pa.array(new, text.type))
                if "n_chars" in cols:
                    cols["n_chars"] = pc.replace_with_mask(cols["n_chars"], mask, pa.array([len(x) for x in new], cols["n_chars"].type))
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(counts, pa.int32())], names=[*cols, "n_pii"])

    return run


def pseudonymize(docs: DataFrame, key: bytes, by: int = 1) -> DataFrame:
    """``docs`` with ``text`` rewritten and ``n_pii``, the number of values replaced (in place of any such column)."""
    columns = [c for c in docs.columns if c != "n_pii"]
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField("n_pii", T.IntegerType())])
    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(_rows(columns, key, by), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data under pseudonyms."""
    return pseudonymize(table(spark, sf_dir, "documents"), session_key())
