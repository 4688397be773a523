"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A value is found by its format and validated (check digits, ranges, calendar);
only valid values are touched. A format's values are numbered 0..N-1, and a
Feistel network over that range, keyed and tweaked by the kind, permutes the
numbers; numbers that fall outside the range are permuted again until they fall
inside (cycle walking). The result is written back in the format of the
occurrence, with its separators and with check digits that hold. What is
permuted is the value, not its spelling: a telephone number with or without
country code, a date in any order, an IPv6 address with or without its zeros.
Equal values get equal pseudonyms in all documents without any table of values,
different values get different ones, and the holder of the key can invert them.
"""

from __future__ import annotations

import calendar
import hashlib
import ipaddress
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 8
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")


# --- permutation of 0..n-1 -----------------------------------------------------


def _round(key: bytes, tweak: bytes, i: int, value: int, size: int) -> int:
    data = b"%s|%d|%d|%d" % (tweak, i, size, value)
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=32).digest(), "big") % size


def _once(x: int, a: int, b: int, key: bytes, tweak: bytes, back: bool) -> int:
    """A Feistel network over pairs (left < a, right < b), forth or back."""
    left, right = divmod(x, b)
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if i % 2:
            right = (right + sign * _round(key, tweak, i, left, b)) % b
        else:
            left = (left + sign * _round(key, tweak, i, right, a)) % a
    return left * b + right


def permute(x: int, n: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of 0..n-1; ``back`` inverts it."""
    a = math.isqrt(n - 1) + 1 if n > 1 else 1
    b = -(-n // a)
    while True:
        x = _once(x, a, b, key, tweak, back)
        if x < n:
            return x


# --- formats -------------------------------------------------------------------


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def _into(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), shape)


def _card(s: str, key: bytes, back: bool) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    n = len(d) - 1
    out = f"{permute(int(d[:-1]), 10**n, key, b'card%d' % n, back):0{n}d}"
    return _into(s, out + luhn_digit(out))


#: Country codes of two digits; 1 and 7 have one digit, all others three. Fixed values.
_CODES_2 = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: North American area and exchange codes: from 200, none that ends in 11.
_NANP = [a for a in range(200, 1000) if a % 100 != 11]
#: Numbers whose national spelling shows the first digit's meaning: that digit stays. Britain and France: (code, digits).
_FIRST_STAYS = frozenset((("44", 10), ("33", 9)))


def _national(code: str, number: str, key: bytes, back: bool) -> str:
    """A number (country code, national digits without a trunk 0) permuted among those of its code and length.

    Ten digits under code 1 stay North American numbers, or stay none.
    """
    n, tweak = len(number), b"phone" + code.encode()
    if code == "1" and n == 10:
        size = len(_NANP)

        def valid(d: str) -> bool:
            return all(int(x) >= 200 and int(x) % 100 != 11 for x in (d[:3], d[3:6]))

        if valid(number):
            x = (_NANP.index(int(number[:3])) * size + _NANP.index(int(number[3:6]))) * 10_000 + int(number[6:])
            x, line = divmod(permute(x, size**2 * 10_000, key, b"nanp", back), 10_000)
            return f"{_NANP[x // size]}{_NANP[x % size]}{line:04d}"
        while True:
            number = f"{permute(int(number), 10**n, key, tweak, back):0{n}d}"
            if not valid(number):
                return number
    head = number[: (code, n) in _FIRST_STAYS]
    n -= len(head)
    return head + f"{permute(int(number[len(head):]), 10**n, key, tweak + b'|' + head.encode(), back):0{n}d}"


def _phone(s: str, key: bytes, back: bool) -> str | None:
    """With country code; a trunk 0 in brackets after it stays and is no part of the number."""
    d = _digits(s)
    if not 8 <= len(d) <= 15:
        return None
    code = d[: 1 if d[0] in "17" else 2 if d[:2] in _CODES_2 else 3]
    trunk = "0" if re.match(r"\+%s[ .-]?\(0\)" % code, s) else ""
    rest = d[len(code) + len(trunk) :]
    return _into(s, code + trunk + _national(code, rest, key, back))


def _nanp(s: str, key: bytes, back: bool) -> str | None:
    """North American without +; the leading 1, if any, stays."""
    d = _digits(s)
    if int(d[-10:-7]) % 100 == 11 or int(d[-7:-4]) % 100 == 11:
        return None
    return _into(s, d[:-10] + _national("1", d[-10:], key, back))


def _trunk(s: str, key: bytes, back: bool) -> str | None:
    """British (eleven digits) and French (ten) numbers; the leading 0 and the digit after it stay."""
    d = _digits(s)
    return _into(s, d[0] + _national("44" if len(d) == 11 else "33", d[1:], key, back))


def _ip(s: str, key: bytes, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, b"ip", back)
    return ".".join(str(b) for b in x.to_bytes(4, "big"))


def _ip6(s: str, key: bytes, back: bool) -> str | None:
    """Global, unique local and link-local addresses.

    The first group, groups of zero, the lengths of the groups without leading zeros and the places of digits and letters
    stay, so every spelling of an address (leading zeros, ``::``, upper case) can hold the same new one.
    """
    try:
        groups = ipaddress.IPv6Address(s).exploded.split(":")
    except ValueError:
        return None
    first = int(groups[0], 16)
    if not (0x2000 <= first <= 0x3FFF or 0xFC00 <= first <= 0xFDFF or 0xFE80 <= first <= 0xFEBF):
        return None
    plain = [g.lstrip("0") for g in groups[1:]]  # a group of zero is empty
    sets = [("123456789" if i == 0 else "0123456789") if c.isdigit() else "abcdef" for g in plain for i, c in enumerate(g)]
    tweak = b"ip6" + groups[0].encode() + ":".join(re.sub(r"\d", "0", re.sub(r"[a-f]", "a", g)) for g in plain).encode()
    new = iter(_pick("".join(plain), sets, key, tweak, back))
    it = iter(["".join(next(new) for _ in g) for g in plain])
    out = [s[:4]]
    at = 4
    for m in re.finditer(r"[0-9A-Fa-f]+|::", s[4:]):
        out.append(s[at : 4 + m.start()])
        at = 4 + m.end()
        if m.group() == "::":
            spelled = len(re.findall(r"[0-9A-Fa-f]+", s))
            for _ in range(8 - spelled):
                next(it)
            out.append("::")
        else:
            out.append(_cased(m.group(), next(it).rjust(len(m.group()), "0")))
    return "".join(out) + s[at:]


_SSN_AREAS = [a for a in range(1, 900) if a != 666]


def _ssn(s: str, key: bytes, back: bool) -> str | None:
    area, group, serial = int(s[:3]), int(s[4:6]), int(s[7:])
    if area not in _SSN_AREAS or not group or not serial:
        return None
    x = (_SSN_AREAS.index(area) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(permute(x, len(_SSN_AREAS) * 99 * 9999, key, b"ssn", back), 9999)
    area, group = divmod(x, 99)
    return f"{_SSN_AREAS[area]:03d}{s[3]}{group + 1:02d}{s[6]}{serial + 1:04d}"


def _date(s: str, key: bytes, back: bool) -> str | None:
    """Dates from 1900 to 2099: year first, or day first unless only month first is a date.

    A day stays in 1-9, 10-12 or 13-31 and a month in 1-9 or 10-12, so every spelling of a date (with or without leading
    zeros, month first or day first) can hold the same new one and is read back in the same order.
    """
    sep = re.search(r"\D", s)[0]
    parts = s.split(sep)
    iso = len(parts[0]) == 4
    y, first, second = int(parts[0] if iso else parts[2]), *(parts[1:] if iso else parts[:2])
    month_first = iso or int(second) > 12
    m, d = (int(first), int(second)) if month_first else (int(second), int(first))

    def valid(y: int, m: int, d: int) -> bool:
        return 1900 <= y <= 2099 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]

    if not valid(y, m, d):
        return None
    days = range(1, 10) if d < 10 else range(10, 13) if d < 13 else range(13, 32)
    months = range(1, 10) if m < 10 else range(10, 13)
    n, tweak = 200 * len(months) * len(days), b"date%d,%d" % (days[0], months[0])
    while True:
        x = ((y - 1900) * len(months) + months.index(m)) * len(days) + days.index(d)
        x, j = divmod(permute(x, n, key, tweak, back), len(days))
        y, m, d = x // len(months) + 1900, months[x % len(months)], days[j]
        if valid(y, m, d):
            break
    a, b = (m, d) if month_first else (d, m)
    a, b = f"{a:0{len(first)}d}", f"{b:0{len(second)}d}"
    return sep.join((f"{y}", a, b) if iso else (a, b, f"{y}"))


def _alphabet(c: str) -> str:
    return "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _pick(chars: str, sets: list[str], key: bytes, tweak: bytes, back: bool) -> str:
    """``chars`` permuted among all strings that take one character of each set in turn."""
    x, n = 0, 1
    for c, a in zip(chars, sets):
        x, n = x * len(a) + a.index(c), n * len(a)
    x = permute(x, n, key, tweak, back)
    out = []
    for a in reversed(sets):
        x, r = divmod(x, len(a))
        out.append(a[r])
    return "".join(reversed(out))


def _letters(s: str, key: bytes, tweak: bytes, back: bool) -> str:
    """Digits, lower and upper case letters of ``s`` permuted together, each staying what it is."""
    chars = "".join(c for c in s if c.isascii() and c.isalnum())
    sets = [_alphabet(c) for c in chars]
    it = iter(_pick(chars, sets, key, tweak + "".join(a[0] for a in sets).encode(), back))
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in s)


def _cased(shape: str, s: str) -> str:
    """``s`` with upper case where ``shape`` has an ASCII capital."""
    return "".join(c.upper() if h.isascii() and h.isupper() else c for h, c in zip(shape, s))


def _email(s: str, key: bytes, back: bool) -> str | None:
    """The local part without regard to case; the domain stays."""
    local, _, domain = s.rpartition("@")
    lower = "".join(c.lower() if c.isascii() else c for c in local)
    return f"{_cased(local, _letters(lower, key, b'email' + domain.lower().encode(), back))}@{domain}"


def _iban_check(country: str, bban: str) -> str:
    number = "".join(str(int(c, 36)) for c in bban + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _iban(s: str, key: bytes, back: bool) -> str | None:
    plain = s.replace(" ", "")
    country, check, bban = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, bban) != check:
        return None
    new = _letters(bban, key, b"iban" + country.encode(), back)
    it = iter(country + _iban_check(country, new) + new)
    return "".join(" " if c == " " else next(it) for c in s)


#: Formats, most specific first; each stands alone, not inside a longer word or number.
_FORMATS = (
    ("email", "@", re.compile(r"(?<![\w.+%-])\w[\w.%+-]*@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}(?![\w@])"), _email),
    ("iban", "", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    ("ip", ".", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"), _ip),
    ("ip", ":", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]{4}:)[0-9A-Fa-f]{4}(?::[0-9A-Fa-f]{1,4}){0,7}(?:::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)?(?!\w|:[\w:])"), _ip6),
    ("date", "", re.compile(r"(?<![\d./-])(?:\d{4}([-/.])\d\d\1\d\d|\d\d([-/.])\d\d\2\d{4})(?![/-]?\d)"), _date),
    ("date", "", re.compile(r"(?<![\d./-])(?:\d{4}([-/])\d\d?\1\d\d?|\d\d?([-/.])\d\d?\2\d{4})(?![/-]?\d)"), _date),
    ("ssn", "-", re.compile(r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])"), _ssn),
    ("phone", "+", re.compile(
        r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?(?:\d(?:[ .-]\d\d){4}(?![ .-]?\d)|\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d))"), _phone),
    ("card", "", re.compile(r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"), _card),
    ("phone", "", re.compile(r"(?<![\w+.-])(?:1[ .-])?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}(?![\w-]|\.\d)"), _nanp),
    ("phone", "", re.compile(
        r"(?<![\w+.-])(?:(?:\(02\d\)|02\d)[ -]\d{4}[ -]?\d{4}|(?:\(0[1378]\d\d\)|0[1378]\d\d)[ -]\d{3}[ -]?\d{4}|"
        r"(?:\(0[17]\d{3}\)|0[17]\d{3})[ -]\d{3}[ -]?\d{3}|0[1-9]([ .-])\d\d(?:\1\d\d){3})(?![\w-]|[ .]?\d\d)"), _trunk),
)
_DIGIT = re.compile(r"[0-9]")


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[int]]:
    """(text with every valid value replaced, number of values by KINDS). ``back`` restores the values."""
    counts = [0] * len(KINDS)
    if not text or not (_DIGIT.search(text) or "@" in text):
        return text, counts
    # pieces that are done are never searched again, so that no value is replaced twice
    pieces: list[tuple[str, bool]] = [(text, False)]
    for kind, sign, pattern, swap in _FORMATS:
        i = KINDS.index(kind)
        if sign and sign not in text:
            continue
        out: list[tuple[str, bool]] = []
        for piece, done in pieces:
            at = 0
            if not done:
                for m in pattern.finditer(piece):
                    new = swap(m.group(), key, back)
                    if new is not None:
                        counts[i] += 1
                        out += [(piece[at : m.start()], False), (new, True)]
                        at = m.end()
            out.append((piece[at:], done) if at or done else (piece, False))
        pieces = out
    return "".join(p for p, _ in pieces), counts


def protect(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with every valid personal value in the text replaced, and n_<kind> (long), the values replaced by kind.

    ``key``: 16 to 64 secret bytes. A null text stays null, an empty one empty. Repeated rows are treated alike. Extra
    columns pass through; they may not be called as the added ones. ``id_col`` is not read. ``back`` inverts the operator.
    """
    if not 16 <= len(key) <= 64:
        raise ValueError("the key must have 16 to 64 bytes")
    added = [f"n_{k}" for k in KINDS]
    taken = sorted({"_pii", *added} & set(docs.columns))
    if taken:
        raise ValueError(f"rename these columns first: {taken}")

    schema = T.StructType([T.StructField("text", T.StringType())] + [T.StructField(c, T.LongType()) for c in added])

    @F.pandas_udf(schema)
    def run(text: pd.Series) -> pd.DataFrame:
        rows = [(None, [0] * len(KINDS)) if t is None else pseudonymise(t, key, back) for t in text]
        return pd.DataFrame([(t, *n) for t, n in rows], columns=["text", *added])

    out = docs.withColumn("_pii", run(F.col(text_col)))
    return out.withColumn(text_col, F.col("_pii.text")).withColumns({c: F.col(f"_pii.{c}") for c in added}).drop("_pii")
