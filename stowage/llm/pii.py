"""Personal data replaced by format-preserving pseudonyms.

Each validated value is permuted by a keyed Feistel network within its own format: digits stay digits, separators and
case stay where they are, check digits are made right again, and dates stay dates. The permutation depends on the key
and the kind of value only, so a value has the same pseudonym in every document, and no two values share one.

Phone numbers are found as ten digits (3-3-4 with separators, or plain and not beginning with 0 or 1, after a 1 or not),
with + and a country code, and with a leading 0 (five pairs, or an area code set apart). Nine digits without + or 0, as
in Spain, read like a count and stay. Secrets are runs of 32 or more hexadecimal digits, tokens that begin as those of
common services do, and private keys in PEM form. E-mail addresses keep their domain.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import bound_batches

ROUNDS = 8
#: Dates are permuted among the days of these years.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date", "secret")

_START = r"(?<!\w)(?=[(+\dA-Fa-f]|[A-Z]{2}\d)"
_SHAPES = (
    r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}([/.])\d{1,2}\4\d{4})(?![\w]|[./-]\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d))"
    r"|(?P<phone>(?<![\w])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?![\w]|-\d))"
    r"|(?P<abroad>\+[1-9](?:[ .-]?\d){0,2}(?:[ .-]?\(\d{1,4}\))?(?:[ ./-]?\d){5,13}(?!\w))"
    r"|(?P<trunk>(?<![.,/+-])(?:0[1-9](?:[ .-]?\d{2}){4}|(?:0[1-9]\d{1,3}[ /-]|\(0[1-9]\d{1,3}\) ?)(?:\d{6,8}|\d{3,4}[ -]\d{3,4}))(?![\w]|[.,/-]\d))"
    r"|(?P<plain>(?<![.,/+-])1?[2-9]\d{9}(?![\w]|[ .,/-]\d))"
    r"|(?P<secret>(?<!\w)[0-9A-Fa-f]{32,}+(?!\w))"
)
_OTHERS = re.compile(f"{_START}(?:{_SHAPES})")
#: A run of digits may hold several cards, or a card beside other numbers.
_NUMBERS = re.compile(_START + "(?:" + _SHAPES + r"|(?P<digits>\d(?:[ -]?\d){12,}+(?!\w)))")
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_AROUND = re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}")


#: What the tokens of common services, web tokens and private keys have in them, and their shapes.
_MARKS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk-", "k_live_", "xox", "AIza", "eyJ", "PRIVATE KEY")
_TOKEN = re.compile(
    r"(?<![A-Za-z0-9])(?:((?:AKIA|ASIA))[A-Z0-9]{16}|(gh[pousr]_)[A-Za-z0-9]{36,255}|(github_pat_)\w{22,255}|(glpat-)[\w-]{20,255}|(sk-)(?=[A-Za-z_-]{0,255}\d)[A-Za-z0-9_-]{20,255}"
    r"|([sr]k_live_)[A-Za-z0-9]{16,255}|(xox[abps]-)[A-Za-z0-9-]{10,255}|(AIza)[\w-]{35}|(eyJ)[\w-]{8,}+\.eyJ[\w-]{4,}+\.[\w-]*+)(?![A-Za-z0-9])"
    r"|(-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----)[^-]*+(?=-----END [A-Z ]{0,30}PRIVATE KEY-----)"
)

#: Country codes of telephone numbers have one, two or three digits.
_COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")


class Feistel:
    """A keyed permutation of the numbers below ``size``: a Feistel network, walked until it is back in range."""

    def __init__(self, key: bytes, kind: str, size: int) -> None:
        self.size = size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        label = size if size.bit_length() <= 4096 else f"{size:x}"  # long decimals are slow to write
        self.seeds = [hashlib.blake2b(f"{kind}:{label}:{i}".encode(), key=key, digest_size=32).digest() for i in range(ROUNDS)]

    def _round(self, seed: bytes, x: int) -> int:
        n = (self.half + 7) // 8
        if n > 64:
            return int.from_bytes(hashlib.shake_256(seed + x.to_bytes(n, "big")).digest(n), "big") & self.mask
        out = hashlib.blake2b(x.to_bytes(n, "big"), key=seed, digest_size=n).digest()
        return int.from_bytes(out[:n], "big") & self.mask

    def __call__(self, x: int) -> int:
        if self.size < 2:
            return x
        while True:
            a, b = x >> self.half, x & self.mask
            for seed in self.seeds:
                a, b = b, a ^ self._round(seed, b)
            x = a << self.half | b
            if x < self.size:
                return x

    def back(self, x: int) -> int:
        if self.size < 2:
            return x
        while True:
            a, b = x >> self.half, x & self.mask
            for seed in reversed(self.seeds):
                a, b = b ^ self._round(seed, a), a
            x = a << self.half | b
            if x < self.size:
                return x


@functools.lru_cache(maxsize=4096)
def _permutation(key: bytes, kind: str, size: int) -> Feistel:
    return Feistel(key, kind, size)


def luhn(digits: str) -> int:
    """Sum of the Luhn rule; a number with its check digit is valid if it ends in 0."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))


def _digits(key: bytes, kind: str, digits: str) -> str:
    return str(_permutation(key, kind, 10 ** len(digits))(int(digits))).zfill(len(digits))


def _fill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def _in_base(key: bytes, kind: str, text: str, alphabet: str) -> str:
    """Permute the characters of ``text`` that are in ``alphabet`` (case is kept, the others stay)."""
    own = [c for c in text.lower() if c in alphabet]
    n = functools.reduce(lambda acc, c: acc * len(alphabet) + alphabet.index(c), own, 0)
    n = _permutation(key, kind, len(alphabet) ** len(own))(n)
    out = []
    for _ in own:
        n, r = divmod(n, len(alphabet))
        out.append(alphabet[r])
    it = iter(reversed(out))
    return "".join((next(it).upper() if c.isupper() else next(it)) if c.lower() in alphabet else c for c in text)


def _iban_check(body: str, country: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97


def _card(key: bytes, v: str) -> str | None:
    digits = re.sub(r"\D", "", v)
    if luhn(digits) % 10:
        return None
    body = _digits(key, "card", digits[:-1])
    return _fill(v, body + str(-luhn(body + "0") % 10))


def _cards(run: str) -> Iterator[tuple[int, int]]:
    """Where the cards in a run of digits are: groups that together have 13 to 19 digits (16 first) and hold the Luhn rule."""
    groups = [(m.start(), m.end()) for m in re.finditer(r"\d+", run)]
    i = 0
    while i < len(groups):
        n, found = 0, {}
        for k in range(i, min(len(groups), i + 19)):
            n += groups[k][1] - groups[k][0]
            if n > 19:
                break
            if n >= 13 and luhn(re.sub(r"\D", "", run[groups[i][0] : groups[k][1]])) % 10 == 0:
                found[n] = k
        if not found:
            i += 1
            continue
        last = found[min(found, key=lambda n: (n != 16, n))]
        yield groups[i][0], groups[last][1]
        i = last + 1


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(key: bytes, v: str) -> str | None:
    digits = v.replace("-", "")
    if not _ssn_valid(digits):
        return None
    while not _ssn_valid(digits := _digits(key, "ssn", digits)):
        pass
    return _fill(v, digits)


def _phone(key: bytes, v: str) -> str:
    digits = re.sub(r"\D", "", v)
    return _fill(v, digits[:-10] + _digits(key, "phone", digits[-10:]))


def _phone_from(key: bytes, v: str, head: int) -> str:
    """All digits but the first ``head`` (country code, trunk 0) are permuted, as in the same number written otherwise."""
    digits = re.sub(r"\D", "", v)
    return _fill(v, digits[:head] + _digits(key, "phone", digits[head:]))


def _abroad(key: bytes, v: str) -> str:
    digits = re.sub(r"\D", "", v)
    head = _COUNTRY.match(digits).end()
    return _phone_from(key, v, head + ("(0" in v and digits[head] == "0"))


def _trunk(key: bytes, v: str) -> str:
    return _phone_from(key, v, 1)


def _ip(key: bytes, v: str) -> str | None:
    parts = [int(x) for x in v.split(".")]
    if max(parts) > 255:
        return None
    return ".".join(str(b) for b in _permutation(key, "ip", 1 << 32)(int.from_bytes(bytes(parts), "big")).to_bytes(4, "big"))


def _date(key: bytes, v: str) -> str | None:
    a, b, c = map(int, re.split(r"\D", v))
    iso = "-" in v
    # Day before month where that is a date, else month before day.
    orders = [(a, b, c)] if iso else [(c, b, a), (c, a, b)]
    for k, (year, month, day) in enumerate(orders):
        try:
            n = datetime.date(year, month, day).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= n <= LAST_DAY:
            return None
        while True:
            n = FIRST_DAY + _permutation(key, "date", LAST_DAY - FIRST_DAY + 1)(n - FIRST_DAY)
            d = datetime.date.fromordinal(n)
            if iso:
                return d.isoformat()
            one = re.match(r"\d\D|\d\d\D\d\D", v)  # no leading zeros
            first, second = (d.day, d.month) if k == 0 else (d.month, d.day)
            if k == 1 and d.day <= 12:
                continue  # it would read as day before month
            sep = re.search(r"\D", v)[0]
            return f"{first}{sep}{second}{sep}{d.year}" if one else f"{first:02}{sep}{second:02}{sep}{d.year}"
    return None


def _iban(key: bytes, v: str) -> str | None:
    plain = v.replace(" ", "")
    country, body = plain[:2], plain[4:]
    if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in body + country + plain[2:4])) % 97 != 1:
        return None
    body = _in_base(key, "iban", _in_base(key, "iban-letters", body, "abcdefghijklmnopqrstuvwxyz"), "0123456789")
    it = iter(f"{country}{_iban_check(body, country):02}{body}")
    return "".join(c if c == " " else next(it) for c in v)


def _secret(key: bytes, v: str) -> str:
    kind, size = "secret", 16 ** len(v)
    n = (_permutation(key, kind, size) if len(v) <= 1024 else Feistel(key, kind, size))(int(v, 16))  # only short ones are worth keeping
    return "".join(o.upper() if c.isupper() else o for c, o in zip(v, f"{n:0{len(v)}x}", strict=True))


def _token(key: bytes, m: re.Match[str]) -> str:
    """What follows the mark, letter for letter and digit for digit, some at a time."""
    mark, body = m[m.lastindex], m[0][len(m[m.lastindex]) :]
    parts = (body[i : i + 256] for i in range(0, len(body), 256))
    return mark + "".join(_in_base(key, "token", _in_base(key, "token-digits", p, "0123456789"), "abcdefghijklmnopqrstuvwxyz") for p in parts)


def _email(key: bytes, v: str) -> str:
    local, _, domain = v.rpartition("@")
    return f"{_in_base(key, 'email', _in_base(key, 'email-digits', local, '0123456789'), 'abcdefghijklmnopqrstuvwxyz')}@{domain}"


_PHONES = ("abroad", "trunk", "plain")
_MAKERS = {"iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "abroad": _abroad, "trunk": _trunk, "plain": _phone, "ip": _ip, "date": _date, "secret": _secret}


def pseudonymise(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind were replaced."""
    counts: dict[str, int] = {}

    def number(m: re.Match[str]) -> str:
        kind = m.lastgroup or "date"
        new = _MAKERS[kind](key, m[0])
        if new is None:
            return m[0]
        kind = "phone" if kind in _PHONES else kind
        counts[kind] = counts.get(kind, 0) + 1
        return new

    def email(m: re.Match[str]) -> str:
        counts["email"] = counts.get("email", 0) + 1
        return _email(key, m[0])

    def digits(m: re.Match[str]) -> str:
        if m.lastgroup != "digits":
            return number(m)
        out, at = [], 0
        for start, end in _cards(m[0]):
            counts["card"] = counts.get("card", 0) + 1
            out += [_OTHERS.sub(number, m[0][at:start]), _card(key, m[0][start:end])]
            at = end
        return "".join([*out, _OTHERS.sub(number, m[0][at:])])

    def plain(part: str) -> str:
        out, at = [], 0
        for m in _TOKEN.finditer(part) if any(mark in part for mark in _MARKS) else ():
            counts["secret"] = counts.get("secret", 0) + 1
            out += [_NUMBERS.sub(digits, part[at : m.start()]), _token(key, m)]
            at = m.end()
        return "".join([*out, _NUMBERS.sub(digits, part[at:])])

    parts, at, look = [], 0, 0
    # Only what stands around an @ is looked at for e-mail; what is none is searched for numbers like the rest.
    while "@" in text and (m := _AROUND.search(text, look)):
        look = text.index("@", m.start()) + 1
        if e := _EMAIL.search(m[0]):
            parts += [plain(text[at : m.start() + e.start()]), email(e)]
            at = look = m.start() + e.end()
    parts.append(plain(text[at:]))
    return "".join(parts), counts


def redact(docs: DataFrame, key: bytes, text_col: str = "text", column: str = "pii") -> DataFrame:
    """``docs`` with a struct column: text (pseudonymised) and one count for each kind of value.

    Null texts stay null with counts of 0, empty ones empty. Numbers that fail their check (Luhn, IBAN, calendar,
    octets) stay as they are; so do texts without any value. Long texts are read whole, repeated rows changed alike, no
    rows give no rows. Other columns stay as they were: if one is named ``column``, the new one gets underscores
    behind its name until it is free. ``key``: 16 to 64 secret bytes.
    """
    if not 16 <= len(key) <= 64:
        raise ValueError("key must have 16 to 64 bytes")
    bound_batches(docs.sparkSession)
    taken = {c.lower() for c in docs.columns}
    while column.lower() in taken:
        column += "_"

    @F.pandas_udf("text string, " + ", ".join(f"n_{k} int" for k in KINDS))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for t in s:
                new, counts = (t, {}) if t is None else pseudonymise(t, key)
                rows.append((new, *(counts.get(k, 0) for k in KINDS)))
            yield pd.DataFrame(rows, columns=["text", *(f"n_{k}" for k in KINDS)])

    value: Column = of(F.col(text_col))
    return docs.withColumn(column, value)
