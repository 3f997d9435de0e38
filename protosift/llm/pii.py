"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A finding is validated (check digits, ranges, calendar), turned into an index
within all values of its format, permuted by a keyed Feistel network over just
that range, and written back in the shape it had: same separators, lengths and
character classes, valid check digits. The permutation depends on the key and the
format, not on the document, so equal values stay equal everywhere, also
if they are separated differently; with the key it can be undone (a date up to
its zero padding). Dates as 3/4/2024 are read with the day first. Days up to the twelfth
and those beyond, which alone can stand behind the month, are permuted apart.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from calendar import monthrange
from collections.abc import Callable
from datetime import date
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("email", "iban", "ip", "date", "ssn", "card", "phone")
#: First and last day that a date is permuted within.
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

# The formats that are looked for. None begins within a word, and
# numbers not behind a digit with a separator of theirs (or a decimal point); other
# signs may stand right before.
FOUND = re.compile(
    r"""(?<![A-Za-z0-9])(?:
    (?P<email>[A-Za-z0-9_+-][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24})(?![A-Za-z0-9@])
  | (?P<iban>[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])
  | (?<![0-9][.])(?P<ip>[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?![0-9]|\.[0-9])
  | (?<![0-9][.-])(?P<date>[0-9]{4}(?P<d1>[-/.])[0-9]{1,2}(?P=d1)[0-9]{1,2}|[0-9]{1,2}(?P<d2>[-/.])[0-9]{1,2}(?P=d2)[0-9]{4})(?![0-9]|[-/.][0-9])
  | (?<![0-9][-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9]|-[0-9])
  | (?<![0-9][.-])(?P<card>[0-9](?:[\x20-]?[0-9]){12,18})(?![0-9]|-[0-9])
  | (?<![0-9][.+-])(?P<phone>(?:\+?1[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])|(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{1,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])?[0-9]{2,4}[\x20.-][0-9]{2,4}(?:[\x20.-][0-9]{2,4}){0,2}|\+[0-9]{8,15})(?![0-9]|-[0-9])
    )""",
    re.VERBOSE,
)
_HINT = re.compile(r"[0-9@]")


class Feistel:
    """Keyed permutations of 0 .. n-1 for any n, and their inverses."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, number: int, value: int, below: int) -> int:
        size = (below.bit_length() + 7) // 8 + 16
        told = f"{tweak}|{number}|{value}".encode()
        return int.from_bytes(hashlib.shake_256(self.key + b"|" + told).digest(size), "big") % below

    def permute(self, value: int, n: int, tweak: str, back: bool = False) -> int:
        """The value's place under the permutation of ``tweak``. The network covers
        a rectangle of at least n places; places beyond n are passed over."""
        if n < 2:
            return value
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            x, y = divmod(value, b)
            for k in range(ROUNDS)[:: -1 if back else 1]:
                sign = -1 if back else 1
                if k % 2:
                    y = (y + sign * self._round(tweak, k, x, b)) % b
                else:
                    x = (x + sign * self._round(tweak, k, y, a)) % a
            value = x * b + y
            if value < n:
                return value


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _class(c: str) -> str | None:
    return next((k for k in _CLASSES if c in k), None)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _reshape(shape: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> int:
    """Sum of a number by Luhn's rule, modulo 10: 0 if its last digit is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def iban_rest(text: str) -> int:
    """Rest modulo 97 of an account number, spaces left out: 1 if it is right."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _months() -> list[int]:
    """Days beyond the twelfth before each month from the first day's on."""
    out = [0]
    for year in range(date.fromordinal(FIRST_DAY).year, date.fromordinal(LAST_DAY).year + 1):
        for month in range(1, 13):
            out.append(out[-1] + monthrange(year, month)[1] - 12)
    return out


_LATE = _months()


def _place(day: date) -> tuple[int, int, str]:
    """Number of a day among those up to, or among those beyond, the twelfth of their
    months; how many such days there are; and which of the two."""
    month = (day.year - date.fromordinal(FIRST_DAY).year) * 12 + day.month - 1
    if day.day > 12:
        return _LATE[month] + day.day - 13, _LATE[-1], "late date"
    return month * 12 + day.day - 1, 12 * (len(_LATE) - 1), "early date"


def _day(number: int, late: bool) -> date:
    """The day of a number that ``_place`` gives."""
    month = bisect_right(_LATE, number) - 1 if late else number // 12
    day = number - _LATE[month] + 13 if late else number % 12 + 1
    return date(date.fromordinal(FIRST_DAY).year + month // 12, month % 12 + 1, day)


class Pseudonyms:
    """Pseudonyms of single findings, by kind. ``None`` if a finding is not valid."""

    def __init__(self, key: bytes, back: bool = False):
        network = Feistel(key)
        self.permute: Callable[[int, int, str], int] = lambda value, n, tweak: network.permute(value, n, tweak, back)
        self.of = lru_cache(maxsize=100_000)(self._of)

    def _of(self, kind: str, text: str) -> str | None:
        return getattr(self, kind)(text)

    def classes(self, text: str, tweak: str) -> str:
        """Letters and digits permuted, each within its class."""
        free = [(i, k) for i, c in enumerate(text) if (k := _class(c))]
        n = value = 0
        for n_before, (i, k) in enumerate(free):
            n = n * len(k) if n_before else len(k)
            value = value * len(k) + k.index(text[i])
        shape = "".join(str(_CLASSES.index(k)) if (k := _class(c)) else c for c in text)
        value, out = self.permute(value, n, f"{tweak}|{shape}"), list(text)
        for i, k in reversed(free):
            value, place = divmod(value, len(k))
            out[i] = k[place]
        return "".join(out)

    def email(self, text: str) -> str | None:
        local, _, host = text.rpartition("@")
        labels, _, top = host.rpartition(".")
        if ".." in local or local.endswith("."):
            return None
        # Upper and lower case are the same address.
        return f"{self._uncased(local, 'local')}@{self._uncased(labels, 'host')}.{top}"

    def _uncased(self, text: str, tweak: str) -> str:
        """Permuted in lower case; capitals stay where they are."""
        moved = self.classes(text.lower(), tweak)
        return "".join(new.upper() if old.isupper() else new for old, new in zip(text, moved, strict=True))

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
            return None
        body = self.classes(plain[4:], f"iban|{plain[:2]}")
        left = iter(f"{plain[:2]}{98 - iban_rest(f'{plain[:2]}00{body}'):02d}{body}")
        return "".join(c if c == " " else next(left) for c in text)

    def ip(self, text: str) -> str | None:
        parts = [int(x) for x in text.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
            return None
        value = self.permute(int.from_bytes(bytes(parts), "big"), 2**32, "ip")
        return ".".join(map(str, value.to_bytes(4, "big")))

    def date(self, text: str) -> str | None:
        mark = next(c for c in text if not c.isdigit())
        parts = text.split(mark)
        order = ["year", "month", "day"] if len(parts[0]) == 4 else ["month", "day", "year"] if int(parts[1]) > 12 else ["day", "month", "year"]
        try:
            day = date(**{k: int(x) for k, x in zip(order, parts, strict=True)}).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        # Days that can stand behind a month stay such days, whichever way a date is
        # written, so that all its spellings move to the same day.
        padded = any(len(x) == 2 and x[0] == "0" for x in parts)
        moved = _day(self.permute(*_place(date.fromordinal(day))), date.fromordinal(day).day > 12)
        plain = not padded and any(len(x) == 1 for x in parts)
        written = {"year": f"{moved.year:04d}", "month": f"{moved.month:0{1 if plain else 2}d}", "day": f"{moved.day:0{1 if plain else 2}d}"}
        return mark.join(written[k] for k in order)

    def ssn(self, text: str) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        value = self.permute(value, 898 * 99 * 9999, "ssn")
        value, serial = divmod(value, 9999)
        area, group = divmod(value, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def card(self, text: str) -> str | None:
        digits = _digits(text)
        if luhn(digits) or len(set(digits)) == 1:
            return None
        free = len(digits) - 2  # the first digit names the network, the last is the check
        moved = f"{self.permute(int(digits[1:-1]), 10**free, f'card|{len(digits)}|{digits[0]}'):0{free}d}"
        body = digits[0] + moved
        return _reshape(text, body + str(-luhn(body + "0") % 10))

    def phone(self, text: str) -> str | None:
        digits = _digits(text)
        if not (10 <= len(digits) <= 15 if text[0] != "+" else 8 <= len(digits) <= 15):
            return None
        national = digits[-10:]
        american = len(digits) == 10 and text[0] != "+" or len(digits) == 11 and digits[0] == "1"
        if american and (national[0] in "01" or national[3] in "01"):  # not a number of that plan
            american = False
        if american:
            value = (((int(national[0]) - 2) * 100 + int(national[1:3])) * 8 + int(national[3]) - 2) * 10**6 + int(national[4:])
            value = self.permute(value, 800 * 8 * 10**6, "phone")
            rest, last = divmod(value, 10**6)
            rest, exchange = divmod(rest, 8)
            area, middle = divmod(rest, 100)
            moved = f"{area + 2}{middle:02d}{exchange + 2}{last:06d}"
        elif text[0] == "+":
            free = len(digits) - 2
            moved = f"{self.permute(int(digits[2:]), 10**free, f'phone|{len(digits)}|{digits[:2]}'):0{free}d}"
        else:
            return None
        return _reshape(text, digits[: len(digits) - len(moved)] + moved)


def replace_all(text: str, names: Pseudonyms) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what they replaced."""
    if not _HINT.search(text):
        return text, []
    parts, spans, done, at = [], [], 0, 0
    while m := FOUND.search(text, at):
        kind, new = m.lastgroup, None
        for kind in KINDS:
            if m.group(kind):
                new = names.of(kind, m.group())
                break
        if new is None:
            # Not valid as a whole: go on after its first character run.
            at = m.start() + len(re.match(r"[A-Za-z0-9]*", m.group()).group() or "x")
            other = _valid_other(text, m, kind, names)
            if other is None:
                continue
            kind, end, new = other
        else:
            end = m.end()
        parts += [text[done : m.start()], new]
        spans.append((kind, m.start(), end))
        done = at = end
    return "".join(parts) + text[done:], spans


_ALONE = {"card": re.compile(r"[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9]|-[0-9])"), "phone": re.compile(r"[0-9]{10}(?![0-9])|\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9]|-[0-9])")}


def _valid_other(text: str, m: re.Match, kind: str, names: Pseudonyms) -> tuple[str, int, str] | None:
    """A valid card number without the numbers that follow it, or a later kind
    that is valid where an earlier one matched in vain."""
    if kind == "card":
        for cut in reversed([x.start() for x in re.finditer("[\x20-]", m.group())]):
            part = m.group()[:cut]
            if len(_digits(part)) >= 13 and (new := names.of("card", part)) is not None:
                return "card", m.start() + cut, new
    for other, pattern in _ALONE.items():
        if other != kind and (found := pattern.match(text, m.start())) and (new := names.of(other, found.group())) is not None:
            return other, found.end(), new
    return None


class Pseudonymiser:
    """Replaces personal values in whole texts by pseudonyms of the same format.

    Values that are written differently stay linked: dates in either order, and
    addresses in capitals or not. A permutation may leave a value as it is, as
    any other value is as likely; a text is then the same there.

    A null text stays null and an empty one empty. Other columns stay as they
    are, rows may repeat, and an empty table stays empty. Columns ``out_col`` and
    ``spans_col`` replace columns of these names.
    """

    def __init__(self, key: bytes, text_col="text"):
        if len(key) < 16:
            raise ValueError("the key takes 16 bytes or more")
        self.key, self.text_col = key, text_col

    def apply(self, docs: DataFrame, out_col: str = "pseudonymous", spans_col: str = "spans", back: bool = False) -> DataFrame:
        """The table with new texts, and spans (kind, start, end) of the old text
        in code points. ``back`` turns pseudonyms into the values they stand for."""
        keep = [c for c in docs.columns if c not in (out_col, spans_col)]
        docs = docs.select(*(F.col(f"`{c}`") for c in keep))
        at, key = keep.index(self.text_col), self.key

        def run(batches):
            names = Pseudonyms(key, back)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            for batch in batches:
                texts, spans = [], []
                for text in batch.column(at).to_pylist():
                    new, found = (text, []) if not text else replace_all(text, names)
                    texts.append(new)
                    spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(texts, pa.string()), pa.array(spans, kind)], names=[*batch.schema.names, out_col, spans_col]
                )

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        return docs.mapInArrow(run, f"{fields}, `{out_col}` string, `{spans_col}` array<struct<kind:string,start:long,end:long>>")
