"""Personal data replaced by format-preserving Feistel pseudonyms.

E-mail addresses, IPv4 addresses, payment cards (Luhn), IBANs (mod 97), US
social security numbers, phone numbers and calendar dates are found, validated,
and mapped by a keyed permutation of all values of the same format.  The map is
a bijection, so equal values stay equal (and different ones different) in all
documents, without any table: nothing is shuffled or gathered.  Separators,
letter case, country codes and top-level domains stay; pseudonyms are valid in
the sense that their kind was validated in.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, prepare

#: Column that the operator adds: spans of the pseudonyms in the new text.
SPANS = "pii_spans"
ROUNDS = 10
#: Characters that one permutation covers.
PART = 64
#: Values up to this length are remembered.
SHORT = 128
#: What the formats look like.
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ymd>(?<![\w.-])\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}(?!\w|[-/.]\d))"
    r"|(?P<dmy>(?<![\w.-])\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4}(?!\w|[-/.]\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?!\w|-\d))"
    r"|(?P<nanp>(?<!\w)(?:\+1[ .-]?)?(?:\(\d{3}\)[ ]?|(?<![\d-])\d{3}[.-])\d{3}[.-]\d{4}(?!\w|-\d))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\w))"
    r"|(?P<card>(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w))",
    re.ASCII,
)
_MAYBE = re.compile(r"[0-9@]")
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): alternating Feistel, cycle-walked."""
    if size < 2:
        return value
    a = max(2, int(size**0.5)) if size < 1 << 52 else 1 << (size.bit_length() // 2)
    b = -(-size // a)
    width = (max(a, b).bit_length() + 7) // 8 + 8
    while True:
        left, right = value % a, value // a
        for r in range(ROUNDS):
            half = right if r % 2 == 0 else left
            mask = int.from_bytes(hashlib.shake_256(b"%b|%b|%d|%d|%d" % (key, tweak.encode(), size, r, half)).digest(width), "big")
            if r % 2 == 0:
                left = (left + mask) % a
            else:
                right = (right + mask) % b
        value = right * a + left
        if value < size:
            return value


def walk(value: int, size: int, key: bytes, tweak: str, valid: Callable[[int], bool]) -> int:
    """The permutation restricted to valid values, of which ``value`` is one."""
    while not valid(value := permute(value, size, key, tweak)):
        pass
    return value


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _refill(shape: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def _alnum(text: str, key: bytes, tweak: str) -> str:
    """Letters become letters of the same case and digits digits.

    Longer values than ``PART`` characters are permuted part by part, each part
    with its place in the tweak: bounded numbers, linear work, still a bijection.
    """
    if len(text) > PART:
        return "".join(_alnum(text[at : at + PART], key, f"{tweak}|{at}" if at else tweak) for at in range(0, len(text), PART))
    low = text.lower()
    value, size = 0, 1
    for c in low:
        if c.isdigit():
            value, size = value * 10 + int(c), size * 10
        elif "a" <= c <= "z":
            value, size = value * 26 + ord(c) - 97, size * 26
    shape = re.sub("[a-z]", "a", re.sub("[0-9]", "0", low))
    value = permute(value, size, key, f"{tweak}|{shape}")
    out = []
    for c, old in zip(reversed(low), reversed(text), strict=True):
        if c.isdigit():
            value, d = divmod(value, 10)
            out.append(str(d))
        elif "a" <= c <= "z":
            value, d = divmod(value, 26)
            out.append(chr((65 if old.isupper() else 97) + d))
        else:
            out.append(old)
    return "".join(reversed(out))


def _email(text: str, key: bytes) -> str:
    local, _, domain = text.partition("@")
    name, _, top = domain.rpartition(".")
    return f"{_alnum(local, key, 'local')}@{_alnum(name, key, 'domain')}.{top}"


def _ip(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    value = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
    return ".".join(str(b) for b in value.to_bytes(4, "big"))


def _iban_check(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _iban(text: str, key: bytes) -> str | None:
    flat = text.replace(" ", "")
    country, body = flat[:2], flat[4:]
    if not 15 <= len(flat) <= 34 or _iban_check(country, body) != flat[2:4]:
        return None
    new = _alnum(body, key, f"iban|{country}")
    rest = iter(country + _iban_check(country, new) + new)
    return "".join(c if c == " " else next(rest) for c in text)


def _card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not luhn(digits) or not digits.strip("0"):
        return None
    n = len(digits) - 1
    body = f"{walk(int(digits[:-1]), 10**n, key, 'card', bool):0{n}d}"
    return _refill(text, body + next(c for c in "0123456789" if luhn(body + c)))


def _ssn(text: str, key: bytes) -> str | None:
    def valid(v: int) -> bool:
        area, group, serial = v // 1_000_000, v // 10_000 % 100, v % 10_000
        return area not in (0, 666) and area < 900 and group > 0 and serial > 0

    value = int(text.replace("-", ""))
    return _refill(text, f"{walk(value, 10**9, key, 'ssn', valid):09d}") if valid(value) else None


def _phone(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 8 <= len(digits) <= 15 or text.count("(") != text.count(")"):
        return None
    if text[0] == "+":
        code = re.match(r"\+(\d{1,3})(?:[ .(-]|$)", text)
        code = code[1] if code else digits[:1]
    else:
        code = ""
    body = digits[len(code) :]
    tweak = f"phone|{len(body)}"  # written with or without a country code, a number stays linked
    return _refill(text, code + f"{permute(int(body), 10 ** len(body), key, tweak):0{len(body)}d}")


def _date(text: str, key: bytes, year_first: bool) -> str | None:
    mark = re.search(r"\D", text)[0]
    parts = text.split(mark)
    year, numbers = (parts[0], parts[1:]) if year_first else (parts[2], parts[:2])
    orders = [(0, 1)] if year_first else [(1, 0), (0, 1)]  # where month and day are; day first where that is valid

    def read(y: int, pair: list[int]) -> tuple[int, tuple[int, int]] | None:
        for m, d in orders:
            try:
                return datetime.date(y, pair[m], pair[d]).toordinal(), (m, d)
            except ValueError:
                continue
        return None

    found = read(int(year), [int(x) for x in numbers])
    if found is None or not _FIRST_DAY <= found[0] <= _LAST_DAY:
        return None
    day, order = found

    def write(v: int) -> list[int]:
        date = datetime.date.fromordinal(v + _FIRST_DAY)
        pair = [0, 0]
        pair[order[0]], pair[order[1]] = date.month, date.day
        return [date.year, *pair]

    def valid(v: int) -> bool:
        y, *pair = write(v)
        return read(y, pair)[1] == order

    y, *pair = write(walk(day - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, key, "date", valid))
    padded = [f"{x:02d}" if all(len(n) == 2 for n in numbers) else str(x) for x in pair]
    return mark.join([str(y), *padded] if year_first else [*padded, str(y)])


KINDS: dict[str, Callable[[str, bytes], str | None]] = {
    "email": _email,
    "ip": _ip,
    "iban": _iban,
    "ymd": lambda t, k: _date(t, k, True),
    "dmy": lambda t, k: _date(t, k, False),
    "ssn": _ssn,
    "nanp": _phone,
    "phone": _phone,
    "card": _card,
}
NAMES = {"ymd": "date", "dmy": "date", "nanp": "phone"}


@lru_cache(maxsize=100_000)
def _known(kind: str, text: str, key: bytes) -> str | None:
    return KINDS[kind](text, key)


def pseudonym(kind: str, text: str, key: bytes) -> str | None:
    """The pseudonym of a value of a kind, None if it isn't valid."""
    return _known(kind, text, key) if len(text) <= SHORT else KINDS[kind](text, key)


def replace(text: str | None, key: bytes) -> tuple[str | None, list[dict]]:
    """The text with pseudonyms, and their kinds and spans in the new text."""
    if not text or not _MAYBE.search(text):
        return text, []
    out, spans, at, length, pos = [], [], 0, 0, 0
    while found := PATTERN.search(text, pos):
        kind = found.lastgroup if found.lastgroup in KINDS else next(k for k in KINDS if found[k])
        new = pseudonym(kind, found[0], key)
        if new is None:
            # Not valid as this kind: a shorter or later value may begin inside.
            pos = found.start() + 1
            while pos < len(text) and text[pos - 1].isalnum() and text[pos].isalnum() and pos < found.end():
                pos += 1
            continue
        before = text[at : found.start()]
        out += [before, new]
        length += len(before)
        spans.append({"kind": NAMES.get(kind, kind), "start": length, "end": length + len(new)})
        length += len(new)
        at = pos = found.end()
    return "".join([*out, text[at:]]), spans


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _replace_batches(key: bytes, added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            done = [replace(t, key) for t in batch.column("text").to_pylist()]
            columns = dict(zip(names, batch.columns, strict=True))
            columns["text"] = pa.array([t for t, _ in done], type=pa.string())
            if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
                columns["n_chars"] = pa.array([None if t is None else len(t) for t, _ in done], type=columns["n_chars"].type)
            for name in added:
                columns[name] = pa.array([s for _, s in done], type=_SPAN_TYPE)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def pseudonymise(docs: DataFrame, key: bytes, spans: bool = True) -> DataFrame:
    """All columns with ``text`` (and its length in an integer ``n_chars``) renewed.

    ``spans`` adds a last column, named ``pii_spans``, or ``pii_spans_`` and so
    on where the input has one of that name.  A null text stays null and an empty
    one empty, both without spans; repeated rows give repeated results; a text of
    any length is replaced as a whole.
    """
    prepare(docs.sparkSession)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    added = fresh(docs, SPANS) if spans else []
    fields = [T.StructField(f.name, f.dataType) for f in docs.schema.fields]
    return docs.mapInArrow(_replace_batches(key, added), T.StructType([*fields, *[T.StructField(name, T.ArrayType(span)) for name in added]]))
