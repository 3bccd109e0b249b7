import datetime
import hashlib
import random
import re

from reelforge.llm import pii
from reelforge.llm import queries as llm_queries

KEY = b"test"


def test_permutation_is_a_bijection():
    for size in (2, 3, 10, 97, 1000):
        assert sorted(pii.permute(v, size, KEY, "t") for v in range(size)) == list(range(size))
    big = 26**30
    assert len({pii.permute(v, big, KEY, "t") for v in range(50)}) == 50


def test_formats_stay_and_values_validate():
    rng = random.Random(1)
    for _ in range(60):
        body = "".join(rng.choices("0123456789", k=15))
        card = body + next(c for c in "0123456789" if pii.luhn(body + c))
        new, spans = pii.replace(f"pay {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}!!", KEY)
        assert spans[0]["kind"] == "card" and pii.luhn(re.sub(r"\D", "", new)) and card[:8] not in new
        assert re.fullmatch(r"pay \d{4} \d{4} \d{4} \d{4}!!", new)
    for text, shape, kind in [
        ("mail Ab.c9@mail8.example.com.", r"mail [A-Z][a-z]\.[a-z]\d@[a-z]{4}\d\.[a-z]{7}\.com\.", "email"),
        ("at 42.144.35.254###", r"at \d+\.\d+\.\d+\.\d+###", "ip"),
        ("+1 (017) 555-7713 x", r"\+1 \(\d{3}\) \d{3}-\d{4} x", "phone"),
        ("call +49 30 901820", r"call \+49 \d\d \d{6}", "phone"),
        ("on 2024-02-29,", r"on \d{4}-\d\d-\d\d,", "date"),
        ("on 3/14/1999", r"on \d+/\d+/\d{4}", "date"),
        ("ssn 123-45-6789", r"ssn \d{3}-\d\d-\d{4}", "ssn"),
        ("iban DE89 3704 0044 0532 0130 00", r"iban DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", "iban"),
    ]:
        new, spans = pii.replace(text, KEY)
        assert re.fullmatch(shape, new) and new != text, (text, new)
        assert [s["kind"] for s in spans] == [kind]
        again, spans = pii.replace(new, KEY)  # pseudonyms validate as the same kind
        assert [s["kind"] for s in spans] == [kind], (new, again)


def test_invalid_values_stay():
    for text in ("9807915762804491", "1.2.3.999", "2023-02-30", "12/13/14", "666-12-3456", "DE00370400440532013000", "a" * 50000, "@" * 1000, "v4.0. 12 monkeys", ""):
        assert pii.replace(text, KEY) == (text, [])


def test_equal_values_stay_linked():
    one, _ = pii.replace("Write to kfslg.71@mail0.example.com or +1 (578) 555-6437", KEY)
    two, _ = pii.replace("x KFSLG.71@mail0.example.com, (578) 555-6437", KEY)
    mail = re.search(r"\S+@\S+", one)[0]
    assert mail in two.replace(two[2:7], two[2:7].lower()) and one[-14:] == two[-14:]
    assert pii.replace("kfslg.71@mail0.example.com", b"other")[0] != mail


def test_operator(spark):
    rows = [(1, "ip 42.144.35.254", 16, 5), (1, "ip 42.144.35.254", 16, 5), (2, None, None, 6), (None, "", 0, 7), (3, "x" * 100_000 + " a@b.example", 0, 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, pii_spans int")
    got = pii.pseudonymise(frame, KEY)
    assert got.columns == ["doc_id", "text", "n_chars", "pii_spans", "pii_spans_"]
    assert got.schema["n_chars"].dataType.simpleString() == "int"
    rows = sorted(got.collect(), key=lambda r: (r.doc_id or 0, r.text or ""))
    assert [(r.doc_id, r.pii_spans, len(r.pii_spans_)) for r in rows] == [(None, 7, 0), (1, 5, 1), (1, 5, 1), (2, 6, 0), (3, 8, 1)]
    for r in rows:
        for s in r.pii_spans_:
            assert pii.PATTERN.fullmatch(r.text[s.start : s.end]) and r.n_chars == len(r.text)
    assert pii.pseudonymise(frame.limit(0), KEY).collect() == []
    assert pii.pseudonymise(frame, KEY, spans=False).columns == frame.columns
    text_length = pii.pseudonymise(spark.createDataFrame([(1, "ip 42.144.35.254", "many")], "doc_id long, text string, n_chars string"), KEY)
    assert text_length.first().n_chars == "many"


def test_very_long_addresses():
    for text in ("a" * 100_000 + "@mail.example.com", "me@" + "b" * 100_000 + ".com", "a.1-" * 25_000 + "@" + "c.d" * 30_000 + ".org"):
        new, spans = pii.replace(f"<{text}>", KEY)
        assert spans == [{"kind": "email", "start": 1, "end": len(text) + 1}] and len(new) == len(text) + 2
        assert new != f"<{text}>" and new == pii.replace(f"<{text}>", KEY)[0]
        assert [c for c in new if not c.isalnum()] == [c for c in f"<{text}>" if not c.isalnum()]
    # parts are permuted apart, so equal values stay linked and different ones stay different
    values = {"x" * 200 + f"{i}@mail.example.com" for i in range(30)}
    assert len({pii.replace(v, KEY)[0] for v in values}) == 30


# An independent rewriting of planted values: Feistel rounds on digit strings.


def feistel(value, size, key, tweak):
    a = max(2, int(size**0.5)) if size < 2**52 else 2 ** (size.bit_length() // 2)
    b = (size + a - 1) // a
    n = ((max(a, b)).bit_length() + 7) // 8 + 8

    def f(r, x):
        message = key + b"|" + tweak.encode() + b"|" + str(size).encode() + b"|" + str(r).encode() + b"|" + str(x).encode()
        return int.from_bytes(hashlib.shake_256(message).digest(n), "big")

    while True:
        right, left = divmod(value, a)
        for r in range(0, 10, 2):
            left = (left + f(r, right)) % a
            right = (right + f(r + 1, left)) % b
        value = right * a + left
        if value < size:
            return value


def letters(text, key, tweak):
    """Mixed-radix number of the letters and digits, permuted and written back."""
    bases = [10 if c.isdigit() else 26 for c in text.lower() if c.isdigit() or c.isalpha()]
    digits = [int(c) if c.isdigit() else ord(c) - 97 for c in text.lower() if c.isdigit() or c.isalpha()]
    value, size = 0, 1
    for base, digit in zip(bases, digits):
        value, size = value * base + digit, size * base
    shape = "".join("0" if c.isdigit() else "a" if c.isalpha() else c for c in text)
    value = feistel(value, size, key, f"{tweak}|{shape}")
    back = []
    for base in reversed(bases):
        back.append(value % base)
        value //= base
    made = iter(reversed(back))
    return "".join(str(next(made)) if c.isdigit() else chr(next(made) + (97 if c.islower() else 65)) if c.isalpha() else c for c in text)


def digits_into(text, digits):
    made = iter(digits)
    return "".join(next(made) if c.isdigit() else c for c in text)


def email(text, key):
    local, domain = text.split("@")
    name, top = domain.rsplit(".", 1)
    return letters(local, key, "local") + "@" + letters(name, key, "domain") + "." + top


def address(text, key):
    n = 0
    for p in text.split("."):
        n = n * 256 + int(p)
    n = feistel(n, 2**32, key, "ip")
    return ".".join(str(n // 256**k % 256) for k in (3, 2, 1, 0))


def phone(text, key, code=0):
    digits = re.sub("[^0-9]", "", text)
    body = digits[code:]
    return digits_into(text, digits[:code] + str(feistel(int(body), 10 ** len(body), key, f"phone|{len(body)}")).zfill(len(body)))


def social(text, key):
    value = int(text.replace("-", ""))
    while True:
        value = feistel(value, 10**9, key, "ssn")
        area, group, serial = str(value).zfill(9)[:3], str(value).zfill(9)[3:5], str(value).zfill(9)[5:]
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            return f"{area}-{group}-{serial}"


def check_digit(body):
    return next(c for c in "0123456789" if sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(body + c))) % 10 == 0)


def card(text, key):
    digits = text.replace(" ", "")
    body = str(feistel(int(digits[:-1]), 10 ** (len(digits) - 1), key, "card")).zfill(len(digits) - 1)
    return digits_into(text, body + check_digit(body))


def iso_date(text, key):
    first = datetime.date(1900, 1, 1)
    days = (datetime.date(2100, 1, 1) - first).days
    return str(first + datetime.timedelta(days=feistel((datetime.date.fromisoformat(text) - first).days, days, key, "date")))


def test_query_against_planted_values(spark, tmp_path):
    rng, want, rows = random.Random(4), {}, []
    key = llm_queries.PII_KEY
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    names = ("email", "ip", "phone", "card", "ssn", "date", "iban")
    for i in range(120):
        body = digits(15)
        values = {
            "email": (email, f"{rng.choice(['kfs', 'Lena.M', 'x_9'])}{digits(2)}@mail{rng.randrange(9)}.example.com"),
            "ip": (address, ".".join(str(rng.randrange(256)) for _ in range(4))),
            "phone": (phone, f"({digits(3)}) {digits(3)}-{digits(4)}"),
            "card": (card, f"{body[:4]} {body[4:8]} {body[8:12]} {body[12:]}{check_digit(body)}"),
            "ssn": (social, f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"),
            "date": (iso_date, str(datetime.date(1900, 1, 1) + datetime.timedelta(days=rng.randrange(73_000)))),
        }
        chosen = rng.sample(sorted(values), k=rng.randrange(7))
        junk = [rng.choice(["plain words", "1.2.3.999", "2023-02-30", "666-12-3456", "v4.0", "9807915762804491", "é\U0001f600"]) for _ in chosen]
        old = "start " + " ".join(f"{j} <{values[c][1]}>," for j, c in zip(junk, chosen, strict=True))
        new = "start " + " ".join(f"{j} <{values[c][0](values[c][1], key)}>," for j, c in zip(junk, chosen, strict=True))
        rows.append((i, old, None, "s", len(old)))
        want[i] = (new, *[chosen.count(k) for k in names])
    rows += [(500, None, None, None, None), (501, "", None, None, 0), (502, rows[7][1], "en", "s", 1)]
    want |= {500: (None,) + (0,) * 7, 501: ("",) + (0,) * 7, 502: want[7]}
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = llm_queries.op2_pii(spark, str(tmp_path)).select("doc_id", "text", *[f"n_{k}" for k in names]).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == want and len(found) == len(rows)
