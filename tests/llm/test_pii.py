"""Pseudonyms against a plain Python Feistel network, its inverse, and whole domains."""

import hashlib
import re
from datetime import date, timedelta

import pytest

from framelake.llm import pii

SECRET = "k1"


def prf(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def forward(secret, n, high, low):
    h, l = divmod(n, low)
    for i in range(1, pii.ROUNDS // 2 + 1):
        h = (h + prf(secret, i, "h", l)) % high
        l = (l + prf(secret, i, "l", h)) % low
    return h * low + l


def backward(secret, n, high, low):
    h, l = divmod(n, low)
    for i in range(pii.ROUNDS // 2, 0, -1):
        l = (l - prf(secret, i, "l", h)) % low
        h = (h - prf(secret, i, "h", l)) % high
    return h * low + l


def turn(text, by, secret, i, side, sign):
    out = []
    for j, c in enumerate(text):
        for alphabet in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            if c in alphabet:
                c = alphabet[(alphabet.index(c) + sign * prf(secret, i, side, j, by)) % len(alphabet)]
                break
        out.append(c)
    return "".join(out)


def strings(secret, a, b, sign=1):
    rounds = range(1, pii.ROUNDS // 2 + 1)
    for i in rounds if sign > 0 else reversed(rounds):
        if sign > 0:
            a = turn(a, b, secret, i, "a", 1)
            b = turn(b, a, secret, i, "b", 1)
        else:
            b = turn(b, a, secret, i, "b", -1)
            a = turn(a, b, secret, i, "a", -1)
    return a, b


def refill(x, digits):
    digits = iter(digits)
    return "".join(next(digits) if c.isdigit() else c for c in x)


LATE = [d for d in (date(1800, 1, 1) + timedelta(i) for i in range(146_097)) if d.day > 12]
RANK = {d: i for i, d in enumerate(LATE)}


def day_by_hand(d, step):
    if d.day > 12:
        return LATE[step(f"{SECRET}/date/late", RANK[d], 9, 9833)]
    n = step(f"{SECRET}/date/early", ((d.year - 1800) * 12 + d.month - 1) * 12 + d.day - 1, 240, 240)
    return date(1800 + n // 144, n // 12 % 12 + 1, n % 12 + 1)


def luhn_digit(body):
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(body[::-1]))
    return str(-total % 10)


def by_hand(kind, x, sign=1):
    step = forward if sign > 0 else backward
    digits = re.sub("[^0-9]", "", x)
    if kind == "date":
        y, m, d = map(int, re.split("[-/.]", x))
        return day_by_hand(date(y, m, d), step).strftime(x[4].join(("%Y", "%m", "%d")))
    if kind == "ip":
        n = 0
        for o in x.split("."):
            n = n * 256 + int(o)
        n = step(f"{SECRET}/ip", n, 65536, 65536)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ssn":
        areas = [a for a in range(1, 900) if a != 666]
        n = step(f"{SECRET}/ssn", (areas.index(int(x[:3])) * 99 + int(x[4:6]) - 1) * 9999 + int(x[7:]) - 1, 898 * 99, 9999)
        return f"{areas[n // 9999 // 99]:03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"
    if kind == "card":
        body = digits[1:-1]
        half = len(body) // 2
        new = digits[0] + "".join(strings(f"{SECRET}/card", body[:half], body[half:], sign))
        return refill(x, new + luhn_digit(new))
    if kind == "email":
        local, host = x.split("@")
        name, top = host[: host.rindex(".") + 1], host[host.rindex(".") + 1 :]
        a, b = strings(f"{SECRET}/email", local, name, sign)
        return f"{a}@{b}{top}"
    if re.match(r"\+1|[^+]", x):
        kept, r = digits[:-10], digits[-10:]
        n = step(f"{SECRET}/phone/1", ((int(r[:3]) - 200) * 800 + int(r[3:6]) - 200) * 10_000 + int(r[6:]), 80_000, 80_000)
        return refill(x, f"{kept}{n // 8_000_000 + 200}{n // 10_000 % 800 + 200}{n % 10_000:04d}")
    code = 1 if digits[0] in "17" else 2 if digits[:2] in pii.COUNTRY_CODES else 3
    rest = digits[code:].lstrip("0")
    low = len(rest) // 2
    n = step(f"{SECRET}/phone/other", int(rest) - 10 ** (len(rest) - 1), 9 * 10 ** (len(rest) - 1 - low), 10**low)
    return refill(x, digits[: len(digits) - len(rest)] + str(n + 10 ** (len(rest) - 1)))


VALUES = {
    "date": ["2024-02-29", "1800/01/01", "2199.12.31", "1999-12-12", "1999-12-13", "2000/03/01"],
    "ip": ["10.20.30.40", "0.0.0.0", "255.255.255.255"],
    "ssn": ["078-05-1120", "667-01-0001", "665-99-9999", "001-01-0001", "899-99-9999"],
    "card": ["4111 1111 1111 1111", "4111111111111111", "3782-822463-10005", "5500005555555559", "30569309025904"],
    "email": ["Jo.Do+x@mail.example.com", "a@b.org", "x_1%y@a-b.c.museum"],
    "phone": ["+1 (212) 555-0199", "212-555-0198", "1 999.200.0000", "+15551234567".replace("555123", "555223"), "+44 20 79 46", "+44 (0)20 7946 0958", "+33 6 12 34 56 78", "+49 170 1234567", "+351 912 345 678", "+79161234567"],
}


def pseudonyms(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(rows, SECRET).orderBy("doc_id").collect()]


@pytest.mark.parametrize("kind", pii.KINDS)
def test_values_by_hand_and_back(spark, kind):
    got = pseudonyms(spark, VALUES[kind])
    assert got == [by_hand(kind, x) for x in VALUES[kind]]
    assert [by_hand(kind, x, -1) for x in got] == VALUES[kind]
    counts = pii.pseudonymise(spark.createDataFrame([(i, x) for i, x in enumerate([*VALUES[kind], *got])], "doc_id long, text string"), SECRET)
    assert counts.where(f"n_{kind} = 1").count() == 2 * len(got)


def test_every_day_in_every_notation_keeps_its_own_pseudonym(spark):
    """400 years, five notations: a pseudonym belongs to one day and reads in its original's order."""
    days = [date(1800, 1, 1) + timedelta(i) for i in range(146_097)]
    want = {d: day_by_hand(d, forward) for d in days}
    assert sorted(want.values()) == days and all((d.day > 12) == (w.day > 12) for d, w in want.items())
    formats = {0: "%Y-%m-%d", 1: "%d/%m/%Y", 2: "%m/%d/%Y", 3: "%d.%m.%Y", 4: "%m.%d.%Y"}
    sample = [(k, d) for i, d in enumerate(days) for k in formats if i % 5 == k or i % 40 < 3]
    texts = [d.strftime(formats[k]) for k, d in sample]
    read = {}
    for (k, d), text, new in zip(sample, texts, pseudonyms(spark, texts)):
        # the day that the text means: where both orders can be read, points put the day first, other marks the month
        if d.day <= 12 and k in (1, 4):
            d = date(d.year, d.day, d.month)
        assert new == want[d].strftime(formats[{1: 2, 4: 3}.get(k, k) if d.day <= 12 else k])
        assert read.setdefault(new, d) == d
    assert len(read) > len(days)


def test_parts_of_one_digit(spark):
    texts = ["5/3/2024", "05/03/2024", "3.7.1999", "25/3/2024", "2024-5-3", "5/13/2024"]
    got = pseudonyms(spark, texts)
    day = lambda y, m, d: day_by_hand(date(y, m, d), forward)
    a, b, c, e = day(2024, 5, 3), day(1999, 7, 3), day(2024, 3, 25), day(2024, 5, 13)
    assert got == [f"{a.month}/{a.day}/{a.year}", a.strftime("%m/%d/%Y"), f"{b.day}.{b.month}.{b.year}", f"{c.day}/{c.month}/{c.year}", f"{a.year}-{a.month}-{a.day}", f"{e.month}/{e.day}/{e.year}"]


def test_phones_stay_valid_and_apart(spark):
    numbers = [f"{200 + i % 800} {200 + i * 7 % 800} {i * 37 % 10_000:04d}" for i in range(2000)] + [f"+44 {i + 1000:05d}" for i in range(2000)] + [f"+998 {i + 1000:04d} 12" for i in range(1000)]
    got = pseudonyms(spark, numbers)
    assert len(set(got)) == len(numbers)
    assert all(re.fullmatch("[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}", x) for x in got[:2000])
    assert all(re.fullmatch(r"\+44 0?[1-9][0-9]{3,4}", x) and x[4] == n[4].replace("1", x[4]) for x, n in zip(got[2000:4000], numbers[2000:4000]))
    assert all(re.fullmatch(r"\+998 [1-9][0-9]{3} [0-9]{2}", x) for x in got[4000:])


def test_what_is_not_valid_stays(spark):
    texts = ["123-555-0199", "212 055 0199", "+1 212 555 01", "+44 123", "31/02/2000", "13.13.2000", "1799-12-31", "2200-01-01", "000-12-3456", "4111111111111112", "300.1.1.1", f"{'x' * 60}.{'y' * 9}@a.com", "a@b", "a@b.c1", "+1234567890123456"]
    assert pseudonyms(spark, texts) == texts


def test_addresses_end_where_their_labels_do(spark):
    got = pseudonyms(spark, ["see .a.b@c-d.com-based", "x@y.org.", "to <q@w.net>,"])
    assert re.fullmatch(r"see \.[a-z]\.[a-z]@[a-z]-[a-z]\.com-based", got[0]) and "a.b@c-d" not in got[0]
    assert re.fullmatch(r"[a-z]@[a-z]\.org\.", got[1]) and re.fullmatch(r"to <[a-z]@[a-z]\.net>,", got[2])
