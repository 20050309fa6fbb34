"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Candidates are found by one regular expression and validated: card numbers by their
check digit, addresses by their octets, dates by the calendar (1800 to 2199), social
security numbers by their ranges, phone numbers by country code, length and, under
code 1, area and exchange codes of 200 to 999, e-mail addresses by their labels
and the length of the name.
What is valid is permuted by a keyed Feistel network within its format: a card stays
a number of the same length, spacing and first digit with a valid check digit, a date
a date, an address an address, and every pseudonym is again valid.  Each permutation
is one to one on values, so equal values stay equal in every document and different
ones different.  Everything is an expression over one row: no shuffle, no state, no
hot key.

Dates: the days up to the 12th of a month are permuted among themselves, and so are
the later ones.  Whether a text such as 25/03/1972 can be read in one order only
depends on that alone, so a pseudonym reads in its original's order and one day has
one pseudonym in every notation.  Where both orders can be read, points mean that the
day comes first and other marks that the month does.  Parts written with one digit
stay without a leading zero.  Names of months and years of two digits are not read.
Phones: the country code, and zeros after it, stay; numbers without a plus sign are
read as those of code 1.

Cases: a null text stays null and an empty one empty; candidates that fail
validation are left as they are; very long texts are handled whole; repeated rows
give repeated results; other columns are kept as they are, except that count
columns of the same name are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "date", "ip", "card", "ssn", "phone")
_FREE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_ATOM, _LABEL = "[A-Za-z0-9_%+-]", "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
PATTERNS = {
    "email": rf"(?<!{_ATOM}){_ATOM}{{1,64}}+(?:\.{_ATOM}{{1,64}}+){{0,16}}+@(?:{_LABEL}\.){{1,8}}[A-Za-z]{{2,63}}(?![A-Za-z0-9])",
    "date": rf"{_FREE}(?:" + "|".join(rf"[0-9]{{4}}{s}[0-9]{{1,2}}{s}[0-9]{{1,2}}|[0-9]{{1,2}}{s}[0-9]{{1,2}}{s}[0-9]{{4}}" for s in ("-", "/", "[.]")) + f"){_END}",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "card": rf"{_FREE}(?:[0-9]{{13,19}}|[0-9]{{4}}(?: [0-9]{{4}}){{3}}|[0-9]{{4}}(?:-[0-9]{{4}}){{3}}|[0-9]{{4}} [0-9]{{6}} [0-9]{{5}}|[0-9]{{4}}-[0-9]{{6}}-[0-9]{{5}}){_END}",
    "ssn": rf"{_FREE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}",
    "phone": r"(?<![0-9A-Za-z+(])(?:(?:1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[1-9](?:[ .-]?\(?[0-9]\)?){6,14})(?![0-9A-Za-z])",
}
PATTERN = "|".join(PATTERNS[k] for k in KINDS)
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: The Gregorian cycle of 400 years from 1800-01-01 has 4,800 months, 57,600 = 240 * 240
#: days up to the 12th of their month and 88,497 = 9 * 9,833 later ones.
_FIRST_YEAR, _FIRST_DAY, _LAST_DAY, _MONTHS, _EARLY = 1800, "1800-01-01", "2199-12-31", 4800, 12
_EARLY_RADIX, _LATE_HIGH, _LATE_LOW = 240, 9, 9833
#: Country codes of two digits (fixed values of the ITU); 1 and 7 stand alone, all others have three.
COUNTRY_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Least digits of a national number without its leading zeros.
_NATIONAL = 4


def _prf(secret: str, *parts: Column) -> Column:
    """A keyed pseudo-random number below 2 ** 48."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(secret), *(p.cast("string") for p in parts)), 256), 1, 12), 16, 10).cast("long")


def _feistel_numbers(secret: str, number: Column, radix_high: int | Column, radix_low: int | Column) -> Column:
    """A permutation of the numbers below the product of the radices."""
    high, low = (r.cast("long") if isinstance(r, Column) else F.lit(r).cast("long") for r in (radix_high, radix_low))

    def step(s: Column, i: Column) -> Column:
        h = F.pmod(s["h"] + _prf(secret, i, F.lit("h"), s["l"]), high)
        return F.transform(F.array(h), lambda x: F.struct(x.alias("h"), F.pmod(s["l"] + _prf(secret, i, F.lit("l"), x), low).alias("l")))[0]

    start = _let(number.cast("long"), lambda n: F.struct(((n - F.pmod(n, low)) / low).cast("long").alias("h"), F.pmod(n, low).alias("l")))
    return _let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step), lambda s: s["h"] * low + s["l"])


def _turn(c: Column, by: Column) -> Column:
    """A letter or digit turned within its alphabet; anything else unchanged."""

    def within(alphabet: str) -> Column:
        return F.substring(F.lit(alphabet), (F.pmod(F.instr(F.lit(alphabet), c) - 1 + by, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))

    return F.when(c.rlike("^[0-9]$"), within(_DIGITS)).when(c.rlike("^[a-z]$"), within(_LOWER)).when(c.rlike("^[A-Z]$"), within(_UPPER)).otherwise(c)


def _feistel_strings(secret: str, a: Column, b: Column) -> Column:
    """struct(a, b): a permutation of pairs of strings that keeps every character's kind."""

    def turned(s: Column, by: Column, i: Column, side: str) -> Column:
        return F.array_join(F.transform(F.split(s, ""), lambda c, j: _turn(c, _prf(secret, i, F.lit(side), j, by))), "")

    def step(s: Column, i: Column) -> Column:
        new = turned(s["a"], s["b"], i, "a")
        return F.transform(F.array(new), lambda x: F.struct(x.alias("a"), turned(s["b"], x, i, "b").alias("b")))[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), F.struct(a.alias("a"), b.alias("b")), step)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _refill(x: Column, digits: Column) -> Column:
    """x with its digits replaced in order."""
    start = F.struct(F.lit("").alias("out"), digits.alias("rest"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(s["rest"], 1, 1)).otherwise(c)).alias("out"), F.when(digit, F.substring(s["rest"], F.lit(2), F.length(s["rest"]))).otherwise(s["rest"]).alias("rest"))

    return F.aggregate(F.split(x, ""), start, step)["out"]


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled."""
    back = F.reverse(digits)

    def worth(acc: Column, i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int")
        table = F.when(i % 2 == 1, F.lit("0246813579")).otherwise(F.lit(_DIGITS))
        return acc + F.substring(table, d + 1, F.lit(1)).cast("int")

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), worth)


def _halves(secret: str, digits: Column) -> Column:
    half = (F.length(digits) / 2).cast("int")
    return _let(_feistel_strings(secret, F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, F.length(digits))), lambda s: F.concat(s["a"], s["b"]))


def _card(secret: str, x: Column) -> Column:
    def body(d: Column) -> Column:
        middle = _let(_halves(secret, F.substring(d, F.lit(2), F.length(d) - 2)), lambda m: F.concat(F.substring(d, 1, 1), m))
        return _let(middle, lambda p: F.concat(p, F.pmod(10 - _luhn(F.concat(p, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    return _refill(x, _let(_digits(x), body))


def _power(n: Column) -> Column:
    """10 ** n, n from 0 to 15."""
    return F.get(F.array(*(F.lit(10**i).cast("long") for i in range(16))), n)


def _code_digits(x: Column, digits: Column) -> Column:
    """How many of a phone number's digits are its country code and the zeros after it."""
    code = F.when(digits.rlike("^[17]"), 1).when(F.substring(digits, 1, 2).isin(*COUNTRY_CODES), 2).otherwise(3)
    abroad = _let(code, lambda n: n + F.length(F.regexp_extract(F.substring(digits, n + 1, F.lit(15)), "^0*", 0)))
    return F.when(_american(x), F.length(digits) - 10).otherwise(abroad)


def _american(x: Column) -> Column:
    return x.rlike(r"^(?:\+1|[^+])")


def _phone(secret: str, x: Column) -> Column:
    def american(rest: Column) -> Column:
        first = lambda at: F.substring(rest, at, 3).cast("long") - 200
        number = _feistel_numbers(f"{secret}/1", (first(1) * 800 + first(4)) * 10_000 + F.substring(rest, 7, 4).cast("long"), 80_000, 80_000)
        area = lambda n: F.pmod(n, F.lit(800)) + 200
        whole = lambda n, by: ((n - F.pmod(n, F.lit(by))) / by).cast("long")
        return _let(number, lambda n: F.concat(area(whole(n, 8_000_000)).cast("string"), area(whole(n, 10_000)).cast("string"), F.lpad(F.pmod(n, F.lit(10_000)).cast("string"), 4, "0")))

    def abroad(rest: Column) -> Column:
        n, low = F.length(rest), (F.length(rest) / 2).cast("int")
        number = _feistel_numbers(f"{secret}/other", rest.cast("long") - _power(n - 1), 9 * _power(n - 1 - low), _power(low))
        return (number + _power(n - 1)).cast("string")

    def body(d: Column) -> Column:
        def split(kept: Column) -> Column:
            rest = F.substring(d, kept + 1, F.lit(15))
            return F.concat(F.substring(d, F.lit(1), kept), _let(rest, lambda r: F.when(_american(x), american(r)).otherwise(abroad(r))))

        return _let(_code_digits(x, d), split)

    return _refill(x, _let(_digits(x), body))


def _valid_phone(x: Column) -> Column:
    def body(d: Column) -> Column:
        here = d.rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$")
        return F.when(_american(x), here).otherwise(F.length(d).between(7, 15) & (F.length(d) - _code_digits(x, d) >= _NATIONAL))

    return _let(_digits(x), body)


def _octet(x: Column, i: int) -> Column:
    return F.split_part(x, F.lit("."), F.lit(i)).cast("int")


def _ip(secret: str, x: Column) -> Column:
    number = F.lit(0).cast("long")
    for i in range(1, 5):
        number = number * 256 + _octet(x, i)
    return _let(_feistel_numbers(secret, number, 65536, 65536), lambda n: F.concat_ws(".", *((F.shiftright(n, shift) % 256).cast("string") for shift in (24, 16, 8, 0))))


def _area(x: Column) -> Column:
    return F.substring(x, 1, 3).cast("int")


def _ssn(secret: str, x: Column) -> Column:
    """Areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999."""
    area = _area(x) - F.when(_area(x) > 666, 2).otherwise(1)
    number = _feistel_numbers(secret, (area * 99 + F.substring(x, 5, 2).cast("int") - 1) * 9999 + F.substring(x, 8, 4).cast("int") - 1, 898 * 99, 9999)

    def shown(n: Column) -> Column:
        group = ((n - n % 9999) / 9999).cast("int")
        index = ((group - group % 99) / 99).cast("int")
        return F.format_string("%03d-%02d-%04d", index + F.when(index >= 665, 2).otherwise(1), group % 99 + 1, (n % 9999 + 1).cast("int"))

    return _let(number, shown)


def _parts(x: Column) -> Column:
    """struct(day, order): the date of a text, or null, and the order of its parts."""

    def read(given: Column, order: str) -> Column:
        day = F.concat_ws("-", *(given[order.index(c)] for c in "ymd")).try_cast("date")
        return F.when(day.isNotNull(), F.struct(day.alias("day"), F.lit(order).alias("order")))

    def body(given: Column) -> Column:
        first, second = read(given, "dmy"), read(given, "mdy")
        pointed = F.when(F.contains(x, F.lit(".")), F.coalesce(first, second)).otherwise(F.coalesce(second, first))
        return F.when(F.length(given[0]) == 4, read(given, "ymd")).otherwise(pointed)

    return _let(F.split(x, "[-/.]"), body)


def _as_date(x: Column) -> Column:
    return _parts(x)["day"]


def _months(day: Column) -> Column:
    return ((F.year(day) - _FIRST_YEAR) * 12 + F.month(day) - 1).cast("long")


def _late_before(month: Column) -> Column:
    """How many days later than the 12th of their month come before a month."""
    return F.datediff(F.add_months(F.lit(_FIRST_DAY).cast("date"), month.cast("int")), F.lit(_FIRST_DAY).cast("date")) - _EARLY * month


def _early_day(secret: str, day: Column) -> Column:
    """struct(m, d): the month since the first one and the day, for days up to the 12th."""
    number = _feistel_numbers(f"{secret}/early", _months(day) * _EARLY + F.dayofmonth(day) - 1, _EARLY_RADIX, _EARLY_RADIX)
    return _let(number, lambda n: F.struct(((n - n % _EARLY) / _EARLY).cast("long").alias("m"), (n % _EARLY + 1).alias("d")))


def _late_day(secret: str, day: Column) -> Column:
    """The same for later days, counted without the early ones; a month has 18.4 of them, give or take less than two."""
    number = _feistel_numbers(f"{secret}/late", _late_before(_months(day)) + F.dayofmonth(day) - _EARLY - 1, _LATE_HIGH, _LATE_LOW)

    def placed(n: Column) -> Column:
        near = F.floor(n * _MONTHS / (_LATE_HIGH * _LATE_LOW))
        month = _let(near, lambda m: m - 1 + (_late_before(m) <= n).cast("long") + (_late_before(m + 1) <= n).cast("long"))
        return _let(month, lambda m: F.struct(m.alias("m"), (n - _late_before(m) + _EARLY + 1).alias("d")))

    return _let(number, placed)


def _date(secret: str, x: Column) -> Column:
    """Order, separators and parts of one digit stay."""

    def shown(p: Column, new: Column) -> Column:
        values = {"y": (new["m"] - new["m"] % 12) / 12 + _FIRST_YEAR, "m": new["m"] % 12 + 1, "d": new["d"]}
        given = F.split(x, "[-/.]")

        def written(order: str) -> Column:
            parts = (F.format_string("%d", values[c].cast("long")) for c in order)
            return F.array(*(F.lpad(text, 2, "0") if c != "y" else text for c, text in zip(order, parts)))

        filled = F.coalesce(*(F.when(p["order"] == name, written(name)) for name in ("ymd", "dmy", "mdy")))
        fitted = F.zip_with(filled, given, lambda new, old: F.when(F.length(old) == 1, F.regexp_replace(new, "^0", "")).otherwise(new))
        return F.replace(F.array_join(fitted, "|"), F.lit("|"), F.regexp_extract(x, "[^0-9]", 0))

    def permuted(p: Column) -> Column:
        new = F.when(F.dayofmonth(p["day"]) <= _EARLY, _early_day(secret, p["day"])).otherwise(_late_day(secret, p["day"]))
        return _let(new, lambda n: shown(p, n))

    return _let(_parts(x), permuted)


def _email(secret: str, x: Column) -> Column:
    local, host = F.split_part(x, F.lit("@"), F.lit(1)), F.split_part(x, F.lit("@"), F.lit(2))
    top = F.substring_index(host, ".", -1)
    name = F.substring(host, F.lit(1), F.length(host) - F.length(top))
    return _let(_feistel_strings(secret, local, name), lambda s: F.concat(s["a"], F.lit("@"), s["b"], top))


def _valid(kind: str, x: Column) -> Column:
    if kind == "card":
        return _let(_digits(x), lambda d: F.substring(d, 1, 1).isin(*"23456") & (_luhn(d) % 10 == 0))
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda o: o.cast("int") <= 255)
    if kind == "date":
        return _let(_as_date(x), lambda day: day.between(F.lit(_FIRST_DAY).cast("date"), F.lit(_LAST_DAY).cast("date")))
    if kind == "ssn":
        return _area(x).between(1, 899) & (_area(x) != 666) & (F.substring(x, 5, 2) != "00") & (F.substring(x, 8, 4) != "0000")
    if kind == "phone":
        return _valid_phone(x)
    return F.length(F.split_part(x, F.lit("@"), F.lit(1))) <= 64


_PERMUTE = {"email": _email, "date": _date, "ip": _ip, "card": _card, "ssn": _ssn, "phone": _phone}


def kind_of(x: Column) -> Column:
    """The kind of a candidate, or null where it is not valid."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        whole = "^(?:" + PATTERNS[kind] + ")$"
        out = F.when(x.rlike(whole), F.when(F.coalesce(_valid(kind, x), F.lit(False)), F.lit(kind))).otherwise(out)
    return out


def pseudonym(x: Column, kind: Column, secret: str) -> Column:
    """The pseudonym of a candidate of that kind; a null kind leaves it."""
    out = x
    for name, permute in _PERMUTE.items():
        out = F.when(kind == name, permute(f"{secret}/{name}", x)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """docs with the text's personal data replaced, and counts n_<kind> long of what was."""
    column = F.col("_text")
    none = F.array().cast("array<string>")
    hits = F.when(column.rlike("[0-9@]"), F.regexp_extract_all(column, F.lit(PATTERN), F.lit(0))).otherwise(none)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), docs[text].alias("_text"))
    found = rows.withColumn("_hits", F.transform(F.coalesce(hits, none), lambda x: F.struct(x.alias("x"), kind_of(x).alias("kind"))))
    new = F.transform("_hits", lambda h: pseudonym(h["x"], h["kind"], secret))
    between = F.split(column, PATTERN, -1)
    merged = F.array_join(F.flatten(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")

    def count(kind: str) -> Column:
        return F.size(F.filter("_hits", lambda h: h["kind"] == kind)).cast("long")

    counts = {f"n_{kind}": count(kind) for kind in KINDS}
    changed = F.exists("_hits", lambda h: h["kind"].isNotNull())
    kept = [F.when(changed, merged).otherwise(column).alias(text) if c == text else F.col("_row")[c].alias(c) for c in docs.columns if c not in counts]
    return found.select(*kept, *(c.alias(name) for name, c in counts.items()))
