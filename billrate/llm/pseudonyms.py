"""Format-preserving pseudonyms, by native expressions only.

Validated numbers and dates in a text are replaced by another valid value of the same
format: a Feistel network permutes the values of each format under a secret key, so
equal values stay equal in all documents and different ones stay different.

format     valid if                         permuted
card       13 to 19 digits, Luhn            all digits but the first and the check digit
phone      ten digits, see below            area and exchange code together, the last four digits
ssn        area, group and serial in use    the valid triples
ipv4       up to 255, no leading zeros      the 32 bits
date       in the calendar, 1700 to 2099    the 146,097 days of these years

A network works on a pair (a, b) below (ra, rb) and adds, in turn, a keyed hash of one
to the other, modulo its range; format and range are part of the hash.  Separators, the
order of day, month and year, and two-digit parts stay; a one-digit day or month gets as many
digits as it needs.  A date is read as day-month-year if
valid, else month-day-year.  What is not valid stays as it is.

A number with a country code or a bracketed area is a phone by its form.  One without either is
valid if area and exchange code can be in use: 200 or more and not ending in 11.  Numbers with two
such codes, with no such area and with such an area alone are permuted among themselves, so what
is valid stays valid and is the same number in every form.

A null text stays null; empty texts stay empty.  Rows are independent.  Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 12
FORMATS = {
    "ipv4": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})(?!\w|[./-]\d)",
    "phone": r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}"
             r"|\d{3}([.-])\d{3}\1\d{4})(?!\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?!\w|-\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{4}([ -])\d{6}\3\d{5})(?!\d)",
}
PATTERN = "|".join(FORMATS[k] for k in ("ipv4", "date", "phone", "ssn", "card"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _prf(key: str, tweak: Column, turn: Column, value: Column) -> Column:
    said = F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), value.cast("string"), F.lit(key))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, ra: Column, rb: Column, tweak: Column, key: str, back: bool = False) -> Column:
    """Struct (a, b) after the rounds, or before them if ``back``."""
    sign = -1 if back else 1
    turns = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))

    def turn(s, i):
        odd = i % 2 == 1
        x, y = s["a"], s["b"]
        f = _prf(key, tweak, i, F.when(odd, y).otherwise(x)) * sign
        return F.struct(
            F.when(odd, F.pmod(x + F.pmod(f, ra), ra)).otherwise(x).alias("a"),
            F.when(odd, y).otherwise(F.pmod(y + F.pmod(f, rb), rb)).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(turns, start, turn)


def luhn_sum(digits: Column, shift: int = 0) -> Column:
    """Luhn sum; ``shift`` 1 as if one more digit followed."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i + shift) % 2 == 1, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _refill(like: Column, digits: Column) -> Column:
    """``like`` with its digits replaced in order."""
    def char(j):
        c = F.substring(like, j, F.lit(1))
        return F.when(
            c.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(like, F.lit(1), j))), F.lit(1))
        ).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(like)), char), "")


def _with(value: Column, body) -> Column:
    """``body(value)`` with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _zero(n: Column, width: Column) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _card(m: Column, key: str, back: bool) -> Column:
    def one(d):
        n = F.length(d)
        u = F.floor((n - 2) / 2).cast("int")
        v = n - 2 - u
        left, right = F.substring(d, F.lit(2), u), F.substring(d, u + 2, v)
        got = feistel(left, right, _pow10(u), _pow10(v), F.concat(F.lit("card"), n.cast("string")), key, back)
        body = _with(got, lambda s: F.concat(F.substring(d, 1, 1), _zero(s["a"], u), _zero(s["b"], v)))
        full = _with(body, lambda x: F.concat(x, F.pmod(-luhn_sum(x, 1), F.lit(10)).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, _refill(m, full)).otherwise(m)

    return _with(_digits(m), one)


# How many three-digit codes can be in use, and how many cannot.
IN_USE, OUT_OF_USE = 792, 208


def _in_use(code: Column) -> Column:
    return (code >= 200) & (code % 100 != 11)


def _code_place(code: Column) -> Column:
    """Place of a code among those in use, or among the others."""
    other = F.when(code < 200, code).otherwise(F.floor(code / 100) + 198)
    return F.when(_in_use(code), code - 200 - F.floor((code - 112) / 100)).otherwise(other)


def _code_at(place: Column, in_use: Column) -> Column:
    used = 200 + F.floor(place / 99) * 100 + place % 99 + F.when(place % 99 >= 11, 1).otherwise(0)
    other = F.when(place < 200, place).otherwise((place - 198) * 100 + 11)
    return F.when(in_use, used).otherwise(other)


def _phone(m: Column, key: str, back: bool) -> Column:
    def one(d):
        n = F.length(d)
        area, exchange = (F.substring(d, n - k, F.lit(3)).cast("int") for k in (9, 6))
        known, both = _in_use(area), _in_use(area) & _in_use(exchange)
        areas = F.when(known, IN_USE).otherwise(OUT_OF_USE)
        # Any exchange code may stand after an area that is not in use.
        exchanges = F.when(both, IN_USE).when(known, OUT_OF_USE).otherwise(1000)
        place = F.when(known, _code_place(exchange)).otherwise(exchange)
        tweak = F.when(both, "phone").when(known, "phone-exchange").otherwise("phone-area")
        got = feistel(
            _code_place(area) * exchanges + place, F.substring(d, n - 3, F.lit(4)), areas * exchanges, F.lit(10**4), tweak, key, back
        )

        def write(s):
            left, right = F.floor(s["a"] / exchanges), s["a"] % exchanges
            code = F.when(known, _code_at(right, both)).otherwise(right)
            return F.concat(
                F.substring(d, F.lit(1), n - 10), _zero(_code_at(left, known), F.lit(3)), _zero(code, F.lit(3)), _zero(s["b"], F.lit(4))
            )

        return F.when(both | m.rlike("^[+(]"), _refill(m, _with(got, write))).otherwise(m)

    return _with(_digits(m), one)


def _ssn(m: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(k)).cast("int") for k in (1, 2, 3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)  # 898 areas
    got = feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), F.lit("ssn"), key, back)

    def write(s):
        p = F.floor(s["a"] / 99)
        return F.concat_ws("-", _zero(p + F.when(p >= 665, 2).otherwise(1), F.lit(3)), _zero(s["a"] % 99 + 1, F.lit(2)), _zero(s["b"] + 1, F.lit(4)))

    return F.when(valid, _with(got, write)).otherwise(m)


def _ipv4(m: Column, key: str, back: bool) -> Column:
    o = [F.split_part(m, F.lit("."), F.lit(k)).cast("int") for k in (1, 2, 3, 4)]
    # A zero before an octet would be lost, and some readers take it for octal.
    valid = (o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256) & ~m.rlike(r"(?:^|\.)0[0-9]")
    got = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), F.lit("ipv4"), key, back)
    part = lambda x: (F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return F.when(valid, _with(got, lambda s: F.concat_ws(".", *part(s["a"]), *part(s["b"])))).otherwise(m)


def _date(m: Column, key: str, back: bool) -> Column:
    p, sep = F.split(m, "[./-]", -1), F.regexp_extract(m, r"\d([./-])", 1)
    second = F.regexp_extract(m, r"\d[./-]\d+([./-])", 1)
    p1, p2, p3 = p[0], p[1], p[2]
    read = lambda y, mo, d: F.try_to_timestamp(F.concat_ws("-", y, mo, d), F.lit("yyyy-M-d")).cast("date")
    ymd, dmy, mdy = read(p1, p2, p3), read(p3, p2, p1), read(p3, p1, p2)
    order = F.when(F.length(p1) == 4, F.when(ymd.isNotNull(), "ymd")).when(dmy.isNotNull(), "dmy").when(mdy.isNotNull(), "mdy")
    date = F.when(F.length(p1) == 4, ymd).otherwise(F.coalesce(dmy, mdy))
    year = F.year(date)
    valid = date.isNotNull() & (year >= 1700) & (year <= 2099)
    n = F.date_diff(date, F.lit("1700-01-01").cast("date"))
    got = feistel(F.floor(n / 773), n % 773, F.lit(189), F.lit(773), F.lit("date"), key, back)
    new = _with(got, lambda s: F.date_add(F.lit("1700-01-01").cast("date"), (s["a"] * 773 + s["b"]).cast("int")))

    def write(x):
        y, mo, d = F.year(x).cast("string"), F.month(x), F.dayofmonth(x)
        # A part of two digits keeps two; of one digit, as many as it needs.
        w = lambda v, like: F.when(F.length(like) == 2, _zero(v, F.lit(2))).otherwise(v.cast("string"))
        return F.when(order == "ymd", F.concat(y, sep, w(mo, p2), second, w(d, p3))).when(
            order == "dmy", F.concat(w(d, p1), sep, w(mo, p2), second, y)
        ).otherwise(F.concat(w(mo, p1), sep, w(d, p2), second, y))

    return F.when(valid, _with(new, write)).otherwise(m)


def pseudonym(m: Column, key: str, back: bool = False) -> Column:
    """Pseudonym of one matched string; with ``back`` the value behind one."""
    is_a = lambda k: m.rlike(f"^(?:{_plain(k)})$")
    return (
        F.when(is_a("ipv4"), _ipv4(m, key, back)).when(is_a("date"), _date(m, key, back))
        .when(is_a("ssn"), _ssn(m, key, back)).when(is_a("phone"), _phone(m, key, back))
        .otherwise(_card(m, key, back))
    )


def _plain(kind: str) -> str:
    return FORMATS[kind].replace(r"\2", r"\1").replace(r"\3", r"\2") if kind == "card" else FORMATS[kind]


def replace(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and a column ``n_replaced``."""
    names = [c for c in docs.columns if c.lower() != "n_replaced"]
    # Every format has two digits in a row, or one-digit octets around a dot; other texts are passed over.
    matches = F.when(F.col("text").rlike("[0-9]{2}|[0-9][.][0-9]"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    found = docs.select(*names, matches.alias("_pn_found"))
    new = F.transform("_pn_found", lambda m: pseudonym(m, key, back))
    some = found.withColumn("_pn_new", F.when(F.size("_pn_found") > 0, new))
    pieces = F.split("text", PATTERN, -1)
    woven = F.array_join(
        F.transform(pieces, lambda x, i: F.concat(x, F.coalesce(F.get(F.col("_pn_new"), i), F.lit("")))), ""
    )
    text = F.when(F.col("_pn_new").isNull(), F.col("text")).otherwise(woven).alias("text")
    changed = F.size(F.filter(F.zip_with("_pn_found", "_pn_new", lambda x, y: x != y), lambda c: c))
    return some.select(
        *[text if c == "text" else F.col(c) for c in names],
        F.coalesce(F.when(F.col("_pn_new").isNotNull(), changed), F.lit(0)).cast("long").alias("n_replaced"),
    )
