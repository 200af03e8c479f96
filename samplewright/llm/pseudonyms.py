"""Format-preserving pseudonyms for personal numbers, dates and addresses [DataFrame operations only].

Values are found by pattern, validated, and permuted by a keyed Feistel network
within the set of valid values of their format, so a value always has the same
pseudonym, in any document and in any notation, and no two values share one:
- card numbers (13 to 19 digits, Luhn): all digits but the last are permuted, the
  last is recomputed; separators stay;
- phone numbers: all digits but those of the country code (by the code table of
  ITU E.164, so +14155552671 and +1 415 555 2671 are one number; without a + there is
  no code); separators stay;
- social security numbers (area, group and serial in range): within that range;
- IPv4 addresses: 32 bits;
- dates (year-month-day, day.month.year, month/day/year, or day/month/year where the
  first number is over 12): one of the 146097 days of the years 1800 to 2199, in the
  same notation, padded with zeros unless the value was not;
- mail addresses: the letters and digits of the local part, by kind; upper and lower
  case have the same pseudonym in their own case.
A value that one kind's validation turns down is tried as each later kind whose
pattern it fits as a whole. The rounds' functions are SHA-256 over the key, so the
permutation cannot be inverted without it; the key has no default. `restore=True`
inverts it (a day/month date whose pseudonym's day is 12 or less reads as
month/day and is not restored; a date's zeros may differ).

Texts are matched once: each found value is put between two marks (a code point that
is no character; texts that hold it take a slower way) and the text is split there.

Cases: null and empty texts stay as they are; values that fail validation stay;
texts of any length are read whole; repeated rows give repeated rows; an empty
table gives no rows; other columns, with any names, are ignored by `pseudonymise`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
MAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d]|[./-]\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?: \d{4}){2,3}(?: \d{1,3})?|\d{4}(?:-\d{4}){2,3}(?:-\d{1,3})?|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?!\d)"
PHONE = r"(?<![\d(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\d]|[.-]\d)|(?<![\d])\+\d{8,15}(?!\d)"
#: Other values than mail addresses start with one of these, so most places of a text fail at once.
NUMBER = r"(?=[+(0-9])(?:" + "|".join((IP, DATE, SSN, CARD, PHONE)) + ")"
ANY = f"{MAIL}|{NUMBER}"
# Country codes of one and two digits; all others have three.
CODE = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
MARK = "\ufdd0"
DAYS, EPOCH = 146097, "1800-01-01"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's argument is not computed again at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digest(key: str, tag: Column | str, i: Column, value: Column) -> Column:
    """A number below 2^60 from the key, a round and a value."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tag, i.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(value: Column, left: Column, right: Column, key: str, tag: Column | str, restore: bool = False) -> Column:
    """A keyed permutation of 0 .. left * right - 1 (left and right below 2^31): alternating modular rounds."""
    start = F.struct(F.floor(value / right).cast("long").alias("a"), F.pmod(value, right).cast("long").alias("b"))
    sign = -1 if restore else 1
    order = F.sequence(F.lit(ROUNDS), F.lit(1)) if restore else F.sequence(F.lit(1), F.lit(ROUNDS))

    def one(acc, i):
        a = F.when(i % 2 == 1, F.pmod(acc["a"] + sign * F.pmod(_digest(key, tag, i, acc["b"]), left), left)).otherwise(acc["a"])
        b = F.when(i % 2 == 0, F.pmod(acc["b"] + sign * F.pmod(_digest(key, tag, i, acc["a"]), right), right)).otherwise(acc["b"])
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    return F.aggregate(order, start, one, lambda acc: acc["a"] * right + acc["b"])


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("long")


def _permute_digits(value: Column, key: str, tag: str, restore: bool) -> Column:
    """Permutes a string of 2 to 18 digits among those of its length."""
    return _let(value, lambda digits: _permuted(digits, key, tag, restore))


def _permuted(digits: Column, key: str, tag: str, restore: bool) -> Column:
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    left, right = _power(half), _power(n - half)
    split = F.struct(F.substring(digits, F.lit(1), half).cast("long").alias("a"), F.substring(digits, half + 1, n).cast("long").alias("b"))
    sign, order = (-1, F.sequence(F.lit(ROUNDS), F.lit(1))) if restore else (1, F.sequence(F.lit(1), F.lit(ROUNDS)))
    label = F.concat(F.lit(tag), n.cast("string"))

    def one(acc, i):
        a = F.when(i % 2 == 1, F.pmod(acc["a"] + sign * F.pmod(_digest(key, label, i, acc["b"]), left), left)).otherwise(acc["a"])
        b = F.when(i % 2 == 0, F.pmod(acc["b"] + sign * F.pmod(_digest(key, label, i, acc["a"]), right), right)).otherwise(acc["b"])
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    return F.aggregate(order, split, one, lambda acc: F.concat(F.lpad(acc["a"].cast("string"), half, F.lit("0")), F.lpad(acc["b"].cast("string"), n - half, F.lit("0"))))


def _luhn(value: Column) -> Column:
    """Luhn sum of the digits, the last one being the check digit."""

    def total(digits):
        n = F.length(digits)

        def add(acc, i):
            d = F.substring(digits, n - i, F.lit(1)).cast("int")
            return acc + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)

    return _let(value, total)


def _refill(shape: Column, value: Column) -> Column:
    """Writes digits over the digits of a notation, left to right."""
    return _let(value, lambda digits: _refilled(shape, digits))


def _refilled(shape: Column, digits: Column) -> Column:
    chars = F.split(shape, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def one(acc, c):
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["k"], F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + F.when(is_digit, 1).otherwise(0)).alias("k"))

    return F.aggregate(chars, start, one, lambda acc: acc["out"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _card(x: Column, key: str, restore: bool) -> tuple[Column, Column]:
    d = _digits(x)
    body = F.substring(d, F.lit(1), F.length(d) - 1)
    ok = F.length(d).between(13, 19) & (_luhn(d) % 10 == 0)
    check = lambda fresh: F.pmod(10 - _luhn(F.concat(fresh, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return ok, _refill(x, _let(_permute_digits(body, key, "card", restore), lambda fresh: F.concat(fresh, check(fresh))))


def _phone(x: Column, key: str, restore: bool) -> tuple[Column, Column]:
    code = F.regexp_extract(x, CODE, 0)
    rest = F.substring(x, F.length(code) + 1, F.length(x))
    ok = F.length(_digits(rest)).between(6, 15) & F.length(_digits(x)).between(7, 15)
    return ok, F.concat(code, _let(rest, lambda x: _refill(x, _permute_digits(_digits(x), key, "phone", restore))))


def _ssn(x: Column, key: str, restore: bool) -> tuple[Column, Column]:
    area, group, serial = (F.substring(x, i, n).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas
    value = (index * 99 + group - 1).cast("long") * 9999 + serial - 1
    pad = lambda c, n: F.lpad(c.cast("long").cast("string"), n, "0")

    def written(fresh):
        high = F.floor(fresh / 9999)
        area = F.floor(high / 99)
        return F.concat_ws("-", pad(F.when(area >= 665, area + 2).otherwise(area + 1), 3), pad(high % 99 + 1, 2), pad(fresh % 9999 + 1, 4))

    return ok, _let(feistel(value, F.lit(898 * 99), F.lit(9999), key, "ssn", restore), written)


def _ip(x: Column, key: str, restore: bool) -> tuple[Column, Column]:
    parts = F.split(x, r"\.")
    ok = F.forall(parts, lambda p: p.cast("int") <= 255)
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p.cast("long"))
    octet = lambda fresh, k: F.pmod(F.floor(fresh / k), F.lit(256)).cast("string")
    written = lambda fresh: F.concat_ws(".", *[octet(fresh, 256**i) for i in (3, 2, 1, 0)])
    return ok, _let(feistel(value, F.lit(65536), F.lit(65536), key, "ip", restore), written)


def _date(x: Column, key: str, restore: bool) -> tuple[Column, Column]:
    iso, slash = x.contains("-"), x.contains("/")
    p = F.split(x, "[./-]")
    at = lambda i: F.element_at(p, i)
    american = slash & (at(1).cast("int") <= 12)
    year = F.when(iso, at(1)).otherwise(at(3))
    month = F.when(american, at(1)).otherwise(at(2))
    day = F.when(iso, at(3)).when(american, at(2)).otherwise(at(1))
    date = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    value = F.datediff(date, F.lit(EPOCH).cast("date"))
    ok = date.isNotNull() & value.between(0, DAYS - 1)
    fresh = F.date_add(F.lit(EPOCH).cast("date"), feistel(value.cast("long"), F.lit(189), F.lit(773), key, "date", restore).cast("int"))
    short = (F.length(month) < 2) | (F.length(day) < 2)
    shapes = ((iso, "yyyy-MM-dd"), (american & short, "M/d/yyyy"), (american, "MM/dd/yyyy"), (slash & short, "d/M/yyyy"), (slash, "dd/MM/yyyy"), (short, "d.M.yyyy"))
    out = F.date_format(fresh, "dd.MM.yyyy")
    for fits, shape in reversed(shapes):
        out = F.when(fits, F.date_format(fresh, shape)).otherwise(out)
    return ok, out


def _mail(x: Column, key: str, restore: bool) -> tuple[Column, Column]:
    """Letters and digits of the local part, each shifted by a keyed amount; the halves in turn depend on each other, whatever their case."""
    local, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    n = F.length(local)
    half = F.ceil(n / 2).cast("int")
    start = F.struct(F.substring(local, F.lit(1), half).alias("a"), F.substring(local, half + 1, n).alias("b"))
    sign, order = (-1, F.sequence(F.lit(ROUNDS), F.lit(1))) if restore else (1, F.sequence(F.lit(1), F.lit(ROUNDS)))

    def shift(part, other, i):
        def char(c, k):
            by = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), i.cast("string"), k.cast("string"), n.cast("string"), F.lower(other), F.lower(domain)), 256), 1, 8), 16, 10).cast("long")
            turn = lambda first, size: F.char(F.pmod(F.ascii(c) - ord(first) + sign * F.pmod(by, F.lit(size)), F.lit(size)) + ord(first))
            return F.when(c.rlike("^[a-z]$"), turn("a", 26)).when(c.rlike("^[A-Z]$"), turn("A", 26)).when(c.rlike("^[0-9]$"), turn("0", 10)).otherwise(c)

        return F.when(F.length(part) > 0, F.array_join(F.transform(F.split(part, ""), char), "")).otherwise(part)

    def one(acc, i):
        return F.struct(
            F.when(i % 2 == 1, shift(acc["a"], acc["b"], i)).otherwise(acc["a"]).alias("a"), F.when(i % 2 == 0, shift(acc["b"], acc["a"], i)).otherwise(acc["b"]).alias("b")
        )

    return F.lit(True), F.concat(F.aggregate(order, start, one, lambda acc: F.concat(acc["a"], acc["b"])), F.lit("@"), domain)


KINDS = (("mail", MAIL, _mail), ("ip", IP, _ip), ("date", DATE, _date), ("ssn", SSN, _ssn), ("card", CARD, _card), ("phone", PHONE, _phone))


def pseudonym(value: Column, key: str, restore: bool = False) -> Column:
    """struct(kind, was, now) of a found value: of the first kind it fits and is valid for; kind is null if there is none, and the value stays."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), value.alias("was"), value.alias("now"))
    for kind, pattern, make in reversed(KINDS):
        ok, fresh = make(value, key, restore)
        fits = F.when(value.rlike(f"^(?:{pattern})$"), F.coalesce(ok, F.lit(False))).otherwise(False)
        out = F.when(fits, F.struct(F.lit(kind).alias("kind"), value.alias("was"), fresh.alias("now"))).otherwise(out)
    return out


def _is(kind: str):
    return lambda x: x["kind"] == kind


def _pieces(text: Column) -> Column:
    """The text cut at the values found: every second piece, from the second one on, is a value."""
    marked = lambda pattern: F.split(F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(f"{MARK}$1{MARK}")), MARK, -1)
    values = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    slow = F.flatten(F.transform(F.split(text, ANY, -1), lambda gap, i: F.when(i < F.size(values), F.array(gap, F.get(values, i))).otherwise(F.array(gap))))
    return F.when(text.contains(MARK), slow).when(text.contains("@"), marked(ANY)).when(text.rlike("[0-9]"), marked(NUMBER)).otherwise(F.array(text))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", doc_id: str = "doc_id", restore: bool = False) -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, n_replaced, and `n_<kind>`: the count of each kind found.

    Each value's replacement is in `replaced`, an array of (kind, was, now) in text order.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("was")).withColumn("pieces", _pieces(F.col("was")))
    stays = lambda x: F.struct(F.lit(None).cast("string").alias("kind"), x.alias("was"), x.alias("now"))
    found = F.when(F.size("pieces") > 1, F.transform("pieces", lambda x, i: F.when(i % 2 == 1, pseudonym(x, key, restore)).otherwise(stays(x))))
    rows = rows.withColumn("found", found).withColumn("text", F.when(F.col("found").isNotNull(), F.array_join(F.transform("found", lambda x: x["now"]), "")).otherwise(F.col("was")))
    none = F.array().cast("array<struct<kind:string,was:string,now:string>>")
    rows = rows.withColumn("replaced", F.coalesce(F.filter("found", lambda x: x["kind"].isNotNull()), none))
    return rows.select("doc_id", "text", F.size("replaced").alias("n_replaced"), *[F.size(F.filter("replaced", _is(k))).alias(f"n_{k}") for k, _, _ in KINDS], "replaced")
