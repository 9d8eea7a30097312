"""Personal data: format-preserving Feistel pseudonyms, in DataFrame functions alone.

Found and validated: dates (of the calendar, 1900 to 2099), card numbers (Luhn), IBANs (mod 97), social security
numbers, IPv4 addresses, phone numbers, e-mail addresses (the local part), and secrets (values of password, token and
the like, access keys). What isn't valid stays as it is.

A value is a vector of digits, letters, octets or parts of a day number, each with its base. A Feistel network whose
round function is keyed with SHA-256 permutes all vectors of one format: its two halves take turns in adding (modulo
each base) a function of the key, the format and the other half. So equal values get equal pseudonyms in all documents,
different values of a format get different ones, and separators, letter case, check digits and the calendar stay right.

Dates with the year last are read day first where they can be. Those that can't be (month first, with a day over 12) are
permuted among themselves, so that no pseudonym is read in the other order.

Null text stays null, empty text empty, an empty table empty; rows that repeat get equal pseudonyms. Texts and values of
any length are taken whole. Other columns, also ones named like inner ones, are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEY, ROUNDS = "edgeloom-pseudonyms-1", 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SECRET = r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_.-]{8,}+"
ACCESS = r"\bAKIA[A-Z0-9]{16}\b"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"
ISO = r"(?<![\w.-])\d{4}([-/.])\d{2}\1\d{2}(?:(?![\w-])|(?=[Tt]\d{2}:?\d{2}))"
DMY = r"(?<![\w.-])\d{1,2}([-/.])\d{1,2}\2\d{4}(?![\w-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
CARD = r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"
PHONE = r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5})(?![\w-])"
#: Digit groups that may hold a card; a card starts and ends at the borders of groups.
RUN = r"(?<![\w-])\d(?:[ -]?\d){12,}+"
START, END = r"(?:(?<![\w-])|(?<=\d-))", r"(?:(?![\w-])|(?=-\d))"
#: As printed on cards: these come before other stretches that cross them.
PRINTED = r"^(?:[2-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{2}([ -]?)\d{6}\2\d{5})$"
#: In this order where several match at one place; a text's cards come between the two parts.
FIRST, LAST = "|".join([SECRET, ACCESS, EMAIL, IBAN, ISO, DMY, SSN, IP]), PHONE
#: Longer secrets and local parts are permuted in blocks, each with its own key.
PIECE = 128
#: Days from 1900-01-01 to 2100-01-01: as many as 150 * 487.
DAY_BASES, FIRST_DAY = (150, 487), "1900-01-01"
#: Month first needs a day over 12, or it would read as day first: dates are permuted again until they have one. Each
#: time two in five haven't; none of the 44 thousand such dates comes near this many times (a test tries all).
AGAIN = 64
#: Areas but for 000, 666 and 900 to 999, groups but for 00, serial numbers but for 0000.
SSN_BASES = (898, 99, 9999)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(values: Column, bases: Column, kind: Column, key: str, rounds: int = ROUNDS) -> Column:
    """Permutes array<int> values; values[i] is below bases[i]. Even and odd places are the two halves."""
    form = F.concat_ws("|", F.lit(key), kind, F.array_join(bases.cast("array<string>"), ","))

    def one(state: Column, r: Column) -> Column:
        turn = F.pmod(r, F.lit(2))
        other = F.filter(state, lambda _, i: F.pmod(i, F.lit(2)) != turn)
        digest = F.sha2(F.concat_ws("|", form, r.cast("string"), F.array_join(other.cast("array<string>"), ",")), 256)
        return let(digest, lambda h: F.transform(F.arrays_zip(state.alias("v"), bases.alias("b")), lambda x, i: F.when(F.pmod(i, F.lit(2)) == turn, F.pmod(x.getField("v").cast("long") + F.pmod(F.xxhash64(h, i), x.getField("b").cast("long")), x.getField("b").cast("long")).cast("int")).otherwise(x.getField("v"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), values, one)


def letters(chars: Column) -> Column:
    """array<int>: place of each character in its alphabet, -1 for other characters."""
    return F.transform(chars, lambda c: (F.instr(F.lit("\x00" + DIGITS + "\x00" * 3 + LOWER + "\x00" * 3 + UPPER), c) - 2).cast("int"))


def permuted(m: Column, kind: str | Column, key: str, skip: Column, last: int = 0) -> Column:
    """m with its ASCII letters and digits permuted, but for the first `skip` characters and the last `last`."""
    alphabet = DIGITS + LOWER + UPPER
    chars = F.filter(F.split(m, ""), lambda c: c != "")

    def body(cs: Column) -> Column:
        place = F.transform(cs, lambda c, i: F.when((i >= skip) & (i < F.size(cs) - last), F.instr(F.lit(alphabet), c) - 1).otherwise(-1).cast("int"))

        def inner(p: Column) -> Column:
            free = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.get(p, i) >= 0)

            def rebuilt(at: Column) -> Column:
                old = F.transform(at, lambda i: F.get(p, i))
                low = F.transform(old, lambda v: F.when(v < 10, 0).when(v < 36, 10).otherwise(36).cast("int"))
                base = F.transform(old, lambda v: F.when(v < 10, 10).otherwise(26).cast("int"))
                new = feistel(F.zip_with(old, low, lambda v, b: v - b), base, kind if isinstance(kind, Column) else F.lit(kind), key)
                full = F.zip_with(new, low, lambda v, b: v + b)
                return let(full, lambda v: F.array_join(F.transform(cs, lambda c, i: F.when(F.get(p, i) >= 0, F.substring(F.lit(alphabet), F.get(v, (F.array_position(at, i) - 1).cast("int")) + 1, F.lit(1))).otherwise(c)), ""))

            return let(free, rebuilt)

        return let(place, inner)

    return let(chars, body)


def digits(m: Column) -> Column:
    return F.transform(F.filter(F.split(m, ""), lambda c: c.rlike("^[0-9]$")), lambda c: c.cast("int"))


def luhn(payload: Column) -> Column:
    """Check digit of digits without it."""
    total = F.aggregate(F.transform(F.reverse(payload), lambda d, i: F.when(F.pmod(i, F.lit(2)) == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)), F.lit(0), lambda a, d: a + d)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("int")


def cards(t: Column) -> Column:
    """array<string>: the Luhn-valid stretches of 13 to 19 digits of each digit run, longest first; where some are as printed, only those and what doesn't cross them."""

    def stretches(run: Column) -> Column:
        return F.concat(*(F.regexp_extract_all(run, F.lit(rf"{START}(?=(\d(?:[ -]?\d){{{n - 1}}}){END})"), F.lit(1)) for n in range(19, 12, -1)))

    def valid(m: Column) -> Column:
        return F.element_at(F.transform(F.array(digits(m)), lambda d: luhn(F.slice(d, 1, F.size(d) - 1)) == F.element_at(d, -1)), 1)

    def chosen(found: Column) -> Column:
        printed = F.filter(found, lambda m: m.rlike(PRINTED))
        crosses = lambda m, p: p.contains(F.substring(m, 1, 4)) | p.contains(F.substring(m, -4, 4)) | m.contains(p)
        return F.concat(printed, F.filter(found, lambda m: ~m.rlike(PRINTED) & ~F.exists(printed, lambda p: crosses(m, p))))

    found = F.filter(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(t, F.lit(RUN), F.lit(0)), stretches))), valid)
    return let(found, chosen)


def pattern(found: Column) -> Column:
    """All kinds, with these cards."""
    return F.when(F.size(found) > 0, F.concat(F.lit(f"{FIRST}|{START}(?:"), F.array_join(found, "|"), F.lit(f"){END}|{LAST}"))).otherwise(F.lit(f"{FIRST}|{LAST}"))


def card(m: Column, key: str) -> Column:
    """Luhn-valid numbers of 13 to 19 digits: all digits but the last are permuted, the last is made right again."""

    def body(d: Column) -> Column:
        payload = F.slice(d, 1, F.size(d) - 1)
        new = feistel(payload, F.transform(payload, lambda _: F.lit(10)), F.lit("card"), key)
        filled = let(new, lambda p: let(F.concat(p, F.array(luhn(p))), lambda q: place_digits(m, q)))
        return F.when(luhn(payload) == F.element_at(d, -1), filled).otherwise(m)

    return let(digits(m), body)


def place_digits(m: Column, new: Column) -> Column:
    """m with its digits replaced in turn."""
    chars = F.filter(F.split(m, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("i"))
    done = F.aggregate(chars, start, lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a.s, F.get(new, a.i).cast("string")).alias("s"), (a.i + 1).alias("i"))).otherwise(F.struct(F.concat(a.s, c).alias("s"), a.i.alias("i"))))
    return done.getField("s")


def ip(m: Column, key: str) -> Column:
    def body(v: Column) -> Column:
        new = feistel(v, F.transform(v, lambda _: F.lit(256)), F.lit("ip"), key)
        return F.when(F.forall(v, lambda x: x < 256), F.array_join(new.cast("array<string>"), ".")).otherwise(m)

    return let(F.split(m, r"\.").cast("array<int>"), body)


def date(m: Column, key: str) -> Column:
    """Year first, or day (else month) first; the order, separators and leading zeros stay."""
    mark = F.regexp_extract(m, r"([-/.])", 1)

    def body(p: Column) -> Column:
        iso = F.length(F.regexp_extract(m, r"^(\d+)", 1)) == 4
        a, b, c = (F.get(p, k) for k in range(3))
        swap = ~iso & (b > 12)  # month first
        year, month, day = F.when(iso, a).otherwise(c), F.when(swap, a).otherwise(b), F.when(iso, c).when(swap, b).otherwise(a)
        leap = (F.pmod(year, F.lit(4)) == 0) & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0))
        length = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
        valid = (year >= 1900) & ((year < 2100) | (year == 2100) & (month == 1) & (day == 1)) & month.between(1, 12) & (day >= 1) & (day <= length)
        number = F.datediff(F.make_date(year, month, day), F.lit(FIRST_DAY).cast("date"))
        bases = F.array(*(F.lit(x) for x in DAY_BASES))

        def dated(v: Column) -> Column:
            return F.date_add(F.lit(FIRST_DAY).cast("date"), F.get(v, 0) * DAY_BASES[1] + F.get(v, 1))

        once = feistel(F.array((number / F.lit(DAY_BASES[1])).cast("int"), F.pmod(number, F.lit(DAY_BASES[1]))), bases, F.lit("date"), key)
        again = lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(AGAIN)), v, lambda x, _: F.when(F.dayofmonth(dated(x)) > 12, x).otherwise(feistel(x, bases, F.lit("date"), key)))
        to = let(let(once, lambda v: F.when(swap, again(v)).otherwise(v)), dated)
        short = F.length(m) < 10  # days and months without leading zeros

        def written(d: Column) -> Column:
            dd, mm = F.dayofmonth(d).cast("string"), F.month(d).cast("string")
            dd, mm = F.when(short, dd).otherwise(F.lpad(dd, 2, "0")), F.when(short, mm).otherwise(F.lpad(mm, 2, "0"))
            yyyy = F.year(d).cast("string")
            return F.when(iso, F.concat(yyyy, mark, mm, mark, dd)).when(swap, F.concat(mm, mark, dd, mark, yyyy)).otherwise(F.concat(dd, mark, mm, mark, yyyy))

        return F.when(valid, let(to, written)).otherwise(m)

    return let(F.split(m, "[-/.]").cast("array<int>"), body)


def mod97(text: Column) -> Column:
    """Of an IBAN's rearranged characters, letters as 10 to 35."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    value = F.transform(chars, lambda c: (F.instr(F.lit(DIGITS + UPPER), c) - 1).cast("int"))
    return F.aggregate(value, F.lit(0), lambda a, v: F.pmod(a * F.when(v < 10, 10).otherwise(100) + v, F.lit(97)).cast("int"))


def iban(m: Column, key: str) -> Column:
    country, rest = F.substring(m, 1, 2), F.substring(m, 5, 40)
    new = permuted(rest, "iban", key, F.lit(0))
    filled = let(new, lambda r: F.concat(country, F.lpad((98 - mod97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0"), r))
    right = (mod97(F.concat(rest, F.substring(m, 1, 4))) == 1) & F.substring(m, 3, 2).cast("int").between(2, 98)
    return F.when(right, filled).otherwise(m)


def in_blocks(value: Column, kind: str, key: str) -> Column:
    """All of a value of any length."""
    blocks = F.regexp_extract_all(value, F.lit(f".{{1,{PIECE}}}"), F.lit(0))
    new = F.transform(blocks, lambda x, i: permuted(x, F.when(i == 0, kind).otherwise(F.concat(F.lit(kind), i.cast("string"))), key, F.lit(0)))
    return F.array_join(new, "")


def secret(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, r"^(\w+(?:-\w+)?\s*[=:]\s*[\"']?)", 1)
    return let(name, lambda start: F.concat(start, in_blocks(F.substring(m, F.length(start) + 1, F.length(m)), "secret", key)))


def ssn(m: Column, key: str) -> Column:
    """Valid numbers are permuted among themselves."""
    area, group, serial = (F.substring(m, i, n).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = ~area.isin(0, 666) & (area < 900) & (group > 0) & (serial > 0)
    new = feistel(F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1), F.array(*(F.lit(x) for x in SSN_BASES)), F.lit("ssn"), key)

    def written(v: Column) -> Column:
        first = F.get(v, 0) + F.when(F.get(v, 0) >= 665, 2).otherwise(1)
        return F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in ((first, 3), (F.get(v, 1) + 1, 2), (F.get(v, 2) + 1, 4))))

    return F.when(valid, let(new, written)).otherwise(m)


def phone(m: Column, key: str) -> Column:
    """8 to 15 digits; the country code stays."""
    n = F.length(F.regexp_replace(m, r"\D", ""))
    code = F.length(F.regexp_extract(m, r"^(\+1|\+\d{2})", 1))
    return F.when(n.between(8, 15), permuted(m, "phone", key, code)).otherwise(m)


KINDS: list[tuple[str, str, Callable[[Column, str], Column]]] = [
    ("secret", SECRET, secret),
    ("access", ACCESS, lambda m, key: permuted(m, "access", key, F.lit(4))),
    ("email", EMAIL, lambda m, key: F.concat(in_blocks(F.substring_index(m, "@", 1), "email", key), F.lit("@"), F.substring_index(m, "@", -1))),
    ("iban", IBAN, iban),
    ("date", ISO + "|" + DMY, date),
    ("ssn", SSN, ssn),
    ("ip", IP, ip),
    ("card", CARD, card),
    ("phone", PHONE, phone),
]


def pseudonym(m: Column, key: str = KEY) -> Column:
    """Of one found value; its kind is the first whose pattern matches all of it."""
    out = None
    for _, pattern, f in KINDS:
        test = m.rlike(f"^(?:{pattern})$")
        out = F.when(test, f(m, key)) if out is None else out.when(test, f(m, key))
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """docs with the text's personal data replaced by pseudonyms, and a last column with the number of values replaced. No shuffle, no Python."""
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    t = F.col(names[at])
    parts = docs.toDF(*names).withColumn("kinds", pattern(cards(t)))
    parts = parts.withColumn("found", F.regexp_extract_all(t, F.col("kinds"), F.lit(0)))
    new = F.transform("found", lambda m: pseudonym(m, key))
    parts = parts.withColumn("new", F.when(F.size("found") > 0, new).otherwise(F.array().cast("array<string>")))
    gaps = F.split(t, F.col("kinds"), -1)
    whole = F.array_join(F.flatten(F.zip_with(gaps, F.concat("new", F.array(F.lit(""))), lambda g, m: F.array(g, m))), "")
    count = F.size(F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x)).cast("long")
    out = parts.select(*(F.when(F.size("found") > 0, whole).otherwise(t).alias(n) if n == names[at] else F.col(n) for n in names), F.coalesce(F.when(t.isNotNull(), count), F.lit(0).cast("long")).alias("replaced"))
    return out.toDF(*docs.columns, "replaced")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return pseudonymise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
