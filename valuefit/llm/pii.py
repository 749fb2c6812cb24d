"""Personal data as format-preserving pseudonyms.

Numbers and dates that pass the checks of their kind are permuted, by a keyed Feistel network, within the set of values
of their kind and format: a card number becomes a card number with a right check digit and the same grouping, a date a
date.  Equal values stay equal in all documents, and whoever has the key can undo it (``reverse=True``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, spare

ROUNDS, WALK = 10, 16
#: digits of a card without gaps or in the groups in which cards are printed
LAYOUT = r"(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\d)"
#: kind, pattern, in the order in which they are tried at each place; what may repeat without end never gives back
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    # other groups only as a whole run of digits in which no layout begins later
    "card": rf"(?<!\d)(?:{LAYOUT}|(?<!\d[ -])(?!(?:\d++[ -]){{1,18}}?{LAYOUT})\d(?:[ -]?\d){{12,18}}(?![ -]?\d))",
}
ANY = "|".join(PATTERNS.values())
FIRST_DAY, DAYS, SIDE = "1900-01-01", 73049, 271  # to 2099-12-31; 271 * 271 >= 73049


def _prf(key: str, tweak: Column, i: Column, half: Column) -> Column:
    """60 bits of a keyed hash."""
    text = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(value: Column, left: Column, right: Column, tweak: Column, key: str, reverse: bool) -> Column:
    """A permutation of the numbers from 0 to left * right - 1 that halves of these sizes take turns to define."""
    sign = -1 if reverse else 1
    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if reverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    begin = F.struct(F.floor(value / right).cast("long").alias("l"), (value % right).cast("long").alias("r"))

    def turn(x: Column, i: Column) -> Column:
        l, r = x["l"], x["r"]  # noqa: E741
        new_l = F.pmod(l + F.lit(sign) * (_prf(key, tweak, i, r) % left), left)
        new_r = F.pmod(r + F.lit(sign) * (_prf(key, tweak, i, l) % right), right)
        even = i % 2 == 0
        return F.struct(F.when(even, new_l).otherwise(l).cast("long").alias("l"), F.when(even, r).otherwise(new_r).cast("long").alias("r"))

    return F.aggregate(order, begin, turn, lambda x: x["l"] * right + x["r"])


def walked(value: Column, valid, step) -> Column:
    """Apply a permutation until it falls into the valid values again: a permutation of these."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(value), lambda x, _: F.when(valid(x), x).otherwise(step(x)))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _date(m: Column) -> Column:
    return F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date")


def _ten(n: Column) -> Column:
    """10 to the power n, from 0 to 18, exactly."""
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _permute_digits(digits: Column, kind: str, key: str, reverse: bool) -> Column:
    """Up to 18 digits to as many."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    out = feistel(digits.cast("long"), _ten(half), _ten(n - half), F.concat(F.lit(kind), n.cast("string")), key, reverse)
    return F.lpad(out.cast("string"), n, "0")


def _luhn_sum(digits: Column, shift: int) -> Column:
    """Of digits from the right, those at odd places (plus ``shift``) are doubled."""
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when((i + shift) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _fill(layout: Column, digits: Column) -> Column:
    """The layout with its digits replaced by others, in order."""
    def one(c: Column, i: Column) -> Column:
        before = F.length(_digits(F.substr(layout, F.lit(1), i)))
        return F.when(c.rlike(r"^\d$"), F.substr(digits, before + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(layout, ""), one), "")


def _octets_ok(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda x: (x.cast("int") <= 255) & ((F.length(x) == 1) | ~F.startswith(x, F.lit("0"))))


def _ssn_ok(d: Column) -> Column:
    area = F.substr(d, F.lit(1), F.lit(3))
    return ~area.isin("000", "666") & (area < "900") & (F.substr(d, F.lit(4), F.lit(2)) != "00") & (F.substr(d, F.lit(6), F.lit(4)) != "0000")


def kind_of(m: Column) -> Column:
    """The kind of a match if the checks of the kind hold, else null."""
    d = _digits(m)
    day = F.datediff(_date(m), F.lit(FIRST_DAY).cast("date"))
    ok = {
        "email": F.lit(True), "ip": _octets_ok(m), "date": day.between(0, DAYS - 1), "ssn": _ssn_ok(d),
        "phone": F.length(d).between(10, 13), "card": _luhn_sum(d, 0) % 10 == 0,
    }
    cases = [F.when(m.rlike(f"^(?:{p})$"), F.when(ok[k], F.lit(k)).otherwise(F.lit("")) ) for k, p in PATTERNS.items()]
    return F.nullif(F.coalesce(*cases, F.lit("")), F.lit(""))


def pseudonym(m: Column, kind: Column, key: str, reverse: bool = False) -> Column:
    d = _digits(m)
    parts = F.split(m, r"\.")
    number = reduce(lambda a, b: a * 256 + b, (F.get(parts, i).cast("long") for i in range(4)))
    ip = feistel(number, F.lit(1 << 16).cast("long"), F.lit(1 << 16).cast("long"), F.lit("ip"), key, reverse)
    ip = F.aggregate(F.array(ip), F.lit(""), lambda _, x: F.concat_ws(".", *(F.shiftright(x, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0))))
    start = F.lit(FIRST_DAY).cast("date")
    day = F.datediff(_date(m), start).cast("long")
    side = F.lit(SIDE).cast("long")
    moved = walked(day, lambda x: x < DAYS, lambda x: feistel(x, side, side, F.lit("date"), key, reverse))
    date = F.date_format(F.date_add(start, moved.cast("int")), "yyyy-MM-dd")
    ssn = _fill(m, walked(d, _ssn_ok, lambda x: _permute_digits(x, "ssn", key, reverse)))
    tail = F.substr(d, F.length(d) - 9, F.lit(10))
    phone = _fill(m, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), _permute_digits(tail, "phone", key, reverse)))
    body = _permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), "card", key, reverse)
    card = F.aggregate(F.array(body), F.lit(""), lambda _, b: _fill(m, F.concat(b, F.pmod(F.lit(10) - _luhn_sum(b, 1) % 10, F.lit(10)).cast("string"))))
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    email = F.concat(F.lit("user"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(name), F.lower(host)), 256), 1, 32), F.lit("@"), host)
    cases = {"email": email, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}
    return F.coalesce(*(F.when(kind == k, v) for k, v in cases.items()), m)


def pseudonymise(docs: DataFrame, key: str, reverse: bool = False) -> DataFrame:
    """All columns of ``docs``, its text with pseudonyms, and ``found``: array of (kind, original, pseudonym) in order.

    Kinds: cards (13 to 19 digits, right check digit), phone numbers (10 to 13 digits in usual groups; the last ten are
    permuted), social security numbers (valid area, group and serial), IPv4 addresses, ISO dates from 1900 to 2099,
    and mail addresses, whose local part gets a keyed hash.  What fails the checks of its kind stays.  The pseudonym
    depends on key, kind and value alone, so equal values stay linked.  ``reverse`` undoes all but mail addresses.
    ``key`` is a secret: whoever has it can undo the pseudonyms.  Of kinds that begin at the same place the first of
    ``PATTERNS`` is taken, of matches that overlap the leftmost.

    A null or empty text comes back as it was, with an empty ``found``.  Whole texts of any length are read in time that
    grows with it.  Repeated rows and null ids are rows like any other, an empty table gives an empty result; a column
    named ``found`` is replaced, all others are kept, whatever their names.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    docs = docs.drop("found")
    at, = spare(docs, "matches")
    text = F.col("text")
    # a text without digits and @ can hold nothing
    maybe = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    matches = F.when(maybe, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    named = F.transform(at, lambda x: F.struct(x.alias("original"), kind_of(x).alias("kind")))
    changed = F.transform(at, lambda x: F.struct(x["kind"].alias("kind"), x["original"].alias("original"), pseudonym(x["original"], x["kind"], key, reverse).alias("pseudonym")))
    out = docs.withColumn(at, matches).withColumn(at, named).withColumn(at, changed)
    gaps = F.split("text", ANY)
    # the text is split once a row, not once a match
    rest = F.slice(gaps, F.lit(2), F.size(at))
    joined = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.zip_with(at, rest, lambda x, gap: F.concat(x["pseudonym"], gap)), ""))
    return out.select(
        *(F.when(F.size(at) > 0, joined).otherwise(text).alias(c) if c == "text" else F.col(c) for c in docs.columns),
        F.filter(at, lambda x: x["kind"].isNotNull()).alias("found"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whoever runs this on real documents sets a key of their own
    key = spark.conf.get("spark.valuefit.pseudonymKey", "a key for tables of invented documents")
    found = pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    of_kind = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(of_kind(k) for k in PATTERNS), "text")


QUERIES = {"op9_pii": op9_pii}
