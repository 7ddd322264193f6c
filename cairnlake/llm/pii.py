"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

One pattern finds e-mail addresses, ISO dates, social security numbers, phone
numbers, IPv4 addresses and card numbers. A find that passes its kind's check
(octets to 255, a calendar date, the Luhn digit ...) is replaced by a keyed
permutation of itself within its format, so equal values stay equal in all
documents, different ones stay different, and the result passes the same check:

- card: a permutation of all digits but the last, which is the Luhn digit anew;
- phone: of the last ten digits; country code and punctuation stay;
- IPv4: of 32-bit numbers; ssn: of the valid area-group-serial triples;
- date: of the 146,097 days from 1800 to 2199, a full cycle of the calendar;
- e-mail: of the local part, letters to letters and digits to digits.

What fails its check stays. Null texts stay null with zero counts; texts without
finds come back unchanged; repeated rows are treated alike. Other columns of the
input are not read. Texts of any length are read whole; an empty table gives an
empty result. Where two kinds begin at the same place, the first in ``PATTERNS``
wins. Not found are phones that aren't grouped 3-3-4 and cards in other groups
than 4-4-4-4 and 4-6-5.

The permutations are Feistel networks whose round function is SHA-256 of key,
kind, round and the other half. The key has no default: who has it can invert them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import pick

ROUNDS = 8
#: Set around each find; a text that has it itself is taken apart by the pattern instead.
MARK = "\x01"
_B, _E = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: Kind -> pattern; an earlier kind wins where two begin at the same place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "date": rf"{_B}\d{{4}}-\d{{2}}-\d{{2}}{_E}",
    "ssn": rf"{_B}\d{{3}}-\d{{2}}-\d{{4}}{_E}",
    "phone": rf"(?<![0-9A-Za-z+])(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{3}}\)|\d{{3}})[ .-]\d{{3}}[ .-]\d{{4}}{_E}",
    "ip": r"(?<![0-9A-Za-z.])\d{1,3}(?:\.\d{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "card": rf"{_B}(?:\d{{13,19}}|(?:\d{{4}} ){{3}}\d{{4}}|(?:\d{{4}}-){{3}}\d{{4}}|\d{{4}} \d{{6}} \d{{5}}|\d{{4}}-\d{{6}}-\d{{5}}){_E}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Radices of the two halves: 65536 * 65536 addresses; 898 areas, 99 groups and 9999 serials; 189 * 773 days.
IP_RADICES, SSN_RADICES, DATE_RADICES = (65536, 65536), (898, 99 * 9999), (189, 773)
FIRST_DAY, LAST_DAY = "1800-01-01", "2199-12-31"


def _digest(key: str, kind: str, i: Column, other: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), i.cast("string"), F.lit("|"), other.cast("string")), 256)


def _shifted(half: Column, digest: Column) -> Column:
    """Each letter or digit moved within its class by two hex digits of ``digest``."""

    def one(i: Column) -> Column:
        c = F.substr(half, i, F.lit(1))
        by = F.conv(F.substr(digest, F.pmod(i - 1, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        move = lambda first, size: F.char(F.pmod(F.ascii(c) - ord(first) + by, F.lit(size)) + ord(first))
        return F.when(c.between("0", "9"), move("0", 10)).when(c.between("a", "z"), move("a", 26)).when(c.between("A", "Z"), move("A", 26)).otherwise(c)

    return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(half), F.lit(1))), one), ""))


def permuted_text(s: Column, key: str, kind: str) -> Column:
    """A permutation of the strings with the same classes of characters as ``s``."""
    cut = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), cut).alias("a"), F.substr(s, cut + 1, F.length(s)).alias("b"))
    step = lambda st, i: F.struct(st["b"].alias("a"), _shifted(st["a"], _digest(key, kind, i, st["b"])).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda st: F.concat(st["a"], st["b"]))


def permuted_number(x: Column, radices: tuple[int, int], key: str, kind: str) -> Column:
    """A permutation of 0 .. radices[0] * radices[1] - 1: the halves are shifted in turn."""
    p, q = radices
    number = lambda i, other: F.conv(F.substring(_digest(key, kind, i, other), 1, 12), 16, 10).cast("long")
    start = F.struct(F.floor(x / q).cast("long").alias("a"), F.pmod(x, F.lit(q)).cast("long").alias("b"))

    def step(st: Column, i: Column) -> Column:
        a = F.pmod(st["a"] + number(i, st["b"]), F.lit(p)).cast("long")
        return F.struct(F.when(i % 2 == 1, a).otherwise(st["a"]).alias("a"), F.when(i % 2 == 0, F.pmod(st["b"] + number(i, st["a"]), F.lit(q)).cast("long")).otherwise(st["b"]).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda st: st["a"] * q + st["b"])


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def laid_out(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced, in turn, by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(st: Column, i: Column) -> Column:
        c = F.substr(template, i, F.lit(1))
        is_digit = c.between("0", "9")
        return F.struct(F.concat(st["out"], F.when(is_digit, F.substr(digits, st["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (st["k"] + F.when(is_digit, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(template), F.lit(1))), start, step, lambda st: st["out"])


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum modulo 10; 0 for a valid number."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add, lambda t: F.pmod(t, F.lit(10)))


def _email(m: Column, key: str) -> Column:
    return F.concat(permuted_text(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _phone(m: Column, key: str) -> Column:
    d = digits_of(m)
    return laid_out(m, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), permuted_text(F.right(d, F.lit(10)), key, "phone")))


def _card(m: Column, key: str) -> Column:
    d = digits_of(m)
    body = permuted_text(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
    check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))
    return laid_out(m, F.concat(body, check.cast("string")))


def _octet(m: Column, i: int) -> Column:
    return F.get(F.split(m, r"\."), F.lit(i)).cast("long")


def _ip(m: Column, key: str) -> Column:
    x = permuted_number(((_octet(m, 0) * 256 + _octet(m, 1)) * 256 + _octet(m, 2)) * 256 + _octet(m, 3), IP_RADICES, key, "ip")
    return F.concat_ws(".", *[F.pmod(F.floor(x / F.lit(256**k)), F.lit(256)).cast("long").cast("string") for k in (3, 2, 1, 0)])


def _ssn_parts(m: Column) -> tuple[Column, Column, Column]:
    return tuple(F.get(F.split(m, "-"), F.lit(i)).cast("long") for i in range(3))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = _ssn_parts(m)
    x = permuted_number(((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1, SSN_RADICES, key, "ssn")
    new = F.floor(x / (99 * 9999)).cast("long") + 1
    part = lambda c, n: F.lpad(c.cast("long").cast("string"), n, "0")
    return F.concat_ws("-", part(new + F.when(new >= 666, 1).otherwise(0), 3), part(F.pmod(F.floor(x / 9999), F.lit(99)) + 1, 2), part(F.pmod(x, F.lit(9999)) + 1, 4))


def _ssn_valid(m: Column) -> Column:
    area, group, serial = _ssn_parts(m)
    return area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)


def _day(m: Column) -> Column:
    return F.try_to_date(m, "yyyy-MM-dd")


def _date(m: Column, key: str) -> Column:
    x = permuted_number(F.datediff(_day(m), F.lit(FIRST_DAY).cast("date")).cast("long"), DATE_RADICES, key, "date")
    return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), x.cast("int")), "yyyy-MM-dd")


#: Kind -> (check, pseudonym).
RULES = {
    "email": (lambda m: F.lit(True), _email),
    "date": (lambda m: F.coalesce(_day(m).between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")), F.lit(False)), _date),
    "ssn": (_ssn_valid, _ssn),
    "phone": (lambda m: F.length(digits_of(m)) >= 10, _phone),
    "ip": (lambda m: F.greatest(*[_octet(m, i) for i in range(4)]) <= 255, _ip),
    "card": (lambda m: luhn_sum(digits_of(m)) == 0, _card),
}


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, new) of a find; kind is null, and new the find itself, where the check fails."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new"))
    for kind, (valid, make) in reversed(RULES.items()):
        is_kind = m.rlike(f"^(?:{PATTERNS[kind]})$")
        out = F.when(is_kind, F.when(valid(m), F.struct(F.lit(kind).alias("kind"), make(m, key).alias("new"))).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new")))).otherwise(out)
    return out


def pseudonymise(documents: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``text_col`` with pseudonyms, and the number of replaced finds of each kind.

    One pass of the pattern marks the finds; texts without a digit or an ``@``,
    which every find has, are spared it. The marked text falls apart into texts
    between finds (even places) and finds (odd places).
    """
    rows = pick(documents, id=id_col, text=text_col)
    by_mark = F.split(F.regexp_replace("text", ANY, f"{MARK}$0{MARK}"), MARK, -1)
    between, finds = F.split("text", ANY, -1), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    by_pattern = F.flatten(F.transform(between, lambda x, i: F.when(i < F.size(finds), F.array(x, F.get(finds, i))).otherwise(F.array(x))))
    parts = F.when(F.col("text").rlike("[0-9@]"), F.when(F.instr("text", MARK) > 0, by_pattern).otherwise(by_mark))
    rows = rows.withColumn("parts", parts).withColumn("parts", F.when(F.size("parts") > 1, F.col("parts")))
    rows = rows.withColumn("new", F.transform("parts", lambda x, i: F.when(i % 2 == 1, pseudonym(x, key)).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), x.alias("new")))))
    text = F.when(F.col("parts").isNotNull(), F.array_join("new.new", "")).otherwise(F.col("text"))
    n = lambda kind: F.coalesce(F.when(F.col("parts").isNotNull(), F.size(F.filter("new", lambda x: x["kind"] == kind))), F.lit(0)).cast("long").alias(f"n_{kind}")
    return rows.select(F.col("id").alias(id_col), text.alias(text_col), *[n(k) for k in RULES])
