"""Format-preserving pseudonyms for personal data, by keyed Feistel networks.

Values are found by one pattern, validated, and permuted within their own format: a payment card
number becomes another one with a right check digit, a date another date, an address of four
bytes another one, an account number another one with right check digits. A permutation maps
different values to different values and equal values to the same one, in every document and run
with the same key, so what was linked stays linked and nothing but the key leads back.

The network for numbers works on a pair of numbers modulo (a, b) with a * b the size of the
domain, so no walking through a larger domain is needed; rounds alternate between the halves with
SHA-256 over key, format, round and the other half. Mail addresses have no numeric domain: there
the halves are strings and each letter or digit moves within its own alphabet.

Everything is a column expression: no Python runs on the executors and nothing is shuffled.

Kinds: mail (local part and domain up to the last label), card (13 to 19 digits with a right Luhn
digit), iban (mod 97), ssn (NNN-NN-NNNN with valid groups), ipv4, phone (+ and 8 to 15 digits, the
country code stays), date (years 1900 to 2100 as Y-M-D, D.M.Y or D/M/Y; D/M/Y that only reads as
M/D/Y is read so; days and months come back with two digits). What fails its validation stays as it is.

Defined results: NULL text stays NULL, text without values stays as it is. Repeated rows are
treated alike. Other columns stay. A pseudonym can by chance equal its value (about one in the
size of the format).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.llm.common import free_name, in_row, let, row_fields, table

QUERY_KEY = "key of the registered query"       # for op7 alone: callers of pseudonymise pass their own secret
BLOCK = 64                      # characters that one SHA-512 of key stream moves
ROUNDS = 8
DAY_ZERO = "1900-01-01"
DAYS = (270, 271)               # 270 * 271 days from day zero: to 2 May 2100

MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,63}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PHONE = r"(?<![\d+])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\(?\d{2,5}\)?){2,5}(?!\d))"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\d/-]|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
ANY = "|".join((MAIL, IBAN, PHONE, IPV4, DATE, SSN, CARD))


def _whole(pattern: str) -> str:
    """The pattern for a value by itself: what may stand around it has been checked."""
    import re

    return "^(?:" + re.sub(r"\(\?<?!(?:[^()]|\([^()]*\))*\)", "", pattern) + ")$"


def _draw(key: Column, kind: str, rnd: int, other: Column) -> Column:
    """56 bits of SHA-256 over key, format, round and the other half, as a number."""
    digest = F.sha2(F.concat_ws("|", key, F.lit(kind), F.lit(str(rnd)), other.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")


def feistel(value: Column, a: Column | int, b: Column | int, key: Column, kind: str) -> Column:
    """Keyed permutation of the numbers 0 to a * b - 1 (long)."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))
    pair = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).alias("r"))
    for i in range(ROUNDS):
        if i % 2 == 0:
            step = lambda p, i=i: F.struct(F.pmod(p["l"] + _draw(key, kind, i, p["r"]), a).alias("l"), p["r"].alias("r"))
        else:
            step = lambda p, i=i: F.struct(p["l"].alias("l"), F.pmod(p["r"] + _draw(key, kind, i, p["l"]), b).alias("r"))
        pair = let(pair, step)
    return let(pair, lambda p: p["l"] * b + p["r"])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _permuted_digits(digits: Column, key: Column, kind: str) -> Column:
    """A string of 2 to 18 digits as another one of the same length."""
    return let(digits, lambda d: let(F.length(d), lambda n: F.lpad(feistel(
        d.cast("long"), F.pow(F.lit(10.0), n - F.floor(n / 2)).cast("long"), F.pow(F.lit(10.0), F.floor(n / 2)).cast("long"),
        key, kind).cast("string"), n, "0")))


def _into(value: Column, digits: Column) -> Column:
    """value with its digits replaced, in order, by those of digits."""
    between = F.split(value, r"\d", -1)
    return F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size(between) - 1), F.split(digits, ""),
                                            lambda x, y: F.concat(x, y)), ""), F.element_at(between, -1))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum, the last digit counted once."""
    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), lambda c, i: let(
        c.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x))), F.lit(0), lambda s, x: s + x)


def _card(value: Column, key: Column) -> Column:
    def fresh(d: Column) -> Column:
        body = _permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        return let(body, lambda x: F.concat(x, F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))

    return let(digits_of(value), lambda d: F.when(luhn_sum(d) % 10 == 0, _into(value, fresh(d))).otherwise(value))


def _mod97(chars: Column) -> Column:
    """Remainder of an account number (letters as 10 to 35), first four characters moved to the end."""
    moved = F.concat(F.substring(chars, F.lit(5), F.length(chars)), F.substring(chars, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda s, c: F.when(
        c.rlike("[0-9]"), F.pmod(s * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(s * 100 + F.ascii(c) - 55, F.lit(97))))


def _into_chars(value: Column, chars: Column) -> Column:
    """value with its characters other than spaces replaced, in order."""
    between = F.split(value, "[A-Za-z0-9]", -1)
    return F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size(between) - 1), F.split(chars, ""),
                                            lambda x, y: F.concat(x, y)), ""), F.element_at(between, -1))


def _iban(value: Column, key: Column) -> Column:
    def fresh(c: Column) -> Column:
        country = F.substring(c, 1, 2)
        return let(permuted_text(F.substring(c, F.lit(5), F.length(c)), key, "iban"), lambda body: F.concat(country, F.lpad(
            (F.lit(98) - _mod97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0"), body))

    return let(F.replace(value, F.lit(" "), F.lit("")), lambda c: F.when(_mod97(c) == 1, _into_chars(value, fresh(c))).otherwise(value))


def _shift(text: Column, other: Column, key: Column, kind: str, rnd: int) -> Column:
    """Letters and digits of text moved within their alphabet by a key stream that other determines.

    The stream has a block for every BLOCK characters, so it never ends before the text does.
    """
    blocks = F.greatest(F.ceil(F.length(text) / BLOCK).cast("int"), F.lit(1))
    stream = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.sha2(
        F.concat_ws("|", key, F.lit(kind), F.concat(F.lit(f"{rnd}."), k.cast("string")), other), 512))

    def move(c: Column, i: Column, ks: Column) -> Column:
        block = F.get(ks, F.floor(i / BLOCK).cast("int"))
        by = F.conv(F.substring(block, i % BLOCK * 2 + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)

        def within(low: int, size: int) -> Column:
            return F.chr(F.pmod(code - low + by, F.lit(size)) + low)

        return (F.when(code.between(48, 57), within(48, 10)).when(code.between(65, 90), within(65, 26))
                .when(code.between(97, 122), within(97, 26)).otherwise(c))

    return let(stream, lambda ks: F.array_join(F.transform(F.split(text, ""), lambda c, i: move(c, i, ks)), ""))


def permuted_text(text: Column, key: Column, kind: str) -> Column:
    """Keyed permutation of the strings (of any length) with the same pattern of letters and digits."""
    half = lambda t: F.ceil(F.length(t) / 2).cast("int")
    pair = let(text, lambda t: F.struct(F.substring(t, F.lit(1), half(t)).alias("l"), F.substring(t, half(t) + 1, F.length(t)).alias("r")))
    for i in range(ROUNDS):
        if i % 2 == 0:
            step = lambda p, i=i: F.struct(_shift(p["l"], p["r"], key, kind, i).alias("l"), p["r"].alias("r"))
        else:
            step = lambda p, i=i: F.struct(p["l"].alias("l"), _shift(p["r"], p["l"], key, kind, i).alias("r"))
        pair = let(pair, step)
    return let(pair, lambda p: F.concat(p["l"], p["r"]))


def _mail(value: Column, key: Column) -> Column:
    top = F.substring_index(value, ".", -1)
    return let(F.substring(value, F.lit(1), F.length(value) - F.length(top)), lambda v: F.concat(permuted_text(v, key, "mail"), top))


def _ipv4(value: Column, key: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))

    def fresh(p: Column) -> Column:
        number = F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
        return let(feistel(number, 65536, 65536, key, "ipv4"), lambda n: F.concat_ws(".", *[
            F.shiftright(n, 8 * k).bitwiseAND(F.lit(255)).cast("string") for k in (3, 2, 1, 0)]))

    return let(parts, lambda p: F.when(F.array_max(p) <= 255, fresh(p)).otherwise(value))


def _phone(value: Column, key: Column) -> Column:
    """The country code, up to the first separator, stays."""
    head = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = F.substring(value, F.length(head) + 1, F.length(value))
    return let(F.struct(digits_of(value).alias("all"), digits_of(rest).alias("d"), head.alias("h"), rest.alias("r")), lambda p: F.when(
        F.length(p["all"]).between(8, 15) & (F.length(p["d"]) >= 4),
        F.concat(p["h"], _into(p["r"], _permuted_digits(p["d"], key, "phone")))).otherwise(value))


def _ssn(value: Column, key: Column) -> Column:
    """Area 1 to 899 without 666, group 1 to 99, serial 1 to 9999."""
    area, group, serial = (F.substring(value, p, n).cast("long") for p, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)
    number = (area - F.when(area > 666, 2).otherwise(1)) * 99 * 9999 + (group - 1) * 9999 + serial - 1
    return F.when(valid, let(feistel(number, 898, 99 * 9999, key, "ssn"), lambda n: let(
        F.floor(n / (99 * 9999)) + 1, lambda a: F.concat_ws(
            "-", F.lpad((a + F.when(a >= 666, 1).otherwise(0)).cast("string"), 3, "0"),
            F.lpad((F.floor(F.pmod(n, F.lit(99 * 9999)) / 9999) + 1).cast("string"), 2, "0"),
            F.lpad((F.pmod(n, F.lit(9999)) + 1).cast("string"), 4, "0"))))).otherwise(value)


def _date(value: Column, key: Column) -> Column:
    p = F.transform(F.split(value, "[-./]"), lambda x: x.cast("int"))
    iso = F.contains(value, F.lit("-"))

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"),
                                         F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")

    def read(x: Column) -> Column:
        """Date and whether the month stands first."""
        dmy = made(x[2], x[1], x[0])
        return F.when(iso, F.struct(made(x[0], x[1], x[2]).alias("d"), F.lit(False).alias("us"))).when(
            dmy.isNotNull() | ~F.contains(value, F.lit("/")), F.struct(dmy.alias("d"), F.lit(False).alias("us"))).otherwise(
            F.struct(made(x[2], x[0], x[1]).alias("d"), F.lit(True).alias("us")))

    def fresh(x: Column) -> Column:
        day = F.datediff(x["d"], F.lit(DAY_ZERO).cast("date")).cast("long")
        mark = F.when(F.contains(value, F.lit("/")), "/").otherwise(".")
        # a date read as month first comes back month first
        return F.when(x["d"].isNull() | ~day.between(0, DAYS[0] * DAYS[1] - 1), value).otherwise(
            let(F.date_add(F.lit(DAY_ZERO).cast("date"), feistel(day, *DAYS, key, "date").cast("int")), lambda n: F.when(
                iso, F.date_format(n, "yyyy-MM-dd")).when(x["us"], F.concat_ws("/", F.date_format(n, "MM"), F.date_format(n, "dd"), F.date_format(n, "yyyy")))
                .otherwise(F.concat(F.date_format(n, "dd"), mark, F.date_format(n, "MM"), mark, F.date_format(n, "yyyy")))))

    return let(let(p, read), fresh)


KINDS = (("mail", MAIL, _mail), ("iban", IBAN, _iban), ("phone", PHONE, _phone), ("ipv4", IPV4, _ipv4), ("date", DATE, _date),
         ("ssn", SSN, _ssn), ("card", CARD, _card))


def pseudonym(value: Column, key: Column) -> Column:
    """The value as its pseudonym, or as it is where it is not valid."""
    out = value
    for _, pattern, make in reversed(KINDS):
        out = F.when(value.rlike(_whole(pattern)), make(value, key)).otherwise(out)
    return out


def pseudonymised(text: Column, key: Column) -> Column:
    """Struct of text and the number of values that were replaced."""
    values = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    pieces = F.split(text, ANY, -1)
    made = let(values, lambda v: F.struct(v.alias("old"), F.transform(v, lambda x: pseudonym(x, key)).alias("new")))
    full = let(made, lambda m: F.struct(
        F.concat(F.array_join(F.zip_with(F.slice(pieces, 1, F.size(m["new"])), m["new"], lambda a, b: F.concat(a, b)), ""),
                 F.element_at(pieces, -1)).alias("text"),
        F.size(F.filter(F.zip_with(m["old"], m["new"], lambda a, b: a != b), lambda x: x)).cast("long").alias("n")))
    # most texts hold nothing: a quick look saves the long pattern
    return F.when(text.rlike(r"@|\d"), full).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns of docs with the text replaced, and struct _pii (n); a column of docs of that name stays, the struct is then __pii."""
    made = docs.select(in_row(docs), pseudonymised(F.col(f"`{text}`"), F.lit(key)).alias("made"))
    return made.select(*row_fields(docs, {text: F.col("made.text")}), F.struct(F.col("made.n").alias("n")).alias(free_name(docs, "_pii")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, QUERY_KEY).select("doc_id", "text", F.col("_pii.n").alias("n_replaced"))
