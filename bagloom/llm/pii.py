"""Format-preserving pseudonyms for personal data, by DataFrame functions only.

A match of one pattern is validated and then permuted within its own format by a keyed Feistel network, so equal
values get equal pseudonyms in all documents, and different values of a format different ones:

- card numbers (13 to 19 digits, also in the usual groups) that pass the Luhn check: all digits but the last are
  permuted and the check digit is made anew; separators stay;
- phone numbers in international form (8 to 15 digits): the digits after the country code, as one number, so that a
  number has one pseudonym however it is grouped. A number after a phone stays its own where the country's numbers have
  one length (PLANS); elsewhere groups of 2 to 4 digits that begin no other value count as the phone's up to 15 digits,
  as nothing tells them apart;
- IPv4 addresses whose parts are 0 to 255: as one 32-bit number;
- calendar dates (YYYY-MM-DD, 1700 to 2099): as the number of a day of these 400 years;
- e-mail addresses with a local part of at most 64 characters (longer ones are none): letters and digits of the local
  part, each within its kind, letters beyond ASCII within their run of neighbouring letters; the domain stays;
- secrets of 32 to 64 hexadecimal digits, within these digits; in upper case as in lower case, and raised again, so both
  spellings stay linked; in mixed case, digits and the letters of each case within their kind.

The two halves of a value take turns in being shifted, place by place, by digits of SHA-256 over key, kind,
round and other half. Numbers that fail their check (other long numbers, versions such as 1.2.3.400) stay.
The caller should give a key of its own and keep it secret; whoever has it can undo the pseudonyms.

Defined results: a null text stays null, with no values; an empty text stays empty; all else of a text, and all
other columns, whatever their names, stay as they are; repeated rows are treated alike; an empty table gives no rows.
Repeated groups in the patterns are possessive: Java's matcher recurses into others, and a long text would end the JVM.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

KEY, ROUNDS = "bagloom", 8
#: The patterns of what is looked for, in order of preference at one place.
_LOCAL, _LABEL = r"[\p{L}\p{N}._%+-]", "[A-Za-z0-9-]"
_TO_TOP = rf"(?:\.(?![A-Za-z]{{2}}){_LABEL}++)*+\.[A-Za-z]{{2,}}+"  # labels up to one that begins with two letters
EMAIL = rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+@{_LABEL}++{_TO_TOP}(?:{_LABEL}*+{_TO_TOP})*+"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
SECRET = r"(?<![\p{L}\p{N}])[0-9A-Fa-f]{32,64}(?![\p{L}\p{N}])"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?!\d)"
#: Digits after the country code, for codes whose numbers have one length.
PLANS = {8: "45|47|65|852", 9: "27|31|33|34|41|48|61|351|420|421", 10: "1|7|30|44|52|57|91"}
#: Country codes of one and two digits; all others have three.
CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98"
_DIGIT = r"[ ()-]{0,2}\d"  # written out n times: Java bounds no lookbehind over a repeated group
_COMPLETE = "(?<=" + "|".join(rf"\+(?:{codes}){_DIGIT * n}" for n, codes in PLANS.items()) + ")"
_VALID = rf"(?<=\+{_DIGIT * 8}{f'(?:{_DIGIT})?' * 7})"
_GROUPS = r"\+\d{1,3}[ -]?\(?\d{2,4}\)?(?:%s[ -]?\d{2,4}){2,3}(?!\d)"
_OTHERS = (EMAIL, ADDRESS, DATE, SECRET)
#: A phone ends where its country's number is complete; or else where another value follows; or else after all groups, up to
#: 15 digits. The last doesn't ask for cards: four groups of four digits may be the phone's own with numbers after it.
PHONE = f"{_GROUPS % ''}{_COMPLETE}|{_GROUPS % ''}{_VALID}(?=[ -](?:{'|'.join((*_OTHERS, CARD))}))|{_GROUPS % f'(?![ -](?:{"|".join(_OTHERS)}))'}{_VALID}"
PATTERN = "|".join((EMAIL, PHONE, ADDRESS, DATE, SECRET, CARD))
#: Days from 1700-01-01 to 2099-12-31, as two factors.
DAYS = (189, 773)
DIGITS, LOWER, UPPER, HEXADECIMAL = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value bound, so that it is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _noise(key: str, kind: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), turn.cast("string"), F.lit("|"), half.cast("string")), 256)


def _number(noise: Column, at: Column, digits: int) -> Column:
    return F.conv(F.substring(noise, at, F.lit(digits)), 16, 10).cast("long")


@lru_cache
def letter_runs() -> tuple[list[int], list[int]]:
    """First code points and lengths of the runs of neighbouring letters and numbers from U+0080 to U+FFFF; Latin ones are cut every 64."""
    starts, lengths = [], []
    for c in range(0x80, 0x10000):
        if unicodedata.category(chr(c))[0] in "LN":
            if starts and starts[-1] + lengths[-1] == c and (c >= 0x250 or c % 64):
                lengths[-1] += 1
            else:
                starts.append(c)
                lengths.append(1)
    return starts, lengths


def _literal(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<int>")


def _moved_in_run(c: Column, step: Column) -> Column:
    """A letter beyond ASCII, moved within its run; what is in no run stays."""
    starts, lengths = (_literal(v) for v in letter_runs())
    code = F.ascii(c)

    def within(i: Column) -> Column:
        start, length = F.get(starts, i), F.get(lengths, i)
        to = start + (code - start + step) % length
        return F.when(code < start + length, F.decode(F.unhex(F.lpad(F.hex(to.cast("long")), 4, "0")), "UTF-16BE")).otherwise(c)

    last = F.size(F.filter(starts, lambda x: x <= code)) - 1
    return F.when((code >= 0x80) & (code < 0x10000), let(last, within)).otherwise(c)


def _shifted(half: Column, noise: Column, alphabets: tuple[str, ...], others: bool = False) -> Column:
    """Each character moved within its alphabet by the noise of its place; of others, letters only if `others` says so."""

    def one(i: Column) -> Column:
        def moved(c: Column) -> Column:
            out = None
            step = _number(noise, (i * 4) % 64 + 1, 4)
            for a in alphabets:
                to = F.substring(F.lit(a), ((F.instr(F.lit(a), c) - 1 + step) % len(a) + 1).cast("int"), F.lit(1))
                out = F.when(F.instr(F.lit(a), c) > 0, to) if out is None else out.when(F.instr(F.lit(a), c) > 0, to)
            return out.otherwise(_moved_in_run(c, step) if others else c)

        return let(F.substring(half, i + 1, F.lit(1)), moved)

    return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.length(half) - 1), one), ""))


def permuted(value: Column, kind: str, key: str, alphabets: tuple[str, ...], others: bool = False) -> Column:
    """A Feistel network over the halves of a string. value must be a bound variable or a column."""
    middle = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), middle).alias("l"), F.substring(value, middle + 1, F.length(value)).alias("r"))

    def turned(s: Column, i: Column) -> Column:
        return let(_noise(key, kind, i, s["r"]), lambda noise: F.struct(s["r"].alias("l"), _shifted(s["l"], noise, alphabets, others).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turned, lambda s: F.concat(s["l"], s["r"]))


def permuted_number(left: Column, right: Column, kind: str, key: str, sizes: tuple[int, int], done: Callable[[Column, Column], Column]) -> Column:
    """A Feistel network over two numbers below the given sizes."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turned(s: Column, i: Column) -> Column:
        size = F.when(i % 2 == 1, F.lit(sizes[0])).otherwise(F.lit(sizes[1]))
        return F.struct(s["r"].alias("l"), ((s["l"] + _number(_noise(key, kind, i, s["r"]), F.lit(1), 12)) % size).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turned, lambda s: done(s["l"], s["r"]))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum, the last digit counting singly."""

    def one(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(let(d * 2, lambda x: F.when(x > 9, x - 9).otherwise(x)))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), one)


def in_layout(value: Column, digits: Column) -> Column:
    """The value with its digits replaced in order."""

    def one(i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(value, F.lit(1), i), "[0-9]", ""))
        c = F.substring(value, i + 1, F.lit(1))
        return F.when(F.instr(F.lit(DIGITS), c) > 0, F.substring(digits, i - before + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(value) - 1), one), "")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(value: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        front = let(F.substring(d, F.lit(1), F.length(d) - 1), lambda f: permuted(f, "card", key, (DIGITS,)))
        whole = let(front, lambda f: F.concat(f, ((10 - luhn_sum(F.concat(f, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, let(whole, lambda w: in_layout(value, w))).otherwise(value)

    return let(_digits(value), made)


def _phone(value: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        code = F.length(F.regexp_extract(d, rf"^(?:{CODES}|\d{{3}})", 0))
        own = let(F.substring(d, code + 1, F.length(d)), lambda own: permuted(own, "phone", key, (DIGITS,)))
        return F.when(F.length(d).between(8, 15), in_layout(value, F.concat(F.substring(d, F.lit(1), code), own))).otherwise(value)

    return let(_digits(value), made)


def _address(value: Column, key: str) -> Column:
    def made(p: Column) -> Column:
        n = [F.get(p, i).cast("int") for i in range(4)]
        octets = lambda x: F.concat(F.floor(x / 256).cast("string"), F.lit("."), (x % 256).cast("string"))
        new = permuted_number(n[0] * 256 + n[1], n[2] * 256 + n[3], "address", key, (65536, 65536), lambda a, b: F.concat(octets(a), F.lit("."), octets(b)))
        return F.when(F.exists(p, lambda x: (x.cast("int") > 255) | ((F.length(x) > 1) & x.startswith("0"))), value).otherwise(new)

    return let(F.split(value, r"\."), made)


def _date(value: Column, key: str) -> Column:
    first = F.lit("1700-01-01").cast("date")

    def made(day: Column) -> Column:
        new = permuted_number(F.floor(day / DAYS[1]), day % DAYS[1], "date", key, DAYS, lambda a, b: F.date_format(F.date_add(first, (a * DAYS[1] + b).cast("int")), "yyyy-MM-dd"))
        return F.when(day.between(0, DAYS[0] * DAYS[1] - 1), new).otherwise(value)

    return let(F.datediff(value.try_cast("date"), first), made)


def _email(value: Column, key: str) -> Column:
    at = F.instr(value, "@")
    return F.concat(let(F.substring(value, F.lit(1), at - 1), lambda v: permuted(v, "email", key, (DIGITS, LOWER, UPPER), others=True)), F.substring(value, at, F.length(value)))


def _secret(value: Column, key: str) -> Column:
    plain = let(F.lower(value), lambda v: permuted(v, "secret", key, (HEXADECIMAL,)))
    mixed = permuted(value, "secret", key, (DIGITS, HEXADECIMAL[10:], HEXADECIMAL[10:].upper()))
    return F.when(value == F.lower(value), plain).when(value == F.upper(value), F.upper(plain)).otherwise(mixed)


def pseudonym(value: Column, key: str = KEY) -> Column:
    """Of a match of PATTERN: its pseudonym, or itself if it isn't valid."""
    return (
        F.when(F.instr(value, "@") > 0, _email(value, key))
        .when(value.startswith("+"), _phone(value, key))
        .when(F.instr(value, ".") > 0, _address(value, key))
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), _date(value, key))
        .when((F.length(value) >= 32) & ~value.contains(" ") & ~value.contains("-"), _secret(value, key))
        .otherwise(_card(value, key))
    )


def pseudonymised(docs: DataFrame, key: str = KEY, text: str = "text", values: tuple[str, str] | None = None) -> DataFrame:
    """The rows with valid values in `text` replaced. `values` names two columns to add: the values found, and what stands for each."""
    if values and set(values) & set(docs.columns):
        raise ValueError(f"the table has a column of {values} already")
    before, after = values or (f"_found_{uuid.uuid4().hex}", f"_new_{uuid.uuid4().hex}")
    none = F.array().cast("array<string>")
    found = F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)))
    marked = docs.withColumn(before, F.coalesce(found, none))
    marked = marked.withColumn(after, F.transform(before, lambda v: pseudonym(v, key)))
    joined = F.array_join(F.zip_with(F.split(F.col(text), PATTERN), F.col(after), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    out = marked.withColumn(text, F.when(F.size(before) == 0, F.col(text)).otherwise(joined))
    return out if values else out.select(*docs.columns)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    changed = F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x)
    out = pseudonymised(docs, values=("found", "new"))
    return out.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), F.size(changed).cast("long").alias("n_replaced"))
