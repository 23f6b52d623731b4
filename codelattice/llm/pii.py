"""PII: format-preserving Feistel pseudonyms, with DataFrame operations only.

E-mail addresses, telephone numbers, card and social security numbers, IPv4 addresses and ISO dates
are found by one pattern, validated by kind, and permuted within their format by a keyed Feistel
network: digits become digits and letters letters, separators stay where they are, a card keeps a
valid check digit, an address stays an address and a date a date.  The permutation depends on key,
kind and format alone, so equal values stay linked across documents and unequal ones never merge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pattern of each kind, in the order in which they are tried.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "date": r"(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?!\d)",
    "ip": r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "ssn": r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?:\d{1,3}[.-])?\d{3}[.-]\d{3}[.-]\d{4}(?!\d)|(?:\d{1,3} )?\d{3} \d{3} \d{4}(?! ?\d)",
    "card": r"\d{13,19}(?!\d)|(?<!\d{4}-)\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?(?!\d)|\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d)",
}
#: What may not stand before a value, by kind: only what would make it the end of a longer one.
BEFORE = {
    "email": r"(?<![A-Za-z0-9@._+-])",
    "date": r"(?<![A-Za-z0-9])",
    "ip": r"(?<![A-Za-z0-9])(?<!\d\.)",
    "ssn": r"(?<![A-Za-z0-9])(?<!\d-)",
    "phone": r"(?<![A-Za-z0-9])(?<!\d[ .-])",
    "card": r"(?<![A-Za-z0-9])(?<!\d\.)",
}
ANY = "(?:" + "|".join(f"(?:{BEFORE[k]}(?:{p}))" for k, p in PATTERNS.items()) + ")"
ROUNDS = 8
#: Symbols in one pass of the network; halves stay below 2^53.
DIGITS_AT_ONCE, LETTERS_AT_ONCE = 30, 20
#: The pattern's dates, 1900-01-01 to 2099-12-31, are 17 x 4297 days and permuted among these.
FIRST_DAY, DATE_LEFT, DATE_RIGHT = "1900-01-01", 17, 4_297
#: Social security numbers that are given out: areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999.
AREAS, GROUPS, SERIALS = 898, 99, 9_999
#: Digits of a telephone number, country code included.
PHONE_DIGITS = (7, 15)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def feistel(a: Column, b: Column, left: Column, right: Column, key: str, tweak: Column) -> Column:
    """struct(a, b) with a < left and b < right after the keyed rounds.

    Even rounds add a keyed function of b to a modulo left, odd ones a function of a to b modulo
    right.  Each round can be undone, so the whole is a permutation of all pairs.
    """

    def keyed(k, value):
        text = F.concat_ws("|", F.lit(key), tweak, k.cast("string"), value.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("long")

    def step(state, k):
        even = k % 2 == 0
        shift = keyed(k, F.when(even, state["b"]).otherwise(state["a"]))
        return F.struct(
            F.when(even, F.pmod(state["a"] + shift, left)).otherwise(state["a"]).alias("a"),
            F.when(even, state["b"]).otherwise(F.pmod(state["b"] + shift, right)).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _digits_to_number(digits: Column) -> Column:
    return F.concat(F.lit("0"), digits).cast("long")


def _number_to_digits(number: Column, n: Column) -> Column:
    return F.when(n == 0, "").otherwise(F.lpad(number.cast("string"), n, F.lit("0")))


def _letters_to_number(letters: Column) -> Column:
    places = F.filter(F.split(letters, ""), lambda c: c != "")
    return F.aggregate(places, F.lit(0).cast("long"), lambda total, c: total * 26 + F.ascii(c) - 97)


def _number_to_letters(number: Column, n: Column) -> Column:
    def put(state, _):
        low = state["x"] % 26
        return F.struct(((state["x"] - low) / 26).cast("long").alias("x"), F.concat(F.char(low + 97), state["s"]).alias("s"))

    start = F.struct(number.cast("long").alias("x"), F.lit("").alias("s"))
    return F.when(n == 0, "").otherwise(F.aggregate(F.sequence(F.lit(1), n), start, put, lambda s: s["s"]))


def permute_symbols(text: Column, radix: int, at_once: int, key: str, tweak: Column) -> Column:
    """A keyed permutation of the strings of the same length, of digits (radix 10) or of a-z (radix 26)."""
    to_number, to_text = (_digits_to_number, _number_to_digits) if radix == 10 else (_letters_to_number, _number_to_letters)

    def block(at):
        def permuted(part):
            n = F.length(part)
            cut = F.floor(n / 2).cast("int")
            size = lambda k: F.pow(F.lit(float(radix)), k).cast("long")
            own = F.concat_ws("/", tweak, at.cast("string"), n.cast("string"))
            state = feistel(
                to_number(F.substring(part, F.lit(1), cut)), to_number(F.substring(part, cut + 1, n)),
                size(cut), size(n - cut), key, own,
            )
            return let(state, lambda s: F.concat(to_text(s["a"], cut), to_text(s["b"], n - cut)))

        return let(F.substring(text, at * at_once + 1, F.lit(at_once)), permuted)

    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(text) / at_once).cast("int") - 1))
    return F.when(F.length(text) == 0, "").otherwise(F.array_join(F.transform(blocks, block), ""))


def luhn_sum(digits: Column) -> Column:
    """Sum of a digit string by Luhn's rule, the last digit undoubled."""

    def add(total, place):
        value = F.substring(digits, F.length(digits) - place, F.lit(1)).cast("int")
        return total + F.when(place % 2 == 0, value).when(value > 4, value * 2 - 9).otherwise(value * 2)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def refill(template: Column, digits: Column, letters: Column) -> Column:
    """The template with its digits and ASCII letters replaced in order; letters keep their case."""

    def put(state, at):
        char = F.substring(template, at, F.lit(1))
        digit, letter = char.rlike("^[0-9]$"), char.rlike("^[A-Za-z]$")
        low = F.substring(letters, state["l"], F.lit(1))
        new = F.when(digit, F.substring(digits, state["d"], F.lit(1))).when(letter, F.when(char == F.lower(char), low).otherwise(F.upper(low)))
        return F.struct(
            F.concat(state["out"], new.otherwise(char)).alias("out"),
            (state["d"] + digit.cast("int")).alias("d"),
            (state["l"] + letter.cast("int")).alias("l"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("d"), F.lit(1).alias("l"))
    return F.aggregate(F.sequence(F.lit(1), F.length(template)), start, put, lambda s: s["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def kind_of(value: Column) -> Column:
    """The first kind whose pattern is all of the value and whose validation holds; null if none."""
    found = None
    for name, pattern in PATTERNS.items():
        fits = value.rlike(f"^(?:{pattern})$")
        if name == "card":
            fits = fits & let(_digits(value), lambda d: luhn_sum(d) % 10 == 0)
        elif name == "phone":
            fits = fits & F.length(_digits(value)).between(*PHONE_DIGITS)
        elif name == "date":
            fits = fits & F.coalesce(F.datediff(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")), F.lit(FIRST_DAY)).between(0, DATE_LEFT * DATE_RIGHT - 1), F.lit(False))
        found = F.when(fits, name) if found is None else found.when(fits, name)
    return found


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The value's pseudonym of the same kind and format."""
    tweak = F.coalesce(kind, F.lit(""))

    def digits_only(v):
        return refill(v, permute_symbols(_digits(v), 10, DIGITS_AT_ONCE, key, tweak), F.lit(""))

    def email(v):
        def local(name):
            letters = F.lower(F.regexp_replace(name, "[^A-Za-z]", ""))
            # the shape is part of the tweak, so values of one shape are permuted among themselves
            shape = F.concat_ws("/", tweak, F.regexp_replace(F.regexp_replace(name, "[0-9]", "0"), "[A-Za-z]", "a"))
            new_digits = permute_symbols(_digits(name), 10, DIGITS_AT_ONCE, key, shape)
            return refill(name, new_digits, permute_symbols(letters, 26, LETTERS_AT_ONCE, key, shape))

        return F.concat(let(F.substring_index(v, "@", 1), local), F.lit("@"), F.substring_index(v, "@", -1))

    def card(v):
        def body(digits):
            new = permute_symbols(F.substring(digits, F.lit(1), F.length(digits) - 1), 10, DIGITS_AT_ONCE, key, tweak)
            whole = let(new, lambda n: F.concat(n, F.pmod(10 - luhn_sum(F.concat(n, F.lit("0"))) % 10, F.lit(10)).cast("string")))
            return refill(v, whole, F.lit(""))

        return let(_digits(v), body)

    def ip(v):
        part = lambda k: F.split_part(v, F.lit("."), F.lit(k)).cast("long")
        state = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65_536), F.lit(65_536), key, tweak)
        octets = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
        return let(state, lambda s: F.concat_ws(".", octets(s["a"]), octets(s["b"])))

    def ssn(v):
        part = lambda at, n: F.substring(v, at, n).cast("long")
        area = part(1, 3) - 1 - (part(1, 3) > 666).cast("long")
        state = feistel(area * GROUPS + part(5, 2) - 1, part(8, 4) - 1, F.lit(AREAS * GROUPS), F.lit(SERIALS), key, tweak)

        def written(s):
            new = F.floor(s["a"] / GROUPS) + 1
            new = new + (new >= 666).cast("long")
            digits = ((new, 3), (s["a"] % GROUPS + 1, 2), (s["b"] + 1, 4))
            return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in digits])

        return let(state, written)

    def date(v):
        day = F.datediff(F.try_to_timestamp(v, F.lit("yyyy-MM-dd")), F.lit(FIRST_DAY))
        moved = let(day, lambda n: feistel(F.floor(n / DATE_RIGHT), n % DATE_RIGHT, F.lit(DATE_LEFT), F.lit(DATE_RIGHT), key, tweak))
        return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (moved["a"] * DATE_RIGHT + moved["b"]).cast("int")), "yyyy-MM-dd")

    return (
        F.when(kind.isNull(), value)
        .when(kind == "email", email(value))
        .when(kind == "card", card(value))
        .when(kind == "ip", ip(value))
        .when(kind == "date", date(value))
        .when(kind == "ssn", ssn(value))
        .otherwise(digits_only(value))
    )


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id_col, text with pseudonyms, n_pii, kinds).

    kinds holds the kind of every replaced value in order.  Values that look like a kind but fail
    its validation (a card's check digit, a day that does not exist, a social security number of an
    area, group or serial that is not given out, a telephone number of under 7 or over 15 digits, an
    address with a leading zero) stay.  Null text stays null
    with n_pii 0; empty texts stay empty.  Nothing is looked at but id and text; an empty table
    gives an empty result; equal rows give equal results.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col),
        text.alias("text"),
        # texts without a digit or an @ hold nothing that the pattern finds
        F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("values"),
    )
    made = F.transform("values", lambda v: let(kind_of(v), lambda k: F.struct(pseudonym(v, k, key).alias("new"), k.alias("kind"))))
    rows = rows.select("*", F.when(F.size("values") > 0, made).alias("made"))
    gaps = F.split("text", ANY, -1)
    whole = F.array_join(F.flatten(F.zip_with(gaps, F.col("made.new"), lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")
    kinds = F.coalesce(F.filter("made.kind", lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return rows.select(
        id_col,
        F.when(F.col("made").isNotNull(), whole).otherwise(F.col("text")).alias("text"),
        F.size(kinds).alias("n_pii"),
        kinds.alias("kinds"),
    )
