"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Matches of one pattern are found in a text, checked (Luhn digit, octets, real
dates, numbering-plan ranges, check digits), and permuted within their format by
a keyed Feistel network, so equal values get equal pseudonyms in every document
and a pseudonym passes the checks its value passed. All else stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import table

#: Rounds of every network.
ROUNDS = 8
#: What the patterns take, one for each kind; fixed formats.
EMAIL = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
CARD = r"\d(?:[ -]?\d){12,18}"
PHONE = r"(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}"
SSN = r"\d{3}-\d{2}-\d{4}"
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
DATE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
#: A match is no part of a longer word, number or address.
BEFORE, AFTER = r"(?<![\p{L}\p{N}_.+@-])", r"(?![\p{L}\p{N}_@]|[.-][\p{L}\p{N}_])"
PATTERN = f"{BEFORE}(?:{EMAIL}|{PHONE}|{SSN}|{IPV4}|{DATE}|{IBAN}|{CARD}){AFTER}"
#: A card ends before a dash and digits, too: what follows may be another number.
CARD_AFTER = r"(?![\p{L}\p{N}_@]|\.[\p{L}\p{N}_]|-[\p{L}_])"
#: The longest text from a number on that may be a card, at each number and where a
#: run of numbers begins; and the usual groupings.
CARD_AT = rf"{BEFORE}(?=({CARD}){CARD_AFTER})\d+"
FREE_AT = rf"(?<!\d[ -]){CARD_AT}"
GROUPED = r"^(?:\d{4}([ -])\d{4}\1\d{4}\1(?:\d{4}(?:\1\d{3})?|\d{1,3})|\d{4}([ -])\d{6}\2\d{4,5})$"
KINDS = ("email", "phone", "ssn", "ip", "date", "iban", "card")
#: Dates are permuted within their 400 years (1600 to 1999, 2000 to 2399 and so
#: on), a whole cycle of the calendar, which has 27 * 5411 days.
CYCLE_START, CYCLE = "2000-01-01", (27, 5411)


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _turns(x: Column, y: Column, step) -> Column:  # noqa: ANN001
    """The last struct (x, y) of ROUNDS steps."""
    return F.reduce(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(x.alias("x"), y.alias("y")), step)


def feistel(x: Column, y: Column, high: Column | int, low: Column | int, key: Column) -> Column:
    """The keyed permutation of pairs of x below high and y below low: they
    change by turns, each by a keyed hash of the other."""
    high, low = (n if isinstance(n, Column) else F.lit(n) for n in (high, low))

    def number(turn: Column, other: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", key, turn.cast("string"), other.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")

    def step(s: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        new_x = F.when(even, s["x"]).otherwise(F.pmod(s["x"] + number(turn, s["y"]), high))
        new_y = F.when(even, F.pmod(s["y"] + number(turn, s["x"]), low)).otherwise(s["y"])
        return F.struct(new_x.cast("bigint").alias("x"), new_y.cast("bigint").alias("y"))

    return _turns(x.cast("bigint"), y.cast("bigint"), step)


def feistel_text(value: Column, key: Column) -> Column:
    """The keyed permutation of texts that keeps, sign by sign, lower-case letters,
    capitals, digits and everything else what they are: the halves move along
    their alphabets by turns, each by keyed hashes of the other."""

    def moved(half: Column, turn: Column, other: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", key, turn.cast("string"), other), 512)

        def sign(at: Column) -> Column:
            c = F.substr(half, at, F.lit(1))
            by = F.conv(F.substr(stream, 2 * ((at - 1) % 64) + 1, F.lit(2)), 16, 10).cast("int")
            code = F.ascii(c)

            def along(first: int, n: int) -> Column:
                return F.char((code - first + by) % n + first)

            return F.when(c.between("a", "z"), along(97, 26)).when(c.between("A", "Z"), along(65, 26)).when(c.between("0", "9"), along(48, 10)).otherwise(c)

        return F.when(F.length(half) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), sign), "")).otherwise(F.lit(""))

    def step(s: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        return F.struct(F.when(even, s["x"]).otherwise(moved(s["x"], turn, s["y"])).alias("x"), F.when(even, moved(s["y"], turn, s["x"])).otherwise(s["y"]).alias("y"))

    cut = _div(F.length(value), 2).cast("int")
    last = _turns(F.substr(value, F.lit(1), cut), F.substr(value, cut + 1), step)
    return F.concat(last["x"], last["y"])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def filled(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order, by the given ones."""

    def sign(at: Column) -> Column:
        c = F.substr(template, at, F.lit(1))
        place = F.length(digits_of(F.substr(template, F.lit(1), at)))
        return F.when(c.between("0", "9"), F.substr(digits, place, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(template)), sign), "")


def padded(value: Column, width: Column | int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of digits of which the last one is the check digit."""

    def one(at: Column) -> Column:
        d = F.substr(digits, -at, F.lit(1)).cast("int")
        return F.when(at % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.reduce(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, at: total + one(at))


def card(value: Column, key: Column) -> Column:
    """The first digit stays, and the check digit is made anew."""
    digits = digits_of(value)
    n = F.length(digits)
    a = _div(n - 2, 2).cast("int")
    b = n - 2 - a
    new = feistel(F.substr(digits, F.lit(2), a), F.substr(digits, a + 2, b), F.pow(F.lit(10.0), a).cast("bigint"), F.pow(F.lit(10.0), b).cast("bigint"), F.concat(key, F.lit("card"), n.cast("string")))
    body = F.transform(F.array(new), lambda s: F.concat(F.substr(digits, F.lit(1), F.lit(1)), padded(s["x"], a), padded(s["y"], b)))
    whole = F.transform(body, lambda s: F.concat(s, ((10 - luhn_sum(F.concat(s, F.lit("0"))) % 10) % 10).cast("string")))
    return F.when(luhn_sum(digits) % 10 == 0, filled(value, whole[0]))


def spaced_cards(value: Column) -> Column:
    """(grouped, free): the cards of a text that are written with spaces or dashes,
    longest first. Grouped: at any number, the longest text of a usual grouping with
    a right check digit. Free: where a run of numbers begins, the longest text of any
    grouping that ends before no dash, and whatever matches as a whole, unless a plain
    or grouped card begins in it. (Such texts at every number of a table would take
    most of the table for cards.)"""

    def right(s: Column) -> Column:
        return luhn_sum(digits_of(s)) % 10 == 0

    def cards(at: Column, grouped: bool) -> Column:
        ends = F.filter(F.sequence(F.lit(13), F.length(at)), lambda i: F.substr(at, i + 1, F.lit(1)).isin("", " ", *["-"] * grouped) & F.substr(at, i, F.lit(1)).between("0", "9"))
        parts = F.transform(ends, lambda i: F.substr(at, F.lit(1), i))
        usual = lambda s: s.rlike(GROUPED) if grouped else ~s.rlike(GROUPED)
        return F.filter(parts, lambda s: usual(s) & (F.length(digits_of(s)) >= 13) & s.rlike("[ -]") & right(s))

    def plain(at: Column) -> Column:
        return F.exists(F.regexp_extract_all(at, F.lit(r"(?<!\d)\d{13,19}(?!\d)"), F.lit(0)), right)

    def sorted_last(found: Column) -> Column:
        last = F.array_distinct(F.array_compact(F.transform(found, lambda x: F.try_element_at(x, F.lit(-1)))))
        return F.transform(F.array_sort(F.transform(last, lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s")))), lambda x: x["s"])

    places = F.filter(F.array_distinct(F.regexp_extract_all(value, F.lit(CARD_AT), F.lit(1))), lambda at: at.rlike("[ -]"))
    grouped = sorted_last(F.transform(F.filter(places, lambda at: ~plain(F.regexp_extract(at, r"^\d+", 0))), lambda at: cards(at, True)))

    def others(usual: Column) -> Column:
        begins = F.transform(usual, lambda s: F.regexp_extract(s, r"^\d+", 0))

        def free(found: Column) -> Column:
            return F.filter(F.array_distinct(found), lambda at: at.rlike("[ -]") & ~plain(at) & ~F.exists(begins, lambda s: F.array_contains(F.split(at, "[ -]"), s)))

        first = free(F.regexp_extract_all(value, F.lit(FREE_AT), F.lit(1)))
        as_is = free(F.filter(F.regexp_extract_all(value, F.lit(PATTERN), F.lit(0)), lambda m: m.rlike(f"^{CARD}$")))
        found = F.concat(F.transform(first, lambda at: cards(at, False)), F.transform(as_is, lambda at: F.filter(F.array(at), right)))
        return F.struct(usual.alias("grouped"), sorted_last(found).alias("free"))

    return F.transform(F.array(grouped), others)[0]


def pattern_of(value: Column) -> Column:
    """The pattern of a text's matches: all kinds, plain cards, and the text's
    spaced_cards as they stand, so that no neighbour is taken for a part of a card."""

    def whole(free: Column | None = None, grouped: Column | None = None) -> Column:
        others = F.lit("|".join((EMAIL, PHONE, SSN, IPV4, DATE, IBAN)))
        first = others if free is None else F.array_join(F.concat(F.array(others), free), "|")
        last = F.lit(r"\d{13,19}") if grouped is None else F.array_join(F.concat(grouped, F.array(F.lit(r"\d{13,19}"))), "|")
        return F.concat(F.lit(f"{BEFORE}(?:(?:"), first, F.lit(f"){AFTER}|(?:"), last, F.lit(f"){CARD_AFTER})"))

    spaced = F.transform(F.array(spaced_cards(value)), lambda c: F.when(F.size(c["grouped"]) + F.size(c["free"]) > 0, whole(c["free"], c["grouped"])))[0]
    return F.coalesce(F.when(value.rlike(CARD_AT), spaced), whole())


def phone(value: Column, key: Column) -> Column:
    """Area and exchange stay within 200 to 999, or below 200 where they are: such
    numbers are none of the numbering plan, but are written as if they were."""
    digits = F.substr(digits_of(value), F.lit(-10))
    area, exchange, line = (F.substr(digits, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (4, 3), (7, 4)))
    (area_from, areas), (exchange_from, exchanges) = ((F.when(n >= 200, 200).otherwise(0), F.when(n >= 200, 800).otherwise(200)) for n in (area, exchange))
    number = ((area - area_from).cast("bigint") * exchanges + (exchange - exchange_from)) * 10_000 + line
    low = exchanges * 100
    new = F.transform(F.array(feistel(_div(number, low), number % low, areas * 100, low, F.concat(key, F.lit("phone")))), lambda s: s["x"] * low + s["y"])
    text = F.transform(new, lambda n: F.concat(F.substr(digits_of(value), F.lit(1), F.length(digits_of(value)) - 10), padded(_div(n, exchanges * 10_000) + area_from, 3), padded(_div(n, 10_000) % exchanges + exchange_from, 3), padded(n % 10_000, 4)))
    return filled(value, text[0])


def ssn(value: Column, key: Column) -> Column:
    """Areas 001 to 899 but 666, groups from 01 and serials from 0001."""
    area, group, serial = (F.substr(value, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    place = area - 1 - (area > 666).cast("int")
    new = feistel(place * 99 + group - 1, serial - 1, 898 * 99, 9999, F.concat(key, F.lit("ssn")))

    def text(s: Column) -> Column:
        at = _div(s["x"], 99)
        return F.concat_ws("-", padded(at + 1 + (at >= 665).cast("int"), 3), padded(s["x"] % 99 + 1, 2), padded(s["y"] + 1, 4))

    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, F.transform(F.array(new), text)[0])


def ip(value: Column, key: Column) -> Column:
    """Octets of at most 255; what is written with leading zeros is no address."""
    parts = F.split(value, r"\.")
    o = [parts[i].cast("int") for i in range(4)]
    new = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, F.concat(key, F.lit("ip")))
    text = F.transform(F.array(new), lambda s: F.concat_ws(".", *((_div(h, 256) if top else h % 256).cast("string") for h in (s["x"], s["y"]) for top in (True, False))))
    return F.when((F.greatest(*o) <= 255) & ~value.rlike(r"(^|\.)0\d"), text[0])


def date(value: Column, key: Column) -> Column:
    """Real days of the years 0001 to 9599, written year first or month first."""
    iso = F.when(value.contains("-"), value).otherwise(F.concat_ws("-", F.substr(value, F.lit(7), F.lit(4)), F.substr(value, F.lit(1), F.lit(2)), F.substr(value, F.lit(4), F.lit(2))))
    day = iso.try_cast("date")
    low, high = CYCLE
    since = F.date_diff(day, F.lit(CYCLE_START).cast("date"))
    within = F.pmod(since, F.lit(low * high))
    new = feistel(_div(within, low), within % low, high, low, F.concat(key, F.lit("date")))
    moved = F.transform(F.array(new), lambda s: F.date_add(day, (s["x"] * low + s["y"] - within).cast("int")))[0]
    text = F.when(value.contains("-"), F.date_format(moved, "yyyy-MM-dd")).otherwise(F.date_format(moved, "MM/dd/yyyy"))
    return F.when(F.year(day).between(1, 9599) & F.year(moved).between(1, 9999), text)


def _mod97(text: Column) -> Column:
    def one(rest: Column, at: Column) -> Column:
        c = F.substr(text, at, F.lit(1))
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.reduce(F.sequence(F.lit(1), F.length(text)), F.lit(0), one)


def iban(value: Column, key: Column) -> Column:
    """The country stays, and the check digits are made anew."""
    bare = F.regexp_replace(value, " ", "")
    country, body = F.substr(bare, F.lit(1), F.lit(2)), F.substr(bare, F.lit(5))
    new = F.transform(F.array(feistel_text(body, F.concat(key, F.lit("iban"), country))), lambda s: F.concat(country, padded(98 - _mod97(F.concat(s, country, F.lit("00"))), 2), s))

    def spaced(s: Column) -> Column:
        def sign(at: Column) -> Column:
            place = F.length(F.regexp_replace(F.substr(value, F.lit(1), at), " ", ""))
            return F.when(F.substr(value, at, F.lit(1)) == " ", F.lit(" ")).otherwise(F.substr(s, place, F.lit(1)))

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), sign), "")

    valid = _mod97(F.concat(body, F.substr(bare, F.lit(1), F.lit(4)))) == 1
    return F.when(valid, F.transform(new, spaced)[0])


def email(value: Column, key: Column) -> Column:
    """The part before the @ is permuted sign by sign; the domain stays."""
    local = F.substring_index(value, "@", 1)
    return F.concat(feistel_text(local, F.concat(key, F.lit("email"))), F.substr(value, F.length(local) + 1))


def kind_of(value: Column) -> Column:
    """Which of the patterns a match is of: the first that takes the whole."""
    kinds = zip(KINDS, (EMAIL, PHONE, SSN, IPV4, DATE, IBAN, CARD))
    out = None
    for name, pattern in kinds:
        here = value.rlike(f"^(?:{pattern})$")
        out = F.when(here, name) if out is None else out.when(here, name)
    return out


def pseudonym(value: Column, kind: Column, key: Column) -> Column:
    """The pseudonym of a match, null where it does not pass its kind's check."""
    out = None
    for name, f in zip(KINDS, (email, phone, ssn, ip, date, iban, card)):
        out = F.when(kind == name, f(value, key)) if out is None else out.when(kind == name, f(value, key))
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", into: str = "text", counts: str = "n_private") -> DataFrame:
    """docs with the text's personal data replaced, in the column named into, and
    the number of values replaced of each kind, a map in the column named counts
    (kinds without any are left out). Columns of those names are replaced; all
    other columns and rows stay. A null text stays null. Ids play no part, so
    repeated and null ones are as they are. Values that fail their check stay,
    and so do texts without a value, empty ones too, to the byte; an empty table stays
    empty, and texts of any length are taken whole.
    """
    key_column = F.lit(key)
    value = F.col(text)
    held, pattern = "__found", "__pattern"
    while held in docs.columns:
        held += "_"
    while pattern in docs.columns:
        pattern += "_"
    matches = F.when(value.rlike("[0-9@]"), F.regexp_extract_all(value, F.col(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def one(match: Column) -> Column:
        return F.struct(match.alias("match"), kind_of(match).alias("kind"))

    def replaced(s: Column) -> Column:
        return F.struct(s["match"].alias("match"), s["kind"].alias("kind"), pseudonym(s["match"], s["kind"], key_column).alias("new"))

    found = F.transform(F.transform(matches, one), replaced)
    names = [c for c in docs.columns if c not in (into, counts)]
    # the patterns and the matches are made once, behind projections that are not merged into the next
    rows = docs.withColumn(pattern, pattern_of(value)).withColumn(held, found)
    new = F.col(held)
    between = F.split(value, F.col(pattern), -1)
    joined = F.array_join(F.zip_with(between, new, lambda part, s: F.concat(part, F.coalesce(s["new"], s["match"], F.lit("")))), "")
    hits = F.filter(new, lambda s: s["new"].isNotNull())

    def of(name: str) -> Column:
        return F.struct(F.lit(name), F.size(F.filter(hits, lambda s: s["kind"] == name)).cast("bigint"))

    count = F.map_filter(F.map_from_entries(F.array(*map(of, KINDS))), lambda _, n: n > 0)
    out = rows.select(*(F.col(f"`{c}`") for c in names), F.when(F.size(hits) > 0, joined).otherwise(value).alias(into), count.alias(counts))
    return out


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, key="waymark")
    counts = [F.coalesce(F.try_element_at("n_private", F.lit(k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", "text", *counts)
