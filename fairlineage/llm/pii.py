"""Pseudonyms for personal data that keep each value's format.

Method. One pattern finds candidates; a candidate counts only if it is valid for its kind (card numbers by their check
digit, addresses by their octets, dates by the calendar, account numbers by their remainder). A valid
value is a number of a finite domain, or a string over its characters' alphabets, and a keyed Feistel network permutes
that domain: two unequal halves are in turn shifted by a keyed hash of the other. So a pseudonym has the
format of its value and is valid again, different values get different pseudonyms, and equal values get equal
ones in all documents (a card with and without blanks, too), which keeps them linked.

Kinds: ``card`` (13 to 19 digits; blanks or hyphens between; also beside other numbers, where usual groupings go first), ``phone`` (ten digits with an area code),
``ip`` (four octets), ``ssn`` (3-2-4 digits), ``iban``, ``email`` (the part before the @; its domain stays) and
``date`` (1900 to 2099, year first or last). Row by row, no shuffle, only DataFrame functions.

Defined results: a null text stays null with no findings; empty texts stay empty; repeated rows are all returned; a
text of any length is treated whole; further columns are ignored, or carried by ``pseudonymised``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.sets import let

ROUNDS = 8
_FREE, _END = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
#: A host name up to its last label that begins with two letters. Loops over groups are possessive: the JVM runs these as loops, any other
#: loop over groups as calls in each other, which a long text would let overflow.
_OTHER = r"(?:\.(?![A-Za-z]{2})[A-Za-z0-9-]+)*+"
_HOST = r"[A-Za-z0-9-]+(?:" + _OTHER + r"\.[A-Za-z]{2}[A-Za-z0-9-]*+(?=" + _OTHER + r"\.[A-Za-z]{2}))*+" + _OTHER + r"\.[A-Za-z]{2,}"
#: How each kind is written.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@" + _HOST,
    "iban": _FREE + r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?" + _END,
    "date": _FREE + r"(?:(?:19|20)[0-9]{2}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2(?:19|20)[0-9]{2})" + _END,
    "ssn": _FREE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "phone": r"(?<![0-9A-Za-z])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}" + _END,
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "card": _FREE + r"[0-9](?:[-\x20]?[0-9]){12,18}" + _END,
}
KINDS = tuple(PATTERNS)
#: Shapes of cards in order: usual groupings and undivided numbers, and any other grouping. A card may stand beside other numbers,
#: so every start and end between two groups is tried.
USUAL = (r"[0-9]{4}(?:[-\x20][0-9]{4}){3}", r"[0-9]{4}[-\x20][0-9]{6}[-\x20][0-9]{4,5}", r"[0-9]{13,19}",
         r"[0-9]{4}(?:[-\x20][0-9]{4}){3}[-\x20][0-9]{3}")
UNUSUAL = tuple(r"[0-9](?:[-\x20]?[0-9]){%d}" % (n - 1) for n in (16, 15, 19, 14, 18, 13, 17))
#: All kinds in one pattern; a group per kind, whose back references are counted through.
_GROUPS = {kind: 1 + i + (2 if i > KINDS.index("date") else 0) for i, kind in enumerate(KINDS)}
ANY = "|".join(
    "(" + p.replace(r"\1", f"\\{_GROUPS['date'] + 1}").replace(r"\2", f"\\{_GROUPS['date'] + 2}") + ")"
    for p in PATTERNS.values())
OTHERS = ANY[:ANY.rindex("|(" + PATTERNS["card"])]


def _shift(key: str, kind: str, tag: Column, half: Column) -> Column:
    """Keyed hash of (kind, tag, half) as a number below 2^48."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), tag.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def feistel(number: Column, left: int, right: int, key: str, kind: str) -> Column:
    """Image of ``number`` under a keyed permutation of 0 … left*right-1."""
    def one(s: Column, r: Column) -> Column:
        new_left = F.pmod(s["l"] + _shift(key, kind, F.concat(r, F.lit("l")), s["r"]), F.lit(left).cast("long"))
        return F.struct(new_left.alias("l"), s["r"].alias("r"))

    def two(s: Column, r: Column) -> Column:
        new_right = F.pmod(s["r"] + _shift(key, kind, F.concat(r, F.lit("r")), s["l"]), F.lit(right).cast("long"))
        return F.struct(s["l"].alias("l"), new_right.alias("r"))

    start = F.struct((F.floor(number / right)).cast("long").alias("l"), F.pmod(number, F.lit(right).cast("long")).alias("r"))
    steps = F.sequence(F.lit(1), F.lit(2 * ROUNDS))
    return F.aggregate(
        steps, start, lambda s, r: F.when(r % 2 == 1, one(s, r.cast("string"))).otherwise(two(s, r.cast("string"))),
        lambda s: s["l"] * right + s["r"])


def feistel_text(text: Column, key: str, kind: str) -> Column:
    """A string permuted within the alphabets of its characters (small, capital, digit; others stay)."""
    def shifted(part: Column, tag: Column, other: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            def inside(first: str, size: int) -> Column:
                step = F.pmod(F.ascii(c) - ord(first) + _shift(key, kind, F.concat_ws(":", tag, i), other), F.lit(size).cast("long"))
                return F.char(step + ord(first))
            return (F.when(c.between("a", "z"), inside("a", 26)).when(c.between("A", "Z"), inside("A", 26))
                    .when(c.between("0", "9"), inside("0", 10)).otherwise(c))
        return F.array_join(F.transform(F.filter(F.split(part, ""), lambda c: c != ""), one), "")

    half = F.floor(F.char_length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.char_length(text)).alias("r"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start,
        lambda s, r: F.when(r % 2 == 1, F.struct(shifted(s["l"], r, s["r"]).alias("l"), s["r"].alias("r")))
        .otherwise(F.struct(s["l"].alias("l"), shifted(s["r"], r, s["l"]).alias("r"))),
        lambda s: F.concat(s["l"], s["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _filled(pattern_text: Column, digits: Column) -> Column:
    """``pattern_text`` with its digits, one after the other, replaced by ``digits``."""
    return F.aggregate(
        F.filter(F.split(pattern_text, ""), lambda c: c != ""), F.struct(F.lit(0).alias("i"), F.lit("").alias("out")),
        lambda s, c: F.when(c.between("0", "9"), F.struct(
            (s["i"] + 1).alias("i"), F.concat(s["out"], F.substring(digits, s["i"] + 1, F.lit(1))).alias("out")))
        .otherwise(F.struct(s["i"].alias("i"), F.concat(s["out"], c).alias("out"))),
        lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled (and cast out)."""
    terms = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x)


def _remainder(text: Column) -> Column:
    """Remainder by 97 of digits and letters (A is 10) read as one number."""
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _is_card(value: Column) -> Column:
    digits = _digits(value)
    return (_luhn(digits) % 10 == 0) & (F.regexp_replace(digits, "0", "") != "")


def _cards(text: Column, shapes: tuple[str, ...]) -> Column:
    """A pattern that finds the valid cards of these shapes in this text, and nothing if it has none."""
    # looked ahead for, so that an invalid number hides none that begins within it
    seen = F.concat(*[F.regexp_extract_all(text, F.lit(f"{_FREE}(?=({s}){_END})"), F.lit(1)) for s in shapes])
    valid = F.array_distinct(F.filter(seen, _is_card))
    return F.when(F.size(valid) > 0, F.concat(F.lit(_FREE + "(?:"), F.array_join(valid, "|"), F.lit(")" + _END))).otherwise("(?!)")


def _card(value: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(value)
    size = F.char_length(digits)
    valid = _is_card(value)
    # the first digit says whose card it is and stays, the last one follows from the others
    body = F.concat(F.substring(digits, 1, 1), feistel_text(F.substring(digits, F.lit(2), size - 2), key, "card"))
    check = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return valid, _filled(value, F.concat(body, check))


def _phone(value: Column, key: str) -> tuple[Column, Column]:
    number = feistel(_digits(value).cast("long"), 100_000, 100_000, key, "phone")
    return F.lit(True), _filled(value, F.lpad(number.cast("string"), 10, "0"))


def _ip(value: Column, key: str) -> tuple[Column, Column]:
    parts = F.transform(F.split(value, r"\."), lambda p: p.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    out = feistel(number, 65_536, 65_536, key, "ip")
    octets = [(F.shiftright(out, 8 * i) % 256).cast("string") for i in (3, 2, 1, 0)]
    return F.forall(parts, lambda p: p < 256), F.concat_ws(".", *octets)


def _ssn(value: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.element_at(F.split(value, "-"), i).cast("long") for i in (1, 2, 3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1) * 9999 + serial - 1
    out = feistel(index, 898, 99 * 9999, key, "ssn")
    high = F.floor(out / (99 * 9999)).cast("long") + 1
    high = high + F.when(high >= 666, 1).otherwise(0)
    return valid, F.concat_ws("-", F.lpad(high.cast("string"), 3, "0"),
                              F.lpad((F.floor(out / 9999).cast("long") % 99 + 1).cast("string"), 2, "0"),
                              F.lpad((out % 9999 + 1).cast("string"), 4, "0"))


def _iban(value: Column, key: str) -> tuple[Column, Column]:
    plain = F.regexp_replace(value, r"\x20", "")
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.char_length(plain))
    new = feistel_text(body, key, "iban")
    check = 98 - _remainder(F.concat(new, country, F.lit("00")))
    whole = F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)
    letters = F.aggregate(
        F.filter(F.split(value, ""), lambda c: c != ""), F.struct(F.lit(0).alias("i"), F.lit("").alias("out")),
        lambda s, c: F.when(c == " ", F.struct(s["i"].alias("i"), F.concat(s["out"], c).alias("out")))
        .otherwise(F.struct((s["i"] + 1).alias("i"), F.concat(s["out"], F.substring(whole, s["i"] + 1, F.lit(1))).alias("out"))),
        lambda s: s["out"])
    return _remainder(F.concat(body, F.substring(plain, 1, 4))) == 1, letters


def _email(value: Column, key: str) -> tuple[Column, Column]:
    at = F.split(value, "@", 2)
    return F.lit(True), F.concat_ws("@", feistel_text(at[0], key, "email"), at[1])


#: 1900-01-01 to 2099-12-31 are 17 * 4297 days.
DAYS = (17, 4297)


def _date(value: Column, key: str) -> tuple[Column, Column]:
    digits, mark = _digits(value), F.substring(F.regexp_replace(value, "[0-9]", ""), 1, 1)
    first = F.substring(value, 1, 4).rlike("^[0-9]{4}$")
    day_first = F.try_to_timestamp(F.concat(F.substring(digits, 5, 4), F.substring(digits, 3, 2), F.substring(digits, 1, 2)),
                                   F.lit("yyyyMMdd")).cast("date")
    month_first = F.try_to_timestamp(F.concat(F.substring(digits, 5, 4), F.substring(digits, 1, 4)), F.lit("yyyyMMdd")).cast("date")
    day = F.when(first, F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")).otherwise(F.coalesce(day_first, month_first))
    number = feistel(F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long"), *DAYS, key, "date")
    new = F.date_add(F.lit("1900-01-01").cast("date"), number.cast("int"))
    shaped = F.when(first, F.date_format(new, "yyyyMMdd")).when(
        day_first.isNotNull(), F.date_format(new, "ddMMyyyy")).otherwise(F.date_format(new, "MMddyyyy"))
    widths = F.when(first, F.array(F.lit(4), F.lit(2), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(2), F.lit(4)))
    a, b = widths[0], widths[1]
    return day.isNotNull(), F.concat(F.substring(shaped, F.lit(1), a), mark, F.substring(shaped, a + 1, b), mark,
                                     F.substring(shaped, a + b + 1, widths[2]))


MAKERS = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "phone": _phone, "ip": _ip, "card": _card}


def findings(text: Column, any_: Column, values: Column, groups: dict[str, Column], key: str) -> Column:
    """Array of (between, kind, value, pseudonym) of a text, ending with the text after the last candidate.

    ``any_`` is the text's pattern of candidates, ``values`` its matches and ``groups`` what each kind's group matched. ``kind`` is null, and ``pseudonym`` the value itself, where a candidate is not valid. Cards of
    unusual groupings are sought in what is left between all other findings.
    """
    named = F.transform(values, lambda v, i: F.struct(v.alias("value"), F.coalesce(
        *[F.when(groups[k][i] != "", F.lit(k)) for k in KINDS]).alias("kind")))

    def treated(m: Column) -> Column:
        value = m["value"]
        kind, new = F.lit(None).cast("string"), value
        for name, maker in MAKERS.items():
            valid, made = maker(value, key)
            kind = F.when((m["kind"] == name) & valid, F.lit(name)).otherwise(kind)
            new = F.when((m["kind"] == name) & valid, made).otherwise(new)
        return F.struct(kind.alias("kind"), value.alias("value"), new.alias("pseudonym"))

    def entry(between: Column, kind: Column, value: Column, new: Column) -> Column:
        return F.struct(between.alias("between"), kind.alias("kind"), value.alias("value"), new.alias("pseudonym"))

    def with_unusual(e: Column) -> Column:
        between = e["between"]
        cards = _cards(between, UNUSUAL)
        parts, inside = F.split(between, cards, -1), F.regexp_extract_all(between, cards, F.lit(0))
        found = F.zip_with(F.slice(parts, 1, F.size(inside)), inside, lambda part, v: entry(part, F.lit("card"), v, _card(v, key)[1]))
        return F.when(between.rlike(PATTERNS["card"]), F.concat(
            found, F.array(entry(F.element_at(parts, -1), e["kind"], e["value"], e["pseudonym"])))).otherwise(F.array(e))

    usual = F.zip_with(F.split(text, any_, -1), F.transform(named, treated),
                       lambda part, m: entry(part, m["kind"], m["value"], m["pseudonym"]))
    return F.flatten(F.transform(usual, with_unusual))


def _found(docs: DataFrame, carried: list[str], key: str, text: str) -> DataFrame:
    """(row struct of the carried columns, text, found): ``found`` is null where a text has no candidate."""
    body = F.col("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col(text).alias("text"))
    some = body.rlike("[0-9]|@") & body.rlike(ANY)
    pattern = F.concat(F.lit(OTHERS + "|("), _cards(body, USUAL), F.lit(")"))

    def matches(any_: Column) -> Column:
        return F.struct(any_.alias("any"), F.regexp_extract_all(body, any_, F.lit(0)).alias("values"),
                        *[F.regexp_extract_all(body, any_, F.lit(_GROUPS[k])).alias(k) for k in KINDS])

    # bound by let, as the optimizer would put columns of their own back into the lambda that reads them for every match
    found = let(let(pattern, matches), lambda m: findings(body, m["any"], m["values"], {k: m[k] for k in KINDS}, key))
    return rows.withColumn("found", F.when(some, found))


def _rebuilt() -> Column:
    return F.when(F.col("found").isNull(), F.col("text")).otherwise(F.array_join(F.transform(
        "found", lambda f: F.concat(f["between"], F.coalesce(f["pseudonym"], F.lit("")))), ""))


def pseudonymised(docs: DataFrame, key: str = "fairlineage", text: str = "text") -> DataFrame:
    """All rows and columns, with personal data in the text replaced by pseudonyms."""
    found = _found(docs, docs.columns, key, text)
    return found.select(F.col("row").withField(text, _rebuilt()).alias("row")).select("row.*")


def personal_data(docs: DataFrame, key: str = "fairlineage", row_key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_key, n_<kind> for every kind, n_found, text with pseudonyms) of every row."""
    found = _found(docs, [row_key], key, text)
    count = lambda kind: F.size(F.filter("found", lambda f: f["kind"] == kind))
    counted = found.select(
        F.col("row")[row_key].alias(row_key),
        *[F.when(F.col("found").isNull(), 0).otherwise(count(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        _rebuilt().alias("text"))
    return counted.select(row_key, *[f"n_{k}" for k in KINDS],
                          sum((F.col(f"n_{k}") for k in KINDS), F.lit(0).cast("long")).alias("n_found"), "text")
