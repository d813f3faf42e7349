r"""Personal numbers, dates and addresses replaced by pseudonyms of the same format.

A pseudonym is a keyed permutation (Feistel network) of the value inside its format, so equal
values get equal pseudonyms in all documents and different values different ones:

* payment cards (13 to 19 digits, single blanks or hyphens between any of them, check digit right;
  within a longer row of digits or in unusual groups also an issuer's first digits and length):
  all digits but the first, new check digit
* account numbers (two letters, two check digits, as long as the country's are, right modulo 97):
  letters and digits after the country, new check digits
* social security numbers (area not 000, 666, 9xx; group not 00; serial not 0000): permuted
  among the valid ones
* telephone numbers: national ones of the form (ddd) ddd-dddd with area and exchange from 200 on,
  permuted among those; international ones from ``+``, 8 to 15 digits, all but the first two
* addresses of four numbers up to 255: permuted among those
* calendar dates from 1900-01-01 on for 73,000 days, year first or last, days before months if
  only that is a date or the separator is a dot, also before a time: permuted among those days
* e-mail addresses, in lower case: letters and digits of the local part

Whatever does not pass its check stays as it is, as does all other text. The separators of a value
stay, and only its digits and letters count, so one number written in two ways keeps its link.
Null texts stay null. Columns are kept inside ``row``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", (250, 292)
# Signs of an account number by country (ISO 13616).
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
ACCOUNTS = "|".join(f"(?:{'|'.join(lands.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, lands in LENGTHS.items())
# Patterns of candidates, tried in this order at each place. Fixed values.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}(?![A-Za-z0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{ACCOUNTS}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])",
    "date": r"(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\SEP[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\SEP[0-9]{4})(?!(?!T[0-9]{2})\w|[-/.][0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<!\w)(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])",
    "abroad": r"(?<![\w+])\+[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?!\w)",
}
PATTERNS["date"] = PATTERNS["date"].replace(r"([-/.])", "[-/.]").replace(r"\SEP", "[-/.]")
# Groups of digits, one by one: the first of 13 digits or more that at most single blanks or hyphens part, and what
# goes on from the match before, unless another value begins there.
GROUP = (r"(?:\G[ -](?!" + "|".join(PATTERNS[k] for k in ("email", "ip", "date", "ssn", "phone"))
         + r")|(?<![\w+])(?=[0-9](?:[ -]?[0-9]){12}))[0-9]++(?!\w)")
ANY = "|".join([*PATTERNS.values(), GROUP])
# Usual groups of a card, and first digits and lengths of the issuers (ISO 7812).
USUAL = "^(?:[0-9]+|[0-9]{4}(?:[ -][0-9]{4}){2,3}|[0-9]{4}(?:[ -][0-9]{4}){2,3}[ -][0-9]{1,3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
ISSUERS = (
    "^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}"
    "|3(?:0[0-59]|[689][0-9])[0-9]{11,16}|35(?:2[89]|[3-8][0-9])[0-9]{12,15}|(?:5[06-8]|6[0-9])[0-9]{11,17})$")
LONGEST, SHORTEST = 19, 13  # digits of a card


def bound(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def keyed(key: str, kind: str, turn: Column, value: Column) -> Column:
    """48 bits of a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("/", F.lit(key), F.lit(kind), turn, value), 256), 1, 12), 16, 10).cast("long")


def permuted_pair(key: str, kind: str, left: Column, right: Column, n_left: int, n_right: int) -> Column:
    """A keyed permutation of pairs (left < n_left, right < n_right); a struct of both."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")),
        lambda s, i: F.when(i % 2 == 1, F.struct(((s["l"] + keyed(key, kind, i, s["r"])) % n_left).alias("l"), s["r"].alias("r")))
        .otherwise(F.struct(s["l"].alias("l"), ((s["r"] + keyed(key, kind, i, s["l"])) % n_right).alias("r"))))


def permuted_signs(key: str, kind: str, text: Column) -> Column:
    """A keyed permutation of strings that keeps each sign's class: digit, small or capital letter, other."""

    def turned(part: Column, digest: Column) -> Column:
        def sign(c: Column, i: Column) -> Column:
            more = F.conv(F.substring(F.sha2(F.concat_ws("/", digest, i), 256), 1, 8), 16, 10).cast("long")
            move = lambda low, n: F.char(F.lit(low) + (F.ascii(c) - low + more) % n)
            return F.when(c.between("0", "9"), move(48, 10)).when(c.between("a", "z"), move(97, 26)).when(c.between("A", "Z"), move(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.filter(F.split(part, ""), lambda x: x != ""), sign), "")

    def digest(turn: Column, other: Column) -> Column:
        return F.concat_ws("/", F.lit(key), F.lit(kind), turn, F.length(other), other)

    def rounds(text: Column) -> Column:
        half = F.floor(F.length(text) / 2).cast("int")
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r")),
            lambda s, i: F.when(i % 2 == 1, F.struct(bound(digest(i, s["r"]), lambda d: turned(s["l"], d)).alias("l"), s["r"].alias("r")))
            .otherwise(F.struct(s["l"].alias("l"), bound(digest(i, s["l"]), lambda d: turned(s["r"], d)).alias("r"))),
            lambda s: F.concat(s["l"], s["r"]))

    return bound(text, rounds)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def filled(shape: Column, kept: str, signs: Column) -> Column:
    """``shape`` with its signs of class ``kept`` replaced by ``signs`` in order."""
    other = f"[^{kept}]"
    cells = F.filter(F.split(shape, ""), lambda x: x != "")
    return bound(signs, lambda new: F.array_join(F.transform(cells, lambda c, i: F.when(
        F.regexp_like(c, F.lit(f"[{kept}]")), F.substring(new, F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), other, "")), F.lit(1))).otherwise(c)), ""))


def luhn(digits: Column) -> Column:
    """Sum of the check rule over all digits, doubled from the last but one on."""

    def total(text: Column) -> Column:
        def part(i: Column) -> Column:
            d = F.substring(text, i, F.lit(1)).cast("int") * F.when((F.length(text) - i) % 2 == 1, 2).otherwise(1)
            return F.when(d > 9, d - 9).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), lambda s, i: s + part(i))

    return bound(digits, total)


def mod97(signs: Column) -> Column:
    """Remainder of an account number, its first four signs moved to the end."""
    moved = bound(signs, lambda s: F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, F.lit(1), F.lit(4))))

    def step(s: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda x: x != ""), F.lit(0), step)


def _card(key: str, token: Column) -> Column:
    d = digits_of(token)
    n = F.length(d)
    body = F.concat(F.substring(d, F.lit(1), F.lit(1)), permuted_signs(key, "card", F.substring(d, F.lit(2), n - 2)))
    new = bound(body, lambda b: F.concat(b, ((10 - luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return filled(token, "0-9", new)


def _is_group(token: Column) -> Column:
    return F.regexp_like(token, F.lit("^[ -]?[0-9]+$"))


def chained(hits: Column) -> Column:
    """Groups of digits with a bar before each that begins a row of groups; a bar for other hits."""
    return F.transform(hits, lambda x, i: F.when(~_is_group(x), "|").when(
        F.regexp_like(x, F.lit("^[ -]")) & (i > 0) & F.coalesce(_is_group(F.get(hits, i - 1)), F.lit(False)), x).otherwise(F.concat(F.lit("|"), x)))


def cards(key: str, hits: Column, chain: Column) -> Column:
    """(i, n, text) of the cards in rows of groups: first group, groups, pseudonym.

    From each group on, the longest number that passes is taken, one in usual groups before others.
    One group, or usual groups from the start of a row, need the check digit; any other part of a
    row needs an issuer's first digits and length as well.
    """

    def best(at: Column, i: Column) -> Column:
        row = F.regexp_replace(F.concat_ws("", F.slice(chain, i + 1, LONGEST)), r"^\|?[ -]?", "")
        first = F.startswith(at, F.lit("|"))

        def judged(text: Column) -> Column:
            usual = F.regexp_like(text, F.lit(USUAL))
            shaped = F.regexp_like(text, F.lit("^[0-9]+$")) | (usual & first) | F.regexp_like(digits_of(text), F.lit(ISSUERS))
            good = (text != "") & shaped & F.regexp_like(text, F.lit("[1-9]")) & (luhn(digits_of(text)) % 10 == 0)
            return F.when(good, F.struct(i.alias("i"), (F.length(F.regexp_replace(text, "[0-9]", "")) + 1).alias("n"), text.alias("text"), usual.alias("usual")))

        found = bound(row, lambda row: F.when(F.length(row) >= SHORTEST, F.filter(F.transform(F.array(*tries_of(row)), judged), lambda w: w.isNotNull())))
        return bound(found, lambda ws: F.coalesce(F.get(F.filter(ws, lambda w: w["usual"]), 0), F.get(ws, 0)))

    def tries_of(row: Column) -> list[Column]:
        return [F.regexp_extract(row, rf"^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])", 0) for n in range(LONGEST, SHORTEST - 1, -1)]

    def chosen(all_of: Column) -> Column:
        apart = lambda a, w: (a["i"] >= w["i"] + w["n"]) | (w["i"] >= a["i"] + a["n"])
        order = F.concat(F.filter(all_of, lambda w: w["usual"]), F.filter(all_of, lambda w: ~w["usual"]))
        return F.aggregate(order, F.filter(all_of, lambda w: F.lit(False)), lambda acc, w: F.when(F.forall(acc, lambda a: apart(a, w)), F.concat(acc, F.array(w))).otherwise(acc))

    found = F.filter(F.transform(chain, lambda c, i: F.when(F.length(c) > 1, best(c, i))), lambda w: w.isNotNull())
    return F.transform(bound(found, chosen), lambda w: F.struct(w["i"].alias("i"), w["n"].alias("n"), _card(key, w["text"]).alias("text")))


def _iban(key: str, token: Column) -> tuple[Column, Column]:
    s = F.replace(token, F.lit(" "), F.lit(""))
    land, rest = F.substring(s, F.lit(1), F.lit(2)), F.substring(s, F.lit(5), F.length(s))
    check = lambda r: F.lpad((98 - mod97(F.concat(land, F.lit("00"), r))).cast("string"), 2, "0")
    new = bound(permuted_signs(key, "iban", rest), lambda r: F.concat(land, check(r), r))
    return (mod97(s) == 1), filled(token, "A-Z0-9", new)


def _ip(key: str, token: Column) -> tuple[Column, Column]:
    part = lambda i: F.element_at(F.split(token, r"\."), i).cast("int")
    new = permuted_pair(key, "ip", part(1) * 256 + part(2), part(3) * 256 + part(4), 65536, 65536)
    text = bound(new, lambda p: F.concat_ws(".", F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256))
    return F.greatest(*[part(i) for i in (1, 2, 3, 4)]) <= 255, text


def _ssn(key: str, token: Column) -> tuple[Column, Column]:
    area, group, serial = (F.substring(token, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    good = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    new = permuted_pair(key, "ssn", place * 99 + group - 1, serial - 1, 898 * 99, 9999)
    area_at = lambda at: F.when(at >= 665, at + 2).otherwise(at + 1)
    return good, bound(new, lambda p: F.format_string("%03d-%02d-%04d", area_at(F.floor(p["l"] / 99)), p["l"] % 99 + 1, p["r"] + 1))


def _phone(key: str, token: Column) -> tuple[Column, Column]:
    d = digits_of(token)
    lead, ten = F.substring(d, F.lit(1), F.length(d) - 10), F.substring(d, F.length(d) - 9, F.lit(10))
    area, exchange, line = (F.substring(ten, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (4, 3), (7, 4)))
    new = permuted_pair(key, "phone", area - 200, (exchange - 200) * 10000 + line, 800, 8_000_000)
    text = bound(new, lambda p: F.concat(lead, F.format_string("%03d%07d", p["l"] + 200, p["r"] + 2_000_000)))
    return (area >= 200) & (exchange >= 200), filled(token, "0-9", text)


def _abroad(key: str, token: Column) -> tuple[Column, Column]:
    d = digits_of(token)
    return F.length(d).between(8, 15), filled(token, "0-9", F.concat(F.substring(d, F.lit(1), F.lit(2)), permuted_signs(key, "abroad", F.substring(d, F.lit(3), F.length(d)))))


def _date(key: str, token: Column) -> tuple[Column, Column]:
    parts = F.split(token, "[-/.]")
    a, b, c = (F.element_at(parts, i) for i in (1, 2, 3))
    first = F.length(a) == 4
    try_date = lambda y, m, d: F.to_date(F.try_to_timestamp(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")))
    same = F.regexp_extract(token, "[-/.]", 0) == F.regexp_extract(F.reverse(token), "[-/.]", 0)
    month_first, day_first = try_date(c, a, b), try_date(c, b, a)
    dotted = F.instr(token, ".") > 0
    by_day = ~first & ((dotted & day_first.isNotNull()) | month_first.isNull())
    found = F.when(first, try_date(a, b, c)).when(by_day, day_first).otherwise(month_first)
    n = F.datediff(found, F.lit(FIRST_DAY).cast("date"))
    new = permuted_pair(key, "date", F.floor(n / DAYS[1]), n % DAYS[1], *DAYS)
    to = bound(new, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS[1] + p["r"]).cast("int")))
    shaped = lambda d: F.when(first, F.date_format(d, "yyyy-MM-dd")).when(by_day, F.date_format(d, "dd-MM-yyyy")).otherwise(F.date_format(d, "MM-dd-yyyy"))
    text = F.replace(bound(to, shaped), F.lit("-"), F.regexp_extract(token, "[-/.]", 0))
    return same & found.isNotNull() & (n >= 0) & (n < DAYS[0] * DAYS[1]), text


def _email(key: str, token: Column) -> tuple[Column, Column]:
    token = F.lower(token)
    return F.lit(True), F.concat(permuted_signs(key, "email", F.substring_index(token, "@", 1)), F.lit("@"), F.substring_index(token, "@", -1))


KINDS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "abroad": _abroad}


def replacement(key: str, token: Column) -> Column:
    """(kind, text) of one candidate; a null kind if it fails its check."""
    out = None
    for kind, pattern in PATTERNS.items():
        good, text = KINDS[kind](key, token)
        this = F.when(good, F.struct(F.lit(kind).alias("kind"), text.alias("text"))).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), token.alias("text")))
        fits = F.regexp_like(token, F.lit(f"^(?:{pattern})$"))
        out = F.when(fits, this) if out is None else out.when(fits, this)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), token.alias("text")))


def pseudonymised(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(row, masked, kinds): the text with pseudonyms, and the kinds of its values in order."""
    body = F.col(f"row.`{text}`").cast("string")
    rows = docs.select(F.struct("*").alias("row"))
    hits = F.when(F.regexp_like(body, F.lit("[0-9@]")), F.regexp_extract_all(body, F.lit(ANY), F.lit(0)))
    rows = rows.select("row", hits.alias("hits"))
    rows = rows.select("row", "hits", chained(F.col("hits")).alias("chain"))
    rows = rows.select("row", "hits", F.when(F.exists("chain", lambda c: F.length(c) > 1), cards(key, F.col("hits"), F.col("chain"))).alias("cards"))

    def new(found: Column) -> Column:
        def piece(token: Column, i: Column) -> Column:
            def woven(card: Column) -> Column:
                lead, none = F.regexp_extract(token, "^[ -]?", 0), F.lit(None).cast("string")
                return (F.when(card["i"] == i, F.struct(F.lit("card").alias("kind"), F.concat(lead, card["text"]).alias("text")))
                        .when(card.isNotNull(), F.struct(none.alias("kind"), F.lit("").alias("text")))
                        .when(_is_group(token), F.struct(none.alias("kind"), token.alias("text"))).otherwise(replacement(key, token)))

            return bound(F.get(F.filter(found, lambda c: (c["i"] <= i) & (i < c["i"] + c["n"])), 0), woven)

        return F.transform("hits", piece)

    rows = rows.select("row", bound(F.col("cards"), new).alias("new"))  # bound: the cards are sought once, not for each hit
    gaps = F.split(body, ANY)
    woven = F.array_join(F.zip_with(gaps, "new", lambda gap, n: F.concat(gap, F.coalesce(n["text"], F.lit("")))), "")
    kinds = F.filter(F.transform("new", lambda n: n["kind"]), lambda k: k.isNotNull())
    return rows.select("row", F.when(F.size("new") > 0, woven).otherwise(body).alias("masked"), F.coalesce(kinds, F.array().cast("array<string>")).alias("kinds"))


__all__ = ["PATTERNS", "permuted_pair", "permuted_signs", "pseudonymised"]
