"""Format-preserving pseudonyms by Feistel networks, in SQL functions only.

Numbers and dates that pass validation are replaced by others of the same format: same length, same
separators, valid again. A keyed Feistel network permutes all values of a format, so equal values
get equal pseudonyms in every document, however written, different values different ones, and the key
turns them back (``reveal``).

- Cards: 13 to 19 digits with a valid Luhn digit; the digits before it are permuted, it is computed anew.
  In a run of numbers (a card beside a security code, a date, another card) each number is tried as a
  card's begin, in the groupings of ``CARDS`` in their order. Equal cards get equal pseudonyms there, too;
  the price is that a pseudonym can by chance (1 in 10 for each other reading of such a run, such as with
  a group of four digits before the card) form a card with its neighbours, and ``reveal`` misreads that run.
- IBANs: two letters, mod-97 valid, up to 30 letters and digits behind the check digits; the digits are
  permuted and the check digits computed anew. Country, length and letters stay. An account with letters
  may be grouped by spaces if the country is one of ``IBAN_LENGTHS``.
- Phone numbers: ``+`` and 8 to 15 digits; the country's first digit stays. A number of another kind, or
  with decimals, behind them is not theirs; +1 has ten digits behind it.
- Social security numbers ddd-dd-dddd with valid fields; serial and group are permuted within 1..n.
- Dates yyyy-mm-dd from 1900-01-01 on for 270 x 270 days (to 2099); others and impossible ones stay.
- IPv4 addresses: 32 bits in two halves; a number of the four may get more or fewer digits.

A text is cut at its matches and joined again, so its length does not matter and no row leaves its task.
Null texts stay null, empty ones empty. Repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.operators.parsing import once

ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", 270

# Lengths of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _account(size: int) -> str:
    """Letters and digits in groups of four, with or without spaces."""
    rest = rf"(?:\x20?[A-Z0-9]{{{size % 4}}})" if size % 4 else ""
    return rf"(?:\x20?[A-Z0-9]{{4}}){{{size // 4}}}{rest}"


# A country's own length; else any length, in one piece or with digits only.
_IBAN = (r"(?<![A-Za-z0-9])(?:"
         + "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}{_account(size - 4)}(?![A-Za-z0-9])" for size, names in IBAN_LENGTHS.items())
         + r"|[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}(?![A-Za-z0-9])"
         + r"|[A-Z]{2}[0-9]{2}(?:\x20?[0-9]{4}){2,7}(?:\x20?[0-9]{1,3})?(?![A-Za-z0-9]))")
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
_IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"
# What a number with separators must not run into.
_OTHER = f"(?!{_SSN}|{_DATE}|{_IP})"
# How cards are written: the first of these whose Luhn digit is right counts.
CARDS = (
    r"[0-9]{13,19}", r"[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}", r"[0-9]{4}([\x20-])[0-9]{6}\1[0-9]{4,5}",
    r"[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{5}", r"[0-9]{8}[\x20-][0-9]{8}", r"[0-9]{6}[\x20-][0-9]{13}",
    r"[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}\1[0-9]{1,3}",
)
# A card right behind a phone number, with nothing behind it that could be its last group.
_CARD_NEXT = (r"(?=[\x20-](?:[0-9]{13,19}(?![0-9])|[0-9]{4}(?<s>[\x20-])[0-9]{4}\k<s>[0-9]{4}\k<s>[0-9]{4}(?![0-9]|\k<s>[0-9]{4}(?![0-9]))"
              r"|[0-9]{4}(?<t>[\x20-])[0-9]{6}\k<t>[0-9]{4,5}(?![0-9])))")
_PHONE_END = r"(?![0-9]|\.[0-9])"
_STEP = r"(?:(?!\.\x20)[\x20().-]{0,2}" + _OTHER + "[0-9])"
# One alternative per kind, the most specific first; a digit or letter on either side
# means that the match is part of something longer. Phone numbers: before a card; the North American
# grouping; one separator style; any. Cards: all numbers joined by spaces or hyphens, to be cut into cards.
PATTERNS = {
    "iban": _IBAN,
    "ssn": _SSN,
    "date": _DATE,
    "ip": _IP,
    "phone": (r"(?<![0-9+])\+(?:[0-9]" + _STEP + "{7,14}?" + _CARD_NEXT
              + r"|1[\x20.-]?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}" + _PHONE_END
              + r"|[0-9](?:\.?[0-9]){7,14}" + _PHONE_END
              + r"|[0-9](?:[\x20()-]{0,2}" + _OTHER + "[0-9]){7,14}" + _PHONE_END
              + "|[0-9]" + _STEP + "{7,14}(?![0-9]))"),
    "card": r"(?<![0-9.-])(?=[0-9](?:[\x20-]?[0-9]){12})[0-9]++(?:[\x20-]" + _OTHER + "[0-9]++)*+",
}
KINDS = tuple(PATTERNS)
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _power(n: Column) -> Column:
    """10^n as a whole number, n up to 17."""
    return F.element_at(F.array(*[F.lit(10**i) for i in range(18)]), n + 1)


def _round_value(key: str, tag: Column, turn: Column, half: Column) -> Column:
    """60 keyed bits of a round."""
    text = F.concat_ws("|", F.lit(key), tag, turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def _permute(left: Column, right: Column, a: Column, b: Column, key: str, tag: Column, back: bool) -> Column:
    """Struct (l, r): the pair (left below a, right below b) after ROUNDS keyed rounds, or before them."""
    def step(s: Column, i: Column) -> Column:
        turn = F.lit(ROUNDS) - 1 - i if back else i
        sign = -1 if back else 1
        even = turn % 2 == 0
        other = F.when(even, s["r"]).otherwise(s["l"])
        value = _round_value(key, tag, turn, other)
        return F.struct(
            F.when(even, F.pmod(s["l"] + F.lit(sign) * (value % a), a)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.lit(sign) * (value % b), b)).alias("r"))

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_digits(text: Column, key: str, tag: str, back: bool = False) -> Column:
    """A string of 2 to 34 digits, permuted among all strings of its length."""
    size = F.length(text)
    cut = F.floor(size / 2).cast("int")
    a, b = _power(cut), _power(size - cut)
    pair = _permute(F.substring(text, F.lit(1), cut), F.substring(text, cut + 1, size), a, b, key,
                    F.concat(F.lit(tag), size.cast("string")), back)
    out = F.transform(F.array(pair), lambda p: F.concat(
        F.lpad(p["l"].cast("string"), cut, F.lit("0")), F.lpad(p["r"].cast("string"), size - cut, F.lit("0"))))
    return F.when(size >= 2, out[0]).otherwise(text)


def _refill(shape: Column, digits: Column) -> Column:
    """The digits put where digits are in ``shape``."""
    signs = F.split(shape, "")
    filled = F.aggregate(signs, F.struct(F.lit("").alias("t"), F.lit(1).alias("i")), lambda s, c: F.struct(
        F.concat(s["t"], F.when(c.rlike("^[0-9]$"), F.substring(digits, s["i"], F.lit(1))).otherwise(c)).alias("t"),
        (s["i"] + c.rlike("^[0-9]$").cast("int")).alias("i")))
    return filled["t"]


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn sum of a digit string; whether its last digit counts twice."""
    size = F.length(digits)
    values = F.transform(F.split(digits, ""), lambda c, i: F.when(
        ((size - 1 - i) % 2 == (0 if double_last else 1)), F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
        .otherwise(c.cast("int")))
    return F.aggregate(F.filter(values, lambda v: v.isNotNull()), F.lit(0), lambda s, v: s + v)


def _mod97(text: Column) -> Column:
    """Digits and capitals, read as one number with A as 10, modulo 97."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda s, c: F.when(
        c.rlike("^[0-9]$"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def _card(m: Column, key: str, back: bool) -> Column:
    digits = _digits(m)
    payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
    moved = permute_digits(payload, key, "card", back)
    full = F.transform(F.array(moved), lambda p: F.concat(p, ((F.lit(10) - _luhn_sum(p, True) % 10) % 10).cast("string")))[0]
    return F.when(_luhn_sum(digits, False) % 10 == 0, _refill(m, full))


def _iban(m: Column, key: str, back: bool) -> Column:
    plain = F.regexp_replace(m, "\\x20", "")
    country, check, account = F.substring(m, 1, 2), F.substring(plain, 3, 2), F.substring(plain, 5, 40)
    valid = _mod97(F.concat(account, country, check)) == 1
    moved = permute_digits(_digits(account), key, "iban", back)
    full = F.transform(F.array(moved), lambda p: F.concat(
        F.lpad((F.lit(98) - _mod97(F.concat(_refill(account, p), country, F.lit("00")))).cast("string"), 2, "0"), p))[0]
    return F.when(valid, F.concat(country, _refill(F.substring(m, 3, 60), full)))


def _phone(m: Column, key: str, back: bool) -> Column:
    digits = _digits(m)
    return _refill(m, F.concat(F.substring(digits, 1, 1), permute_digits(F.substring(digits, 2, 20), key, "phone", back)))


def _ssn(m: Column, key: str, back: bool) -> Column:
    area, group, serial = F.substring(m, 1, 3), F.substring(m, 5, 2), F.substring(m, 8, 4)
    valid = (area != "000") & (area != "666") & (area < "900") & (group != "00") & (serial != "0000")
    pair = _permute(group.cast("int") - 1, serial.cast("int") - 1, F.lit(99), F.lit(9999), key, F.concat(F.lit("ssn"), area), back)
    return F.when(valid, F.transform(F.array(pair), lambda p: F.concat_ws(
        "-", area, F.lpad((p["l"] + 1).cast("string"), 2, "0"), F.lpad((p["r"] + 1).cast("string"), 4, "0")))[0])


def _date(m: Column, key: str, back: bool) -> Column:
    day = F.datediff(F.try_to_date(m, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    pair = _permute(F.floor(day / DAYS), day % DAYS, F.lit(DAYS), F.lit(DAYS), key, F.lit("date"), back)
    moved = F.transform(F.array(pair), lambda p: F.date_format(
        F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS + p["r"]).cast("int")), "yyyy-MM-dd"))[0]
    return F.when((day >= 0) & (day < DAYS * DAYS), moved)


def _ip(m: Column, key: str, back: bool) -> Column:
    part = F.transform(F.split(m, r"\."), lambda c: c.cast("int"))
    valid = F.forall(part, lambda p: p < 256)
    pair = _permute(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), key, F.lit("ip"), back)
    return F.when(valid & ~m.rlike(r"(?:^|\.)0[0-9]"), F.transform(F.array(pair), lambda p: F.concat_ws(
        ".", *[x.cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)]))[0])


_MAKERS = {"iban": _iban, "ssn": _ssn, "date": _date, "ip": _ip, "phone": _phone, "card": _card}


def _kind(m: Column) -> Column:
    """The kind a match outside a run of numbers has, by its shape."""
    kind = F.when(m.startswith("+"), "phone").when(m.rlike("^[A-Z]"), "iban")
    for name in ("ssn", "date", "ip"):
        kind = kind.when(m.rlike(f"^(?:{PATTERNS[name]})$"), name)
    return kind


def _lone(m: Column) -> Column:
    return F.array(F.struct(F.lit("").alias("gap"), m.alias("m"), _kind(m).alias("kind")))


def _cut(m: Column) -> Column:
    """A run of numbers as pieces (gap before it, text, kind): cards, and single numbers without a kind.

    From left to right, a card is the first way of writing that begins at a number and is valid. A run
    that holds none is a card itself if it is valid as a whole, however grouped.
    """
    def card(window: Column) -> Column:
        found = [F.regexp_extract(window, f"^(?:{p})(?![0-9])", 0) for p in CARDS]
        return F.coalesce(*[F.when((f != "") & (_luhn_sum(_digits(f), False) % 10 == 0), f) for f in found], F.lit(""))

    def cut(run: Column) -> Column:
        numbers = F.regexp_extract_all(run, F.lit("[0-9]+"), F.lit(0))
        signs = F.regexp_extract_all(run, F.lit("[\\x20-]"), F.lit(0))
        windows = F.regexp_extract_all(run, F.lit(r"(?<![0-9])(?=([0-9]+(?:[\x20-][0-9]+){0,4}))[0-9]+"), F.lit(1))
        digits = _digits(run)
        odd = F.when(F.length(digits).between(13, 19) & (_luhn_sum(digits, False) % 10 == 0), run).otherwise("")
        known = F.transform(windows, card)
        cards = F.transform(F.array(known), lambda k: F.when(F.exists(k, lambda c: c != ""), k).otherwise(
            F.transform(k, lambda c, i: F.when(i == 0, odd).otherwise(""))))[0]
        return F.transform(F.array(F.struct(numbers.alias("n"), signs.alias("s"), cards.alias("c"))), join)[0]

    def join(x: Column) -> Column:
        def step(state: Column, c: Column) -> Column:
            inside = state["left"] > 0
            begins = ~inside & (c != "")
            return F.struct(
                F.when(inside, state["left"] - 1).when(begins, F.size(F.split(c, "[\\x20-]")) - 1).otherwise(0).alias("left"),
                F.concat(state["marks"], F.when(inside, "i").when(begins, "c").otherwise("n")).alias("marks"))

        marks = F.split(F.aggregate(x["c"], F.struct(F.lit(0).alias("left"), F.lit("").alias("marks")), step)["marks"], "")
        pieces = F.transform(F.arrays_zip(marks.alias("mark"), x["n"].alias("n"), x["c"].alias("c")), lambda z, i: F.struct(
            F.when((i == 0) | (z["mark"] == "i"), "").otherwise(F.get(x["s"], i - 1)).alias("gap"),
            F.when(z["mark"] == "c", z["c"]).when(z["mark"] == "n", z["n"]).otherwise("").alias("m"),
            F.when(z["mark"] == "c", "card").alias("kind")))
        return pieces

    return F.when(m.rlike(f"^(?:{PATTERNS['card']})$") & _kind(m).isNull(), cut(m)).otherwise(_lone(m))


def _replaced(piece: Column, key: str, back: bool) -> Column:
    """Struct (gap, kind, original, text): the pseudonym of a piece, or the piece and a null kind if it is
    not valid."""
    made = F.lit(None).cast("string")
    for name in KINDS:
        made = F.when(piece["kind"] == name, _MAKERS[name](piece["m"], key, back)).otherwise(made)
    return F.transform(F.array(made), lambda t: F.struct(
        piece["gap"].alias("gap"), F.when(t.isNotNull(), piece["kind"]).alias("kind"), piece["m"].alias("original"),
        F.coalesce(t, piece["m"]).alias("text")))[0]


def pseudonymize(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """(doc_id, text, found): texts with pseudonyms, and an array of (kind, original, pseudonym)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    matched = once(rows, m=F.regexp_extract_all("text", F.lit(_ANY), F.lit(0)))
    cut = once(matched, pieces=F.transform("m", _cut))
    replaced = once(cut, made=F.transform("pieces", lambda p: F.transform(p, lambda x: _replaced(x, key, back))))
    joined = F.transform("made", lambda p: F.array_join(F.transform(p, lambda x: F.concat(x["gap"], x["text"])), ""))
    made = once(replaced, joined=joined)
    whole = F.array_join(F.transform(F.split("text", _ANY, -1), lambda g, i: F.concat(
        g, F.coalesce(F.get(F.col("joined"), i), F.lit("")))), "")
    found = F.transform(F.filter(F.flatten("made"), lambda x: x["kind"].isNotNull()), lambda x: F.struct(
        x["kind"].alias("kind"), x["original"].alias("original"), x["text"].alias("pseudonym")))
    return made.select("doc_id", F.when(F.size("m") > 0, whole).otherwise(F.col("text")).alias("text"),
                       F.coalesce(found, F.array().cast("array<struct<kind:string,original:string,pseudonym:string>>")).alias("found"))


def reveal(docs: DataFrame, key: str) -> DataFrame:
    """The original texts of pseudonymized ones."""
    return pseudonymize(docs, key, back=True)
