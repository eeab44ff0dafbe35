"""Format-preserving Feistel pseudonyms for personal data.

Validated values are permuted inside their format under a key: digits stay digits,
letters stay letters, card numbers keep a right check digit, dates stay dates.
A permutation maps equal values to equal pseudonyms and different values to
different ones, so records stay linked across documents. Only column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# Fixed formats. Every pattern is linear: it starts only where no longer value could have started.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# 7 to 15 digits behind the plus sign: a longer run of digits is cut at a separator where it can be.
_PHONE_DIGITS = f"(?<={7 * '[0-9][ .()-]{0,2}'})(?<!{16 * '[0-9][ .()-]{0,2}'})"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})",
    "secret": (r"(?<![\p{L}\p{N}])(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key)"
               r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9+/_.=-]{8,}+[\"']?"
               r"|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9])"),
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9-]|\.[0-9])",
    "ipv4": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9]|-[0-9])",
    "phone": (rf"(?<![0-9+])\+[0-9]{{1,3}}[ .-]?\([0-9]{{1,4}}\)[ .-]?[0-9]{{2,4}}(?:[ .-]?[0-9]{{2,4}}){{1,3}}(?![0-9]){_PHONE_DIGITS}"
              rf"|(?<![0-9+])\+[0-9]{{1,3}}(?:[ .-]?[0-9]{{2,4}}){{2,5}}(?![0-9]){_PHONE_DIGITS}"
              r"|(?<![0-9)])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
              r"|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])"),
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
#: Kinds with a check digit: what may stand around a value, and all lengths to try at a start.
RUNS = {
    "iban": ("[A-Za-z0-9]", [rf"^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "") for n in range(2, 8) for rest in range(4)]),
    "card": ("[0-9]", [rf"^[0-9](?:[ -]?[0-9]){{{n - 1}}}" for n in range(13, 20)]),
}
#: Where an IBAN may start, and as much as may belong to it.
IBAN_START = r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){8,31}))"
#: Cards: undivided digits; the usual groups, unless they belong to a row of six or more groups of four digits; anything behind a label.
CARD_DIGITS = "[0-9]{13,}+"
CARD_GROUPS = (r"(?<![0-9])(?=([0-9]{4}[ -](?:[0-9]{4}[ -][0-9]{4}|[0-9]{6})[ -][0-9]{1,5}(?:[ -][0-9]{1,3})?))"
               r"(?<![0-9]{4}[ -][0-9]{4}[ -])(?!(?:[0-9]{4}[ -]){5}[0-9]{4}(?![0-9]))")
CARD_LABELLED = r"(?i:card|visa|amex|karte|carte|tarjeta)[^0-9]{0,20}([0-9](?:[ -]?[0-9]){12,18})"
#: Lengths of IBANs by country. Of several lengths that pass the check this one is taken; others hold where no such length is known.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
                23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM MR",
                28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
#: Usual shapes of card numbers, taken before others of the same start.
CARD_SHAPE = r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"
#: Days of a full calendar cycle of 400 years, a product of two radices; ordinals count from 1800-01-01.
DATE_RADICES = (189, 773)
DATE_START = "1800-01-01"
DATE_FORMATS = ((r"^[0-9]{4}-", "yyyy-MM-dd"), (r"^[0-9]{2}\.", "dd.MM.yyyy"), (r"^(?:0[0-9]|1[0-2])/", "MM/dd/yyyy"), (r"^(?:1[3-9]|[2-9][0-9])/", "dd/MM/yyyy"))
#: Days from the 13th on in the same cycle, a product of two radices: dates that can only be read with the day first keep to them.
LATE_RADICES = (9, 9833)


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"(?s)."), 0)


def _digest(key: str, kind: str, r: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), half), 256)


def _byte(digest: Column, i: Column) -> Column:
    """Two bytes of a digest, chosen by position, as a number."""
    return F.conv(F.substring(digest, (F.pmod(i, F.lit(30)) * 2 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _turn(c: Column, by: Column, hexadecimal: Column) -> Column:
    """Shift a character inside its class."""
    code = F.ascii(c)
    letters = F.when(hexadecimal, 6).otherwise(26)
    moved = (F.when((code >= 48) & (code <= 57), F.pmod(code - 48 + by, F.lit(10)) + 48)
             .when((code >= 97) & (code <= 122), F.pmod(code - 97 + by, letters) + 97)
             .when((code >= 65) & (code <= 90), F.pmod(code - 65 + by, letters) + 65))
    return F.coalesce(F.char(moved.cast("long")), c)


def permute_text(s: Column, key: str, kind: str) -> Column:
    """Feistel permutation of the strings with the same pattern of digits, capitals, small letters and others."""
    chars = _chars(s)
    cut = (F.size(chars) / 2).cast("int")
    pure = s.rlike("^[0-9a-f]*$") | s.rlike("^[0-9A-F]*$")

    def step(acc: Column, r: Column) -> Column:
        digest = _digest(key, kind, r, F.array_join(acc["b"], ""))
        left = F.transform(acc["a"], lambda c, i: _turn(c, _byte(digest, i), acc["h"]))
        return F.struct(acc["b"].alias("a"), left.alias("b"), acc["h"].alias("h"))

    start = F.struct(F.slice(chars, F.lit(1), cut).alias("a"), F.slice(chars, cut + 1, F.size(chars) - cut).alias("b"), pure.alias("h"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step,
                       lambda acc: F.array_join(F.concat(acc["a"], acc["b"]), ""))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _relay(m: Column, digits: Column) -> Column:
    """New digits between the separators of ``m``."""
    return F.array_join(F.zip_with(F.split(m, "[0-9]", -1), F.concat(_chars(digits), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def _luhn(digits: Column, doubled_last: bool) -> Column:
    """Luhn sum; ``doubled_last``: the check digit is still missing."""
    odd = 0 if doubled_last else 1
    values = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(
        F.pmod(i, F.lit(2)) == odd, F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), (c.cast("int") + 1)))
        .otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def _card_valid(m: Column) -> Column:
    return F.pmod(_luhn(_digits(m), False), F.lit(10)) == 0


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = F.concat(F.substring(d, 1, 1), permute_text(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
    check = F.pmod(10 - F.pmod(_luhn(body, True), F.lit(10)), F.lit(10))
    return F.when(_card_valid(m), _relay(m, F.concat(body, check.cast("string"))))


def _mod97(s: Column) -> Column:
    """Remainder of an IBAN's number: letters count 10 to 35."""
    return F.aggregate(_chars(s), F.lit(0), lambda a, c: F.when(
        F.ascii(c) >= 65, F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))).otherwise(F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))))


def _iban_valid(m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    return _mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1


def _iban_usual(m: Column) -> Column:
    size = F.length(F.regexp_replace(m, " ", ""))
    return m.rlike("^(?:%s)" % "|".join(c for names in IBAN_LENGTHS.values() for c in names.split())) & F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for n, names in IBAN_LENGTHS.items() for c in names.split() for x in (c, n)]), F.substring(m, 1, 2)) == size, F.lit(False))


def _valid_values(text: Column, kind: str) -> Column:
    """Every stretch of ``text`` that may be a value of the kind and passes its check; the usual lengths come first, then the longest."""
    lengths = RUNS[kind][1]
    passes, usual = (_iban_valid, _iban_usual) if kind == "iban" else (_card_valid, lambda m: m.rlike(CARD_SHAPE))

    def stretches(start: str) -> Column:
        runs = F.array_distinct(F.regexp_extract_all(text, F.lit(start), 1))
        return F.flatten(F.transform(runs, lambda run: F.transform(F.array(*[F.lit(p) for p in lengths]), lambda p: F.regexp_substr(run, p))))

    if kind == "iban":
        tried = stretches(IBAN_START)
    else:
        whole = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(CARD_DIGITS), 0)), lambda m: F.length(m) <= 19)
        parted = F.concat(F.filter(stretches(CARD_GROUPS), lambda m: m.rlike(CARD_SHAPE)), stretches(CARD_LABELLED))
        # most texts have no digits beside digits, so they are looked at once
        tried = F.when(text.rlike("[0-9][ -][0-9]"), F.concat(whole, parted)).otherwise(whole)
    good = F.filter(tried, lambda m: m.isNotNull() & passes(m))
    ranked = F.transform(good, lambda m: F.struct(usual(m).alias("usual"), F.length(m).alias("size"), m.alias("m")))
    return F.array_distinct(F.transform(F.sort_array(ranked, False), lambda r: r["m"]))


def _pattern(values: dict[str, Column]) -> Column:
    """Expression that finds all kinds; of those with a check digit only ``values``, so that nothing else takes up text."""
    parts = []
    for kind, p in PATTERNS.items():
        if kind in values:
            around = RUNS[kind][0]
            parts.append(F.when(F.size(values[kind]) > 0, F.concat(F.lit(f"(?:(?<!{around})(?:"), F.array_join(values[kind], "|"), F.lit(f")(?!{around}))"))))
        else:
            parts.append(F.lit(f"(?:{p})"))
    return F.concat_ws("|", *parts)


def _iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    account = F.substring(plain, F.lit(5), F.length(plain))
    new = permute_text(account, key, "iban")
    check = 98 - _mod97(F.concat(new, F.substring(plain, 1, 2), F.lit("00")))
    full = F.concat(F.substring(plain, 1, 2), F.lpad(check.cast("string"), 2, "0"), new)
    spaced = F.array_join(F.zip_with(F.split(m, "[A-Z0-9]", -1), F.concat(_chars(full), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return F.when(_iban_valid(m), spaced)


def _number(digest: Column, below: int) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(below)).cast("int")


def _late_ordinal(day: Column) -> Column:
    """Place of a date among those from the 13th on."""
    return F.datediff(day, F.lit(DATE_START).cast("date")) - 12 * ((F.year(day) - int(DATE_START[:4])) * 12 + F.month(day))


def _late_date(n: Column) -> Column:
    """Date of a place among those from the 13th on: the last month that begins there or before."""
    first = F.lit(DATE_START).cast("date")
    about = (n * 4800 / (LATE_RADICES[0] * LATE_RADICES[1])).cast("int")
    begin = lambda k: F.datediff(F.add_months(first, k), first) - 12 * k
    month = F.when(begin(about + 1) <= n, about + 1).when(begin(about) <= n, about).otherwise(about - 1)
    return F.date_add(F.add_months(first, month), (n - begin(month) + 12).cast("int"))


def _date(m: Column, key: str) -> Column:
    """A date as ``MM/dd`` if its first number can be a month, else as ``dd/MM``; each keeps to its own reading."""
    out = F.lit(None).cast("string")
    for shape, form in DATE_FORMATS:
        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        late = form == "dd/MM/yyyy"
        n = _late_ordinal(day) if late else F.datediff(day, F.lit(DATE_START).cast("date"))
        high, low = LATE_RADICES if late else DATE_RADICES

        def step(acc: Column, r: Column) -> Column:
            a = F.pmod(acc["a"] + _number(_digest(key, "date", r * 2, acc["b"].cast("string")), high), F.lit(high))
            b = F.pmod(acc["b"] + _number(_digest(key, "date", r * 2 + 1, a.cast("string")), low), F.lit(low))
            return F.struct(a.alias("a"), b.alias("b"))

        start = F.struct((n / low).cast("int").alias("a"), F.pmod(n, F.lit(low)).alias("b"))
        moved = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1)), start, step, lambda acc: acc["a"] * low + acc["b"])
        new = F.date_format(_late_date(moved) if late else F.date_add(F.lit(DATE_START).cast("date"), moved), form)
        out = F.when(m.rlike(shape), F.when((n >= 0) & (n < high * low), new)).otherwise(out)
    return out


def _ipv4(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda c: c.cast("int"))

    def step(acc: Column, r: Column) -> Column:
        digest = _digest(key, "ipv4", r, F.array_join(F.transform(acc["b"], lambda v: v.cast("string")), "."))
        left = F.transform(acc["a"], lambda v, i: F.pmod(v + _byte(digest, i), F.lit(256)))
        return F.struct(acc["b"].alias("a"), left.alias("b"))

    start = F.struct(F.slice(parts, 1, 2).alias("a"), F.slice(parts, 3, 2).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.array_join(
        F.transform(F.concat(acc["a"], acc["b"]), lambda v: v.cast("string")), "."))


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    fixed = F.greatest(F.lit(0), F.length(d) - 10)
    rest = permute_text(F.substring(d, fixed + 1, F.length(d)), key, "phone")
    return F.when(F.length(d).between(7, 15), _relay(m, F.concat(F.substring(d, F.lit(1), fixed), rest)))


def _email(m: Column, key: str) -> Column:
    """The name is permuted, apart from letters beyond ASCII; the host stays."""
    at = F.instr(m, "@")
    name = F.substring(m, F.lit(1), at - 1)
    # letters beyond ASCII have no class of their own: each becomes a small letter, its place in the digest of the name
    plain = F.when(name.rlike(r"^[\x00-\x7F]*$"), name).otherwise(F.concat(
        F.regexp_replace(name, r"[^\x00-\x7F]", "x"), F.substring(_digest(key, "email", F.lit(0), name), 1, 6)))
    return F.concat(permute_text(plain, key, "email"), F.substring(m, at, F.length(m)))


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^([^:=]*[:=]\s{0,3}[\"']?|AKIA|gh[pousr]_|sk-)", 1)
    tail = F.regexp_extract(m, r"([\"']?)$", 1)
    value = F.substring(m, F.length(head) + 1, F.length(m) - F.length(head) - F.length(tail))
    return F.concat(head, permute_text(value, key, "secret"), tail)


#: Steps of a walk to the next valid number; fewer than one number in 10 ** 30 is still invalid then.
WALK = 32


def _ssn(m: Column, key: str) -> Column:
    """Permuted again until the number is one that could be given out, which is a permutation of those."""
    def step(acc: Column, _: Column) -> Column:
        valid = F.regexp_like(acc["d"], F.lit("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"))
        done = acc["moved"] & valid
        return F.struct(F.when(done, acc["d"]).otherwise(permute_text(acc["d"], key, "ssn")).alias("d"), F.lit(True).alias("moved"))

    start = F.struct(_digits(m).alias("d"), F.lit(False).alias("moved"))
    return _relay(m, F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step, lambda acc: acc["d"]))


_MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ipv4": _ipv4,
           "ssn": _ssn, "phone": _phone, "card": _card}


def _replace(m: Column, key: str) -> Column:
    """Kind and pseudonym of a match; both null if the value isn't valid."""
    found = F.lit(None).cast("struct<kind:string,value:string>")
    for kind in reversed(PATTERNS):
        new = _MAKERS[kind](m, key)
        found = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), F.when(new.isNotNull(), F.struct(F.lit(kind).alias("kind"), new.alias("value")))).otherwise(found)
    return found


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` with the text rewritten, and ``pii``: kind and pseudonym of each value in order.

    Values that fail their check (card or IBAN check digits, calendar) stay as they
    are. An IBAN is found at every start and length of a run, a card as undivided digits or in
    its usual groups whatever stands before or after, in other groups behind a label. Rows of
    six or more groups of four digits are ordinary numbers. A number that passes its check by chance is replaced. A null text stays null and an empty one empty, both with no values. The key
    is part of every permutation; without it pseudonyms can't be traced back. Equal
    rows give equal rows. A column of ``docs`` called ``pii`` is replaced.
    """
    names = [c for c in docs.columns if c != "pii"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    text = F.col("text")
    rows = rows.withColumn("card", _valid_values(text, "card")).withColumn("iban", _valid_values(text, "iban"))
    rows = rows.withColumn("any", _pattern({k: F.col(k) for k in RUNS}))
    rows = rows.withColumn("matches", F.when(F.regexp_like(text, F.col("any")), F.regexp_extract_all(text, F.col("any"), F.lit(0))))
    rows = rows.withColumn("found", F.transform("matches", lambda m: F.struct(m.alias("m"), _replace(m, key).alias("r"))))
    new = F.concat(F.transform("found", lambda f: F.coalesce(f["r"]["value"], f["m"])), F.array(F.lit("")))
    masked = F.when(F.col("matches").isNull(), text).otherwise(
        F.array_join(F.zip_with(F.split(text, F.col("any"), -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
    pii = F.coalesce(F.filter(F.transform("found", lambda f: f["r"]), lambda r: r.isNotNull()),
                     F.array().cast("array<struct<kind:string,value:string>>"))
    return rows.select(*[(masked if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in names], pii.alias("pii"))


def op5_feistel_pii(docs: DataFrame, key: str = "canopyframe") -> DataFrame:
    rows = pseudonymise(docs.select("doc_id", "text"), key)
    return rows.select("doc_id", "text", F.size("pii").cast("long").alias("n_values"),
                       F.array_join(F.transform("pii", lambda r: r["kind"]), ",").alias("kinds"))
