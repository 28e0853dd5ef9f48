"""Operator 1: format-preserving pseudonyms of personal data, in DataFrame functions only.

A text is cut at candidates (one regular expression), each candidate is
validated - check digits of cards and IBANs, ranges of addresses and numbers,
the calendar for dates - and a valid one is replaced within its own format by
a keyed permutation: an alternating Feistel network over two halves of its
digits (or of its index among the valid values), ten rounds of SHA-256. Equal
values get equal pseudonyms in every document, different values of one format
different ones, and check digits fit again. Row-local: no shuffle, no Python.

Formats: payment cards (Luhn, 13 to 19 digits, plain or in groups), phone
numbers (international or North American; the country code stays), IPv4
addresses, IBANs (mod 97; country and letters stay), US social security
numbers, dates from 1900 to 2099 (y-m-d, and d.m.y, d/m/y, d-m-y; with m/d/y
where only that is valid). An email address isn't a number: its local part
becomes a keyed hash, so that it stays linked; the domain stays. A slash date
that is valid either way counts as day-first; dates of the two readings are
permuted separately, and so may rarely share a pseudonym.

A candidate may take in a neighbour. IBANs are therefore first tried at their
country's length and phone numbers up to where another form begins; and of a
rejected candidate only the first word is passed over: the rest is cut again,
with what follows, until nothing in it is a candidate. OP1_SQL has the single
pass with the wider forms, so it differs where such neighbours meet.

Defined results: a null text stays null with counts 0; empty texts stay empty;
candidates that fail validation or touch other letters or digits stay as they
are; rows that repeat a doc_id give a row each; the operator keeps all other
columns, op1 only what it states.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstat.llm.common import free_names, read_table

KEY = "pseudonym-key"  # of op1 and of tests; the operator itself takes its secret from the caller
ROUNDS = 10

#: Candidates by kind, in the order in which they are tried. No look-around: SQL engines share these.
FORMS: list[tuple[str, str]] = [
    ("email", r"[\p{L}\p{N}._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"),
    ("ymd", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("dmy", r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"),
    ("ip", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    (
        "phone",
        r"\+1[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|\+1[ .-][0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|\+[0-9]{8,15}"
        r"|\+[0-9]{1,3}(?:[ .-]\(?[0-9]{1,8}\)?){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}",
    ),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    ("card", r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19}"),
]
KINDS = ["email", "phone", "card", "ip", "iban", "ssn", "date"]
CANDIDATE = r"(^|[^\p{L}\p{N}_])(" + "|".join(p for _, p in FORMS) + ")"
#: What must not follow a candidate: it would be part of something longer.
GOES_ON = r"^(?:[\p{L}\p{N}_]|\.[0-9])"

#: Lengths of IBANs by country; others are taken as long as they go.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _nearer() -> str:
    """Candidates that leave their neighbours alone: IBANs of their country's length, phone numbers of 7 to 15 digits
    that end before a date, address, card or number of its own. Look-around, so Spark only; the wider forms follow."""
    form = dict(FORMS)
    end = rf"(?!{GOES_ON[1:]})"
    ibans = "|".join(
        f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{n - 4}}}|(?: [A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" [A-Z0-9]{{{n % 4}}})" if n % 4 else ")")
        for n, c in IBAN_LENGTHS.items()
    )
    card = rf"(?:{form['card']}){end}(?! [0-9]{{4}}(?![0-9-]))"  # not four groups out of more: the last ones are the card
    others = "|".join(form[k] for k in ("email", "ymd", "dmy", "ip", "ssn"))
    digit = "[ .()-]{0,3}[0-9]"  # spelt out below: Java wants a look-behind of an evident length
    group = r"[ .-]\(?[0-9]{1,8}\)?"
    phone = rf"\+[0-9]{{1,3}}(?! {card}){group}(?:(?! (?:(?:{others}){end}|{card})){group}){{0,3}}(?<=\+{7 * digit}{8 * f'(?:{digit})?'}\)?){end}"
    wide = form["phone"].split(r"|\+[0-9]{1,3}(?:")
    form["iban"] = f"(?:{ibans}){end}|{form['iban']}"
    form["phone"] = f"{wide[0]}|{phone}|" + r"\+[0-9]{1,3}(?:" + wide[1]
    return "(" + "|".join(form.values()) + ")"


NEARER = r"(^|[^\p{L}\p{N}_])" + _nearer()
#: In what is left of a text, a start needs something before it.
LATER = r"([^\p{L}\p{N}_])" + _nearer()

# A cut is \x01\x03; after it, \x01\x04 is a new candidate and \x01\x05 one that was rejected; an own \x01 of the text is \x01\x02 meanwhile.
_ESCAPE, _ESCAPED, _CUT, _NEW, _DEAD = "\x01", "\x01\x02", "\x01\x03", "\x01\x04", "\x01\x05"

DAYS_A, DAYS_B = 17, 4297  # 17 * 4297 = 73049 days from 1900 to 2099


def _prf(key: str, tweak: Column, n: Column, i: Column) -> Column:
    """60 pseudorandom bits of (key, tweak, round, half)."""
    said = F.concat_ws(":", F.lit(key), tweak, i.cast("string"), n.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, tweak: Column, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """Struct (a, b): the permuted halves, of the same sizes. One half moves each round, then they swap roles."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), size_a.cast("long").alias("ma"), size_b.cast("long").alias("mb"))

    def step(s: Column, i: Column) -> Column:
        moved = F.pmod(s["a"] + _prf(key, tweak, s["b"], i), s["ma"])
        return F.struct(s["b"].alias("a"), moved.alias("b"), s["mb"].alias("ma"), s["ma"].alias("mb"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)


def _permuted_digits(key: str, tweak: str, digits: Column) -> Column:
    """A string of digits of the same length, permuted among all of that length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    number = lambda x: F.coalesce(x.try_cast("long"), F.lit(0).cast("long"))  # noqa: E731  no digit at all: 0
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    out = F.transform(
        F.array(digits),
        lambda d: feistel(
            key, F.concat(F.lit(tweak), n.cast("string")), number(F.substring(d, F.lit(1), u)), number(F.substring(d, u + 1, n - u)), power(u), power(n - u)
        ),
    )[0]
    return F.concat(F.lpad(out["a"].cast("string"), u, F.lit("0")), F.lpad(out["b"].cast("string"), n - u, F.lit("0")))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _chars(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))


def _with_digits(x: Column, digits: Column) -> Column:
    """x with its digits replaced, in order, by the given ones."""
    return F.array_join(
        F.transform(
            _chars(x),
            lambda c, i: F.when(c.between("0", "9"), F.substring(digits, F.length(_digits(F.substring(x, F.lit(1), i + 1))), F.lit(1))).otherwise(c),
        ),
        "",
    )


def _luhn(digits: Column) -> Column:
    doubled = F.transform(
        _chars(F.reverse(digits)),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x)


def _mod97(chars: Column) -> Column:
    """The number that letters (A = 10) and digits spell, modulo 97."""

    def step(s: Column, c: Column) -> Column:
        value = F.ascii(c)
        return F.when(value < 65, (s * 10 + value - 48) % 97).otherwise((s * 100 + value - 55) % 97)

    return F.aggregate(_chars(chars), F.lit(0), step)


def _iban_turned(x: Column) -> Column:
    """An IBAN without blanks, its first four characters moved to the end."""
    plain = F.replace(x, F.lit(" "))
    return F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date of three texts, null if there is none such between 1900 and 2099."""
    said = F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    d = F.try_to_date(said, "yyyy-MM-dd")
    return F.when((year >= "1900") & (year <= "2099"), d)


def _dmy(x: Column) -> tuple[Column, Column]:
    """Day-first and month-first readings of a date."""
    part = [F.regexp_extract(x, r"^([0-9]+)[./-]([0-9]+)[./-]([0-9]+)$", i) for i in (1, 2, 3)]
    return _date(part[2], part[1], part[0]), F.when(F.contains(x, F.lit("/")), _date(part[2], part[0], part[1]))


def _octets(x: Column) -> list[Column]:
    return [F.split_part(x, F.lit("."), F.lit(i)).cast("int") for i in (1, 2, 3, 4)]


def kind_of(x: Column) -> Column:
    """The kind of a candidate, null if it isn't valid."""
    shape = {name: f"^(?:{p})$" for name, p in FORMS}
    n = F.length(_digits(x))
    octets = _octets(x)
    ip = reduce(lambda a, b: a & b, [o <= 255 for o in octets]) & (F.concat_ws(".", *[o.cast("string") for o in octets]) == x)
    iban = (F.length(F.replace(x, F.lit(" "))) <= 34) & (_mod97(_iban_turned(x)) == 1)
    ssn = ~F.substring(x, 1, 3).isin("000", "666") & (F.substring(x, 1, 1) != "9") & (F.substring(x, 5, 2) != "00") & (F.substring(x, 8, 4) != "0000")
    dmy, mdy = _dmy(x)
    ymd = _date(F.substring(x, 1, 4), F.substring(x, 6, 2), F.substring(x, 9, 2))
    kinds = [
        ("email", "email", F.lit(True)), ("iban", "iban", iban), ("ymd", "date", ymd.isNotNull()),
        ("dmy", "date", dmy.isNotNull() | mdy.isNotNull()), ("ip", "ip", ip), ("phone", "phone", n.between(7, 15)),
        ("ssn", "ssn", ssn), ("card", "card", n.between(13, 19) & (_luhn(_digits(x)) % 10 == 0)),
    ]
    out = F.lit(None).cast("string")
    for name, kind, valid in reversed(kinds):
        out = F.when(x.rlike(shape[name]), F.when(valid, F.lit(kind))).otherwise(out)
    return out


def pseudonym(kind: Column, x: Column, key: str) -> Column:
    """The pseudonym of a valid value of a kind."""
    number = lambda v, size: F.lpad(v.cast("string"), size, "0")
    # email
    address = F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    email = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), address), 256), 1, 20), F.lit("@"), F.split_part(x, F.lit("@"), F.lit(2)))
    # phone: the country code stays
    code = F.regexp_extract(x, r"^\+([17]|[0-9]{2})", 1)  # two digits stand for longer codes too
    own = F.substring(_digits(x), F.length(code) + 1, F.lit(15))
    phone = _with_digits(x, F.concat(code, _permuted_digits(key, "phone", own)))
    # card: the check digit follows
    digits = _digits(x)
    payload = _permuted_digits(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
    card = F.transform(F.array(payload), lambda p: _with_digits(x, F.concat(p, ((10 - _luhn(F.concat(p, F.lit("0"))) % 10) % 10).cast("string"))))[0]
    # ip
    o = _octets(x)
    halves = F.transform(F.array(F.lit("ip")), lambda t: feistel(key, t, o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536)))[0]
    ip = F.transform(
        F.array(halves),
        lambda h: F.concat_ws(".", *[v.cast("string") for v in (F.floor(h["a"] / 256), h["a"] % 256, F.floor(h["b"] / 256), h["b"] % 256)]),
    )[0]
    # iban: digits of the account part, then the check digits
    plain = F.replace(x, F.lit(" "))
    country, rest = F.substring(x, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    moved = F.transform(
        F.array(F.concat(country, F.lit("00"), _with_digits(rest, _permuted_digits(key, "iban", _digits(rest))))),
        lambda p: F.concat(country, F.lpad((98 - _mod97(_iban_turned(p))).cast("string"), 2, "0"), F.substring(p, F.lit(5), F.length(p))),
    )[0]
    spaced = F.rtrim(F.regexp_replace(moved, "(.{4})", "$1 "))
    iban = F.when(F.contains(x, F.lit(" ")), spaced).otherwise(moved)
    # ssn: an index among the valid ones
    area = F.substring(x, 1, 3).cast("int")
    area = area - 1 - F.when(area > 666, 1).otherwise(0)
    ssn = F.transform(
        F.array(F.lit("ssn")),
        lambda t: feistel(key, t, area * 99 + F.substring(x, 5, 2).cast("int") - 1, F.substring(x, 8, 4).cast("int") - 1, F.lit(898 * 99), F.lit(9999)),
    )[0]
    ssn = F.transform(
        F.array(ssn),
        lambda h: F.concat_ws("-", number(F.floor(h["a"] / 99) + 1 + F.when(F.floor(h["a"] / 99) >= 665, 1).otherwise(0), 3), number(h["a"] % 99 + 1, 2), number(h["b"] + 1, 4)),
    )[0]
    # date: an index among the days
    dmy, mdy = _dmy(x)
    iso = x.rlike(r"^[0-9]{4}-")
    read = F.when(iso, F.lit("ymd")).when(dmy.isNotNull(), F.lit("dmy")).otherwise(F.lit("mdy"))
    day = F.datediff(F.when(iso, _date(F.substring(x, 1, 4), F.substring(x, 6, 2), F.substring(x, 9, 2))).otherwise(F.coalesce(dmy, mdy)), F.lit("1900-01-01"))
    new = F.transform(
        F.array(F.struct(read.alias("read"), day.alias("day"))),
        lambda r: feistel(key, F.concat(F.lit("date"), r["read"] == "mdy"), F.floor(r["day"] / DAYS_B), r["day"] % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B)),
    )[0]
    mark = F.regexp_extract(x, "[./-]", 0)
    width = F.lit(2)
    date = F.transform(
        F.array(F.date_add(F.lit("1900-01-01").cast("date"), (new["a"] * DAYS_B + new["b"]).cast("int"))),
        lambda d: F.when(read == "ymd", F.date_format(d, "yyyy-MM-dd")).otherwise(
            F.concat(
                F.lpad(F.when(read == "dmy", F.dayofmonth(d)).otherwise(F.month(d)).cast("string"), width, F.lit("0")), mark,
                F.lpad(F.when(read == "dmy", F.month(d)).otherwise(F.dayofmonth(d)).cast("string"), width, F.lit("0")), mark, F.year(d).cast("string"),
            )
        ),
    )[0]
    return (
        F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip)
        .when(kind == "iban", iban).when(kind == "ssn", ssn).when(kind == "date", date).otherwise(x)
    )


def _settled(parts: Column) -> Column:
    """Parts in one text again: of a rejected candidate only the first word stays cut, the rest may hold others."""

    def one(x: Column, i: Column) -> Column:
        c = F.substring(x, F.lit(3), F.length(x))
        valid = ~F.get(parts, i + 1).rlike(GOES_ON) & kind_of(c).isNotNull()
        head = F.substring_index(c, " ", 1)
        dead = F.concat(F.lit(_CUT + _DEAD), head, F.lit(_CUT), F.substring(c, F.length(head) + 1, F.length(c)))
        return (
            F.when(i % 2 == 0, x).when(~F.startswith(x, F.lit(_NEW)), F.concat(F.lit(_CUT), x, F.lit(_CUT)))
            .when(valid, F.concat(F.lit(_CUT), c, F.lit(_CUT))).otherwise(dead)
        )

    return F.array_join(F.transform(parts, one), "")


def _again(parts: Column) -> Column:
    """Parts of a text with rejected candidates, cut until what is left has no candidate."""
    first = F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.concat(F.lit(_NEW), x)).otherwise(x))
    start = F.struct(_settled(first).alias("s"), F.lit(True).alias("more"))

    def step(a: Column, _: Column) -> Column:
        cut = F.array_join(
            F.transform(
                F.split(a["s"], _CUT),
                lambda x, i: F.when(i % 2 == 1, F.concat(F.lit(_CUT), x, F.lit(_CUT))).otherwise(F.regexp_replace(x, LATER, f"$1{_CUT}{_NEW}$2{_CUT}")),
            ),
            "",
        )
        now = F.struct(_settled(F.split(cut, _CUT)).alias("s"), F.contains(cut, F.lit(_CUT + _NEW)).alias("more"))
        return F.when(a["more"], now).otherwise(a)

    # Every round takes a word at least.
    words = F.sequence(F.lit(0), F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x) - F.length(F.replace(x, F.lit(" ")))))
    return F.split(F.aggregate(words, start, step)["s"], _CUT)


def pseudonymize(docs: DataFrame, key: str, into: str = "text", kinds: str | None = None) -> DataFrame:
    """`text` with pseudonyms; with `kinds`, also that column: an array of the kinds found, in order.

    All columns are kept; n_chars, where there is such a column, follows the new text.
    """
    text = F.col("text")
    cut = F.split(
        F.regexp_replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPED)), NEARER, f"$1{_CUT}$2{_CUT}"), _CUT
    )
    # A text without a digit or @ has no candidate.
    parts = F.when(text.rlike("[0-9@]"), cut).otherwise(F.array(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPED))))
    cut_parts, marks, made, seen = free_names(docs, "parts", "marked", "made", "seen")
    out = docs.withColumn(cut_parts, parts)
    marked = F.transform(
        cut_parts,
        lambda x, i: F.struct(
            F.when((i % 2 == 1) & ~F.get(F.col(cut_parts), i + 1).rlike(GOES_ON), kind_of(x)).alias("kind"), x.alias("x")
        ),
    )
    out = out.withColumn(marks, marked)
    # Rejected candidates of several words may hide others.
    hidden = F.exists(F.transform(marks, lambda m, i: (i % 2 == 1) & m["kind"].isNull() & F.contains(m["x"], F.lit(" "))), lambda h: h)
    retried = F.transform(
        _again(F.col(cut_parts)),
        lambda x, i: F.when(F.startswith(x, F.lit(_DEAD)), F.struct(F.lit(None).cast("string").alias("kind"), F.substring(x, F.lit(3), F.length(x)).alias("x")))
        .otherwise(F.struct(F.when(i % 2 == 1, kind_of(x)).alias("kind"), x.alias("x"))),
    )
    out = out.withColumn(marks, F.when(hidden, retried).otherwise(F.col(marks)))
    new = F.array_join(F.transform(marks, lambda m: F.when(m["kind"].isNull(), m["x"]).otherwise(pseudonym(m["kind"], m["x"], key))), "")
    found = F.filter(F.transform(marks, lambda m: m["kind"]), lambda k: k.isNotNull())
    out = out.withColumn(made, F.when(text.isNotNull(), F.replace(new, F.lit(_ESCAPED), F.lit(_ESCAPE))))
    out = out.withColumn(seen, found)
    picked = []
    for c in docs.columns:
        if c == into:
            picked.append(F.col(made).alias(into))
        elif c == "n_chars" and into == "text":
            picked.append(F.when(F.size(seen) > 0, F.length(made).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            picked.append(F.col(f"`{c}`"))
    if kinds:
        picked.append(F.coalesce(seen, F.array().cast("array<string>")).alias(kinds))
    return out.select(*picked)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonymise all of `documents`."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymize(docs, KEY, kinds="kinds")
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", "text", F.size("kinds").cast("long").alias("n_pii"), *[count(k) for k in KINDS])


def _oracle() -> str:
    """DuckDB SQL of op1: each different candidate is a row, a round is a step of nested selects."""
    shape = {name: p.replace("'", "''") for name, p in FORMS}
    candidate, goes_on = CANDIDATE.replace("'", "''"), GOES_ON
    luhn = "list_sum(list_transform(string_split(reverse({0}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) ELSE CAST(c AS INT) * 2 - CASE WHEN CAST(c AS INT) > 4 THEN 9 ELSE 0 END END))"
    mod97 = "list_reduce(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) < 65 THEN unicode(c) - 48 ELSE unicode(c) - 55 END), lambda s, v: (s * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, 0)"
    turned = "substr({0}, 5) || substr({0}, 1, 4)"
    day = "CASE WHEN {0} BETWEEN '1900' AND '2099' THEN try_cast({0} || '-' || lpad({1}, 2, '0') || '-' || lpad({2}, 2, '0') AS DATE) END"
    part = [rf"regexp_extract(x, '^([0-9]+)[./-]([0-9]+)[./-]([0-9]+)$', {i})" for i in (1, 2, 3)]
    is_ = lambda name: f"regexp_full_match(x, '{shape[name]}')"
    octet = [f"try_cast(split_part(x, '.', {i}) AS INT)" for i in (1, 2, 3, 4)]
    rounds = "h"
    for i in range(ROUNDS):
        rounds = (
            f"(SELECT x, kind, tweak, b AS a, (a + CAST('0x' || substr(sha256(concat_ws(':', '{KEY}', tweak, '{i}', CAST(b AS VARCHAR))), 1, 15) AS BIGINT)) % ma AS b, "
            f"mb AS ma, ma AS mb FROM {rounds})"
        )
    with_digits = "array_to_string(list_transform(string_split({0}, ''), lambda c, i: CASE WHEN c BETWEEN '0' AND '9' THEN substr({1}, length(regexp_replace(substr({0}, 1, i), '[^0-9]', '', 'g')), 1) ELSE c END), '')"
    return rf"""
WITH p AS (
  SELECT doc_id, text, CASE WHEN regexp_matches(text, '[0-9@]') THEN string_split(regexp_replace(replace(text, chr(1), chr(1) || chr(2)), '{candidate}', '\1' || chr(1) || chr(3) || '\2' || chr(1) || chr(3), 'g'), chr(1) || chr(3))
         ELSE [replace(text, chr(1), chr(1) || chr(2))] END AS parts FROM documents
), f AS (
  SELECT doc_id, i, parts[i] AS x, i % 2 = 0 AND NOT regexp_matches(parts[i + 1], '{goes_on}') AS apart FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM p)
), v AS (
  SELECT x, regexp_replace(x, '[^0-9]', '', 'g') AS d, replace(x, ' ', '') AS plain, {day.format(part[0], part[1], part[2])} AS ymd,
         {day.format(part[2], part[1], part[0])} AS dmy, CASE WHEN contains(x, '/') THEN {day.format(part[2], part[0], part[1])} END AS mdy
  FROM (SELECT DISTINCT x FROM f WHERE apart)
), k AS (
  SELECT *, CASE
    WHEN {is_("email")} THEN 'email'
    WHEN {is_("iban")} THEN CASE WHEN length(plain) <= 34 AND {mod97.format(turned.format("plain"))} = 1 THEN 'iban' END
    WHEN {is_("ymd")} THEN CASE WHEN ymd IS NOT NULL THEN 'date' END
    WHEN {is_("dmy")} THEN CASE WHEN dmy IS NOT NULL OR mdy IS NOT NULL THEN 'date' END
    WHEN {is_("ip")} THEN CASE WHEN greatest({", ".join(octet)}) <= 255 AND concat_ws('.', {", ".join(octet)}) = x THEN 'ip' END
    WHEN {is_("phone")} THEN CASE WHEN length(d) BETWEEN 7 AND 15 THEN 'phone' END
    WHEN {is_("ssn")} THEN CASE WHEN substr(x, 1, 3) NOT IN ('000', '666') AND substr(x, 1, 1) <> '9' AND substr(x, 5, 2) <> '00' AND substr(x, 8, 4) <> '0000' THEN 'ssn' END
    WHEN {is_("card")} THEN CASE WHEN length(d) BETWEEN 13 AND 19 AND {luhn.format("d")} % 10 = 0 THEN 'card' END END AS kind,
    regexp_extract(x, '^\+([17]|[0-9]{{2}})', 1) AS code
  FROM v
), s AS (
  SELECT *, CASE kind WHEN 'phone' THEN substr(d, length(code) + 1) WHEN 'card' THEN substr(d, 1, length(d) - 1) WHEN 'iban' THEN regexp_replace(substr(plain, 5), '[^0-9]', '', 'g') END AS own,
         CASE WHEN {is_("ymd")} THEN 'ymd' WHEN dmy IS NOT NULL THEN 'dmy' ELSE 'mdy' END AS read,
         date_diff('day', DATE '1900-01-01', CASE WHEN {is_("ymd")} THEN ymd ELSE coalesce(dmy, mdy) END) AS day,
         CAST(substr(x, 1, 3) AS VARCHAR) AS area3
  FROM k WHERE kind IS NOT NULL
), h AS (
  SELECT x, kind,
    CASE kind WHEN 'ip' THEN 'ip' WHEN 'ssn' THEN 'ssn' WHEN 'date' THEN CASE WHEN read = 'mdy' THEN 'datetrue' ELSE 'datefalse' END ELSE kind || length(own) END AS tweak,
    CASE kind WHEN 'ip' THEN {octet[0]} * 256 + {octet[1]} WHEN 'ssn' THEN (try_cast(area3 AS INT) - 1 - CASE WHEN area3 > '666' THEN 1 ELSE 0 END) * 99 + try_cast(substr(x, 5, 2) AS INT) - 1
      WHEN 'date' THEN day // {DAYS_B} ELSE coalesce(try_cast(substr(own, 1, length(own) // 2) AS BIGINT), 0) END AS a,
    CASE kind WHEN 'ip' THEN {octet[2]} * 256 + {octet[3]} WHEN 'ssn' THEN try_cast(substr(x, 8, 4) AS INT) - 1
      WHEN 'date' THEN day % {DAYS_B} ELSE coalesce(try_cast(substr(own, length(own) // 2 + 1) AS BIGINT), 0) END AS b,
    CASE kind WHEN 'ip' THEN 65536 WHEN 'ssn' THEN {898 * 99} WHEN 'date' THEN {DAYS_A} ELSE CAST(rpad('1', CAST(length(own) // 2 + 1 AS INT), '0') AS BIGINT) END AS ma,
    CASE kind WHEN 'ip' THEN 65536 WHEN 'ssn' THEN 9999 WHEN 'date' THEN {DAYS_B} ELSE CAST(rpad('1', CAST(length(own) - length(own) // 2 + 1 AS INT), '0') AS BIGINT) END AS mb
  FROM s WHERE kind <> 'email'
), r AS (SELECT * FROM {rounds}
), o AS (
  SELECT s.*, r.a, r.b, CASE WHEN s.kind = 'date' THEN DATE '1900-01-01' + CAST(r.a * {DAYS_B} + r.b AS INT) END AS moved,
    CASE WHEN s.own IS NOT NULL THEN lpad(CAST(r.a AS VARCHAR), CAST(length(own) // 2 AS INT), '0') || lpad(CAST(r.b AS VARCHAR), CAST(length(own) - length(own) // 2 AS INT), '0') END AS n
  FROM s LEFT JOIN r ON s.x = r.x
), q AS (
  SELECT *, substr(x, 1, 2) || '00' || {with_digits.format("substr(plain, 5)", "n")} AS bare FROM o
), y AS (
  SELECT x, kind, CASE kind
    WHEN 'email' THEN 'u' || substr(sha256('{KEY}:email:' || translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), 1, 20) || '@' || split_part(x, '@', 2)
    WHEN 'ip' THEN concat_ws('.', a // 256, a % 256, b // 256, b % 256)
    WHEN 'ssn' THEN lpad(CAST(a // 99 + 1 + CASE WHEN a // 99 >= 665 THEN 1 ELSE 0 END AS VARCHAR), 3, '0') || '-' || lpad(CAST(a % 99 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(b + 1 AS VARCHAR), 4, '0')
    WHEN 'phone' THEN {with_digits.format("x", "(code || n)")}
    WHEN 'card' THEN {with_digits.format("x", f"(n || CAST((10 - {luhn.format('(n || 0)')} % 10) % 10 AS VARCHAR))")}
    WHEN 'iban' THEN CASE WHEN contains(x, ' ') THEN rtrim(regexp_replace(substr(bare, 1, 2) || lpad(CAST(98 - {mod97.format(turned.format("bare"))} AS VARCHAR), 2, '0') || substr(bare, 5), '(.{{4}})', '\1 ', 'g'))
      ELSE substr(bare, 1, 2) || lpad(CAST(98 - {mod97.format(turned.format("bare"))} AS VARCHAR), 2, '0') || substr(bare, 5) END
    WHEN 'date' THEN CASE read WHEN 'ymd' THEN strftime(moved, '%Y-%m-%d')
      WHEN 'dmy' THEN strftime(moved, '%d') || regexp_extract(x, '[./-]') || strftime(moved, '%m') || regexp_extract(x, '[./-]') || strftime(moved, '%Y')
      ELSE strftime(moved, '%m') || regexp_extract(x, '[./-]') || strftime(moved, '%d') || regexp_extract(x, '[./-]') || strftime(moved, '%Y') END END AS new
  FROM q
), j AS (SELECT f.doc_id, f.i, coalesce(y.new, f.x) AS x, y.kind FROM f LEFT JOIN y ON f.apart AND f.x = y.x)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE t.text END AS text, coalesce(t.n_pii, 0) AS n_pii, {", ".join(f"coalesce(t.n_{k}, 0) AS n_{k}" for k in KINDS)}
FROM documents d LEFT JOIN (
  SELECT doc_id, replace(string_agg(x, '' ORDER BY i), chr(1) || chr(2), chr(1)) AS text, count(kind) AS n_pii, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in KINDS)} FROM j GROUP BY doc_id
) t ON d.doc_id = t.doc_id
"""


OP1_SQL = _oracle()
