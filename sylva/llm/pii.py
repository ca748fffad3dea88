"""Format-preserving Feistel pseudonyms of private numbers and dates, by built-in functions.

Found: card numbers of 13 to 19 digits with a right check digit, in their usual groups by
blanks or hyphens or unbroken (other than of 16 digits from 2 to 6, or 1 with 15, on); account
numbers (IBAN) of a country's length with a right check sum, in fours or unbroken; social
security numbers ddd-dd-dddd outside the areas never given; existing dates of 1900 to 2099 as
yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy and, where it can be no other, mm/dd/yyyy; telephone
numbers +d (ddd) ddd-dddd and their like, +ddd... of 8 to 15 digits, and (ddd) ddd-dddd,
ddd-ddd-dddd or ddd.ddd.dddd from 2 on; dotted quads of octets. A keyed Feistel network permutes
a card's digits but the check digit (it follows), an account's digits behind the check sum
(it follows), a social security number's, the last ten of a telephone number, an address's
octets and a date's day number, so the format stays and equal values of a kind get equal
pseudonyms in all documents. Pseudonyms may fall into areas, issuers or networks never given;
other kinds of private data (names, e-mail addresses) are left alone.

Candidates are looked for at every place and checked, and the text is cut at the right ones
only. A digit next to a value, or behind a hyphen next to it, makes it a part of another number.

Defined results: null counts as empty; each distinct value of a text is replaced wherever
it stands by itself; of values that overlap the first; repeated rows give a row each; other columns play no part.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# A hyphen before or behind is refused only where a digit is on its other side.
START, END = r"(?<!\d)(?<!\d-)", r"(?!\d)(?!-\d)"
GROUPED = START + r"\d{4}(?:(?: \d{4}){3}|(?:-\d{4}){3})" + END
AMEX = START + r"\d{4}(?: \d{6} \d{4,5}|-\d{6}-\d{4,5})" + END
LONG = START + r"\d{4}(?:(?: \d{4}){3} \d{1,3}|(?:-\d{4}){3}-\d{1,3})" + END
UNBROKEN = START + r"(?:\d{16}|1\d{14}|[2-6]\d{12,18})" + END
SSN = START + r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}" + END
MONTH, DAY, APART = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", (r"(?<!\d[./])", r"(?![./]\d)")
ISO = START + rf"(?:19|20)\d{{2}}-{MONTH}-{DAY}" + END
DOTTED = START + APART[0] + rf"{DAY}\.{MONTH}\.(?:19|20)\d{{2}}" + END + APART[1]
SLASHED = START + APART[0] + rf"{DAY}/{MONTH}/(?:19|20)\d{{2}}" + END + APART[1]
MONTH_FIRST = START + APART[0] + rf"{MONTH}/(?:1[3-9]|2\d|3[01])/(?:19|20)\d{{2}}" + END + APART[1]
WITH_COUNTRY = START + r"(?<!\+)\+[1-9]\d{0,2}[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}" + END
INTERNATIONAL = START + r"(?<!\+)\+[1-9]\d{7,14}" + END
NATIONAL = START + APART[0] + r"(?:\([2-9]\d{2}\) ?[2-9]\d{2}[ .-]|[2-9]\d{2}-[2-9]\d{2}-|[2-9]\d{2}\.[2-9]\d{2}\.)\d{4}" + END + APART[1]
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = START + r"(?<!\d\.)" + rf"(?:{OCTET}\.){{3}}{OCTET}" + END + r"(?!\.\d)"
#: Lengths of account numbers (IBAN) by country.
IBANS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
         22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
         26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
         31: "MT SC", 32: "LC", 33: "RU"}
IBAN = "(?<![A-Za-z0-9])(?:" + "|".join(
    rf"(?:{c.replace(' ', '|')})\d{{2}}(?:[A-Z0-9]{{{n - 4}}}|(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") + ")"
    for n, c in IBANS.items()) + ")(?![A-Za-z0-9])"
#: Days from 1900-01-01 to 2099-12-31, and a domain of two factors that holds them.
ROUNDS, LAST, DAYS = 8, 73_049, (270, 271)


def let(x: Column, body) -> Column:
    """``body`` of ``x``, worked out once."""
    return F.transform(F.array(x), lambda v: body(v))[0]


def feistel(a: Column, b: Column, na: int, nb: int, key: str, body) -> Column:
    """``body`` of a keyed permutation of the pairs (a below ``na``, b below ``nb``)."""
    def turn(pair: Column, k: Column) -> Column:
        a, b, even = pair["a"], pair["b"], F.pmod(k, F.lit(2)) == 0
        draw = F.conv(F.substring(F.sha2(F.concat_ws("/", F.lit(key), k.cast("string"), F.when(even, b).otherwise(a).cast("string")), 256), 1, 13), 16, 10).cast("bigint")
        return let(draw, lambda d: F.struct(F.when(even, F.pmod(a + d, F.lit(na))).otherwise(a).cast("bigint").alias("a"),
                                            F.when(even, b).otherwise(F.pmod(b + d, F.lit(nb))).cast("bigint").alias("b")))

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn), lambda p: body(p["a"], p["b"]))


def feistel_digits(x: Column, key: str, body) -> Column:
    """``body`` of a keyed permutation of the digits of this length, of 2 to 30."""
    def size(n: Column) -> Column:
        return F.element_at(F.array(*[F.lit(10**k) for k in range(1, 16)]), n.cast("int"))

    def of(half: Column) -> Column:
        rest = F.length(x) - half
        return feistel(F.substr(x, F.lit(1), half), F.substr(x, half + 1), size(half), size(rest), key,
                       lambda a, b: body(F.concat(F.lpad(a.cast("string"), half, F.lit("0")), F.lpad(b.cast("string"), rest, F.lit("0")))))

    return let(F.ceil(F.length(x) / 2).cast("int"), of)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def fill(x: Column, new: Column) -> Column:
    """``x`` with its digits replaced by those of ``new``, one by one."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: let(F.substr(x, i, F.lit(1)), lambda c: F.when(
        c.rlike("[0-9]"), F.substr(new, F.length(digits(F.substr(x, F.lit(1), i))), F.lit(1))).otherwise(c))), "")


def luhn(x: Column) -> Column:
    """The check digit behind these digits."""
    def turn(total: Column, i: Column) -> Column:
        d = F.substr(x, F.length(x) - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return let(d, lambda d: total + F.when(d > 9, d - 9).otherwise(d))

    return F.pmod(-F.aggregate(F.sequence(F.lit(0), F.length(x) - 1), F.lit(0), turn), F.lit(10)).cast("string")


def card(x: Column, key: str) -> Column:
    return let(digits(x), lambda d: feistel_digits(F.substr(d, F.lit(1), F.length(d) - 1), key + "/card",
                                                   lambda n: fill(x, F.concat(n, luhn(n)))))


def phone(x: Column, key: str) -> Column:
    """The last ten digits are permuted, or of fewer all behind the first."""
    def of(d: Column) -> Column:
        return let(F.greatest(F.length(d) - 10, F.when(x.startswith("+"), 1).otherwise(0)), lambda n: feistel_digits(
            F.substr(d, n + 1), key + "/phone", lambda new: fill(x, F.concat(F.substr(d, F.lit(1), n), new))))

    return let(digits(x), of)


def ipv4(x: Column, key: str) -> Column:
    def pair(p: Column, k: int) -> Column:
        return F.get(p, F.lit(k)).cast("int") * 256 + F.get(p, F.lit(k + 1)).cast("int")

    return let(F.split(x, r"\."), lambda p: feistel(pair(p, 0), pair(p, 2), 2**16, 2**16, key + "/ipv4", lambda a, b: F.concat_ws(
        ".", *[y.cast("string") for h in (a, b) for y in (F.floor(h / 256), F.pmod(h, F.lit(256)))])))


def mod97(x: Column) -> Column:
    """Of a text of digits and letters, a letter being 10 to 35."""
    return F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(0), lambda r, i: let(
        F.conv(F.substr(x, i, F.lit(1)), 36, 10).cast("int"), lambda v: F.pmod(r * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))))


def iban_ok(x: Column) -> Column:
    return let(F.regexp_replace(x, " ", ""), lambda u: (mod97(F.concat(F.substr(u, F.lit(5)), F.substr(u, F.lit(1), F.lit(4)))) == 1)
               & (F.length(digits(F.substr(u, F.lit(5)))) > 1))


def iban(x: Column, key: str) -> Column:
    """The country and the letters stay; the check digits follow."""
    def of(u: Column) -> Column:
        own, country = F.substr(u, F.lit(5)), F.substr(u, F.lit(1), F.lit(2))
        return feistel_digits(digits(own), key + "/iban", lambda n: let(fill(own, n), lambda new: F.concat(
            F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), digits(new))))

    return let(F.regexp_replace(x, " ", ""), lambda u: let(of(u), lambda n: fill(x, n)))


def ssn(x: Column, key: str) -> Column:
    return feistel(F.concat(F.substring(x, 1, 3), F.substring(x, 5, 2)), F.substring(x, 8, 4), 10**5, 10**4, key + "/ssn",
                   lambda a, b: let(F.lpad(a.cast("string"), 5, "0"), lambda n: F.concat_ws(
                       "-", F.substring(n, 1, 3), F.substring(n, 4, 2), F.lpad(b.cast("string"), 4, "0"))))


def day_of(x: Column, form: str) -> Column:
    return F.datediff(F.try_to_date(x, form), F.lit("1900-01-01").cast("date"))


def date_ok(form: str):
    return lambda x: day_of(x, form).isNotNull()


def date(form: str):
    def new(x: Column, key: str) -> Column:
        def turn(day: Column, _) -> Column:
            # Past the last day the permutation goes on, until it comes to a day that is one.
            return F.when((day >= 0) & (day < LAST), day).otherwise(let(F.when(day < 0, -1 - day).otherwise(day), lambda d: feistel(
                F.floor(d / DAYS[1]), F.pmod(d, F.lit(DAYS[1])), *DAYS, key + "/date", lambda a, b: a * DAYS[1] + b)))

        start = (-1 - day_of(x, form)).cast("bigint")  # below 0: not turned yet
        # No way back is longer than the places that are no days, and one.
        walk = F.aggregate(F.sequence(F.lit(0), F.lit(DAYS[0] * DAYS[1] - LAST)), start, turn)
        return F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), walk.cast("int")), form)

    return new


def card_ok(x: Column) -> Column:
    return let(digits(x), lambda d: luhn(F.substr(d, F.lit(1), F.length(d) - 1)) == F.substr(d, F.length(d)))


def always(x: Column) -> Column:
    return F.lit(True)


#: Pattern, check and pseudonym of every format; of two at one place the first one that is right.
FORMATS = ((IBAN, iban_ok, iban), (LONG, card_ok, card), (GROUPED, card_ok, card), (AMEX, card_ok, card), (UNBROKEN, card_ok, card),
           (SSN, always, ssn), *[(p, date_ok(f), date(f)) for p, f in ((ISO, "yyyy-MM-dd"), (DOTTED, "dd.MM.yyyy"), (SLASHED, "dd/MM/yyyy"),
                                                                      (MONTH_FIRST, "MM/dd/yyyy"))],
           (WITH_COUNTRY, always, phone), (INTERNATIONAL, always, phone), (NATIONAL, always, phone), (IPV4, always, ipv4))


#: Parts of a text that are appended to one by one, before they go to the others together.
CHUNK = 256


def cut(pieces: Column, marks: Column) -> Column:
    """The text with its values replaced: ``marks`` are null or (old, new), and each stands at
    the start of the piece behind it; what stands in a replaced value is none itself."""
    def of(i: Column) -> Column:
        return F.get(pieces, i + 1)

    def over(i: Column, m: Column) -> Column:
        """Characters of a value that are in later pieces."""
        return F.greatest(F.coalesce(F.length(m["old"]) - F.length(of(i)), F.lit(0)), F.lit(0))

    def one(i: Column, m: Column) -> Column:
        return F.when(m.isNull(), of(i)).otherwise(F.concat(m["new"], F.substr(of(i), F.length(m["old"]) + 1)))

    def turn(state: Column, x: Column) -> Column:
        i, m, skip = x["i"], x["m"], state["skip"]
        covered = F.substr(of(i), skip + 1)
        part = F.struct(F.when(skip > 0, covered).otherwise(one(i, m)).alias("text"),
                        F.when(skip == 0, m["old"]).alias("old"))
        full = F.size(state["last"]) >= CHUNK    # appending copies: only a chunk, and now and then the list of chunks
        return F.struct(F.when(skip > 0, F.greatest(skip - F.length(of(i)), F.lit(0))).otherwise(over(i, m)).alias("skip"),
                        F.when(full, F.concat(state["chunks"], F.array(state["last"]))).otherwise(state["chunks"]).alias("chunks"),
                        F.when(full, F.array(part)).otherwise(F.concat(state["last"], F.array(part))).alias("last"))

    kind = "array<struct<text:string,old:string>>"
    at = F.transform(marks, lambda m, i: F.struct(i.alias("i"), m.alias("m")))
    # One after the other only where values overlap.
    folded = F.aggregate(at, F.struct(F.lit(0).alias("skip"), F.array().cast(f"array<{kind}>").alias("chunks"), F.array().cast(kind).alias("last")),
                         turn, lambda state: F.concat(F.flatten(state["chunks"]), state["last"]))
    straight = F.transform(marks, lambda m, i: F.struct(one(i, m).alias("text"), m["old"].alias("old")))
    return F.when(F.exists(at, lambda x: over(x["i"], x["m"]) > 0), folded).otherwise(straight)


def pseudonymise(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row: doc_id, n_values (distinct values replaced) and the whole text. Who has the ``key`` can turn
    pseudonyms back; without one the session's ``spark.sylva.pseudonyms.key`` is taken, and where that
    isn't set either a random one, so that pseudonyms are linked within this result only.

    A text's cost grows with its length and the number of its values, not with their product: every start is
    held against all formats and replaced where it stands."""
    key = key or docs.sparkSession.conf.get("spark.sylva.pseudonyms.key", None) or secrets.token_hex(16)
    # Blanks in front, so that the first piece is never a value's and a start has two characters before it.
    out = docs.select(F.col(id_col).alias("doc_id"), F.concat(F.lit("  "), F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    # What begins no format is passed over by its first character. Every start's surroundings,
    # as far as any format looks, are held against all formats.
    start = r"(?=[0-9+(]|[A-Z]{2}\d\d)(?<!\d)(?=" + "|".join(p for p, _, _ in FORMATS) + ")"
    around = [F.regexp_extract_all("text", F.lit(start + r"(?<=([\s\S]{2}))(?=([\s\S]{0,50}))"), F.lit(k)) for k in (1, 2)]

    def mark(w: Column) -> Column:
        """What stands at a start, of the first format that is right: (old, new)."""
        def tried(p: str, ok, new) -> Column:
            return let(F.regexp_extract(w, rf"^[\s\S]{{2}}({p})", 1), lambda x: F.when(
                (x != "") & ok(x), F.struct(x.alias("old"), new(x, key).alias("new"))))

        return F.coalesce(*[tried(*f) for f in FORMATS])

    out = out.select("doc_id", F.split("text", start).alias("pieces"),
                     F.transform(F.zip_with(*around, lambda a, b: F.concat(a, b)), mark).alias("marks"))
    # Both columns are used more than once below, so they are worked out once, and not in a lambda.
    out = out.select("doc_id", "pieces", cut(F.col("pieces"), F.col("marks")).alias("cut"))
    old = F.filter(F.array_distinct(F.transform("cut", lambda c: c["old"])), lambda x: x.isNotNull())
    return out.select("doc_id", F.size(old).alias("n_values"),
                      F.substr(F.concat(F.get("pieces", F.lit(0)), F.array_join(F.transform("cut", lambda c: c["text"]), "")), F.lit(3)).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"))
