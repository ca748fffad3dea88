"""Pseudonyms keep formats and link equal values."""

import datetime
import hashlib
import re
import time

from pyspark.sql import functions as F

from sylva.llm import pii


def test_pseudonyms(spark):
    rows = [(1, "4111 1111 1111 1111 or 4111-1111-1111-1111, 123-45-6789 on 2001-02-03, 2001-02-30."), (2, "4111111111111111 4111111111111112 123-45-6789"),
            (3, None), (4, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, pairs int")
    got = {r.doc_id: (r.n_values, r.text) for r in pii.pseudonymise(df).collect()}
    one, two = got[1][1], got[2][1].split(" ")
    assert got[1][0] == 4 and got[2][0] == 2 and got[3] == got[4] == (0, "")
    assert one[:19].replace(" ", "") == one[23:42].replace("-", "") == two[0] != "4111111111111111"
    assert two[1] == "4111111111111112" and two[2] in one and "2001-02-30" in one and "2001-02-03" not in one
    assert pii.pseudonymise(df.limit(0)).count() == 0


def test_values_behind_and_before_other_numbers(spark):
    texts = ["paid 2024 4111 1111 1111 1111 today", "4111 1111 1111 1111-visa", "no-4111-1111-1111-1111", "1-4111 1111 1111 1111",
             "4111 1111 1111 1111 1111 1111 1111 4111", "日本 𝒳 123-45-6789|123-45-6789"]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()]
    new = got[1][:19]
    assert new != "4111 1111 1111 1111" and got[0] == f"paid 2024 {new} today" and got[1] == new + "-visa"
    assert got[2] == "no-" + new.replace(" ", "-") and got[3] == texts[3]
    assert got[4].startswith(new + " ") and len(got[4]) == len(texts[4])
    ssn = got[5][5:16]
    assert got[5] == f"日本 𝒳 {ssn}|{ssn}" and ssn != "123-45-6789"


def test_other_numbers(spark):
    cards = ["4222222222222", "30569309025904", "378282246310005", "3782 822463 10005", "3056 930902 5904", "4000 0000 0000 0000 006", "4000000000000000006"]
    ibans = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947"]
    dates = ["03.02.2001", "03/02/2001", "02/28/2001", "2099-11-13", "2099-12-31", "31.12.2099"]
    phones = ["+1 (555) 123-4567", "+15551234567", "(555) 234-5678", "555-234-5678", "+4915123456789", "+7 (012) 345-6789"]
    quads = ["192.168.0.1", "255.255.255.255"]
    kept = ["4222222222223", "DE88 3704 0044 0532 0130 00", "30.02.2001", "256.1.1.1", "1.2.3.4.5", "1700000000000", "123-456-7890"]
    values = cards + ibans + dates + phones + quads
    rows = [(i, f"a {v}, b: {v}.") for i, v in enumerate(values + kept)] + [(99, "IBAN DE89 3704 0044 0532 0130 00 EUR, 4111 1111 1111 1111 123")]
    got = {r.doc_id: (r.n_values, r.text) for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    new = {}
    for i, v in enumerate(values):
        n, text = got[i]
        new[v] = text[2:text.index(", b: ")]
        assert n == 1 and text == f"a {new[v]}, b: {new[v]}." and new[v] != v, (v, text)
        if v not in quads:
            assert [c if not c.isdigit() else "d" for c in new[v]] == [c if not c.isdigit() else "d" for c in v]
    for i, v in enumerate(kept):
        assert got[len(values) + i] == (0, f"a {v}, b: {v}.")
    for v in cards:
        d = [int(c) for c in reversed(new[v]) if c.isdigit()]
        assert sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2]) and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0
    for v in ibans:
        u = new[v].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in u[4:] + u[:4])) % 97 == 1 and u[:2] == v[:2]
    assert all(0 <= int(o) < 256 for v in quads for o in new[v].split("."))
    assert new[ibans[0]].replace(" ", "") == new[ibans[1]] and new[cards[5]].replace(" ", "") == new[cards[6]]
    assert new["03.02.2001"].split(".") == new["03/02/2001"].split("/") and new["2099-12-31"].split("-") == new["31.12.2099"].split(".")[::-1]
    assert new["+1 (555) 123-4567"][-13:].replace(") ", "").replace("-", "") in new["+15551234567"]
    assert got[99][0] == 2 and f"IBAN {new[ibans[0]]} EUR" in got[99][1] and got[99][1].endswith(" 123")


def test_dates_are_permuted(spark):
    days = spark.range(pii.LAST).select("id", F.expr("date_format(date_add(date'1900-01-01', int(id)), 'dd.MM.yyyy')").alias("text"))
    rows = pii.pseudonymise(days, id_col="id").collect()
    got = [r.text for r in rows]
    assert all(r.n_values == 1 for r in rows) and len(set(got)) == pii.LAST and all("1900" <= t[6:] <= "2099" for t in got)


def plain_feistel(a, b, na, nb, key):
    for k in range(pii.ROUNDS):
        d = int(hashlib.sha256(f"{key}/{k}/{b if k % 2 == 0 else a}".encode()).hexdigest()[:13], 16)
        a, b = ((a + d) % na, b) if k % 2 == 0 else (a, (b + d) % nb)
    return a, b


def plain_digits(x, key):
    half = -(-len(x) // 2)
    a, b = plain_feistel(int(x[:half]), int(x[half:]), 10**half, 10**(len(x) - half), key)
    return f"{a:0{half}d}{b:0{len(x) - half}d}"


def refilled(old, new):
    new = iter(new)
    return "".join(next(new) if c.isdigit() else c for c in old)


def plain_card(v, key):
    d = re.sub(r"\D", "", v)
    new = plain_digits(d[:-1], f"{key}/card")
    twice = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(new)))
    return refilled(v, new + str(-twice % 10))


def plain_iban(v, key):
    u = v.replace(" ", "")
    own = refilled(u[4:], plain_digits(re.sub(r"\D", "", u[4:]), f"{key}/iban"))
    check = 98 - int("".join(str(int(c, 36)) for c in own + u[:2] + "00")) % 97
    return refilled(v, f"{check:02d}" + re.sub(r"\D", "", own))


def plain_phone(v, key):
    d = re.sub(r"\D", "", v)
    n = max(len(d) - 10, int(v.startswith("+")))
    return refilled(v, d[:n] + plain_digits(d[n:], f"{key}/phone"))


def plain_quad(v, key):
    o = list(map(int, v.split(".")))
    a, b = plain_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 2**16, 2**16, f"{key}/ipv4")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def plain_ssn(v, key):
    a, b = plain_feistel(int(v[:3] + v[4:6]), int(v[7:]), 10**5, 10**4, f"{key}/ssn")
    return f"{a:05d}"[:3] + "-" + f"{a:05d}"[3:] + f"-{b:04d}"


def plain_date(v, key, form):
    first = datetime.date(1900, 1, 1)
    day = (datetime.datetime.strptime(v, form).date() - first).days
    while True:
        a, b = plain_feistel(day // pii.DAYS[1], day % pii.DAYS[1], *pii.DAYS, f"{key}/date")
        day = a * pii.DAYS[1] + b
        if day < pii.LAST:
            return (first + datetime.timedelta(day)).strftime(form)


def test_every_format_against_plain_python(spark):
    """The same permutations, written a second time."""
    values = {v: plain_card for v in ("4222222222222", "30569309025904", "3782 822463 10005", "4111-1111-1111-1111", "4000 0000 0000 0000 006")}
    values |= {v: plain_iban for v in ("DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "NO93 8601 1117 947")}
    values |= {v: plain_phone for v in ("+1 (555) 123-4567", "+4915123456789", "(555) 234-5678", "555-234-5678")}
    values |= {"123-45-6789": plain_ssn, "192.168.0.1": plain_quad, "10.0.0.255": plain_quad}
    for form, days in (("%Y-%m-%d", ("1900-01-01", "2099-12-31", "2024-02-29")), ("%d.%m.%Y", ("31.12.1999",)), ("%d/%m/%Y", ("01/02/2003",)),
                       ("%m/%d/%Y", ("02/28/2001",))):
        values |= {v: lambda v, key, form=form: plain_date(v, key, form) for v in days}
    rows = list(enumerate(values))
    for key in ("one", "another"):
        got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string"), key).collect()}
        assert {v: got[i] for i, v in rows} == {v: new(v, key) for v, new in values.items()}


def test_the_key(spark):
    df = spark.createDataFrame([(1, "192.168.0.1"), (2, "192.168.0.1")], "doc_id bigint, text string")
    once, again = ([r.text for r in pii.pseudonymise(df).collect()] for _ in range(2))
    assert len(set(once)) == len(set(again)) == 1 and once != again
    spark.conf.set("spark.sylva.pseudonyms.key", "k")
    try:
        assert {r.text for r in pii.pseudonymise(df).collect()} == {plain_quad("192.168.0.1", "k")}
    finally:
        spark.conf.unset("spark.sylva.pseudonyms.key")


def test_texts_with_very_many_values(spark):
    """Twice the values, about twice the time: not four times. And none is missed."""
    def took(text, n):
        t = time.time()
        row = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "k").first()
        return time.time() - t, row

    quads = [f"10.{i >> 16}.{i >> 8 & 255}.{i & 255}" for i in range(20_000)]
    took(" ".join(quads[:10]), 10)
    sec, row = took("\n".join(quads), 20_000)
    assert row.n_values == 20_000 and row.text == "\n".join(plain_quad(q, "k") for q in quads)
    assert sec < 150     # 2,000 took 173 seconds, by the square of their number
    # Cards one behind the other by blanks: every fourth digit group starts a candidate inside a value.
    cards = " ".join(["4111 1111 1111 1111"] * 5_000)
    sec, row = took(cards, 20_000)
    assert row.n_values == 1 and row.text == " ".join([plain_card("4111 1111 1111 1111", "k")] * 5_000) and sec < 150
