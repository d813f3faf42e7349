import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from dayspan.llm import pii

KEY = "test key"


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def iban(signs):
    s = signs.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def masked(spark, texts):
    df = spark.createDataFrame([(i, t, "k", "m") for i, t in enumerate(texts)], "doc_id int, text string, kinds string, masked string").repartition(3)
    return {r.row.doc_id: (r.masked, list(r["kinds"])) for r in pii.pseudonymised(df, "text", KEY).collect()}


def test_values_stay_valid_linked_and_apart(spark):
    rng = random.Random(6)
    cards = []
    while len(cards) < 40:
        d = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if luhn(d):
            cards.append(d)
    ips = [f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}" for _ in range(40)]
    days = [str(datetime.date(1900, 1, 1) + datetime.timedelta(days=rng.randrange(73000))) for _ in range(40)]
    phones = [f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(0, 9999):04d}" for _ in range(40)]
    numbers = [f"{rng.choice([1, 665, 667, 899, 123])}".zfill(3) + f"-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" for _ in range(40)]
    mails = [f"{rng.choice('abc')}{i}.x@m.example.org" for i in range(40)]
    kinds = {"card": cards, "ip": ips, "date": days, "phone": phones, "ssn": numbers, "email": mails}
    for kind, values in kinds.items():
        values = sorted(set(values))
        got = masked(spark, [f"see {v}, then {v}." for v in values])
        new = []
        for i, v in enumerate(values):
            text, found = got[i]
            m = re.fullmatch(r"see (.*), then (.*)\.", text)
            assert found == [kind, kind] and m[1] == m[2], (v, text)
            assert re.sub(r"[a-z]", "a", re.sub(r"\d", "0", m[1])) == re.sub(r"[a-z]", "a", re.sub(r"\d", "0", v)) or kind == "ip"
            new.append(m[1])
        assert len(set(new)) == len(values) and sum(a == b for a, b in zip(new, values)) <= 1
        if kind == "card":
            assert all(luhn(x) for x in new)
        if kind == "ip":
            assert all(all(int(p) < 256 for p in x.split(".")) for x in new)
        if kind == "date":
            assert all(datetime.date.fromisoformat(x) for x in new)
        if kind == "ssn":
            assert all(x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000" for x in new)


def test_formats_link_and_the_rest_stays(spark):
    texts = [
        "4041894974608795 4041-8949-7460-8795 4041 8949 7460 8795", "1987-03-25 1987/3/25 25.03.1987 03/25/1987 13/02/1999", "988-555-2485 +1 (988) 555-2485",
        "GB82 WEST 1234 5698 7654 32, GB82WEST12345698765432", None, "", "no values",
        "4041894974608796 300.1.1.1 1.2.3 1987-13-25 2101-01-01 1800-01-01 000-12-3456 666-12-3456 123-00-4567 0000000000000 GB83WEST12345698765432 v1.2.3.4.5 @ a@b (123) 555-0000",
        "x" * 200_000 + " 10.0.0.1", "A.b@Ex.org a.b@ex.org",
    ]
    got = masked(spark, texts)
    a = got[0][0].split(" ", 2)
    assert a[0] == a[1].replace("-", "") == a[2].replace(" ", "") and luhn(a[0]) and got[0][1] == ["card"] * 3
    d = got[1][0].split(" ")
    assert d[0].split("-") == d[1].split("/") == d[2].split(".")[::-1] and d[3].split("/") == [d[0].split("-")[i] for i in (1, 2, 0)] and got[1][1] == ["date"] * 5
    p = got[2][0].split(" ", 1)
    assert re.sub(r"\D", "", p[1]) == "1" + p[0].replace("-", "")
    b = got[3][0].split(", ")
    assert b[0].replace(" ", "") == b[1] and iban(b[1]) and b[1][:2] == "GB"
    assert [got[i] for i in (4, 5, 6)] == [(None, []), ("", []), ("no values", [])]
    assert got[7] == (texts[7], [])
    assert got[8][0].startswith("x" * 200_000 + " ") and got[8][1] == ["ip"]
    assert len(set(got[9][0].split(" "))) == 1


def test_values_with_digits_or_words_beside_them(spark):
    card, amex = "4111 1111 1111 1111", "3782 822463 10005"
    texts = [
        f"card {card} 12/27", f"card {card} 123", f"no 12 {card}, {amex} 1234", "5500-0055 5555-5559", "55000055 55555559", f"{card} 5500 0055 5555 5559 {card}",
        f"{card} 12/27/2024", f"2024-01-02 {card} 10.0.0.1 {card} 988-555-2485", f"{card} 12@ex.org", " ".join(["7"] * 3000 + [card] + ["7"] * 3000),
        "ES91 2100 0418 4502 0005 1332 BIC CAIXESBB", "BE68 5390 0754 7034 BIC KREDBEBB", "BE68539007547034 ABC", "at 2024-01-02T10:00:00Z", "4111-1111-1111-1111-1",
        "1999 2000 2001 2002 2003 2004 2005 2006 2007 2008", "11 12 13 14 15 16 17 18 19 20", "4111 1111 1111 1112 12/27", f"{card}x",
    ]
    kinds = ["card"], ["card"], ["card"] * 2, ["card"], ["card"], ["card"] * 3, ["card", "date"], ["date", "card", "ip", "card", "phone"], ["card", "email"], ["card"], ["iban"], ["iban"], ["iban"], ["date"], ["card"]
    got = masked(spark, texts)
    for i, want in enumerate(kinds):
        assert got[i][1] == want, (texts[i][-200:], got[i])
        assert re.sub("[A-Za-z]", "a", re.sub(r"\d", "0", got[i][0])) == re.sub("[A-Za-z]", "a", re.sub(r"\d", "0", texts[i])) or i == 7
    for i in range(len(kinds), len(texts)):
        assert got[i] == (texts[i], [])
    new = got[0][0][5:24]
    assert luhn(new.replace(" ", "")) and new != card and got[0][0] == f"card {new} 12/27" and got[1][0] == f"card {new} 123" and got[14][0] == f"{new}-1".replace(" ", "-")
    assert got[2][0].startswith(f"no 12 {new}, 3") and got[2][0].endswith(" 1234") and got[9][0].strip("7 ") == new.strip("7 ")
    assert got[3][0].replace("-", "").replace(" ", "") == got[4][0].replace(" ", "") == got[5][0][20:39].replace(" ", "")
    assert iban(got[10][0][:29]) and got[10][0][29:] == texts[10][29:] and iban(got[11][0][:19]) and got[12][0] == got[11][0][:19].replace(" ", "") + " ABC"
    assert re.fullmatch(r"at \d{4}-\d\d-\d\dT10:00:00Z", got[13][0]) and "2024-01-02" not in got[13][0]


@pytest.mark.parametrize("size", [(7, 5), (1, 3), (10, 10)])
def test_pairs_are_permuted(spark, size):
    n, m = size
    df = spark.range(n * m).select(pii.permuted_pair(KEY, "t", F.floor(F.col("id") / m), F.col("id") % m, n, m).alias("p"))
    assert {(r.p.l, r.p.r) for r in df.collect()} == {(i, j) for i in range(n) for j in range(m)}


def test_strings_are_permuted(spark):
    df = spark.range(1000).select(pii.permuted_signs(KEY, "t", F.lpad(F.col("id").cast("string"), 3, "0")).alias("s"))
    assert len({r.s for r in df.collect() if re.fullmatch(r"\d{3}", r.s)}) == 1000


def test_empty(spark):
    assert pii.pseudonymised(spark.createDataFrame([], "doc_id int, text string"), "text", KEY).count() == 0
