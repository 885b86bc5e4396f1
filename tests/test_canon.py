import pytest
from pyspark.sql import functions as F

from factloom.functions import canon

SAME = [("$12,500", "12500"), ("12,500 USD", "12500"), ("26.7", "$26.70"), (".50", "0.5"), ("15%", "15"), ("1.2M", "1200000"), ("2k", "2,000"), ("１２", "12"),
        ("2025-04-18", "Apr 18, 2025"), ("2025-04-18", "April 18th, 2025"), ("2025-04-18", "18 Apr 2025"), ("2025-04-18", "04/18/2025"), ("2025-04-18", "04/18/25"), ("2025-09-03", "Sept 3, 2025"),
        ("CA/NY/TX", "ca, ny, tx"), ("Straße", "STRASSE"), ("“Contoso”", "contoso"), ("New York", "new york")]
OTHER = [("12500", "12501"), ("-500", "500"), ("2025-04-18", "2025-04-19"), ("2025-04-18", "2024-04-18"), ("New York", "NY"), ("Contoso Media", "Contoso Medias"), ("15", "2025-04-15")]
NO_NUMBER = ["IO-42-0071", "A25-54", "", "CTV", "-$5", "1 2"]


@pytest.fixture(scope="module")
def keys(spark):
    values = sorted({v for pair in [*SAME, *OTHER] for v in pair} | set(NO_NUMBER))
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r["v"]: r["k"] for r in df.select("v", canon.key(F.col("v")).alias("k")).collect()}


@pytest.mark.parametrize("left,right", SAME)
def test_same(keys, left, right):
    assert keys[left] == keys[right]


@pytest.mark.parametrize("left,right", OTHER)
def test_other(keys, left, right):
    assert keys[left] != keys[right]


@pytest.mark.parametrize("value", NO_NUMBER)
def test_no_number(keys, value):
    assert not keys[value].startswith("n:")


def test_dates_and_forms(spark):
    df = spark.createDataFrame([("2025-02-30", "342000", "Back-to-school"), ("April 2025", "1234", "one")], "d string, n string, t string")
    r = df.select(canon.date(F.col("d")), canon.month_of(F.col("d")), canon.money(F.col("n")), canon.title(F.col("t")), canon.natural(F.lit("2025-04-24")), canon.bare(F.lit("(Northwind's),"))).collect()
    assert tuple(r[0]) == (None, None, "$342,000", "Back-To-School", "April 24, 2025", "Northwind")
    assert r[1][1] == 202504


def test_numbers_are_exact(spark):
    cases = {"9" * 40: "9" * 40, "1.00000000001": "1.00000000001", "1.000000000020": "1.00000000002", "0012.50": "12.5", "1.2345k": "1234.5", "1.5bn": "1500000000", "-0.0": "0", "-.5": "-0.5", "0.0000001M": "0.1", "$1,234,567.10": "1234567.1"}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", canon.number(F.col("v")).alias("n"), canon.key(F.col("v")).alias("k"))
    assert {r["v"]: (r["n"], r["k"]) for r in df.collect()} == {k: (v, "n:" + v) for k, v in cases.items()}


def test_unicode_like_its_database(spark):
    import unicodedata

    texts = ["ﬁne １２ ½", "İstanbul ǅ Straße", "Å e\u0301 ﷺ", "“a” – b…\u00a0c", "ΑΣ ς", "한글 ㎏", "\U0001d400\ufb01"]
    quotes = canon.QUOTES
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(canon.unify(F.col("t")), canon.fold(F.col("t"))).collect()
    for x, r in zip(texts, got, strict=True):
        assert r[0] == "".join(quotes.get(c, c) for c in unicodedata.normalize("NFKC", x)) and r[1] == x.casefold()
