from pyspark.sql import functions as F

from factloom.functions import extract


def index(spark, text):
    return extract.text_index(spark.createDataFrame([(text,)], "text string")).select("idx.*").first()


def holds(spark, text, *wanted):
    idx = extract.text_index(spark.createDataFrame([(text,)], "text string"))
    df = idx.crossJoin(spark.createDataFrame([(w,) for w in wanted], "w string"))
    found = {r["w"]: r["h"] for r in extract.with_value(df, "w").select("w", extract.holds(F.col("idx")).alias("h")).collect()}
    return [found[w] for w in wanted]


def test_everything_in_one_text(spark):
    r = index(spark, "Mr. Smith met Contoso Media on April 18, 2025. The budget is $1.2M for IO-42-0071, not 342,000.\nSee 2025-02-30 in May 2025; Northwind's Line A25-54 ok. Rates: $26.50.")
    assert r["seg_norm"][0] == "mr smith met contoso media on april 18 2025"
    assert [d["surface"] for d in r["dates"]] == ["April 18, 2025"]
    assert [m["month"] for m in r["months"]] == [202505]
    assert "Contoso Media" in r["names"] and "IO-42-0071" in r["names"] and "s" not in r["names"]
    numbers = [n["surface"] for n in r["numbers"]]
    assert numbers[:2] == ["$1.2M", "342,000"] and "$26.50" in numbers and "42" not in numbers


def test_dates_in_order_of_format(spark):
    r = index(spark, "04/18/2025 then 18 Apr 2025, Apr 19, 2025 and 2025-04-20")
    assert [str(d["day"]) for d in r["dates"]] == ["2025-04-20", "2025-04-19", "2025-04-18", "2025-04-18"]
    assert not r["numbers"]


def test_containment(spark):
    text = "The rate is $12,500 for New York Line.\nIt ran to 04/18/2025. Inactive"
    assert holds(spark, text, "12500", "2025-04-18", "new york", "New York Line", "active", "Line It", "york line it", "", "12501") == [True, True, True, True, False, False, False, False, False]


def test_needle_longer_than_text(spark):
    assert holds(spark, "one", "one two three") == [False]


def test_null_and_empty(spark):
    df = extract.text_index(spark.createDataFrame([(None,), ("",), ("\n \n",)], "text string"))
    assert all(not r["n"] for r in df.select(F.size("idx.numbers").alias("n")).collect())


def test_supported_names(spark):
    phrases = F.array(F.lit("northwind traders"), F.lit("fabrikam studios"))
    cases = {"northwind": True, "northwind and fabrikam studios": True, "the rate": True, "northwind and acme": False, "acme": False, "": True}
    df = spark.createDataFrame([(k,) for k in cases], "n string").select("n", extract.supports_name(F.filter(F.split("n", " "), lambda x: x != ""), phrases).alias("ok"))
    assert {r["n"]: r["ok"] for r in df.collect()} == cases


def codes(text):
    """Places of words of letters, digits and single hyphens that have a letter and a digit, but for amounts such as 2M."""
    out, i = [], 0
    while i < len(text):
        if not (text[i].isalnum() or text[i] in "-_"):
            i += 1
            continue
        j = i
        while j < len(text) and (text[j].isalnum() or text[j] in "-_"):
            j += 1
        word = text[i:j]
        parts = word.split("-")
        whole = all(p.isalnum() for p in parts) and any(c.isalpha() for c in word) and any(c.isdigit() for c in word)
        head = word.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
        amount = head.isdigit() and word[len(head) :].lower() in ("k", "m", "mm", "b", "bn")
        if whole and not amount:
            out.append((i, j))
        i = j
    return out


def scan(text):
    """Numbers of a text without dates, read character by character."""
    chars = list(text)
    for a, b in codes(text):
        chars[a:b] = " " * (b - a)
    text, out, i = "".join(chars), [], 0
    digits = lambda k: next((j for j in range(k, len(text)) if not text[j].isdigit()), len(text))
    while i < len(text):
        if i and (text[i - 1].isalnum() or text[i - 1] == "."):
            i += 1
            continue
        k = i + 1 if text[i] == "$" else i
        while k < len(text) and text[k].isspace():
            k += 1
        if k < len(text) and text[k] == "-":
            k += 1
        j = digits(k)
        if 1 <= j - k <= 3 and text[j : j + 1] == "," and digits(j + 1) >= j + 4:
            while text[j : j + 1] == "," and digits(j + 1) >= j + 4:
                j += 4
            if text[j : j + 1].isdigit():  # three digits of a longer run: the group isn't one
                j = digits(k)
        if text[j : j + 1] == "." and text[j + 1 : j + 2].isdigit():
            j = digits(j + 1)
        elif j == k:
            i += 1
            continue
        if text[j : j + 1].isdigit():
            i += 1
            continue
        word = j
        while word < len(text) and text[word].isspace():
            word += 1
        end = next((w for w in range(word, len(text)) if not (text[w].isalnum() or text[w] == "_")), len(text))
        if text[word:end].lower() in ("k", "m", "mm", "b", "bn"):
            j = end
        pct = j
        while pct < len(text) and text[pct].isspace():
            pct += 1
        if text[pct : pct + 1] == "%":
            j = pct + 1
        out.append(text[i:j].strip())
        i = j
    return out


TEXTS = ["a 12 b 3.5c", "x12 y-4 .5", "1,234,567 and 12,34", "9" * 40, "v1.2 10.0.0.1", "See A1 then A12", "A12 12 A12 12", "rate 12 % of 3 M, $ 5 and -7.25", "2M 2Mx IO-42-0071 42", "1.00000000001 or 1.00000000002", "IO-42-0071, again IO-42-007 and 0071"]


def test_numbers_like_a_plain_scan(spark):
    df = extract.text_index(spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string"))
    got = {r["k"]: [n["surface"] for n in r["idx"]["numbers"]] for r in df.collect()}
    assert got == {k: scan(x) for k, x in enumerate(TEXTS)}


def test_values_are_masked_by_place(spark):
    r = index(spark, "Due 2025-04-18 under ref 12025-04-18 now")
    assert [n["surface"] for n in r["numbers"]] == ["12025", "04", "18"] and [str(d["day"]) for d in r["dates"]] == ["2025-04-18"]
    # a date that starts before another one is its own; one that starts inside isn't
    r = index(spark, "On 18 April 2025-04-19 it was 2025-02-30")
    assert sorted(str(d["day"]) for d in r["dates"]) == ["2025-04-18", "2025-04-19"] and [n["surface"] for n in r["numbers"]] == ["2025", "02", "30"]
    r = index(spark, "May 5, 2025 and May 2025, May 5, 2025")
    assert len(r["dates"]) == 2 and [m["month"] for m in r["months"]] == [202505] and not r["numbers"]


def test_very_long_tokens(spark):
    for text in ("a1" + "-b" * 300_000 + " 7", "The " * 20_000 + "7", "of " * 5_000 + "7", "." * 300_000 + "7 7", "12 " * 3_000):
        assert index(spark, text)["numbers"][-1]["surface"] in ("7", "12")


def test_running_sums_and_maxima(spark):
    lists = [[(k * 37 + n) % 101 for k in range(n)] for n in (0, 1, 2, extract.BLOCK - 1, extract.BLOCK, extract.BLOCK + 1, 5 * extract.BLOCK + 7)]
    df = spark.createDataFrame([(x,) for x in lists], "x array<int>")
    for r in df.select("x", extract.running(F.col("x"), lambda a, b: a + b).alias("s"), extract.running(F.col("x"), F.greatest).alias("m")).collect():
        assert r["s"] == [sum(r["x"][:k]) for k in range(len(r["x"]))] and r["m"] == [max(r["x"][:k], default=0) for k in range(len(r["x"]))]


def test_spans_stand_apart_as_by_all_pairs(spark):
    import random

    r = random.Random(4)

    def made():
        at, out = 0, []
        while len(out) < r.randrange(40):
            at += r.randrange(4)
            out.append((f"s{at}", str(at), at, at + r.randrange(1, 5)))
            at = out[-1][3]
        return out

    rows = [(k, made(), made()) for k in range(60)]
    df = spark.createDataFrame(rows, f"k int, x {extract._SPANS}, t {extract._SPANS}")
    for row in df.select("k", extract._apart(F.col("x"), F.col("t"), True).alias("a"), extract._apart(F.col("x"), F.col("t"), False).alias("b")).collect():
        _, x, t = rows[row["k"]]
        assert sorted(map(tuple, row["a"])) == sorted(h for h in x if not any(a <= h[2] < b for _, _, a, b in t))
        assert sorted(map(tuple, row["b"])) == sorted(h for h in x if not any(a < h[3] and h[2] < b for _, _, a, b in t))


def test_a_long_line_takes_time_in_proportion(spark):
    import time

    def taken(n):
        line = " ".join(f"2024-0{1 + k % 9}-1{k % 10} März IO-{k}A {k},000 on March {1 + k % 28}, 2024, in May 2031" for k in range(n))
        start = time.perf_counter()
        r = extract.text_index(spark.createDataFrame([(line,)], "text string")).select(*(F.size(f"idx.{c}").alias(c) for c in extract.PARTS), F.col("idx.numbers").getItem(0)["surface"].alias("first")).first()
        assert (r["dates"], r["months"], r["first"]) == (2 * n, n, "0,000") and r["numbers"] >= n and r["names"] >= n
        return time.perf_counter() - start

    taken(10)
    assert taken(16_000) < 8 * taken(4_000) + 5  # of quadratic work it would be sixteen times as much


def test_numbers_of_the_documents_like_a_plain_scan(spark):
    lines = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.explode(F.split("text", "[\n\r\x0b\x0c]")).alias("text")).where(~F.col("text").rlike(r"[^\x20-\x7E]") & F.col("text").rlike("[0-9]")).distinct()
    rows = extract.text_index(lines, parts=("dates", "months", "numbers")).where("size(idx.dates) = 0 AND size(idx.months) = 0").select("text", "idx.numbers.surface").collect()
    assert len(rows) > 50
    for text, found in rows:
        assert found == scan(text), text


def test_texts_are_indexed_by_many_tasks(spark, tmp_path):
    """Orders in one file of one row group are dealt out before their texts are indexed, without loss."""
    from factloom.plans import texts

    path = f"{tmp_path}/orders.parquet"
    spark.range(3 * texts.TEXTS).selectExpr("id AS o_orderkey", "double(id) AS o_totalprice", "timestamp'1996-05-04' AS o_orderdate").coalesce(1).write.parquet(path)
    said = texts._sentences(spark, str(tmp_path))
    assert said.rdd.getNumPartitions() == 3 and said.select("k").distinct().count() == said.count() == 3 * texts.TEXTS


def test_audited_texts_are_dealt_out(spark, tmp_path):
    """Customers in one file of one row group become questions, facts and texts of many files, each of which a task reads, without loss."""
    from factloom.plans import texts

    path = f"{tmp_path}/customer.parquet"
    spark.range(3 * texts.TEXTS).selectExpr("id AS c_custkey", "'Customer ' || id AS c_name").coalesce(1).write.parquet(path)
    questions, facts, corpus = texts._audited(spark, str(tmp_path))
    assert [len(df.inputFiles()) for df in (questions, facts, corpus)] == [3, 6, 3]  # facts are of two parts, true ones and lies
    assert questions.select("question_id").distinct().count() == questions.count() == corpus.count() == facts.where("NOT injection").count() == 3 * texts.TEXTS
