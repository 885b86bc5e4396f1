"""op3 against plain Python: the same permutations written with integers, and their inverses."""

import datetime as d
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from factloom.llm import pii
from factloom.llm.common import table

SF = "/root/testdata/sf0.001"
KEY = "a key"


def keyed(kind, r, half):
    return int(hashlib.sha256(f"{KEY}|{kind}|{r}|{half}".encode()).hexdigest()[:15], 16)


def feistel(left, right, n_left, n_right, kind, back=False):
    for r in range(3, -1, -1) if back else range(4):
        sign = -1 if back else 1
        if r % 2 == 0:
            left = (left + sign * keyed(kind, r, right)) % n_left
        else:
            right = (right + sign * keyed(kind, r, left)) % n_right
    return left, right


def digits(text, kind, back=False):
    h = len(text) // 2
    left, right = feistel(int(text[:h]), int(text[h:]), 10**h, 10 ** (len(text) - h), kind, back)
    return f"{left:0{h}d}{right:0{len(text) - h}d}"


def walk(text, kind, fits, back=False):
    text = digits(text, kind, back)
    while not fits(text):
        text = digits(text, kind, back)
    return text


def fill(shape, new):
    new = iter(new)
    return "".join(next(new) if c.isdigit() else c for c in shape)


def luhn(text):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(text)))


def issued(x):
    return x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"


def day(v):
    try:
        if v[4] == "-":
            return d.date.fromisoformat(v), "%Y-%m-%d"
        a, b, y = int(v[:2]), int(v[3:5]), int(v[6:])
        if v[2] == ".":
            return d.date(y, b, a), "%d.%m.%Y"
        return (d.date(y, b, a), "%d/%m/%Y") if a > 12 else (d.date(y, a, b), "%m/%d/%Y")
    except ValueError:
        return None


def plain(kind, v, back=False):
    """The pseudonym of a value, or the value of a pseudonym."""
    bare = "".join(c for c in v if c.isdigit())
    if kind == "card":
        body = digits(bare[:-1], "card", back)
        return fill(v, body + str(-luhn(body + "0") % 10))
    if kind == "ssn":
        return fill(v, walk(bare, "ssn", issued, back))
    if kind == "phone":
        head = "+1" if v.startswith("+1") else ""
        dialled = lambda x: x[0] > "1" and x[3] > "1"
        own = bare[len(head) // 2 :]
        return head + fill(v[len(head) :], walk(own, "phone", lambda x: dialled(x) == dialled(own), back))
    if kind == "ipv4":
        a, b, c, e = map(int, v.split("."))
        x, y = feistel(a * 256 + b, c * 256 + e, 65536, 65536, "ipv4", back)
        return f"{x >> 8}.{x & 255}.{y >> 8}.{y & 255}"
    if kind == "date":
        of, shape = day(v)
        base = d.date(1800, 1, 1).toordinal()
        while True:
            left, right = feistel(*divmod(of.toordinal() - base, 773), 189, 773, "date", back)
            of = d.date.fromordinal(base + left * 773 + right)
            if shape != "%d/%m/%Y" or of.day > 12:
                return of.strftime(shape)
    name, _, domain = v.partition("@")
    half = [name[: len(name) // 2], name[len(name) // 2 :]]
    for r in range(3, -1, -1) if back else range(4):
        other = half[1 - r % 2]
        digest = hashlib.sha512(f"{KEY}|email|{r}|{other}".encode()).digest()
        out = ""
        for k, c in enumerate(half[r % 2]):
            for low, n in (("a", 26), ("A", 26), ("0", 10)):
                if c.isascii() and ord(low) <= ord(c) < ord(low) + n:
                    c = chr(ord(low) + (ord(c) - ord(low) + (-1 if back else 1) * digest[k % 64]) % n)
                    break
            out += c
        half[r % 2] = out
    return f"{half[0]}{half[1]}@{domain}"


def pieces(v):
    """(text, kind) of a match: its values and what is between them."""
    bare = "".join(c for c in v if c.isdigit())
    if re.fullmatch("[0-9][0-9 -]*[0-9]", v) and len(bare) >= 13:
        cells = re.findall("[ -]?[0-9]+", v)
        groups = [c.strip(" -") for c in cells]
        good = lambda i, n: i + n <= len(groups) and 13 <= len(x := "".join(groups[i : i + n])) <= 19 and luhn(x) % 10 == 0
        shapes = [(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)]
        strong = [next((n for n, s in [(1, None), *((len(s), s) for s in shapes)] if good(i, n) and (s is None or tuple(map(len, groups[i : i + n])) == s)), 0) for i in range(len(groups))]
        out, i = [], 0
        while i < len(cells):
            n = strong[i] or next((n for n in range(min(19, len(cells) - i), 0, -1) if good(i, n) and not any(strong[i + 1 : i + n])), 0)
            gap = "" if cells[i][0].isdigit() else cells[i][0]
            if n:
                out += [(gap, None), ("".join(cells[i : i + n])[len(gap) :], "card")]
            else:
                out.append((cells[i], None))
            i += max(n, 1)
        return out
    if "@" in v:
        return [(v, "email")]
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", v):
        ok = all(int(p) < 256 and str(int(p)) == p for p in v.split("."))
        return [(v, "ipv4" if ok else None)]
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4}", v):
        of = day(v)
        return [(v, "date" if of and 1800 <= of[0].year < 2200 else None)]
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", v):
        return [(v, "ssn" if issued(bare) else None)]
    return [(v, "phone")]


MORE = ["a@b.co x.y+z@sub.ex-ample.org", "987-65-4321 and 123-45-6789", "(487) 555-7209, +1 187-155-7209, 487.555.7209", "01.02.2003 31.12.1799 12/31/2024 31/12/2024 2024-02-30", "1.2.3.4 256.1.1.1 01.2.3.4",
        "1000 4111 1111 1111 1111 123 5", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", None, ""]


def test_whole_texts_like_plain_python(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-k - 1, x) for k, x in enumerate(MORE)], "doc_id long, text string"))
    found = re.compile(pii.ANY, re.ASCII)
    seen = set()
    for r in docs.join(pii.pseudonymise(docs, KEY).withColumnRenamed("text", "new"), "doc_id").collect():
        if r["text"] is None:
            assert r["new"] is None
            continue
        kinds, out, at = [], "", 0
        for m in found.finditer(r["text"]):
            out, at = out + r["text"][at : m.start()], m.end()
            for v, kind in pieces(m[0]):
                out += plain(kind, v) if kind else v
                kinds += [kind] * bool(kind)
                if kind:
                    assert plain(kind, plain(kind, v), back=True) == v
        assert (r["new"], r["kinds"]) == (out + r["text"][at:], kinds), r["doc_id"]
        seen.update(kinds)
    assert seen == {"card", "email", "date", "phone", "ssn", "ipv4"}


def test_results_keep_their_class(spark):
    df = spark.range(4000).select(F.format_string("%03d-%02d-%04d", 1 + F.col("id") % 665, 1 + F.col("id") % 99, 1 + F.col("id")).alias("s"), F.format_string("(%03d) %03d-%04d", F.col("id") % 1000, F.col("id") * 7 % 1000, F.col("id")).alias("p"))
    rows = df.select("s", pii.ssn(F.col("s"), KEY).alias("ns"), "p", pii.phone(F.col("p"), KEY).alias("np")).collect()
    assert all(issued(r["ns"].replace("-", "")) for r in rows) and len({r["ns"] for r in rows}) == len({r["s"] for r in rows})
    dialled = lambda p: p[1] > "1" and p[6] > "1"
    assert all(dialled(r["p"]) == dialled(r["np"]) for r in rows) and len({r["np"] for r in rows}) == 4000


@pytest.mark.parametrize("text", ["x@" + "a." * 500_000 + "com", "x@" + "a" * 1_000_000, "a1" + "-b" * 500_000, "1-" * 60_000 + "1", "1000 " * 40_000, "1" * 1_000_000, "1." * 500_000, " " * 1_000_000], ids=str.__len__)
def test_very_long_texts(spark, text):
    out = pii.pseudonymise(spark.createDataFrame([(1, text + " 123-45-6789")], "doc_id long, text string"), KEY).first()
    assert "ssn" in out["kinds"] and out["text"][-11:] != "123-45-6789" and len(out["text"]) == len(text) + 12
