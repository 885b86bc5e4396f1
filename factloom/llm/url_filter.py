"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Glob rules are packed into multiword Shift-And masks. Every pattern has a start
bit and one bit a literal position; `*` (no slash), `**` (anything) and `?` (one
character but a slash) turn into self-loops and byte classes. One step moves all
patterns by one byte of the URL, for all URLs of a batch at once:

    next = ((state << 1) & enter[byte]) | (state & stay[byte])

with the carry between words. A pattern accepts if its last bit is set when
the URL ends. Rules are bounded (MAX_BITS), URLs are not: they are read from one
flat buffer, longest first, and leave the step when they end.

A canonical URL is "." + host + path. Site rules (host, path) become the globs
`**.host path **` with a host part that can't run into the path; of those that
accept, the longest rule decides, and of equally long ones the first. URLs that
no site rule fits are judged by the glob rules: the longest that accepts, else
DEFAULT.

Defined results: a null URL or one without `://` has an empty host and path,
and no site rule fits it. The host is what follows the first `://`, so it keeps
a port or user name. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, workers_import_us

#: The rules of the query, (verdict, host, path).
SITE_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Globs for URLs without a site rule, (verdict, glob over "." + host + path).
GLOB_RULES = (
    ("block", "**cheap-pills**"),
    ("block", "**free-bets**"),
    ("block", "**casino**"),
    ("block", "**.xxx/**"),
)
DEFAULT = "allow"
MAX_BITS = 1 << 20
#: Words of 64 bits that the states of the texts in step may take.
STATE = 1 << 20

_ANY = np.ones(256, dtype=bool)
_NO_SLASH = _ANY.copy()
_NO_SLASH[ord("/")] = False


def _escaped(text: str) -> list:
    """A glob's items for literal text."""
    return list(text.encode())


def _items(glob: str) -> list:
    """Bytes, and "*", "**" or "?" for wildcards."""
    out: list = []
    raw, at = glob.encode(), 0
    while at < len(raw):
        if raw[at : at + 2] == b"**":
            out.append("**")
            at += 2
        elif raw[at : at + 1] in (b"*", b"?"):
            out.append(raw[at : at + 1].decode())
            at += 1
        else:
            out.append(raw[at])
            at += 1
    return out


@dataclass
class Automaton:
    """enter, stay: [256, words] masks; first: the state before any byte; last: (word, bit) of each pattern's end."""

    enter: np.ndarray
    stay: np.ndarray
    first: np.ndarray
    last: list[tuple[int, int]]


def compile_rules(patterns: list[list]) -> Automaton:
    """Packs patterns (lists of items) one after the other into 64-bit words."""
    starts, total = [], 0
    for items in patterns:
        starts.append(total)
        total += 1 + sum(i not in ("*", "**") for i in items)
    if total > MAX_BITS:
        raise ValueError(f"the rules need {total} bits, over {MAX_BITS}")
    words = max(1, -(-total // 64))
    enter, stay = np.zeros((256, words), dtype=np.uint64), np.zeros((256, words), dtype=np.uint64)
    first, last = np.zeros(words, dtype=np.uint64), []

    def put(masks: np.ndarray, which: np.ndarray, bit: int) -> None:
        masks[which, bit // 64] |= np.uint64(1 << bit % 64)

    for start, items in zip(starts, patterns, strict=True):
        bit = start
        first[bit // 64] |= np.uint64(1 << bit % 64)
        for item in items:
            if item == "*":
                put(stay, _NO_SLASH, bit)
            elif item == "**":
                put(stay, _ANY, bit)
            else:
                bit += 1
                put(enter, _NO_SLASH if item == "?" else np.arange(256) == item, bit)
        last.append((bit // 64, bit % 64))
    return Automaton(enter, stay, first, last)


def decide(automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first pattern that accepts each text, -1 if none does; so many texts at a time that states stay under STATE words."""
    n = len(offsets) - 1
    step = max(1, STATE // automaton.enter.shape[1])
    out = np.full(n, -1)
    for at in range(0, n, step):
        hits = simulate(automaton, data, offsets[at : at + step + 1])
        if hits.shape[1]:
            out[at : at + step] = np.where(hits.any(axis=1), hits.argmax(axis=1), -1)
    return out


def simulate(automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which patterns accept: [texts, patterns] booleans, for texts data[offsets[k]:offsets[k + 1]]."""
    n, words = len(offsets) - 1, automaton.enter.shape[1]
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    begin, left = offsets[:-1][order], lengths[order]
    state = np.repeat(automaton.first[None, :], n, axis=0)
    one, top = np.uint64(1), np.uint64(63)
    active = n
    for t in range(int(left[0]) if n else 0):
        active = int(np.searchsorted(-left[:active], -t, side="left"))  # those with more than t bytes
        now = state[:active]
        byte = data[begin[:active] + t]
        moved = now << one
        if words > 1:
            moved[:, 1:] |= now[:, :-1] >> top
        state[:active] = (moved & automaton.enter[byte]) | (now & automaton.stay[byte])
    out = np.empty((n, len(automaton.last)), dtype=bool)
    for k, (word, bit) in enumerate(automaton.last):
        out[order, k] = (state[:, word] >> np.uint64(bit)) & one != 0
    return out


def site_items(host: str, path: str) -> list:
    """host and all its subdomains, and any path that starts with path."""
    return ["*", *_escaped("." + host), *_escaped(path), "**"]


def host_of(url: Column) -> Column:
    return _lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", site_rules=SITE_RULES, glob_rules=GLOB_RULES, default: str = DEFAULT) -> DataFrame:
    """Rows (id, host, path, rule, verdict, glob_rule), one for each row of pages; glob_rule: the glob rule that decided."""
    workers_import_us(pages.sparkSession)
    # longest first, so that the first rule that accepts decides
    sites = sorted(site_rules, key=lambda r: -len(r[1] + r[2]))
    globs = sorted(glob_rules, key=lambda r: -len(r[1]))
    automaton = compile_rules([site_items(h, p) for _, h, p in sites] + [_items(g) for _, g in globs])
    names = np.array([h + p for _, h, p in sites] + [g for _, g in globs] + [""], dtype=object)
    verdicts = np.array([v for v, *_ in [*sites, *globs]] + [default], dtype=object)
    n_sites = len(sites)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path = batch.column(1), batch.column(2)
            both = pa.compute.binary_join_element_wise(".", host, path, "").cast(pa.large_binary())
            offsets = np.frombuffer(both.buffers()[1], dtype=np.int64)[both.offset : both.offset + len(both) + 1]
            data = np.frombuffer(both.buffers()[2] or b"", dtype=np.uint8)
            chosen = decide(automaton, data, offsets)
            site, glob = (chosen >= 0) & (chosen < n_sites), chosen >= n_sites
            found = names[chosen]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), host, path, pa.array(found, pa.string(), mask=~site), pa.array(verdicts[chosen], pa.string()), pa.array(found, pa.string(), mask=~glob)],
                names=["id", "host", "path", "rule", "verdict", "glob_rule"],
            )

    slim = pages.select(F.col(id_col).cast("long").alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return slim.mapInArrow(run, "id long, host string, path string, rule string, verdict string, glob_rule string").withColumnRenamed("id", id_col)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP4_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
globs(verdict, gname, pattern) AS (VALUES
  ('block', '**cheap-pills**', 'cheap-pills'), ('block', '**free-bets**', 'free-bets'), ('block', '**casino**', 'casino'), ('block', '**.xxx/**', '.xxx/')),
fits AS (
  SELECT p.page_id, p.host, p.path,
         (SELECT arg_max(struct_pack(r := rhost || rpath, v := verdict), length(rhost || rpath)) FROM rules
          WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS site,
         (SELECT arg_max(struct_pack(g := gname, v := verdict), length(gname)) FROM globs
          WHERE contains('.' || p.host || p.path, pattern)) AS g
  FROM parts p)
SELECT page_id, host, path, site.r AS rule, coalesce(site.v, g.v, 'allow') AS verdict,
       CASE WHEN site IS NULL THEN g.g END AS glob_rule
FROM fits
"""
