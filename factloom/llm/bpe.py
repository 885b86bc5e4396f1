"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than one chunk is cut into overlapping chunks, which are
pre-tokenised apart from each other. A chunk that starts in the middle of a
pre-token soon falls into step: from the first boundary that it shares with the
chunk before it, both see the same pre-tokens. The text is cut there, and the
pieces between the cuts are encoded on their own. Should the overlap hold no
common boundary (one pre-token may be longer than it), the earlier chunk is
read on, twice as far each time, until one is found. Decoding concatenates the
bytes of the ids.

A run of over RUN white spaces is a pre-token by itself, but for its last one
where something follows; the library's matcher gives up on very long ones, so such
runs are taken out and encoded as the one pre-token that they are.

Texts over `far` characters are spread over tasks: they are written as blocks,
each block is pre-tokenised in a task of its own, cuts are found from the
boundaries of neighbours, and the pieces between cuts are encoded in tasks of
their own. Only ids come together, piece by piece in order, where a text's digests
(and its ids, if asked for) are made. Where neighbours share no boundary, what is
left of the text is one piece.

Defined results: null text is empty; an empty text has no ids; every row gives
one row, repeated rows and null or repeated doc_ids included; special tokens
are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table, workers_import_us

CHUNK = 16_384
OVERLAP = 512
#: A boundary so near to the end of what a chunk has seen may still move.
MARGIN = 8
#: Characters from which a text's blocks are dealt to several tasks, and chunks in a block.
FAR = 2_000_000
BLOCK = 64
#: White spaces in a row from which they are taken out of a text; the library fails at about a million.
RUN = 4096
#: What \s matches, and the end of patterns by which a run of it is one pre-token but for its last character.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_RULE = r"|\s+(?!\S)|\s+"
_LONG_RUN = regex.compile(f"[{SPACES}]{{{RUN},}}+")

_ENCODERS: dict[tuple[str, str], tiktoken.Encoding] = {}
#: A pattern by which a whole text is one pre-token.
_WHOLE = r"[\s\S]+"


def default_ranks() -> tuple[str, str]:
    """Path and pattern of the vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """One encoder a worker process."""
    key = (path, pattern)
    if key not in _ENCODERS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def boundaries(text: str, pattern: regex.Pattern, start: int, end: int) -> list[int]:
    """Ends of the pre-tokens of text[start:end] read by itself, as offsets of text; those that may move are left out."""
    last = len(text) if end >= len(text) else end - MARGIN
    return [m.end() + start for m in pattern.finditer(text[start:end]) if m.end() + start <= last]


def cuts(text: str, pattern: regex.Pattern, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Offsets at which text may be cut so that its pieces are pre-tokenised as the whole is."""
    found: list[int] = []
    if len(text) <= chunk:
        return found
    at, mine = 0, boundaries(text, pattern, 0, chunk)
    while at + chunk < len(text):
        nxt, reach = at + chunk - overlap, at + chunk
        ahead = boundaries(text, pattern, nxt, nxt + chunk)
        cut = common_cut(text, mine, ahead, nxt)
        while cut is None and reach < len(text):  # no boundary in common yet: read the earlier chunk on
            reach = min(len(text), reach + 2 * (reach - at))
            start = found[-1] if found else 0
            mine = boundaries(text, pattern, start, reach)
            ahead = boundaries(text, pattern, nxt, reach)
            cut = common_cut(text, mine, ahead, nxt)
        if cut is None:
            break
        found.append(cut)
        if cut >= nxt + chunk - overlap:  # the common boundary lies beyond the next chunk's reach
            nxt = cut
            ahead = boundaries(text, pattern, nxt, nxt + chunk)
        at, mine = nxt, ahead
    return found


def common_cut(text: str, mine: list[int], ahead: list[int], start: int) -> int | None:
    """The first boundary after start that both have, behind a character that isn't white space."""
    shared = sorted(set(ahead).intersection(mine))
    return next((p for p in shared if start < p < len(text) and not text[p - 1].isspace()), None)


def pieces(text: str, pattern: regex.Pattern, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    at = [0, *cuts(text, pattern, chunk, overlap), len(text)]
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


def encode_piece(text: str, path: str, pattern: str) -> list[int]:
    """Ids of a text that is pre-tokenised by itself."""
    own = encoder(path, pattern)
    if len(text) < RUN or not pattern.endswith(SPACE_RULE):
        return own.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for m in _LONG_RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        ids += own.encode_ordinary(text[at : m.start()])
        ids += encoder(path, _WHOLE).encode_ordinary(text[m.start() : end])
        at = end
    return ids + own.encode_ordinary(text[at:])


def encode(text: str, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    ids: list[int] = []
    for piece in pieces(text, regex.compile(pattern), chunk, overlap):
        ids += encode_piece(piece, path, pattern)
    return ids


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    own = encoder(path, pattern)
    return own.decode_bytes(ids)


def _digest(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: tuple[str, str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, far: int = FAR, with_ids: bool = False) -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256[, ids]), one for each row of docs.

    ranks: path of the rank file, readable on every machine, and pattern.
    """
    workers_import_us(docs.sparkSession)
    path, pattern = ranks or default_ranks()
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_far = F.length("text") > far
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, split = encoder(path, pattern), regex.compile(pattern)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):
                rows = [_row(own, [encode_piece(p, path, pattern) for p in pieces(text, split, chunk, overlap)], with_ids) for text in batch.column(1).slice(at, 256).to_pylist()]
                yield _batch(ids[at : at + 256], rows, with_ids)

    whole = slim.where(~is_far).mapInArrow(near, schema)
    blocks = materialize(_blocks(slim.where(is_far), chunk * BLOCK, chunk), "blocks")
    if not blocks.isEmpty():
        whole = whole.unionByName(_spread(blocks, path, pattern, chunk, overlap, schema, with_ids))
    return whole.withColumnRenamed("id", id_col)


class _Sums:
    """Count and digests of a text whose ids come part by part."""

    def __init__(self, id_: int | None, row: int, own: tiktoken.Encoding, with_ids: bool):
        self.id, self.row, self.own = id_, row, own
        self.ids_sha, self.text_sha, self.n = hashlib.sha256(), hashlib.sha256(), 0
        self.ids: list[int] | None = [] if with_ids else None

    def add(self, ids: list[int]) -> None:
        self.n += len(ids)
        self.ids_sha.update(_digest(ids))
        self.text_sha.update(self.own.decode_bytes(ids))
        if self.ids is not None:
            self.ids += ids

    def result(self) -> tuple:
        out = (self.n, self.ids_sha.hexdigest(), self.text_sha.hexdigest())
        return out if self.ids is None else (*out, self.ids)


def _row(own: tiktoken.Encoding, parts: list[list[int]], with_ids: bool) -> tuple:
    sums = _Sums(None, 0, own, with_ids)
    for part in parts:
        sums.add(part)
    return sums.result()


def _batch(ids: list, rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids
    columns = [pa.array(ids, pa.int64())] + [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["id", *(n for n, _ in kinds)])


def _blocks(docs: DataFrame, block: int, more: int) -> DataFrame:
    """Rows (id, row, k, last, text): a text's blocks; each but the last sees `more` characters of the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = max(0, (len(text) - 1) // block)
                for k in range(last + 1):
                    yield pa.RecordBatch.from_pylist([{"id": i, "row": row, "k": k, "last": last, "text": text[k * block : (k + 1) * block + more]}], schema=_BLOCK)

    return docs.select("id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, "id long, row long, k int, last int, text string")


_BLOCK = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("k", pa.int32()), ("last", pa.int32()), ("text", pa.string())])


def _spread(blocks: DataFrame, path: str, pattern: str, chunk: int, overlap: int, schema: str, with_ids: bool) -> DataFrame:
    """Rows of encode_documents() for texts that are written as blocks."""
    block = chunk * BLOCK
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        kind = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("tail", pa.list_(pa.int32())), ("head", pa.list_(pa.int32()))])
        for batch in batches:
            for row, k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # the part that both this block and the next one see, and the part that it shares with the one before
                tail = [p - block for p in boundaries(text, split, 0, len(text)) if block < p <= len(text) - MARGIN]
                head = [p for p in boundaries(text, split, 0, min(len(text), 2 * chunk)) if p < chunk - MARGIN and not text[p - 1].isspace()]
                yield pa.RecordBatch.from_pylist([{"row": row, "k": k, "tail": tail, "head": head}], schema=kind)

    seen = blocks.select("row", "k", "text").repartition(parts, "row", "k").mapInArrow(ends, "row long, k int, tail array<int>, head array<int>")
    by_row = W.partitionBy("row").orderBy("k")
    cut = F.array_min(F.array_intersect(F.lag("tail").over(by_row), F.col("head")))
    plan = seen.select("row", "k", cut.alias("cut"))
    # behind a block that shares no boundary with the one before, the next ones may be out of step: all of them stay with it
    plan = plan.withColumn("apart", F.max((F.col("k") > 0) & F.col("cut").isNull()).over(by_row))
    plan = plan.withColumn("start", F.when(F.col("k") == 0, F.lit(0).cast("long")).when(~F.col("apart"), F.col("k").cast("long") * block + F.col("cut")))
    plan = plan.select("row", "k", "start", F.count("start").over(by_row).alias("piece"), F.min("start").over(by_row.rowsBetween(1, W.unboundedFollowing)).alias("stop"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        kind = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("piece", pa.int64()), ("ids", pa.list_(pa.int32()))])
        held: list[dict] = []

        def piece() -> pa.RecordBatch:
            first, end = held[0], held[-1]
            text = "".join([r["text"][:block] for r in held[:-1]] + [end["text"]])
            base = first["k"] * block
            own = text[first["start"] - base : None if end["stop"] is None else end["stop"] - base]
            ids = [i for p in pieces(own, split, chunk, overlap) for i in encode_piece(p, path, pattern)]
            return pa.RecordBatch.from_pylist([{"id": first["id"], "row": first["row"], "piece": first["piece"], "ids": ids}], schema=kind)

        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                if held and (held[0]["row"], held[0]["piece"]) != (r["row"], r["piece"]):
                    yield piece()
                    held.clear()
                held.append(r)
        if held:
            yield piece()

    both = blocks.join(plan, ["row", "k"]).repartition(parts, "row", "piece").sortWithinPartitions("row", "piece", "k")
    coded = both.select("id", "row", "piece", "k", "start", "stop", "text").mapInArrow(encoded, "id long, row long, piece long, ids array<int>")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = encoder(path, pattern), None
        for batch in batches:
            for at in range(batch.num_rows):
                i, row, _, ids = (c[at].as_py() for c in batch.columns)
                if now is None or now.row != row:
                    if now is not None:
                        yield _batch([now.id], [now.result()], with_ids)
                    now = _Sums(i, row, own, with_ids)
                now.add(ids)
        if now is not None:
            yield _batch([now.id], [now.result()], with_ids)

    return coded.repartition(parts, "row").sortWithinPartitions("row", "piece").mapInArrow(joined, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
