r"""Suffix-array dedup: bytes that a `LENGTH`-byte string covers which starts elsewhere, too, are cut.

Suffixes are told apart to a depth of LENGTH bytes by bucket-pointer refinement. A bucket's pointer is
a 128-bit name that only depends on its bytes, so that all tasks agree on it without a shared
array, and Spark's shuffle brings equal pointers together:

1. Initial q-gram buckets: the first `Q` = 145 bytes of a suffix. Of every window of LENGTH bytes the
   smallest of its 256 q-gram names is its anchor (the leftmost of equal ones). Equal windows have equal
   anchors at equal offsets, so only windows whose anchor's bucket holds several anchors are looked at,
   and a row stands for the up to 256 windows of an anchor, not for a byte.
2. Refinement: the bucket of depth 401 - 2^(j+1) of a suffix, sorted on the bucket of the same depth at
   the later offset 2^j, gives the bucket of depth 401 - 2^j; the new pointers are used for the next
   refinement, from 145 over 273, 337, ... to 400.
3. 2^j neighbouring windows are a node. All of them hold the same 401 - 2^j bytes in their middle:
   where that bucket has one member, none of the windows repeats. The buckets of its first and last
   window (depth 400) name all of its bytes: where that name occurs twice, all windows
   repeat. Other nodes are split, 256 windows into nodes of 32, of 4 and single ones. Of nodes with equal bytes
   one goes on for all, as long as others share their middle. So copies cost one row for an
   anchor, and only ends of matches are followed down to the byte.
4. Covered bytes are gathered by document and cut out. `cut` returns the bytes that are left and the
   runs that were removed; sizes and digests are derived from them.

Texts are written once, bucketed by a row number, so that later visits to them need no shuffle of text.
Buckets are counted by partial aggregates; what occurs often is written before it is joined, so that a
hot name is split. Names of 128 bits stand for bytes; bytes aren't compared again.

Edge cases: null and empty texts have no bytes; texts under LENGTH bytes have no window; equal rows are
texts of their own and cover each other; matches may overlap and lie in one text; a text of any
length is visited in pieces of bounded size; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_and_text, shared_path, written

LENGTH = 400
TOP = 8
#: The windows of a node in each visit, as powers of two.
LEVELS = (8, 5, 2, 0)
Q = LENGTH + 1 - (1 << TOP)
#: Windows of a text that are looked at in one go.
PIECE = 1 << 20
_ROW = "row long, low int, middle long, u1 long, u2 long"
_LOW24 = np.uint64((1 << 24) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The pointer of a bucket x that is refined by a bucket y at a later offset."""
    return _mixed(x * np.uint64(0x9E3779B97F4A7C15) + (y ^ (y >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F))


@cache
def _powers(lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the bytes, powers of an odd number and of its inverse, for texts of a piece."""
    base = np.random.default_rng(71 + lane).integers(0, 1 << 63, 257, dtype=np.uint64)
    by = int(base[256]) * 8 + 5
    n = 2 * PIECE + 8 * LENGTH
    up, down = np.full(n, by % (1 << 64), np.uint64), np.full(n, pow(by, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return base[:256], np.multiply.accumulate(up), np.multiply.accumulate(down)


def _grams(data: np.ndarray, lane: int) -> np.ndarray:
    """Names of the Q bytes from each byte on."""
    values, up, down = _powers(lane)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    n = max(0, len(data) - Q + 1)
    return _mixed((sums[Q:] - sums[:-Q]) * down[:n]) if n else np.zeros(0, np.uint64)


def _refined(names: np.ndarray, level: int) -> np.ndarray:
    """Names of depth 401 - 2^level out of those of the level above."""
    step = 1 << level
    return _paired(names[:-step], names[step:]) if len(names) > step else np.zeros(0, np.uint64)


def _anchors(grams: np.ndarray) -> np.ndarray:
    """Of the window at each byte the place of its smallest q-gram name, the leftmost of equal ones."""
    least = (grams & ~_LOW24) | np.arange(len(grams), dtype=np.uint64)
    for k in range(TOP):
        step = 1 << k
        if len(least) <= step:
            return np.zeros(0, np.int64)
        least = np.minimum(least[:-step], least[step:])
    return (least & _LOW24).astype(np.int64)


def _named(data: np.ndarray, low: np.ndarray, level: int, row: int, base: int, whole: int) -> tuple[np.ndarray, ...]:
    """The nodes of 2^level windows from each low on (places in the text); data begins at base in a text of `whole` bytes."""
    high = low + (1 << level) - 1
    inside = (low >= 0) & (high <= whole - LENGTH)
    lanes, middle = [], None
    for lane in (0, 1):
        names = _grams(data, lane)
        middle = names[high - base] if level == TOP and lane == 0 else middle
        for j in range(TOP - 1, -1, -1):
            names = _refined(names, j)
            if j == level and lane == 0:
                middle = names[high - base]
        u = _mixed(np.uint64(row) * np.uint64(0x9E3779B97F4A7C15) + low.astype(np.uint64) + np.uint64(lane + 1))
        u[inside] = _paired(names[low[inside] - base], names[high[inside] - base])
        lanes.append(u.view(np.int64))
    return np.full(len(low), row), low.astype(np.int32), middle.view(np.int64), *lanes


def _frame(parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("row", "low", "middle", "u1", "u2"), map(np.concatenate, zip(*parts, strict=True)), strict=False)))


def _first_nodes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The place and the q-gram name of every anchor, from the piece in which its first window starts."""
    for f in frames:
        out, size = [], 0
        for row, text in zip(f["row"], f["text"], strict=True):
            data = np.frombuffer(text, np.uint8)
            for start in range(0, max(0, len(data) - LENGTH + 1), PIECE):
                stop = min(start + PIECE, len(data) - LENGTH + 1)
                base = max(0, start - 1)
                grams = _grams(data[base : stop + LENGTH], 0)
                at = _anchors(grams)[: stop - base]
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1]
                if start:  # the window before the piece only tells whether its anchor is new
                    new[0] = False
                at = at[new]
                out.append((np.full(len(at), row), (at + base - (1 << TOP) + 1).astype(np.int32), grams[at].view(np.int64)))
                size += len(at)
                if size > 50_000:
                    yield _frame(out)
                    out, size = [], 0
        if out:
            yield _frame(out)


def _split_nodes(frames: Iterator[pd.DataFrame], above: int, level: int) -> Iterator[pd.DataFrame]:
    """The parts of the nodes that go on; of an anchor's node only parts with windows of that anchor."""
    parts = np.arange(0, 1 << above, 1 << level)
    for f in frames:
        out = []
        for row, text, lows in zip(f["row"], f["text"], f["lows"], strict=True):
            data, lows = np.frombuffer(text, np.uint8), np.sort(np.asarray(lows, np.int64))
            last = len(data) - LENGTH
            done = np.zeros(0, np.int64)
            while len(lows):
                some, lows = lows[lows < lows[0] + PIECE], lows[lows >= lows[0] + PIECE]
                base = max(0, int(some[0]))
                piece = data[base : int(some[-1]) + (1 << above) + LENGTH]
                low = some[:, None] + parts
                if level < above == TOP:
                    at = _anchors(_grams(piece, 0))
                    start = some[:, None] - base + np.arange(1 << TOP)
                    mine = (start >= 0) & (start < len(at))
                    mine &= at[np.clip(start, 0, len(at) - 1)] == (some - base + (1 << TOP) - 1)[:, None]
                    low = low[mine.reshape(len(some), len(parts), -1).any(-1)]
                low = np.unique(low)
                low = low[(low <= last) & (low + (1 << level) > 0) & ~np.isin(low, done)]
                if len(low):
                    out.append(_named(piece, low, level, row, base, len(data)))
                    done = low
        if out:
            yield _frame(out)


def _met(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes whose middle bucket has several members."""
    several = scratch.written(nodes.groupBy("middle").agg(F.count("*").alias("c")).filter("c > 1").select("middle"), "middles")
    return scratch.written(nodes.join(several, "middle", "left_semi"), "alive")


def _resolved(nodes: DataFrame, level: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """row, low of the nodes that go on, and row, low and level of those whose windows all repeat."""
    alive = _met(nodes, scratch)
    equal = scratch.written(alive.groupBy("u1", "u2").agg(F.first("middle").alias("middle"), F.count("*").alias("c"), F.min(F.struct("row", "low")).alias("x")), "equal")
    repeated = alive.join(scratch.written(equal.filter("c > 1").select("u1", "u2"), "repeated"), ["u1", "u2"], "left_semi").select("row", "low", F.lit(level).alias("level"))
    mixed = scratch.written(equal.groupBy("middle").agg(F.count("*").alias("c")).filter("c > 1").select("middle"), "mixed")
    return scratch.written(equal.join(mixed, "middle", "left_semi").select("x.row", "x.low"), "going"), scratch.written(repeated, "found")


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        left, runs = zip(*(_without(text, spans) for text, spans in zip(f["text"], f["spans"], strict=True)), strict=True) if len(f) else ((), ())
        yield pd.DataFrame({"doc_id": f["doc_id"].array, "n_bytes": f["text"].map(len), "kept": left, "spans": runs})


def _without(text: bytes, spans: list | None) -> tuple[bytes, list[dict]]:
    """What is left of a text, and the maximal runs that were cut."""
    left, runs, end = [], [], 0
    for start, stop in sorted((s["start"], s["stop"]) for s in (() if spans is None else spans)):
        if start > end or not runs:
            left.append(text[end:start])
            runs.append({"start": start})
        end = runs[-1]["stop"] = max(end, stop)
    return b"".join([*left, text[end:]]), runs


def digests(rows: DataFrame, *more: Column) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of rows as `cut` returns them, and more columns of them."""
    removed = F.col("n_bytes") - F.octet_length("kept")
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), *more)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    return digests(cut(docs))


def kept_text() -> Column:
    """The bytes that `cut` leaves as text; halves of a character whose other bytes were cut show as U+FFFD."""
    return F.make_valid_utf8(F.col("kept").cast("string"))


def cut(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that are left, in order) and spans (the maximal runs of removed bytes, stop exclusive) of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    name, path = f"quartzfolio_{uuid.uuid4().hex}", shared_path(spark, "texts")
    scratch.paths.append(path)
    rows = id_and_text(docs).select("doc_id", F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(buckets, "row").write.option("path", path).option("compression", "zstd").bucketBy(buckets, "row").saveAsTable(name)
    texts = spark.table(name)
    anchors = scratch.written(texts.select("row", "text").mapInPandas(_first_nodes, "row long, low int, middle long"), "anchors")
    going, found = _met(anchors, scratch).select("row", "low"), []
    for above, level in zip((TOP, *LEVELS), LEVELS, strict=False):
        # The few rows are hashed, so that texts are neither shuffled nor sorted.
        lows = going.groupBy("row").agg(F.collect_list("low").alias("lows")).hint("shuffle_hash")
        nodes = texts.select("row", "text").join(lows, "row").mapInPandas(lambda frames, a=above, b=level: _split_nodes(frames, a, b), _ROW)
        going, repeated = _resolved(scratch.written(nodes, "nodes"), level, scratch)
        found.append(repeated)
    spans = reduce(DataFrame.unionByName, found)
    start, stop = F.greatest("low", F.lit(0)), F.expr(f"low + shiftleft(1, level) - 1 + {LENGTH}")
    spans = spans.groupBy("row").agg(F.collect_list(F.struct(start.alias("start"), stop.alias("stop"))).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = written(texts.join(spans.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "spans").mapInPandas(_cut, f"doc_id {kind}, n_bytes long, kept binary, spans array<struct<start: int, stop: int>>"), "kept")
    spark.sql(f"DROP TABLE {name}")
    scratch.drop()
    return result
