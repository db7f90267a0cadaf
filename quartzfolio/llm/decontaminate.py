"""Benchmark decontamination with suffix arrays over the training text.

Each task gathers documents into shards of about `SHARD_CHARS` (a longer document is a shard of
its own), builds a suffix array over the shard's words to a depth of at least `DEPTH` words,
and binary-searches the window at the head of every suffix of every benchmark item in it. The
range of the array that shares the window gives all its locations. Words are compared as 32-bit
ids in the array; each hit is confirmed on 64-bit hashes of its words. Equal windows of the
benchmark are one class that is searched once and knows its items, so that a window repeated in
the benchmark and in a shard makes no pairs of places.

The longest match of a document is the longest stretch of its words that one item holds verbatim. The
benchmark's own suffixes stand in a second array in full order; from each place with a hit, the
longest common prefix with its two neighbours there is the longest match that begins at the place, and the
suffixes beside them that share it tell the items. Of equal lengths the first place counts, and there the lowest item.
Matches of fewer than `WINDOW` words are reported only where a whole item is that short.

The benchmark is the query side. Its bytes are counted first; up to `BLOCK_BYTES` it is broadcast
at once, beyond that in as many blocks, each a pass that adds its hits to the rows of the pass
before or drops the rows it hits. Rows are never joined or merged, so every row has its own verdict.

Edge cases: a null or empty text has no words; an item with fewer than `WINDOW` words is one
window, one without words is ignored; repeated items count under their item_id once; equal rows
and rows of one doc_id are judged each for itself; a null doc_id stays null; an empty table on
either side works; `searched` ignores other columns, `clean` keeps them whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_rows, written

WINDOW, DEPTH = 10, 16
SHARD_CHARS = 3_000_000
BLOCK_BYTES = 16_000_000
#: Windows that are searched at once.
SLICE = 1 << 16
PIECE = 1 << 20
#: Fixed by the contract: ASCII letters and digits and every byte from 0x80 on are in words.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SCHEMA = "doc_id long, text string, n_words long, hits array<int>, items array<string>, longest_match long, longest_item string, longest_at long"
_TYPES = {"n_words": pa.int64(), "hits": pa.list_(pa.int32()), "items": pa.list_(pa.string()), "longest_match": pa.int64(), "longest_item": pa.string(), "longest_at": pa.int64()}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers and those of its inverse, modulo 2**64."""
    up = np.full(n, _MUL)
    down = np.full(n, np.uint64(pow(int(_MUL), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words:
    """Hashes of the words of UTF-8 bytes (A-Z lower-cased), in pieces of bounded size."""

    def __init__(self, inside: np.ndarray = _IN_WORD) -> None:
        self.inside = inside
        self.up, self.down = _powers(PIECE + 1)

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit hash of each word and the byte after its end."""
        hashes, ends, at = [], [], 0
        while at < len(data):
            stop = min(len(data), at + PIECE)
            piece = np.frombuffer(data, np.uint8, stop - at, at)
            inside = self.inside[piece]
            if stop < len(data) and inside[-1]:  # cut after the last whole word
                gaps = np.flatnonzero(~inside)
                if len(gaps):
                    stop = at + int(gaps[-1]) + 1
                    piece, inside = piece[: stop - at], inside[: stop - at]
                else:  # one word longer than a piece
                    stop = at
                    while stop < len(data) and self.inside[data[stop]]:
                        stop += 1
                    digest = hashlib.blake2b(data[at:stop].lower(), digest_size=8).digest()
                    hashes.append(np.frombuffer(digest, np.uint64))
                    ends.append(np.array([stop]))
                    at = stop
                    continue
            edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
            first, last = edge[::2], edge[1::2]
            summed = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[piece].astype(np.uint64) + np.uint64(1)) * self.up[: len(piece)], dtype=np.uint64)))
            h = (summed[last] - summed[first]) * self.down[first]
            h ^= h >> np.uint64(32)
            h *= _MIX
            h ^= h >> np.uint64(29)
            hashes.append(h)
            ends.append(last + at)
            at = stop
        return (np.concatenate(hashes), np.concatenate(ends)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _ids(h: np.ndarray) -> np.ndarray:
    """32-bit ids of words; 0 is the end of a text."""
    return np.maximum((h >> np.uint64(32)).astype(np.uint32), 1)


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Positions ordered by their next words, to a depth of DEPTH or more, by prefix doubling."""
    n = len(ids)
    after = np.append(ids[1:], np.uint32(0))
    key = (ids.astype(np.uint64) << np.uint64(32)) | after
    order = np.argsort(key)
    key = key[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n + 1, np.int64)
    heads = np.flatnonzero(fresh)
    rank[order] = heads[np.cumsum(fresh) - 1]
    rank[n] = -1
    depth = 2
    while depth < DEPTH:
        size = np.diff(np.append(heads, n))
        tied = np.repeat(size > 1, size)
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        at = order[slots]
        own, then = rank[at], rank[np.minimum(at + depth, n)]
        by = np.lexsort((then, own))
        at, own, then = at[by], own[by], then[by]
        order[slots] = at
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (then[1:] != then[:-1])))
        fresh[slots] = new
        heads = np.flatnonzero(fresh)
        rank[order[slots]] = slots[new][np.cumsum(new) - 1]
        depth *= 2
    return order


def full_order(h: np.ndarray, longest: int) -> np.ndarray:
    """The places of h ordered by the up to `longest` words from each on, by doubling."""
    if not len(h):
        return np.zeros(0, np.int64)
    rank = np.unique(h, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while True:
        then = np.append(rank[depth:], np.full(min(depth, len(h)), -1))[: len(h)]
        order = np.lexsort((then, rank))
        new = np.concatenate(([False], (rank[order][1:] != rank[order][:-1]) | (then[order][1:] != then[order][:-1])))
        rank = np.empty(len(h), np.int64)
        rank[order] = np.cumsum(new)
        depth *= 2
        if depth >= longest or rank[order[-1]] == len(h) - 1:
            return order


class Queries:
    """The distinct windows at the heads of the suffixes of the benchmark's items.

    h and ids have a row of `WINDOW` words for each, 0 beyond its `size`; `items_of` gives the names
    of the items with a window: names[of[begin[k]:begin[k + 1]]].
    """

    def __init__(self, items: list[tuple[str, str]], words: Words) -> None:
        names, texts, windows, item = [], [], [np.zeros((0, WINDOW), np.uint64)], [np.zeros(0, np.int64)]
        for name, text in items:
            h, _ = words((text or "").encode("utf-8", "surrogatepass"))
            if not len(h):
                continue
            if len(h) < WINDOW:
                own = np.zeros((1, WINDOW), np.uint64)
                own[0, : len(h)] = h
            else:
                own = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
            windows.append(own)
            item.append(np.full(len(own), len(names)))
            names.append("" if name is None else str(name))
            texts.append(h)
        every, item = np.ascontiguousarray(np.concatenate(windows)), np.concatenate(item)
        _, first, inverse = np.unique(every.view(f"V{8 * WINDOW}").ravel(), return_index=True, return_inverse=True)
        self.names = np.array(names, object)
        self.h = every[first]
        self.size = (self.h != 0).sum(1)
        self.ids = np.where(self.h == 0, np.uint32(0), _ids(self.h))
        pairs = np.unique(inverse.ravel().astype(np.int64) * max(len(names), 1) + item)
        self.of = pairs % max(len(names), 1)
        self.begin = np.searchsorted(pairs // max(len(names), 1), np.arange(len(first) + 1))
        # All items one after another, each with a 1 behind it, which no text has.
        ends = np.cumsum([len(x) + 1 for x in texts]) if texts else np.zeros(0, np.int64)
        self.flat = np.concatenate([np.append(x, np.uint64(1)) for x in texts]) if texts else np.zeros(0, np.uint64)
        self.order = full_order(self.flat, max((len(x) for x in texts), default=0) + 1)
        self.owner = np.searchsorted(ends, self.order, "right")

    def items_of(self, which: np.ndarray) -> list[str]:
        """The names of the items with any of these windows, ascending."""
        return sorted(set(self.names[np.concatenate([self.of[self.begin[k] : self.begin[k + 1]] for k in which])]))


def _search(ids: np.ndarray, order: np.ndarray, q: Queries, some: np.ndarray, low: np.ndarray, high: np.ndarray, upper: bool) -> np.ndarray:
    """The first place in the array whose suffix is not below (upper: is above) each window of some."""
    step, n = np.arange(WINDOW), len(ids)
    padded = np.concatenate((ids, np.zeros(WINDOW, np.uint32)))
    want, used = q.ids[some], step < q.size[some][:, None]
    low, high, rows = low.copy(), high.copy(), np.arange(len(some))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        have = padded[order[np.minimum(mid, n - 1)][:, None] + step]
        differs = (have != want) & used
        first = differs.argmax(1)
        same = ~differs[rows, first]
        right = np.where(same, upper, have[rows, first] < want[rows, first]) & open_
        low = np.where(right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)
    return low


def matches(h: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """All (place, window): at most one for each place and size of a window."""
    ids = np.where(h == 0, np.uint32(0), _ids(h))
    places, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not len(ids) or not len(q.size):
        return places[0], windows[0]
    order = suffix_array(ids)
    head = ids[order]
    for at in range(0, len(q.size), SLICE):
        some = np.arange(at, min(at + SLICE, len(q.size)))
        low, high = np.searchsorted(head, q.ids[some, 0], "left"), np.searchsorted(head, q.ids[some, 0], "right")
        there = low < high
        some, low, high = some[there], low[there], high[there]
        left = _search(ids, order, q, some, low, high, False)
        many = _search(ids, order, q, some, low, high, True) - left
        which = np.repeat(some, many)
        place = order[np.repeat(left - (np.cumsum(many) - many), many) + np.arange(len(which))]
        true = np.ones(len(which), bool)
        for k in range(WINDOW):  # confirmed on the 64-bit hashes
            true &= (k >= q.size[which]) | (h[np.minimum(place + k, len(h) - 1)] == q.h[which, k])
        places.append(place[true])
        windows.append(which[true])
    return np.concatenate(places), np.concatenate(windows)


def _shared(h: np.ndarray, place: np.ndarray, q: Queries, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words the suffixes of h at place and of the items at q.order[at] share, and whether the former is greater."""
    length, greater = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
    step, open_ = np.arange(32), np.arange(len(place))
    other = q.order[at]
    while len(open_):
        x, y = place[open_] + length[open_], other[open_] + length[open_]
        a = h[np.minimum(x[:, None] + step, len(h) - 1)]
        b = q.flat[np.minimum(y[:, None] + step, len(q.flat) - 1)]
        differs = (a != b) | (x[:, None] + step >= len(h)) | (y[:, None] + step >= len(q.flat))
        first = differs.argmax(1)
        done = differs[np.arange(len(open_)), first]
        length[open_] += np.where(done, first, len(step))
        greater[open_[done]] = (a > b)[done, first[done]]
        open_ = open_[~done]
    return length, greater


def _reach(h: np.ndarray, place: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """Of each place the most words that an item shares from there on, and a slot of q.order with them."""
    low, high = np.zeros(len(place), np.int64), np.full(len(place), len(q.order), np.int64)
    while (some := np.flatnonzero(low < high)).size:
        mid = (low[some] + high[some]) // 2
        greater = _shared(h, place[some], q, mid)[1]
        low[some], high[some] = np.where(greater, mid + 1, low[some]), np.where(greater, high[some], mid)
    before, after = np.maximum(low - 1, 0), np.minimum(low, len(q.order) - 1)
    x, y = _shared(h, place, q, before)[0], _shared(h, place, q, after)[0]
    return np.maximum(x, y), np.where(x >= y, before, after)


def _items_at(q: Queries, slot: int, length: int) -> str:
    """The lowest item with a suffix that begins with the same `length` words as that of the slot."""
    own = q.flat[q.order[slot] : q.order[slot] + length]
    same = lambda k: 0 <= k < len(q.order) and np.array_equal(q.flat[q.order[k] : q.order[k] + length], own)
    ends = []
    for way in (-1, 1):  # the equal ones are neighbours: by doubled steps, then halved ones
        step, k = 1, slot
        while same(k + way * step):
            k, step = k + way * step, 2 * step
        while step := step // 2:
            k += way * step if same(k + way * step) else 0
        ends.append(k)
    return min(q.names[np.unique(q.owner[ends[0] : ends[1] + 1])])


def _longest(h: np.ndarray, doc: np.ndarray, place: np.ndarray, which: np.ndarray, q: Queries) -> Iterator[tuple[int, int, str, int]]:
    """Per document the words of its longest match with one item, the lowest such item, and its place."""
    whole = q.size[which] == WINDOW
    length, slot = q.size[which].astype(np.int64), np.full(len(which), -1)
    at, of = np.unique(place[whole], return_inverse=True)
    if len(at):
        reach, found = _reach(h, at, q)
        length[whole], slot[whole] = reach[of], found[of]
    best = np.lexsort((place, -length, doc))
    best = best[np.concatenate(([True], doc[best][1:] != doc[best][:-1]))]
    for k in best:
        item = _items_at(q, int(slot[k]), int(length[k])) if slot[k] >= 0 else q.items_of(which[k : k + 1])[0]
        yield int(doc[k]), int(length[k]), item, int(place[k])


def _shard(texts: list[str], q: Queries, words: Words) -> pd.DataFrame:
    """n_words, hits (numbers of words), items and the longest match of each text."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    h, ends = words(b"\n".join(data))
    stops = np.cumsum([len(x) + 1 for x in data])
    upto = np.searchsorted(ends, stops)  # words of the texts so far
    first = np.append(0, upto[:-1])
    n = len(texts)
    held = np.zeros(len(h) + n, np.uint64)  # each text ends with a 0
    held[np.arange(len(h)) + np.repeat(np.arange(n), upto - first)] = h
    begin = first + np.arange(n)
    place, which = matches(held, q)
    hits: list = [None] * n
    items: list = [None] * n
    length, longest, where = [0] * n, [None] * n, [None] * n
    if len(place):
        doc = np.searchsorted(begin, place, "right") - 1
        for i, size, item, p in _longest(held, doc, place, which, q):
            length[i], longest[i], where[i] = size, item, int(p - begin[i])
        edge = np.zeros(len(held) + 1, np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + q.size[which], -1)
        word = np.flatnonzero(np.cumsum(edge) > 0)
        owner = np.searchsorted(begin, word, "right") - 1
        for i, some in zip(np.unique(owner), np.split(word, np.flatnonzero(np.diff(owner)) + 1), strict=True):
            hits[i] = (some - begin[i]).astype(np.int32)
        pairs = np.unique(doc * len(q.size) + which)
        for some in np.split(pairs, np.flatnonzero(np.diff(pairs // len(q.size))) + 1):
            items[some[0] // len(q.size)] = q.items_of(some % len(q.size))
    return pd.DataFrame({"n_words": upto - first, "hits": hits, "items": items, "longest_match": length, "longest_item": longest, "longest_at": pd.array(where, "Int64")})


#: The windows of the block that this Python worker searched last.
_BUILT: dict[str, Queries] = {}


def _queries(key: str, shared) -> Queries:
    """Built once in each worker, not in each task."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Queries(shared.value, Words())
    return _BUILT[key]


def _shards(batches: Iterator[pa.RecordBatch], key: str, shared, shard_chars: int) -> Iterator[tuple[pa.Table, pd.DataFrame]]:
    """The rows of each shard with what was found in their texts."""
    words, held, size = Words(), [], 0

    def searched_rows() -> tuple[pa.Table, pd.DataFrame]:
        rows = pa.Table.from_batches(held)
        return rows, _shard([t or "" for t in rows["text"].to_pylist()], _queries(key, shared), words)

    for batch in batches:
        upto = np.cumsum(pa.compute.fill_null(pa.compute.utf8_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(upto):
            done = upto[at - 1] if at else 0
            stop = max(int(np.searchsorted(upto, done + shard_chars - size, "right")), at + (not held))
            if stop > at:
                held.append(batch.slice(at, stop - at))
                size += int(upto[stop - 1] - done)
            if stop < len(upto):
                yield searched_rows()
                held, size = [], 0
            at = stop
    if held:
        yield searched_rows()


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[tuple[str, object]]:
    """A name and the broadcast items of each part of about `limit` bytes of text."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // limit
    for k in range(n):
        block = b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else b
        yield uuid.uuid4().hex, b.sparkSession.sparkContext.broadcast([tuple(r) for r in block.collect()])


def _merged(old: dict, new: dict) -> dict:
    """A row's findings in the blocks so far and in this one."""
    out = {"n_words": new["n_words"]}
    out["hits"] = sorted({*(old["hits"] or ()), *(() if new["hits"] is None else new["hits"].tolist())}) or None
    out["items"] = sorted({*(old["items"] or ()), *(new["items"] or ())}) or None
    place = lambda r: (-(r["longest_match"] or 0), -1 if pd.isna(r["longest_at"]) else r["longest_at"], r["longest_item"] or "")
    best = min(old, new, key=place)
    return out | {c: None if pd.isna(best[c]) else best[c] for c in ("longest_match", "longest_item", "longest_at")}


def searched(docs: DataFrame, benchmark: DataFrame, shard_chars: int = SHARD_CHARS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated and its longest match."""
    names = ["n_words", "hits", "items", "longest_match", "longest_item", "longest_at"]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for k, (key, shared) in enumerate(_blocks(benchmark, block_bytes)):

        def run(batches: Iterator[pa.RecordBatch], k: int = k, key: str = key, shared=shared) -> Iterator[pa.RecordBatch]:
            for rows, new in _shards(batches, key, shared, shard_chars):
                new = new[names].astype(object).to_dict("records")
                if k:
                    new = [_merged(a, b) for a, b in zip(rows.select(names).to_pylist(), new, strict=True)]
                else:
                    new = [{c: None if c not in ("hits", "items") and pd.isna(x) else x for c, x in r.items()} for r in new]
                yield from pa.Table.from_arrays([rows["doc_id"], rows["text"], *(pa.array([r[c] for r in new], t) for c, t in _TYPES.items())], ["doc_id", "text", *_TYPES]).to_batches()

        found = found.mapInArrow(run, SCHEMA)
        if k:
            found = written(found, "benchmark_hits")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        "doc_id", "n_words",
        F.when(F.col("hits").isNull(), 0).otherwise(F.size("hits")).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.coalesce(F.size("hits") > 0, F.lit(False)).alias("contaminated"),
        "longest_match", "longest_item", "longest_at",
    )


def clean(docs: DataFrame, benchmark: DataFrame, shard_chars: int = SHARD_CHARS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of the benchmark."""
    rows = whole_rows(docs)
    for k, (key, shared) in enumerate(_blocks(benchmark, block_bytes)):

        def run(batches: Iterator[pa.RecordBatch], key: str = key, shared=shared) -> Iterator[pa.RecordBatch]:
            for rows, found in _shards(batches, key, shared, shard_chars):
                yield from rows.filter(pa.array(found["hits"].isna())).to_batches()

        rows = rows.mapInArrow(run, rows.schema)
        if k:
            rows = written(rows, "clean_so_far")
    return rows.select("row.*")
