"""Splits texts into a tokenizer's pieces with numpy and remembers what each distinct piece became.

The known pattern (contractions, words, numbers, other characters, white space) is worked out
on arrays of code points: a piece starts where the class of the characters changes, one blank
joins the piece after it, and white space before a word leaves its last character. Any other
pattern is matched by the `regex` library. Pieces are looked up by a 64-bit hash of their code points
and compared with the piece that is remembered under it; one that differs gets a digest for its hash.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

#: Fixed: the pattern that `split` knows.
KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE, STOP = range(5)
_END = 0x110000
_MUL = np.uint64(0x9E3779B97F4A7C15)


def classes() -> np.ndarray:
    """The class of every code point; STOP for the mark that ends a text."""
    import regex

    table = np.zeros(_END + 1, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, _END)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            first, last = ord(every[m.start()]), ord(every[m.end() - 1])
            table[first : last + 1] = kind
    table[0xD800:0xE000] = OTHER
    table[_END] = STOP
    return table


def split(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of texts that each end with the mark _END."""
    kind = table[codes]
    n = len(codes)
    run = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    stop = np.append(run[1:], n)
    k = kind[run]
    start = np.zeros(n + 1, bool)
    word = (k != SPACE) & (k != STOP)
    blank = np.zeros(len(run), bool)
    blank[1:] = word[1:] & (k[:-1] == SPACE) & (codes[run[1:] - 1] == 0x20)
    start[run[word] - blank[word]] = True
    start[run[k == STOP]] = True
    space = k == SPACE
    start[run[space]] = True
    # White space before a word leaves its last character, which starts a piece of its own or joins the word.
    follows = np.append(k[1:], STOP)
    start[stop[space & (follows != STOP)] - 1] = True
    # Contractions: a lone apostrophe that starts a piece, with the letters after it.
    lone = np.flatnonzero((k == OTHER) & (stop - run == 1) & (codes[run] == 0x27) & ~blank & (follows == LETTER))
    if len(lone):
        at, end = run[lone], stop[lone + 1]
        a = codes[np.minimum(at + 1, n - 1)]
        b = np.where(at + 2 < end, codes[np.minimum(at + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        size = np.where(one, 1, np.where(two, 2, 0))
        start[at[size > 0] + 1] = False
        rest = at + 1 + size
        start[rest[(size > 0) & (rest < end)]] = True
    first = np.flatnonzero(start[:n])
    last = np.append(first[1:], n)
    real = kind[first] != STOP
    return first[real], last[real]


#: Characters that are compared at once.
_COMPARED = 1 << 20


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()


def _differ(a: np.ndarray, at: np.ndarray, b: np.ndarray, there: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each i whether a[at:at + size] and b[there:there + size] differ."""
    out = np.zeros(len(at), bool)
    upto = np.cumsum(size)
    at, there = at.astype(np.int32), there.astype(np.int32)
    begin = 0
    while begin < len(at):
        done = upto[begin - 1] if begin else 0
        end = max(int(np.searchsorted(upto, done + _COMPARED, "right")), begin + 1)
        n = size[begin:end]
        first = (upto[begin:end] - n - done).astype(np.int32)
        step = np.arange(int(upto[end - 1] - done), dtype=np.int32)
        out[begin:end] = np.logical_or.reduceat(a[np.repeat(at[begin:end] - first, n) + step] != b[np.repeat(there[begin:end] - first, n) + step], first)
        begin = end
    return out


class Memo:
    """Values (arrays) of distinct pieces, learned once; bounded by `most` pieces."""

    def __init__(self, pattern: str, learn: Callable[[list[str]], tuple[np.ndarray, ...]], most: int) -> None:
        self.table = classes() if pattern == KNOWN else None
        self.pattern, self.learn, self.most = pattern, learn, most
        self.up = np.ones(1, np.uint64)
        self.forget()

    def forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.codes, self.code_at, self.code_size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.size: list[np.ndarray] | None = None
        self.flat: list[np.ndarray] | None = None

    def pieces(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The joined texts, starts, ends and hashes of their pieces, and the pieces in each text."""
        joined = "\0".join([*texts, ""])
        self.current = codes = _codes(joined)
        stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        codes[stops - 1] = _END
        if self.table is not None:
            first, last = split(codes, self.table)
        else:
            import regex

            spans = [(m.start() + at, m.end() + at) for t, at in zip(texts, [0, *stops[:-1]], strict=True) for m in regex.finditer(self.pattern, t) if m.end() > m.start()]
            first, last = np.array(spans, np.int64).reshape(-1, 2).T
        if len(self.up) <= len(codes):
            self.up = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(codes), _MUL))))
            self.down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(codes), np.uint64(pow(int(_MUL), -1, 1 << 64))))))
        summed = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.up[: len(codes)], dtype=np.uint64)))
        h = (summed[last] - summed[first]) * self.down[first]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return joined, first, last, h, np.diff(np.searchsorted(first, [0, *stops]))

    def __call__(self, texts: list[str]) -> list[list[np.ndarray]]:
        """For each kind of value, an array for each text: its pieces' values one after the other."""
        joined, first, last, h, count = self.pieces(texts)
        codes, length = self.current, last - first
        while True:
            which, distinct = pd.factorize(h)
            sample = np.zeros(len(distinct), np.int64)
            sample[which[::-1]] = np.arange(len(h))[::-1]
            if len(self.hash) + len(distinct) > self.most:
                self.forget()
            near = np.minimum(np.searchsorted(self.hash, distinct), max(len(self.hash) - 1, 0))
            fresh = np.ones(len(distinct), bool) if not len(self.hash) else self.hash[near] != distinct
            # Each piece against the first of its hash, and that one against the piece that is remembered.
            wrong = length != length[sample[which]]
            same = np.flatnonzero(~wrong)
            wrong[same] = _differ(codes, first[same], codes, first[sample[which[same]]], length[same])
            known = np.flatnonzero(~fresh)
            if len(known):
                slot, mine = self.place[near[known]], sample[known]
                other = self.code_size[slot] != length[mine]
                same = np.flatnonzero(~other)
                other[same] = _differ(codes, first[mine[same]], self.codes, self.code_at[slot[same]], length[mine[same]])
                wrong |= np.isin(which, known[other])
            if not wrong.any():
                break
            for i in np.flatnonzero(wrong):
                h[i] = np.frombuffer(hashlib.blake2b(joined[first[i] : last[i]].encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint64)[0]
        if fresh.any() or self.size is None:
            values = self.learn([joined[first[i] : last[i]] for i in sample[fresh]])
            sizes, flats = values[::2], values[1::2]
            known = len(self.hash)
            new = sample[fresh]
            begin = np.cumsum(length[new]) - length[new]
            self.code_at = np.concatenate((self.code_at, len(self.codes) + begin))
            self.code_size = np.concatenate((self.code_size, length[new]))
            self.codes = np.concatenate((self.codes, codes[np.repeat(first[new] - begin, length[new]) + np.arange(int(length[new].sum()))]))
            self.size = list(sizes) if self.size is None else [np.concatenate(x) for x in zip(self.size, sizes, strict=True)]
            self.flat = list(flats) if self.flat is None else [np.concatenate(x) for x in zip(self.flat, flats, strict=True)]
            self.begin = [np.cumsum(s) - s for s in self.size]
            merged = np.concatenate((self.hash, distinct[fresh]))
            order = np.argsort(merged, kind="stable")
            self.hash, self.place = merged[order], np.concatenate((self.place, known + np.arange(int(fresh.sum()))))[order]
        slot = self.place[np.searchsorted(self.hash, distinct)][which]
        out = []
        for size, begin, flat in zip(self.size, self.begin, self.flat, strict=True):
            n = size[slot]
            upto = np.cumsum(n)
            all_values = flat[np.repeat(begin[slot] - (upto - n), n) + np.arange(int(upto[-1]) if len(upto) else 0)]
            ends = np.append(0, upto)[np.cumsum(count)]
            out.append(np.split(all_values, ends[:-1]) if len(texts) else [])
        return out


def give_back() -> None:
    """Hands memory that a lot has left free in Arrow's pool and in the C library's heap back to the system, where it can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batches(frames: Iterator[pd.DataFrame], chars: int) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts in lots of about `chars`."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for frame in frames:
        for i, t in zip(frame["doc_id"], frame["text"], strict=True):
            if texts and held + len(t) > chars:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(None if pd.isna(i) else int(i))
            texts.append(t)
            held += len(t)
    if texts:
        yield ids, texts
