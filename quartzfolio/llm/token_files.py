"""Token ids in binary shards, compressed by a Re-Pair grammar.

Documents are range-partitioned and sorted by doc_id, encoded with the tokenizers library (each
distinct piece of the tokenizer's pattern once), and cut into shards of about `SHARD` ids, one
row of a Parquet table each. In a shard the most frequent id pairs are replaced by nonterminals,
round after round with at most `PAIRS` of them at once, until no pair occurs `LEAST` times or the
symbols of `width` bytes are used up. A shard holds

- sequence: its symbols as little-endian integers of `width` bytes (ids, then rule k as `first_rule` + k);
  2 bytes where the vocabulary leaves room for `ROOM` rules, else 4;
- rules: two symbols a rule; lengths: the ids that each rule expands to;
- doc_ids, and for each document the place of its first symbol (doc_at) and the number of ids
  before it in the partition (doc_start), so that one document is decoded from its own symbols alone.

A pair never crosses the end of a document. Nothing but the shards is read back.

Edge cases: a null or empty text has only its end id; equal rows are written each, those of one
doc_id in the order of their texts; a null doc_id comes first; an empty table writes no shard; a
document longer than a shard is a shard of its own; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path
from .pieces import Memo, batches, give_back

BATCH_CHARS, SHARD, CACHE = 3_000_000, 1_000_000, 1_500_000
PAIRS, LEAST, ROOM = 2048, 16, 4096
END_ID = 2
BLANK = "\u0120"  # fixed: how a byte-level vocabulary writes the byte 0x20
SHARD_SCHEMA = "part int, shard int, n_tokens long, width int, first_rule int, sequence binary, rules binary, lengths binary, doc_ids array<long>, doc_at array<int>, doc_start array<long>"
DOC_SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def width_of(first_rule: int) -> int:
    """Bytes of a symbol where ids are below first_rule."""
    if first_rule >= 1 << 31:
        raise ValueError(f"{first_rule} ids leave no room for rules in 4 bytes")
    return 2 if first_rule + ROOM <= 1 << 16 else 4


def _occurrences(x: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the places `at` at which a pair (left, right) occurs, and which; 0 is the most frequent."""
    symbols = int(x.max()) + 1
    row, column = np.zeros(symbols, np.uint16), np.zeros(symbols, np.uint16)
    lefts, r = np.unique(left, return_inverse=True)
    rights, c = np.unique(right, return_inverse=True)
    row[lefts], column[rights] = np.arange(1, len(lefts) + 1), np.arange(1, len(rights) + 1)
    which = np.full((len(lefts) + 1, len(rights) + 1), PAIRS, np.int32)
    which[r + 1, c + 1] = np.arange(len(left))
    found = which[row[x[at]], column[x[at + 1]]]
    some = np.flatnonzero(found < PAIRS)
    return at[some], found[some]


def _places(x: np.ndarray, last: np.ndarray, newest: int) -> np.ndarray:
    """Where a pair begins inside a document; with `newest` only pairs with a symbol from there on. Of a run of one symbol every second pair counts."""
    inside = ~last[:-1]
    if newest:
        new = x >= newest
        inside &= new[:-1] | new[1:]
    twin = np.flatnonzero((x[:-1] == x[1:]) & inside)
    if len(twin):
        run = np.concatenate(([True], np.diff(twin) != 1))
        start = np.maximum.accumulate(np.where(run, np.arange(len(twin)), 0))
        inside[twin[(np.arange(len(twin)) - start) % 2 == 1]] = False
    return np.flatnonzero(inside)


def _frequent(x: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (left, right) that occur LEAST times at these places, the most frequent first."""
    shift, wide = 8 * width, np.uint32 if width == 2 else np.uint64
    ordered = np.sort(x[at].astype(wide) << wide(shift) | x[at + 1].astype(wide))
    if len(ordered) < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A pair with LEAST occurrences equals the one LEAST - 1 places on.
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(ordered) - LEAST + 1]
    head = np.flatnonzero(first & (ordered[LEAST - 1 :] == ordered[: len(ordered) - LEAST + 1]))
    pair = ordered[head]
    count = np.searchsorted(ordered, pair, "right") - head
    pair = pair[np.lexsort((pair, -count))]
    return (pair >> wide(shift)).astype(np.int64), (pair & wide((1 << shift) - 1)).astype(np.int64)


def compress(x: np.ndarray, last: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, whether each ends a document, and the rules (two symbols each) of Re-Pair.

    A round after one that took all frequent pairs only counts pairs with its new symbols, as no other
    pair has become more frequent; where they are used up a round over everything is the proof.
    """
    x, width = x.astype(np.uint32), width_of(first_rule)
    rules, newest = np.zeros((0, 2), np.int64), 0
    while len(x) > 1 and (room := (1 << 8 * width) - first_rule - len(rules)) > 0:
        at = _places(x, last, newest)
        every = _frequent(x, at, width)
        lefts, rights = (side[: min(PAIRS, room)] for side in every)
        if not len(lefts):
            if not newest:
                break
            newest = 0
            continue
        newest = first_rule + len(rules) if len(every[0]) == len(lefts) else 0
        at, place = _occurrences(x, at, lefts, rights)
        joined = np.diff(at) == 1  # with the occurrence before
        before = np.concatenate(([PAIRS], np.where(joined, place[:-1], PAIRS)))
        after = np.concatenate((np.where(joined, place[1:], PAIRS), [PAIRS]))
        take = (place < before) & (place <= after)
        at, place = at[take], place[take]
        x[at] = first_rule + len(rules) + place
        last[at] = last[at + 1]
        keep = np.ones(len(x), bool)
        keep[at + 1] = False
        x, last = x[keep], last[keep]
        rules = np.concatenate((rules, np.stack((lefts, rights), axis=1)))
    return x, last, rules


def expansion_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Ids that each rule stands for; a rule only names ids and rules before it."""
    out = np.ones(len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (out[a - first_rule] if a >= first_rule else 1) + (out[b - first_rule] if b >= first_rule else 1)
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids of symbols, level by level."""
    x = symbols.astype(np.int64)
    while (nested := x >= first_rule).any():
        size = 1 + nested
        begin = np.cumsum(size) - size
        out = np.repeat(x, size)
        out[begin[nested]] = rules[x[nested] - first_rule, 0]
        out[begin[nested] + 1] = rules[x[nested] - first_rule, 1]
        x = out
    return x


def expand_all(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_rule: int) -> np.ndarray:
    """As `expand`, for many symbols: every rule is expanded once, unless that takes more than the text."""
    nested = symbols >= first_rule
    size = np.ones(len(symbols), np.int64)
    size[nested] = lengths[symbols[nested] - first_rule]
    total = int(size.sum())
    if int(lengths.sum()) > 2 * total:
        return expand(symbols, rules, first_rule)
    begin = np.cumsum(lengths) - lengths
    flat = expand(np.arange(first_rule, first_rule + len(rules)), rules, first_rule)
    first = symbols.copy()  # a plain id, or where the rule's ids begin
    first[nested] = begin[symbols[nested] - first_rule]
    at = np.cumsum(size) - size
    out = np.repeat(first, size)
    inner = np.repeat(nested, size)
    out[inner] = flat[out[inner] + (np.arange(total) - np.repeat(at, size))[inner]]
    return out


class _Learner:
    """Ids of distinct pieces by the tokenizers library.

    Most pieces are a blank and letters. A byte-level tokenizer splits a text of such pieces at
    their blanks again, so they are encoded `JOINED` at once, and a token that starts
    with the blank begins the next piece. All other pieces are encoded one by one.
    """

    JOINED = 50
    #: Texts that the library holds encodings of at once.
    LOT = 5_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.of.encode_special_tokens = True
        self.begins = np.zeros(self.of.get_vocab_size(), bool)
        for token, i in self.of.get_vocab().items():
            self.begins[i] = token.startswith(BLANK)
        self.byte_level = self.of.token_to_id(BLANK) is not None and self.single([" a", " ab"])[0].sum() == len(self.of.encode(" a ab", add_special_tokens=False).ids)

    def encoded(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text; a lot's encodings are let go before the next."""
        for at in range(0, len(texts), self.LOT):
            yield from (e.ids for e in self.of.encode_batch_fast(texts[at : at + self.LOT], add_special_tokens=False))

    def single(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = list(self.encoded(pieces))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))

    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lots = [words[at : at + self.JOINED] for at in range(0, len(words), self.JOINED)]
        sizes, ids = [], []
        for some, found in zip(lots, self.encoded(["".join(some) for some in lots]), strict=True):
            code = np.array(found, np.uint32)
            first = np.flatnonzero(self.begins[code])
            if len(first) == len(some) and first[0] == 0:
                sizes.append(np.diff(np.append(first, len(code))))
                ids.append(code)
            else:
                for part, held in zip(self.single(some), (sizes, ids), strict=True):
                    held.append(part)
        return np.concatenate(sizes), np.concatenate(ids)

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, ...]:
        word = np.fromiter((self.byte_level and p[0] == " " and p[1:].isalpha() for p in pieces), bool, len(pieces))
        sizes, flat, begin, known = np.zeros(len(pieces), np.int64), [], np.zeros(len(pieces), np.int64), 0
        for learn, mine in ((self.joined, word), (self.single, ~word)):
            if mine.any():
                n, ids = learn([pieces[i] for i in np.flatnonzero(mine)])
                sizes[mine], begin[mine] = n, known + np.cumsum(n) - n
                flat.append(ids)
                known += len(ids)
        upto = np.cumsum(sizes)
        ids = np.concatenate([*flat, np.zeros(0, np.uint32)])
        return sizes, ids[np.repeat(begin - (upto - sizes), sizes) + np.arange(known)]


_MEMOS: dict[tuple[str, str], tuple[Memo, int]] = {}


def _memo(path: str, pattern: str) -> tuple[Memo, int]:
    if (path, pattern) not in _MEMOS:
        learner = _Learner(path)
        _MEMOS[path, pattern] = Memo(pattern, learner, CACHE), learner.of.get_vocab_size()
    return _MEMOS[path, pattern]


def _shard(part: int, number: int, ids: list, codes: list[np.ndarray], before: int, first_rule: int) -> pd.DataFrame:
    size = np.fromiter(map(len, codes), np.int64, len(codes))
    last = np.zeros(int(size.sum()), bool)
    last[np.cumsum(size) - 1] = True
    x, last, rules = compress(np.concatenate(codes), last, first_rule)
    width = width_of(first_rule)
    at = np.append(0, np.flatnonzero(last)[:-1] + 1)
    row = {
        "part": part, "shard": number, "n_tokens": int(size.sum()), "width": width, "first_rule": first_rule,
        "sequence": x.astype(f"<u{width}").tobytes(), "rules": rules.astype(f"<u{width}").tobytes(), "lengths": expansion_lengths(rules, first_rule).astype("<u4").tobytes(),
        "doc_ids": ids, "doc_at": at.tolist(), "doc_start": (before + np.cumsum(size) - size).tolist(),
    }
    return pd.DataFrame([row])


def write(docs: DataFrame, path: str, tokenizer: str, pattern: str, end_id: int = END_ID, shard: int = SHARD) -> None:
    """Writes the shards of docs to path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, first_rule = _memo(tokenizer, pattern)
        part, number, before, held = 0, 0, 0, 0
        names: list = []
        codes: list[np.ndarray] = []

        def seen() -> Iterator[pd.DataFrame]:
            nonlocal part
            for f in frames:
                if len(f):
                    part = int(f["part"].iloc[0])
                yield f

        for ids, texts in batches(seen(), BATCH_CHARS):
            for i, code in zip(ids, memo(texts)[0], strict=True):
                names.append(i)
                codes.append(np.append(code, np.uint32(end_id)))
                held += len(codes[-1])
                if held >= shard:
                    yield _shard(part, number, names, codes, before, first_rule)
                    number, before, held, names, codes = number + 1, before + held, 0, [], []
        if codes:
            yield _shard(part, number, names, codes, before, first_rule)
        give_back()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    d.mapInPandas(run, SHARD_SCHEMA).write.parquet(path)


def _decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for s in frame.itertuples():
            rules = np.frombuffer(s.rules, f"<u{s.width}").reshape(-1, 2).astype(np.int64)
            lengths = np.frombuffer(s.lengths, "<u4").astype(np.int64)
            sequence = np.frombuffer(s.sequence, f"<u{s.width}").astype(np.int64)
            nested = sequence >= s.first_rule
            size = np.ones(len(sequence), np.int64)
            size[nested] = lengths[sequence[nested] - s.first_rule]
            n = np.add.reduceat(size, s.doc_at)
            ids = np.split(expand_all(sequence, rules, lengths, s.first_rule).astype("<u4"), np.cumsum(n)[:-1])
            yield pd.DataFrame({"part": s.part, "doc_id": pd.array([None if pd.isna(i) else int(i) for i in s.doc_ids], "Int64"), "local_start": s.doc_start, "n_tokens": n, "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]})
    give_back()


def document(shard, place: int) -> np.ndarray:
    """Random access: the ids of one document of a shard row, from its own symbols alone."""
    stop = shard.doc_at[place + 1] if place + 1 < len(shard.doc_at) else len(shard.sequence) // shard.width
    symbols = np.frombuffer(shard.sequence, f"<u{shard.width}")[shard.doc_at[place] : stop]
    return expand(symbols, np.frombuffer(shard.rules, f"<u{shard.width}").reshape(-1, 2).astype(np.int64), shard.first_rule)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the shards: doc_id, start, n_tokens and ids_crc32."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # One row for each partition of the writer: bounded by the number of partitions, not by the data.
    total, offsets = 0, []
    for part, n in sorted(shards.groupBy("part").agg(F.sum("n_tokens")).collect()):
        offsets.append((part, total))
        total += n
    starts = spark.createDataFrame(offsets, "of int, offset long")
    found = shards.mapInPandas(_decoded, DOC_SCHEMA)
    return found.join(F.broadcast(starts), found.part == starts.of).select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """Writes docs as shards into the shared folder and reads them back."""
    path = shared_path(docs.sparkSession, "token_files")
    write(docs, path, tokenizer, pattern)
    return read(docs.sparkSession, path)
