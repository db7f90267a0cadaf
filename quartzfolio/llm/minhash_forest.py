"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Every text becomes its set of 5-word shingles (64-bit hashes), a 128-bit fingerprint of the set
   and trees x `LENGTH` minima. Equal sets are one class, so exact copies never meet in pairs.
2. The threshold gives the number of trees (16 at 85 per cent, 23 at 80). Each tree is a sorted order
   of the classes by its own `LENGTH` minima. Classes that share the first `DEPTH` minima are a
   region. Candidates are the neighbours in the order by longest common prefix, the region's lowest
   id and the hub, the lowest id below its most frequent longer prefix. The depth adapts: in a region
   of more than `CROWDED` classes every longer prefix gives its lowest id as one more candidate.
   Candidates grow in proportion to the members.
3. Candidates that sizes and signatures don't rule out are confirmed on their full sets and
   gathered into components.
4. The exact way for the rest: in every region that still has several components, all members
   outside its largest component are compared with all members of other components, in
   blocks of bounded size, by signatures and then by 32-bit shingles: all of them where a set has at
   most `MINI`, which no true link fails, else a share chosen by their last bits, within
   `SLACK` deviations. What passes is confirmed on full sets, too. Pairs of blocks are dealt by
   their own numbers, so that a large region is the work of many tasks.

After that no pair of a region is left untested but those already connected, whatever the
region's size. A pair at the threshold misses all regions with a probability of
(1 - similarity ** DEPTH) ** trees, `MISS` = 8e-6 at most (7.4e-6 at 85 per cent, 5.4e-6 at 80); is
dropped on its signatures, in whichever step, with less than 8e-8; and on a share of its shingles,
where a set has more than `MINI`, with about 3e-8: 7.6e-6 and 5.6e-6 in all at most. Links,
components and sets are tables in the shared folder, which go once the result is written.

Edge cases: a null or empty text, or one without words, has no shingles and is linked with nothing; fewer
words than 5 are one shingle; rows of one doc_id are one document in the components (and kept
alike); a null doc_id is linked with nothing and kept; an empty table gives no rows; other
columns are kept by `representatives`, whatever their names, and ignored otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, whole_rows, written
from .decontaminate import Words
from .pieces import batches

SHINGLE, DEPTH, LENGTH, CROWDED = 5, 4, 6, 64
#: The most that a pair at the threshold may miss all regions.
MISS = 8e-6
BATCH_CHARS, BLOCK, MINI = 4_000_000, 512, 512
#: Deviations that a share of the shingles may lie below the threshold.
SLACK = 6
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Forest:
    """The threshold in per cent, and what follows from it."""

    percent: int

    @property
    def similarity(self) -> float:
        return self.percent / 100

    @property
    def trees(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - self.similarity**DEPTH))

    @cached_property
    def least(self) -> int:
        """Equal minima below which a pair is ruled out: a pair at the threshold has fewer with a hundredth of MISS at most."""
        n, below, k = self.trees * LENGTH, 0.0, 0
        while (below := below + math.comb(n, k) * self.similarity**k * (1 - self.similarity) ** (n - k)) <= MISS / 100:
            k += 1
        return k

    @property
    def variance(self) -> float:
        """Of one shingle of the union at the threshold."""
        return self.similarity * (1 - self.similarity)


@cache
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240601)
    return r.integers(0, 1 << 63, n, dtype=np.uint64) | np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str], words: Words) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    h, ends = words(b"\n".join(data))
    upto = np.searchsorted(ends, np.cumsum([len(x) + 1 for x in data]))
    n = len(h) - SHINGLE + 1
    s = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        s = s * _M1 + h[k : k + n]
    s = _mixed(s)
    out, at = [], 0
    for stop in upto.tolist():
        if stop - at >= SHINGLE:
            out.append(np.unique(s[at : stop - SHINGLE + 1]))
        elif stop > at:
            one = np.uint64(stop - at)
            with np.errstate(over="ignore"):
                for x in h[at:stop]:
                    one = one * _M2 + x
            out.append(_mixed(np.array([one], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at = stop
    return out


def _fingerprint(s: np.ndarray) -> bytes:
    return len(s).to_bytes(4, "little") + int(np.bitwise_xor.reduce(s * _M2)).to_bytes(8, "little") + int(np.add.reduce(_mixed(s ^ _M1))).to_bytes(8, "little")


def _sketches(frames: Iterator[pd.DataFrame], forest: Forest) -> Iterator[pd.DataFrame]:
    words, trees = Words(_WORD), forest.trees
    by, plus = _multipliers(trees * LENGTH)
    for ids, texts in batches(frames, BATCH_CHARS):
        sets = shingle_sets(texts, words)
        full = [k for k, s in enumerate(sets) if len(s)]
        rows = {"doc_id": pd.array(ids, "Int64"), "n": list(map(len, sets)), "cls": [_fingerprint(s) if len(s) else None for s in sets], "sig": [None] * len(sets), "keys": [None] * len(sets), "deep": [None] * len(sets)}
        if full:
            flat = np.concatenate([sets[k] for k in full])
            size = np.array([len(sets[k]) for k in full])
            first = np.cumsum(size) - size
            least = np.empty((len(full), trees * LENGTH), np.uint64)
            for j in range(trees * LENGTH):
                least[:, j] = np.minimum.reduceat(_mixed(flat * by[j] + plus[j]), first)
            tree = _mixed(least).reshape(len(full), trees, LENGTH)
            key, deep = np.zeros((2, len(full), trees), np.uint64)
            key, deep = key.astype(np.uint64), deep.astype(np.uint64)
            for j in range(LENGTH):
                if j < DEPTH:
                    key = _mixed(key * _M1 + tree[:, :, j])
                else:
                    deep = (deep << np.uint64(64 // (LENGTH - DEPTH) % 64)) | (tree[:, :, j] >> np.uint64(64 - 64 // (LENGTH - DEPTH)))
            small = (least >> np.uint64(20)).astype("<u2")
            for i, k in enumerate(full):
                rows["sig"][k], rows["keys"][k], rows["deep"][k] = small[i].tobytes(), key[i].view(np.int64), deep[i].view(np.int64)
        yield pd.DataFrame(rows)


def sketched(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, n (shingles), cls (fingerprint), sig, and for each tree its region key and deeper order."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInPandas(lambda frames: _sketches(frames, forest), "doc_id long, n long, cls binary, sig binary, keys array<long>, deep array<long>")


def _neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last = None
    for f in frames:
        if last is not None:
            f = pd.concat([last, f], ignore_index=True)
        same = (f["t"].values[1:] == f["t"].values[:-1]) & (f["key"].values[1:] == f["key"].values[:-1])
        a, b = f["id"].values[:-1][same], f["id"].values[1:][same]
        last = f.tail(1)
        yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _likely(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray, forest: Forest) -> np.ndarray:
    """What sizes and signatures leave open; a and b broadcast against one another."""
    sizes = 100 * np.minimum(na, nb) >= forest.percent * np.maximum(na, nb)
    return sizes & ((a == b).sum(-1) >= forest.least)


def _open_pairs(frames: Iterator[pd.DataFrame], forest: Forest) -> Iterator[pd.DataFrame]:
    for f in frames:
        if len(f):
            a, b = (np.frombuffer(b"".join(f[c]), "<u2").reshape(len(f), -1) for c in ("sig_a", "sig_b"))
            f = f[_likely(f["n_a"].values, f["n_b"].values, a, b, forest)]
        yield f[["a", "b", "cls_a", "cls_b"]]


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = Words(_WORD)
    for _, texts in batches(frames, BATCH_CHARS):
        sets = shingle_sets(texts, words)
        yield pd.DataFrame({"cls": [_fingerprint(s) for s in sets], "shingles": [s.tobytes() for s in sets]})


def _confirmed(frames: Iterator[pd.DataFrame], forest: Forest) -> Iterator[pd.DataFrame]:
    for f in frames:
        keep = []
        for x, y in zip(f["set_a"], f["set_b"], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate((x, y))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= forest.percent * (len(x) + len(y) - common))
        yield f.loc[keep, ["a", "b"]]


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, forest: Forest, scratch: Scratch) -> DataFrame:
    """Of candidate pairs (a < b, ids of classes) those whose full sets reach the threshold."""
    of = classes.select("id", "cls", "n", "sig")
    for side in "ab":
        pairs = pairs.join(of.withColumnsRenamed({"id": side, "cls": f"cls_{side}", "n": f"n_{side}", "sig": f"sig_{side}"}), side)
    likely = scratch.written(pairs.mapInPandas(lambda frames: _open_pairs(frames, forest), "a long, b long, cls_a binary, cls_b binary"), "likely_pairs")
    ids = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    # One row for a class, however many rows repeat its text.
    sets = texts.mapInPandas(_sets, "cls binary, shingles binary").groupBy("cls").agg(F.first("shingles").alias("shingles"))
    sets = scratch.written(sets, "shingle_sets")
    for side in "ab":
        likely = likely.join(sets.withColumnsRenamed({"cls": f"cls_{side}", "shingles": f"set_{side}"}), f"cls_{side}")
    return likely.mapInPandas(lambda frames: _confirmed(frames, forest), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and comp, the lowest id reachable, of every id in edges (a, b): minima of neighbours and jumps."""
    kept, rounds = Scratch(edges.sparkSession), Scratch(edges.sparkSession)
    both = kept.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = rounds.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, F.col("id") == F.col("a")).select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = labels.select(F.col("id").alias("at"), F.col("comp").alias("beyond"))
        new = rounds.written(step.join(jump, F.col("comp") == F.col("at")).select("id", "old", F.least("comp", "beyond").alias("comp")), "labels")
        rounds.drop(last=1)
        labels = new.select("id", "comp")
        if new.filter("comp != old").isEmpty():
            kept.drop()
            return labels


def _minis(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each set the 32-bit shingles whose last `bits` bits are 0: at most about MINI, ascending."""
    words = Words(_WORD)
    for _, texts in batches(frames, BATCH_CHARS):
        sets = shingle_sets(texts, words)
        bits = [max(0, int(np.ceil(np.log2(max(len(s), 1) / MINI)))) for s in sets]
        low = [s.astype(np.uint32) for s in sets]
        yield pd.DataFrame({"cls": [_fingerprint(s) for s in sets], "bits": bits, "mini": [np.sort(x[(x & np.uint32((1 << k) - 1)) == 0]).tobytes() for x, k in zip(low, bits, strict=True)]})


def _alike(mine: np.ndarray, my_bits: int, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, bits: np.ndarray, some: np.ndarray, forest: Forest) -> np.ndarray:
    """Of the places `some` in a block those whose shingles leave a link with mine open."""
    if not len(some) or not len(mine):
        return some
    n = size[some]
    upto = np.cumsum(n)
    theirs = flat[np.repeat(begin[some] - (upto - n), n) + np.arange(int(upto[-1]))]
    share = np.maximum(bits[some], my_bits)
    mask = (np.uint32(1) << share.astype(np.uint32)) - np.uint32(1)
    used = (theirs & np.repeat(mask, n)) == 0
    hit = used & (mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs)
    of = np.repeat(np.arange(len(some)), n)
    common = np.bincount(of, hit, len(some))
    of_mine = np.array([int(((mine & m) == 0).sum()) for m in np.unique(mask)])[np.searchsorted(np.unique(mask), mask)]
    union = np.maximum(np.bincount(of, used, len(some)) + of_mine - common, 1)
    slack = np.where(share == 0, 0.0, SLACK * np.sqrt(forest.variance / union))
    return some[100 * common >= (forest.percent - 100 * slack) * union]


def _crossed(frames: Iterator[pd.DataFrame], forest: Forest) -> Iterator[pd.DataFrame]:
    """Pairs of a block of the rest and a block of its region that aren't connected nor ruled out."""
    for f in frames:
        for r in f.itertuples():
            a, b = (np.frombuffer(b"".join(x), "<u2").reshape(len(x), -1) for x in (r.sig_1, r.sig_2))
            size = np.fromiter((len(x) // 4 for x in r.mini_2), np.int64, len(r.mini_2))
            flat, begin = np.frombuffer(b"".join(r.mini_2), np.uint32), np.cumsum(size) - size
            for k, (me, n, comp) in enumerate(zip(r.id_1, r.n_1, r.comp_1, strict=True)):
                some = np.flatnonzero(r.comp_2 != comp)
                some = some[_likely(r.n_2[some], n, b[some], a[k], forest)]
                some = _alike(np.frombuffer(r.mini_1[k], np.uint32), r.bits_1[k], flat, begin, size, r.bits_2, some, forest)
                yield pd.DataFrame({"a": np.minimum(r.id_2[some], me), "b": np.maximum(r.id_2[some], me)})


def _rest(members: DataFrame, classes: DataFrame, comps: DataFrame, docs: DataFrame, forest: Forest, scratch: Scratch) -> DataFrame:
    """Candidate pairs of regions with several components."""
    placed = members.select("t", "key", "id").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    sizes = placed.groupBy("t", "key", "comp").agg(F.count("*").alias("c"))
    regions = sizes.groupBy("t", "key").agg(F.count("*").alias("comps"), F.sum("c").alias("c"), F.max_by("comp", F.struct("c", "comp")).alias("big")).filter("comps > 1").select("t", "key", "c", "big")
    inside = scratch.written(placed.join(regions, ["t", "key"]), "inside")
    of = classes.join(inside.select("id").distinct(), "id", "left_semi").select("id", "cls", "n", "sig")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(of.select("id"), F.col("doc_id") == F.col("id"), "left_semi")
    minis = texts.mapInPandas(_minis, "cls binary, bits long, mini binary").groupBy("cls").agg(F.first("bits").alias("bits"), F.first("mini").alias("mini"))
    inside = inside.join(scratch.written(of.join(minis, "cls").drop("cls"), "minis"), "id")
    n_blocks = F.ceil(F.col("c") / BLOCK)
    block = F.pmod(F.xxhash64("id"), n_blocks).alias("block")
    blocks = inside.select("t", "key", block, n_blocks.alias("n_blocks"), "big", F.struct("id", "comp", "n", "sig", "bits", "mini").alias("x"))
    columns = lambda side: [F.col(f"x.{c}").alias(f"{c}_{side}") for c in ("id", "comp", "n", "sig", "bits", "mini")]
    every = blocks.groupBy("t", "key", "block").agg(F.collect_list("x").alias("x")).select("t", "key", "block", *columns(2))
    rest = blocks.filter("x.comp != big").groupBy("t", "key", F.col("block").alias("of")).agg(F.first("n_blocks").alias("n_blocks"), F.collect_list("x").alias("x")).select("t", "key", "of", "n_blocks", *columns(1))
    every, rest = scratch.written(every, "blocks"), scratch.written(rest, "rest")
    pairs = rest.select("t", "key", "of", F.explode(F.expr("sequence(0L, n_blocks - 1)")).alias("block")).repartition("t", "key", "of", "block")
    crossed = pairs.join(every, ["t", "key", "block"]).join(rest.drop("n_blocks"), ["t", "key", "of"]).drop("t", "key", "of", "block")
    return crossed.mapInPandas(lambda frames: _crossed(frames, forest), "a long, b long").distinct()


def _deeper(members: DataFrame) -> DataFrame:
    """Candidates (a, b) of crowded regions: every class and the lowest id of each of its longer prefixes."""
    bits = 64 // (LENGTH - DEPTH)
    prefixes = F.array(*(F.struct(F.lit(k).alias("level"), F.expr(f"shiftright(deep, {bits * (LENGTH - DEPTH - k)})").alias("prefix")) for k in range(1, LENGTH - DEPTH + 1)))
    placed = members.filter(F.col("c") > CROWDED).select("t", "key", "id", F.explode(prefixes).alias("p")).select("t", "key", "id", "p.*")
    low = placed.groupBy("t", "key", "level", "prefix").agg(F.min("id").alias("low"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return placed.join(low, ["t", "key", "level", "prefix"]).filter("low != id").select(F.col("low").alias("a"), F.col("id").alias("b"))


def linked(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all documents; the components (id, comp) of classes that have links."""
    forest, scratch = Forest(percent), Scratch(docs.sparkSession)
    sketches = written(sketched(docs, forest), "sketches")
    classes = scratch.written(sketches.filter("n > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n", "sig", "keys", "deep"))), "classes")
    trees = classes.select("id", F.posexplode(F.arrays_zip("keys", "deep")).alias("t", "x")).select("t", F.col("x.keys").alias("key"), F.col("x.deep").alias("deep"), "id")
    below = trees.groupBy("t", "key", "deep").agg(F.count("*").alias("c"), F.min("id").alias("low"))
    regions = below.groupBy("t", "key").agg(F.sum("c").alias("c"), F.min("low").alias("pivot"), F.max_by("low", F.struct("c", F.expr("-low"))).alias("hub")).filter("c > 1")
    members = scratch.written(trees.join(regions, ["t", "key"]), "members")
    order = members.select("t", "key", "deep", "id").repartitionByRange("t", "key", "deep", "id").sortWithinPartitions("t", "key", "deep", "id")
    stars = members.select(F.col("id").alias("me"), F.explode(F.array_distinct(F.array("pivot", "hub"))).alias("you")).filter("me != you").select(F.least("me", "you").alias("a"), F.greatest("me", "you").alias("b"))
    candidates = order.mapInPandas(_neighbours, "a long, b long").filter("a != b").unionByName(stars).unionByName(_deeper(members))
    edges = confirmed(candidates.distinct(), classes, docs, forest, scratch)
    comps = components(edges)
    more = confirmed(_rest(members, classes, comps, docs, forest, scratch), classes, docs, forest, scratch)
    label = lambda side: comps.withColumnsRenamed({"id": side, "comp": f"c_{side}"})
    across = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("c_a", "a").alias("x"), F.coalesce("c_b", "b").alias("y"))
    across = scratch.written(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "across")
    joined = components(across).withColumnsRenamed({"id": "was", "comp": "now"})
    every = comps.unionByName(across.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comps, "id", "left_anti").withColumn("comp", F.col("id")))
    whole = every.join(joined, F.col("comp") == F.col("was"), "left").select("id", F.coalesce("now", "comp").alias("comp"))
    result = written(_repeated_ids(sketches, classes, whole), "components")
    scratch.drop()
    return sketches, result


def _repeated_ids(sketches: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """cls and comp of every class; a doc_id with several texts connects their components."""
    of = classes.select("cls", "id").join(comps, "id", "left").select("cls", F.coalesce("comp", "id").alias("comp"))
    several = sketches.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low != high").select("doc_id")
    if several.isEmpty():
        return of
    links = sketches.join(several, "doc_id", "left_semi").join(of, "cls").groupBy("doc_id", "comp").count()
    low = links.groupBy("doc_id").agg(F.min("comp").alias("a"))
    joined = components(links.join(low, "doc_id").select("a", F.col("comp").alias("b"))).withColumnsRenamed({"id": "was", "comp": "now"})
    return of.join(joined, F.col("comp") == F.col("was"), "left").select("cls", F.coalesce("now", "comp").alias("comp"))


def groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    sketches, comps = linked(docs, percent)
    of = sketches.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("cls")).alias("cls")).join(comps, "cls", "left")
    component = F.coalesce("comp", "doc_id")
    return of.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs, with all their columns, that `groups` keeps."""
    gone = groups(docs, percent).groupBy("doc_id").agg(F.bool_or("kept").alias("any")).filter("NOT any").select(F.col("doc_id").alias("gone"))
    rows = whole_rows(docs).drop("text")
    return rows.join(gone, F.col("row.doc_id").cast("long") == F.col("gone"), "left_anti").select("row.*")
