r"""A Merkle manifest of a dataset: one tree per source, one over the sources' roots.

1. Every row becomes a leaf, the digest of its fields. Leaves are range-partitioned by source, doc_id
   and digest, so that a partition holds runs of neighbouring leaves; counts of runs give each its
   first index. A large source is many runs, and equal rows are told apart by a number of their own.
2. A run pushes its leaves on a stack: as soon as a node's last sibling is there, the `FANOUT` nodes
   (fewer at the end of a level, one even) are carried into their parent. What stays on the stack are
   the run's peaks: completed subtrees whose siblings lie in neighbouring runs. Level sizes follow
   from the source's count, so that no run is padded.
3. Peaks of `WIDTH` neighbouring runs meet and are merged by the same stack, again and again, until a
   source has one node, its subroot. The subroots are leaves of the same tree above.
4. Each node knows the siblings on its way up to its peak, and each peak those of the rounds after; a
   second visit to the runs puts both together as proofs and folds a (tampered) leaf with them.

Edge cases: a null field is `-`; null doc_ids and sources come first, and a row without doc_id isn't
tampered with; rows that tie on doc_id are ordered by their digest; equal rows are leaves of their
own; an empty table has no rows and no root; other columns are ignored; long texts are only hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written

FANOUT, RUN_ROWS, WIDTH = 3, 50_000, 64
#: Fixed by the contract: the fields of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "key string, run long, level int, place long, digest string, total long"


def joined_digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(docs: DataFrame, text: Column) -> Column:
    fields = [text if c == "text" else F.col(c).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in fields)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """key (the source; null sorts first), doc_id, leaf and found, the leaf of the tampered row."""
    d = docs.select(*FIELDS)
    text = F.col("text").cast("string")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    tampered = leaf_digest(d, F.when(hit, F.translate(text, "\n", "")).otherwise(text))
    return d.select(key.alias("key"), "doc_id", leaf_digest(d, text).alias("leaf"), tampered.alias("found"), F.monotonically_increasing_id().alias("number"))


class Mountains:
    """The stack of a run of neighbouring nodes of one tree with `total` leaves."""

    def __init__(self, total: int) -> None:
        self.sizes = [total]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // FANOUT))
        self.stack: list[tuple[int, int]] = []
        self.known: dict[tuple[int, int], str] = {}

    def siblings(self, level: int, place: int) -> range:
        first = place - place % FANOUT
        return range(first, min(first + FANOUT, self.sizes[level]))

    def push(self, level: int, place: int, digest: str) -> None:
        while True:
            self.known[level, place] = digest
            self.stack.append((level, place))
            if self.sizes[level] == 1:
                return
            group = self.siblings(level, place)
            if place != group[-1] or self.stack[-len(group) :] != [(level, k) for k in group]:
                return
            del self.stack[-len(group) :]
            digest = joined_digest(self.known[level, k] for k in group)
            level, place = level + 1, place // FANOUT

    def way(self, level: int, place: int) -> tuple[list[str], list[str], int, int]:
        """The siblings to the left and to the right, level by level up to the peak, and the peak."""
        left, right = [], []
        while (level + 1, place // FANOUT) in self.known:
            group = self.siblings(level, place)
            left.append("".join(self.known[level, k] for k in group if k < place))
            right.append("".join(self.known[level, k] for k in group if k > place))
            level, place = level + 1, place // FANOUT
        return left, right, level, place


def _of_run(rows: pd.DataFrame) -> tuple[pd.DataFrame, Mountains]:
    rows = rows.sort_values(["doc_id", "leaf", "number"], na_position="first", kind="stable")
    m = Mountains(int(rows["total"].iloc[0]))
    for place, digest in enumerate(rows["leaf"], int(rows["first"].iloc[0])):
        m.push(0, place, digest)
    return rows, m


def _records(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of a run but leaves that aren't peaks."""
    m, peaks = (x := _of_run(rows)[1]), set(x.stack)
    made = [(level, place, digest, (level, place) in peaks) for (level, place), digest in m.known.items() if level or (level, place) in peaks]
    out = pd.DataFrame(made, columns=["level", "place", "digest", "peak"])
    return out.assign(key=key[0], run=key[1], total=m.sizes[0])


def _merged(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
    """Every node with its way to the peak of this round; nodes that were made besides have no run."""
    nodes = nodes.assign(start=[p * FANOUT**n for n, p in zip(nodes["level"], nodes["place"], strict=True)]).sort_values("start")
    m = Mountains(int(nodes["total"].iloc[0]))
    for r in nodes.itertuples():
        m.push(r.level, r.place, r.digest)
    out = []
    for r in nodes.itertuples():
        left, right, level, place = m.way(r.level, r.place)
        out.append((key[0], key[1], r.level, r.place, r.digest, m.sizes[0], left, right, level, place, m.known[level, place], False))
    given = set(zip(nodes["level"], nodes["place"], strict=True))
    out += [(key[0], key[1], level, place, digest, m.sizes[0], [], [], level, place, digest, True) for (level, place), digest in m.known.items() if (level, place) not in given]
    return pd.DataFrame(out, columns=["key", "run", "level", "place", "digest", "total", "left", "right", "top_level", "top_place", "top_digest", "made"])


@dataclass
class Tree:
    """runs: leaves with key, run, first and total; records: completed nodes; ways: from a run's peak up; roots: key and root."""

    runs: DataFrame
    records: DataFrame
    ways: DataFrame
    roots: DataFrame


def grown(rows: DataFrame, scratch: Scratch) -> Tree:
    """rows: key, doc_id, leaf, found, number, written before."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RUN_ROWS + 1)
    order = ["key", "doc_id", "leaf", "number"]
    runs = scratch.written(rows.repartitionByRange(parts, *order).withColumn("run", F.spark_partition_id().cast("long")), "runs")
    counts = scratch.written(runs.groupBy("key", "run").agg(F.count("*").alias("n")), "counts")
    # A source has at most `parts` runs.
    before = counts.alias("a").join(counts.select("key", F.col("run").alias("r"), F.col("n").alias("m")).alias("b"), "key").groupBy("key", "run")
    before = before.agg(F.coalesce(F.sum(F.when(F.col("r") < F.col("run"), F.col("m"))), F.lit(0)).alias("first"), F.sum("m").alias("total"))
    runs = runs.join(before, ["key", "run"])
    made = scratch.written(runs.groupBy("key", "run").applyInPandas(_records, _NODE + ", peak boolean"), "records")
    records, peaks, rounds = [made.drop("peak")], made.filter("peak").drop("peak"), []
    while parts > 1:
        parts = -(-parts // WIDTH)
        met = peaks.withColumn("run", F.floor(F.col("run") / WIDTH)).groupBy("key", "run")
        rounds.append(scratch.written(met.applyInPandas(_merged, _NODE + ", left array<string>, right array<string>, top_level int, top_place long, top_digest string, made boolean"), "merged"))
        records.append(rounds[-1].filter("made").select(*made.drop("peak").columns))
        tops = rounds[-1].filter("NOT made").groupBy("key", "run", "top_level", "top_place")
        peaks = tops.agg(F.first("top_digest").alias("digest"), F.first("total").alias("total")).withColumnsRenamed({"top_level": "level", "top_place": "place"})
    none = F.array().cast("array<string>")
    ways = made.filter("peak").select("key", "level", "place", none.alias("left"), none.alias("right"))
    for k, merged in enumerate(reversed(rounds)):
        merged = merged.filter("NOT made")
        if k == 0:
            ways = merged.select("key", "level", "place", "left", "right")
        else:
            above = ways.select("key", F.col("level").alias("top_level"), F.col("place").alias("top_place"), F.col("left").alias("l"), F.col("right").alias("r"))
            ways = merged.join(above, ["key", "top_level", "top_place"]).select("key", "level", "place", F.concat("left", "l").alias("left"), F.concat("right", "r").alias("right"))
    every = records[0]
    for more in records[1:]:
        every = every.unionByName(more)
    ways = made.filter("peak").select("key", "run", "level", "place").join(ways, ["key", "level", "place"])
    return Tree(runs, every, ways, peaks.select("key", F.col("digest").alias("root")))


def _climbed(key: tuple, rows: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
    """Each leaf with all siblings up to the root of its tree."""
    rows, m = _of_run(rows)
    above = {(r.level, r.place): (list(r.left), list(r.right)) for r in ways.itertuples()}
    out = []
    for r, place in zip(rows.itertuples(), range(int(rows["first"].iloc[0]), 1 << 62), strict=False):
        left, right, *peak = m.way(0, place)
        more = above[tuple(peak)]
        out.append((r.leaf, left + more[0], right + more[1]))
    return pd.DataFrame(out, columns=["leaf", "left", "right"]).assign(key=[r.below for r in rows.itertuples()])


def _proved(key: tuple, rows: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
    rows, m = _of_run(rows)
    above = {(r.level, r.place): (list(r.left), list(r.right)) for r in ways.itertuples()}
    root, subroot = ways["root"].iloc[0], ways["subroot"].iloc[0]
    proofs, folded = [], []
    for place, found in enumerate(rows["found"], int(rows["first"].iloc[0])):
        left, right, *peak = m.way(0, place)
        more = above[tuple(peak)]
        steps = list(zip(left + more[0], right + more[1], strict=True))
        proofs.append(joined_digest(x for step in steps for x in step))
        for a, b in steps:
            found = joined_digest((a, found, b))
        folded.append(found)
    return pd.DataFrame({"doc_id": rows["doc_id"].array, "leaf": rows["leaf"].array, "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded]})


def _both(docs: DataFrame, scratch: Scratch) -> tuple[Tree, Tree]:
    """The trees of the sources, and the tree over them with one key."""
    tree = grown(scratch.written(leaves(docs), "leaves"), scratch)
    roots = scratch.written(tree.roots, "subroots")
    tree.roots = roots
    # In the tree above, the source takes the place of doc_id in the order.
    top = roots.select(F.lit("").alias("key"), F.col("key").alias("doc_id"), F.col("root").alias("leaf"), F.col("root").alias("found"), F.lit(0).cast("long").alias("number"), F.col("key").alias("below"))
    return tree, grown(scratch.written(top, "tops"), scratch)


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered row) and verified."""
    scratch = Scratch(docs.sparkSession)
    tree, top = _both(docs, scratch)
    climbed = top.runs.groupBy("key", "run").cogroup(top.ways.groupBy("key", "run")).applyInPandas(_climbed, "key string, leaf string, left array<string>, right array<string>")
    climbed = scratch.written(climbed.crossJoin(F.broadcast(top.roots.select("root"))), "climbed")  # one root
    ways = tree.ways.join(climbed.select("key", F.col("leaf").alias("subroot"), "root", F.col("left").alias("l"), F.col("right").alias("r")), "key")
    ways = ways.select("key", "run", "level", "place", F.concat("left", "l").alias("left"), F.concat("right", "r").alias("right"), "subroot", "root")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = tree.runs.groupBy("key", "run").cogroup(ways.groupBy("key", "run"))
    result = written(made.applyInPandas(_proved, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"), "merkle")
    scratch.drop()
    return result


def manifest(docs: DataFrame) -> DataFrame:
    """source, level, place, digest of every completed node, the leaves left out; the tree over the sources has tree = 'root'."""
    scratch = Scratch(docs.sparkSession)
    tree, top = _both(docs, scratch)
    source = F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30))
    a = tree.records.filter("level > 0").select(F.lit("source").alias("tree"), source.alias("source"), "level", "place", "digest")
    b = top.records.filter("level > 0").select(F.lit("root").alias("tree"), F.lit(None).cast("string").alias("source"), "level", "place", "digest")
    result = written(a.unionByName(b), "manifest")
    scratch.drop()
    return result
