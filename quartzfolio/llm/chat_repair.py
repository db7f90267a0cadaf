r"""Conversation structure repair: the cheapest edits to a legal sequence of roles.

A legal conversation's role initials are `(s?(ua)+)?`. Keeping a row costs 0, another role (user or
assistant) 2, deleting it 3, inserting an empty user or assistant row 2; an undeleted row whose
text is cut off adds 1, and blank or repeated rows have to go. The lattice of (row, grammar state) is
never built: Dijkstra's search makes its edges as it pops nodes by (cost, audit), the audit being
the initials of the edits so far, and stops at the first accepting end node. No audit of equal
cost is the beginning of another at the same node, as what it lacks could only be inserts, which cost;
so the order of audits is kept by every continuation.

A conversation of any length is cut into blocks of at most `BLOCK` distinct rows, by a range partitioning of all
rows in their order, and each block is searched from every state it may be entered in. The search over
a conversation's blocks is the same with blocks in place of rows, so that only audits and the
repaired rows of one conversation meet, not the work. Searches depend on initials and faults
alone and are remembered by them. Equal rows of a turn are one row with a count.

Edge cases: a null role or text is one space, as the contract says, a null turn comes first; rows that
tie on the turn are ordered by role, then by a digest of the text; an empty role has no legal
initial; a null conv_id is a conversation of its own; a conversation without rows has an empty
audit; an empty table has no conversation; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written

BLOCK = 128
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant. Conversations may end in the first and the last.
STATES, START, ACCEPTING = range(4), 0, (0, 3)
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ROLES = {"u": "user", "a": "assistant"}
Edge = tuple[int, str, int, int]


def cheapest(end: int, edges: Callable[[int, int], Iterable[Edge]], start: int, ends: tuple[int, ...], first: bool) -> dict[int, tuple[int, str]]:
    """(cost, audit) of end states by Dijkstra from (0, start): of the first one that is popped, or of all."""
    heap, done, found = [(0, "", 0, start)], set(), {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == end and state in ends:
            found[state] = (cost, audit)
            if first or len(found) == len(ends):
                break
        for more, letters, j, to in edges(i, state):
            if (j, to) not in done:
                heapq.heappush(heap, (cost + more, audit + letters, j, to))
    return found


def row_edges(tokens: str) -> tuple[int, Callable[[int, int], Iterable[Edge]]]:
    """The lattice of rows: x has to go, s u a o are initials, upper case where a row is cut off.

    Rows in a row that have to go are one step: an insert between them is never better than one behind them.
    """
    steps = [(c, len(list(run))) for c, run in itertools.groupby(tokens)] if "xx" in tokens else [(c, 1) for c in tokens]
    steps = [(c, n) for c, k in steps for n in ([k] if c == "x" else [1] * k)]

    def edges(i: int, state: int) -> Iterable[Edge]:
        for c in "ua":
            if (to := _NEXT.get((state, c))) is not None:
                yield INSERT, "I", i, to
        if i == len(steps):
            return
        token, count = steps[i]
        yield DELETE * count, "D" * count, i + 1, state
        if token != "x":
            extra = CUT_OFF if token.isupper() else 0
            if (to := _NEXT.get((state, token.lower()))) is not None:
                yield KEEP + extra, "K", i + 1, to
            for c in "ua":
                if (to := _NEXT.get((state, c))) is not None:
                    yield REROLE + extra, "R", i + 1, to

    return len(steps), edges


@lru_cache(100_000)
def block_table(tokens: str) -> list[tuple[int, str] | None]:
    """(cost, audit) from each state (first) to each state of a block of rows."""
    n, edges = row_edges(tokens)
    return [x for start in STATES for found in [cheapest(n, edges, start, tuple(STATES), False)] for x in (found.get(to) for to in STATES)]


def chained(tables: list[list]) -> tuple[int, str]:
    """The cheapest way through all blocks, by the same search over blocks."""

    def edges(b: int, state: int) -> Iterable[Edge]:
        for to in STATES if b < len(tables) else ():
            if (x := tables[b][4 * state + to]) is not None:
                yield x[0], x[1], b + 1, to

    return next(iter(cheapest(len(tables), edges, START, ACCEPTING, True).values()))


def plan(tokens: str, audit: str) -> list[tuple[int, str | None]]:
    """Of each repaired row which of the rows that needn't go it is (-1: inserted) and its new role (None: its own).

    The roles follow from the number of rows: an odd one begins with a kept system row.
    """
    rows, at = iter(tokens), -1
    odd, out = sum(c != "D" for c in audit) % 2, []
    for edit in audit:
        if edit != "I" and next(rows) != "x":
            at += 1
        if edit != "D":
            role = "ua"[(len(out) - odd) % 2]
            out.append((-1 if edit == "I" else at, None if edit == "K" else ROLES[role]))
    return out


def _tables(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: [None if x is None else {"cost": x[0], "audit": x[1]} for x in block_table(t)])


def _path(tokens: pd.Series, tables: pd.Series) -> pd.DataFrame:
    out = []
    for t, blocks in zip(tokens, tables, strict=True):
        cost, audit = chained([[None if x is None else (x["cost"], x["audit"]) for x in b] for b in blocks])
        steps = plan(t, audit)
        out.append((cost, audit, [a for a, _ in steps], [r for _, r in steps]))
    return pd.DataFrame(out, columns=["cost", "audit", "places", "roles"])


def damaged(turns: DataFrame) -> DataFrame:
    """The rows after damage by crc32 of conv_id:turn, each with `copies`; a dropped row leaves an empty one with 0 copies."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    d = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    gone = F.col("kind") == 0
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return d.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").otherwise(role).alias("role"), F.when(gone, "").otherwise(text).alias("text"), F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _judged(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text) with their faults, tokens and initials."""
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    said = F.unhex(F.sha2(F.concat_ws(":", conv, F.length("role").cast("string"), "role", "text"), 256))
    once = scratch.written(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("said", said), "turns")
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = once.filter("copies > 0").groupBy("said").agg(F.min(at).alias("first"), F.count("*").alias("c")).filter("c > 1").select("said", "first")
    # What is said in several turns is written first, so that the join can be split where one text is said very often.
    d = once.join(scratch.written(again, "said_again"), "said", "left")
    later = F.coalesce(at > F.col("first"), F.lit(False))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    d = d.withColumns({"blank_row": blank, "live": ~blank & ~later & (F.col("copies") > 0)})
    d = d.withColumn("cut", F.col("live") & ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    more = F.col("copies") - F.col("live").cast("long")
    token = F.concat(F.when(F.col("cut"), F.upper(initial)).when(F.col("live"), initial).otherwise(""), F.repeat(F.lit("x"), more.cast("int")))
    return d.select(
        "conv_id", "turn", "role", "said", "live", F.when(F.col("live"), F.col("text")).otherwise("").alias("text"), token.alias("token"), F.repeat(initial, F.col("copies").cast("int")).alias("initials"),
        F.when(F.col("blank_row"), F.col("copies")).otherwise(0).alias("blank"), F.when(F.col("blank_row"), 0).otherwise(more).alias("duplicate"), F.col("cut").cast("long").alias("truncated"), F.col("copies"),
    )


def _blocks(rows: DataFrame) -> DataFrame:
    """At most BLOCK neighbouring rows of a conversation, with the table of their cheapest edits."""
    order = ["conv_id", "turn", "role", "said"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK))
    one = F.struct("turn", "role", "said", "token", "initials", "live", "text")
    totals = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    b = placed.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(one)).alias("rows"), F.countDistinct(F.when(F.col("copies") > 0, F.col("turn"))).alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"), *totals)
    joined = lambda c: F.array_join(F.transform("rows", lambda x: x[c]), "")
    live = F.transform(F.filter("rows", lambda x: x.live), lambda x: F.struct(x.role.alias("role"), x.text.alias("text")))
    b = b.select("conv_id", "block", joined("token").alias("tokens"), joined("initials").alias("initials"), live.alias("live"), "turns", "low", "high", "blank", "duplicate", "truncated")
    return b.withColumn("table", F.pandas_udf(_tables, "array<struct<cost:long,audit:string>>")("tokens"))


def repaired(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text and copies. Per conversation: gaps, counts of faults, cost, audit and turns, the repaired (role, text)."""
    scratch = Scratch(rows.sparkSession)
    b = _blocks(scratch.written(_judged(rows, scratch), "judged"))
    b = scratch.written(b, "blocks")
    part = F.struct("block", "tokens", "initials", "live", "turns", "low", "high", "table")
    c = b.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", part.alias("b")))).alias("blocks"), *(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "turns")), F.min("low").alias("low"), F.max("high").alias("high"))
    # Two blocks may hold rows of one turn.
    shared = F.size(F.filter(F.zip_with(F.slice("blocks", 1, F.greatest(F.size("blocks") - 1, F.lit(0))), F.slice("blocks", 2, F.size("blocks")), lambda x, y: x.b.high == y.b.low), lambda same: F.coalesce(same, F.lit(False))))
    whole = lambda c: F.transform("blocks", lambda x: x.b[c])
    c = c.select("conv_id", "blank", "duplicate", "truncated", F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("turns") - shared), F.lit(0)).alias("gaps"), F.array_join(whole("tokens"), "").alias("tokens"), F.array_join(whole("initials"), "").alias("initials"), F.flatten(whole("live")).alias("live"), whole("table").alias("tables"))
    c = c.withColumn("path", F.pandas_udf(_path, "cost long, audit string, places array<int>, roles array<string>")("tokens", "tables"))

    def turn(place: Column, role: Column) -> Column:
        own = F.try_element_at("live", place + 1)
        return F.struct(F.coalesce(role, F.when(place >= 0, own.role)).alias("role"), F.when(place >= 0, own.text).otherwise("").alias("text"))

    # element 0 is never asked for: an inserted row has place -1 and no own row.
    places = F.transform("path.places", lambda p: F.when(p < 0, -2).otherwise(p))
    legal = sum(((F.length("initials") - F.length(F.replace(F.col("initials"), F.lit(x)))) / 2 for x in ("su", "ua", "au")), F.lit(0.0))
    illegal = F.when(F.length("initials") > 0, F.length("initials") - 1 - legal).otherwise(0).cast("long")
    c = c.select("conv_id", "gaps", "blank", "duplicate", "truncated", illegal.alias("illegal"), "path.cost", "path.audit", F.zip_with(places, "path.roles", turn).alias("turns"))
    result = written(c, "repaired")
    scratch.drop()
    return result


def digests(rows: DataFrame) -> DataFrame:
    d = repaired(rows)
    text = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit(":"), x.text)), "\n")
    return d.select(*(c for c in d.columns if c != "turns"), F.sha2(text, 256).alias("repaired_sha256"))
