"""Byte-level BPE encoding and decoding by DuckDB's recursive queries, per partition.

A task splits its texts by the tokenizer's pattern and encodes each distinct piece once. A step of
the recursive query joins the token-position rows of each piece with the merge table and
contracts its leftmost pair of minimum rank, until no pair is left that merges. Pieces of more than
`SHORT` bytes contract in one step all pairs of that rank that don't overlap, in a run every
second one from the left (they would be next, since a pair that a contraction forms has a higher
rank), for `STEPS` steps a query; those not at their fixpoint by then go into the next one. Ids are decoded
by a join with the vocabulary and an aggregation ordered by position, each distinct piece
once; a document's bytes are those of its pieces' ids in order.

The merge table holds every split of a token into two tokens; its rank is the token's own.
Vocabulary and pattern are parameters: a path that executors can read, never copied.

Memory is bounded by `BATCH_CHARS` of text, `PIECES` distinct pieces per query and `CACHE` pieces
that a Python worker remembers; what a lot leaves free goes back to the system. A task that is lost is run again from its input rows.

Edge cases: a null or empty text has no tokens; control and special strings are ordinary text;
equal rows are encoded each; a null doc_id stays null; an empty table gives no rows; a piece of
any length is encoded whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Memo, batches, give_back

BATCH_CHARS, PIECES, CACHE, STEPS, SHORT = 600_000, 12_500, 1_500_000, 64, 256
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

ENCODE = f"""
WITH RECURSIVE step(piece, pos, tok, it) AS (
    SELECT piece, pos, tok, 0 FROM start
  UNION ALL
    SELECT piece, pos, CASE WHEN joins THEN rank ELSE tok END, it + 1 FROM (
        SELECT *, coalesce(lag(joins) OVER w, false) AS gone FROM (
            SELECT *, coalesce(least AND (no - max(CASE WHEN NOT least THEN no ELSE 0 END) OVER (PARTITION BY piece ORDER BY pos ROWS UNBOUNDED PRECEDING)) % 2 = 1, false) AS joins FROM (
                SELECT *, coalesce(rank = min(rank) OVER (PARTITION BY piece), false) AS least, min(rank) OVER (PARTITION BY piece) IS NOT NULL AS moves, row_number() OVER w AS no FROM (
                    SELECT p.*, m.rank FROM (SELECT *, lead(tok) OVER w AS following FROM step WHERE it < {STEPS} WINDOW w AS (PARTITION BY piece ORDER BY pos)) p LEFT JOIN merges m ON p.tok = m.a AND p.following = m.b)
                WINDOW w AS (PARTITION BY piece ORDER BY pos))
            WHERE moves)
        WINDOW w AS (PARTITION BY piece ORDER BY pos))
    WHERE NOT gone
)
SELECT piece, max(it) AS it, list(tok ORDER BY pos) AS ids FROM (SELECT *, max(it) OVER (PARTITION BY piece) AS last FROM step) WHERE it = last GROUP BY piece
"""
#: For pieces of up to SHORT bytes: a row holds the tokens in order, which are unnested to be joined.
ENCODE_SHORT = """
WITH RECURSIVE step(piece, tokens) AS (
    SELECT piece, tokens FROM start
  UNION ALL
    SELECT s.piece, list_concat(list_concat(s.tokens[1:best.pos - 1], [best.rank]), s.tokens[best.pos + 2:])
    FROM step s JOIN (
        SELECT piece, min(rank) AS rank, (min(rank::BIGINT * 65536 + pos) % 65536)::INT AS pos
        FROM (SELECT piece, unnest(tokens[1:len(tokens) - 1]) AS a, unnest(tokens[2:]) AS b, unnest(range(1, len(tokens)))::INT AS pos FROM step) pairs
        JOIN merges USING (a, b) GROUP BY piece) best USING (piece)
)
SELECT piece, arg_min(tokens, len(tokens)) AS ids FROM step GROUP BY piece
"""
DECODE = "SELECT doc, from_hex(string_agg(hex, '' ORDER BY pos)) AS bytes FROM tokens JOIN vocabulary USING (id) GROUP BY doc"


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    """A DuckDB connection with the merge table and vocabulary of one rank file."""

    def __init__(self, path: str) -> None:
        import duckdb

        self.of = ranks(path)
        merges = [(self.of[t[:i]], self.of[t[i:]], r) for t, r in self.of.items() for i in range(1, len(t)) if t[:i] in self.of and t[i:] in self.of]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self._table("merges", pd.DataFrame(merges, columns=["a", "b", "rank"]).astype("int32"))
        self._table("vocabulary", pd.DataFrame({"id": list(self.of.values()), "hex": [t.hex() for t in self.of]}).astype({"id": "int32"}))
        self.byte = np.array([self.of[bytes([b])] for b in range(256)], np.int32)

    def _table(self, name: str, frame: pd.DataFrame) -> None:
        self.db.register("frame", frame)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM frame")
        self.db.unregister("frame")

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, ...]:
        """Sizes and ids of distinct pieces, then sizes and bytes of what these ids decode to."""
        out: list = [None] * len(pieces)
        for at in range(0, len(pieces), PIECES):
            tokens = {k: self.byte[np.frombuffer(p.encode("utf-8", "surrogatepass"), np.uint8)] for k, p in enumerate(pieces[at : at + PIECES])}
            for k, ids in self._short({k: x for k, x in tokens.items() if len(x) <= SHORT}):
                out[at + k] = ids
            todo = {k: x for k, x in tokens.items() if len(x) > SHORT}
            while todo:
                again = {}
                for k, it, ids in self._steps(todo):
                    if it == STEPS:
                        again[k] = ids
                    else:
                        out[at + k] = ids
                todo = again
        size = np.fromiter(map(len, out), np.int64, len(out))
        ids = np.concatenate([*out, np.zeros(0, np.int32)]).astype("<u4")
        text = self.decode(np.split(ids, np.cumsum(size)[:-1]) if out else [])
        return size, ids, np.fromiter(map(len, text), np.int64, len(text)), np.frombuffer(b"".join(text), np.uint8)

    def _short(self, tokens: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        import pyarrow as pa

        size = np.fromiter(map(len, tokens.values()), np.int64, len(tokens))
        flat = np.concatenate([*tokens.values(), np.zeros(0, np.int32)])
        start = pa.table({"piece": pa.array(np.fromiter(tokens, np.int32, len(tokens))), "tokens": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat))})
        self.db.register("start", start)
        found = self.db.sql(ENCODE_SHORT).to_arrow_table()
        self.db.unregister("start")
        lists = found["ids"].combine_chunks()
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for k, piece in enumerate(found["piece"].to_pylist()):
            yield piece, flat[ends[k] : ends[k + 1]]

    def _steps(self, tokens: dict[int, np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        size = np.fromiter(map(len, tokens.values()), np.int64, len(tokens))
        start = pd.DataFrame({"piece": np.repeat(np.fromiter(tokens, np.int32, len(tokens)), size), "pos": (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32), "tok": np.concatenate(list(tokens.values())).astype(np.int32)})
        self.db.register("start", start)
        found = self.db.sql(ENCODE).to_arrow_table()
        self.db.unregister("start")
        lists = found["ids"].combine_chunks()
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for k, (piece, it) in enumerate(zip(found["piece"].to_pylist(), found["it"].to_pylist(), strict=True)):
            yield piece, it, flat[ends[k] : ends[k + 1]]

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        out = [b""] * len(lists)
        for at in range(0, len(lists), PIECES):
            part = lists[at : at + PIECES]
            size = np.fromiter(map(len, part), np.int64, len(part))
            tokens = pd.DataFrame({"doc": np.repeat(np.arange(len(part), dtype=np.int32), size), "pos": (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32), "id": np.concatenate(part).astype(np.int32)})
            self.db.register("tokens", tokens)
            found = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("tokens")
            for k, x in zip(found["doc"].to_pylist(), found["bytes"].to_pylist(), strict=True):
                out[at + k] = x
        return out


_MEMOS: dict[tuple[str, str], Memo] = {}


def _memo(path: str, pattern: str) -> Memo:
    """One for each Python worker, kept over its tasks."""
    if (path, pattern) not in _MEMOS:
        _MEMOS[path, pattern] = Memo(pattern, Coder(path).learn, CACHE)
    return _MEMOS[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, the digest of its ids and that of the decoded bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _memo(path, pattern)
        for ids, texts in batches(frames, BATCH_CHARS):
            codes, decoded = memo(texts)
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_tokens": list(map(len, codes)), "ids_sha256": [hashlib.sha256(c.tobytes()).hexdigest() for c in codes], "decoded_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in decoded]})
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, SCHEMA)


def tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids, the token ids of every document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _memo(path, pattern)
        for ids, texts in batches(frames, BATCH_CHARS):
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "ids": [c.astype(np.int32) for c in memo(texts)[0]]})
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, ids array<int>")
