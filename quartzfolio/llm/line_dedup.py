"""Line dedup by content-defined chunks of lines (DataFrame and SQL functions only).

A hash rolls over the lines of a text (empty ones between them only counted): at every line it
covers the fewest lines from there on with `CHUNK` words. Where it is least among all that lie in
the next `PASSAGE` words, a chunk is cut out there. The choice hangs on those words alone,
whatever stands around them, so that two copies of a passage of `PASSAGE` words or more choose
the same chunk. A line of `CHUNK` words or more bounds the chunks beside it and is one itself.

A chunk that occurs again goes wherever it isn't its first occurrence (by doc_id, then position),
and with it the lines on both sides that equal, one by one, those beside that one first occurrence:
up to `PASSAGE` words, behind which another chunk follows. So what goes at a chunk
stood in one piece before. Neighbouring chunks may have their first occurrences in different documents.

Words are parted by white space; in lines with more than `WIDE` characters to a word, or two
bytes to a character, each character of a script without blanks (Chinese, Japanese, Thai, Lao, Khmer, Burmese) is a word.
A line of white space alone counts as a word.

Chunks are found by their hashes, which hold what stands beside them; the texts are shuffled once, to meet
the numbers of their repeated chunks. The lines of these chunks and beside them are then compared
byte for byte under their hashes, and the chunks line by line: should two different ones share a
64-bit hash, all is done again under another seed. A hot chunk is pre-aggregated to a count and
a first occurrence. These are written before they are joined back, so that the join has
shuffles of its own, which adaptive execution splits where a key is hot. What was written on
the way goes once the marked documents are written.

Edge cases: a null text has no lines and stays null, an empty one has one empty line; a text
whose chunks are all removed becomes empty; empty lines go where both neighbours go; equal rows
(same doc_id and text) count as one occurrence and stay alike; a null doc_id sorts first; an
empty table gives no rows; other columns are kept as they are, whatever their names (`rows`; the
counters that `deduplicated` adds may repeat a name of docs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, written

CHUNK, PASSAGE, WIDE = 30, 50, 20
NO_ID = -(2**63)
#: The hash of a line or of a chunk, x, under a seed.
HASH = "xxhash64({x}, {seed})"
_WORD = SPACE.replace("[", "[^").replace("\\", "\\\\") + "+"
_UNPARTED = "[" + "".join(f"\\\\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")) + "]"


def _words(x: str) -> str:
    """SQL for the number of words of a line that isn't empty; the pattern only where blanks aren't single ones."""
    odd = f"contains({x}, '  ') OR contains({x}, '\\t') OR contains({x}, '\\r') OR startswith({x}, ' ') OR endswith({x}, ' ')"
    parted = f"CASE WHEN {odd} THEN regexp_count({x}, '{_WORD}') ELSE 1 + length({x}) - length(replace({x}, ' ', '')) END"
    unparted = f"length({x}) - length(regexp_replace({x}, '{_UNPARTED}', ''))"
    wide = f"length({x}) > {WIDE} * (1 + length({x}) - length(replace({x}, ' ', ''))) OR octet_length({x}) > 2 * length({x})"
    return f"CASE WHEN {wide} THEN greatest({parted}, {unparted}) ELSE {parted} END"


def _lined(docs: DataFrame, seed: int, where: str = "true") -> DataFrame:
    """Adds to a doc_id its key and, where asked for, _lines: (x, i, h, n) of the lines that aren't empty."""
    filled = "filter(transform(split(text, '\\n'), (x, i) -> struct(x AS x, i AS i)), u -> u.x != '')"
    n = f"greatest(1, {_words('u.x')})"
    return docs.select(
        "*",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64("doc_id", "text").alias("_key"),
        F.expr(f"CASE WHEN {where} THEN transform({filled}, u -> struct(u.x AS x, u.i AS i, {HASH.format(x='u.x', seed=seed)} AS h, {n} AS n)) END").alias("_lines"),
    )


def _near(words: str) -> str:
    """SQL for how many of these lines' words make up `PASSAGE` words, at most to a long line."""
    more = "struct(a.s + n AS s, a.k + 1 AS k)"
    return f"aggregate({words}, struct(0 AS s, 0 AS k), (a, n) -> CASE WHEN a.s >= {PASSAGE} THEN a WHEN n < 0 THEN struct({PASSAGE} AS s, a.k AS k) ELSE {more} END).k"


def _chunks(docs: DataFrame, seed: int) -> DataFrame:
    """_id, _key and the chunks of every text: k the first line, n lines, h; left and right, (h, g) of the lines beside.

    g is the number of line ends between a line and the next one of the chunk's side.
    """
    d = _lined(docs, seed).select("_id", "_key", F.expr("transform(_lines, u -> struct(u.i AS i, u.h AS h, u.n AS n))").alias("_lines"))
    # A long line is a sum that no chunk and no passage gets over.
    d = d.withColumn("_n", F.expr(f"transform(_lines, u -> IF(u.n >= {CHUNK}, -1000000, u.n))"))
    d = d.withColumn("_g", F.expr("transform(_lines, (u, p) -> struct(u.h AS h, u.i - coalesce(get(_lines, p - 1).i, 0) AS g))"))
    fold = f"(a, n) -> IF(a.s >= {PASSAGE} OR a.s < 0, a, struct(a.s + n AS s, a.c + IF(a.s < {CHUNK}, 1, 0) AS c, a.p + 1 AS p, IF(a.s < {CHUNK}, a.s + n, a.t) AS t))"
    span = f"aggregate(slice(_n, p + 1, {PASSAGE}), struct(0 AS s, 0 AS c, 0 AS p, 0 AS t), {fold})"
    # c lines hold CHUNK words, p lines PASSAGE words; 0 where a long line or the end comes before.
    d = d.withColumn("_spans", F.expr(f"transform(_n, (n, p) -> IF(n < 0, struct(1 AS c, 0 AS p), transform(array({span}), a -> struct(IF(a.t >= {CHUNK}, a.c, 0) AS c, IF(a.s >= {PASSAGE}, a.p, 0) AS p))[0]))"))
    rolled = HASH.format(x="_g[p].h, slice(_g, p + 2, s.c - 1)", seed=seed)
    d = d.withColumn("_rolled", F.expr(f"transform(_spans, (s, p) -> IF(s.c > 0, struct({rolled} AS h, p AS k, s.c AS n), NULL))"))
    least = "array_min(filter(slice(_rolled, p + 1, s.p), r -> r.k + r.n <= p + s.p))"
    chosen = f"array_distinct(filter(transform(_spans, (s, p) -> IF(_n[p] < 0, _rolled[p], IF(s.p > 0, {least}, NULL))), r -> r IS NOT NULL))"
    before = f"reverse(slice(_n, greatest(r.k - {PASSAGE}, 0) + 1, least(r.k, {PASSAGE})))"
    left = f"transform(slice(_lines, r.k - l + 1, l), (u, j) -> struct(u.h AS h, _lines[r.k - l + j + 1].i - u.i AS g))"
    left = f"reverse(transform(array({_near(before)}), l -> {left})[0])"
    right = f"slice(_g, r.k + r.n + 1, {_near(f'slice(_n, r.k + r.n + 1, {PASSAGE})')})"
    sides = f"transform({chosen}, r -> struct(r.k AS k, r.n AS n, r.h AS h, {left} AS left, {right} AS right))"
    return d.select("_id", "_key", F.explode(F.expr(sides)).alias("c")).select("_id", "_key", "c.*")


def _equal(side: str) -> str:
    """SQL for the number of lines on a side that are those of the first occurrence."""
    return f"coalesce(nullif(array_position(zip_with({side}, first.{side}, (a, b) -> a <=> b), false), 0) - 1, size({side}))"


def _hits(docs: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """_hid, _hkey and hits of a document: chunks that occur again, (k, n, h), (s, e) with the lines that are equal, and whether it is the first."""
    every = scratch.written(_chunks(docs.select("doc_id", "text"), seed), "line_chunks")
    repeated = every.groupBy("h").agg(F.count("*").alias("m"), F.min(F.struct("_id", "_key", "k", "left", "right")).alias("first")).filter("m > 1").select("h", "first")
    repeated = scratch.written(repeated, "repeated_chunks")
    # The first occurrence names all lines beside it, as any of them may have been compared.
    spans = f"CAST(k - {_equal('left')} AS INT) AS s, CAST(k + n - 1 + {_equal('right')} AS INT) AS e"
    hit = every.join(repeated, "h").select(F.col("_id").alias("_hid"), F.col("_key").alias("_hkey"), F.expr(f"struct(k, n, h, {spans}, struct(_id, _key, k) = struct(first._id, first._key, first.k) AS first)").alias("hit"))
    return hit.groupBy("_hid", "_hkey").agg(F.collect_set("hit").alias("hits"))


def _collide(marked: DataFrame, seed: int) -> bool:
    """Byte comparison: whether lines of repeated chunks and beside them, or these chunks, share a hash and differ."""
    lined = _lined(marked.filter("hits IS NOT NULL"), seed)
    used = "array_distinct(flatten(transform(hits, x -> sequence(x.s, x.e))))"
    lines = f"transform({used}, p -> struct(_lines[p].h AS h, _lines[p].x AS x))"
    spelt = "concat_ws(' ', transform(slice(_lines, x.k + 1, x.n), u -> concat(u.h, ':', u.i - _lines[x.k].i)))"
    found = lined.select(F.explode(F.expr(f"concat({lines}, transform(hits, x -> struct(x.h AS h, {spelt} AS x)))")).alias("c")).select("c.*")
    return not found.groupBy("h").agg(F.min("x").alias("low"), F.max("x").alias("high")).filter("low != high").isEmpty()


def _blocks(ks: str) -> str:
    """SQL for the (s, e) of neighbouring numbers in an ascending array."""
    first = f"filter({ks}, (p, j) -> j = 0 OR get({ks}, j - 1) != p - 1)"
    last = f"filter({ks}, (p, j) -> j = size({ks}) - 1 OR get({ks}, j + 1) != p + 1)"
    return f"zip_with({first}, {last}, (s, e) -> struct(s AS s, e AS e))"


def rows(docs: DataFrame, seed: int = 0) -> DataFrame:
    """row, the columns of docs as a struct with repeated chunks cut from its text, and n_lines, n_removed_lines, n_removed_chunks."""
    named = [F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").cast("string").alias("text")]
    whole = docs.select(F.struct("*").alias("_row")).select("_row", *named).withColumns({"_i": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_k": F.xxhash64("doc_id", "text")})
    scratch = Scratch(docs.sparkSession)
    hits = _hits(whole.select("doc_id", "text"), seed, scratch)
    marked = written(whole.drop("doc_id", "text").join(hits, F.expr("_i = _hid AND _k = _hkey"), "left").select("_row", "hits"), "line_dedup").select(*named, "_row", "hits")
    scratch.drop()
    if _collide(marked, seed):
        return rows(docs, seed + 1)
    d = _lined(marked, seed, "exists(hits, x -> NOT x.first)")
    d = d.withColumn("_gone", F.expr("IF(_lines IS NULL, NULL, array_sort(array_distinct(flatten(transform(filter(hits, x -> NOT x.first), x -> sequence(x.s, x.e))))))"))
    d = d.withColumn("_cuts", F.expr(f"transform({_blocks('_gone')}, b -> struct(_lines[b.s].i AS s, _lines[b.e].i AS e))"))
    d = d.withColumn("_all", F.expr("IF(size(_cuts) > 0, split(text, '\\n'), NULL)"))
    between = "transform(concat(_cuts, array(struct(size(_all) AS s, size(_all) AS e))), (c, k) -> slice(_all, IF(k = 0, 0, get(_cuts, k - 1).e + 1) + 1, c.s - IF(k = 0, 0, get(_cuts, k - 1).e + 1)))"
    return d.select(
        F.col("_row").withField("text", F.expr(f"CASE WHEN _all IS NOT NULL THEN array_join(flatten({between}), '\\n') ELSE text END")).alias("row"),
        F.expr("1L + length(text) - length(replace(text, '\n', ''))").alias("n_lines"),
        F.expr("CASE WHEN _all IS NOT NULL THEN aggregate(_cuts, 0L, (a, c) -> a + c.e - c.s + 1) ELSE 0L END").alias("n_removed_lines"),
        F.expr("CASE WHEN _all IS NOT NULL THEN CAST(size(_cuts) AS BIGINT) ELSE 0L END").alias("n_removed_chunks"),
    )


def deduplicated(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of docs with repeated chunks cut from text, and _n_lines, _n_removed_lines, _n_removed_chunks."""
    return rows(docs, seed).select("row.*", *(F.col(c).alias(f"_{c}") for c in ("n_lines", "n_removed_lines", "n_removed_chunks")))
