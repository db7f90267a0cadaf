r"""Chat formatting with a grammar round trip (DataFrame and SQL functions only).

A turn is rendered as `<s>[ROLE]role[INST]text[/INST]</s>` on a line of its own. In a turn that
holds a control string `\` becomes `\b`, `<` becomes `\l` and `[` becomes `\q`, and `<s>[ESC]` in
place of `<s>[ROLE]` says so; reading back needs nothing but the output. The rendered
conversation is reparsed by a deterministic parser (split at the end mark, then at the first
text mark); where a recovered turn differs from its source, the conversation is rendered again
with every turn escaped. No control string survives that; a difference left raises an error.

Turns are first gathered into blocks of `BLOCK` turn numbers and only then into conversations, so that a conversation of many turns meets in one row as few blocks.

Edge cases: a null text or role is empty; turns that tie are ordered by role, then text; equal
rows are turns of their own; a null conv_id is a conversation of its own, a null turn comes
first; an empty table gives no conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
CONTROL = r"<s>|</s>|\[ROLE\]|\[ESC\]|\[INST\]|\[/INST\]|\\[blq]"
ROLE, ESC, TEXT, END, CLOSE = "<s>[ROLE]", "<s>[ESC]", "[INST]", "[/INST]", "</s>"
#: Fixed by the contract: the conversation that the query adds.
EXTRA = ((-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"))


def escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\q"))


def unescaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\q"), F.lit("[")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def parsed(output: Column) -> Column:
    """The turns of a rendered conversation, an array of (role, text)."""
    ends = F.split(output, r"\Q" + END + CLOSE + "\n" + r"\E")

    def turn(x: Column) -> Column:
        strong = x.startswith(ESC)
        body = F.when(strong, F.substr(x, F.lit(len(ESC) + 1))).otherwise(F.substr(x, F.lit(len(ROLE) + 1)))
        cut = F.instr(body, TEXT)
        role, text = F.substr(body, F.lit(1), cut - 1), F.substr(body, cut + len(TEXT))
        return F.struct(F.when(strong, unescaped(role)).otherwise(role).alias("role"), F.when(strong, unescaped(text)).otherwise(text).alias("text"))

    return F.transform(F.slice(ends, 1, F.size(ends) - 1), turn)


def _gathered(turns: DataFrame) -> DataFrame:
    """conv_id, source and the rendering at each level; first by blocks, then whole."""
    place = F.struct("turn", "role", "text")
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    block = t.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(place)).alias("turns"))
    whole = block.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "turns"))).alias("blocks"))
    return whole.select("conv_id", F.flatten(F.transform("blocks", lambda b: F.transform(b.turns, lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))))).alias("source"))


def _rendered(everywhere: bool) -> Column:
    def one(x: Column) -> Column:
        plain = F.concat(F.lit(ROLE), x.role, F.lit(TEXT), x.text, F.lit(END + CLOSE + "\n"))
        strong = F.concat(F.lit(ESC), escaped(x.role), F.lit(TEXT), escaped(x.text), F.lit(END + CLOSE + "\n"))
        return strong if everywhere else F.when(F.concat(x.role, F.lit(" "), x.text).rlike(CONTROL), strong).otherwise(plain)

    return F.array_join(F.transform("source", one), "")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, source, output, everywhere (all turns escaped) and turns, read back from output and equal to source."""
    d = _gathered(turns).withColumn("output", _rendered(False))
    d = d.withColumn("turns", parsed(F.col("output"))).withColumn("everywhere", F.col("turns") != F.col("source"))
    d = d.withColumn("output", F.when(F.col("everywhere"), _rendered(True)).otherwise(F.col("output")))
    d = d.withColumn("turns", F.when(F.col("everywhere"), parsed(F.col("output"))).otherwise(F.col("turns")))
    return d.withColumn("turns", F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(F.raise_error(F.lit("a rendered conversation doesn't read back")).cast(d.schema["turns"].dataType)))


def digests(turns: DataFrame) -> DataFrame:
    """What the output reads back as: counts and digests of all turns and of the loss mask."""
    d = formatted(turns)
    said = F.array_join(F.transform(F.filter("turns", lambda x: x.role == "assistant"), lambda x: x.text), "")
    d = d.select("conv_id", "turns", "output", said.alias("loss"))
    return d.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("output").cast("long").alias("formatted_chars"),
    )


def with_extra(turns: DataFrame) -> DataFrame:
    names = ("conv_id", "turn", "role", "text")
    rows = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(names, r, strict=True))) for r in EXTRA))
    extra = turns.sparkSession.range(1).select(F.inline(rows))
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)
