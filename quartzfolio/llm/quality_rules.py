"""Quality rules as a short-circuit cascade (DataFrame and SQL functions only).

A rule is a rejecting predicate over the text and over measures of it, such as the number of words.
`cascade` runs every rule by itself on a bounded sample of raw texts, in one job, which gives its share of
rejections and its cost, and orders the rules by rejection per cost. A cost is counted, not timed:
the characters of the texts that reach a measure of the rule, each with the measure's `WORK`. Equal
samples so give equal orders, whatever else the machines do; the clock over 1,000 rows mostly tells of jobs. `passing`
writes them as one nested CASE in that order: a measure is computed where the first rule that
needs it is reached, so a text that a rule rejects costs nothing beyond that rule. The order
never changes a verdict, only the work. `judged` returns all measures of the contract, so there only
the rules that need none of them are left to be saved.

The sample is chosen by a hash of doc_id and text, about `SAMPLE_ROWS` rows of the whole table and
twice that at most.

Edge cases: a null or empty text has no words, so `few_words` rejects it; rows that repeat
are judged each for itself; a null doc_id stays null; an empty table gives no rows; other
columns of the input are kept by `passing`, whatever their names, and ignored by `judged`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, parsed_aside, whole_rows

#: Rows of the sample on which cost and selectivity are estimated; verdicts don't depend on it.
SAMPLE_ROWS = 1000


def _let(name: str, value: str, body: str) -> str:
    """SQL for body with name bound to value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _replaced(text: str, chars: list[str], by: str) -> str:
    """SQL for text with each of these ASCII characters replaced: plain searches, no pattern."""
    for c in chars:
        text = f"replace({text}, '{c}', '{by}')"
    return text


#: Fixed: the white space that ends a word, and the symbols.
_SPACES, _SYMBOLS = [" ", *(chr(c) for c in range(0x09, 0x0E))], list("#*$%&|<>")
_HASHES = "transform(IF(size(words) < 3, array(), sequence(0, size(words) - 3)), i -> xxhash64(words[i], words[i + 1], words[i + 2]))"


#: Bits of a sorted number that hold the place of a window, below those of its hash.
_PLACE = 20


def _repeated_words() -> str:
    """SQL for the words in 3-word windows that are found twice or more.

    Hashes of windows are sorted with their places; neighbours whose hashes meet are compared word by
    word. Should two differ there, or the text be too long for the places, the windows
    themselves are sorted. The words that repeated windows cover are summed over their ascending starts.
    """
    covered = "aggregate(starts, struct(0L AS n, -3 AS last), (a, s) -> struct(a.n + least(3, s - a.last) AS n, s AS last), a -> a.n)"
    place = f"CAST(sorted[{{}}] & {(1 << _PLACE) - 1}L AS INT)".format
    meets = f"shiftrightunsigned(sorted[{{0}} - 1] ^ sorted[{{0}}], {_PLACE}) = 0".format
    differ = " OR ".join(f"words[{place('k - 1')} + {j}] != words[{place('k')} + {j}]" for j in range(3))
    either = f"k > 0 AND {meets('k')} OR k < size(sorted) - 1 AND {meets('(k + 1)')}"
    hashed = _let("starts", f"sort_array(transform(filter(sequence(0, size(sorted) - 1), k -> {either}), k -> {place('k')}))", covered)
    equal = "k > 0 AND texts[k - 1].x = t.x OR k < size(texts) - 1 AND texts[k + 1].x = t.x"
    texts = "sort_array(transform(sequence(0, size(words) - 3), i -> struct(concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS x, i AS i)))"
    exact = _let("texts", texts, _let("starts", f"sort_array(transform(filter(texts, (t, k) -> {equal}), t -> t.i))", covered))
    either = f"CASE WHEN exists(sequence(1, size(sorted) - 1), k -> {meets('k')} AND ({differ})) THEN {exact} ELSE {hashed} END"
    short = _let("sorted", f"sort_array(transform(windows, (h, i) -> (h & {-(1 << _PLACE)}L) | i))", either)
    return f"CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0L WHEN size(words) >= {1 << _PLACE} THEN {exact} ELSE {short} END"


#: SQL of each measure over text and the measures before it that it names.
MEASURES = {
    "words": f"array_remove(split({_replaced('text', _SPACES[1:], ' ')}, ' '), '')",
    "n_words": "CAST(size(words) AS BIGINT)",
    "word_chars": f"CAST(length({_replaced('text', _SPACES, '')}) AS BIGINT)",
    "n_symbols": f"CAST(octet_length(text) - octet_length({_replaced('text', _SYMBOLS, '')}) AS BIGINT)",
    "n_dup_lines": _let("lines", "filter(split(text, '\\n'), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')", "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)"),
    "n_repeat_words": _repeated_words(),
    "windows": _HASHES,
    # Windows less distinct ones, and windows that occur twice or more; hashes that meet by chance only make them larger.
    "n_repeats": "CAST(size(windows) - size(array_distinct(windows)) AS BIGINT)",
    "n_repeated": _let("hashed", "sort_array(windows)", "CAST(size(filter(hashed, (h, k) -> k > 0 AND hashed[k - 1] = h OR k < size(hashed) - 1 AND hashed[k + 1] = h)) AS BIGINT)"),
}
NEEDS = {"n_words": ("words",), "windows": ("words",), "n_repeats": ("words", "windows"), "n_repeated": ("words", "windows"), "n_repeat_words": ("words", "windows")}
#: Nanoseconds that a measure takes for a character of text beyond those it needs, on 100 million characters of documents.
WORK = {"words": 100, "word_chars": 90, "n_symbols": 80, "n_dup_lines": 30, "windows": 80, "n_repeats": 30, "n_repeated": 60, "n_repeat_words": 250}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects where `fails` holds, SQL over text and the measures that it names in `uses`.

    `unless` has cheaper conditions, each with its measures, under which `fails` can't hold;
    `work` is what `fails` itself takes for a character, in the unit of `WORK`.
    """

    name: str
    fails: str
    uses: tuple[str, ...] = ()
    unless: tuple[tuple[str, tuple[str, ...]], ...] = ()
    work: int = 1


#: The first two are the base rules of the contract; the others are the method's.
RULES = (
    Rule("few_words", "n_words < 50", ("n_words",)),
    # A repeated window covers 3 words at most, and k windows more than distinct ones are at most 2 k repeated windows.
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words", ("n_words", "n_repeat_words"), (("12 * n_repeats <= n_words", ("n_words", "n_repeats")), ("6 * n_repeated <= n_words", ("n_words", "n_repeated")))),
    Rule("duplicate_lines", "2 * n_dup_lines > size(split(text, '\n'))", ("n_dup_lines",)),
    Rule("symbols", "4 * n_symbols > n_words", ("n_symbols", "n_words"), (("n_symbols <= 20", ("n_symbols",)),)),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words", ("n_words", "word_chars")),
    Rule("capitals", "2 * length(regexp_replace(text, '[^A-Z]+', '')) > length(text)", work=30),
    Rule("exclamations", "10 * (octet_length(text) - octet_length(replace(text, '!', ''))) > length(text)", work=5),
)
BASE = ("few_words", "repeated_words")


def _bound(body: str, names: tuple[str, ...], known: tuple[str, ...]) -> str:
    """SQL for body with the measures bound that it names and that aren't known yet."""
    for name in reversed(_wanted(names, known)):
        body = _let(name, MEASURES[name], body)
    return body


def _wanted(names: tuple[str, ...], known: tuple[str, ...]) -> list[str]:
    every = dict.fromkeys(x for n in names if n not in known for x in (*NEEDS.get(n, ()), n))
    return [n for n in every if n not in known]


def _fails(rule: Rule, known: tuple[str, ...]) -> str:
    """SQL for whether a rule rejects, its cheaper conditions first."""
    body, seen = rule.fails, [known]
    for _, names in rule.unless:
        seen.append((*seen[-1], *_wanted(names, seen[-1])))
    body = _bound(body, rule.uses, seen[-1])
    for (passes, names), before in reversed(list(zip(rule.unless, seen, strict=False))):
        body = _bound(f"CASE WHEN {passes} THEN false ELSE {body} END", names, before)
    return body


def _work(rule: Rule) -> str:
    """SQL for the work of a rule on a text: that of its measures which are reached."""
    units = lambda names, known: sum(WORK.get(m, 0) for m in _wanted(names, known))
    steps, known = [], ()
    for passes, names in (*rule.unless, ("true", rule.uses)):
        steps.append((units(names, known), passes, names))
        known = (*known, *_wanted(names, known))
    body = str(steps[-1][0] + rule.work)
    for n, passes, names in reversed(steps[:-1]):
        body = f"{n} + IF({_bound(passes, names, ())}, 0, {body})"
    return f"CAST(length(text) AS DOUBLE) * ({body})"


def first_failure(ordered: list[Rule], known: tuple[str, ...] = ()) -> str:
    """SQL over text (and known measures) for the first rule that rejects, else null.

    A measure that several rules name is bound at the first of them that is reached, for those after it, too.
    """
    if not ordered:
        return "CAST(NULL AS STRING)"
    rule, rest = ordered[0], ordered[1:]
    shared = tuple(m for m in _wanted(rule.unless[0][1] if rule.unless else rule.uses, known) if any(m in _wanted(r.uses, known) for r in rest))
    seen = (*known, *shared)
    return _bound(f"CASE WHEN {_fails(rule, seen)} THEN '{rule.name}' ELSE {first_failure(rest, seen)} END", shared, known)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, text and the measures of the contract (long). No row leaves its partition."""
    d = id_and_text(docs).withColumn("words", F.expr(MEASURES["words"]))
    return d.select("doc_id", "text", *(F.expr(_bound(c, (c,), ("words",))).alias(c) for c in COUNTS))


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text of about so many rows, chosen by hash."""
    every = max(1, docs.count() // max(rows, 1))
    return id_and_text(docs).filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text").limit(2 * rows)


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejection per cost on raw texts of a sample, ties by name."""
    figures = [(F.count_if(F.expr(first_failure([r]) + " IS NOT NULL")), F.sum(F.expr(_work(r)))) for r in rules]
    sample = sampled(docs, rows).repartition(docs.sparkSession.sparkContext.defaultParallelism)
    with parsed_aside(docs.sparkSession):
        figures = sample.agg(F.count("*"), *(c for pair in figures for c in pair))
    found = figures.first()
    if not found[0]:
        return list(rules)
    worth = {r.name: found[1 + 2 * k] / max(found[2 + 2 * k], 1.0) for k, r in enumerate(rules)}
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts of every document, base_failed, kept and the rule that rejected it."""
    base = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    ordered = [r for r in cascade(docs, rules) if r.name not in BASE]
    with parsed_aside(docs.sparkSession):
        return counts(docs).select("doc_id", *COUNTS, F.expr(base).alias("base_failed"), F.expr(f"CASE WHEN {base} THEN false ELSE {first_failure(ordered, COUNTS)} IS NULL END").alias("kept"))


def kept(ordered: list[Rule]) -> Column:
    """Over text: whether no rule rejects."""
    return F.expr(f"{first_failure(ordered)} IS NULL")


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects."""
    ordered = cascade(docs, rules)
    with parsed_aside(docs.sparkSession):
        return whole_rows(docs).filter(kept(ordered)).select("row.*")
