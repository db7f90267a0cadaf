r"""Personal data by candidate gradient boosting (DataFrame and SQL functions only).

High-recall patterns propose overlapping candidate spans of a whole text. The four base kinds
have validators (parts of an address at most 255, Luhn, number of digits); a candidate that
they accept stays as it is. Every other candidate is scored by boosted trees over its format
and the text next to it, and selected where the score reaches the threshold that was
calibrated for its kind, so that the method only adds spans to the base ones.

The trees are fitted by `fitted` on at most `TRAIN_ROWS` labelled examples. Values come from
`FAMILIES`, some thirty formats with a known label each; what stands next to them is cut from the
corpus (at most `CONTEXTS` places, chosen by hash over all rows), as are the words of the slugs that
serve as negatives. A fifth of the examples is held out for calibration: a kind's threshold lies
in the middle between the lowest score with a precision of `PRECISION` there and the next one below. Families marked withheld, with cue words of their own,
are never trained or calibrated on (nor is a format whose positives are withheld trained on as a negative); `measured` gives precision and recall on them by kind. The trees
are then written as a SQL expression, so that scoring needs no shuffle, join or model file, and
positions are summed within the row: no row leaves its partition and no text is cut.

All patterns take linear time: runs are matched possessively and start only at the start of
a run or, where that matters, at the end of the match before.

Edge cases: a null or empty text has no spans; equal rows are searched each for itself; a null
doc_id stays null; spans that tie in start are ordered by kind; an empty table gives no rows (and
examples without corpus text); other columns are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

TRAIN_ROWS, TREES, DEPTH, PRECISION, CONTEXTS = 9000, 12, 4, 0.98, 512

#: Fixed by the contract, in its order; written without backtracking, with equal matches.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The method's own generators, high recall and low precision.
MORE = {
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "phone_like": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "email_like": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9.]{0,40}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,40}+(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z]{2,10})",
    "card_like": r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])",
}
KINDS = [*BASE, *MORE]
#: A text without it has no candidate of the kind.
NEEDS = {"email": "instr(text, '@') > 0", "email_like": "instr(text, 'at)') > 0 OR instr(text, 'at]') > 0", "phone": "instr(text, '+') > 0", "secret": "text RLIKE '[A-Za-z0-9_-]{20}'"}
#: Word stems looked for before a candidate; the generator's cue words go beyond them.
CUES = {
    "secret": r"(?i)(?:token|secret|pass|pwd|key|cred|auth|bearer)",
    "iban": r"(?i)\b(?:iban|account|bank)",
    "phone_like": r"(?i)\b(?:tel|phone|call|mobile|fax|cell)",
    "email_like": r"(?i)\b(?:e-?mail|contact|write|reach)",
    "card_like": r"(?i)\b(?:card|visa|credit|payment)",
}
AGAINST = r"(?i)\b(?:order|invoice|isbn|version|build|commit|sha|hash|digest|ticket|serial|part|model|page)"
ENDINGS = r"(?i)\b(?:com|org|net|edu|gov|info|io|de|fr|uk|es|it|eu)$"
BEFORE, AFTER = 24, 8


def _valid(kind: str) -> str:
    """SQL over c.value: what the base rule accepts."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return rf"c.value RLIKE r'^(?:{part}\.){{3}}{part}$'"
    digits = "regexp_replace(c.value, '[^0-9]', '')"
    if kind == "card":
        return f"length({digits}) BETWEEN 14 AND 19 AND {_luhn(digits)}"
    if kind == "phone":
        return f"length({digits}) BETWEEN 10 AND 15"
    return "true" if kind == "email" else "false"


def _luhn(digits: str) -> str:
    """Luhn's sum from the right: every second digit doubled, its own digits summed."""
    term = "CAST(substr(reverse(%s), i + 1, 1) AS INT)" % digits
    return f"aggregate(transform(sequence(0, length({digits}) - 1), i -> IF(i % 2 = 0, {term}, IF({term} > 4, 2 * {term} - 9, 2 * {term}))), 0, (a, x) -> a + x) % 10 = 0"


def _mod97(text: str) -> str:
    """Remainder by 97 of a text of digits and capitals, a capital read as 10 to 35."""
    step = "IF(x RLIKE '[0-9]', (a * 10 + CAST(x AS INT)) % 97, (a * 100 + ascii(x) - 55) % 97)"
    return f"aggregate(filter(split({text}, ''), x -> x <> ''), 0, (a, x) -> {step})"


def _checked(iban: str) -> str:
    """SQL of whether the check digits of an IBAN without blanks hold."""
    return _mod97(f"concat(substr({iban}, 5), left({iban}, 4))") + " = 1"


def _features(c: str = "c") -> dict[str, str]:
    """Names and SQL of a candidate's features; c has kind, value, before and after."""
    v = f"{c}.value"
    cue = "CASE " + " ".join(f"WHEN {c}.kind = '{k}' THEN CAST({c}.before RLIKE r'{p}' AS DOUBLE)" for k, p in CUES.items()) + " ELSE 0.0D END"
    flag = "CAST({0} AS DOUBLE)".format
    share = lambda chars: f"CAST(length(regexp_replace({v}, '[^{chars}]', '')) AS DOUBLE) / greatest(length({v}), 1)"
    plain, digits = f"replace({v}, ' ', '')", f"regexp_replace({v}, '[^0-9]', '')"
    checked = f"CASE WHEN {c}.kind = 'iban' THEN {_checked(plain)} ELSE false END"
    return {
        **{f"is_{k}": flag(f"{c}.kind = '{k}'") for k in MORE},
        "length": flag(f"length({plain})"),
        "digits": share("0-9"),
        "upper": share("A-Z"),
        "lower": share("a-z"),
        "vowels": share("aeiouAEIOU"),
        "joints": share("_-"),
        "blanks": share("\\x20"),
        "wordy": f"CAST(length({v}) - length(regexp_replace({v}, '[A-Z]?[a-z]{{3,}}|[A-Z]{{4,}}', '')) AS DOUBLE) / greatest(length({v}), 1)",
        "varied": flag(f"size(array_distinct(split({v}, '')))"),
        "hex": flag(f"{v} RLIKE '^(?:[0-9a-f]+|[0-9A-F]+)$'"),
        "uuid": flag(f"{v} RLIKE '^[0-9A-Fa-f]{{8}}-[0-9A-Fa-f]{{4}}-'"),
        "changes": flag(f"size(regexp_extract_all({v}, '(?:[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z])', 0))"),
        "checked": flag(checked),
        "dialled": flag(f"{digits} RLIKE '^[2-9][0-9]{{2}}[2-9]'"),
        "issued": flag(f"{digits} RLIKE '^[3-6]'"),
        "bracket": flag(f"{v} RLIKE '^[(]'"),
        "ending": flag(f"{v} RLIKE r'{ENDINGS}'"),
        "cue": cue,
        "against": flag(f"{c}.before RLIKE r'{AGAINST}'"),
        "assigned": flag(f"{c}.before RLIKE r'[=:]\\s*[\"\\x27]?$'"),
        "quoted": flag(f"{c}.before RLIKE r'[\"\\x27]$' AND {c}.after RLIKE r'^[\"\\x27]'"),
        "slash": flag(f"{c}.before RLIKE '[/#]$'"),
    }


class Family(NamedTuple):
    """One format: SQL of its values over id and words, where it stands (cue, against, plain or
    path), whether that is personal data, and whether it is withheld from the fit."""

    kind: str
    value: str
    place: str
    label: bool
    withheld: bool = False


def _bits(seed: int) -> str:
    return f"sha2(concat_ws('-', id, {seed}), 512)"


def _hex(n: int, seed: int = 1) -> str:
    return f"substr({_bits(seed)}, 1, {n})"


def _digits(n: int, seed: int = 1) -> str:
    return f"substr(translate({_bits(seed)}, 'abcdef', '147069'), 1, {n})"


def _mixed(n: int, seed: int = 1) -> str:
    return f"substr(regexp_replace(base64(unhex({_bits(seed)})), '[^A-Za-z0-9]', ''), 1, {n})"


def _pick(words: str, seed: int) -> str:
    of = words.split("|")
    return f"element_at(array({', '.join(map(repr, of))}), 1 + CAST(pmod(xxhash64(id, {seed}), {len(of)}) AS INT))"


def _in_fours(text: str) -> str:
    return f"trim(regexp_replace({text}, '(.{{4}})', '$1 '))"


def _iban(country: str, bank: str) -> str:
    check = f"lpad(CAST(98 - {_mod97(f"concat({bank}, '{country}00')")} AS STRING), 2, '0')"
    return f"concat('{country}', {check}, {bank})"


def _dial(form: str, first: str = "2|3|5|7|9") -> str:
    """A number of ten digits in a form with places 0, 1 and 2."""
    parts = [f"concat({_pick(first, 11)}, {_digits(2, 2)})", f"concat({_pick(first, 12)}, {_digits(2, 3)})", _digits(4, 4)]
    return "concat(" + ", ".join(parts[int(x)] if x in "012" else repr(x) for x in form) + ")"


_UUID = f"concat_ws('-', {_hex(8)}, {_hex(4, 2)}, {_hex(4, 3)}, {_hex(4, 4)}, {_hex(12, 5)})"
_NAME = f"concat({_pick('anna|j.miller|info|lee|k.sato|sales|o', 21)}, {_pick('|7|42|.b|99', 22)})"
_HOST = _pick("mail|example|uni-lab|acme|web3|home", 23)
_FOURS = f"concat_ws({{0}}, concat({{1}}, {_digits(3, 6)}), {_digits(4, 7)}, {_digits(4, 8)}, {_digits(4, 9)})"
_CARD, _OTHER = _pick("3|4|5|6", 24), _pick("0|1|2|8|9", 24)
FAMILIES = [
    Family("secret", _hex(40), "cue", True),
    Family("secret", _hex(32), "cue", True),
    Family("secret", _mixed(43), "cue", True),
    Family("secret", _mixed(28), "cue", True),
    Family("secret", _UUID, "cue", True),
    Family("secret", f"concat('sk_live_', {_mixed(24)})", "plain", True),
    Family("secret", f"concat('AKIA', upper({_mixed(16)}))", "plain", True),
    Family("secret", f"concat('ghp_', {_mixed(36)})", "plain", True, True),
    Family("secret", _hex(64), "cue", True, True),
    Family("secret", f"upper({_hex(48)})", "cue", True, True),
    Family("secret", _hex(40), "against", False),
    Family("secret", _hex(32), "plain", False),
    Family("secret", _hex(64), "plain", False),
    Family("secret", _UUID, "plain", False),
    Family("secret", _UUID, "path", False),
    Family("secret", _mixed(27), "path", False),
    Family("secret", _digits(24), "plain", False),
    Family("secret", f"repeat({_pick('-|_|a|x', 25)}, 20 + CAST(pmod(id, 40) AS INT))", "plain", False),
    Family("secret", "array_join(words, '-')", "path", False),
    Family("secret", "array_join(words, '_')", "cue", False),
    Family("secret", f"concat(array_join(words, '_'), '_', {_digits(3)})", "plain", False),
    Family("secret", f"concat({_digits(4)}, '-', array_join(words, '-'))", "path", False),
    Family("secret", "upper(array_join(words, '_'))", "plain", False),
    Family("secret", "replace(initcap(array_join(words, ' ')), ' ', '')", "cue", False),
    Family("secret", "array_join(words, '-')", "cue", False, True),
    Family("secret", _hex(56), "against", False, True),
    Family("secret", f"concat(array_join(words, '-'), '-', {_digits(6)})", "path", False, True),
    Family("secret", f"concat(replace(initcap(array_join(words, ' ')), ' ', ''), {_digits(4)})", "plain", False, True),
    Family("secret", f"concat('xoxb-', {_digits(12)}, '-', {_mixed(24)})", "plain", True, True),
    *(Family("iban", value, place, True) for value in (_iban("DE", _digits(18)), _in_fours(_iban("NL", f"concat('ABNA', {_digits(10)})"))) for place in ("cue", "plain")),
    Family("iban", _iban("ES", _digits(20)), "cue", True, True),
    Family("iban", _in_fours(_iban("FR", _digits(23))), "plain", True, True),
    Family("iban", f"concat('DE', {_digits(20)})", "plain", False),
    Family("iban", f"concat('SN', {_digits(2)}, upper({_hex(12)}))", "against", False),
    Family("iban", _in_fours(f"concat('GB', {_digits(18)})"), "against", False, True),
    Family("iban", f"concat('PX', {_digits(2)}, upper({_mixed(14)}))", "plain", False, True),
    *(Family("phone_like", _dial(form), "cue", True) for form in ("(0) 1-2", "0-1-2", "0.1.2")),
    *(Family("phone_like", _dial(form), "plain", True) for form in ("(0) 1-2", "(0).1.2", "(0) 1.2")),
    Family("phone_like", _dial("0 1 2"), "cue", True, True),
    Family("phone_like", _dial("(0) 1 2"), "plain", True, True),
    *(Family("phone_like", _dial("0-1-2"), place, False) for place in ("against", "against", "plain")),
    *(Family("phone_like", _dial(form, "0|1"), "plain", False) for form in ("0-1-2", "(0) 1-2", "0.1.2")),
    Family("phone_like", _dial("0.1.2"), "against", False, True),
    Family("phone_like", _dial("0-1.2", "0|1"), "plain", False, True),
    *(Family("email_like", f"concat({_NAME}, '{at}', {_HOST}, '{dot}', {_pick('com|org|de|fr|ch|jp', 26)})", place, True) for at, dot in ((" [at] ", " [dot] "), ("(at)", "(dot)")) for place in ("cue", "plain")),
    Family("email_like", f"concat({_NAME}, ' (at) ', {_HOST}, '.', {_pick('net|edu|nl|se', 26)})", "cue", True, True),
    Family("email_like", f"concat({_NAME}, '[at]', {_HOST}, '[dot]com')", "plain", True, True),
    Family("email_like", f"concat({_pick('meet|arrive|index|stop|look', 27)}, ' (at) ', {_pick('noon|gate|home|the', 28)}, '.', {_pick('Then|We|See|Next|len', 29)})", "plain", False),
    Family("email_like", f"concat({_pick('f|get|pos', 27)}, '[at] ', {_pick('x|node|self', 28)}, '.', {_pick('next|value|size', 29)})", "plain", False),
    Family("email_like", f"concat({_pick('open|start', 27)}, '(at) ', {_pick('dawn|ten', 28)}, '. ', {_pick('They|Later', 29)})", "plain", False, True),
    *(Family("card_like", _FOURS.format(repr(by), _CARD), "cue", True) for by in "- "),
    Family("card_like", _FOURS.format("'-'", _CARD), "cue", True, True),
    Family("card_like", _FOURS.format("'-'", _OTHER), "cue", False),
    *(Family("card_like", _FOURS.format(repr(by), _CARD), place, False) for by in "- " for place in ("plain", "against")),
    Family("card_like", _FOURS.format("' '", _CARD), "against", False, True),
    Family("card_like", _FOURS.format("'-'", _OTHER), "plain", False, True),
]
#: Words before an example, for families that are fitted and for withheld ones.
SAID = {
    "secret": ("token|secret|password|api_key|access key|Bearer|pin code", "passphrase|private key|client_secret|auth|login"),
    "iban": ("IBAN|account|bank|Konto", "bank account|transfer to|IBAN no."),
    "phone_like": ("phone|call|tel.|mobile|ring", "fax|cell|call us at|dial"),
    "email_like": ("mail|contact|write to|ask", "email|reach me|send to"),
    "card_like": ("card|visa|credit card|paid by", "payment|card no.|charged"),
}
AGAINST_SAID = ("order|invoice|commit|serial|ticket|version|sha|item", "build|digest|part|model|checksum|lot")


def contexts(docs: DataFrame) -> DataFrame:
    """slot and piece: at most CONTEXTS pieces of 64 characters, one row and place of it per slot."""
    h = "xxhash64(doc_id, text)"
    d = id_and_text(docs).filter("length(text) > 0").select(F.expr(f"pmod({h}, {CONTEXTS})").alias("slot"), F.expr(f"struct({h} AS h, substr(text, 1 + CAST(pmod(xxhash64({h}), length(text)) AS INT), 64) AS piece)").alias("c"))
    return d.groupBy("slot").agg(F.min("c").alias("c")).select("slot", "c.piece")


def examples(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """id, kind, value, before, after, label and withheld of labelled candidates in corpus text.

    Without corpus text nothing but cue words stands next to the values.
    """
    pick = lambda of: "CASE family " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(of)) + " END"
    d = docs.sparkSession.range(0, rows, 1, 8).withColumns({"family": F.expr(f"CAST(pmod(id, {len(FAMILIES)}) AS INT)"), "slot": F.expr(f"pmod(xxhash64(id, 31), {CONTEXTS})")})
    d = d.join(contexts(docs), "slot", "left").withColumn("piece", F.coalesce("piece", F.lit("")))
    # Slugs need words where the piece has none of Latin script.
    spare = "array('winter', 'report', 'of', 'northern', 'harbour')"
    d = d.withColumn("found", F.expr("slice(regexp_extract_all(piece, '[A-Za-z]{2,12}', 0), 1, 6)"))
    d = d.withColumn("words", F.expr(f"IF(length(array_join(found, '-')) < 20, {spare}, found)"))
    d = d.withColumn("value", F.expr(pick(f.value for f in FAMILIES)))

    def said(f: Family) -> str:
        if f.place == "plain":
            return "''"
        if f.place == "path":
            return _pick("/|/posts/|#|?id=|/v/", 32)
        words = (SAID[f.kind] if f.place == "cue" else AGAINST_SAID)[f.withheld]
        return f"concat({_pick(words, 33)}, {_pick(' = "|: |=| | is |: "', 34) if f.kind == 'secret' and f.place == 'cue' else _pick(': | | no. | #', 34)})"

    place = {"kind": pick(repr(f.kind) for f in FAMILIES), "said": pick(said(f) for f in FAMILIES), "label": pick(f"{int(f.label)}.0D" for f in FAMILIES), "withheld": pick(str(f.withheld).lower() for f in FAMILIES)}
    d = d.withColumns({k: F.expr(x) for k, x in place.items()})
    d = d.withColumns({"before": F.expr(f"right(concat(left(piece, 32), ' ', said), {BEFORE})"), "after": F.expr(f"left(concat(IF(said LIKE '%\"', '\"', ''), ' ', substr(piece, 33)), {AFTER})")})
    # Only what the generators propose whole.
    proposed = "CASE " + " ".join(f"WHEN kind = '{k}' THEN regexp_replace(value, r'{p}', '') = ''" for k, p in MORE.items()) + " END"
    # One made-up account number in 97 has valid check digits by chance and is no negative.
    lucky = f"CASE WHEN kind = 'iban' AND label = 0 THEN {_checked("replace(value, ' ', '')")} ELSE false END"
    return d.filter(proposed).filter(f"NOT ({lucky})").select("id", "kind", "value", "before", "after", "label", "withheld")


def _tree_sql(lines: list[str], names: list[str]) -> str:
    """One tree of Spark's debug string as nested CASE expressions."""
    line = lines.pop(0)
    if m := re.fullmatch(r"Predict: (\S+)", line):
        return f"{m[1]}D" if "E" not in m[1] else f"CAST('{m[1]}' AS DOUBLE)"
    index, op, at = re.fullmatch(r"If \(feature (\d+) (<=|>) (\S+)\)", line).groups()
    yes = _tree_sql(lines, names)
    lines.pop(0)
    return f"CASE WHEN f.{names[int(index)]} {op} {at}D THEN {yes} ELSE {_tree_sql(lines, names)} END"


def _described(examples: DataFrame) -> DataFrame:
    """Examples with part (0 fitted, 1 calibrated, 2 withheld) and the features."""
    part = F.expr("CASE WHEN withheld THEN 2 WHEN pmod(xxhash64(id, 3), 5) = 0 THEN 1 ELSE 0 END")
    d = examples.select("kind", "label", part.alias("part"), F.expr("struct(kind, value, before, after)").alias("c"))
    return d.select("kind", "label", "part", *(F.expr(x).alias(n) for n, x in _features().items()))


def fitted(docs: DataFrame, rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH, precision: float = PRECISION) -> tuple[str, dict[str, float]]:
    """The margin as SQL over f, a struct of the features, and the threshold of each kind."""
    names = list(_features())
    d = VectorAssembler(inputCols=names, outputCol="features").transform(_described(examples(docs, rows)).filter("part < 2").repartition(2)).persist()
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, cacheNodeIds=False).fit(d.filter("part = 0"))
    parts = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        lines = [x.strip() for x in tree.toDebugString.split("\n")[1:] if x.strip()]
        parts.append(f"{weight}D * ({_tree_sql(lines, names)})")
    margin = " + ".join(parts)
    scored = _margins(d.filter("part = 1"), margin).groupBy("kind", "m").agg(F.sum("label").alias("hits"), F.count("*").alias("n")).collect()
    d.unpersist()
    limits = {}
    for kind in MORE:
        hits = n = 0
        limits[kind] = 1e9
        ordered = sorted((r for r in scored if r.kind == kind), key=lambda r: -r.m)
        for r, below in zip(ordered, [r.m for r in ordered[1:]] + [0.0], strict=True):
            hits, n = hits + r.hits, n + r.n
            if hits >= precision * n and r.m > 0:
                limits[kind] = max(0.0, (r.m + below) / 2)
    return margin, limits


def _margins(described: DataFrame, margin: str) -> DataFrame:
    """kind, label and the margin m, rounded."""
    d = described.select("kind", "label", F.struct(*_features()).alias("f"))
    return d.select("kind", "label", F.expr(f"round({margin}, 2)").alias("m"))


def measured(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per kind: threshold, precision and recall on the withheld families and cue words."""
    margin, limits = fitted(docs, rows)
    limit = F.expr("CASE " + " ".join(f"WHEN kind = '{k}' THEN {x}D" for k, x in limits.items()) + " END")
    d = _margins(_described(examples(docs, rows)).filter("part = 2"), margin).withColumn("limit", limit)
    return d.groupBy("kind", "limit").agg(
        F.count("*").alias("n"),
        F.expr("avg(label) FILTER (WHERE m >= limit)").alias("precision"),
        F.expr("avg(IF(m >= limit, 1, 0)) FILTER (WHERE label = 1)").alias("recall"),
    )


def _placed(d: DataFrame, kind: str, pattern: str) -> DataFrame:
    """Adds c_<kind>: the candidates of a kind with start, end, value, before and after.

    A candidate starts where the gaps and matches before it end. These lengths are summed by blocks
    of 256, so that a text of very many candidates takes little more than linear time.
    """
    need = NEEDS.get(kind, "text RLIKE '[0-9]'")
    d = d.withColumns({"_m": F.expr(f"CASE WHEN {need} THEN regexp_extract_all(text, r'{pattern}', 0) END"), "_g": F.expr(f"CASE WHEN {need} THEN split(text, r'{pattern}', -1) END")})
    d = d.withColumn("_n", F.expr("CASE WHEN size(_m) > 0 THEN transform(_m, (m, i) -> CAST(length(_g[i]) + length(m) AS BIGINT)) END"))
    d = d.withColumn("_s", F.expr("transform(sequence(0, (size(_n) - 1) div 256), b -> aggregate(slice(_n, CAST(b * 256 + 1 AS INT), 256), 0L, (a, x) -> a + x))"))
    d = d.withColumn("_b", F.expr("transform(_s, (x, b) -> aggregate(slice(_s, 1, b), 0L, (a, y) -> a + y))"))
    start = "_b[i div 256] + aggregate(slice(_n, CAST((i div 256) * 256 + 1 AS INT), i % 256), 0L, (a, x) -> a + x) + length(_g[i])"
    one = f"struct('{kind}' AS kind, {start} AS start, m AS value, right(_g[i], {BEFORE}) AS before, left(_g[i + 1], {AFTER}) AS after)"
    return d.withColumn(f"c_{kind}", F.expr(f"CASE WHEN size(_b) > 0 THEN transform(_m, (m, i) -> {one}) ELSE CAST(array() AS ARRAY<STRUCT<kind: STRING, start: BIGINT, value: STRING, before: STRING, after: STRING>>) END")).drop("_m", "_g", "_n", "_s", "_b")


def spans(docs: DataFrame, model: tuple[str, dict[str, float]] | None = None) -> DataFrame:
    """doc_id, text, base and added: arrays of (start, kind number, end, kind, value), in order.

    A model that `fitted` gave is used where it is passed, else one is fitted on these documents.
    """
    margin, limits = model or fitted(docs)
    d = id_and_text(docs)
    for kind, pattern in (BASE | MORE).items():
        d = _placed(d, kind, pattern)
    shape = "struct(c.start AS start, {0} AS place, c.start + length(c.value) AS end, c.kind AS kind, c.value AS value)".format
    base = ", ".join(f"transform(filter(c_{k}, c -> {_valid(k)}), c -> {shape(KINDS.index(k))})" for k in BASE)
    features = "named_struct(" + ", ".join(f"'{n}', {x}" for n, x in _features().items()) + ")"
    scored = ", ".join(f"transform(c_{k}, c -> struct({shape(KINDS.index(k))} AS c, {features} AS f))" for k in MORE)
    d = d.select("doc_id", "text", F.expr(f"sort_array(flatten(array({base})))").alias("base"), F.expr(f"flatten(array({scored}))").alias("scored"))
    limit = "CASE " + " ".join(f"WHEN f.c.kind = '{k}' THEN {x}D" for k, x in limits.items()) + " END"
    chosen = f"transform(filter(scored, f -> {margin.replace('f.', 'f.f.')} >= {limit}), f -> f.c)"
    d = d.withColumn("chosen", F.expr(f"CASE WHEN size(scored) > 0 THEN {chosen} ELSE transform(scored, f -> f.c) END"))
    # An added span that lies within a base span says nothing new.
    return d.select("doc_id", "text", "base", F.expr("sort_array(filter(chosen, c -> NOT exists(base, b -> b.start <= c.start AND c.end <= b.end)))").alias("added"))


def _joined(array: str) -> str:
    return f"array_join(transform({array}, c -> concat(c.kind, ':', c.start, ':', c.end)), ',')"


def found(docs: DataFrame, model: tuple[str, dict[str, float]] | None = None) -> DataFrame:
    """Per document: counts of the base kinds, the digest of base spans, and all spans."""
    d = spans(docs, model)
    return d.select(
        "doc_id",
        *(F.expr(f"CAST(size(filter(base, c -> c.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE),
        F.expr(f"sha2({_joined('base')}, 256)").alias("base_sha256"),
        F.expr(_joined("sort_array(concat(base, added))")).alias("spans"),
        F.expr("CAST(size(added) AS BIGINT)").alias("n_added"),
    )


def redacted(docs: DataFrame, mask: str = "[{}]", model: tuple[str, dict[str, float]] | None = None) -> DataFrame:
    """doc_id and text with the selected spans replaced by their kind; overlaps go as one."""
    d = spans(docs, model).withColumn("all", F.expr("sort_array(concat(base, added))"))
    step = f"struct(concat(a.t, IF(c.start >= a.at, concat(substr(text, CAST(a.at + 1 AS INT), CAST(c.start - a.at AS INT)), '{mask.split('{}')[0]}', c.kind, '{mask.split('{}')[1]}'), '')) AS t, greatest(a.at, c.end) AS at)"
    return d.select("doc_id", F.expr(f"CASE WHEN size(all) = 0 THEN text ELSE aggregate(all, struct('' AS t, 0L AS at), (a, c) -> {step}, a -> concat(a.t, substr(text, CAST(a.at + 1 AS INT)))) END").alias("text"))
