"""op1, op2, op3, op4: against brute force over whole texts, and edge cases."""

import collections
import hashlib
import random
import re

import duckdb
import pytest

from quartzfolio.llm import decontaminate, line_dedup, pii, quality_rules
from quartzfolio.llm.queries import ORACLES, QUERIES

from .conftest import SF

EDGE = [(1, None), (2, ""), (3, "x " * 3), (3, "x " * 3), (None, "a\n\nb"), (4, "é😀 " * 20_000)]
SCHEMA = "doc_id long, text string"
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def base_spans(text):
    def ok(kind, s):
        g = re.sub("[^0-9]", "", s)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in s.split(".")), "card": lambda: 14 <= len(g) <= 19 and luhn(g), "phone": lambda: 10 <= len(g) <= 15}[kind]()

    return sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(PII.items()) for m in re.finditer(p, text or "") if ok(k, m.group()))


def test_pii(spark, docs, texts):
    more = [(10**6, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 +1 (234) 567-8901. 4111 1111 1111 1111 999.1.1.1"), (10**6 + 1, 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" é😀 q@w.io'), (10**6 + 2, " ".join(f"u{i}@m.io" for i in range(600)))]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*EDGE, *more], SCHEMA))
    want = collections.Counter()
    for r in every.collect():
        b = base_spans(r.text)
        n = collections.Counter(k for _, _, k, _ in b)
        want[r.doc_id, *(n[k] for k in PII), hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in b).encode()).hexdigest()] += 1
    model = pii.fitted(every)
    got = pii.found(every, model).collect()
    assert collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    secret = next(r for r in got if r.doc_id == 10**6 + 1)
    assert "secret:9:49" in secret.spans and "email" in secret.spans
    masked = pii.redacted(spark.createDataFrame(more[1:2], SCHEMA), model=model).first().text
    assert masked == 'token = "[secret]" é😀 [email]'
    assert len(set(model[1].values())) > 1 and max(model[1].values()) < 1e9
    assert pii.found(every.limit(0)).count() == 0


def test_pii_on_withheld_formats(spark, docs):
    """Formats and cue words that the trees never saw; the least figures are those to keep."""
    got = {r.kind: r for r in pii.measured(docs).collect()}
    assert set(got) == set(pii.MORE) and all(r.n > 200 for r in got.values())
    assert min(r.precision for r in got.values()) > 0.8 and min(r.recall for r in got.values()) > 0.5


def test_line_dedup(spark):
    long = " ".join(f"w{i}" for i in range(60))
    short = "\n".join(" ".join(f"s{j}{i}" for i in range(12)) for j in range(12))
    rows = [(1, f"own one\n{long}\nend"), (2, f"other start\nmore\n{long}"), (3, long), (4, "head\n" + short), (5, short + "\ntail of another"), (6, None), (7, ""), (8, "same"), (8, "same"), (None, f"{long}\nnull id")]
    got = {(r.doc_id, r.extra): r for r in line_dedup.deduplicated(spark.createDataFrame([(i, t, "e") for i, t in rows], SCHEMA + ", extra string")).collect()}
    assert len(got) == 9
    assert got[None, "e"].text == f"{long}\nnull id"
    assert got[1, "e"].text == "own one\nend" and got[2, "e"].text == "other start\nmore" and got[3, "e"].text == ""
    assert got[6, "e"].text is None and got[7, "e"].text == "" and got[8, "e"].text == "same"
    assert got[4, "e"]._n_removed_lines == 0 and got[5, "e"]._n_removed_lines >= 6 and got[5, "e"].text.endswith("tail of another")


def test_line_dedup_keeps_what_occurs_once(docs, texts):
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(docs).collect()}
    before, after = (collections.Counter(x for t in d.values() for x in t.split("\n")) for d in (texts, got))
    assert set(before) - {""} == set(after) - {""}
    assert not [x for x, n in after.items() if n > 1 and len(x.split()) >= line_dedup.CHUNK]


def passages(rng):
    """Passages of 50 to 200 words in 2 to 20 lines, some without blanks or with empty lines, each as (sep, lines)."""
    for k in range(120):
        n_words, n_lines = rng.choice([50, 52, 60, 80, 100, 200]), rng.choice([2, 3, 4, 6, 8, 10, 15, 20])
        cuts = sorted(rng.sample(range(1, n_words), n_lines - 1))
        w = [chr(rng.randrange(0x4E00, 0x9000)) if k % 10 == 9 else f"p{k}x{i}" for i in range(n_words)]
        yield "\n\n" if k % 5 == 3 else "\n", [("" if k % 10 == 9 else " ").join(w[a:b]) for a, b in zip([0, *cuts], [*cuts, n_words])]


def test_line_dedup_cuts_planted_passages(spark):
    rng, rows, want = random.Random(7), [], {}
    own = lambda: "\n".join(" ".join(f"o{rng.randrange(10**9)}" for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 6)))
    for k, (sep, lines) in enumerate(passages(rng)):
        for copy in range(3):
            before, after = own(), own()
            rows.append((10 * k + copy, f"{before}\n{sep.join(lines)}\n{after}"))
            want[10 * k + copy] = rows[-1][1] if copy == 0 else f"{before}\n{after}"
    few = [(10**6, "own a\nHome of it\nAbout us\nown b"), (10**6 + 1, "own c\nHome of it\nAbout us\nown d"), (10**6 + 2, "x    y\nu" + 30 * " " + "v\nown e"), (10**6 + 3, "x    y\nu" + 30 * " " + "v\nown f")]
    got = {r.doc_id: r for r in line_dedup.deduplicated(spark.createDataFrame(rows + few, SCHEMA)).collect()}
    assert {i: r.text for i, r in got.items()} == want | dict(few)
    assert all(got[i]._n_removed_chunks == (i % 10 > 0) and got[i]._n_lines - got[i]._n_removed_lines == t.count("\n") + 1 for i, t in want.items())


def runs(rows):
    """Lines as (gap, line) by position in order of doc_id, and the runs that stand earlier, too: (doc, start, end, words)."""
    lines = {i: [(p, x) for p, x in enumerate(t.split("\n")) if x] for i, t in sorted(rows.items())}
    place, found = collections.defaultdict(list), []
    same = lambda a, p, b, q: p >= 0 and q >= 0 and p < len(lines[a]) and q < len(lines[b]) and lines[a][p][1] == lines[b][q][1]
    gap = lambda a, p: lines[a][p + 1][0] - lines[a][p][0]
    for i, own in lines.items():
        for p, (_, x) in enumerate(own):
            for j, q in place[x]:
                if same(i, p - 1, j, q - 1) and gap(i, p - 1) == gap(j, q - 1):
                    continue
                e = 0
                while same(i, p + e + 1, j, q + e + 1) and gap(i, p + e) == gap(j, q + e):
                    e += 1
                found.append((i, p, p + e, sum(len(y.split()) for _, y in own[p : p + e + 1])))
            place[x].append((i, p))
    return lines, found


def test_line_dedup_equals_runs_found_by_brute_force(spark):
    """What goes stands earlier in one piece of a chunk's words; of a passage that stands earlier something goes."""
    rng = random.Random(3)
    pool = [[" ".join(f"a{k}x{j}x{i}" for i in range(rng.randint(2, 16))) for j in range(rng.randint(4, 12))] for k in range(12)]
    rows = {}
    for i in range(80):
        parts = []
        for _ in range(rng.randint(1, 4)):
            part = rng.choice(pool)
            a, b = sorted(rng.sample(range(len(part) + 1), 2))
            parts += [*part[a:b], *([""] * rng.randint(0, 1)), f"own {i} {rng.random()}"]
        rows[i] = "\n".join(parts)
    # Three documents hold two lines of a passage each, the last one all four of them: no chunk stands earlier in one piece.
    four = [" ".join(f"f{j}x{i}" for i in range(14)) for j in range(4)]
    rows |= {100 + k: "\n".join([f"head {k}", *four[k : k + 2], f"tail {k}"]) for k in range(3)} | {103: "\n".join(["head 3", *four, "tail 3"])}
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(list(rows.items()), SCHEMA)).collect()}
    assert got[103] == rows[103]
    lines, found = runs(rows)
    may, cut = collections.defaultdict(set), {}
    for i, s, e, n in found:
        if n >= line_dedup.CHUNK:
            may[i] |= set(range(s, e + 1))
    for i, own in lines.items():
        left = collections.Counter(x for x in got[i].split("\n") if x)
        cut[i] = [x for _, x in own if not left[x]]
        assert not collections.Counter(cut[i]) - collections.Counter(own[p][1] for p in may[i])
    passages = [r for r in found if r[3] >= line_dedup.PASSAGE]
    assert len(passages) > 50 and all(got[i] != rows[i] for i, _, _, _ in passages)
    once = [r for r in passages if len({x for _, x in lines[r[0]]}) == len(lines[r[0]])]
    assert len(once) > 20 and all(set(cut[i]) & {x for _, x in lines[i][s : e + 1]} for i, s, e, _ in once)
    assert set().union(*(set(t.split("\n")) for t in rows.values())) - {""} == set().union(*(set(t.split("\n")) for t in got.values())) - {""}


def test_line_dedup_hashes_that_collide(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HASH", "IF({seed} = 0, xxhash64({x}) & 3L, xxhash64({x}, {seed}))")
    rows = [(k, "\n".join(" ".join(f"w{k if line != 1 else 0}_{line}_{i}" for i in range(40)) for line in range(3))) for k in range(4)]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: t if k == 0 else "\n".join(t.split("\n")[::2]) for k, t in rows}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))


def hits(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        x = words(t)
        n = min(10, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == x[k : k + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("sizes", [{}, {"shard_chars": 300, "block_bytes": 40}])
def test_decontaminate(spark, sizes):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, "a a a a a a a a a a a a a a"), (2, None), (None, "x y"), (3, "Foo BAR é  é foo bar"), (4, "w" * 2_000_000 + " foo bar " + "z " * 100), (5, f"before {passage.upper()} after"), (6, " ".join(passage.split()[:9])), (7, "")]
    items = [(1, "a " * 12), (2, "foo bar"), (2, None), (3, "É foo"), (4, "x"), (5, "z " * 18), (6, passage), (7, "")]
    d, b = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.searched(d, b, **sizes).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == hits(t, items), i
    assert (got[5].longest_match, got[5].longest_item, got[5].longest_at) == (30, "6", 1)
    odd = d.selectExpr("*", "doc_id AS _dirty", "text AS `a.b`", "map('k', array(1)) AS m", "1 AS n_words", "CAST(1.5 AS DECIMAL(9, 2)) AS hits")
    left = decontaminate.clean(odd, b, **sizes)
    assert left.dtypes == odd.dtypes and sorted(map(str, left.collect())) == sorted(str(r) for r in odd.collect() if r.doc_id in (2, 6, 7))
    assert decontaminate.searched(d.limit(0), b).count() == 0 and not decontaminate.searched(d, b.limit(0)).filter("contaminated").count()
    assert decontaminate.clean(d.limit(0), b).count() == 0 and decontaminate.clean(d, b.limit(0)).count() == len(rows)


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 200}])
def test_decontaminate_judges_rows(spark, sizes):
    """Repeated rows, rows of one doc_id, and windows repeated on both sides."""
    rows = [(1, "own words " * 3), (1, "a b " * 8), (1, "a b " * 8), (None, "a b " * 8), (None, "own"), (2, "x " + "c d e " * 40)]
    items = [(k, "a b " * 7 if k % 3 else "c d e " * 5) for k in range(60)]
    d, b = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.searched(d, b, **sizes).collect())
    assert got == sorted((i or 0, *hits(t, items)) for i, t in rows)
    assert sorted((r.doc_id or 0, r.text) for r in decontaminate.clean(d, b, **sizes).collect()) == [(0, "own"), (1, "own words " * 3)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_quality_rules(spark):
    d = spark.createDataFrame([*EDGE, (9, " ".join(f"word{i}" for i in range(80))), (10, "a b c " * 40)], SCHEMA)
    got = {r.doc_id: r for r in quality_rules.judged(d).collect()}
    assert got[9].kept and not got[1].kept and got[1].n_words == 0 and got[10].n_repeat_words == 120
    odd = d.selectExpr("*", "1 AS n_words", "text AS `a.b`", "doc_id AS row")
    left = quality_rules.passing(odd)
    assert left.columns == odd.columns and [r.doc_id for r in left.collect()] == [9]
    assert quality_rules.judged(d.limit(0)).count() == 0 and quality_rules.passing(d.limit(0)).count() == 0


def test_quality_order_is_stable(spark, docs):
    """Five runs, dealt over other partitions, give one order of the seven rules, that of rejection per work."""
    orders = [[r.name for r in quality_rules.cascade(docs.repartition(k))] for k in (1, 2, 3, 5, 8)]
    assert len(orders[0]) == 7 and orders == [orders[0]] * 5
    assert orders[0].index("exclamations") < orders[0].index("word_length")
    reject = [quality_rules.Rule(n, "length(text) >= 0", u) for n, u in (("c", ()), ("b", ("n_symbols",)), ("a", ("n_repeat_words",)))]
    assert [r.name for r in quality_rules.cascade(docs, tuple(reject[::-1]))] == ["c", "b", "a"]


def test_quality_rules_leave_the_parser_empty(spark, docs):
    """The cascade's long SQL doesn't stay in the driver's heap (some 80 MB before), and the session's settings stay."""
    jvm, key = spark.sparkContext._jvm, "spark.sql.parser.manageParserCaches"

    def held() -> float:
        for _ in range(3):
            jvm.System.gc()
        return (jvm.java.lang.Runtime.getRuntime().totalMemory() - jvm.java.lang.Runtime.getRuntime().freeMemory()) / 1e6

    set_before, before = spark.conf.get(key), held()
    rules = (*quality_rules.RULES[::-1], *quality_rules.RULES[1::2])
    assert quality_rules.passing(docs, rules).columns == docs.columns and "kept" in quality_rules.judged(docs, rules).columns
    assert held() - before < 25 and spark.conf.get(key) == set_before


def test_quality_cascade(spark, docs):
    """Verdicts don't depend on the order, a rejected text costs no later rule, and a dear rule comes late."""
    want = sorted(r.doc_id for r in quality_rules.judged(docs).filter("kept").collect())
    for rules in (quality_rules.RULES, quality_rules.RULES[::-1]):
        left = docs.filter(quality_rules.kept(list(rules)))
        assert sorted(r.doc_id for r in left.collect()) == want
    assert sorted(r.doc_id for r in quality_rules.passing(docs).collect()) == want
    reject, fatal = quality_rules.Rule("any", "length(text) >= 0"), quality_rules.Rule("fatal", "assert_true(n_symbols < 0) IS NULL", ("n_symbols",))
    assert docs.filter(quality_rules.kept([reject, fatal])).count() == 0
    dear = quality_rules.Rule("a_dear", "n_words < 50 AND n_repeat_words >= 0", ("n_words", "n_repeat_words"))
    cheap = quality_rules.Rule("b_cheap", "length(text) < 400")
    for _ in range(2):
        assert [r.name for r in quality_rules.cascade(docs, (dear, cheap))] == ["b_cheap", "a_dear"]


def repeated_words(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = collections.Counter(windows)
    return len({k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(3)})


def test_repeated_words_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice("abcdefgh"[: 2 + k % 7]) + str(rng.randrange(1 + k % 5)) for _ in range(rng.randint(0, 120)))) for k in range(400)]
    d = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: r.n_repeat_words for r in quality_rules.counts(d).collect()} == {i: repeated_words(t) for i, t in rows}
    rule = [r for r in quality_rules.RULES if r.name == "repeated_words"]
    got = {r.doc_id for r in d.filter(quality_rules.kept(rule)).collect()}
    assert got == {i for i, t in rows if 2 * repeated_words(t) <= len(t.split())}


def test_token_files_learn_in_lots():
    """Encodings are only held for LOT texts at once, and ids don't depend on it."""
    import public_tokenizers

    from quartzfolio.llm.token_files import _Learner

    learner = _Learner(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = [f" w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(700)] + [str(k) for k in range(40)]
    whole, seen = learner(pieces), []

    class Held:
        def encode_batch_fast(self, texts, of=learner.of, **more):
            seen.append(len(texts))
            return of.encode_batch_fast(texts, **more)

    learner.of, learner.LOT = Held(), 7
    assert all((a == b).all() for a, b in zip(learner(pieces), whole, strict=True))
    assert max(seen) == 7 and sum(seen) == 700 // 50 + 40
