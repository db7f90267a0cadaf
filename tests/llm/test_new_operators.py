"""Conversation repair, repeated bytes and the Merkle manifest against brute force."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quartzfolio.llm import chat_repair, decontaminate, merkle, minhash_forest, repeated_bytes
from quartzfolio.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- conversation repair
def damaged_rows(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        out[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    """All cheapest edits by exhaustive breadth over (row, initials so far as a state), with whole audits kept."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    faults, seen = [], set()
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "b" if not last else "d" if (role, text) in seen else "t" if last[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    legal = re.compile(r"(s?(ua)*u?)?\Z")
    best, heap = {}, [(0, "", 0, "", ())]
    answer = None
    while heap:
        cost, audit, i, initials, kept = heapq.heappop(heap)
        state = (i, ("s" if initials == "s" else "", "e" if not initials else initials[-1]))
        if best.setdefault(state, (cost, audit)) != (cost, audit):
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            answer = cost, audit, kept
            break
        moves = [(2, "I", i, c, c, "") for c in "ua"]
        if i < len(rows):
            _, role, text = rows[i]
            moves.append((3, "D", i + 1, "", None, None))
            if faults[i] not in ("b", "d"):
                more = faults[i] == "t"
                moves += [(more, "K", i + 1, role[:1] or "?", role, text)] + [(2 + more, "R", i + 1, c, c, text) for c in "ua"]
        for c, edit, j, initial, role, text in moves:
            if legal.match(initials + initial):
                said = kept if role is None else kept + ((chat_repair.ROLES.get(role, role), text),)
                heapq.heappush(heap, (cost + c, audit + edit, j, initials + initial, said))
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    count = Counter(faults)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    text = "\n".join(f"{r}:{t}" for r, t in answer[2])
    return gaps, count["b"], count["d"], count["t"], sum(p not in ("su", "ua", "au") for p in pairs), answer[0], answer[1], hashlib.sha256(text.encode()).hexdigest()


def enumerated(tokens):
    """(cost, audit) over all edit sequences with few inserts, by plain enumeration."""
    best = None

    def go(i, initials, cost, audit, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(tokens) and re.fullmatch("(s?(ua)+)?", initials):
            best = min(best or (cost, audit), (cost, audit))
        if inserts < len(tokens) + 2 and cost < 3 * len(tokens) + 1:
            for c in "ua":
                go(i, initials + c, cost + 2, audit + "I", inserts + 1)
        if i < len(tokens):
            go(i + 1, initials, cost + 3, audit + "D", inserts)
            if tokens[i] != "x":
                extra = tokens[i].isupper()
                go(i + 1, initials + tokens[i].lower(), cost + extra, audit + "K", inserts)
                for c in "ua":
                    go(i + 1, initials + c, cost + 2 + extra, audit + "R", inserts)

    go(0, "", 0, "", 0)
    return best


def test_cheapest_edits_equal_enumeration():
    for n in range(4):
        for tokens in itertools.product("suaoxA", repeat=n):
            assert chat_repair.chained([chat_repair.block_table("".join(tokens))]) == enumerated("".join(tokens)), tokens


def test_blocks_of_a_conversation_join_exactly():
    r = random.Random(5)
    for _ in range(60):
        tokens = "".join(r.choice("ssuuuaaaoxxxUAS") for _ in range(r.randrange(2, 30)))
        whole = chat_repair.chained([chat_repair.block_table(tokens)])
        cuts = sorted({0, len(tokens), *(r.randrange(len(tokens)) for _ in range(3))})
        assert chat_repair.chained([chat_repair.block_table(tokens[a:b]) for a, b in itertools.pairwise(cuts)]) == whole


def repaired_rows(spark, rows):
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    names = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return {r.conv_id: tuple(r[n] for n in names) for r in chat_repair.digests(chat_repair.damaged(d)).collect()}


def test_repair_of_the_table(spark):
    d = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in d.collect()]
    assert repaired_rows(spark, rows) == {k: brute_repair(v) for k, v in damaged_rows(rows).items()}


def test_repair_at_the_edges(spark, monkeypatch):
    monkeypatch.setattr(chat_repair, "BLOCK", 5)
    rows = [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes"), (7, None, None, None), (7, None, "system", "Be kind."), (7, 3, "user", "What?"), (8, 1, "", "odd"), (8, 2, "tool", "x" * 30_000 + ".")]
    rows += [(9, t, ("user", "assistant")[t % 2], f"Say {t % 5}." if t % 3 else "Cut") for t in range(60)] + [(10, 4, "user", "Same.")] * 40 + [(11, t, "user", "Again.") for t in range(30)]
    assert repaired_rows(spark, rows) == {k: brute_repair(v) for k, v in damaged_rows(rows).items()}
    assert repaired_rows(spark, []) == {}


# ---------------------------------------------------------------- repeated bytes
def brute_bytes(docs):
    n, starts = repeated_bytes.LENGTH, Counter()
    data = [(k, (t or "").encode()) for k, t in docs]
    for _, b in data:
        starts.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if starts[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((k, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def cut_rows(spark, docs):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((tuple(r) for r in repeated_bytes.deduplicated(d).collect()), key=str)


def test_repeated_bytes_of_random_overlaps(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh ä") for _ in range(r.randrange(380, 2500))) for _ in range(8)]
    docs = []
    for k in range(60):
        text = ""
        for _ in range(r.randrange(1, 4)):
            x = r.choice(base)
            a = r.randrange(len(x))
            part = x[a : a + r.randrange(300, 1200)]
            if r.random() < 0.3:
                at = r.randrange(len(part)) if part else 0
                part = part[:at] + "#" + part[at + 1 :]
            text += part + "".join(r.choice("xyz") for _ in range(r.randrange(40)))
        docs.append((k, text))
    assert cut_rows(spark, docs) == brute_bytes(docs)


def test_repeated_bytes_at_the_edges(spark, monkeypatch):
    monkeypatch.setattr(repeated_bytes, "PIECE", 700)
    repeated_bytes._powers.cache_clear()
    r = random.Random(4)
    line = "".join(r.choice("abcdef") for _ in range(399))
    long = "".join(r.choice("abcdefghijkl") for _ in range(5000))
    docs = [(1, None), (2, ""), (3, line), (4, line), (5, line + "x"), (6, "y" + line + "x"), (7, "a" * 1500), (8, "ab" * 450), (9, long), (10, long[:1999] + "Q" + long[2000:]), (11, long[700:1150]), (None, "tail " + long[4600:]), (12, long), (12, long)]
    assert cut_rows(spark, docs) == brute_bytes(docs)
    assert cut_rows(spark, []) == []
    repeated_bytes._powers.cache_clear()


@pytest.mark.parametrize("table", ["documents"])
def test_repeated_bytes_of_the_table(spark, table):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/{table}.parquet").collect()]
    docs = docs + [(k + 10**6, t) for k, t in docs[::17]]
    assert cut_rows(spark, docs) == brute_bytes(docs)


def test_repeated_bytes_returns_what_is_left_and_what_was_cut(spark, tmp_path):
    r = random.Random(6)
    words = lambda n, letters: " ".join("".join(r.choice("abcdefghijkl") for _ in range(letters)) for _ in range(n))
    long, short = words(55, 8), words(55, 5)  # 494 and 329 bytes: only the first is as long as a window
    umlauts = "ä" * 300
    own = [words(60, 7) for _ in range(7)]
    docs = [(1, own[0] + long + own[1]), (2, long + own[2]), (3, own[3] + short), (4, short + own[4]), (5, own[5]), (6, None), (7, "é" + umlauts + "é"), (8, "\u00e8" + umlauts[:-1] + own[6])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {x.doc_id: x for x in repeated_bytes.cut(d).collect()}
    assert sorted(rows) == list(range(1, 9))
    for k, text in docs:
        left, end = b"", 0
        data = (text or "").encode()
        for s in rows[k].spans:
            assert end <= s.start < s.stop <= len(data)
            left, end = left + data[end : s.start], s.stop
        assert rows[k].kept == left + data[end:] and rows[k].n_bytes == len(data)
    assert all(long[50:-50].encode() not in rows[k].kept for k in (1, 2)) and all(short.encode() in rows[k].kept for k in (3, 4))
    assert [rows[k].spans for k in (3, 4, 5, 6)] == [[]] * 4 and rows[7].spans and rows[8].spans
    d.write.parquet(f"{tmp_path}/documents.parquet")
    found = {x.doc_id: x for x in QUERIES["op12_repeated_bytes"](spark, str(tmp_path)).collect()}
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found.values()), key=str) == brute_bytes(docs)
    assert all(found[k].text == rows[k].kept.decode() for k in range(1, 7)) and found[5].text == own[5] and found[6].text == ""
    assert hashlib.sha256(rows[8].kept).hexdigest() == found[8].kept_sha256 and found[8].text.endswith(own[6])
    halves = spark.createDataFrame([(bytearray("ä".encode()[1:] + b"x"),)], "kept binary").select(repeated_bytes.kept_text().alias("t")).first().t
    assert halves == "\ufffdx"


# ---------------------------------------------------------------- Merkle manifest
def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(nodes):
    """The levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, k):
    for level in levels[:-1]:
        run = level[k - k % 3 : k - k % 3 + 3]
        yield run[: k % 3], run[k % 3 + 1 :]
        k //= 3


def brute_merkle(rows):
    by = defaultdict(list)
    for row in rows:
        by[row[1]].append((row, brute_leaf(row)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = tree([leaf for _, leaf in by[s]])
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for place, s in enumerate(sources):
        for k, (row, leaf) in enumerate(by[s]):
            steps = [*way(trees[s], k), *way(top, place)]
            found = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                found = brute_leaf((*row[:4], row[4].replace("\n", "")))
            for left, right in steps:
                found = digest(*left, found, *right)
            out.append((row[0], leaf, trees[s][-1][0], top[-1][0], digest(*(x for a, b in steps for x in (*a, *b))), found, found == top[-1][0]))
    return sorted(out, key=str), trees, top


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def proved(spark, rows):
    return sorted((tuple(r[n] for n in NAMES) for r in merkle.verified(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_merkle_of_the_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    assert proved(spark, [tuple(r) for r in d.collect()]) == brute_merkle([tuple(r) for r in d.collect()])[0]


@pytest.mark.parametrize("runs", [1, 7, 150])
def test_merkle_of_many_runs(spark, monkeypatch, runs):
    monkeypatch.setattr(merkle, "WIDTH", 4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", runs)
    rows = [(k, f"s{'x' * (k % 7 == 0)}", "en", k, f"text\n{k}") for k in range(700)] + [(5, None, None, None, None), (None, "", "de", 3, "a\nb"), (None, "ü", "de", 3, "")] + [(9, "same", "en", 1, "one\n")] * 60
    rows += [(k, f"src{k}", "en", 1, "l" * 50_000) for k in range(12)]
    want, trees, top = brute_merkle(rows)
    try:
        assert proved(spark, rows) == want
        if runs == 7:
            got = {(r.tree, r.source, r.level, r.place): r.digest for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()}
            every = {("source", s, n, k): x for s, t in trees.items() for n, level in enumerate(t) if n for k, x in enumerate(level)}
            assert got == every | {("root", None, n, k): x for n, level in enumerate(top) if n for k, x in enumerate(level)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_merkle_of_nothing_and_one(spark):
    assert proved(spark, []) == []
    one = [(2, "a", "en", 1, "x")]
    assert proved(spark, one) == brute_merkle(one)[0]


# ---------------------------------------------------------------- near-duplicates of many repeated rows
def test_near_duplicates_of_rows_that_repeat(spark):
    words = [f"w{k}" for k in range(200)]
    a, b, other = " ".join(words), " ".join([*words[:199], "end"]), " ".join(reversed(words))
    rows = [(1, a)] * 700 + [(2, b)] * 700 + [(3, other)] * 5 + [(4, other + " more")]
    got = {tuple(r) for r in minhash_forest.groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 3, True), (4, 3, False)}


# ---------------------------------------------------------------- longest matches of the benchmark
def brute_longest(text, items):
    """(length, item, place): the longest match of WINDOW words or of a whole shorter item, the first place, the lowest item."""
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    w, best = words(text), (0, None, None)
    for name, item in items:
        v = words(item)
        for p in range(len(w)):
            for s in range(len(v)):
                n = 0
                while p + n < len(w) and s + n < len(v) and w[p + n] == v[s + n]:
                    n += 1
                if n >= 10 or (n == len(v) and s == 0):
                    best = min(best, (-n, p, name), key=lambda x: (x[0], x[1] if x[1] is not None else 1 << 60, x[2] or "")) if best[0] else (-n, p, name)
    return (-best[0], best[2], best[1]) if best[0] else (0, None, None)


def longest(spark, docs, items, **how):
    d = decontaminate.searched(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), **how)
    return {r.doc_id: (r.longest_match, r.longest_item, r.longest_at) for r in d.collect()}


def test_longest_match_is_one_items(spark):
    w = [f"w{k}" for k in range(25)]
    items = [("1", " ".join(w[:12])), ("2", " ".join(w[4:21])), ("3", " ".join(w[11:]))]
    assert longest(spark, [(1, " ".join(["a", *w, "b"]))], items) == {1: (17, "2", 5)}


@pytest.mark.parametrize("how", [{}, {"block_bytes": 200, "shard_chars": 300}])
def test_longest_matches_of_random_overlaps(spark, how):
    r = random.Random(8)
    stream = [f"w{r.randrange(12)}" for _ in range(80)]
    cut = lambda n: (lambda a: " ".join(stream[a : a + n]))(r.randrange(70))
    items = [(f"i{k}", cut(r.choice((3, 6, 11, 14, 30)))) for k in range(12)] + [("i0", cut(20)), ("same", " ".join(stream[:15])), ("also", " ".join(stream[:15]))]
    docs = [(k, " x ".join(cut(r.randrange(1, 40)) for _ in range(3))) for k in range(40)] + [(40, " ".join(stream)), (41, "")]
    assert longest(spark, docs, items, **how) == {k: brute_longest(t, items) for k, t in docs}
