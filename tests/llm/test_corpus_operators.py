"""op5 to op10 and the pipeline: brute force, round trips, held-out accuracy, edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from quartzfolio.llm import bpe, chat_format, minhash_forest, pieces, quality_classifier, quality_rules, token_files, url_filter
from quartzfolio.llm.common import written

from .conftest import SF

SCHEMA = "doc_id long, text string"
ODD = [(10**6, None), (10**6 + 1, ""), (None, "b"), (10**6 + 2, "<|endoftext|> hi"), (10**6 + 3, "aaaa " * 500 + "-" * 700), (10**6 + 4, "don't we'll 'tis ''s x 's  's\n's it'lll  \n\n a\t\tb \n")]


def test_classifier(spark):
    sf = SF.replace("0.001", "0.01")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_classifier.fitted(d, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality_classifier.scored(d, model).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    odd = quality_classifier.scored(spark.createDataFrame(ODD, SCHEMA), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert quality_classifier.scored(spark.createDataFrame([], SCHEMA), model).count() == 0 and quality_classifier.fitted(spark.createDataFrame([], SCHEMA), labels) is None
    assert {r.score for r in quality_classifier.classified(spark.createDataFrame(ODD, SCHEMA), labels.limit(0)).collect()} == {0.5}


def test_attention_gradient():
    r = np.random.default_rng(2)
    x, first, y = r.normal(size=(9, quality_classifier.N_FEATURES)), np.array([0, 2, 6]), np.array([1.0, 0.0, 1.0])
    m = quality_classifier.Model(x.mean(0), x.std(0) + 1)
    loss = lambda: -np.mean(np.where(y == 1, np.log(p := m.forward(x, first)[0]), np.log(1 - p)))
    for k, g in m.gradients(x, first, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        m.w[k][at] += 1e-5
        up = loss()
        m.w[k][at] -= 2e-5
        assert (up - loss()) / 2e-5 == pytest.approx(g[at], rel=1e-3)
        m.w[k][at] += 1e-5


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    sets, of = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    where, common = collections.defaultdict(list), collections.Counter()
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for ids in where.values():
        common.update((a, b) for k, b in enumerate(ids) for a in ids[:k])
    for (a, b), n in common.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            of[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_minhash(spark, texts):
    rng, vocabulary = random.Random(1), [f"w{i}" for i in range(3000)]
    hub = [rng.choice(vocabulary) for _ in range(140)]
    rows = [*texts.items(), (10**6, ""), (10**6 + 1, None), (10**6 + 2, "x y z"), (10**6 + 3, "X y  Z")]
    for k in range(250):  # a hub whose copies link with it, but not all with one another
        copy = list(hub)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append((10**6 + 10 + k, " ".join(copy)))
    for k in range(20):  # a chain
        hub[rng.randrange(140)] = rng.choice(vocabulary)
        rows.append((10**6 + 500 + k, " ".join(hub)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_forest.groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == components(rows)
    edge = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (5, "a b c d e f"), (9, "p q r s t u v"), (9, "k l m n o p q"), (8, "p q r s t u v")], SCHEMA)
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash_forest.groups(edge).collect()) == [(-1, -1, True), (5, 5, True), (7, 5, False), (8, 8, True), (9, 8, False), (9, 8, False)]
    assert sorted(r.doc_id or -1 for r in minhash_forest.representatives(edge).collect()) == [-1, 5, 8]
    assert minhash_forest.groups(edge.limit(0)).count() == 0
    odd = edge.selectExpr("*", "1 AS _gone", "doc_id AS `a.b`", "2 AS row")
    assert minhash_forest.representatives(odd).columns == odd.columns and minhash_forest.representatives(odd).count() == 3


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_bpe(spark, docs, encoding):
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(ODD, SCHEMA))
    want = collections.Counter()
    for r in d.collect():
        ids = encoding.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in bpe.encoded(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()) == want


def test_pieces(encoding):
    import regex

    assert pieces.KNOWN == public_tokenizers.PATTERN
    rng, memo = random.Random(5), bpe._memo(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    lots = ["".join(rng.choice(" \n\t'srtvemld1aÉ.,² ") for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["", "'", "  ", "a"]
    joined, first, last, _, count = memo.pieces(lots)
    assert [joined[a:b] for a, b in zip(first, last, strict=True)] == [p for t in lots for p in regex.findall(public_tokenizers.PATTERN, t)]
    ids, data = memo(lots)
    assert [x.tolist() for x in ids] == [encoding.encode_ordinary(t) for t in lots] and [x.tobytes().decode() for x in data] == lots


def test_pieces_whose_hashes_meet(encoding, monkeypatch):
    memo = bpe._memo(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    memo.forget()
    plain = memo.pieces
    monkeypatch.setattr(memo, "pieces", lambda texts: (*(r := plain(texts))[:3], r[3] & np.uint64(7), r[4]))
    for lots in (["one two three four five", "six"], ["seven eight two one", "nine one"]):
        assert [x.tolist() for x in memo(lots)[0]] == [encoding.encode_ordinary(t) for t in lots]
    memo.forget()


def test_token_files(spark, docs):
    of = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    of.encode_special_tokens = True
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(ODD, SCHEMA))
    want, at = [], 0
    for i, t in sorted(((r.doc_id, r.text or "") for r in d.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*of.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.round_trip(d, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == want
    assert token_files.round_trip(d.limit(0), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 0


def test_grammar():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 30, 500), np.tile([5, 5, 5, 6], 200), np.zeros(300, int)])
    last = np.zeros(len(x), bool)
    last[[99, 700, len(x) - 1]] = True
    y, ends, rules = token_files.compress(x.astype(np.uint32), last.copy(), 1000)
    assert len(y) < len(x) / 2 and token_files.expand(y, rules, 1000).tolist() == x.tolist()
    assert token_files.expand(y[: np.flatnonzero(ends)[0] + 1], rules, 1000).tolist() == x[:100].tolist()
    assert token_files.expand_all(y.astype(np.int64), rules, token_files.expansion_lengths(rules, 1000), 1000).tolist() == x.tolist()
    pairs = collections.Counter(zip(y[:-1][~ends[:-1]].tolist(), y[1:][~ends[:-1]].tolist()))
    assert max(n for (a, b), n in pairs.items() if a != b) < token_files.LEAST
    wide = token_files.compress(x.astype(np.uint32) + 70_000, last.copy(), 100_000)
    assert token_files.width_of(100_000) == 4 and token_files.expand(wide[0], wide[2], 100_000).tolist() == (x + 70_000).tolist()
    with pytest.raises(ValueError):
        token_files.width_of(1 << 31)


def test_chat(spark):
    rows = [(1, 0, "user", "a\\b\\q<s>[ROLE]"), (1, 1, None, None), (1, 2, "[INST]x", "[/INST]</s>\n"), (2, 0, "user", "[/INST]"), (3, 0, "user", "[/INST"), (None, None, "a", "\\l"), (4, 5, "assistant", "b"), (4, 5, "assistant", "a"), *((5, k, "assistant", f"t{k}") for k in range(300))]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.formatted(d).collect()}
    assert len(got) == 6 and all(r.turns == r.source for r in got.values())
    assert [t.text for t in got[5].turns] == [f"t{k}" for k in range(300)] and [t.text for t in got[4].turns] == ["a", "b"]
    assert got[2].output == "<s>[ESC]user[INST]\\q/INST][/INST]</s>\n"
    loss = {r.conv_id: r for r in chat_format.digests(chat_format.with_extra(d)).collect()}
    assert loss[-1].loss_chars == 21 and loss[4].loss_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert chat_format.digests(d.limit(0)).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/x?y#z", "https://www.example.com/en/", "ftp://a.net/es/1", "http://net/fr/", "http://anet/fr/", "x://m.com", "http://cheap-pills.org/", "http://a.org/path://b?c"]
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")).collect()}
    assert [got[i].rule for i in range(len(urls))] == [None, None, None, "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, None, None]
    assert [got[i].verdict for i in (3, 4, 5, 9, 10)] == ["block", "allow", "block", "block", "allow"]
    assert (got[10].host, got[10].path) == ("a.org", "/path://b")
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert sum(r.page_id == 1 for r in url_filter.judged(spark.createDataFrame([(1, "http://a.org/ads/"), (1, "http://a.org/ads/"), (2, None)], "page_id long, url string")).filter("verdict = 'block'").collect()) == 2


def test_url_patterns(spark):
    """Every pattern of the table blocks its example and leaves its neighbour."""
    cases = {
        "numbered mirror": ("http://mirror-12.a.org/x", "http://mirror.a.org/x"),
        "calendar day": ("http://a.org/calendar/2024/5/", "http://a.org/calendar/help"),
        "month of events": ("http://a.org/events/2024-05", "http://a.org/events/fair"),
        "calendar by query": ("http://a.org/c?year=2024&month=5", "http://a.org/c?year=2024"),
        "session in path": ("http://a.org/x;jsessionid=0123456789ABCDEF", "http://a.org/jsessionid"),
        "session in query": ("http://a.org/x?a=1&PHPSESSID=abcdef12", "http://a.org/x?sessions=abcdef12"),
        "campaign": ("http://a.org/x?utm_source=f&utm_medium=m#z", "http://a.org/x?utm_source=feed"),
        "page by referrer": ("http://a.org/x?page=2&ref=x", "http://a.org/x?page=2#?page=2&ref=x"),
        "deep page": ("http://a.org/x?page=100", "http://a.org/x?page=99"),
        "page of a tag": ("http://a.org/tag/b/page/3", "http://a.org/tag/b"),
        "sorted listing": ("http://a.org/x?sort=price&order=asc", "http://a.org/x?sort=price"),
        "print view": ("http://a.org/x?print=1", "http://a.org/x?print=house"),
        "affiliate": ("http://a.org/x?affid=9", "http://a.org/x?id=9"),
        "click through": ("http://a.org/x?url=http%3A%2F%2Fb", "http://a.org/x?url=b"),
        "plugin file": ("http://a.org/wp-content/plugins/p/x.css", "http://a.org/wp-content/x.css"),
        "reply form": ("http://a.org/x?replytocom=7", "http://a.org/x?comment=7"),
    }
    assert set(cases) == set(url_filter.PATTERNS)
    urls = [u for pair in cases.values() for u in pair] + ["http://a.org?x", "x://?utm_source=a&utm_medium=b"]
    got = {r.page_id: r.verdict for r in url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i] for i in range(len(urls))] == ["block", "allow"] * len(cases) + ["allow", "block"]


def test_url_rules_need_no_whole_token(spark):
    """Any rule equals its own pattern run over every URL."""
    rules = [("x.com/pro", r"^x\.com/pro", "x.com/pro"), ("é", "é", "/é/"), ("shop", r"/shop/[a-z]+s$", "/shop/"), ("a.b", r"^a\.b", "a.b"), ("end", r"end$", "end"), ("(x|y)-z", r"[xy]-z-", "-z-")]
    urls = ["http://x.com/products", "http://x.com/pro", "http://a.org/é/x", "http://s.org/shop/bags", "http://a.bc/", "http://weekend", "http://q.org/x-z-1", "http://ax.com/pro", "http://s.org/shops/bags", "http://b.org/é"]
    table = spark.createDataFrame([("block", r, p, len(r), x, True) for r, p, x in rules], "verdict string, rule string, pattern string, size int, literal string, listed boolean")
    got = {r.page_id: r.rule for r in url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), table).collect()}
    for i, u in enumerate(urls):
        fits = [(-len(r), r) for r, p, _ in rules if re.search(p, u.split("://")[1])]
        assert got[i] == (min(fits)[1] if fits else None), u
    none = table.limit(0)
    assert {r.verdict for r in url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), none).collect()} == {"allow"}


@pytest.mark.parametrize(("percent", "trees"), [(85, 16), (80, 23)])
def test_minhash_losses(percent, trees):
    forest, n = minhash_forest.Forest(percent), trees * minhash_forest.LENGTH
    below = lambda n, least: sum(math.comb(n, k) * (percent / 100) ** k * (1 - percent / 100) ** (n - k) for k in range(least))
    a = np.arange(n)
    kept = [k for k in range(n + 1) if minhash_forest._likely(np.array([100]), 100, np.where(a < k, a, -1)[None], a, forest)[0]]
    assert forest.trees == trees and kept == list(range(kept[0], n + 1))
    miss = (1 - (percent / 100) ** minhash_forest.DEPTH) ** trees
    assert below(n, kept[0]) < miss / 50
    share = math.ceil(256 * (percent / 100 - minhash_forest.SLACK * math.sqrt(forest.variance / 256)))
    assert miss + below(n, kept[0]) + below(256, share) < 8e-6


def test_near_duplicates_of_the_pipeline(spark, texts):
    rng = random.Random(3)
    rows, between = list(texts.items()), 0
    for k in range(300):
        one = [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(60, 900))]
        other, n = list(one), round(len(one) * rng.uniform(0.1, 0.26) / 5 / 1.4)
        for at in rng.sample(range(len(one)), max(n, 1)):
            other[at] = "other"
        rows += [(10**6 + 2 * k, " ".join(one)), (10**6 + 2 * k + 1, " ".join(other))]
    sets, where, common = {i: shingles(t) for i, t in rows}, collections.defaultdict(list), collections.Counter()
    for i, s in sorted(sets.items()):
        for x in s:
            where[x].append(i)
    for ids in where.values():
        common.update((a, b) for k, b in enumerate(ids) for a in ids[:k])
    of = {i: i for i in sets}
    for (a, b), n in common.items():
        union = len(sets[a]) + len(sets[b]) - n
        between += 80 * union <= 100 * n < 85 * union
        if 100 * n >= 80 * union and of[a] != of[b]:
            low, high = sorted((of[a], of[b]))
            of = {i: low if c == high else c for i, c in of.items()}
    assert between > 30
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, c in of.items() if i == c)


def test_crowded_region_in_blocks(spark, monkeypatch):
    """Regions that the candidates leave open are compared block by block."""
    monkeypatch.setattr(minhash_forest, "BLOCK", 8)
    monkeypatch.setattr(minhash_forest, "CROWDED", 4)
    rng, shared = random.Random(4), [f"s{i}" for i in range(60)]
    rows = []
    for k in range(60):  # a common half, so that minima meet, and small groups that link
        own = [f"o{k // 3}x{i}" for i in range(45)]
        own[rng.randrange(45)] = f"v{k}"
        rows.append((k, " ".join(shared + own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_forest.groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == components(rows)


def test_pipeline_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, _gone int, row string"
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(70))
    rows = [(1, None, "en", "s", 0, 1, 1, "r"), (2, "", None, None, None, 1, 1, "r"), (3, words(3), "en", "s", 5, 1, 1, "r"), (3, words(4), "en", "s", 5, 1, 1, "r"), (None, words(5), "en", "s", 5, 1, 1, "r"), (7, f"{words(3)}\n{words(8)}\n{words(9)}", "en", "s", 5, 1, 1, "r"), (8, words(3), "en", "s", 5, 1, 1, "r")]
    d = spark.createDataFrame(rows, schema)
    step = d
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = written(stage(spark, step, SF), "step")
        assert step.dtypes == d.dtypes
    assert sorted((r.doc_id or 0, len(r.text.split()), r.n_chars == (5 if r.doc_id != 7 else len(r.text))) for r in step.collect()) == [(0, 70, True), (3, 70, True), (3, 70, True), (7, 140, True)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, d.limit(0), SF).count() == 0, k


def test_pipeline(spark, docs, encoding):
    names = docs.columns
    step, sizes = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = written(stage(spark, step, SF), "step")
        assert step.columns == names
        sizes.append(step.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    kept = {r.doc_id for r in quality_rules.judged(docs).filter("kept").collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    left = {r.doc_id: r.text for r in step.collect()}
    assert set(got) == set(left) <= kept
    assert all(got[i].n_tokens == len(encoding.encode_ordinary(t or "")) for i, t in left.items())
    assert not [i for i, (_, c) in components(list(left.items())).items() if c != i]
