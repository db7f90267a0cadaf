"""URL filters: pattern rules found by their rarest literal token (DataFrame functions only).

A rule is a regular expression over host, path and query with its literal text. `rule_index` splits
that text into tokens, counts in how many URLs each of them occurs, and files the rule under the
rarest. Only tokens that the literal bounds on both sides count: the literal `shop/pro` has the
token `shop` after a bound, but `pro` may go on in a URL (`products`). A rule without such a
token is filed under the empty one, which every URL has. A URL's tokens are looked up in that
index; only the rules found so run their regular expression on it. Among fitting rules the
longest wins, then a listed one, then the lower rule text.

The lookup is an equi-join on the token. A rule table of at most `BROADCAST_BYTES` is
broadcast after its bytes have been summed; a larger one is joined by a shuffle, its hot
tokens split by adaptive execution. A URL is judged once however often it occurs.

Edge cases: a null URL or one without `://` has an empty host and path, fits no rule and is
allowed; equal rows are judged alike and all returned; an empty page or rule table works; other
columns of the pages are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contract: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The method's own rules where none of the contract's fits: a token of the host, a folder of the path, or a
#: pattern of several tokens with texts that all its matches hold.
HOST_WORDS = (
    "casino", "poker", "betting", "jackpot", "escort", "porn", "porno", "xxx", "adult", "camgirls", "pills", "viagra", "cialis",
    "pharmacy", "spam", "warez", "torrent", "torrents", "keygen", "doubleclick", "adserver", "clickbait", "replica", "payday",
)
FOLDERS = ("cgi-bin", "wp-admin", "wp-login.php", "adserver", "ads", "doorway", "redirect", "xmlrpc.php")
PATTERNS = {
    "numbered mirror": (r"^(?:[^/?]*[.-])?mirror-[0-9]+\.", " mirror-"),
    "calendar day": (r"/calendar/[0-9]{4}/[0-9]{1,2}(?:[/?]|$)", "/calendar/"),
    "month of events": (r"/events/[0-9]{4}-[0-9]{2}", "/events/"),
    "calendar by query": (r"\?(?:.*&)?(?:year=[0-9]+&month=|month=[0-9]+&year=)", "&month=&year="),
    "session in path": (r"(?i);jsessionid=[0-9a-f]{16}", ";jsessionid="),
    "session in query": (r"(?i)[?&]phpsessid=[0-9a-z]{8}", "?phpsessid="),
    "campaign": (r"[?&]utm_source=[^&]*&(?:.*&)?utm_(?:medium|campaign)=", "?utm_source="),
    "page by referrer": (r"[?&]page=[0-9]+&(?:.*&)?ref=", "?page=&ref="),
    "deep page": (r"[?&]page=[0-9]{3}", "?page="),
    "page of a tag": (r"/tag/[^/?]+/page/[0-9]+(?:[/?]|$)", "/tag/ /page/"),
    "sorted listing": (r"[?&]sort=[a-z_]+&(?:.*&)?order=(?:asc|desc)", "?sort=&order="),
    "print view": (r"[?&]print=(?:1|true|yes)(?:&|$)", "?print="),
    "affiliate": (r"[?&]affid=[0-9a-z]+", "?affid="),
    "click through": (r"(?i)[?&]url=https?(?::|%3a)", "?url="),
    "plugin file": (r"/wp-content/plugins/[^/?]+/", "/wp-content/plugins/"),
    "reply form": (r"[?&]replytocom=[0-9]+", "?replytocom="),
}
BROADCAST_BYTES = 8_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TOKEN, _BOUND = "[^a-z0-9]+", "[^a-z0-9]"
#: Patterns over host, path and, where there is a query, ? and query; `{}` is a quoted word.
HOST_PATTERN = r"^(?:[^/?]*[^a-z0-9/?])?{}(?:[^a-z0-9/?][^/?]*)?(?:[/?]|$)"
FOLDER_PATTERN = r"^[^?]*/{}(?:[/?]|$)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    after = F.substring_index(url, "://", 1)
    return F.regexp_extract(F.substr(url, F.length(after) + 4), r"(?s)^[^?#]*\?([^#]*)", 1)


def method_rules() -> list[tuple[str, str, str]]:
    """(rule, pattern, literal) of the method's own rules, all of which block."""
    quoted = lambda w: w.replace(".", r"\.")
    words = [(f"*{w}*", HOST_PATTERN.format(quoted(w)), f" {w} ") for w in HOST_WORDS] + [(f"*/{w}/", FOLDER_PATTERN.format(quoted(w)), f"/{w}/") for w in FOLDERS]
    return words + [(name, pattern, literal) for name, (pattern, literal) in PATTERNS.items()]


def contract_rules(spark: SparkSession) -> DataFrame:
    """The contract's rules and the method's as patterns over host, path and query, with their literal text.

    The blank before a host and after it stands for the bounds of its labels.
    """
    rows = [(v, f"{h}{p}", rf"^(?:[^/?]*\.)?\Q{h}{p}\E", len(h) + len(p), f" {h} {p}", True) for v, h, p in RULES]
    rows += [("block", rule, pattern, 0, literal, False) for rule, pattern, literal in method_rules()]
    names = ("verdict", "rule", "pattern", "size", "literal", "listed")
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(names, r, strict=True))) for r in rows))))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), _TOKEN), ""))


def bounded_tokens(literal: Column) -> Column:
    """The tokens of a literal that have a bound before and behind them; the empty one where there is none."""
    inner = F.regexp_replace(F.regexp_replace(F.lower(literal), "^[a-z0-9]+", ""), "[a-z0-9]+$", "")
    found = _tokens(inner)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """The rules with `token`, the one of their bounded tokens in the fewest URLs."""
    held = rules.select("rule", "pattern", F.explode(bounded_tokens(F.col("literal"))).alias("token"))
    seen = _with_rules(urls.select(F.explode("tokens").alias("token")), held.select("token").filter("token != ''").distinct()).groupBy("token").agg(F.count("*").alias("n"))
    rarest = held.join(seen, "token", "left").groupBy("rule", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("best"))
    return rules.join(rarest.select("rule", "pattern", F.col("best.token").alias("token")), ["rule", "pattern"])


def _with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    size = rules.agg(F.sum(sum(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in rules.columns))).first()[0] or 0
    return urls.join(F.broadcast(rules) if size <= BROADCAST_BYTES else rules, "token")


def judged(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    rules: verdict, rule, pattern, size, literal, listed (whether its name is returned).
    """
    rules = contract_rules(pages.sparkSession) if rules is None else rules
    d = pages.select("page_id", F.col("url").alias("_url"))
    urls = d.select("_url").filter(F.col("_url").contains("://")).distinct()
    urls = urls.select("_url", F.concat(host_of(F.col("_url")), path_of(F.col("_url")), F.regexp_replace(query_of(F.col("_url")), "(?s)^(?=.)", "?")).alias("subject"))
    urls = urls.withColumn("tokens", _tokens(F.col("subject")))
    index = rule_index(rules, urls)
    every = F.array_append("tokens", F.lit("")) if not index.filter("token = ''").isEmpty() else F.col("tokens")
    found = _with_rules(urls.select("_url", "subject", F.explode(every).alias("token")), index)
    fits = found.filter(F.expr("subject RLIKE pattern"))
    best = fits.groupBy("_url").agg(F.min(F.struct(F.expr("-size"), F.expr("NOT listed"), "rule", "verdict", "listed")).alias("b"))
    return d.join(best, "_url", "left").select(
        "page_id",
        F.coalesce(host_of(F.col("_url")), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col("_url")), F.lit("")).alias("path"),
        F.expr("CASE WHEN b.listed THEN b.rule END").alias("rule"),
        F.coalesce("b.verdict", F.lit("allow")).alias("verdict"),
    )
