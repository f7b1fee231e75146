"""URL rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that every URL it matches must contain. Pattern rules come in
families: choices of words, one after the other, between an expression for what stands before them and one for what
stands after; each combination of words is a rule of its own, and as no letter or digit can stand beside a word, its
words are whole tokens of every URL that it matches. Each rule is filed under that one of its tokens which the fewest
distinct URLs have; a URL's own tokens fetch candidate rules, and only those run their expressions. Host rules decide first, the longest one wins; URLs without one take the verdict of the
pattern rules: block if any blocking pattern matches that no allowing pattern outweighs, else allow.

Defined results: a null URL, or one without "://", has an empty host and path and no host rule; repeated rows keep
their rows; an empty table gives no rows. Columns other than the id and the URL are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import read, write_cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = "://([^/?#]*)"
PATH = "://[^/?#]*([^?#]*)"
NO_TOKEN = "[^a-z0-9]+"
#: Up to so many rules the index is sent to every task; beyond it is joined by a shuffle on the token.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    kind: str  # host or pattern
    length: int  # of a host rule; the longest wins


#: What may stand before the first word of a family, and after its last one: each lets no letter or digit touch the word.
ANYWHERE, IN_HOST, SEGMENT, EXTENSION = "(^|[^a-z0-9])", "^([^/]*[.])?", "/", "[.]"
ENDS, HOST_DOT, AT_END, SEGMENT_ENDS = "([^a-z0-9]|$)", "[.]", "$", "([/.]|$)"
BETWEEN = "[._/-]"


@dataclass(frozen=True)
class Family:
    """Rules of one name and verdict: every combination of one word of each of `words`."""

    name: str
    verdict: str
    words: tuple[tuple[str, ...], ...]
    before: str = ANYWHERE
    after: str = ENDS
    tail: str = ""  # whatever else follows; it can only narrow the match

    def __post_init__(self) -> None:
        if self.before not in (ANYWHERE, IN_HOST, SEGMENT, EXTENSION) or self.after not in (ENDS, HOST_DOT, AT_END, SEGMENT, SEGMENT_ENDS):
            raise ValueError(f"{self.name}: a word's neighbours must be neither letters nor digits")
        if not self.words or any(not re.fullmatch("[a-z0-9]+", w) for choice in self.words for w in choice) or not all(self.words):
            raise ValueError(f"{self.name}: words are letters a-z and digits")

    def regex(self, words: tuple[str, ...]) -> str:
        return self.before + BETWEEN.join(words) + self.after + self.tail

    def whole(self) -> str:
        """One expression for all of the family."""
        return self.regex(tuple(f"(?:{'|'.join(choice)})" for choice in self.words))

    def rules(self) -> tuple[Rule, ...]:
        return tuple(Rule(self.name, self.verdict, self.regex(w), tuple(dict.fromkeys(w)), "pattern", 0) for w in product(*self.words))


def tokens_of(text: str) -> list[str]:
    return [t for t in re.split(NO_TOKEN, text.lower()) if t]


def host_rule(verdict: str, name: str) -> Rule:
    """name: host, then the start of the path. Whole labels and whole path segments are its literal tokens."""
    host, slash, path = name.partition("/")
    whole = path[: path.rfind("/") + 1]
    return Rule(name, verdict, f"^(?:[^/]*\\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(dict.fromkeys(tokens_of(f"{host}/{whole}"))), "host", len(name))


HOST_RULES = (
    host_rule("allow", "org/"),
    host_rule("block", "example.org/es/"),
    host_rule("block", "example.org/en/1"),
    host_rule("allow", "com/fr/"),
    host_rule("block", "com/de/"),
)
#: Matched against host and path in lower case.
FAMILIES = (
    Family("ad tracker", "block", (("ad", "ads", "adv", "advert"), ("beacon", "click", "pixel", "redirect", "track", "tracker", "tracking"))),
    Family("ad server", "block", (("ads", "adserv", "adserver", "adservice", "advertising", "banner", "banners", "doubleclick", "popads", "sponsors"),), IN_HOST, HOST_DOT),
    Family("tracking call", "block", (("analytics", "beacon", "counter", "metrics", "pixel", "telemetry"), ("collect", "event", "gif", "hit", "js", "log", "png"))),
    Family("login page", "block", (("login", "logout", "signin", "signup", "register", "sso", "resetpassword"),), SEGMENT, SEGMENT_ENDS),
    Family("cart", "block", (("basket", "cart", "checkout", "wishlist"),), SEGMENT, SEGMENT_ENDS),
    Family("archive file", "block", (("7z", "apk", "bz2", "dmg", "exe", "gz", "iso", "msi", "rar", "tar", "xz", "zip"),), EXTENSION, AT_END),
    Family("media file", "block", (("avi", "flac", "mkv", "mov", "mp3", "mp4", "wav", "webm", "wmv"),), EXTENSION, AT_END),
    Family("casino", "block", (("blackjack", "casino", "casinos", "poker", "roulette", "slots", "sportsbook"),)),
    Family("casino offer", "block", (("best", "bonus", "free", "live", "online", "vip"), ("baccarat", "bets", "betting", "bingo", "jackpot", "lottery", "spins"))),
    Family("adult", "block", (("camgirls", "hentai", "nsfw", "porn", "porno", "sexcam", "xxx"),)),
    Family("loan offer", "block", (("cheap", "fast", "instant", "payday"), ("cash", "credit", "loan", "loans"))),
    Family("pill shop", "block", (("buy", "cheap", "online", "order"), ("cialis", "levitra", "pharmacy", "pills", "viagra"))),
    Family("session", "block", (("jsessionid", "phpsessid", "session", "sessionid", "sid"),), SEGMENT, SEGMENT, "[0-9a-f]+"),
    Family("calendar trap", "block", (("agenda", "calendar", "events"),), SEGMENT, SEGMENT, "[0-9]{4}/[0-9]{2}/[0-9]{2}"),
    Family("listing", "block", (("author", "category", "search", "tag", "tags"),), SEGMENT, SEGMENT, "(.*/)?page/[0-9]+"),
    Family("encyclopedia", "allow", (("britannica", "wikibooks", "wikipedia", "wikisource", "wikiversity", "wiktionary"),), IN_HOST, HOST_DOT),
    Family("documentation", "allow", (("docs", "documentation", "manual", "readthedocs", "reference"),), IN_HOST, HOST_DOT),
)
PATTERN_RULES = tuple(r for f in FAMILIES for r in f.rules())


def parts(urls: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    return urls.withColumn("host", F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(url, PATH, 1))


def url_tokens() -> F.Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(F.concat("host", "path")), NO_TOKEN)), "")


def indexed(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """token and rule: each rule under its token that the fewest of urls have; a tie takes the first in order."""
    spark = urls.sparkSession
    table = spark.createDataFrame([(i, r.name, r.verdict, r.regex, list(r.tokens), r.kind, r.length) for i, r in enumerate(rules)], "i int, name string, verdict string, regex string, tokens array<string>, kind string, length int")
    wanted = table.select("i", F.explode("tokens").alias("token"))
    used = wanted.select("token").distinct()
    seen = urls.select(F.explode(url_tokens()).alias("token")).join(F.broadcast(used) if len(rules) <= BROADCAST_RULES else used, "token").groupBy("token").agg(F.count("*").alias("urls"))
    rarest = wanted.join(seen, "token", "left").groupBy("i").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("least")).select("i", F.col("least.token").alias("token"))
    return table.drop("tokens").join(rarest, "i")


def judged(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern for each row of pages. Distinct URLs are judged once."""
    if any(not r.tokens for r in rules):
        raise ValueError("every rule needs a literal token")
    rows = pages.select(F.col("page_id"), F.col("url").cast("string"))
    urls = write_cut(parts(rows.select(F.coalesce("url", F.lit("")).alias("url")).distinct()), "urls")
    index = write_cut(indexed(urls, rules), "rule-index")
    index = F.broadcast(index) if len(rules) <= BROADCAST_RULES else index
    met = urls.select("url", "host", "path", F.explode(url_tokens()).alias("token")).join(index, "token")
    hit = met.where(F.expr("CASE WHEN kind = 'host' THEN concat(host, path) ELSE lower(concat(host, path)) END RLIKE regex"))
    host = F.when(F.col("kind") == "host", F.struct("length", "name", "verdict"))
    pattern = lambda v: F.min(F.when((F.col("kind") == "pattern") & (F.col("verdict") == v), F.col("name")))
    best = hit.groupBy("url").agg(F.max(host).alias("b"), pattern("block").alias("blocks"), pattern("allow").alias("allows"))
    found = write_cut(urls.join(best, "url", "left").select("url", "host", "path", F.col("b.name").alias("rule"), F.col("b.verdict").alias("by_host"), "blocks", "allows"), "verdicts")
    by_pattern = F.when(F.col("blocks").isNotNull() & F.col("allows").isNull(), "block").otherwise("allow")
    out = rows.withColumn("url", F.coalesce("url", F.lit(""))).join(found, "url")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_host", by_pattern).alias("verdict"), F.coalesce("allows", "blocks").alias("pattern"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "pages"))


def _oracle() -> str:
    """Every rule against every URL, without an index."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    hosts = ", ".join(f"({quote(r.name.partition('/')[0])}, {quote('/' + r.name.partition('/')[2])}, {quote(r.name)}, {quote(r.verdict)}, {r.length})" for r in HOST_RULES)
    found = {v: ", ".join(f"CASE WHEN regexp_matches(lower(host || path), {quote(f.whole())}) THEN {quote(f.name)} END" for f in FAMILIES if f.verdict == v) for v in ("block", "allow")}
    return f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{HOST}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{PATH}', 1) AS path FROM pages
), r(h, p, name, verdict, n) AS (VALUES {hosts}),
m AS (
  SELECT u.*, (SELECT max({{'n': n, 'name': name, 'verdict': verdict}}) FROM r WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)) AS b,
    list_min([{found["block"]}]) AS blocks, list_min([{found["allow"]}]) AS allows FROM u
)
SELECT page_id, host, path, b.name AS rule, coalesce(b.verdict, CASE WHEN blocks IS NOT NULL AND allows IS NULL THEN 'block' ELSE 'allow' END) AS verdict, coalesce(allows, blocks) AS pattern FROM m"""


ORACLE = {"op7_url_rules": _oracle()}
