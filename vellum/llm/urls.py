"""URL filter: suffix rules first, then a blocked Bloom filter in front of an exact hash join with a list of URLs.

Everything is a DataFrame expression. A URL's look-ups are its host and every parent domain
joined with its path at every slash, and once with its query. Look-ups probe the filter, whose blocks are one 64-bit
word each; what passes meets the list in a hash join, which removes the false positives. Rows without a hit never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host and path, verdict): the rules of the contract.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Sites that the production query lists, under each of the top-level domains; an entry covers its host's subdomains and
#: everything below its path. Further lists come as tables.
SITES, TOPS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"), ("com", "net", "org")
LISTED = tuple(f"{site}.example.{top}" for site in SITES for top in TOPS)
#: Query parameters that don't change what a URL shows.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: Bits of the filter for each listed URL, bits set by each, and the most blocks that are broadcast (16 bytes each).
BITS_PER_URL, PROBES, BROADCAST_BLOCKS = 16, 4, 1 << 20


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """The query's parameters without tracking ones, sorted; empty without ://."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.filter(F.split(raw, "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING))
    return F.array_join(F.array_sort(kept), "&")


def lookups(url: Column, depth: Column | int, labels: Column | int) -> Column:
    """Canonical forms under which a URL may be listed; those deeper or longer than any listed one are left out."""
    labels_of = F.filter(F.split(host_of(url), r"\.", -1), lambda x: x != "")
    steps = F.filter(F.split(path_of(url), "/", -1), lambda x: x != "")
    n = F.size(labels_of)
    most = F.least(n, F.lit(labels) if isinstance(labels, int) else labels)
    hosts = F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), most)), lambda k: F.array_join(F.slice(labels_of, n - k + 1, k), ".")))
    cut = F.least(F.size(steps), F.lit(depth) if isinstance(depth, int) else depth)
    paths = F.transform(F.sequence(F.lit(0), cut), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    full = F.when(query_of(url) != "", F.array(F.concat(F.array_join(steps, "/"), F.lit("?"), query_of(url)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(F.concat(paths, full), lambda p: F.concat(h, F.lit("/"), p)))))


def canonical(url: Column) -> Column:
    """The one form under which a URL goes on the list: scheme, www., fragment, tracking and empty steps removed."""
    whole = F.when(F.instr(url, "://") > 0, url).otherwise(F.concat(F.lit("http://"), url))
    steps = F.array_join(F.filter(F.split(path_of(whole), "/", -1), lambda x: x != ""), "/")
    query = F.when(query_of(whole) != "", F.concat(F.lit("?"), query_of(whole))).otherwise(F.lit(""))
    return F.concat(F.regexp_replace(host_of(whole), r"^www\.|\.$", ""), F.lit("/"), steps, query)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null without one. Of equally long ones the first in order wins."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        site, _, rest = text.partition("/")
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def bloom_probe(key: Column, blocks: int) -> tuple[Column, Column]:
    """(block, mask of PROBES bits within the block's 64) of a key."""
    h = F.xxhash64(F.lit(1), key)
    mask = F.lit(0).cast("long")
    for k in range(PROBES):
        bit = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.pmod(F.xxhash64(F.lit(2), key), F.lit(blocks)), mask


def listed_hits(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """The distinct URLs (column url) that are on the list (column url), through filter and exact join."""
    keys = listed.select(canonical(F.col("url")).alias("key")).where("key is not null").distinct()
    size = keys.agg(F.count("*").alias("n"), F.max(F.size(F.split("key", "/"))).alias("d"), F.max(F.size(F.split(F.split("key", "/")[0], r"\."))).alias("l")).first()
    if not size["n"]:
        return urls.select("url").limit(0)
    blocks = max(64, size["n"] * BITS_PER_URL // 64)
    at, mask = bloom_probe(F.col("key"), blocks)
    bloom = keys.select(at.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("bits"))
    bloom = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom
    probes = urls.select("url", F.explode(lookups(F.col("url"), size["d"], size["l"])).alias("key"))
    probes = probes.select("url", "key", at.alias("block"), mask.alias("mask"))
    maybe = probes.join(bloom, "block").where("(bits & mask) = mask").select("url", "key")
    return maybe.join(keys, "key").select("url").distinct()


def judge_urls(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and listed of each row of pages.

    A fitting rule decides; otherwise a URL is blocked if it is listed. Null URLs and URLs without :// have empty host
    and path and are allowed. Rows that repeat stay. Other columns of pages are not read. Empty tables give empty results.
    """
    own = pages.select("page_id", "url")
    hits = listed_hits(own.select("url"), listed.select("url")).select(F.col("url").alias("hit"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (
        own.join(hits, F.col("url") == F.col("hit"), "left")
        .select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("hit").isNotNull().alias("listed"))
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
    )
