"""URL filters: listed canonical URLs behind a blocked Bloom filter and an exact join, and host/path rules.

Everything here is DataFrame expressions. The Bloom filter is a table of
512-bit blocks: a key's hash names its block and eight bits in it, so a probe
touches one row. Keys whose bits are all set are possible hits; an exact join
with the list removes the false ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

WORDS = 8
#: Bits for each listed key; about one key in a thousand passes by mistake.
BITS_PER_KEY = 16
#: Bytes up to which a filter or a list is broadcast; beyond it both sides are shuffled by key.
BROADCAST_BYTES = 32 << 20


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; null or no `://`: empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; null or no `://`: empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host_col: Column, path_col: Column) -> Column:
    """Scheme, query and fragment go, and so do a leading `www.` of the host and a closing `/` or `.html` of the path."""
    return F.concat(F.regexp_replace(host_col, r"^www\.", ""), F.regexp_replace(path_col, r"(/|\.html)$", ""))


def block_bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The key's block, and for each word of it the bit that the key needs there."""
    return F.pmod(F.xxhash64(key), F.lit(blocks)), [_bit(F.xxhash64(key, F.lit(7)), i) for i in range(WORDS)]


def _bit(second: Column, word: int) -> Column:
    """One bit of a 64-bit word, chosen by six bits of the second hash of its own."""
    place = F.shiftrightunsigned(second, 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of every block that has a key. Null keys take no part."""
    keys = keys.filter(F.col(key).isNotNull())
    block, bits = block_bits(F.col(key), blocks)
    return keys.select(block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)]).groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)])


def listed(df: DataFrame, key: str, keys: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df and a boolean `listed`, in place of a column of that name: whether column `key` is among the values of `keys` (its only column).

    Rows stay as they are, repeated ones too; a null key isn't listed. An empty list lists nothing.
    """
    name, hit = keys.columns[0], unused(df, "hit")
    keys = keys.select(F.col(name).alias("_listed")).filter(F.col("_listed").isNotNull()).distinct()
    size = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_listed")), F.lit(0)).alias("bytes")).first()
    if not size["n"]:
        return df.withColumn("listed", F.lit(False))
    blocks = -(-size["n"] * BITS_PER_KEY // (64 * WORDS))
    filters = bloom(keys, "_listed", blocks)
    exact = keys
    if blocks * (8 + 8 * WORDS) <= broadcast_bytes:
        filters = F.broadcast(filters)
    if size["bytes"] + 16 * size["n"] <= broadcast_bytes:
        exact = F.broadcast(exact)
    block, bits = block_bits(F.col("_key"), blocks)
    probes = df.select(F.col(key).alias("_key")).filter(F.col("_key").isNotNull()).distinct().select("_key", block.alias("block"), *[b.alias(f"_b{i}") for i, b in enumerate(bits)])
    passed = F.lit(True)
    for i in range(WORDS):
        passed = passed & (F.col(f"w{i}").bitwiseAND(F.col(f"_b{i}")) == F.col(f"_b{i}"))
    possible = probes.join(filters, "block").filter(passed).select("_key")
    hits = possible.join(exact, F.col("_key") == F.col("_listed"), "left_semi").select(F.col("_key").alias(hit))
    return df.join(hits, F.col(key) == F.col(hit), "left").withColumn("listed", F.col(hit).isNotNull()).drop(hit)


def rule_for(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits.

    A rule (verdict, host, path) fits its host and all subdomains if the path starts with the rule's.
    Of rules of one length the later host in the alphabet wins.
    """
    rule = verdict = F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host_col == rule_host) | F.endswith(host_col, F.lit("." + rule_host))) & F.startswith(path_col, F.lit(rule_path))
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], blocklist: DataFrame, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict, listed) of every row.

    A rule decides where one fits; else `block` for listed canonical URLs and `allow` for the rest.
    Null, empty and malformed urls have an empty host and path, fit no rule and aren't listed.
    """
    at = pages.select(F.col(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    found = listed(at.withColumn("_url", F.when(F.col("host") != "", canonical(F.col("host"), F.col("path")))), "_url", blocklist)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return found.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


#: The rules of the query, as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Host labels whose pages make up the query's list.
BAD_LABELS = ["casino-win", "adult-x", "spam-farm", "ads-track"]


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    h, p = host(F.col("url")), path(F.col("url"))
    bad = pages.filter(F.exists(F.split(h, r"\."), lambda x: x.isin(BAD_LABELS))).select(canonical(h, p).alias("listed_url"))
    return judge(pages, RULES, bad)


SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), c AS (
  SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '(/|\.html)$', '') AS canonical FROM p
), bad AS (
  SELECT DISTINCT canonical FROM c
  WHERE list_has_any(string_split(host, '.'), ['casino-win', 'adult-x', 'spam-farm', 'ads-track'])
), r AS (
  SELECT c.*, host <> '' AND canonical IN (SELECT canonical FROM bad) AS listed,
    CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule
  FROM c
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM r
"""
