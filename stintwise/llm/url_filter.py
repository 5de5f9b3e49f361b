"""URL filter (DataFrame functions only): host and path rules, then a blocked
Bloom filter of listed canonical URLs in front of an exact hash join.

The filter is a table of blocks: 512 bits as eight longs, one bit set per
long and listed URL. It has at most ``MAX_BLOCKS`` blocks (72 bytes each as a
row), which bounds its broadcast whatever the list's length; a longer list
only lets more URLs through to the exact join, whose rows alone decide.

Defined results: a null url or one without ``://`` has an empty host and path,
fits no rule, is on no list, and is allowed; repeated pages are judged each;
empty tables and lists give no row and no block verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

WORDS, BITS_PER_URL, MAX_BLOCKS = 8, 16, 1 << 17
#: Host labels whose pages make up the block list of the registered query.
LISTED_LABELS = ("casino", "spam")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# fixed values of the registered query's contract
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"),
         Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_TRACKING = r"(^|&)(utm_[a-z]+|ref)=[^&]*"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path without trailing slashes, and the query without tracking
    parameters; no scheme and no fragment. Empty if there is no host."""
    query = F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, _TRACKING, ""), r"^&", "")
    whole = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""),
                     F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host_of(url) == "", "").otherwise(F.coalesce(whole, F.lit("")))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as (name, verdict), else null. The rules are a
    short list of literals; long lists of URLs go through the filter."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def _masks(url: Column) -> list[Column]:
    h = F.xxhash64(url, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"),
                            F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int"))
            for i in range(WORDS)]


def block_count(listed_rows: int) -> int:
    need, n = listed_rows * BITS_PER_URL / 512, 64
    while n < need and n < MAX_BLOCKS:
        n *= 2
    return n


def bloom_table(listed: DataFrame, blocks: int, url: str = "canonical") -> DataFrame:
    """(block, w0..w7): the filter's blocks that hold any bit."""
    rows = listed.select(_block(F.col(url), blocks).alias("block"),
                         *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(url)))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def flag_listed(urls: DataFrame, listed: DataFrame, url: str = "canonical") -> DataFrame:
    """``urls`` with ``listed``, exact. The filter passes possible hits; only
    these are shuffled and meet the distinct list in a hash join, which removes
    false positives. All other rows are done where they are."""
    listed = listed.select(F.col(url)).where(F.col(url) != "").distinct()
    blocks = block_count(listed.count())
    bloom = F.broadcast(bloom_table(listed, blocks, url))
    probe = urls.withColumn("_block", _block(F.col(url), blocks))
    probe = probe.join(bloom.withColumnRenamed("block", "_block"), "_block", "left")
    maybe = F.lit(True)
    for i, m in enumerate(_masks(F.col(url))):
        maybe = maybe & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(m) != 0)
    probe = probe.withColumn("_maybe", maybe).drop("_block", *[f"w{i}" for i in range(WORDS)])
    exact = listed.withColumn("_hit", F.lit(True)).hint("shuffle_hash")
    hits = probe.where("_maybe").join(exact, url, "left").withColumn("listed", F.coalesce("_hit", F.lit(False)))
    misses = probe.where(~F.col("_maybe")).withColumn("listed", F.lit(False))
    return hits.drop("_hit", "_maybe").unionByName(misses.drop("_maybe"))


def judge(pages: DataFrame, listed: DataFrame, key: str = "page_id", rules=RULES) -> DataFrame:
    """One row per page: rule verdict, else block if the canonical URL is
    listed, else allow."""
    rows = pages.select(key, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                        canonical(F.col("url")).alias("canonical"))
    rows = rows.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    ruled = rows.where(F.col("_r").isNotNull()).withColumns(
        {"verdict": F.col("_r.verdict"), "listed": F.lit(None).cast("boolean")})
    judged = flag_listed(rows.where(F.col("_r").isNull()), listed)
    judged = judged.withColumn("verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    cols = [key, "host", "path", F.col("_r.rule").alias("rule"), "verdict", "canonical", "listed"]
    return ruled.select(*cols).unionByName(judged.select(*cols))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url; the list is the canonical URLs of pages on hosts with
    a label word of ``LISTED_LABELS``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    words = "|".join(LISTED_LABELS)
    listed = (pages.where(host_of(F.col("url")).rlike(rf"(^|[.-])({words})([.-]|$)"))
              .select(canonical(F.col("url")).alias("canonical")))
    return judge(pages, listed)


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') u,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) path FROM pages),
q AS (
  SELECT *, regexp_replace(regexp_replace(regexp_extract(u, '^[^#?]*\?([^#]*)', 1),
              '(^|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&', '') query FROM p),
c AS (
  SELECT page_id, host, path, CASE WHEN host = '' THEN '' ELSE host || regexp_replace(path, '/+$', '')
      || CASE WHEN query <> '' THEN '?' || query ELSE '' END END canonical FROM q),
rules(rh, rp, rule, rv) AS (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
  ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')),
fit AS (
  SELECT page_id, arg_max(rule, length(rule)) rule, arg_max(rv, length(rule)) rv
  FROM (SELECT DISTINCT page_id, host, path FROM c) JOIN rules
    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path),
listed AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '(^|[.-])(casino|spam)([.-]|$)') AND canonical <> '')
SELECT c.page_id, c.host, c.path, fit.rule,
  CASE WHEN fit.rule IS NOT NULL THEN fit.rv WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END verdict,
  c.canonical, CASE WHEN fit.rule IS NULL THEN listed.canonical IS NOT NULL END listed
FROM c LEFT JOIN fit USING (page_id) LEFT JOIN listed ON listed.canonical = c.canonical"""
