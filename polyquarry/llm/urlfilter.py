"""URL rules: a blocked Bloom filter passes possible hits to an exact hash join.

Main path in DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyquarry.llm.common import boxed, cut, quoted, table, values

#: host, path, verdict. Fixed values of the registered query.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without ``://`` or null: empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; without ``://`` or null: empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


class BlockedBloom:
    """A Bloom filter whose bits for one key all lie in one 64-bit block.

    It grows with the list up to ``max_blocks`` (8 bytes each, 2 MB): 16 bits a key up to a million keys, 8 up to two. A longer
    list makes more false positives, which the exact join removes; with many millions of keys nearly all candidates pass, and what
    is left is the shuffled exact join, since a filter too large for one worker would have to be met by such a shuffle too.
    """

    def __init__(self, words: dict[int, int], blocks: int, probes: int):
        self.words, self.blocks, self.probes = words, blocks, probes

    @staticmethod
    def _block(key: Column, blocks: int) -> Column:
        return F.pmod(F.shiftright(F.xxhash64(key), 32), F.lit(blocks)).cast("int")

    @staticmethod
    def _mask(key: Column, probes: int) -> Column:
        """``probes`` bits of a block, six bits of a second hash for each."""
        h, mask = F.xxhash64(key, F.lit(1)), F.lit(0).cast("long")
        for i in range(probes):
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
        return mask

    @classmethod
    def build(cls, keys: DataFrame, column: str, count: int, bits_per_key: int = 16, probes: int = 6, max_blocks: int = 1 << 18) -> BlockedBloom:
        blocks = max(1, min(max_blocks, -(-count * bits_per_key // 64)))
        words = keys.groupBy(cls._block(F.col(column), blocks).alias("block")).agg(F.bit_or(cls._mask(F.col(column), probes)).alias("word")).collect()
        return cls({r.block: r.word for r in words}, blocks, probes)

    def may_hold(self, key: Column) -> Column:
        # one string literal that is folded to an array of longs, instead of a literal for each block
        words = F.split(F.lit(",".join(str(self.words.get(i, 0)) for i in range(self.blocks))), ",").cast("array<bigint>")
        word, mask = F.get(words, self._block(key, self.blocks)), self._mask(key, self.probes)
        return word.bitwiseAND(mask) == mask


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    default: str = "allow",
    broadcast_rules: int = 50_000,
) -> DataFrame:
    """``pages`` with host, path, the longest fitting rule and the verdict.

    ``rules``: host, path, verdict. A rule fits its host and all subdomains if the URL's path starts with the
    rule's. Each URL offers (suffix of its host) + (prefix of its path), prefixes only of lengths that some
    rule has; the Bloom filter drops nearly all of these, the rest meets the rules in an exact hash join.
    Nothing listed: rule null and verdict ``default``. Among equally long rules the least (host + path,
    verdict) wins. Null URLs have empty host and path, which only a rule with an empty host and path fits; rules with nulls
    fit nothing. Repeated rows stay; columns called host, path, rule or verdict are replaced, others may have any names; empty
    tables, of rules too, are fine.

    Pages are scanned twice, so that only those with possible hits are shuffled. Rules of over ``broadcast_rules`` rows are
    joined by a shuffle, whose hot keys adaptive execution splits.
    """
    usable = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    keyed = usable.select(F.concat("host", F.lit("\n"), "path").alias("key"), F.concat("host", "path").alias("listed"), F.length("path").alias("length"), F.col("verdict").alias("says"))
    listed = cut(keyed.groupBy("key", "listed", "length").agg(F.min("says").alias("says")))
    # lengths of rules' paths: at most as many as the longest path has characters
    lengths = sorted(r[0] for r in listed.select("length").distinct().collect())
    n_rules = listed.count()
    bloom = BlockedBloom.build(listed, "key", n_rules)

    address = F.col(quoted(url))
    parted = pages.select(boxed(pages, but=("host", "path", "rule", "verdict")), host_of(address).alias("host"), path_of(address).alias("path"))
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = F.split(F.lit(",".join(map(str, lengths))), ",").cast("array<int>") if lengths else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(known, lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p))))
    probed = parted.withColumn("hits", F.filter(keys, bloom.may_hold)).withColumn("id", F.monotonically_increasing_id())

    hits = probed.where(F.size("hits") > 0).select("row", "host", "path", "id", F.explode("hits").alias("key"))
    exact = F.broadcast(listed) if n_rules <= broadcast_rules else listed
    best = F.min_by(F.struct("listed", "says"), F.when(F.col("listed").isNotNull(), F.struct(-F.length("listed"), "listed", "says")))
    judged = (
        hits.join(exact, "key", "left")
        .groupBy("id")
        .agg(F.first(F.struct("row", "host", "path")).alias("page"), best.alias("best"))
        .select("page.*", F.col("best.listed").alias("rule"), F.coalesce("best.says", F.lit(default)).alias("verdict"))
    )
    unlisted = probed.where(F.size("hits") == 0).select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return judged.unionByName(unlisted).select("row.*", "host", "path", "rule", "verdict")


def op3_url_rules(spark, sf_dir):
    """Every page's URL against the five rules; unlisted URLs are allowed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = values(spark, RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_ORACLE = rf"""
WITH rules(rhost, rpath, v) AS (VALUES {_VALUES}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT p.*, rhost || rpath AS rule, v,
                row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
         FROM parts p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE k = 1"""

QUERIES = {"op3_url_rules": op3_url_rules}
ORACLES = {"op3_url_rules": _ORACLE}
