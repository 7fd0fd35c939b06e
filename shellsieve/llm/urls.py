"""URL rules: a blocked Bloom filter in front of an exact join.

A rule is a host and the start of a path. A URL is looked up under the ends of its host that have as
many labels as rules have, with the starts of its path at the lengths that rules have, so a long
host or path costs no more than a few passes over it. The filter is a table of
blocks of 256 bits, one block to a key, eight bits set in it, so a key costs one look at one
block; it is broadcast with the block number as key while its size, which its row count
gives, is below a bound. What the filter lets pass goes to the exact join with the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.common import LOWER, UPPER, col, sized_broadcast, stored
from shellsieve.sources.checkpoints import Scratch

#: Words of a block, and bits of the filter for each rule.
BLOCK_WORDS, BITS_PER_RULE = 4, 24


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lowered, and path; both empty for null and where there is no ``://``."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def _block(key_hash: Column, blocks: int) -> Column:
    return F.pmod(key_hash, F.lit(blocks))


def _bits(key_hash: Column) -> list[Column]:
    """For every word of the block the two bits of a key, from a second hash of it."""
    second = F.xxhash64(key_hash, F.lit("bits"))
    one = F.lit(1).cast("long")

    def bit(part: int) -> Column:
        place = F.shiftrightunsigned(second, 6 * part).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", one, place)

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(BLOCK_WORDS)]


def bloom_filter(rules: DataFrame) -> tuple[DataFrame, int]:
    """The filter's blocks that are not empty (block, word_0 .. word_3) and the number of all."""
    blocks = max(1, -(-rules.count() * BITS_PER_RULE // (64 * BLOCK_WORDS)))
    keys = rules.select(_hash(F.col("rule_host"), F.col("rule_path")).alias("h"))
    words = [word.alias(f"word_{i}") for i, word in enumerate(_bits(F.col("h")))]
    filled = keys.select(_block(F.col("h"), blocks).alias("block"), *words)
    return filled.groupBy("block").agg(
        *(F.bit_or(f"word_{i}").alias(f"word_{i}") for i in range(BLOCK_WORDS))
    ), blocks


def url_verdicts(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains of it, where
    the path starts with the rule's; of those that fit, the one with the longest host and path
    together wins, then the longer host, then the first by text. Hosts of rules are lowered as
    those of URLs are; rules with a null are left out, of equal rules the first verdict by text
    counts. ``rule`` is null and the verdict ``default`` where no rule fits. A null URL has an
    empty host and path and fits no rule; so does one without ``://``. Repeated rows give a row each,
    an empty table of pages gives none, and without rules every verdict is ``default``.
    """
    scratch = Scratch(pages.sparkSession)
    rules = scratch.stored(
        rules.select(
            F.translate(col("host"), UPPER, LOWER).alias("rule_host"),
            col("path").alias("rule_path"),
            col("verdict").alias("verdict"),
        )
        .dropna()
        .groupBy("rule_host", "rule_path")
        .agg(F.min("verdict").alias("verdict")),
        "rules",
    )
    host, path = host_and_path(col(url_col))
    pages = pages.select(col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    # Few numbers: the different lengths and numbers of labels.
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    labels = sorted(r[0] for r in rules.select(_labels(F.col("rule_host"))).distinct().collect())
    best = _best_rules(pages.select("host", "path"), rules, lengths, labels)
    best = stored(best, "verdicts").withColumnsRenamed({"host": "of_host", "path": "of_path"})
    scratch.drop()
    on = (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path"))
    # Never broadcast: it has a row per URL, however well its files are packed.
    return pages.join(best.hint("merge"), on, "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _best_rules(urls: DataFrame, rules: DataFrame, lengths: list[int], labels: list[int]) -> DataFrame:
    """host, path, rule and verdict of the different URLs that a rule fits.

    Rows are looked up where they are read, and equal ones meet in the grouping at the end.
    """
    urls = urls.filter("host != ''").withColumn("labels", _labels(F.col("host")))
    hosts = F.array(
        *(F.when(F.col("labels") >= n, F.substring_index("host", ".", -n)) for n in labels)
    ).cast("array<string>")
    starts = F.array(
        *(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)
    ).cast("array<string>")
    keys = urls.select("host", "path", F.explode(hosts).alias("rule_host"), starts.alias("starts"))
    keys = keys.filter(F.col("rule_host").isNotNull())
    keys = keys.select("host", "path", "rule_host", F.explode("starts").alias("rule_path"))
    keys = keys.filter(F.col("rule_path").isNotNull())

    blocks, number = bloom_filter(rules)
    blocks = sized_broadcast(blocks, 64 * BLOCK_WORDS)
    keys = keys.withColumn("h", _hash(F.col("rule_host"), F.col("rule_path")))
    probed = keys.withColumn("block", _block(F.col("h"), number)).join(blocks, "block")
    for i, word in enumerate(_bits(F.col("h"))):
        probed = probed.filter(F.col(f"word_{i}").bitwiseAND(word) == word)
    fits = probed.select("host", "path", "rule_host", "rule_path").join(
        rules, ["rule_host", "rule_path"]
    )
    rule = F.concat("rule_host", "rule_path")
    order = F.struct(-F.length(rule), -F.length("rule_host"), rule.alias("rule"), F.col("verdict"))
    return (
        fits.groupBy("host", "path")
        .agg(F.min(order).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
