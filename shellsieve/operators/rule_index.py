"""Rules that are a table: thousands of patterns, found through an index of their literals.

Every match of a rule holds its literal, and a text that holds the literal holds each
part of it of eight characters, or of four where the literal is shorter than eight (of all of it where it is
shorter than four). Of these parts the rule is filed under the one that stands in the fewest places of
the texts, as counted. At each place of a text the rules filed under the part there are looked up, and
only such whose whole literal stands there go on (``literal_search``). So the plan is the same for any number
of rules, and a part that every text has decides nothing.

A pattern that is nothing but its literal has its matches there. Others are tried with the pattern itself
on the texts that hold the literal, and rules that have no literal on every text.
"""

import re
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellsieve.functions.dialect import portable, unsupported
from shellsieve.functions.literals import required_literal
from shellsieve.functions.positions import MARK, let, match_starts, pieces_of, without_marks
from shellsieve.operators.literal_search import Literals, PartCounts
from shellsieve.sources.checkpoints import Scratch
from shellsieve.sources.workers import ship

#: Sizes of the parts; a literal shorter than the first is a part itself.
GRAM, LONG_GRAM = 4, 8
#: Rules that are sent to all workers at once; more are taken in turns, two passes over the texts each.
RULES_AT_ONCE = 50_000

_TEXT, _HITS, _HIT = "__text", "__hits", "__hit"


def _grams(text, size):
    # Every stretch of so many characters; the match itself is empty, so the next begins one further on.
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _compiled(patterns: pd.Series) -> pd.DataFrame:
    rows = []
    for pattern in patterns:
        what = "no pattern" if pattern is None else unsupported(pattern)
        if what:
            rows.append((None, None, None, what))
        else:
            literal = required_literal(pattern)
            plain = pattern if _is_plain(pattern) else None
            rows.append((portable(pattern), literal, plain, None))
    return pd.DataFrame(rows, columns=["java_pattern", "literal", "plain", "problem"])


def _is_plain(pattern):
    """Whether ``pattern``, but for a leading (?i), holds ASCII characters that stand for themselves alone."""
    return re.fullmatch(r"(\(\?i\))?[^\\.^$*+?{}\[\]|()\x80-\U0010FFFF]+", pattern) is not None


def compiled_rules(rules, id_col="rule_id", pattern_col="pattern"):
    """rule_id, java_pattern, literal and plain of every rule of a table; ValueError if one is no rule.

    ``plain`` is the pattern if it is nothing but its literal.
    """
    ship(rules.sparkSession)
    compiled = F.pandas_udf(_compiled, "java_pattern string, literal string, plain string, problem string")
    table = rules.select(
        F.col(id_col).alias("rule_id"), F.col(pattern_col).alias("pattern"), compiled(F.col(pattern_col)).alias("c")
    ).select("rule_id", "pattern", "c.*")
    empty = F.rlike(F.lit(""), F.col("java_pattern"))
    bad = table.select(
        "rule_id", F.coalesce("problem", F.when(empty, F.lit("a match of the empty text"))).alias("problem")
    ).where("problem IS NOT NULL")
    if found := bad.limit(3).collect():
        raise ValueError("; ".join(f"{row.rule_id}: the pattern has {row.problem}" for row in found))
    return table.select("rule_id", "java_pattern", "literal", "plain")


def _filed(rules, texts, scratch):
    """``rules`` with ``gram``, the part of the literal that stands in the fewest places of the one column of ``texts``."""
    literal = F.col("literal")
    grams = (
        F.when(F.length(literal) < GRAM, F.array(literal))
        .when(F.length(literal) < LONG_GRAM, _grams(literal, GRAM))
        .otherwise(_grams(literal, LONG_GRAM))
    )
    parts = scratch.stored(
        rules.select("rule_id", "java_pattern", "literal", "plain", F.explode(grams).alias("gram")), "rule-parts"
    )
    counts = _counted(texts, parts.select("gram").distinct())
    held = parts.join(counts, "gram", "left").withColumn("places", F.coalesce("places", F.lit(0)))
    rarest = F.min_by(F.struct("gram", "java_pattern", "literal", "plain"), F.struct("places", "gram")).alias("part")
    # A part that stands nowhere finds nothing, and neither does the rule.
    return held.groupBy("rule_id").agg(rarest, F.min("places").alias("places")).where("places > 0").select(
        "rule_id", "part.*"
    )


def _counted(texts, grams):
    """gram and places, how often each of the one column of ``grams`` stands in the one column of ``texts``."""
    spark = texts.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(PartCounts([row.gram for row in grams.collect()]))

    def count(batches):
        wanted = shared.value
        counts = wanted.count(batch.column(0) for batch in batches)
        stands = counts.nonzero()[0]
        if len(stands):
            yield pa.RecordBatch.from_arrays(
                [pa.array([wanted.parts[i] for i in stands], pa.string()), pa.array(counts[stands])], ["gram", "n"]
            )

    counted = texts.mapInArrow(count, "gram string, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("places"))


def scan_rule_table(texts, rules, id_col="path", text_col="content", keep=(), rule_id_col="rule_id", pattern_col="pattern"):
    """One row per match of a rule of the table ``rules``: ``keep``, id, rule_id, match_no, line, column.

    Matches are those of the same rules in a scan; the rows of a rule of several rows with one id are
    those of its first pattern by text. Texts that are NULL have none.
    """
    spark = texts.sparkSession
    scratch = Scratch(spark)
    columns = list(dict.fromkeys([*keep, id_col]))
    # Bytes that are no text are what a pattern takes them for.
    texts = texts.where(F.col(text_col).isNotNull()).select(*columns, F.make_valid_utf8(F.col(text_col)).alias(_TEXT))
    compiled = compiled_rules(rules, rule_id_col, pattern_col)
    compiled = compiled.groupBy("rule_id").agg(F.min(F.struct("java_pattern", "literal", "plain")).alias("rule"))
    compiled = scratch.stored(compiled.select("rule_id", "rule.*"), "rules")
    turns = -(-compiled.count() // RULES_AT_ONCE) or 1
    found = None
    for turn in range(turns):
        some = compiled.where(F.pmod(F.xxhash64("rule_id"), F.lit(turns)) == turn)
        matched = _matches(texts, some, columns, scratch)
        found = matched if found is None else found.unionByName(matched)
    return found


def _matches(texts, rules, columns, scratch):
    indexed = F.length("literal") > 0
    filed = _filed(rules.where(indexed), texts.select(_TEXT), scratch).withColumn("number", F.monotonically_increasing_id())
    # What these hold is stored: a row a rule, of which there are ``RULES_AT_ONCE`` or so.
    filed = scratch.stored(filed, "rules-filed")
    other = scratch.stored(rules.where(~indexed).select("rule_id", "java_pattern"), "rules-unfiled")
    marked = F.regexp_replace(F.col(_TEXT), F.col("java_pattern"), F.lit(MARK + "$0"))
    pattern_starts = let(pieces_of(marked), lambda pieces: match_starts(pieces))
    found = [_found_by_literal(texts, filed, columns, pattern_starts)]
    if not other.isEmpty():
        tried = texts.withColumn(_TEXT, without_marks(F.col(_TEXT)))
        tried = tried.join(F.broadcast(other), F.rlike(F.col(_TEXT), F.col("java_pattern")))
        found.append(tried.select(*columns, "rule_id", pattern_starts.alias("starts")))
    # Places are found for each part by itself, so that no text is copied into a union.
    placed = [
        # Outer, then filtered: a plain explode would have the starts worked out a second time.
        part.select(*columns, "rule_id", F.posexplode_outer("starts").alias("at", "place")).where("place IS NOT NULL")
        for part in found
    ]
    return reduce(DataFrame.unionByName, placed).select(
        *columns, "rule_id", (F.col("at") + 1).cast("long").alias("match_no"), "place.line", "place.column"
    )


def _found_by_literal(texts, filed, columns, pattern_starts):
    """rule_id and ``starts`` of the matches of each rule of ``filed`` in each text that holds its literal."""
    spark = texts.sparkSession
    rules = filed.select("number", "gram", "literal", "plain").collect()
    literals = Literals(*([rule[i] for rule in rules] for i in range(4)))
    shared = spark.sparkContext.broadcast(literals)

    @F.arrow_udf("array<struct<number: bigint, starts: array<struct<line: bigint, column: bigint>>>>")
    def search(texts: pa.Array) -> pa.Array:
        return shared.value.search(texts)

    plain_only = all(rule.plain is not None for rule in rules)
    # The text goes on with rules whose pattern it is tried with.
    text = F.lit(None).cast("string") if plain_only else F.when(F.col(f"{_HIT}.starts").isNull(), without_marks(F.col(_TEXT)))
    hits = (
        texts.select(*columns, _TEXT, search(_TEXT).alias(_HITS))
        .select(*columns, _TEXT, F.explode_outer(_HITS).alias(_HIT)).where(F.col(_HIT).isNotNull())
        .select(*columns, f"{_HIT}.*", text.alias(_TEXT))
        .join(F.broadcast(filed.select("number", "rule_id", "java_pattern")), "number")
    )
    starts = F.col("starts") if plain_only else F.coalesce("starts", pattern_starts)
    return hits.select(*columns, "rule_id", starts.alias("starts"))
