"""Removal of benchmark passages from training texts.

A window is a run of ``window`` words of a benchmark item, or the whole item if it is
shorter. Windows are looked up through seeds: of a window of L words, any run of m = L/2
words that starts at one of its first L-m+1 places. A text is looked at in every place that
is a multiple of L-m+1, so each occurrence of a window covers exactly one seed place that is
its first; the seeds of all windows are a hash set that is broadcast after its size is
measured. A text emits one row for L-m+1 words, with the words around the seed, and a hit is
verified on those by comparing the window's whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.common import (
    LOWER, UPPER, col, digest, join_back, lower_ascii, sized_broadcast, stored,
)

WINDOW_WORDS = 10

#: What parts words: ASCII but for digits and letters. A-Z is lowered where words are compared.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text as they are written; null has none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SEPARATORS), "")


def _joined(array: Column, start: Column, length) -> Column:
    """Words from the 0-based place ``start``."""
    return F.array_join(F.slice(array, start + 1, length), " ")


def _fold(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _seed_size(length: int) -> tuple[int, int]:
    """Words of a seed, and the step between the places where texts are looked at."""
    size = (length + 1) // 2
    return size, length - size + 1


def benchmark_windows(
    benchmark: DataFrame,
    id_col: str = "item_id",
    text_col: str = "text",
    window: int = WINDOW_WORDS,
) -> DataFrame:
    """Distinct windows: length (words), window (their words, joined by blanks), items."""
    items = benchmark.select(
        F.coalesce(col(id_col).cast("string"), F.lit("")).alias("item"),
        words(lower_ascii(F.coalesce(col(text_col).cast("string"), F.lit("")))).alias("words"),
    ).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    places = F.sequence(F.lit(0), F.size("words") - F.col("length"))
    return (
        items.withColumn("length", length)
        .select("item", "length", "words", F.explode(places).alias("start"))
        .select("item", "length", _joined(F.col("words"), F.col("start"), F.col("length")).alias("window"))
        .groupBy("length", "window")
        .agg(F.collect_set("item").alias("items"))
    )


def _places(length: int) -> Column:
    """The places of a text at which seeds of windows of ``length`` words are looked for."""
    size, step = _seed_size(length)
    w = F.col("words")
    last = F.size(w) - size
    places = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)))
    return F.transform(
        F.coalesce(places, F.array().cast("array<int>")),
        lambda at: F.struct(
            F.lit(length).alias("length"),
            at.alias("at"),
            # As all letters are lowered here, more can meet than are equal, never fewer.
            F.lower(_joined(w, at, size)).alias("seed"),
            F.least(at, F.lit(length - size)).alias("before"),
            F.slice(
                w,
                F.greatest(at - (length - size), F.lit(0)) + 1,
                F.least(at, F.lit(length - size)) + length,
            ).alias("around"),
        ),
    )


def _hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, digest, start, length and items of every occurrence of a window."""
    windows = stored(windows, "windows")
    lengths = sorted(row[0] for row in windows.select("length").distinct().collect())
    seeds = []
    for length in lengths:
        size, step = _seed_size(length)
        w = F.split("window", " ")
        seeds.append(
            windows.filter(F.col("length") == length)
            .select("window", "items", "length", F.explode(F.sequence(F.lit(0), F.lit(step - 1))).alias("offset"))
            .withColumn("seed", F.lower(_joined(w, F.col("offset"), size)))
        )
    if not seeds:
        return docs.select(
            "doc_id", "digest", F.lit(0).alias("start"), F.lit(0).alias("length"),
            F.array().cast("array<string>").alias("items"),
        ).filter(F.lit(False))
    table = seeds[0]
    for more in seeds[1:]:
        table = table.unionByName(more)
    table = stored(table, "seeds")
    size = table.agg(
        F.avg(F.length("window") * 2 + F.length("seed") + 16 * F.size("items") + 100)
    ).first()[0]
    table = sized_broadcast(table, int(size or 0) + 1)
    places = _places(lengths[0]) if len(lengths) == 1 else F.concat(*map(_places, lengths))
    at = docs.select("doc_id", "digest", F.explode(places).alias("place")).select(
        "doc_id", "digest", "place.*"
    )
    found = at.join(table, ["seed", "length"]).filter(F.col("before") >= F.col("offset"))
    covered = _fold(_joined(F.col("around"), F.col("before") - F.col("offset"), F.col("length")))
    return found.filter(covered == F.col("window")).select(
        "doc_id", "digest", (F.col("at") - F.col("offset")).alias("start"), "length", "items"
    )


def _parted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = col(text_col).cast("string")
    return docs.select(
        col(id_col).alias("doc_id"), digest(text).alias("digest"), words(text).alias("words")
    )


def _found(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest, hit (places of hit words, sorted) and items; texts with hits only.

    Rows of equal id and text are one here. The hits of a text are grouped, as many as it has
    words at most.
    """
    spans = F.transform("spans", lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1))
    return (
        _hits(_parted(docs, id_col, text_col), windows)
        .groupBy("doc_id", "digest")
        .agg(
            F.collect_set(F.struct("start", "length")).alias("spans"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        )
        .select(
            "doc_id",
            "digest",
            F.array_sort(F.array_distinct(F.flatten(spans))).alias("hit"),
            F.array_sort("items").alias("items"),
        )
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW_WORDS,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row.

    ``n_hit`` counts words inside any occurrence of a window, ``n_items`` items with occurring
    windows; rows of one item id are one item, a null id is the empty one. A null text has no
    words, an item without words no window. ``items_sha256`` is over the item ids sorted as
    strings and joined by commas. Every row of ``docs`` gives one row, an empty table none.
    """
    windows = benchmark_windows(benchmark, item_id_col, item_text_col, window)
    found = stored(_found(docs, windows, id_col, text_col), "contaminated")
    found = found.select(
        F.col("doc_id").alias("found_id"),
        F.col("digest").alias("found_digest"),
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.array_join("items", ",").alias("items"),
    )
    rows = _parted(docs, id_col, text_col).select(
        "doc_id", "digest", F.size("words").cast("long").alias("n_words")
    )
    on = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("digest") == F.col("found_digest"))
    zero = F.lit(0).cast("long")
    return rows.join(found, on, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW_WORDS,
) -> DataFrame:
    """``docs`` without the rows in whose text a window occurs."""
    windows = benchmark_windows(benchmark, item_id_col, item_text_col, window)
    found = stored(_found(docs, windows, id_col, text_col).select("doc_id", "digest"), "contaminated")
    return join_back(docs, found, id_col, text_col, "left_anti")


def remove_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW_WORDS,
) -> DataFrame:
    """``docs`` with every hit word cut out of its text, and what follows it up to the next word.

    Texts without hits stay as they are, null stays null.
    """
    windows = benchmark_windows(benchmark, item_id_col, item_text_col, window)
    found = stored(_found(docs, windows, id_col, text_col).drop("items"), "contaminated")
    hit = "hit"
    while hit.lower() in {c.lower() for c in docs.columns}:
        hit = f"_{hit}"
    out = join_back(docs, found.withColumnRenamed("hit", hit), id_col, text_col, "left")
    text = col(text_col)
    # The text is a head without words and then words, each with what follows it.
    head = F.regexp_extract(text, rf"^(?:{SEPARATORS})?", 0)
    pieces = F.regexp_extract_all(text, F.lit(rf"({WORD}(?:{SEPARATORS})?)"), F.lit(1))
    cut = F.map_from_arrays(col(hit), F.transform(col(hit), lambda _: F.lit(True)))
    kept = F.filter(pieces, lambda _, i: ~F.map_contains_key(cut, i))
    text = F.when(col(hit).isNull(), text).otherwise(F.concat(head, F.array_join(kept, "")))
    return out.withColumn(text_col, text).drop(hit)
