"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that hold them. Words
flow from patterns to source quotas; every further copy of a pattern's words costs more than
the one before, so copies are made only where a quota cannot be met without. The flow is
solved over patterns and sources, never over documents. A source that shares no document with
another one has a single way for its words, so its flow is its quota, up to the copies; patterns of
such sources stay in Spark, however many there are, and the others go to the solver. Within a pattern all documents get
the whole copies, and those of the lowest seeded hash one copy more, until the words that are
left are reached; the hash at which that happens is found by counting words digit by digit.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellsieve.llm.common import BROADCAST_BYTES, col, digest, fresh, join_back, sized_broadcast, stored
from shellsieve.operators.findings import numbered
from shellsieve.sources.checkpoints import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MAX_COPIES, SEED = (3.0, 1.0, 2.0), 1.5, 2, 42
#: The flow of sources that share documents runs on the driver; beyond so many of their patterns it is refused.
MAX_PATTERNS = 10_000
#: Bits of the hash by which words are counted in a round, and rows that are ordered one by one.
DIGIT_BITS, ORDERED_ROWS = 12, 100_000


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Targets by weight that sum to ``total``; none is above ``most`` times its size.

    What a source cannot take is shared by weight among the others, until none is above.
    """
    out = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in above:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in above)
        open_ = [i for i in open_ if i not in set(above)]
    return out


def min_cost_flow(
    supplies: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], copies: int
) -> list[list[tuple[int, int]]]:
    """For each pattern the words that go to its sources, (source, words) each.

    The k-th copy of a pattern's words costs k a word. Quotas are met as far as the copies
    reach, at the least cost: shortest paths from the patterns that have copies left, over the
    links words may take and those they may take back.
    """
    flow = [dict.fromkeys(m, 0) for m in members]
    used, need = [0] * len(supplies), list(quotas)
    holders: list[list[int]] = [[] for _ in quotas]
    for p, sources in enumerate(members):
        for s in sources:
            holders[s].append(p)
    while True:
        # Cost of another word from a pattern is the number of its next copy. On the way a
        # source may hand words it has from one pattern to another, which changes no cost.
        cost = {p: used[p] // n + 1 for p, n in enumerate(supplies) if n and used[p] < copies * n}
        queue = [(c, p, -1) for p, c in cost.items()]
        heapq.heapify(queue)
        came, end = {}, None
        while queue and end is None:
            c, p, by = heapq.heappop(queue)
            if p in came:
                continue
            came[p] = by
            for s in members[p]:
                if need[s]:
                    end = (p, s)
                    break
                for other in holders[s]:
                    if other not in came and flow[other][s]:
                        heapq.heappush(queue, (c, other, (p, s)))
        if end is None:
            return [sorted(f.items()) for f in flow]
        p, s = end
        path, amount = [], need[s]
        while came[p] != -1:
            before, through = came[p]
            path.append((before, p, through))
            amount = min(amount, flow[p][through])
            p = before
        amount = min(amount, supplies[p] - used[p] % supplies[p])
        used[p] += amount
        p, s = end
        need[s] -= amount
        flow[p][s] += amount
        for before, to, through in path:
            flow[to][through] -= amount
            flow[before][through] += amount


def _rows(docs: DataFrame, id_col: str, text_col: str, sources: Column, scratch: Scratch) -> DataFrame:
    text = col(text_col).cast("string")
    return scratch.stored(
        docs.select(
            col(id_col).alias("doc_id"),
            digest(text).alias("digest"),
            F.array_sort(F.array_distinct(sources)).alias("pattern"),
            word_count(text).alias("size"),
            # Rows that nothing tells apart are told apart by their place in the stored table.
            F.monotonically_increasing_id().alias("row"),
        ),
        "mix-rows",
    )


def _thresholds(rows: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """``rows`` with ``extra``: whether the row's pattern takes another copy of it.

    ``goal`` is the number of words wanted of another copy of the row's pattern. In each round one
    digit of the hash parts what is undecided: digits below the one that reaches the goal are taken,
    those above are not, that one goes to the next round.
    """
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("digest"))
    tie = F.xxhash64(F.lit(seed), F.col("row"))
    columns = ["pattern_no", "goal", "row", "size", "h1", "h2"]
    open_ = rows.filter("goal > 0 and size > 0").withColumns({"h1": key, "h2": tie}).select(*columns)
    done = []
    places = [("h1", s) for s in (52, 40, 28, 16, 4)] + [("h2", s) for s in (52, 40, 28, 16, 4)]
    for name, shift in places:
        digit = F.shiftrightunsigned(name, shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
        open_ = scratch.stored(open_.withColumn("digit", digit), "mix-open")
        sums = open_.groupBy("pattern_no", "goal", "digit").agg(F.sum("size").alias("words"))
        order = Window.partitionBy("pattern_no").orderBy("digit")
        sums = sums.withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        edges = scratch.stored(
            sums.groupBy("pattern_no").agg(
                F.min(F.when(F.col("upto") > F.col("goal"), F.col("digit"))).alias("edge"),
                F.max(F.when(F.col("upto") <= F.col("goal"), F.col("upto"))).alias("taken"),
            ),
            "mix-edges",
        )
        at = open_.join(sized_broadcast(edges, 64), "pattern_no")
        below = F.col("edge").isNull() | (F.col("digit") < F.col("edge"))
        done.append(at.filter(below).select("row"))
        left = F.col("goal") - F.coalesce("taken", F.lit(0))
        rest = at.filter(F.col("digit") == F.col("edge")).withColumn("goal", left)
        open_ = scratch.stored(rest.select(*columns), "mix-edge")
        if open_.count() <= ORDERED_ROWS:
            break
    order = Window.partitionBy("pattern_no").orderBy("h1", "h2")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # The last document is taken if that comes nearer to the goal than to leave it.
    last = open_.withColumn("upto", upto).filter(2 * F.col("upto") - F.col("size") <= 2 * F.col("goal"))
    taken = last.select("row")
    for more in done:
        taken = taken.unionByName(more)
    taken = scratch.stored(taken, "mix-taken")
    return rows.join(taken.withColumn("extra", F.lit(True)), "row", "left").withColumn(
        "extra", F.coalesce("extra", F.lit(False))
    )


def _with_targets(sources: DataFrame, weights: Sequence[float], total: float, most: float, scratch: Scratch) -> DataFrame:
    """``sources`` (source, size, overlaps) with the ``target`` of each, as ``source_targets`` has it.

    Each round is one aggregation: sources above their bound at the present share of a weight are
    put at it, which raises the share, until none is added. Sums are of whole numbers, so a second
    run gives the same targets.
    """
    order = [F.col("source").isNull(), F.col("source")]
    sources = numbered(sources, order, "no", costly=False, store=scratch.stored)
    turn = (F.col("no") - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))
    sources = scratch.stored(sources.withColumns({"turn": turn, "weight": weight}), "mix-sources")
    bound = F.lit(most) * F.col("size")
    left, every, capped = float(total), None, -1
    above = F.lit(False)
    while True:
        found = sources.groupBy(above.alias("above"), "turn").agg(F.count("*"), F.sum("size")).collect()
        if sum(n for at, _, n, _ in found if at) == capped:
            break
        capped = sum(n for at, _, n, _ in found if at)
        left = float(total) - most * sum(size for at, _, _, size in found if at)
        every = sum(n * float(weights[turn]) for at, turn, n, _ in sorted(found) if not at)
        if not every:
            above = F.lit(True)
            break
        above = F.lit(left) * F.col("weight") / F.lit(every) > bound
    share = F.lit(left) * F.col("weight") / F.lit(every or 1.0)
    return sources.withColumn("target", F.when(above, bound.cast("double")).otherwise(share))


def _solved(patterns: DataFrame, sources: DataFrame, copies: int) -> DataFrame:
    """pattern_no and words of the patterns of overlapping sources, by the flow on the driver."""
    rows = patterns.select("pattern_no", "words", F.posexplode("pattern").alias("at", "source"))
    rows = rows.join(sources.filter("overlaps"), rows["source"].eqNullSafe(sources["source"]))
    rows = rows.groupBy("pattern_no", "words").agg(
        F.sort_array(F.collect_list(F.struct("at", "no", "target"))).alias("members")
    )
    found = sorted(rows.limit(MAX_PATTERNS + 1).collect())
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns of sources that share documents")
    targets = {m.no: m.target for row in found for m in row.members}
    index = {no: i for i, no in enumerate(sorted(targets))}
    # In an order that does not depend on how Spark numbered the patterns.
    found.sort(key=lambda row: [m.no for m in row.members])
    flow = min_cost_flow(
        [row.words for row in found],
        [[index[m.no] for m in row.members] for row in found],
        [round(targets[no]) for no in sorted(targets)],
        copies,
    )
    return patterns.sparkSession.createDataFrame(
        [(row.pattern_no, sum(w for _, w in f)) for row, f in zip(found, flow, strict=True)],
        "solved_no long, solved long",
    )


def _mix(
    docs: DataFrame, sources: Column | None, weights: Sequence[float], share: float, max_copies: int, seed: int,
    id_col: str, text_col: str, scratch: Scratch,
) -> DataFrame:
    rows = _rows(docs, id_col, text_col, F.array(col("source")) if sources is None else sources, scratch)
    patterns = scratch.stored(
        rows.groupBy("pattern").agg(F.sum("size").alias("words")).withColumn(
            "pattern_no", F.monotonically_increasing_id()
        ),
        "mix-patterns",
    )
    every, octets = patterns.agg(
        F.coalesce(F.sum("words"), F.lit(0)),
        F.coalesce(F.sum(F.coalesce(F.octet_length(F.to_json("pattern")), F.lit(0)) + 128), F.lit(0)),
    ).first()
    exploded = patterns.select("words", F.size("pattern").alias("n"), F.explode("pattern").alias("source"))
    held = exploded.groupBy("source").agg(F.sum("words").alias("size"), (F.max("n") > 1).alias("overlaps"))
    held = scratch.stored(
        _with_targets(scratch.stored(held, "mix-held"), weights, share * every, max_copies, scratch), "mix-targets"
    )
    solved = _solved(patterns, held, max_copies)
    # Nulls are last in a pattern, so its first entry is its first source.
    first = F.when(F.size("pattern") > 0, F.struct(F.col("pattern")[0].alias("source")))
    of_first = held.select(
        F.struct("source").alias("held_source"), F.col("size").alias("source_size"), "target", "overlaps"
    )
    target = F.rint(F.coalesce("target", F.lit(0.0))).cast("long")
    quota = F.least(target, F.col("words") * max_copies)
    flow = F.coalesce("solved", F.when(F.col("overlaps"), F.lit(0)).otherwise(quota), F.lit(0))
    some = F.col("words") > 0
    described = (
        patterns.withColumn("first_source", first)
        .join(of_first, F.col("first_source") == F.col("held_source"), "left")
        .join(F.broadcast(solved), F.col("pattern_no") == F.col("solved_no"), "left")
        .withColumn("flow", flow)
        .withColumn("whole", F.when(some, F.expr("flow div words")).otherwise(0).cast("int"))
        .select(
            F.col("pattern").alias("of_pattern"), "pattern_no", "source_size", "target", "whole",
            (F.col("flow") - F.col("whole") * F.col("words")).alias("goal"),
        )
    )
    described = scratch.stored(described, "mix-described")
    described = F.broadcast(described) if octets <= BROADCAST_BYTES else described
    rows = scratch.stored(
        rows.join(described, rows["pattern"].eqNullSafe(described["of_pattern"])).drop("pattern", "of_pattern"),
        "mix-numbered",
    )
    rows = _thresholds(rows, seed, scratch)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra").cast("int")).otherwise(0)
    return rows.select(
        "doc_id", "digest", "row", "size", "source_size", "target",
        (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"),
    )


def mix(
    docs: DataFrame,
    sources: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_copies: int = MAX_COPIES,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, digest, row, size, source_size, target, taken and copies of every row.

    ``sources`` is an array of the sources a document is in; by default the column ``source``
    alone. Sources by code point, null last, have the weights in turn, again and again, and share
    ``share`` times the words of all documents (a document of two sources counts in the
    quotas' sum once, in the size of both); no target is above ``max_copies`` times its
    source's size. ``source_size`` and ``target`` are those of the document's first source,
    null if it has none. A null text has no words, whatever the length of others; an empty table gives
    no rows. ``taken`` is ``copies`` times the size; documents without words are not taken. A
    second run over the same rows selects the same; rows equal in id and text are alike in that.

    Any number of sources may stand alone; those that share documents may have ``MAX_PATTERNS``
    membership patterns between them, beyond which there is an error.
    """
    scratch = Scratch(docs.sparkSession)
    out = stored(
        _mix(docs, sources, weights, share, max_copies, seed, id_col, text_col, scratch), "mix-copies"
    )
    scratch.drop()
    return out


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` as the mix takes them: every row as often as its copies.

    Of rows of equal id and text one stands for all, as often as all of them together. An empty
    table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    how = {"sources": None, "weights": WEIGHTS, "share": SHARE, "max_copies": MAX_COPIES, "seed": SEED} | how
    counts = _mix(docs, id_col=id_col, text_col=text_col, scratch=scratch, **how)
    counts = counts.groupBy("doc_id", "digest").agg(
        F.sum("copies").alias("copies"), F.count("*").alias("rows")
    )
    counts = stored(counts.filter("copies > 0"), "copies")
    scratch.drop()
    (copies,) = fresh(docs, "copies")
    again = not counts.filter("rows > 1").isEmpty()
    counts = counts.drop("rows").withColumnRenamed("copies", copies)
    out = join_back(docs, counts, id_col, text_col, "inner")
    if again:
        out = out.dropDuplicates([id_col, text_col])
    times = F.sequence(F.lit(1), col(copies).cast("int"))
    return out.select(*map(col, docs.columns), F.explode(times).alias(copies)).drop(copies)
