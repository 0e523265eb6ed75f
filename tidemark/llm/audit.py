"""Interaction of document filters over every order in which they can be applied.

What a filter removes depends on the filters before it.  A document is known by its mask, the set of filters it
fails, and only counts of masks are looked at.  Under an order a document is removed by the first filter of its mask.
All orders that begin with the same filters are neighbours in lexicographic order, so the orders in which a mask is
removed at one step by one filter form a few intervals of Lehmer ranks: one for each arrangement of filters outside the mask
followed by one inside it, (n - step)! orders long.  Counts are added at the start of an interval and taken
away at its end; a running sum over the ranks then has the removals of every order.

Edge cases of ``document_masks``: null text is empty and ``""`` passes length-free filters; a null part is the empty string and
is one part with it; a row without an id is never a repeat and makes no other a repeat; rows that repeat id and text are
not repeats of each other (no id is smaller); labels without an id count for nothing, and of labels that repeat an
id any 1 counts; whole texts are read, however long; tables without documents give no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 100, 80, 10, "[#$%&*|]"


def orders(filters: str = FILTERS) -> list[str]:
    """All orders in lexicographic order; the place of an order is its Lehmer rank."""
    return ["".join(p) for p in permutations(sorted(filters))]


def lehmer_rank(prefix: str, filters: str = FILTERS) -> int:
    """Rank of the first order that begins with ``prefix``: each letter counts the smaller letters that are still free,
    times the orders of what follows."""
    free, rank = sorted(filters), 0
    for f in prefix:
        k = free.index(f)
        free.pop(k)
        rank += k * factorial(len(free))
    return rank


def removal_intervals(filters: str = FILTERS) -> list[tuple[int, str, int, int, int]]:
    """(mask, filter, step, first, end): the ranks first..end-1 are the orders in which ``filter`` removes what fails
    ``mask`` at ``step``.  Bit k of a mask stands for the k-th filter."""
    names, out = sorted(filters), []
    for mask in range(1, 1 << len(names)):
        inside = [f for k, f in enumerate(names) if mask >> k & 1]
        outside = [f for f in names if f not in inside]
        for before in range(len(outside) + 1):
            for lead in permutations(outside, before):
                for f in inside:
                    first = lehmer_rank("".join(lead) + f, filters)
                    out.append((mask, f, before + 1, first, first + factorial(len(names) - before - 1)))
    return out


def interactions(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): one row for each
    part, order and step.  ``masks`` has part, mask, n, good, toxic: counts of rows by the set of filters they fail.

    The masks of a part are at most 2^n rows, the intervals and orders a function of n alone."""
    spark, names, n = masks.sparkSession, sorted(filters), len(filters)
    measures = ("n", "good", "toxic")
    masks = masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in measures])
    spans = F.broadcast(spark.createDataFrame(removal_intervals(filters), "mask int, filter string, step int, first int, end int"))
    ranked = F.broadcast(spark.createDataFrame([(r, o) for r, o in enumerate(orders(filters))], "rank int, filter_order string"))
    ends = F.explode(F.array(F.struct(F.col("first").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("rank"), F.lit(-1).alias("sign"))))
    steps = masks.join(spans, "mask").select("part", "step", ends.alias("e"), *measures).select("part", "step", "e.*", *measures)
    steps = steps.groupBy("part", "step", "rank").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in measures])

    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << k) > 0, F.col("n")).otherwise(0)).alias(f"f{k}") for k in range(n)]
    alone = [F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)).alias(f"u{k}") for k in range(n)]
    totals = masks.groupBy("part").agg(F.sum("n").alias("total"), *fails, *alone)
    # every part has every rank and step, also where nothing is removed
    grid = totals.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).select("*", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))).alias("rank"))
    grid = grid.select("part", "step", "rank", *[F.lit(0).cast("long").alias(c) for c in measures])
    running = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    deltas = steps.filter(F.col("rank") < factorial(n)).unionByName(grid).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in measures])
    removed = deltas.select("part", "step", "rank", *[F.sum(c).over(running).alias(c) for c in measures]).join(ranked, "rank")
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    at = F.instr(F.lit("".join(names)), letter)
    rows = removed.join(totals, "part")
    pick = lambda prefix: F.element_at(F.array(*[F.col(f"{prefix}{k}") for k in range(n)]), at)
    gone = F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - gone).alias("kept"),
        F.col("n").alias("removed"),
        (pick("f") - F.col("n")).alias("redundant"),
        pick("u").alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", letter)).alias("shapley"),
    )


def own_mask(text: str) -> Column:
    """Bits 0 to 3: the filters that look at one text alone."""
    t = F.col(text)
    words = F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1))
    count = F.size(words)
    fails = [
        count < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * count,
        100 * F.regexp_count(t, F.lit("[A-Z]")) > CAPITAL_PERCENT * F.char_length(t),
        t.rlike(MARKS),
    ]
    bits = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of documents under the five filters: too short, too repetitive, too many capitals,
    marks, and a text that a smaller id has too.

    A text is read once and leaves its task as a digest.  The repeat filter never brings a text's copies
    together: copies are counted by (text, part, labels) before the shuffle, with the smallest id and how often it
    occurs, and all but the rows of the smallest id of all fail it."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    slim = slim.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own_mask("text").alias("own"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # rows without an id would meet in one partition: each takes a key of its own there
    slim = slim.withColumn("given", F.col("id").isNotNull()).withColumn("key", F.coalesce("id", F.monotonically_increasing_id()))
    met = slim.join(marks.withColumn("is_id", F.lit(True)), (F.col("key") == F.col("label_id")) & (F.col("given") == F.col("is_id")), "left")
    met = met.select("id", "key", "given", "part", "digest", "own", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    kinds = ["digest", "part", "own", "good", "toxic"]
    by_id = met.groupBy("key", "given", *kinds).agg(F.count("*").alias("n"), F.max("id").alias("id"))
    lowest = F.min(F.when(F.col("given"), F.struct("id", "n")))
    groups = by_id.groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("given"), F.col("n")).otherwise(0)).alias("with_id"), lowest.alias("low"))
    first = F.min("low.id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("repeats", F.when(F.col("low.id") == first, F.col("with_id") - F.col("low.n")).otherwise(F.col("with_id")))
    e = 1 << FILTERS.index("E")
    split = F.explode(F.array(F.struct(F.col("own").alias("mask"), (F.col("n") - F.col("repeats")).alias("n")), F.struct((F.col("own") + e).alias("mask"), F.col("repeats").alias("n"))))
    rows = groups.select("part", "good", "toxic", split.alias("s")).select("part", "good", "toxic", "s.*").filter("n > 0")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every part, order and step of the five filters over ``docs``."""
    return interactions(document_masks(docs, labels))
