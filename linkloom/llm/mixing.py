"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, read again from
the start when its target asks for more than it holds.  A document's virtual
finish time is the number of words its source has sent when it ends, over the
source's target; documents leave in order of that time until the total budget
is spent, so every source comes near its target whatever its size.

Nothing is sorted whole.  Running sums of a source go over ``BUCKETS`` slices
of its shuffled order first and over the documents of a slice next, so a
source with a third of all documents is many tasks.  The cut at the budget is
found on histograms of the finish times, ``BUCKETS`` bars at each of two levels;
only the documents of one bar of the second level are ordered in one task.

Cases: a null or empty text has size 0 and takes nothing; a null source is a
source of its own, last in order; sources without words have target 0 and send
nothing; repeated rows are documents of their own, and ties in the shuffled
order go by doc_id and text; an empty table gives an empty mix; extra columns
are not read by ``mix`` and kept by ``take``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.columns import spare
from linkloom.session import materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKETS = 4096
SEED = 42
#: White space between words; a word is a run of anything else.
BLANKS = " \t\n\v\f\r"

_SHUFFLED = 60  # bits of the shuffle key


def n_words(text: Column) -> Column:
    """Words of a text (null: null): the spaces left when every word has exactly one in front.  A few copies of the text are
    made; an array of its words, as ``regexp_count`` makes one, is objects of many times its size."""
    flat = F.concat(F.lit(" "), text)
    for c in BLANKS[1:]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    flat = F.rtrim(flat)
    # there is no tab left, so one can mark the end of each run of spaces
    marked = F.replace(F.replace(flat, F.lit(" "), F.lit(" \t")), F.lit("\t "), F.lit(""))
    single = F.when(F.contains(flat, F.lit("  ")), F.replace(marked, F.lit("\t"), F.lit(""))).otherwise(flat)
    return F.octet_length(single) - F.octet_length(F.replace(single, F.lit(" "), F.lit("")))


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The narrow table of all documents: ids, size in words, place in the shuffled order."""
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source"), F.xxhash64("text").alias("text_key"),
        F.coalesce(n_words(F.col("text")), F.lit(0)).cast("bigint").alias("size"),
        F.conv(F.substring(digest, 1, _SHUFFLED // 4), 16, 10).cast("bigint").alias("place"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: rank, source_size, target.  Sources in code-point order, null last, take the weights in turn.

    With the sources in order of how soon they reach their cap, those before
    the first that stays under the common level are capped, the rest share
    what is left by weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    t = by_source.withColumn("rank", rank).withColumn("weight", turn).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    soonest = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = soonest.rowsBetween(Window.unboundedPreceding, -1)
    onward = soonest.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    t = t.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
    # the level only grows while sources are capped, so its value at the first that stays under its cap holds for all after it
    level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(every)
    shared = level.getField("level") * F.col("weight")
    return t.select("source", "rank", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(shared, F.col("cap").cast("double"))).alias("target"))


def _of_source(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    cond = left["source"].eqNullSafe(right["source"])
    for k in keys:
        cond = cond & (left[k] == right[k])
    return cond


def finish_times(sizes: DataFrame, goal: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(row, rank, place, doc_id, size, epoch, finish): a row for each time a document can be sent."""
    rows = sizes.join(goal.filter("target > 0"), sizes["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    rows = rows.withColumn("slice", F.shiftright("place", _SHUFFLED - (BUCKETS.bit_length() - 1)))
    slices = rows.groupBy("rank", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("rank").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("rank", "slice", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("rank", "slice").orderBy("place", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sent", F.sum("size").over(within)).join(slices, ["rank", "slice"])
    epochs = F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))
    rows = rows.select("row", "rank", "place", "doc_id", "text_key", "size", "source_size", "target", (F.col("base") + F.col("sent")).alias("sent"), epochs.alias("epoch"))
    finish = (F.col("epoch") * F.col("source_size") + F.col("sent")).cast("double") / F.col("target")
    return rows.select("row", "rank", "place", "doc_id", "text_key", "size", "epoch", finish.alias("finish"))


def _cut(bars: list, budget: int) -> tuple[int | None, int]:
    """The first bar in which the budget ends, and what is left of the budget there."""
    for bar, words in sorted(bars):
        if words > budget:
            return bar, budget
        budget -= words
    return None, budget


def send(times: DataFrame, budget: int) -> DataFrame:
    """The rows of ``times`` that leave before the budget is spent."""
    # 1 - 1/(1 + t) grows with t in floating point too, so the bars are in order of the finish times
    times = materialize(times.withColumn("bar", F.floor(BUCKETS * (1 - 1 / (1 + F.col("finish")))).cast("int")), "mix-times")
    bars = times.groupBy("bar").agg(F.sum("size").alias("w"), F.min("finish").alias("lo"), F.max("finish").alias("hi")).collect()
    bar, left = _cut([(r["bar"], r["w"]) for r in bars], budget)
    if bar is None:
        return times
    lo, hi = next((r["lo"], r["hi"]) for r in bars if r["bar"] == bar)
    part = F.floor((F.col("finish") - F.lit(lo)) * F.lit(BUCKETS / (hi - lo) if hi > lo else 0.0)).cast("int")
    inside = times.filter(F.col("bar") == bar).withColumn("part", part)
    fine, left = _cut([tuple(r) for r in inside.groupBy("part").agg(F.sum("size")).collect()], left)
    order = Window.orderBy("finish", "rank", "place", "doc_id", "text_key", "epoch", "row").rowsBetween(Window.unboundedPreceding, 0)
    last = inside.filter(F.col("part") == fine).withColumn("run", F.sum("size").over(order)).filter(F.col("run") <= left)
    return (times.filter(F.col("bar") < bar).unionByName(inside.filter(F.col("part") < fine).drop("part"))
            .unionByName(last.drop("part", "run")))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, times (how often it is sent), source, text_key."""
    sizes = sized(docs, seed)
    goal = materialize(targets(sizes, weights, max_epochs), "mix-targets")
    budget = goal.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    sent = send(finish_times(sizes, goal, max_epochs), budget).groupBy("row").agg(F.count("*").alias("times"))
    rows = sizes.join(goal, sizes["source"].eqNullSafe(goal["source"])).drop(goal["source"]).join(sent, "row", "left")
    times = F.coalesce("times", F.lit(0))
    return rows.select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"), "source", "text_key")


def take(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with all their columns, each as many times as the mix takes it."""
    n_times, n_rows, key, copy = spare(docs, "__times", "__rows", "__key", "__copy")
    sent = (mix(docs, **options).groupBy("doc_id", "source", "text_key").agg(F.sum("times").alias(n_times), F.count("*").alias(n_rows))
            .filter(F.col(n_times) > 0).alias("m"))
    d = docs.withColumn(key, F.xxhash64("text")).alias("d")
    same = (F.col(f"d.{key}") == F.col("m.text_key")) & F.col("d.source").eqNullSafe(F.col("m.source")) \
        & F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("m.doc_id"))
    mine = d.join(sent, same).select("d.*", n_times, n_rows)
    mine = mine.filter(F.col(n_rows) == 1).unionByName(mine.filter(F.col(n_rows) > 1).dropDuplicates(["doc_id", "source", key]))
    return mine.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n_times)))).drop(key, n_times, n_rows, copy)
