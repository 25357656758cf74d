"""Mixing sources to target weights by pivotal dependent rounding.

A source's rows share one expected number of copies, target over size. Its whole part is taken
outright; the rest is a probability. Two rows with fractional probabilities are paired and words move
from one to the other, in a direction drawn so that expectations hold, until one of the two is
integral. Draws depend on a row's id, text and source alone, and on its rank among rows that are equal in them, so
reruns agree however the input is laid out. Rows are paired within buckets of a few hundred; what a bucket leaves fractional (one row) goes
up a reduction tree, level by level, until a source has one row left, which is drawn. Two exchanges
at the end flip the row that best closes a source's remaining gap. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import WORD, Scratch, numbered

BUCKET = 256
CAP = 3
SEED = 20


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size): weights 1, 2, 3 in order, capped at CAP times the size.

    Sources are few, so one task may sort them. Water filling in one pass: in order of cap over weight, the
    first row at which the level of all later ones doesn't exceed its own cap ends the capped ones; from there
    on the level falls, so it is the highest that fits.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", (rank - 1) % 3 + 1).withColumn("cap", CAP * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    per = per.withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    level = F.coalesce(F.max("fits").over(whole), F.lit(0.0))
    return per.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select("source", "source_size", "target")


_UP = "least((1 - a.p) * a.size, b.p * b.size)"  # words that can move from b to a
_DOWN = "least(a.p * a.size, (1 - b.p) * b.size)"
_NAMED = "'row', {0}.row, 'key', {0}.key, 'rank', {0}.rank, 'size', {0}.size"
_A, _B = _NAMED.format("a"), _NAMED.format("b")
_FOLD = f"""aggregate(items,
  named_struct('row', CAST(NULL AS BIGINT), 'key', 0L, 'rank', 0L, 'size', 0D, 'p', 0D, 'done', CAST(array() AS ARRAY<STRUCT<row: BIGINT, x: INT>>)),
  (a, b) -> CASE
    WHEN a.row IS NULL THEN named_struct({_B}, 'p', b.p, 'done', a.done)
    WHEN b.u * ({_UP} + {_DOWN}) < {_DOWN} THEN
      CASE WHEN (1 - a.p) * a.size <= b.p * b.size
        THEN named_struct({_B}, 'p', greatest(0D, b.p - (1 - a.p) * a.size / b.size), 'done', array_append(a.done, named_struct('row', a.row, 'x', 1)))
        ELSE named_struct({_A}, 'p', least(1D, a.p + b.p * b.size / a.size), 'done', array_append(a.done, named_struct('row', b.row, 'x', 0))) END
    ELSE
      CASE WHEN a.p * a.size <= (1 - b.p) * b.size
        THEN named_struct({_B}, 'p', least(1D, b.p + a.p * a.size / b.size), 'done', array_append(a.done, named_struct('row', a.row, 'x', 0)))
        ELSE named_struct({_A}, 'p', greatest(0D, a.p - (1 - b.p) * b.size / a.size), 'done', array_append(a.done, named_struct('row', b.row, 'x', 1))) END
  END)"""


def _draw(level: int):
    """A number in [0, 1) that depends on what the row is and the level alone."""
    return F.pmod(F.xxhash64("key", "rank", F.lit(SEED + level)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _ranked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (row, key and more) with rank: 0, 1, ... among rows of one key, in whatever order, as they are alike.

    Only repeated keys are ranked, first within a task's share of the numbered rows (the number's upper bits),
    then by how many the shares before it hold, so that a key of many rows isn't one task's.
    """
    again = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    again = scratch.save(rows.join(again, "key").select("key", "row", F.shiftright("row", 33).alias("share")), "again")
    shares = again.groupBy("key", "share").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("key", "share").orderBy("row")) - 1
    rank = again.withColumn("inside", inside).join(shares.select("key", "share", before.alias("before")), ["key", "share"]).select("row", (F.col("inside") + F.col("before")).alias("rank"))
    return rows.join(rank, "row", "left").withColumn("rank", F.coalesce("rank", F.lit(0)).cast("long"))


def plan_mix(docs: DataFrame, *, keep: list[str] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the columns in keep, size, source_size, target, copies, taken.

    Size is the number of words; null text has none. A row without words is taken no more than its source's
    whole copies and counts for nothing. Repeated rows are rows of their own. Null is a source, the last. An empty
    table gives no rows; other columns are ignored. Rows are numbered once and written.
    """
    keep = ["doc_id"] if keep is None else keep
    planned = _planned(docs, keep, id_col, source_col, text_col)[0]
    return planned.select(*[F.col(f"k_{c}").alias(c) for c in keep], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _planned(docs: DataFrame, keep: list[str], id_col: str, source_col: str, text_col: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The plan (row, k_ columns in keep, size, source_size, target, copies) and, if whole, all columns of docs as k_ by row."""
    scratch = Scratch(docs.sparkSession, "mixing")
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(source_col).isNull(), F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    named = [F.col(c).alias(f"k_{c}") for c in (docs.columns if whole else keep)]
    table = numbered(docs.select(*named, F.col(source_col).cast("string").alias("source"), size.alias("size"), key.alias("key")), "row", scratch, "numbered")
    rows = scratch.save(_ranked(table.select("row", *[f"k_{c}" for c in keep], "source", "size", "key"), scratch), "rows")
    targets = scratch.save(source_targets(rows.select("source", "size")), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # A source's name may be null; a number stands for it in what follows.
    targets = targets.withColumn("of", F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit("")))).withColumn("whole", F.floor(ratio).cast("int")).withColumn("p", ratio - F.floor(ratio))
    rows = rows.withColumn("of", F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    known = targets.select("of", "source_size", "target", "whole", "p")

    open_rows = rows.select("of", "row", "key", "rank", "size").join(known.filter("p > 0").select("of", "p"), "of").filter("size > 0").select("of", "row", "key", "rank", F.col("size").cast("double").alias("size"), "p")
    open_rows = scratch.save(open_rows, "open-0")
    decided, level = [], 0
    while True:
        many = open_rows.groupBy("of").agg(F.count(F.lit(1)).alias("n")).withColumn("buckets", F.ceil(F.col("n") / BUCKET))
        many = scratch.save(many, f"many-{level}")
        most = many.agg(F.coalesce(F.max("buckets"), F.lit(0)).alias("b")).first()["b"]
        if not most:
            break
        dealt = open_rows.join(many, "of").withColumn("bucket", F.pmod(F.xxhash64("key", "rank", F.lit(level)), F.col("buckets"))).withColumn("u", _draw(level))
        # Largest first: small rows then absorb what a large one has left over.
        items = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), "key", "rank", "row", "size", "p", "u"))).alias("items")
        folded = dealt.groupBy("of", "bucket").agg(items).select("of", F.expr(_FOLD).alias("f"))
        folded = scratch.save(folded, f"folded-{level}")
        decided.append(folded.select(F.explode("f.done").alias("d")).select("d.row", "d.x"))
        open_rows = folded.select("of", "f.row", "f.key", "f.rank", "f.size", "f.p")
        level += 1
        if most == 1:
            decided.append(open_rows.select("row", (_draw(level) < F.col("p")).cast("int").alias("x")))
            break
    if decided:
        drawn = decided[0]
        for more in decided[1:]:
            drawn = drawn.union(more)
        planned = rows.join(drawn, "row", "left")
    else:
        planned = rows.withColumn("x", F.lit(None).cast("int"))
    planned = scratch.save(planned.join(known, "of").withColumn("copies", F.col("whole") + F.coalesce("x", F.lit(0))), "planned-0")
    for step in range(1, 3):
        gap = planned.groupBy("of").agg(F.sum(F.col("copies") * F.col("size")).alias("took"), F.max("target").alias("goal")).select("of", (F.col("took") - F.col("goal")).alias("gap"))
        gap = scratch.save(gap, f"gap-{step}")
        # The row whose flip leaves least: x = 1 to 0 if too much is taken, 0 to 1 if too little.
        useful = planned.filter("x IS NOT NULL").join(gap, "of").filter("(gap > 0) = (x = 1)").withColumn("after", F.abs(F.abs("gap") - F.col("size")))
        flip = useful.filter("after < abs(gap)").groupBy("of").agg(F.min(F.struct("after", "key", "rank", "row")).alias("best")).select("of", F.col("best.row").alias("flip"))
        flip = scratch.save(flip, f"flip-{step}")
        flipped = planned.join(flip, "of", "left").withColumn("x", F.when(F.col("row") == F.col("flip"), 1 - F.col("x")).otherwise(F.col("x"))).drop("flip")
        planned = scratch.save(flipped.withColumn("copies", F.col("whole") + F.coalesce("x", F.lit(0))), f"planned-{step}")
        scratch.drop(f"planned-{step - 1}")
    return planned, table


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source), each as many times as the mix takes it, with all their columns, of any names.

    Null and empty texts count for nothing, and come as often as their source's whole copies. An empty table stays empty.
    """
    plan, table = _planned(docs, [], "doc_id", "source", "text", whole=True)
    taken = table.join(plan.filter("copies > 0").select("row", "copies"), "row")
    return taken.select(F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), *[f"k_{c}" for c in docs.columns]).select(*[F.col(f"k_{c}").alias(c) for c in docs.columns])
