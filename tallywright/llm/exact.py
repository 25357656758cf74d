"""Exact dedup by distributed most-significant-digit radix partitioning.

A group starts as all rows. Each round splits every open group by the next slice of bytes; groups of
one row and groups whose texts have ended are done and leave. Slices grow by a factor, so that
the rounds grow with the logarithm of the longest repeated text. Equality never rests on a digest.

A group of copies is counted by partial aggregation, one row per task and slice, so a group that
holds a third of all rows costs no task more than its share; the join that labels rows is one that
adaptive execution can split. Only open groups carry text on to the next round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import Scratch, fresh, numbered


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", first: int = 64, growth: int = 16, widest: int = 1 << 20) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. The row with the largest id stays; a null id is smaller than any other,
    and of repeated rows with that id exactly one stays. Other columns are ignored. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = numbered(docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("rest")), "row", scratch, "rows")
    whole = _groups(rows.select("row", "id", F.sha2("rest", 256).alias("sha"), "rest"), scratch, first, growth, widest)
    return whole.select(
        F.col("id").alias(id_col), F.col("top").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("top_row")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def _groups(rows: DataFrame, scratch: Scratch, first: int = 64, growth: int = 16, widest: int = 1 << 20) -> DataFrame:
    """row, id, sha, n, top and top_row (id and number of the row that stays) of a written table (row, id, sha, rest)."""
    done, wide, k = [], first, 0
    open_rows, group = rows, []
    while True:
        k += 1
        keyed = open_rows.withColumn("digit", F.substring("rest", 1, wide)).withColumn("ended", F.octet_length("rest") <= wide)
        key = [*group, "digit", "ended"]
        split = scratch.save(
            keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "row")).alias("top_in")).filter("n > 1").select(*key, "n", F.col("top_in.id").alias("to_id"), F.col("top_in.row").alias("to_row")),
            f"split-{k}",
        )
        # A row without a match is alone in its group and done, as is one whose text has ended.
        # One join strategy at every size: rows then move in proportion to the input.
        labelled = keyed.join(split.hint("merge"), key, "left").select(
            "row", "id", "sha", F.coalesce("n", F.lit(1)).alias("n"),
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("to_id")).alias("top"),
            F.coalesce("to_row", "row").alias("top_row"),
            F.when(F.col("n").isNotNull() & ~F.col("ended"), F.expr(f"substring(rest, {wide + 1})")).alias("rest"),
        )
        labelled = scratch.save(labelled, f"rows-{k}")
        scratch.drop(f"split-{k}", *[f"open-{k - 1}"] * (k > 2))
        done.append(labelled.filter("rest IS NULL").drop("rest"))
        open_rows = labelled.filter("rest IS NOT NULL").select("row", "id", "sha", "top_row", "rest")
        group, wide = ["top_row"], min(wide * growth, widest)
        if not open_rows.limit(1).count():
            break
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, of any names: one of each text, that of the largest id.

    Null text counts as empty; of rows that repeat an id and its text one stays. An empty table stays empty.
    Rows are numbered once and written, and leave by that number.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    row = fresh(docs, "row")
    table = numbered(docs, row, scratch, "rows")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    groups = _groups(table.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.lit(0).alias("sha"), text.alias("rest")), scratch)
    gone = groups.filter("row <> top_row").select(F.col("row").alias(row))
    return table.join(gone, row, "left_anti").select(*docs.columns)
