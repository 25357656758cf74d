"""Notes added to rows and the scope that an annotation call reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators.reads import listed
from tallywright.operators.rules import TAGS_PER_ROW

# Fixed limits of a call.
ROWS_PER_CALL = 100
NOTE_CHARS = 1000
AUTHORS = ("operator", "classifier")


def scope(rows: DataFrame, *, row_ids: list[int] | None = None, account_id: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The rows that a call reaches: those named, else an account's and / or those booked from start until before end.

    Only active and vanished rows are reached. With no scope it is all of them.
    """
    rows = listed(rows)
    if row_ids is not None:
        if not 0 < len(row_ids) <= ROWS_PER_CALL:
            raise ValueError(f"a call names 1 to {ROWS_PER_CALL} rows")
        return rows.filter(F.col("row_id").isin(row_ids))
    if account_id is not None:
        rows = rows.filter(F.col("account_id") == account_id)
    if start is not None:
        rows = rows.filter(F.col("booking_date") >= start)
    return rows.filter(F.col("booking_date") < end) if end is not None else rows


def add_note(notes: DataFrame, rows: DataFrame, note: str, author: str, last: int) -> DataFrame:
    """notes with one more for each of rows (row_id), numbered after `last`. A refused note changes nothing."""
    if author not in AUTHORS:
        raise ValueError("the author is operator or classifier")
    if not isinstance(note, str) or not note.strip() or len(note) > NOTE_CHARS:
        raise ValueError(f"a note has 1 to {NOTE_CHARS} characters")
    named = rows.select("row_id").distinct().limit(ROWS_PER_CALL + 1)
    if named.count() > ROWS_PER_CALL:
        raise ValueError(f"a call reaches at most {ROWS_PER_CALL} rows")
    place = F.row_number().over(Window.orderBy("row_id"))  # at most ROWS_PER_CALL rows
    return notes.unionByName(named.select((F.lit(last) + place).cast("long").alias("note_id"), "row_id", F.lit(author).alias("author"), F.lit(note).alias("note")))


def refused_calls(calls: DataFrame, rows: DataFrame, tags: DataFrame, adding: bool = True) -> DataFrame:
    """(call) of those refused whole, each judged against the tags before any of them.

    calls is (call, row_id, tag). A call is refused if it names over 100 rows, a row that is not active or vanished,
    or, when adding, a row that would have over 32 tags.
    """
    live = listed(rows).select("row_id", F.lit(True).alias("live"))
    held = tags.join(calls.select("row_id").distinct(), "row_id", "left_semi").groupBy("row_id").agg(F.collect_set("tag").alias("held"))
    each = calls.groupBy("call", "row_id").agg(F.collect_set("tag").alias("named")).join(live, "row_id", "left").join(held, "row_id", "left")
    bad = F.col("live").isNull()
    if adding:
        bad |= F.size(F.array_union(F.coalesce("held", F.array().cast("array<string>")), "named")) > TAGS_PER_ROW
    verdict = each.groupBy("call").agg(F.bool_or(bad).alias("bad"), F.count(F.lit(1)).alias("n"))
    return verdict.filter(F.col("bad") | (F.col("n") > ROWS_PER_CALL)).select("call")


def tag_rows(calls: DataFrame, rows: DataFrame, tags: DataFrame) -> DataFrame:
    """The tags after the calls that are not refused; a tag that a row has already stays as it is."""
    taken = calls.join(refused_calls(calls, rows, tags), "call", "left_anti").select("row_id", "tag").distinct()
    return tags.unionByName(taken.join(tags, ["row_id", "tag"], "left_anti"), allowMissingColumns=True)


def untag_rows(calls: DataFrame, rows: DataFrame, tags: DataFrame) -> DataFrame:
    """The tags without those that the calls not refused remove; a tag that was not there is no fault."""
    taken = calls.join(refused_calls(calls, rows, tags, adding=False), "call", "left_anti")
    return tags.join(taken, ["row_id", "tag"], "left_anti")


def migrate(tags: DataFrame, notes: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags and notes of superseded rows, moved (row_id, new_id), on the rows that replace them: a tag once a row, every note."""
    after = lambda df: df.join(moved, "row_id", "left").withColumn("row_id", F.coalesce("new_id", "row_id")).drop("new_id").select(*df.columns)
    return after(tags).dropDuplicates(["row_id", "tag"]), after(notes)
