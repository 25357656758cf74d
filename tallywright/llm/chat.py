r"""Chat formatting with a grammar round trip.

Grammar of a rendered conversation:

    conversation := turn*
    turn := "[SYS]" body "[/SYS]"         role system
          | "[INST]" body "[/INST]"       role user
          | "<s>" body "</s>"             role assistant
          | "[TURN]" body "[SEP]" body "[/TURN]"   any other role, then its text
    body := a string without a control string; "\" and the character after it stand for that character

A conversation is first rendered as it is, parsed by that grammar, and compared to its source. If the
recovered turns differ, conflicting content is escaped ("\" doubled, control strings broken after their
first character) and the result is parsed and compared again. What still differs is an error, never output.
An escaped body has no control string, no control string is the start of another, and none has "[" or
"<" inside, so none can arise where body and mark meet: the second form always agrees.

DataFrame functions only. A conversation's turns are gathered in one row, as its rendered form is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TURN = r"(?s)\[SYS\].*?\[/SYS\]|\[INST\].*?\[/INST\]|<s>.*?</s>|\[TURN\].*?\[SEP\].*?\[/TURN\]"
#: Role, opening and closing mark.
MARKS = (("system", "[SYS]", "[/SYS]"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, r"\[(/?(?:SYS|INST|TURN|SEP)\])", r"[\\$1")
    return F.regexp_replace(text, r"<(/?s>)", r"<\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _render(turns: Column, encode) -> Column:
    def one(t: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for role, start, stop in MARKS:
            out = out.when(t["role"] == role, F.concat(F.lit(start), encode(t["text"]), F.lit(stop)))
        return out.otherwise(F.concat(F.lit("[TURN]"), encode(t["role"]), F.lit("[SEP]"), encode(t["text"]), F.lit("[/TURN]")))

    return F.array_join(F.transform(turns, one), "")


def _read(piece: Column) -> Column:
    """The turn (role, text) of a piece that matches the grammar."""
    inner = lambda start, stop: unescape(F.substring(piece, F.lit(len(start) + 1), F.char_length(piece) - len(start) - len(stop)))
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    out = F.when(F.lit(False), turn(F.lit(""), F.lit("")))
    for role, start, stop in MARKS:
        out = out.when(F.startswith(piece, F.lit(start)), turn(F.lit(role), inner(start, stop)))
    body = F.substring(piece, F.lit(7), F.char_length(piece) - 13)
    at = F.locate("[SEP]", body)
    return out.otherwise(turn(unescape(F.substring(body, F.lit(1), at - 1)), unescape(F.substring(body, at + 5, F.char_length(body)))))


def parse(formatted: Column) -> Column:
    """The pieces of a rendered conversation, array<string>; what doesn't match the grammar is left out."""
    return F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))


def turns_of(pieces: Column) -> Column:
    return F.transform(pieces, _read)


def loss_mask(pieces: Column) -> Column:
    """For each code point of the rendered form 1 if an assistant said it, else 0."""

    def one(p: Column) -> Column:
        n = F.char_length(p)
        return F.when(F.startswith(p, F.lit("<s>")), F.concat(F.lit("000"), F.repeat(F.lit("1"), n - 7), F.lit("0000"))).otherwise(F.repeat(F.lit("0"), n))

    return F.array_join(F.transform(pieces, one), "")


def masked(formatted: Column, mask: Column) -> Column:
    """The unescaped texts that stand under the mask in the rendered form, array<string>: one for each run of 1."""
    runs = F.aggregate(
        F.regexp_extract_all(mask, F.lit("0+|1+"), F.lit(0)),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at: int, n: int>>").alias("found")),
        lambda a, r: F.struct(
            (a["at"] + F.char_length(r)).alias("at"),
            F.when(F.startswith(r, F.lit("1")), F.array_append(a["found"], F.struct(a["at"].alias("at"), F.char_length(r).alias("n")))).otherwise(a["found"]).alias("found"),
        ),
    )
    return F.transform(runs["found"], lambda r: unescape(F.substring(formatted, r["at"], r["n"])))


def format_chats(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, formatted, escaped, turns (role, text; read back), loss_mask.

    Rows are ordered by turn, null first; rows of one turn by role, then text. Null role or text is empty.
    Rows without an id are one conversation. Repeated rows are turns of their own. An empty table gives no
    rows; other columns are ignored.
    """
    said = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = rows.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(said)).alias("all"))
    chats = chats.select("id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("want"))
    chats = chats.withColumn("f", _render(F.col("want"), lambda x: x))
    chats = chats.withColumn("pieces", parse(F.col("f")))
    chats = chats.withColumn("same", (F.array_join("pieces", "") == F.col("f")) & (turns_of(F.col("pieces")) == F.col("want")))
    chats = chats.withColumn("f", F.when(F.col("same"), F.col("f")).otherwise(_render(F.col("want"), escape)))
    chats = chats.withColumn("pieces", F.when(F.col("same"), F.col("pieces")).otherwise(parse(F.col("f"))))
    chats = chats.withColumn("turns", turns_of(F.col("pieces")))
    whole = F.col("same") | ((F.array_join("pieces", "") == F.col("f")) & (F.col("turns") == F.col("want")))
    formatted = F.when(whole, F.col("f")).otherwise(F.raise_error(F.lit("a rendered conversation doesn't read back as its source")))
    return chats.select(F.col("id").alias(id_col), formatted.alias("formatted"), (~F.col("same")).alias("escaped"), "turns", loss_mask(F.col("pieces")).alias("loss_mask"))
