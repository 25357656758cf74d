"""The tagging rulebook: conjunctive rules against rows.

Rules are joined by anchor: those with a counterparty by equality on it, the others by equality on one
token of the remittance text; what else a rule asks is a residual filter. No rule is compared with
every row. The rulebook has at most 500 rules, so it is broadcast by size alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.text import rule_text, strict_date, tokens

RULEBOOK_CAP, TAGS_PER_RULE, TAGS_PER_ROW = 500, 16, 32
PREDICATES = ("counterparty_canon", "remittance_token", "direction", "currency", "amount_min_minor", "amount_max_minor", "dom_min", "dom_max", "weekdays")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
TAG = r"^[a-z0-9][a-z0-9-]{0,31}\z"


def signature() -> Column:
    """The predicates as a JSON array with explicit nulls: equal for rules that match alike, whatever they tag."""
    texts = (*PREDICATES[:4], "weekdays")

    def one(p: str) -> Column:
        if p not in texts:
            return F.coalesce(F.col(p).cast("string"), F.lit("null"))
        quoted = F.to_json(F.array(F.col(p)))
        return F.when(F.col(p).isNull(), "null").otherwise(F.substring(quoted, F.lit(2), F.char_length(quoted) - 2))

    return F.concat(F.lit("["), F.concat_ws(",", *[one(p) for p in PREDICATES]), F.lit("]"))


def residual() -> Column:
    """What a rule (r_*) asks of a row besides its anchor; a missing or malformed field never satisfies."""
    true = F.lit(True)
    ask = lambda p, c: F.when(F.col(f"r_{p}").isNull(), true).otherwise(F.coalesce(c, F.lit(False)))
    amount = F.col("amount_minor") >= 0
    day = F.dayofmonth("_day")
    return (
        ask("counterparty_canon", F.col("_party") == F.col("r_counterparty_canon"))
        & ask("remittance_token", F.array_contains("_tokens", F.col("r_remittance_token")))
        & ask("direction", F.col("direction") == F.col("r_direction"))
        & ask("currency", F.upper(F.trim("currency")) == F.col("r_currency"))
        & ask("amount_min_minor", amount & (F.col("amount_minor") >= F.col("r_amount_min_minor")))
        & ask("amount_max_minor", amount & (F.col("amount_minor") <= F.col("r_amount_max_minor")))
        & ask("dom_min", day >= F.col("r_dom_min"))
        & ask("dom_max", day <= F.col("r_dom_max"))
        & ask("weekdays", F.col("_day").isNotNull() & F.array_contains(F.split("r_weekdays", ","), F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.weekday("_day") + 1)))
    )


def matches(rows: DataFrame, rules: DataFrame, canon=rule_text) -> DataFrame:
    """(row_id, rule_id, tags) for each rule that matches a row. canon is the text form, a column function."""
    rows = rows.withColumn("_party", canon(F.coalesce("counterparty", F.lit("")))).withColumn("_tokens", tokens(canon(F.coalesce("remittance", F.lit(""))))).withColumn("_day", strict_date(F.col("booking_date")))
    named = rules.select(*[F.col(c).alias(f"r_{c}") for c in rules.columns])
    by_party = rows.join(named.filter("r_counterparty_canon IS NOT NULL"), F.col("_party") == F.col("r_counterparty_canon"))
    worded = rows.withColumn("_token", F.explode(F.array_distinct("_tokens")))
    by_token = worded.join(named.filter("r_counterparty_canon IS NULL"), F.col("_token") == F.col("r_remittance_token"))
    keep = ["row_id", F.col("r_rule_id").alias("rule_id"), F.split("r_tags", " ").alias("tags")]
    return by_party.filter(residual()).select(*keep).unionByName(by_token.filter(residual()).select(*keep))


def judged(rows: DataFrame, tags: DataFrame, rules: DataFrame) -> DataFrame:
    """(row_id, rule_id, outcome): changed, already or skipped (the row would have over 32 tags), against the tags before."""
    found = matches(rows, rules)
    before = tags.groupBy("row_id").agg(F.collect_set("tag").alias("before"))
    union = found.groupBy("row_id").agg(F.array_distinct(F.flatten(F.collect_list("tags"))).alias("new"))
    sized = union.join(before, "row_id", "left").select("row_id", F.coalesce("before", F.array().cast("array<string>")).alias("before"), "new")
    each = found.join(sized, "row_id")
    over = F.size(F.array_union("before", "new")) > TAGS_PER_ROW
    return each.select("row_id", "rule_id", F.when(over, "skipped").when(F.size(F.array_except("tags", "before")) == 0, "already").otherwise("changed").alias("outcome"))


def apply_rules(rows: DataFrame, tags: DataFrame, rules: DataFrame) -> DataFrame:
    """The tags to add: (row_id, tag), nothing for a row that would have over 32."""
    found = matches(rows, rules).select("row_id", F.explode("tags").alias("tag")).distinct()
    new = found.join(tags, ["row_id", "tag"], "left_anti")
    counts = new.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).join(tags.groupBy("row_id").agg(F.count(F.lit(1)).alias("m")), "row_id", "left")
    over = counts.filter(F.col("n") + F.coalesce("m", F.lit(0)) > TAGS_PER_ROW)
    return new.join(over, "row_id", "left_anti")


def problems(rules: DataFrame) -> DataFrame:
    """rules with the list of what is wrong with each; an empty list is a valid rule."""
    c = F.col
    tags = F.filter(F.split(F.trim("tags"), r"\s+"), lambda t: t != "")
    checks = [
        (c("counterparty_canon").isNull() & c("remittance_token").isNull(), "no anchor"),
        (F.char_length("counterparty_canon") > 128, "counterparty too long"),
        (~F.char_length("remittance_token").between(2, 32) | ~c("remittance_token").rlike(r"^[\p{L}\p{N}]+\z"), "token"),
        (~c("direction").isin("DBIT", "CRDT"), "direction"),
        (~c("currency").rlike(r"^[A-Z]{3}\z"), "currency"),
        ((c("amount_min_minor").isNotNull() | c("amount_max_minor").isNotNull()) & c("currency").isNull(), "amount without currency"),
        ((c("amount_min_minor") < 0) | (c("amount_max_minor") < 0) | (c("amount_min_minor") > c("amount_max_minor")), "amount band"),
        (~c("dom_min").between(1, 31) | ~c("dom_max").between(1, 31) | (c("dom_min") > c("dom_max")), "day band"),
        (F.size(F.array_except(F.split("weekdays", ","), F.array(*[F.lit(w) for w in WEEKDAYS]))) > 0, "weekdays"),
        ((F.size(tags) == 0) | (F.size(tags) > TAGS_PER_RULE) | ~F.forall(tags, lambda t: t.rlike(TAG)), "tags"),
        (F.arrays_overlap(tags, F.array(F.lit("awaiting-operator"), F.lit("unclassifiable"))), "workflow tag"),
    ]
    return rules.withColumn("problems", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(what)) for bad, what in checks])))


def normal_tags(tags: Column) -> Column:
    """Lower case, trimmed, first of each; null unless there are 1 to 16 and each is well formed."""
    clean = F.array_distinct(F.transform(tags, lambda t: F.lower(F.trim(t))))
    return F.when((F.size(clean).between(1, 16)) & F.forall(clean, lambda t: t.rlike(TAG)), clean)


def rename(tags: DataFrame, old: str, new: str) -> DataFrame:
    """Rows' tags with one renamed; a row that had both has it once."""
    return tags.withColumn("tag", F.when(F.col("tag") == old, new).otherwise(F.col("tag"))).distinct()


def rename_in_rules(rules: DataFrame, old: str, new: str) -> DataFrame:
    own = F.array_distinct(F.transform(F.split("tags", " "), lambda t: F.when(t == old, new).otherwise(t)))
    return rules.withColumn("tags", F.array_join(own, " "))


def drop_tag(rules: DataFrame, tag: str) -> DataFrame:
    """Rules without a tag; a rule that has none left goes."""
    own = F.array_remove(F.split("tags", " "), tag)
    return rules.withColumn("tags", F.array_join(own, " ")).filter("tags <> ''")


def rename_everywhere(tags: DataFrame, rules: DataFrame, old: str, new: str, merge: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tags and rules with a tag renamed. A name in use, on rows or in rules, asks for merge, as merging can't be undone."""
    uses = lambda tag: not tags.filter(F.col("tag") == tag).isEmpty() or not rules.filter(F.array_contains(F.split("tags", " "), tag)).isEmpty()
    if old == new or not uses(old):
        raise ValueError("there is nothing to rename")
    if merge is not True and uses(new):
        raise ValueError("the new name is in use; renaming onto it merges the two for good and has to be asked for")
    return rename(tags, old, new), rename_in_rules(rules, old, new)


def judged_additions(book: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rule_id, outcome) of rules added one by one in order of rule_id: added, duplicate (its predicates are there) or full (the book has 500).

    Any number may be offered: the first of each signature are ordered by a bounded top-k.
    """
    signed = candidates.withColumn("s", signature())
    held = book.select(signature().alias("s")).distinct()
    first = signed.join(held, "s", "left_anti").groupBy("s").agg(F.min("rule_id").alias("rule_id")).select("rule_id")
    room = RULEBOOK_CAP - book.count()
    taken = first.orderBy("rule_id").limit(max(room, 0)).withColumn("added", F.lit(True))
    outcome = F.when(F.col("added"), "added").when(F.col("first"), "full").otherwise("duplicate")
    return signed.join(first.withColumn("first", F.lit(True)), "rule_id", "left").join(taken, "rule_id", "left").select("rule_id", outcome.alias("outcome"))


def sentence() -> Column:
    """A rule in words, all nine predicates."""
    c = F.col
    between = lambda lo, hi: F.concat(F.coalesce(c(lo).cast("string"), F.lit("any")), F.lit(" to "), F.coalesce(c(hi).cast("string"), F.lit("any")))
    amount = c("amount_min_minor").isNotNull() | c("amount_max_minor").isNotNull()
    said = F.concat_ws(
        "; ", F.concat(F.lit("counterparty is "), "counterparty_canon"), F.concat(F.lit("text has "), "remittance_token"), F.when(c("direction") == "DBIT", "money out").when(c("direction") == "CRDT", "money in"),
        F.when(amount, F.concat_ws(" ", F.lit("amount"), between("amount_min_minor", "amount_max_minor"), F.lit("minor"), "currency")).otherwise(F.concat(F.lit("currency is "), "currency")),
        F.when(c("dom_min").isNotNull() | c("dom_max").isNotNull(), F.concat(F.lit("day "), between("dom_min", "dom_max"))), F.concat(F.lit("on "), "weekdays"),
    )
    return F.concat(said, F.lit(" -> "), "tags")
