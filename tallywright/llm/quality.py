"""Quality rules: base rules, then robust multivariate outliers per language and source.

Every text gives a vector of transformed statistics. For each language and source, a minimum-covariance-determinant
estimate gives centre and covariance; a text is rejected if its squared Mahalanobis distance exceeds CUTOFF. There
are two starts: medians with deviations from them, and the covariance of squashed deviations, which knows how
statistics go together. From each, concentration steps take the three quarters of rows nearest to the centre, until no
pool's determinant falls any more; the start of the least determinant holds. DataFrame functions only: moments are
sums by group, the Cholesky factor and the distance are column expressions.

A language and source with fewer than LEAST rows that pass the base rules is judged with the other small sources of its
language; if they are fewer than LEAST in all, by the model of all rows of the table. So every row that passes the base rules is
judged. A null language or source is a group of its own. FLOOR holds the least standard deviation by statistic, so a
group of texts that hardly differ does not reject plain variation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import SPACE, Scratch

#: Statistic and least standard deviation.
FLOOR = {"word_length": 0.10, "symbols": 0.12, "repeated_lines": 0.08, "repeated_words": 0.08, "capitals": 0.10, "marks": 0.05}
CUTOFF = 27.86  # chi-square of six degrees of freedom: exceeded with probability 1e-4
SHARE = 0.75  # of rows that a concentration step keeps
CONSISTENT = 1.36  # makes the covariance of the nearest 75% of six-dimensional normal rows that of all
LEAST = 100
FALL = 1e-3  # share of the determinant by which a step has to lower it for another one to follow
MODELS = 20_000  # models that may be broadcast; more are joined
_BLANKS = " \t\n\x0b\f\r"


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long), and n_lines, n_capitals, n_marks."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.withColumn("_text", text)
    trimmed = F.btrim("_text", F.lit(_BLANKS))
    df = df.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+")))
    df = df.withColumn("n_words", F.size("_w").cast("long")).withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x))).drop("_w")
    later = lambda i: F.slice("_h", F.lit(i), F.size("_h"))
    windows = F.zip_with(F.zip_with("_h", later(2), lambda x, y: F.xxhash64(x, y)), later(3), lambda x, y: F.xxhash64(x, y))
    df = df.withColumn("_g", F.when(F.size("_h") >= 4, F.slice(windows, F.lit(1), F.size("_h") - 2)).otherwise(F.array().cast("array<bigint>")))
    df = df.drop("_h").withColumn("_again", F.size(F.array_distinct("_g")) < F.size("_g"))
    # Windows that occur again stand side by side once sorted; the words that they cover are counted once.
    df = df.withColumn("_s", F.when(F.col("_again"), F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("_g")
    df = df.withColumn("_m", F.size("_s"))
    repeated = F.expr("filter(sequence(0, _m - 1), j -> (j > 0 AND _s[j].x = _s[greatest(j - 1, 0)].x) OR (j < _m - 1 AND _s[j].x = _s[least(j + 1, _m - 1)].x))")
    df = df.withColumn("_j", F.when(F.col("_again"), repeated))
    df = df.withColumn("_p", F.expr("sort_array(transform(_j, j -> _s[j].i))")).drop("_s", "_j", "_m")
    covered = F.expr("aggregate(_p, named_struct('n', 0L, 'end', -3), (a, p) -> named_struct('n', a.n + least(3, p + 3 - a.end), 'end', p + 3), a -> a.n)")
    lines = F.filter(F.split("_text", "\n"), lambda x: F.translate(x, _BLANKS, "") != "")
    df = df.withColumn("n_repeat_words", F.when(F.col("_again"), covered).otherwise(F.lit(0).cast("long"))).withColumn("_lines", lines)
    length = lambda c: F.char_length(c).cast("long")
    return df.select(
        *docs.columns, "n_words",
        length(F.translate("_text", _BLANKS, "")).alias("word_chars"),
        (length("_text") - length(F.translate("_text", "#*$%&|<>", ""))).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").cast("long").alias("n_lines"),
        (length("_text") - length(F.regexp_replace("_text", r"\p{Lu}+", ""))).alias("n_capitals"),
        (length("_text") - length(F.regexp_replace("_text", r"[^\p{L}\x20\x09-\x0D]+", ""))).alias("n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "word_length": F.log(F.greatest(share("word_chars", "n_words"), F.lit(0.1))),
        "symbols": F.sqrt(share("n_symbols", "n_words")),
        "repeated_lines": F.col("n_dup_lines") / (F.col("n_lines") + 10),
        "repeated_words": F.col("n_repeat_words") / (F.col("n_words") + 100),
        "capitals": F.sqrt(share("n_capitals", "word_chars")),
        "marks": share("n_marks", "word_chars"),
    }


def _distance(rows: DataFrame, model: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """rows with d2, by the centre (c_*) and Cholesky factor (l_i_j) of their pool."""
    df = rows.join(model, "pool", how)
    for i, a in enumerate(names):
        left = F.col(a) - F.col(f"c_{a}")
        for j in range(i):
            left = left - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        df = df.withColumn(f"y_{i}", left / F.col(f"l_{i}_{i}"))
    d2 = sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, len(names))), F.col("y_0") * F.col("y_0"))
    return df.withColumn("d2", d2)


def _factor(model: DataFrame, names: list[str]) -> DataFrame:
    """The Cholesky factor of each model's covariance (v_i_j), and the log of its determinant."""
    for i in range(len(names)):
        for j in range(i + 1):
            left = F.col(f"v_{i}_{j}")
            for k in range(j):
                left = left - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            model = model.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(left, F.lit(1e-9))) if i == j else left / F.col(f"l_{j}_{j}"))
    determinant = sum((2 * F.log(f"l_{i}_{i}") for i in range(1, len(names))), 2 * F.log("l_0_0"))
    return model.select("pool", "start", *[f"c_{a}" for a in names], *[f"l_{i}_{j}" for i in range(len(names)) for j in range(i + 1)], determinant.alias("determinant"))


def _moments(rows: DataFrame, names: list[str]) -> DataFrame:
    """Centre and covariance by pool and start, with the floors."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    sums = rows.groupBy("pool", "start").agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(f"s_{a}") for a in names], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q_{i}_{j}") for i, j in pairs])
    centre = {a: F.col(f"s_{a}") / F.col("n") for a in names}
    out = [centre[a].alias(f"c_{a}") for a in names]
    for i, j in pairs:
        spread = (F.col(f"q_{i}_{j}") / F.col("n") - centre[names[i]] * centre[names[j]]) * CONSISTENT
        if i == j:  # rounding can leave a little less than nothing
            spread = F.greatest(spread, F.lit(0.0)) + FLOOR[names[i]] ** 2
        out.append(spread.alias(f"v_{i}_{j}"))
    return _factor(sums.select("pool", "start", *out), names)


def _starts(good: DataFrame, names: list[str], small, scratch: Scratch) -> DataFrame:
    """Two starts for each pool: 0 has medians and deviations from them, 1 the covariance of squashed deviations besides."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    median = scratch.save(good.groupBy("pool").agg(*[F.percentile_approx(a, 0.5).alias(f"c_{a}") for a in names]), "median")
    off = good.join(small(median), "pool")
    wide = off.groupBy("pool").agg(*[(1.4826 * F.percentile_approx(F.abs(F.col(a) - F.col(f"c_{a}")), 0.5)).alias(f"m_{a}") for a in names])
    wide = wide.select("pool", *[F.greatest(f"m_{a}", F.lit(FLOOR[a])).alias(f"m_{a}") for a in names])
    wide = scratch.save(median.join(wide, "pool"), "wide")
    plain = [(F.col(f"m_{names[i]}") ** 2 if i == j else F.lit(0.0)).alias(f"v_{i}_{j}") for i, j in pairs]
    plain = wide.select("pool", F.lit(0).alias("start"), *[f"c_{a}" for a in names], *plain)
    squashed = good.join(small(wide), "pool").select("pool", *[F.tanh((F.col(a) - F.col(f"c_{a}")) / F.col(f"m_{a}")).alias(a) for a in names])
    sums = squashed.groupBy("pool").agg(*[F.avg(F.col(names[i]) * F.col(names[j])).alias(f"t_{i}_{j}") for i, j in pairs])
    # A share of the plain start keeps the factor away from zero.
    mixed = [(F.col(f"m_{names[i]}") * F.col(f"m_{names[j]}") * (F.col(f"t_{i}_{j}") + F.lit(0.1 if i == j else 0.0))).alias(f"v_{i}_{j}") for i, j in pairs]
    mixed = wide.join(sums, "pool").select("pool", F.lit(1).alias("start"), *[f"c_{a}" for a in names], *mixed)
    return _factor(plain.unionByName(mixed), names)


def _least(good: DataFrame, names: list[str], small, scratch: Scratch) -> DataFrame:
    """The model of the least determinant of each pool, by concentration steps from each start."""
    now = scratch.save(_starts(good, names, small, scratch), "model-0").withColumn("fell", F.lit(True))
    step, best = 0, None
    while now.filter("fell").limit(1).count():
        step += 1
        model = now.filter("fell").drop("fell")
        limit = _distance(good, small(model), names).groupBy("pool", "start").agg(F.percentile_approx("d2", SHARE, 1000).alias("limit"))
        limited = scratch.save(model.join(limit, ["pool", "start"]), f"limit-{step}")
        nearest = _distance(good, small(limited), names).filter("d2 <= limit").select("pool", "start", *names)
        after = _moments(nearest, names)
        # The first step leaves the starts, whose determinants are not those of any rows.
        fell = F.lit(True) if step == 1 else F.col("determinant") < F.col("was") + math.log1p(-FALL)
        after = after.join(model.select("pool", "start", F.col("determinant").alias("was")), ["pool", "start"]).withColumn("fell", fell).drop("was")
        now = scratch.save(after, f"model-{step}")
        best = now if best is None else best.unionByName(now)
    if best is None:
        return now.drop("fell")
    columns = [c for c in best.columns if c not in ("pool", "fell")]
    return best.groupBy("pool").agg(F.min_by(F.struct(*columns), F.struct("determinant", "start")).alias("m")).select("pool", "m.*")


def judge(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: the columns in keep (default doc_id), the statistics, base_failed, distance, kept.

    Null text counts as empty. distance is null where the row fails the base rules, and no model judges it. Columns of
    docs that are not named are ignored, and names that the statistics have too are no matter. An empty table gives no rows.
    """
    keep = ["doc_id"] if keep is None else keep
    rows = _judged(docs, text_col, lang_col, source_col, keep)
    return rows.select(*[F.col(f"k_{c}").alias(c) for c in keep], *COUNTS, "base_failed", F.col("d2").alias("distance"), "kept")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _judged(docs: DataFrame, text_col: str, lang_col: str, source_col: str, keep: list[str]) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "quality")
    named = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    vector = _vector()
    names = list(vector)
    mark = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c)))
    rows = text_statistics(named, "t").drop("t").withColumn("base_failed", base_failed()).withColumns(vector).withColumn("lang", mark("lang")).withColumn("source", mark("source"))
    rows = rows.withColumn("of", F.when(~F.col("base_failed"), F.to_json(F.struct("lang", "source"))))
    rows = scratch.save(rows.drop("n_lines", "n_capitals", "n_marks"), "rows")

    good = rows.filter("NOT base_failed").select("of", "lang", "source", *names)
    sizes = scratch.save(good.groupBy("of", "lang", "source").agg(F.count(F.lit(1)).alias("n")), "sizes")
    left = sizes.filter(F.col("n") < LEAST).groupBy("lang").agg(F.sum("n").alias("left"))
    pools = sizes.join(left, "lang", "left").select(
        "of", F.when(F.col("n") >= LEAST, F.col("of")).when(F.col("left") >= LEAST, F.to_json(F.struct("lang"))).otherwise(F.lit("")).alias("pool")
    )
    pools = scratch.save(pools, "pools")
    # One row per language and source: broadcast as long as they are few.
    small = F.broadcast if pools.count() <= MODELS else lambda df: df
    pooled = good.join(small(pools), "of").select("pool", *names)
    if pools.filter("pool = ''").limit(1).count():  # judged by the model of all rows
        pooled = pooled.filter("pool <> ''").unionByName(good.select(F.lit("").alias("pool"), *names))
    pooled = scratch.save(pooled, "vectors")
    model = scratch.save(pools.join(_least(pooled, names, small, scratch), "pool").select("of", *[f"c_{a}" for a in names], *[f"l_{i}_{j}" for i in range(len(names)) for j in range(i + 1)]), "models")
    scratch.drop("vectors")
    judged = _distance(rows.withColumnRenamed("of", "pool"), small(model.withColumnRenamed("of", "pool")), names, "left")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF))


def drop_poor(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source) that stay, with all their columns.

    Each row is judged on its own and carries its columns, so repeated rows stay or go alike. Null and empty texts go. An
    empty table stays empty. Other columns may have any name.
    """
    return _judged(docs, "text", "lang", "source", docs.columns).filter("kept").select(*[F.col(f"k_{c}").alias(c) for c in docs.columns])
