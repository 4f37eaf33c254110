"""Evaluation: summaries of judged rows, confusion, agreement and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import number, ratio
from . import ranks


def correctness(row: dict[str, Column]) -> Column:
    """A row's verdict: is_correct, else correct, else the judgement's word, else a score above 0; null if none is given."""
    word = F.lower(F.trim(row["judgement"]))
    judged = F.when(word.isin("correct", "true", "yes", "pass"), True).when(word.isin("incorrect", "false", "no", "fail"), False)
    return F.coalesce(row["is_correct"], row["correct"], judged, number(row["score"].cast("string")) > 0)


def summary(df: DataFrame, *groups: str, correct: str = "correct", score: str = "score") -> DataFrame:
    """total, judged, correct_rows, accuracy (over judged rows) and average_score by groups."""
    judged, right = F.count(correct), F.count(F.when(F.col(correct), 1))
    return df.groupBy(*groups).agg(
        F.count("*").alias("total"), judged.alias("judged"), right.alias("correct_rows"),
        ratio(right, judged).alias("accuracy"), F.avg(score).alias("average_score"),
    )


def protocol(df: DataFrame, score: str, *dimensions: str) -> DataFrame:
    """The 1/0/-1 protocol overall and by each dimension: shares are of all rows, judged or not."""
    groups = [F.col(d) for d in dimensions]
    share = lambda v: (F.count(F.when(F.col(score) == v, 1)) / F.count("*")).alias({1: "right", 0: "missing", -1: "wrong"}[v])
    sets = df.groupingSets([[], *([g] for g in groups)], *groups)
    return sets.agg(F.grouping_id().cast("int").alias("grouping"), F.count("*").alias("total"), share(1), share(0), share(-1))


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    return df.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull()).groupBy(gold, predicted).agg(F.count("*").alias("n"))


def precision_recall(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1, support for each label; 0 where a denominator is 0.

    Sums over the confusion matrix, which is as small as the set of labels.
    """
    matrix = confusion(df, gold, predicted)
    per_gold = matrix.groupBy(F.col(gold).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0)).alias("hits"))
    per_pred = matrix.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("claimed"))
    both = per_gold.join(per_pred, "label", "full").na.fill(0)
    share = lambda a, b: F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0))
    both = both.withColumns({"precision": share("hits", "claimed"), "recall": share("hits", "support")})
    p, r = F.col("precision"), F.col("recall")
    return both.select("label", p, r, F.coalesce(ratio(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def matthews(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row, mcc: the multiclass correlation; null where a side has one class only or there are no rows."""
    matrix = confusion(df, gold, predicted)
    golds = matrix.groupBy(F.col(gold).alias("k")).agg(F.sum("n").alias("t"))
    preds = matrix.groupBy(F.col(predicted).alias("k")).agg(F.sum("n").alias("p"))
    both = golds.join(preds, "k", "full").na.fill(0)
    sums = both.agg(F.sum("t").cast("double").alias("s"), F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("t") * F.col("t")).alias("tt"))
    hits = matrix.agg(F.sum(F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0)).alias("c"))
    one = sums.join(F.broadcast(hits), F.lit(True))  # one row each
    square = F.col("s") * F.col("s")
    root = F.sqrt((square - F.col("pp")) * (square - F.col("tt")))
    return one.select(F.when(root > 0, (F.col("c") * F.col("s") - F.col("tp")) / root).alias("mcc"))


def rank_quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: n, min, max and the values at place max(1, floor(n * share)), counted from the smallest.

    Exact at any size: counts by value come first, and the running sum over
    distinct values goes by blocks of their order.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    run = ranks.running_sum(counts, [value], "_n", "_upto")
    rows = run.join(F.broadcast(run.agg(F.sum("_n").alias("_all"))), F.lit(True))  # one row
    at = lambda p: F.min(F.when(F.col("_upto") >= F.greatest(F.lit(1), F.floor(F.col("_all") * p)), F.col(value)))
    return rows.agg(F.sum("_n").alias("n"), F.min(value).alias("min"), *(at(p).alias(k) for k, p in shares.items()), F.max(value).alias("max"))


def extremes(df: DataFrame, columns: list[str], identity: str) -> DataFrame:
    """For each column its smallest and largest number and the first identity that has it."""
    long = df.unpivot([identity], columns, "column", "value").where("value is not null")
    return long.groupBy("column").agg(
        F.min("value").alias("least"), F.min_by(identity, F.struct("value", identity)).alias("least_at"),
        F.max("value").alias("most"), F.max_by(identity, F.struct(F.col("value"), -F.col(identity))).alias("most_at"),
    )


#: What a judge may say, from which score on each is said, and the gates of a correct reply.
ANSWERS, PATHS = ("correct", "partial", "incorrect", "unassessable"), ("sound", "partially_sound", "unsound", "no_trajectory", "unassessable")
ANSWER_FROM, PATH_FROM = ((0.8, "correct"), (0.25, "partial")), ((0.9, "sound"), (0.5, "partially_sound"))
GATES, WEIGHTS, UNCHECKED = (0.8, 0.7), (0.65, 0.35), 0.5


def clamp_score(c: Column) -> Column:
    """A score from 0 to 1; what is no number is 0."""
    n = c.cast("string").try_cast("double")
    return F.when(n.isNull() | F.isnan(n), 0.0).otherwise(F.least(F.greatest(n, F.lit(0.0)), F.lit(1.0)))


def _said(word: Column, allowed: tuple[str, ...], default: Column) -> Column:
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(word, F.lit("")))), "[- ]", "_")
    return F.when(low.isin(*allowed), low).otherwise(default)


def _answer_of(score: Column) -> Column:
    return F.when(score >= ANSWER_FROM[0][0], ANSWER_FROM[0][1]).when(score >= ANSWER_FROM[1][0], ANSWER_FROM[1][1]).otherwise("incorrect")


def _path_of(score: Column) -> Column:
    return F.when(score >= PATH_FROM[0][0], PATH_FROM[0][1]).when(score >= PATH_FROM[1][0], PATH_FROM[1][1]).when(score <= 0, "no_trajectory").otherwise("unsound")


def judged_replies(df: DataFrame, criteria: str = "criteria", anchors: str = "anchors", atom: Column | None = None) -> DataFrame:
    """df with the judge's verdict brought into form: answer_score, trajectory_score, both judgements, is_correct, overall_score, capped.

    df: answer_score, trajectory_score, answer_judgement, trajectory_judgement
    (anything), contradiction (boolean) and scope, criteria
    (array<struct<answer_matched boolean, trajectory_supported boolean>>) and
    anchors (array). A score may not pass the share of criteria that are met;
    high scores without criteria, and support without an anchor, count half.
    atom: rows whose answer is equal by rule; their answer is correct. Nulls are
    empty or false; df's own columns of these names give way.
    """
    answer, path = clamp_score(F.col("answer_score")), clamp_score(F.col("trajectory_score"))
    rows = df.withColumns({"_a": answer, "_t": path})
    rows = rows.withColumns({"_aj": _said(F.col("answer_judgement"), ANSWERS, _answer_of(F.col("_a"))), "_tj": _said(F.col("trajectory_judgement"), PATHS, _path_of(F.col("_t")))})
    n = F.coalesce(F.size(F.filter(criteria, lambda c: c.isNotNull())), F.lit(0))
    met = lambda name: F.size(F.filter(criteria, lambda c: F.coalesce(c[name], F.lit(False)))) / n
    high = (n == 0) & ((F.col("_a") >= GATES[0]) | (F.col("_t") >= GATES[1]))
    cap = lambda c, name: F.when(n > 0, F.least(F.col(c), met(name))).when(high, F.least(F.col(c), F.lit(UNCHECKED))).otherwise(F.col(c))
    rows = rows.withColumns({"_a2": cap("_a", "answer_matched"), "_t2": cap("_t", "trajectory_supported")})
    loose = (F.col("_t2") > UNCHECKED) & (F.coalesce(F.size(anchors), F.lit(0)) <= 0)
    rows = rows.withColumns({"_t3": F.when(loose, UNCHECKED).otherwise(F.col("_t2")), "_tj": F.when(loose & (F.col("_tj") == "sound"), "partially_sound").otherwise(F.col("_tj"))})
    equal = F.coalesce(atom, F.lit(False)) if atom is not None else F.lit(False)
    mend = equal & ((F.col("_a2") < GATES[0]) | (F.col("_aj") != "correct"))
    rows = rows.withColumns({"_a3": F.when(mend, 1.0).otherwise(F.col("_a2")), "_aj": F.when(mend, "correct").otherwise(F.col("_aj"))})
    rows = rows.withColumns({
        "_aj": F.when((F.col("_a3") < GATES[0]) & (F.col("_aj") == "correct"), _answer_of(F.col("_a3"))).otherwise(F.col("_aj")),
        "_tj": F.when((F.col("_t3") < GATES[1]) & F.col("_tj").isin("sound", "partially_sound"), _path_of(F.col("_t3"))).otherwise(F.col("_tj")),
    })
    against = lambda what: F.coalesce(F.col("contradiction"), F.lit(False)) & F.coalesce(F.col("scope"), F.lit("unclear")).isin(what, "both", "unclear")
    right = (F.col("_a3") >= GATES[0]) & (F.col("_aj") == "correct") & ~against("answer")
    sound = (F.col("_t3") >= GATES[1]) & F.col("_tj").isin("sound", "partially_sound") & ~against("trajectory")
    capped = (F.col("_a2") < F.col("_a")) | (F.col("_t3") < F.col("_t"))
    own = ("answer_score", "trajectory_score", "answer_judgement", "trajectory_judgement", "is_correct", "overall_score", "capped")
    out = rows.withColumns({"_ok": right & sound, "_all": F.round(WEIGHTS[0] * F.col("_a3") + WEIGHTS[1] * F.col("_t3"), 4), "_capped": capped})
    values = ("_a3", "_t3", "_aj", "_tj", "_ok", "_all", "_capped")
    return out.select(*(c for c in df.columns if c not in own), *(F.col(v).alias(c) for v, c in zip(values, own, strict=True)))
