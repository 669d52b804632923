"""Span scores, threshold tuning, ownership pairing and judge summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brakta.functions.text import collapse, f_beta, ratio

#: Candidate thresholds 0.05, 0.10 ... 0.95.
GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))
#: Identifier fields that pair with an owner.
PAIR_FIELDS = ("personnummer", "email", "phone", "address")


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where undefined."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, f_beta(p, r)


def mentions(long: DataFrame) -> DataFrame:
    """Distinct (row_id, label, mention), lower-cased, without empty ones."""
    return long.select("row_id", "label", F.lower("mention").alias("mention")).filter("mention <> ''").distinct()


def confusion(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(label, tp, fp, fn): set agreement of mentions per row, summed by label."""
    g, p = mentions(gold).withColumn("g", F.lit(True)), mentions(pred).withColumn("p", F.lit(True))
    both = g.join(p, ["row_id", "label", "mention"], "full_outer")
    return both.groupBy("label").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def report(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, ord, support, tp, fp, fn, precision, recall, f1): one row per label with any count, in taxonomy order; scores unrounded."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r, f = prf(tp, fp, fn)
    return counts.join(F.broadcast(labels.select("label", "ord")), "label").filter("tp + fp + fn > 0").select("label", "ord", (tp + fn).alias("support"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def totals(rep: DataFrame) -> DataFrame:
    """Micro scores from sums over all labels; macro F1 over labels with support."""
    s = rep.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select("tp", "fp", "fn", p.alias("micro_precision"), r.alias("micro_recall"), f.alias("micro_f1"), "macro_f1")


def best_confidence(candidates: DataFrame, floor: float = 0.05) -> DataFrame:
    """(row_id, label, mention, confidence): candidates at the floor or above, the best of each mention; none given is 1."""
    c = F.coalesce("confidence", F.lit(1.0))
    return candidates.select("row_id", "label", F.lower("mention").alias("mention"), c.alias("confidence")).filter((F.col("mention") != "") & (F.col("confidence") >= floor)).groupBy("row_id", "label", "mention").agg(F.max("confidence").alias("confidence"))


def counts_on_grid(candidates: DataFrame, gold: DataFrame, labels: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """(label, thr, tp, fp, fn) for every label and threshold.

    Candidates and gold meet once; each pair then counts into the grid by one
    aggregate with a column per threshold, so rows are not multiplied by the grid.
    """
    g = mentions(gold).withColumn("g", F.lit(True))
    met = best_confidence(candidates).join(g, ["row_id", "label", "mention"], "full_outer")
    sums = []
    for i, t in enumerate(grid):
        hit = F.col("confidence") >= F.lit(t)
        sums += [F.count_if(hit & F.col("g").isNotNull()).alias(f"tp{i}"), F.count_if(hit & F.col("g").isNull()).alias(f"fp{i}")]
    per = met.groupBy("label").agg(*sums, F.count_if(F.col("g").isNotNull()).alias("gold"))
    rows = F.array(*[F.struct(F.lit(t).alias("thr"), F.coalesce(f"tp{i}", F.lit(0)).alias("tp"), F.coalesce(f"fp{i}", F.lit(0)).alias("fp"), (F.coalesce("gold", F.lit(0)) - F.coalesce(f"tp{i}", F.lit(0))).alias("fn")) for i, t in enumerate(grid)])
    return labels.select("label", "ord").join(per, "label", "left").select("label", "ord", F.inline(rows))


def tune(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """(label, ord, thr, score): each label's best F-beta, the lowest threshold among equals."""
    p, r, _ = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    scored = counts.withColumn("score", f_beta(p, r, beta))
    return scored.groupBy("label", "ord").agg(F.max(F.struct("score", (-F.col("thr")).alias("low"))).alias("b")).select("label", "ord", (-F.col("b.low")).alias("thr"), F.col("b.score").alias("score"))


def at_thresholds(candidates: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Candidates at or above their label's threshold, as predictions; the thresholds are one row a label."""
    return best_confidence(candidates).join(F.broadcast(thresholds.select("label", "thr")), "label").filter("confidence >= thr").select("row_id", "label", "mention")


def fixed_and_tuned(val_candidates: DataFrame, val_gold: DataFrame, candidates: DataFrame, gold: DataFrame, labels: DataFrame, beta: float = 1.0) -> DataFrame:
    """report() of the same candidates twice, told by ``threshold``: at 0.5 for all labels (0.5), and at thresholds tuned on the validation rows (-1)."""
    tuned = tune(counts_on_grid(val_candidates, val_gold, labels), beta)
    half = labels.select("label", F.lit(0.5).alias("thr"))
    one = lambda thr, mark: report(confusion(gold, at_thresholds(candidates, thr)), labels).withColumn("threshold", F.lit(mark))
    return one(half, 0.5).unionByName(one(tuned, -1.0))


def edges(rows: DataFrame, records: str) -> DataFrame:
    """Distinct (row_id, field, value, owner) of records with a name. rows: (row_id, array of maps)."""
    r = rows.select("row_id", F.explode(records).alias("r"))
    owner = collapse(F.col("r")["name"])
    fields = F.array(*[F.struct(F.lit(k).alias("field"), collapse(F.col("r")[k]).alias("value")) for k in PAIR_FIELDS])
    return r.select("row_id", owner.alias("owner"), F.inline(fields)).filter("owner <> '' AND value <> ''").select("row_id", "field", "value", "owner").distinct()


def pairing(predicted: DataFrame, truth: DataFrame, ids: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(row_id, precision, recall, f1, pairs_checked, success): nothing predicted is full precision, nothing true full recall; the pairs checked are the predicted ones."""
    keys = ["row_id", "field", "value", "owner"]
    both = predicted.withColumn("p", F.lit(1)).join(truth.withColumn("t", F.lit(1)), keys, "full_outer").groupBy("row_id").agg(F.count("p").alias("np"), F.count("t").alias("nt"), F.count(F.col("p") + F.col("t")).alias("hit"))
    all_ = ids.join(both, "row_id", "left").na.fill(0, ["np", "nt", "hit"])
    p = F.when(F.col("np") == 0, 1.0).otherwise(F.col("hit") / F.greatest("np", F.lit(1)))
    r = F.when(F.col("nt") == 0, 1.0).otherwise(F.col("hit") / F.greatest("nt", F.lit(1)))
    scored = all_.select("row_id", p.alias("precision"), r.alias("recall"), F.col("np").alias("pairs_checked"))
    return scored.withColumn("f1", f_beta(F.col("precision"), F.col("recall"))).withColumn("success", F.col("f1") >= threshold)


def judge_summary(judged: DataFrame) -> DataFrame:
    """Per metric: mean of its scores, passed, count and pass rate. judged: (metric, score nullable, success)."""
    return judged.groupBy("metric").agg(F.avg("score").alias("mean_score"), F.count_if("success").alias("passed"), F.count("*").alias("n")).withColumn("pass_rate", ratio(F.col("passed"), F.col("n")))


def verdicts(rows: DataFrame, metrics: list[str], threshold: float = 0.5) -> DataFrame:
    """(row_id, metric, score, success): a verdict of each metric on each row, as judges score them; no score is no success. rows: (row_id, metrics)."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in metrics])
    return rows.select("row_id", F.inline(each)).withColumn("success", F.coalesce(F.col("score") >= threshold, F.lit(False)))


def gate(judged: DataFrame) -> DataFrame:
    """Pass rate of all rows, 0 when there are none."""
    return judged.agg(F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)).alias("pass_rate"), F.count("*").alias("n"))


def quality_gate(swedish: Column, invents: Column, completeness: Column) -> Column:
    """0 if not in the language, 2 if it invents personal data, else the completeness verdict."""
    return F.when(~swedish, 0).when(invents, 2).otherwise(completeness)


def rubric_scores(names: list[str], judged: str) -> list[Column]:
    """<name>_score of each rubric of a struct, '' where there is none."""
    return [F.coalesce(F.col(f"{judged}.{n}.score").cast("string"), F.lit("")).alias(f"{n}_score") for n in names]


def min_score_filter(rows: DataFrame, scores: list[str], least: float) -> DataFrame:
    """Rows whose lowest judge score reaches a floor."""
    return rows.filter(F.least(*[F.expr(f"try_cast({c} AS double)") for c in scores]) >= least)


def by_slice(gold: DataFrame, pred: DataFrame, slices: DataFrame, columns: list[str]) -> DataFrame:
    """Confusion counts for every slice column's values and in all. slices: (row_id, columns)."""
    g, p = mentions(gold).withColumn("g", F.lit(True)), mentions(pred).withColumn("p", F.lit(True))
    both = g.join(p, ["row_id", "label", "mention"], "full_outer").join(slices, "row_id")
    sets = [F.array(F.lit("all"), F.lit(""))] + [F.array(F.lit(c), F.col(c).cast("string")) for c in columns]
    return both.withColumn("s", F.explode(F.array(*sets))).groupBy(F.col("s")[0].alias("slice"), F.col("s")[1].alias("value")).agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def labels_of(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord int, label string")


def top_support(rep: DataFrame, k: int) -> DataFrame:
    """The k labels with most support; equals in taxonomy order."""
    return rep.withColumn("place", F.row_number().over(Window.orderBy(F.desc("support"), "ord"))).filter(F.col("place") <= k)
