"""Span scores, tuning, pairing and judge summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brakta.operators import metrics as M
from brakta.operators import weights
from brakta.queries.base import SPANS0, raw_spans, table
from brakta.queries.detection import _values

NAMES = ["email", "ip_address", "card_number", "phone", "mrz"]


def _labels(spark: SparkSession) -> DataFrame:
    return M.labels_of(spark, NAMES)


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return raw_spans(spark, d).select(F.col("doc_id").alias("row_id"), "label", F.col("text").alias("mention"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Gold with losses, doubles in other case and inventions, each with a confidence."""
    row = F.col("row_id")
    said = lambda when, mention, sure: F.when(when, F.struct(mention.alias("mention"), sure.cast("double").alias("confidence")))
    # One pass over the gold: each mention brings what is said of it.
    kinds = F.array(
        said(row % 4 != 0, F.upper("mention"), 0.3 + (row % 60) / 100), said(row % 8 == 1, F.col("mention"), F.lit(0.97)),
        said(row % 3 == 0, F.lit("made up"), (row % 90) / 100), said(row % 16 == 4, F.col("mention"), F.lit(None)))
    return _gold(spark, d).distinct().select("row_id", "label", F.inline(F.filter(kinds, lambda x: x.isNotNull())))


def span_confusion(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(_gold(spark, d), _candidates(spark, d))


def label_report(spark: SparkSession, d: str) -> DataFrame:
    r = M.report(span_confusion(spark, d), _labels(spark))
    return r.select("label", "support", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def total_scores(spark: SparkSession, d: str) -> DataFrame:
    t = M.totals(M.report(span_confusion(spark, d), _labels(spark)))
    return t.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("micro_precision", "micro_recall", "micro_f1", "macro_f1")])


def labels_by_support(spark: SparkSession, d: str) -> DataFrame:
    """The report's labels with most support; a top-k is what it shows."""
    return M.top_support(M.report(span_confusion(spark, d), _labels(spark)), 3).select("label", "support", F.col("place").cast("long").alias("place"))


def candidate_confidence(spark: SparkSession, d: str) -> DataFrame:
    return M.best_confidence(_candidates(spark, d)).select("row_id", "label", "mention", F.round("confidence", 9).alias("confidence"))


def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    return M.counts_on_grid(_candidates(spark, d), _gold(spark, d), _labels(spark)).select("label", "thr", "tp", "fp", "fn")


def tuned_thresholds(spark: SparkSession, d: str) -> DataFrame:
    t = M.tune(M.counts_on_grid(_candidates(spark, d), _gold(spark, d), _labels(spark)), 0.5)
    return t.select("label", "thr", F.round("score", 9).alias("score"))


def tuned_report(spark: SparkSession, d: str) -> DataFrame:
    """Tuned on even rows, scored on odd ones."""
    c, g = _candidates(spark, d), _gold(spark, d)
    thr = M.tune(M.counts_on_grid(c.filter("row_id % 2 = 0"), g.filter("row_id % 2 = 0"), _labels(spark)))
    pred = M.at_thresholds(c.filter("row_id % 2 = 1"), thr)
    r = M.report(M.confusion(g.filter("row_id % 2 = 1"), pred), _labels(spark))
    return r.select("label", "support", "tp", "fp", "fn")


def fixed_and_tuned_report(spark: SparkSession, d: str) -> DataFrame:
    """Odd rows at 0.5 for all labels, and at thresholds tuned on even rows."""
    c, g = _candidates(spark, d), _gold(spark, d)
    even, odd = "row_id % 2 = 0", "row_id % 2 = 1"
    r = M.fixed_and_tuned(c.filter(even), g.filter(even), c.filter(odd), g.filter(odd), _labels(spark))
    return r.select("threshold", "label", "support", "tp", "fp", "fn")


def scores_by_slice(spark: SparkSession, d: str) -> DataFrame:
    slices = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "lang", "source")
    return M.by_slice(_gold(spark, d), _candidates(spark, d), slices, ["lang", "source"])


#: Shares that languages and sources should have; other sources keep theirs.
MARGINS = {"lang": {"en": 0.4, "de": 0.25, "es": 0.2, "fr": 0.15}, "source": {"src0": 0.3, "src1": 0.2, "none such": 0.1}}


def reweighted_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = weights.raked(table(spark, d, "documents").select("doc_id", "lang", "source"), MARGINS, rounds=5)
    return rows.select("doc_id", "lang", "source", F.round("weight", 6).alias("weight"))


def weighted_scores_by_slice(spark: SparkSession, d: str) -> DataFrame:
    slices = weights.raked(table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "lang", "source"), MARGINS, rounds=5)
    found = weights.weighted_by_slice(_gold(spark, d), _candidates(spark, d), slices, ["lang", "source"])
    return found.select("slice", "value", *[F.round(c, 6).alias(c) for c in ("tp", "fp", "fn", "precision", "recall", "f1")])


def four_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of four judges of each labelled row, as a relation."""
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("row_id"), *[F.when(F.pmod(F.col("doc_id") * k, F.lit(m)) > 0, F.pmod(F.col("doc_id") * k, F.lit(m)) / m).alias(name) for name, k, m in JUDGES])
    return M.verdicts(rows, [name for name, _, _ in JUDGES])


JUDGES = (("fluency", 3, 10), ("grounding", 7, 8), ("completeness", 11, 7), ("pairing", 13, 4))


def _people(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    one = lambda name, phone, mail: F.create_map(F.lit("name"), name, F.lit("phone"), phone, F.lit("email"), mail)
    k = F.col("c_custkey")
    phone, mail = F.concat(F.lit("+"), k.cast("string")), F.concat(k.cast("string"), F.lit("@x"))
    truth = F.array(one(F.col("c_name"), phone, mail), one(F.col("n_name"), F.lit("0"), F.lit(None).cast("string")))
    said = F.when(k % 7 == 0, F.array().cast("array<map<string,string>>")).when(k % 5 == 0, F.array(one(F.col("n_name"), phone, mail))).otherwise(F.array(one(F.upper("c_name"), F.concat(F.lit(" "), phone, F.lit(" ")), mail)))
    return c.select(k.alias("row_id"), truth.alias("truth"), said.alias("said"))


def pair_edges(spark: SparkSession, d: str) -> DataFrame:
    return M.edges(_people(spark, d), "said")


def pairing_scores(spark: SparkSession, d: str) -> DataFrame:
    p = _people(spark, d)
    s = M.pairing(M.edges(p, "said"), M.edges(p, "truth"), p.select("row_id"), 0.5)
    return s.select("row_id", "pairs_checked", "success", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def _judged(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels")
    both = [F.struct(F.lit(n).alias("metric"), F.when(F.col("doc_id") % 10 != 3, F.col(c).cast("double")).alias("score"), F.coalesce(F.col(c) == 1, F.lit(False)).alias("success")) for n, c in (("naturalness", "quality"), ("safety", "toxic"))]
    return rows.select("doc_id", F.inline(F.array(*both)))


def judge_means(spark: SparkSession, d: str) -> DataFrame:
    return M.judge_summary(_judged(spark, d)).select("metric", F.round("mean_score", 9).alias("mean_score"), "passed", "n", F.round("pass_rate", 9).alias("pass_rate"))


def judge_gate(spark: SparkSession, d: str) -> DataFrame:
    some = M.gate(_judged(spark, d)).withColumn("rows", F.lit("all"))
    none = M.gate(_judged(spark, d).filter("metric = 'none'")).withColumn("rows", F.lit("none"))
    return some.unionByName(none).select("rows", F.round("pass_rate", 9).alias("pass_rate"), "n")


def quality_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels")
    v = M.quality_gate(F.col("doc_id") % 5 != 0, F.col("doc_id") % 3 == 0, F.lit(4))
    return rows.select("doc_id", v.cast("int").alias("verdict"))


def rubric_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select("doc_id", F.struct(F.struct(F.col("quality").alias("score")).alias("fluency"), F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("toxic")).alias("score")).alias("grounding")).alias("judge"))
    return rows.select("doc_id", *M.rubric_scores(["fluency", "grounding"], "judge"))


def rows_over_judge_score(spark: SparkSession, d: str) -> DataFrame:
    return M.min_score_filter(rubric_columns(spark, d), ["fluency_score", "grounding_score"], 1).select("doc_id")


QUERIES = {f.__name__: f for f in (span_confusion, label_report, total_scores, labels_by_support, candidate_confidence, threshold_grid, tuned_thresholds, tuned_report, fixed_and_tuned_report, scores_by_slice, reweighted_rows, weighted_scores_by_slice, four_verdicts, pair_edges, pairing_scores, judge_means, judge_gate, quality_verdicts, rubric_columns, rows_over_judge_score)}

_LABELS = _values(list(enumerate(NAMES)), "ord, label")
_GOLD = f"""{SPANS0}, g0 AS (SELECT doc_id AS row_id, label, text AS mention FROM spans0), gd AS (SELECT DISTINCT * FROM g0),
cand AS (SELECT row_id, label, upper(mention) AS mention, 0.3::DOUBLE + (row_id % 60) / 100.0::DOUBLE AS confidence FROM gd WHERE row_id % 4 <> 0
  UNION ALL SELECT row_id, label, mention, 0.97 FROM gd WHERE row_id % 8 = 1 UNION ALL SELECT row_id, label, 'made up', (row_id % 90) / 100.0::DOUBLE FROM gd WHERE row_id % 3 = 0 UNION ALL SELECT row_id, label, mention, NULL FROM gd WHERE row_id % 16 = 4),
gold AS (SELECT DISTINCT row_id, label, lower(mention) AS mention FROM g0), pred AS (SELECT DISTINCT row_id, label, lower(mention) AS mention FROM cand),
best AS (SELECT row_id, label, lower(mention) AS mention, max(coalesce(confidence, 1.0::DOUBLE)) AS confidence FROM cand WHERE coalesce(confidence, 1.0::DOUBLE) >= 0.05 GROUP BY 1, 2, 3)"""
_CONF = ", conf AS (SELECT label, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM (SELECT *, 1 AS g FROM gold) FULL JOIN (SELECT *, 1 AS p FROM pred) USING (row_id, label, mention) GROUP BY label)"
_DIV = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"
_REP = _CONF + f", rep AS (SELECT label, ord, tp + fn AS support, tp, fp, fn, {_DIV('tp', 'tp + fp')} AS p, {_DIV('tp', 'tp + fn')} AS r, {_DIV('2.0 * tp', '2.0 * tp + fp + fn')} AS f FROM conf JOIN {_LABELS} USING (label))"
_GRID = f", grid AS (SELECT t.label, t.ord, round(0.05 * i, 2)::DOUBLE AS thr FROM {_LABELS}, range(1, 20) AS r(i)), bg AS (SELECT coalesce(b.row_id, g.row_id) AS row_id, coalesce(b.label, g.label) AS label, b.confidence, g.mention IS NOT NULL AS is_gold FROM best b FULL JOIN gold g USING (row_id, label, mention)), cnt AS (SELECT grid.label, ord, thr, count(*) FILTER (is_gold AND confidence >= thr) AS tp, count(*) FILTER (NOT is_gold AND confidence >= thr) AS fp, count(*) FILTER (is_gold) - count(*) FILTER (is_gold AND confidence >= thr) AS fn FROM grid LEFT JOIN bg USING (label) GROUP BY 1, 2, 3)"
_FB = lambda beta: _DIV(f"{1 + beta * beta} * p * r", f"{beta * beta} * p + r")
_TUNE = lambda src, beta: f"(SELECT label, thr, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, thr) AS k FROM (SELECT *, {_FB(beta)} AS score FROM (SELECT *, {_DIV('tp', 'tp + fp')} AS p, {_DIV('tp', 'tp + fn')} AS r FROM {src}))) WHERE k = 1)"
#: The report of odd rows at thresholds given as a CTE ``thr``, which may read ``cnt``, counted on even rows.
_tuned_report = lambda thresholds: "WITH " + _GOLD + _GRID.replace("FROM best b FULL JOIN gold g", "FROM (SELECT * FROM best WHERE row_id % 2 = 0) b FULL JOIN (SELECT * FROM gold WHERE row_id % 2 = 0) g") + ", " + thresholds + ", pr AS (SELECT row_id, label, mention, 1 AS p FROM best JOIN thr USING (label) WHERE confidence >= thr AND row_id % 2 = 1), cf AS (SELECT label, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM (SELECT *, 1 AS g FROM gold WHERE row_id % 2 = 1) FULL JOIN pr USING (row_id, label, mention) GROUP BY label) SELECT label, tp + fn AS support, tp, fp, fn FROM cf"
_PEOPLE = """pp AS (SELECT c_custkey AS k, c_name AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey),
truth AS (SELECT k AS row_id, 'phone' AS field, '+' || k AS value, lower(c) AS owner FROM pp UNION SELECT k, 'email', k || '@x', lower(c) FROM pp UNION SELECT k, 'phone', '0', lower(n) FROM pp),
said AS (SELECT k AS row_id, 'phone' AS field, '+' || k AS value, lower(CASE WHEN k % 5 = 0 THEN n ELSE c END) AS owner FROM pp WHERE k % 7 <> 0 UNION SELECT k, 'email', k || '@x', lower(CASE WHEN k % 5 = 0 THEN n ELSE c END) FROM pp WHERE k % 7 <> 0)"""
_JUDGED = "j AS (SELECT doc_id, 'naturalness' AS metric, CASE WHEN doc_id % 10 <> 3 THEN quality::DOUBLE END AS score, coalesce(quality = 1, false) AS success FROM labels UNION ALL SELECT doc_id, 'safety', CASE WHEN doc_id % 10 <> 3 THEN toxic::DOUBLE END, coalesce(toxic = 1, false) FROM labels)"

SQL = {
    "span_confusion": f"WITH {_GOLD}{_CONF} SELECT label, tp, fp, fn FROM conf",
    "label_report": f"WITH {_GOLD}{_REP} SELECT label, support, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1 FROM rep",
    "total_scores": f"WITH {_GOLD}{_REP}, s AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, avg(f) FILTER (support > 0) AS m FROM rep) SELECT tp, fp, fn, round({_DIV('tp', 'tp + fp')}, 9) AS micro_precision, round({_DIV('tp', 'tp + fn')}, 9) AS micro_recall, round({_DIV('2.0 * tp', '2.0 * tp + fp + fn')}, 9) AS micro_f1, round(coalesce(m, 0.0), 9) AS macro_f1 FROM s",
    "labels_by_support": f"WITH {_GOLD}{_REP} SELECT label, support, place FROM (SELECT *, row_number() OVER (ORDER BY support DESC, ord) AS place FROM rep) WHERE place <= 3",
    "candidate_confidence": f"WITH {_GOLD} SELECT row_id, label, mention, round(confidence, 9) AS confidence FROM best",
    "threshold_grid": f"WITH {_GOLD}{_GRID} SELECT label, thr, tp, fp, fn FROM cnt",
    "tuned_thresholds": f"WITH {_GOLD}{_GRID} SELECT label, thr, round(score, 9) AS score FROM {_TUNE('cnt', 0.5)}",
    "tuned_report": _tuned_report(f"thr AS {_TUNE('cnt', 1.0)}"),
    "fixed_and_tuned_report": f"SELECT -1.0::DOUBLE AS threshold, * FROM ({_tuned_report('thr AS ' + _TUNE('cnt', 1.0))}) UNION ALL SELECT 0.5::DOUBLE, * FROM ({_tuned_report(f'thr AS (SELECT label, 0.5 AS thr FROM {_LABELS})')})",
    "scores_by_slice": f"WITH {_GOLD}, m AS (SELECT row_id, g, p FROM (SELECT *, 1 AS g FROM gold) FULL JOIN (SELECT *, 1 AS p FROM pred) USING (row_id, label, mention)), s AS (SELECT 'all' AS slice, '' AS value, g, p FROM m JOIN documents ON doc_id = row_id UNION ALL SELECT 'lang', lang, g, p FROM m JOIN documents ON doc_id = row_id UNION ALL SELECT 'source', source, g, p FROM m JOIN documents ON doc_id = row_id) SELECT slice, value, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM s GROUP BY 1, 2",
    "reweighted_rows": f"WITH {weights.raked_sql('documents', 'doc_id', MARGINS, 5)} SELECT doc_id, lang, source, round(weight, 6) AS weight FROM raked",
    "weighted_scores_by_slice": f"WITH {_GOLD}, {weights.raked_sql('documents', 'doc_id', MARGINS, 5)}, m AS (SELECT lang, source, weight, g, p FROM (SELECT *, 1 AS g FROM gold) FULL JOIN (SELECT *, 1 AS p FROM pred) USING (row_id, label, mention) JOIN raked ON doc_id = row_id), s AS (SELECT 'all' AS slice, '' AS value, * FROM m UNION ALL SELECT 'lang', lang, * FROM m UNION ALL SELECT 'source', source, * FROM m), t AS (SELECT slice, value, coalesce(sum(weight) FILTER (g IS NOT NULL AND p IS NOT NULL), 0) AS tp, coalesce(sum(weight) FILTER (g IS NULL), 0) AS fp, coalesce(sum(weight) FILTER (p IS NULL), 0) AS fn FROM s GROUP BY 1, 2) SELECT slice, value, round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn, round({_DIV('tp', '(tp + fp)')}, 6) AS precision, round({_DIV('tp', '(tp + fn)')}, 6) AS recall, round({_DIV('2.0 * tp', '(2.0 * tp + fp + fn)')}, 6) AS f1 FROM t",
    "four_verdicts": "SELECT doc_id AS row_id, metric, score, coalesce(score >= 0.5, false) AS success FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS metric, CASE WHEN doc_id * {k} % {m} > 0 THEN (doc_id * {k} % {m}) / {m}.0::DOUBLE END AS score FROM labels" for name, k, m in JUDGES) + ")",
    "pair_edges": f"WITH {_PEOPLE} SELECT row_id, field, value, owner FROM said",
    "pairing_scores": f"WITH {_PEOPLE}, b AS (SELECT row_id, count(p) AS np, count(t) AS nt, count(p + t) AS hit FROM (SELECT *, 1 AS p FROM said) FULL JOIN (SELECT *, 1 AS t FROM truth) USING (row_id, field, value, owner) GROUP BY 1), s AS (SELECT row_id, np, CASE WHEN np = 0 THEN 1.0 ELSE hit::DOUBLE / np END AS p, CASE WHEN nt = 0 THEN 1.0 ELSE hit::DOUBLE / nt END AS r FROM b), f AS (SELECT *, {_DIV('2.0 * p * r', 'p + r')} AS f1 FROM s) SELECT row_id, np AS pairs_checked, f1 >= 0.5 AS success, round(p::DOUBLE, 9) AS precision, round(r::DOUBLE, 9) AS recall, round(f1, 9) AS f1 FROM f",
    "judge_means": f"WITH {_JUDGED} SELECT metric, round(avg(score), 9) AS mean_score, count(*) FILTER (success) AS passed, count(*) AS n, round(count(*) FILTER (success)::DOUBLE / count(*), 9) AS pass_rate FROM j GROUP BY metric",
    "judge_gate": f"WITH {_JUDGED} SELECT 'all' AS rows, round(avg(success::INTEGER::DOUBLE), 9) AS pass_rate, count(*) AS n FROM j UNION ALL SELECT 'none', 0.0, 0",
    "quality_verdicts": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 2 ELSE 4 END AS verdict FROM labels",
    "rubric_columns": "SELECT doc_id, coalesce(quality::VARCHAR, '') AS fluency_score, coalesce(CASE WHEN doc_id % 2 = 0 THEN toxic END::VARCHAR, '') AS grounding_score FROM labels",
    "rows_over_judge_score": "SELECT doc_id FROM labels WHERE (CASE WHEN doc_id % 2 = 0 THEN coalesce(least(quality, toxic), quality, toxic) ELSE quality END) >= 1",
}
