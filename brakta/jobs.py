"""Batch jobs: ``python -m brakta.jobs generate|convert|evaluate``, for spark-submit as well.

A missing file or a wrong value ends a job with status 1 and a line on standard error.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brakta.functions import parsing
from brakta.operators import curate, metrics, noise, pools, synth, tasks
from brakta.operators.taxonomy import LABELS
from brakta.plans.order import in_order
from brakta.plans.staging import stage
from brakta.sources import io
from brakta.sources.files import qualified, store


def generate(spark: SparkSession, rows: int, folder: str, name: str, seed: int = 42) -> str:
    """A synthetic dataset under folder/name."""
    return synth.create(spark, rows, folder, name, synth.SynthesisConfig(seed=seed))


def converted(rows: DataFrame, order: str, seed: int = 42, train: float = 0.9, validation: float = 0.05, threshold: float | None = None, embedder: Callable | None = None, noise_rate: float | None = None, noise_seed: int = 42, dense: bool = True) -> DataFrame:
    """(split, noisy, text, entities, sensitivity, structures, relations): training examples of a dataset's valid and distinct rows.

    rows: (text, entities map), ``order`` that tells which row of a text is the first, and records,
    records_validated, entities_validated and seed_company where there are any.  With a ``threshold`` and an
    ``embedder`` (see curate.embedded) near copies go too; with a ``noise_rate`` every row comes a second time as
    an OCR engine might read it, in the same split and without its employer and records; ``dense`` gives every example all labels.
    """
    kept = curate.exact_dedup(curate.valid_only(rows), "text", order)
    if threshold is not None:
        if embedder is None:
            raise ValueError("semantic dedup needs an embedder")
        numbered = in_order(kept, [F.col(order).asc()], "convert", "__n")  # the earlier row of a pair is the one that stays
        kept = curate.without_near_copies(numbered, "__n", "text", embedder, threshold)
    none = F.array().cast("array<map<string,string>>")
    given = none if "records" not in kept.columns else parsing.records(F.col("records")) if dict(kept.dtypes)["records"] == "string" else F.col("records")
    company = F.col("seed_company.name") if "seed_company" in kept.columns else F.lit(None).cast("string")
    ok = F.col("records_validated") if "records_validated" in kept.columns else F.lit(False)
    split = curate.with_split(kept, list(LABELS), seed, train, validation).select(F.col(order).alias("key"), "text", "entities", "split", company.alias("company"), given.alias("records"), ok.alias("ok"), F.lit(False).alias("noisy"))
    if noise_rate is not None:
        copies = noise.with_noisy_copies(split.drop("noisy"), "key", noise_rate, noise_seed).filter("noisy")
        split = split.unionByName(copies.withColumns({"records": none, "ok": F.lit(False)}))
    made = tasks.example(F.col("text"), F.col("entities"), F.col("company"), F.col("records"), F.col("ok"), dense)
    return split.select("split", "noisy", made.alias("e")).filter("e is not null").select("split", "noisy", "e.*")


def convert(spark: SparkSession, source: str, target: str, seed: int = 42, train: float = 0.9, validation: float = 0.05, threshold: float | None = None, embedder: Callable | None = None, noise_rate: float | None = None, noise_seed: int = 42, dense: bool = True) -> dict[str, int]:
    """A dataset as JSON lines by split, with a card beside them; the rows of each split. A dataset: text, entities (map or JSON), and what else generate writes.

    See ``converted``.  The rows are made once: lines, coverage and card come from a staged table.
    """
    raw = io.load_parquets(spark, source)
    ordered = raw.withColumn("__place", F.concat_ws("/", "file_name", F.lpad(F.col("row_index").cast("string"), 19, "0")))
    if dict(raw.dtypes)["entities"] == "string":
        ordered = ordered.withColumn("entities", F.from_json("entities", "map<string,array<string>>"))
    made = stage(converted(ordered, "__place", seed, train, validation, threshold, embedder, noise_rate, noise_seed, dense), "converted")
    io.write_splits(made.drop("noisy"), target)
    counted = {r["split"]: r["n"] for r in made.groupBy("split").agg(F.count("*").alias("n")).collect()}  # three rows at most
    numbers = curate.coverage(made).first().asDict()
    hashes = {k: hashlib.sha256(json.dumps(list(v), ensure_ascii=False).encode()).hexdigest()[:16] for k, v in pools.PINNED.items()}
    said = {"source": source, "seed": seed, "noise": noise_rate if noise_rate is not None else "none", "near copies": threshold if threshold is not None else "kept", "dense": dense}
    text = io.card(numbers, {k: counted.get(k, 0) for k in ("train", "val", "test")}, list(LABELS), hashes, said)
    where, path = store(qualified(spark, f"{target}/dataset_card.md"))
    with where.open_output_stream(path) as f:
        f.write(text.encode())
    return counted


def evaluate(spark: SparkSession, gold: str, predicted: str, top: int = 12) -> dict:
    """Scores of predicted against gold mentions, both as lines of training examples: totals and the labels with most support."""

    def mentions(path: str) -> DataFrame:
        if not io.exists(spark, path):
            raise FileNotFoundError(path)
        return io.gold_from_lines(spark.read.text(path)).select(F.sha2("text", 256).alias("row_id"), "label", "mention")

    report = metrics.report(metrics.confusion(mentions(gold), mentions(predicted)), metrics.labels_of(spark, list(LABELS)))
    rows = metrics.top_support(report, top).orderBy("place")  # a row a label
    return {"totals": metrics.totals(report).first().asDict(), "labels": [r.asDict() for r in rows.collect()]}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="brakta.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, needs in (("generate", ("rows", "folder", "name")), ("convert", ("source", "target")), ("evaluate", ("gold", "predicted"))):
        job = jobs.add_parser(name)
        for n in needs:
            job.add_argument(n, type=int if n == "rows" else str)
        if name == "convert":
            job.add_argument("--noise-rate", type=float, default=None)
            job.add_argument("--noise-seed", type=int, default=42)
            job.add_argument("--sparse", dest="dense", action="store_false")
            for n, usual in (("--train", 0.9), ("--validation", 0.05)):
                job.add_argument(n, type=float, default=usual)
    given = vars(parser.parse_args(arguments))
    job = {"generate": generate, "convert": convert, "evaluate": evaluate}[given.pop("job")]
    try:
        print(json.dumps(job(spark or SparkSession.builder.getOrCreate(), **given), ensure_ascii=False))
    except (FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
