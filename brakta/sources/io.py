"""Readers and writers of datasets, and adapters for what only models can read."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, fields
from datetime import UTC, datetime
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brakta.operators.filters import Rule
from brakta.plans.order import in_order


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def load_parquets(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files of ``path``/parquet-files, or else of ``path``, with (file_name, row_index) to tell their order."""
    inner = f"{path.rstrip('/')}/parquet-files"
    where = inner if exists(spark, inner) else path
    if not exists(spark, where):
        raise FileNotFoundError(where)
    return spark.read.parquet(where).select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))


def load_rows(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A Parquet folder or file, or a JSON-lines file without its blank lines; the first ``limit`` rows in order."""
    if path.endswith(".jsonl"):
        rows = spark.read.json(path).select("*", F.col("_metadata.file_name").alias("file_name"), F.monotonically_increasing_id().alias("row_index"))
    elif path.endswith(".parquet") or exists(spark, path):
        rows = load_parquets(spark, path)
    else:
        raise ValueError(f"neither Parquet nor JSON lines: {path}")
    if limit is not None:
        rows = rows.orderBy("file_name", "row_index").limit(limit)
    return rows.drop("file_name", "row_index")


def gold_from_lines(lines: DataFrame) -> DataFrame:
    """(text, label, mention), distinct and in lower case, of lines {"input", "output": {"entities": {label: [mention]}}}."""
    parsed = lines.select(F.from_json("value", "input string, output struct<entities:map<string,array<string>>>").alias("j"))
    return parsed.select(F.col("j.input").alias("text"), F.explode("j.output.entities").alias("label", "ms")).select("text", "label", F.explode("ms").alias("m")).select("text", "label", F.lower("m").alias("mention")).filter("mention <> ''").distinct()


def example_lines(examples: DataFrame) -> DataFrame:
    """(split, value): each example as a JSON line. examples: (split, text, entities map, ...)."""
    rest = [c for c in examples.columns if c not in ("split", "text")]
    return examples.select("split", F.to_json(F.struct(F.col("text").alias("input"), F.struct(*rest).alias("output"))).alias("value"))


def write_splits(examples: DataFrame, path: str) -> None:
    """One folder of JSON lines for each split."""
    example_lines(examples).write.partitionBy("split").mode("overwrite").text(path)


def write_sanitized(pages: DataFrame, path: str) -> None:
    """(file_name, text) pages as JSON lines with the name of the text file each becomes."""
    pages.select(redacted_name(F.col("file_name")).alias("name"), "text").write.mode("overwrite").json(path)


def write_text_files(pages: DataFrame, path: str) -> None:
    """Each page's text under ``redacted_name`` in a folder of its own name, which Spark writes whole or not at all. pages: (file_name, text), names distinct."""
    pages.select("text", redacted_name(F.col("file_name")).alias("name")).write.partitionBy("name").option("lineSep", "\n").mode("overwrite").text(path)


def archive(pages: DataFrame) -> DataFrame:
    """(document, zip): the pages of each document in one ZIP, in order. pages: (document, place, entry, content binary); a document's pages must fit a task."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for entry, content in pdf.sort_values("place")[["entry", "content"]].itertuples(index=False):
                z.writestr(zipfile.ZipInfo(entry), content)
        return pd.DataFrame({"document": [key[0]], "zip": [out.getvalue()]})

    kind = dict(pages.dtypes)["document"]
    return pages.groupBy("document").applyInPandas(one, f"document {kind}, zip binary")


def uploaded(pages: DataFrame, files: DataFrame, append: bool) -> DataFrame:
    """Pages of a session after an upload: (page_no, file_name, width, height, text), new ones after the old or, without ``append``, in their stead.

    files: (place, file_name, width, height), PDFs as one file a page; those that could not be read have no width and
    are passed over.  New pages are skeletons: their text is empty until they are analysed.  Without any page, ValueError.
    """
    kept = pages.select("page_no", "file_name", "width", "height", "text")
    first = (kept.agg(F.max("page_no")).first()[0] if append else None)
    placed = in_order(files.filter("width is not null and height is not null").select("place", "file_name", "width", "height"), [F.col("place"), F.col("file_name")], "uploaded", "page_no")
    new = placed.select((F.col("page_no") + F.lit(0 if first is None else first + 1)).cast("long").alias("page_no"), "file_name", "width", "height", F.lit("").alias("text"))
    out = kept.unionByName(new) if append else new
    if out.isEmpty():
        raise ValueError("no usable images")
    return out


def redacted_name(file_name: Column) -> Column:
    return F.concat(F.regexp_replace(file_name, r"\.[^.]*$", ""), F.lit("-redacted.txt"))


def archive_entry(place: Column, file_name: Column) -> Column:
    """Name of a page's image in an archive: number, safe stem, suffix."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"\.[^.]*$", ""), r'[/\\:*?"<>|]+', "_")
    return F.concat(F.lpad(place.cast("string"), 2, "0"), F.lit("_"), stem, F.lit("-redacted.png"))


def pdf_page_name(file_name: Column, page: Column) -> Column:
    return F.concat(F.regexp_replace(file_name, r"(?i)\.pdf$", ""), F.lit("-p"), page.cast("string"), F.lit(".png"))


def is_pdf(file_name: Column, mime: Column) -> Column:
    return (F.coalesce(mime, F.lit("")) == "application/pdf") | F.lower(file_name).endswith(".pdf")


def images(spark: SparkSession, path: str, decode: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Files through a decoder or OCR model, loaded once per Python worker: decode(bytes) -> rows of ``schema``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"path": p} | r for p, b in zip(pdf["path"], pdf["content"], strict=True) for r in decode(bytes(b))]
            if rows:
                yield pd.DataFrame(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, {schema}")


def card(numbers: dict[str, int], splits: dict[str, int], labels: list[str], hashes: dict[str, str], made: dict | None = None) -> str:
    """A dataset card in Markdown from a few aggregates; ``made`` tells how the dataset was."""
    total = max(1, sum(splits.values()))
    lines = ["# Dataset card", "", *[f"- {k}: {v}" for k, v in (made or {}).items()], *([""] if made else []), "| split | rows | share |", "|---|---|---|", *(f"| {k} | {v} | {v / total:.3f} |" for k, v in splits.items())]
    lines += ["", "| task | rows |", "|---|---|", *(f"| {k} | {v} |" for k, v in numbers.items()), "", f"Labels ({len(labels)}): {', '.join(labels)}", "", "| pool | sha256[:16] |", "|---|---|", *(f"| {k} | {v} |" for k, v in hashes.items())]
    return "\n".join(lines) + "\n"


def report_files(summary: list[dict], now: datetime | None = None) -> dict[str, str]:
    """A judge report as JSON and Markdown, by file name with a UTC stamp."""
    stamp = (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")
    table = ["| metric | mean | passed | rows | pass rate |", "|---|---|---|---|---|", *(f"| {r['metric']} | {r['mean_score']} | {r['passed']} | {r['n']} | {r['pass_rate']:.3f} |" for r in summary)]
    return {f"report-{stamp}.json": json.dumps(summary, ensure_ascii=False, indent=2), f"report-{stamp}.md": "\n".join(table) + "\n"}


@dataclass(frozen=True)
class PipelineConfig:
    """Settings of a run; unknown fields are ignored, and any invalid one brings back all defaults."""

    threshold: float = 0.5
    enabled: tuple[str, ...] = ()
    variant: str = "baseline"
    rules: dict[str, Rule] = field(default_factory=dict)
    descriptions: dict[str, str] = field(default_factory=dict)
    custom: tuple[dict, ...] = ()

    @classmethod
    def parse(cls, raw: dict | str | None) -> PipelineConfig:
        if not raw:
            return cls()
        try:
            data = json.loads(raw) if isinstance(raw, str) else dict(raw)
            known = {f.name for f in fields(cls)}
            data = {k: v for k, v in data.items() if k in known}
            rules = {k: Rule(**v) if isinstance(v, dict) else v for k, v in dict(data.get("rules", {})).items()}
            made = cls(**(data | {"rules": rules, "enabled": tuple(data.get("enabled", ())), "custom": tuple(data.get("custom", ()))}))
            ok = 0 <= made.threshold <= 1 and all(0 <= r.threshold <= 1 and r.mode in ("full", "partial", "exclude") for r in rules.values())
            return made if ok else cls()
        except (TypeError, ValueError, AttributeError):
            return cls()

    def merged(self, saved: dict) -> PipelineConfig:
        """Saved settings laid over these: sections, then entries of rules and descriptions."""
        own = asdict(self)
        out = own | {k: v for k, v in saved.items() if k in own}
        for k in ("rules", "descriptions"):
            out[k] = own[k] | dict(saved.get(k) or {})
        return PipelineConfig.parse(out)


#: Detector variants by name; an unknown one is the first.
VARIANTS = ("baseline", "lora", "ft")


def variant(name: str | None) -> str:
    return name if name in VARIANTS else VARIANTS[0]
