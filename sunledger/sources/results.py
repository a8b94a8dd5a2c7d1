"""Prediction tables, run records, prepared tables, and table exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schema import RUN_FIELDS
from .raw import file_stem


def run_name(path: Column) -> Column:
    """Name of the run that wrote a file: its stem, or its folder for part files."""
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    folder = F.regexp_replace(F.url_decode(folder), r"^[^=_]+=", "")
    stem = file_stem(path)
    return F.when(stem.startswith("part-"), folder).otherwise(stem)


def stem_parts(name: Column) -> dict[str, Column]:
    """group, model and horizon from ``group__model__horizon``."""
    parts = F.split(name, "__")
    return {"experiment_group": F.get(parts, 0), "model": F.get(parts, 1),
            "horizon": F.get(parts, 2)}


def prediction_runs(spark: SparkSession, path: str | list[str], groups: Sequence[str] | None = None,
                    horizon: str | None = None) -> DataFrame:
    """One row per run: its name, parts and ``source``, the file or folder that holds it.

    Only names are listed; no file is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.parquet").load(path)
    files = files.select(run_name(F.col("_metadata.file_path")).alias("run"), F.when(
        file_stem(F.col("path")).startswith("part-"), F.regexp_replace("path", "/[^/]+$", ""))
        .otherwise(F.col("path")).alias("source"))
    runs = files.distinct().withColumns(stem_parts(F.col("run")))
    if groups is not None:
        runs = runs.where(F.col("experiment_group").isin(list(groups)))
    return runs if horizon is None else runs.where(F.col("horizon") == horizon)


def scan_predictions(spark: SparkSession, path: str | list[str], groups: Sequence[str] | None = None,
                     horizon: str | None = None) -> DataFrame:
    """Prediction files of several runs; the first run of a model and horizon wins.

    Winners are found among the names of files and read by path: forecasts of other runs are
    never opened. The driver holds one path per model and horizon.
    """
    runs = prediction_runs(spark, path, groups, horizon)
    known = runs.where("model IS NOT NULL AND horizon IS NOT NULL")
    first = known.groupBy("model", "horizon").agg(F.min("run").alias("run"))
    winners = [r.source for r in known.join(first, ["model", "horizon", "run"])
               .select("source").distinct().orderBy("source").collect()]
    if winners:
        rows = spark.read.parquet(*winners)
    else:
        rows = spark.read.parquet(*([path] if isinstance(path, str) else path)).where(F.lit(False))
    return rows.withColumns(stem_parts(run_name(F.col("_metadata.file_path"))))


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("horizon", "model").parquet(path)


def parsed_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``record`` (a VARIANT, null where the text is cut off or no JSON) and ``file``.

    ``multi_line`` reads one record per file, otherwise one per line. Numbers written as NaN or
    Infinity, which JSON lacks, become null.
    """
    text = spark.read.text(path, wholetext=multi_line)
    numbers = F.regexp_replace("value", r"([:,\[]\s*+)(?:-?Infinity|NaN)(?=\s*+[,}\]])", "$1null")
    return text.where(F.trim("value") != "").select(
        F.coalesce(F.try_parse_json(F.col("value")), F.try_parse_json(numbers)).alias("record"),
        F.col("_metadata.file_path").alias("file"))


def _field(name: str) -> Column:
    path, kind = RUN_FIELDS[name]
    if kind in ("start", "end"):
        dates = F.try_variant_get("record", path, "array<string>")
        at = F.lit(0) if kind == "start" else F.size(dates) - 1
        return F.nullif(F.get(dates, at), F.lit(""))
    return F.try_variant_get("record", path, kind)


def scan_run_records(spark: SparkSession, path: str, multi_line: bool = True,
                     fingerprint: str | None = None) -> DataFrame:
    """Registry rows of JSON run records, all columns of the registry typed, and ``record`` whole,
    so that fields the registry does not know can still be read from it.

    Records that are cut off, or have no specification, are skipped; :func:`record_counts` counts
    them. A field that is missing, or of another type, is null. A record without a group has the
    first part of its id. ``fingerprint`` stands for that of records without one.
    """
    kept = parsed_records(spark, path, multi_line).where(
        F.try_variant_get("record", "$.spec.experiment_id", "string").isNotNull())
    out = kept.select(*[_field(name).alias(name) for name in RUN_FIELDS], "record")
    return out.withColumns({
        "experiment_group": F.coalesce("experiment_group", F.split("experiment_id", "__")[0]),
        "config_fingerprint": F.coalesce("config_fingerprint", F.lit(fingerprint).cast("string"))})


def record_counts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """How many records were read, cut off, and without a specification."""
    parsed = parsed_records(spark, path, multi_line)
    named = F.try_variant_get("record", "$.spec.experiment_id", "string").isNotNull()
    return parsed.agg(F.count_if(named).alias("n_read"),
                      F.count_if(F.col("record").isNull()).alias("n_cut_off"),
                      F.count_if(F.col("record").isNotNull() & ~named).alias("n_unspecified"))


def write_run_records(df: DataFrame, path: str) -> None:
    """One JSON object per row, in the shape :func:`scan_run_records` reads."""
    df.write.mode("overwrite").json(path)


def write_prepared(df: DataFrame, path: str) -> None:
    """Featured rows by site and split; rewriting one site leaves the others alone.

    Rows go to the writers by site and time range, so that a large site is written by
    many tasks.
    """
    (df.repartitionByRange("site", "split", "step").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("site", "split").parquet(path))


def read_prepared(spark: SparkSession, path: str, sites: Sequence[str] | None = None,
                  split: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    if sites is not None:
        rows = rows.where(F.col("site").isin(list(sites)))
    return rows if split is None else rows.where(F.col("split") == split)


def significant(value: Column, digits: int = 6) -> Column:
    """Shortest text with ``digits`` significant digits, for export only."""
    scientific = F.format_string(f"%.{digits - 1}e", value)
    power = F.substring_index(scientific, "e", -1).cast("int")
    fixed = F.regexp_replace(scientific, r"\.?0+e", "e")
    for exponent in range(-4, digits):
        text = F.format_string(f"%.{digits - 1 - exponent}f", value)
        trimmed = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
        fixed = F.when(power == exponent, trimmed).otherwise(fixed)
    return F.when(value.isNotNull(), fixed)


def write_table(df: DataFrame, path: str, digits: int = 6) -> None:
    """CSV export with floating-point columns rounded to significant digits."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType,
                                                                          T.FloatType))}
    df.select(*[significant(F.col(f"`{c}`"), digits).alias(c) if c in floats else F.col(f"`{c}`")
                for c in df.columns]).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
