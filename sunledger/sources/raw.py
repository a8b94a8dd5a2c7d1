"""Raw power and weather CSV files and the station metadata text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.validate import numeric
from ..plans.chunks import carry
from ..plans.summaries import attached
from ..session import materialise
from ..schema import POWER_CSV, TIME_PATTERNS, WEATHER_POSITIONS


def parse_time(text: Column, patterns: Sequence[str] = TIME_PATTERNS) -> Column:
    """First pattern that fits; null when none does."""
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(p)) for p in patterns])


def file_stem(path: Column) -> Column:
    """File name without folder and extension; URL escapes are undone."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.snappy)?\.[^./]+$", 1)
    return F.url_decode(F.regexp_replace(name, r"\+", "%2B"))


def scan_power_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All stations' power files in one scan; the site is a ``site=`` folder or the file name.

    A file whose header names other columns fails the scan; ``header_issues`` lists such files.
    """
    files = spark.read.schema(POWER_CSV).option("header", True).option("enforceSchema", False).csv(path)
    site = F.col("site") if "site" in files.columns else file_stem(F.col("_metadata.file_name"))
    return (files
            .select(site.cast("string").alias("site"),
                    F.col("Time").alias("time_text"), F.col("power(W)").alias("power_text"),
                    parse_time(F.col("Time")).alias("Time")))


def headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, header``: the first line of every file, from the block that starts it."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id()
        .alias("at"), F.col("_metadata.file_block_start").alias("start"))
    return lines.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))


def header_issues(spark: SparkSession, path: str | list[str],
                  expected: Sequence[str]) -> DataFrame:
    """Errors for expected columns that a file lacks, and for those in another place."""
    names = F.transform(F.split("header", ","), lambda c: F.lower(F.trim(c, F.lit(' "\r\ufeff'))))
    wanted = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(i).alias("place"))
                       for i, c in enumerate(expected, start=1)])
    found = headers(spark, path).select("file", names.alias("names"), F.explode(wanted).alias("w"))
    place = F.array_position("names", F.lower("w.name"))
    wrong = found.withColumn("place", place).where(F.col("place") != F.col("w.place"))
    absent = F.col("place") == 0
    return wrong.select(
        F.lit("error").alias("severity"), F.concat(F.lit("loader/"), file_stem(F.col("file")))
        .alias("stage"),
        F.when(absent, "required_column").otherwise("column_position").alias("check"),
        F.concat(F.lit("column "), "w.name", F.when(absent, F.lit(" is not in the header")).otherwise(
            F.concat(F.lit(" is column "), F.col("place").cast("string")))).alias("message"))


def power_series(raw: DataFrame) -> DataFrame:
    """(site, Time, pv_power_w) with duplicate stamps averaged; unparsed stamps are left out
    here and reported by the checks on the raw table."""
    return (raw.where(F.col("Time").isNotNull())
            .withColumn("pv_power_w", numeric(F.col("power_text")))
            .groupBy("site", "Time").agg(F.avg("pv_power_w").alias("pv_power_w")))


def unparsed_times(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("Time").isNull()).groupBy("site").agg(
        F.count(F.lit(1)).alias("n_unparsed"), F.min("time_text").alias("example"))


def station_issues(spark: SparkSession, required: Sequence[str], present: DataFrame) -> DataFrame:
    """Warnings for the declared stations that delivered no file."""
    wanted = spark.createDataFrame([(s,) for s in required], "site string")
    missing = wanted.join(present.select("site").distinct(), "site", "left_anti")
    return missing.select(
        F.lit("warning").alias("severity"), F.lit("loader/station_missing").alias("stage"),
        F.lit("station_missing").alias("check"),
        F.concat(F.lit("station "), "site", F.lit(" could not be loaded")).alias("message"))


def scan_weather_raw(spark: SparkSession, root: str, patterns: Mapping[str, str],
                     positions: Mapping[str, int] = WEATHER_POSITIONS) -> DataFrame:
    """Long (variable, Time, value_text) rows; a variable is a column position of its files.

    ``patterns`` maps a variable to a glob below ``root``; a variable without files is
    skipped. Columns are taken by position, so headers may differ between files.
    """
    out = None
    for variable, pattern in patterns.items():
        position = positions[variable]
        # enough string columns for the position, whatever the header calls them
        schema = ", ".join(f"c{i} string" for i in range(position + 1))
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True)
        try:
            files = reader.csv(f"{root}/{pattern}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" in str(missing):
                continue
            raise
        part = files.select(F.lit(variable).alias("variable"), F.col("c0").alias("time_text"),
                            F.col(f"c{position}").alias("value_text"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(f"no weather files under {root}")
    return out.withColumns({"Time": parse_time(F.col("time_text")),
                            "value": numeric(F.col("value_text"))})


def weather_file_issues(spark: SparkSession, root: str, patterns: Mapping[str, str],
                        positions: Mapping[str, int] = WEATHER_POSITIONS, time: str = "Time") -> DataFrame:
    """Structural issues of weather files as log rows: a file without the time column, a variable whose
    position a file does not reach, a variable without any file. Headers of all files are read as data."""
    out = None
    for variable, pattern in patterns.items():
        position = positions[variable]
        try:
            found = headers(spark, f"{root}/{pattern}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            part = spark.range(1).select(
                F.lit("warning").alias("severity"), F.lit(f"schema/weather/{variable}").alias("stage"),
                F.lit("variable_missing").alias("check"), F.lit(f"no file holds {variable}").alias("message"),
                F.create_map(F.lit("variable"), F.lit(variable)).alias("detail"))
        else:
            names = F.transform(F.split("header", ","), lambda c: F.lower(F.trim(c, F.lit(' "\r\ufeff'))))
            columns = found.select("file", names.alias("names"))
            untimed = F.array_position("names", time.lower()) == 0
            short = F.size("names") <= position
            problems = F.array_compact(F.array(
                F.when(untimed, F.struct(F.lit("required_column").alias("check"), F.lit(
                    f"the header has no column {time}").alias("message"))),
                F.when(short, F.struct(F.lit("column_position").alias("check"), F.format_string(
                    f"{variable} should be column {position + 1} of %d", F.size("names")).alias("message")))))
            part = columns.select("file", "names", F.explode(problems).alias("p")).select(
                F.lit("error").alias("severity"), F.concat(F.lit(f"schema/weather/{variable}/"), file_stem(F.col("file")))
                .alias("stage"), "p.check", "p.message", F.create_map(
                    F.lit("variable"), F.lit(variable), F.lit("n_columns"), F.size("names").cast("string")).alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out


def weather_table(long: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One column per variable; several readings of a stamp are averaged."""
    return (long.where(F.col("Time").isNotNull()).groupBy("Time")
            .pivot("variable", list(variables)).agg(F.avg("value")))


# ---- fixed values: metadata patterns ---------------------------------------------
ENTITY = r"pvsystem:(\S+)\s+a\s+brick:PV_Generation_System\s*;"
COORDINATE = r"brick:{field}\s+([-\d.]+)"
NUMBER = r"(?s)ext:{field}\s*\[.*?brick:value\s+([-\d.]+)"
LOCATION = r"brick:hasLocation\s*\[\s*brick:value\s+\"([^\"]+)\""
DATE = r"(?s)ext:connectionDate\s*\[.*?brick:value\s+\"([^\"]+)\""


MARK = "pvsystem:"


def entity_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``block``: the text of every entity, from its mark to the next entity's.

    Files are split at the mark, so Spark reads one large file as many tasks. A mark inside a block
    (one entity that names another) starts a piece that is no entity; such pieces are joined to the
    entity before them by their place in the file: first byte of the split, then row in the split.
    """
    pieces = materialise(spark.read.option("lineSep", MARK).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id")), "pieces")
    first = pieces.groupBy("file", "start").agg(F.min("id").alias("first"))
    placed = attached(pieces, first, ["file", "start"]).select(
        "file", "value", (F.col("start") + F.col("id") - F.col("first")).alias("at"))
    begins = F.concat(F.lit(MARK), "value").rlike("^" + ENTITY)
    owned = carry(placed, ["file"], "at", {"owner": F.when(begins, F.col("at"))}, chunk_steps=1 << 20)
    return owned.where("owner IS NOT NULL").groupBy("file", "owner").agg(
        F.concat(F.lit(MARK), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))),
                                                       lambda p: p["value"]), MARK)).alias("block")).select("block")


def scan_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station dimension from metadata text: one row per entity block."""
    blocks = entity_blocks(spark, path)

    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract("block", pattern, 1), F.lit(""))

    named = blocks.select("block", found("^" + ENTITY).alias("brick_name")).where(
        F.col("brick_name").isNotNull())
    rated = found(NUMBER.format(field="ratedPowerOutput")).try_cast("double")
    return named.select(
        "brick_name",
        found(COORDINATE.format(field="latitude")).try_cast("double").alias("latitude"),
        found(COORDINATE.format(field="longitude")).try_cast("double").alias("longitude"),
        found(NUMBER.format(field="altitude")).try_cast("double").alias("altitude_m"),
        found(LOCATION).alias("location"), found(DATE).alias("connection_date"),
        rated.alias("rated_kw"), (rated * 1000.0).alias("rated_w"))


def loose_key(name: Column) -> Column:
    """Key that ignores case, spaces, underscores and brackets."""
    return F.lower(F.regexp_replace(name, r"[ _()]+", ""))


def slug(name: Column) -> Column:
    """Lower-case letters and digits joined by single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "_"), r"^_|_$", "")


def lookup_stations(names: DataFrame, stations: DataFrame, name: str = "site",
                    station_name: str = "brick_name") -> DataFrame:
    """Left join on the loose key; ``metadata_found`` tells hits from misses.

    When several stations share a loose key the first by name is taken.
    """
    keyed = stations.withColumn("_key", loose_key(F.col(station_name)))
    row = F.min_by(F.struct(*stations.columns), station_name)
    unique = keyed.groupBy("_key").agg(row.alias("_row")).select("_key", "_row.*")
    return (names.withColumn("_key", loose_key(F.col(name)))
            .join(unique.withColumn("metadata_found", F.lit(True)), "_key", "left")
            .withColumns({"metadata_found": F.coalesce("metadata_found", F.lit(False)),
                          "slug": slug(F.col(name))}).drop("_key"))
