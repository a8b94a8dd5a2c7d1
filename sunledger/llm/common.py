"""What the operators of this subpackage share: words, folds, labelled samples, batches."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path, use_utc

WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; Arrow batches are kept short because a text may be very long."""
    use_utc(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WITHIN: list[list[str]] = []


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there."""
    path = scratch_path(df.sparkSession, label)
    if _WITHIN:
        _WITHIN[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def noted():
    """The folders that ``kept`` writes inside."""
    _WITHIN.append([])
    try:
        yield _WITHIN[-1]
    finally:
        _WITHIN.pop()


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()


BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast when it has few enough rows (16 to 40
    MB); larger ones are joined by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def raw(column: str) -> Column:
    """The UTF-8 bytes of a text; null counts as empty. ``bytes.split()`` splits them at
    exactly the six characters that ``WORD`` leaves out."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def decoded(value: bytes | None) -> str:
    return value.decode("utf-8", "replace") if value else ""


_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_LETTERS_DIGITS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def folded_words(value: bytes | None, digits: bool = False) -> list[bytes]:
    """Lower-cased words of a text, cut at every ASCII character that is not a letter (or,
    with ``digits``, a digit). Other marks stay in the word; callers that mind cut again."""
    if not value:
        return []
    return decoded(value).lower().encode().translate(
        _LETTERS_DIGITS if digits else _LETTERS).split()


def fold() -> Column:
    """0 for rows that are held out; null where the id is null."""
    return F.crc32(F.col("doc_id").cast("string")) % 5


def held_out() -> Column:
    return F.coalesce(fold() == 0, F.lit(False))


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def aside(df: DataFrame, *read: str) -> tuple[DataFrame, dict[str, str]]:
    """Give the columns that are not ``read`` names that meet no other, and say which."""
    names = {c: c if c.lower() in read else f"c{i}__" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def labelled(docs: DataFrame, labels: DataFrame, target: str, max_rows: int) -> DataFrame:
    """``text`` (bytes) and ``label`` of training rows, about ``max_rows`` at most.

    Rows of the held-out fold never enter. Repeated labels that agree count once, labels
    that contradict each other are left out. Beyond ``max_rows`` the rows with the smallest
    hashes stay; that bound is what makes the broadcast of the chosen ids safe.
    """
    known = (labels.where(F.col(target).isin(0, 1) & (fold() != 0))
             .groupBy("doc_id").agg(F.max(target).alias("label"), F.min(target).alias("_other"))
             .where("label = _other").drop("_other"))
    share = min(1.0, max_rows / max(1, known.count()))
    key = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    chosen = known.where(key < F.lit(share))
    return (docs.select("doc_id", raw("text").alias("text"))
            .join(F.broadcast(chosen), "doc_id").select("text", "label"))


_SCORER: list = []


def scorer_of(shipped, make):
    """One scorer per worker process and model, so that batches share what it remembers."""
    if not _SCORER or _SCORER[0] is not shipped.value:
        _SCORER[:] = [shipped.value, make(shipped.value)]
    return _SCORER[1]


def record_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, schema.field(k).type)
         for k, v in columns.items()], schema=schema)
