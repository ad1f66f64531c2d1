"""Parse newly landed order files only.

The daily folders only ever grow, so a job that parses all of them again each
day does work that grows with their age.  This intake parses each version of a
file once and keeps its lines beside a ledger of what they came from: path,
modification time and length.  A file is new if the ledger lacks these three,
however old it is; so late, back-dated and replaced files are read.

Beside the lines stand the files that were skipped, and the counts of each file
that the summary of a run adds up.
"""

import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions import digits_only, safe_timestamp
from kpiloom.operators.dedupe import INPUT_ORDER
from kpiloom.schemas import RAW_ORDER_LINES
from kpiloom.sources.landing import (
    DATE_COLUMN,
    PIECES,
    Batches,
    check_files,
    settle_lines,
    stage_pieces,
    with_row_number,
    with_source,
)
from kpiloom.staging import COMPACT, materialize

_FILE = "source_file string, modified timestamp, length bigint"
_LEDGER = f"{_FILE}, batch string"


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """The order files that stand under ``root`` now; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", PIECES["pathGlobFilter"]).load(root)
    metadata = F.col("_metadata")
    return files.select(
        metadata["file_path"].alias("source_file"),
        metadata["file_modification_time"].alias("modified"),
        metadata["file_size"].alias("length"),
    )


def _kept(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # no file has landed yet


def _new_files(spark: SparkSession, root: str, staged: str) -> DataFrame:
    """The new files as a written table, numbered from 0 by range partitions, so that a page
    of them can be taken without the rest."""
    known = _kept(spark, f"{staged}/ledger", _LEDGER)
    new = _listed(spark, root).join(known, ["source_file", "modified", "length"], "left_anti")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(new.repartitionByRange(parts, "source_file").withColumn("part", F.spark_partition_id()), "new-files")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("files"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    bases = sizes.select("part", F.coalesce(F.sum("files").over(earlier), F.lit(0)).alias("base"))
    place = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("source_file")) - 1
    return materialize(dealt.join(bases, "part").select("source_file", "modified", "length", place.alias("place")), "numbered-files")


def stage_new_orders(spark: SparkSession, root: str, staged: str, max_files: int = 10_000) -> None:
    """Parse the files that the ledger lacks, ``max_files`` at a time, then return.

    The names of one such page are all that passes through the driver.  The
    ledger is written after the lines of a page.  After a failure between the
    two, the files are parsed again as another batch, and the lines that no
    ledger row names are never read.
    """
    new = _new_files(spark, root, staged)
    for first in range(0, new.count(), max_files):
        page = new.filter(F.col("place").between(first, first + max_files - 1)).drop("place")
        batch = uuid.uuid4().hex
        paths = [unquote(row.source_file) for row in page.select("source_file").collect()]
        pieces = with_row_number(with_source(spark.read.options(basePath=root, **PIECES).text(paths)))
        lines, skipped = settle_lines(materialize(stage_pieces(pieces), "raw-orders", **COMPACT), pieces)
        lines.write.options(**COMPACT).parquet(f"{staged}/lines/batch={batch}")
        skipped.write.parquet(f"{staged}/skipped/batch={batch}")
        _counts(spark.read.parquet(f"{staged}/lines/batch={batch}")).write.parquet(f"{staged}/counts/batch={batch}")
        page.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("append").parquet(f"{staged}/ledger")


def _counts(lines: DataFrame) -> DataFrame:
    """Per file, its day and what the summary of a run counts."""
    moment = F.col("order_date_time")
    return lines.groupBy("source_file", DATE_COLUMN).agg(
        F.count("*").alias("raw_orders_rows"),
        F.count_if(digits_only(F.col("mobile_number")) == "").alias("blank_mobile_rows"),
        F.count_if(moment.isNotNull() & safe_timestamp(moment).isNull()).alias("unparsed_date_rows"),
    )


_POSITION = T.StructType([
    T.StructField(DATE_COLUMN, T.DateType()), T.StructField("file", T.LongType()), T.StructField("split_start", T.LongType()),
    T.StructField("row_number", T.LongType()), T.StructField("piece", T.IntegerType()),
])
_BATCH = T.StructField("batch", T.StringType())
_SOURCE = T.StructField("source_file", T.StringType())
_DAY = T.StructField(DATE_COLUMN, T.DateType())
_LINES = T.StructType(RAW_ORDER_LINES.fields + [_DAY, T.StructField(INPUT_ORDER, _POSITION), _SOURCE, _BATCH])
_SKIPPED = T.StructType([_SOURCE, _DAY, _BATCH])
_COUNTED = T.StructType([_SOURCE, _DAY, *(T.StructField(n, T.LongType()) for n in ("raw_orders_rows", "blank_mobile_rows", "unparsed_date_rows")), _BATCH])
VERSIONS = "source_file string, batch string"


def staged_versions(spark: SparkSession, root: str, staged: str) -> DataFrame:
    """source_file, batch: where the lines of each file that stands under ``root`` now were staged.

    Of a file that was replaced or removed, the earlier versions are left out.
    """
    ledger = _kept(spark, f"{staged}/ledger", _LEDGER)
    return _listed(spark, root).join(ledger, ["source_file", "modified", "length"]).select("source_file", "batch")


def staged_lines(spark: SparkSession, staged: str, versions: DataFrame) -> DataFrame:
    """The staged lines of the given versions of files."""
    return _kept(spark, f"{staged}/lines", _LINES).join(versions, ["source_file", "batch"], "left_semi").select(*_LINES.names)


def staged_skips(spark: SparkSession, staged: str, versions: DataFrame) -> DataFrame:
    return _kept(spark, f"{staged}/skipped", _SKIPPED).join(versions, ["source_file", "batch"], "left_semi").select("source_file", DATE_COLUMN)


def staged_counts(spark: SparkSession, staged: str, versions: DataFrame) -> DataFrame:
    """Per file, its day and counts, without reading a line."""
    return _kept(spark, f"{staged}/counts", _COUNTED).join(versions, ["source_file", "batch"], "left_semi").select(*_COUNTED.names[:-1])


def read_staged_orders(spark: SparkSession, root: str, staged: str, on_bad_file: str = "skip") -> Batches:
    """The same result as reading every file under ``root`` again."""
    versions = staged_versions(spark, root, staged)
    rows = staged_lines(spark, staged, versions).select(*RAW_ORDER_LINES.names, DATE_COLUMN, INPUT_ORDER)
    return check_files(Batches(rows, staged_skips(spark, staged, versions)), on_bad_file)
