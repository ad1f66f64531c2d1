"""Small helpers shared by the operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def columns(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns; one that is absent is null, any further ones are left out."""
    kinds = {"doc_id": "bigint", "item_id": "bigint"}
    found = set(docs.columns)
    return docs.select(*(F.col(n).cast(kinds.get(n, "string")).alias(n) if n in found else F.lit(None).cast(kinds.get(n, "string")).alias(n) for n in names))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="kpiloom-code-")) / "kpiloom-code.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
