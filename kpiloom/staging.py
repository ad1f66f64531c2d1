"""Written tables in the folders that the whole cluster shares."""

import json
import tempfile
import uuid
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_VERSION = "version="
_NAMED = "spark.kpiloom.shared.dir"
# For large written tables: no slower than the default there, and much smaller.
COMPACT = {"compression": "zstd"}


def name_local_folder(spark: SparkSession) -> None:
    """For a session on one machine that names no shared folder, name a temporary one.

    Callers that own the session (entry points, tests) do this; the package
    itself never falls back to a local folder.
    """
    local = spark.conf.get("spark.master", "").split("[")[0] == "local"
    if local and not (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_NAMED, None)):
        spark.conf.set(_NAMED, tempfile.mkdtemp(prefix="kpiloom-"))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor must reach."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_NAMED, None)
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return configured.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own, under one folder per application that its owner can expire."""
    run = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/kpiloom/{run}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once as parquet, with the given options, and read it back.

    The written table cuts the lineage, survives the loss of an executor, and
    gives the planner an exact size, so that a later join broadcasts it only if
    it is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# -- versions of a dataset -------------------------------------------------------


def _versions(spark: SparkSession, root: str) -> list[str]:
    """The complete versions of a dataset, oldest first.

    A version counts from the moment its success marker exists, which the
    writer puts down last; so the switch to a new one is one file.
    """
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{_VERSION}*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(status.getPath().getParent().toString() for status in found or ())


def new_version(root: str) -> str:
    """The folder of the next version; later ones sort after earlier ones."""
    moment = datetime.now(UTC).strftime("%Y%m%dT%H%M%S%f")
    return f"{root.rstrip('/')}/{_VERSION}{moment}-{uuid.uuid4().hex[:8]}"


def current_version(spark: SparkSession, root: str) -> str:
    """The folder of the last complete version, or ``root`` itself if it holds no versions."""
    versions = _versions(spark, root)
    return versions[-1] if versions else root


def remove(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)


def expire_versions(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Remove all but the last versions; the one before the current may still be read.

    Of an older version the month folders stay that a kept one names.
    """
    versions = _versions(spark, root)
    needed = {folder for version in versions[-keep:] for folder in (manifest(spark, version) or {"months": {}})["months"].values()}
    for path in versions[:-keep]:
        if not any(folder.startswith(f"{path}/") for folder in needed):
            remove(spark, path)
            continue
        for folder in _folders(spark, path).values():
            if folder not in needed:
                remove(spark, folder)


# -- small files -------------------------------------------------------------------


def _place(spark: SparkSession, path: str):
    """(path, file system) of Hadoop."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in place in one step: readers see all of it or nothing."""
    folder, _, name = path.rpartition("/")
    place, files = _place(spark, path)
    half, _ = _place(spark, f"{folder}/_{name}-{uuid.uuid4().hex}")
    stream = files.create(half, False)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    if not files.rename(half, place):
        raise OSError(f"cannot put {path} in place")


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None where there is none."""
    place, files = _place(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a pattern names, in order."""
    place, files = _place(spark, pattern)
    return sorted(status.getPath().toString() for status in files.globStatus(place) or ())


def move(spark: SparkSession, path: str, to: str) -> None:
    """Move a file to a place that is free; nothing if another has moved it there."""
    old, files = _place(spark, path)
    new, _ = _place(spark, to)
    files.mkdirs(new.getParent())
    try:
        done = files.rename(old, new)
    except Py4JJavaError as error:
        if "FileNotFoundException" not in str(error):
            raise
        done = False
    if not done and not files.exists(new):
        raise OSError(f"cannot move {path} to {to}")


def expire_files(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Remove all but the last of the files of a folder, by name."""
    for path in list_files(spark, f"{folder}/[!_.]*")[:-keep]:
        remove(spark, path)


# -- versions of month folders --------------------------------------------------------

_MANIFEST = "_months"


def _folders(spark: SparkSession, version: str) -> dict[str, str]:
    """The month folders inside a version, by month."""
    return {path.rpartition("=")[2]: path for path in list_files(spark, f"{version}/*=*")}


def manifest(spark: SparkSession, version: str) -> dict | None:
    """What a version that shares folders with earlier ones consists of: ``months`` names
    the folder of each month, ``built`` says from what it was built.  None for a version
    that is whole in its own folder."""
    text = read_text(spark, f"{version}/{_MANIFEST}")
    return None if text is None else json.loads(text)


def month_folders(spark: SparkSession, version: str) -> dict[str, str]:
    """The folder of each month of a version."""
    named = manifest(spark, version)
    return _folders(spark, version) if named is None else named["months"]


def commit_months(spark: SparkSession, version: str, kept: dict[str, str], built: dict) -> None:
    """Completes a version whose own months are written: they and the kept folders of
    earlier versions are the dataset from the moment the success marker is there."""
    months = {**kept, **_folders(spark, version)}
    write_text(spark, f"{version}/{_MANIFEST}", json.dumps({"built": built, "months": months}))
    place, files = _place(spark, f"{version}/_SUCCESS")
    files.create(place, True).close()
