"""Daily landing folders ``<root>/ingest_date=YYYY-MM-DD/``.

Customers arrive as ``*.csv``, order lines as ``*.xml`` or ``*.xml.gz``; either may be
absent on a day.  A batch read parses every file once into a staged parquet table, skips a
file that cannot be read as a whole, and reports it.  No list of files passes
through the driver: layouts and flags are joined on the file.
"""

import uuid
from collections.abc import Callable
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions import partition_date_ist
from kpiloom.functions.calendar import utc_moment
from kpiloom.operators.dedupe import INPUT_ORDER
from kpiloom.schemas import RAW_CUSTOMERS, RAW_ORDER_LINES
from kpiloom.sources.raw import (
    CSV_OPTIONS,
    ORDER_FIELDS,
    ROW_TAG,
    blank_missing,
    resolve_amount,
)
from kpiloom.staging import COMPACT, list_files, materialize, move, remove

DATE_COLUMN = "ingest_date"
_CSV_FILES = "*.csv"
# Text cut at each closing row tag.
PIECES = {"pathGlobFilter": "*.{xml,xml.gz}", "lineSep": f"</{ROW_TAG}>"}
_CORRUPT = "_corrupt"
_LANDING = "_landing"
# XML is landed compressed and without indentation.  A compressed file is one task's work, so it is kept short.
_XML_OPTIONS = {"rowTag": ROW_TAG, "rootTag": "orders", "indent": "", "compression": "gzip", "maxRecordsPerFile": "200000"}
_XML_OPTIONS |= {"zlib.compress.level": "BEST_SPEED"}


_ORIGIN = [
    T.StructField(DATE_COLUMN, T.DateType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("split_start", T.LongType()),
    T.StructField("row_number", T.LongType()),
]
_FLAGS = [T.StructField(flag, T.BooleanType()) for flag in ("is_line", "corrupt", "unsplit", "ends")]
STAGED_ORDERS = T.StructType(
    ORDER_FIELDS.fields
    + _FLAGS
    + [T.StructField("piece", T.IntegerType())]
    + _ORIGIN
)


class Batches(NamedTuple):
    """Raw rows of all readable files, and (source_file, ingest_date) of the rest."""

    rows: DataFrame
    skipped: DataFrame


class BadFileError(ValueError):
    """Files that cannot be read as a whole, where none may be skipped."""


def check_files(batches: Batches, on_bad_file: str) -> Batches:
    """``batches`` itself; with ``on_bad_file='fail'`` an error that names bad files."""
    if on_bad_file not in ("skip", "fail"):
        raise ValueError(f"on_bad_file must be 'skip' or 'fail', not {on_bad_file!r}")
    if on_bad_file == "fail":
        named = [row["source_file"] for row in batches.skipped.limit(10).collect()]
        if named:
            raise BadFileError(f"malformed files, among them: {', '.join(named)}")
    return batches


def land_batch(df: DataFrame, root: str, fmt: str, arrived: Column | datetime) -> None:
    """Append a raw batch to the folder of the day (in India) it arrived.

    ``arrived`` is a moment (UTC if it has no zone), or a zone-less UTC timestamp
    column of ``df``.  The rebalance lets adaptive execution choose the files of
    a day: not one per task and day, and no day in one task.

    A batch is written to a folder of its own, which readers pass over, and its
    files are moved to their days once it is complete.  So batches that are landed
    at the same time do not meet, and of one that stops while it is written
    nothing is seen.  One that stops while it is moved is completed by the next
    batch, or by ``finish_landing``.
    """
    if isinstance(arrived, datetime):
        arrived = F.lit(utc_moment(arrived).isoformat(sep=" ")).cast("timestamp_ntz")
    options = {"csv": CSV_OPTIONS, "xml": _XML_OPTIONS}[fmt]
    dated = df.withColumn(DATE_COLUMN, partition_date_ist(arrived))
    dated = dated.hint("rebalance", F.col(DATE_COLUMN))
    staged = f"{root.rstrip('/')}/{_LANDING}/{uuid.uuid4().hex}"
    dated.write.partitionBy(DATE_COLUMN).options(**options).format(fmt).save(staged)
    finish_landing(df.sparkSession, root)


def finish_landing(spark: SparkSession, root: str) -> None:
    """Move the files of all batches under ``root`` that are completely written to their days.

    The names of files are unique, and several callers may do this at once: each
    file is moved by one of them.
    """
    for marker in list_files(spark, f"{root.rstrip('/')}/{_LANDING}/*/_SUCCESS"):
        staged = marker.rpartition("/")[0]
        for path in list_files(spark, f"{staged}/{DATE_COLUMN}=*/[!_.]*"):
            _, day, name = path.rsplit("/", 2)
            move(spark, path, f"{root.rstrip('/')}/{day}/{name}")
        remove(spark, staged)


def with_source(df: DataFrame) -> DataFrame:
    """Attach the landing day, the file and the split that a row comes from."""
    path = F.col("_metadata.file_path")
    return df.withColumns(
        {
            "source_file": path,
            "split_start": F.col("_metadata.file_block_start"),
            DATE_COLUMN: F.regexp_extract(path, f"/{DATE_COLUMN}=([^/]*)/", 1).try_cast("date"),
        }
    )


def with_row_number(df: DataFrame) -> DataFrame:
    """Number the rows.  One task reads a split in order, so (day, file, split
    start, row number) is the order in which the rows stand in the input."""
    return df.withColumn("row_number", F.monotonically_increasing_id())


def _input_order(*more: str) -> Column:
    """Where a row stands in the input: a few numbers, as every shuffle carries them.

    Days come in order and rows in file order; files of one day in a fixed one.
    """
    file = F.xxhash64("source_file").alias("file")
    return F.struct(DATE_COLUMN, file, "split_start", "row_number", *more).alias(INPUT_ORDER)


def _without_files(rows: DataFrame, skipped: DataFrame) -> DataFrame:
    return rows.join(skipped.select("source_file"), "source_file", "left_anti")


# -- customers -----------------------------------------------------------------


def _starts(parts: DataFrame, amount: str, begins: Callable[[Column], Column]) -> DataFrame:
    """Where the record starts that each part of a file belongs to, as ``at`` (split start, row number).

    A part starts a record if ``begins`` holds for the sum of ``amount`` over all
    parts of its file before it.  That is the sum over the earlier splits plus the
    sum within its own split, so a file is worked on by as many tasks as it has
    splits; what meets in one task is one row for each split.
    """
    split = ["source_file", "split_start"]
    inside = Window.partitionBy(*split).orderBy("row_number").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.withColumn("held", F.coalesce(F.sum(amount).over(inside), F.lit(0))), "parts")
    earlier = Window.partitionBy("source_file").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*split).agg(F.sum(amount).alias("sum"))
    carried = sums.select(*split, F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("carried"))
    parts = parts.join(carried, split)
    start = F.when(begins(F.col("held") + F.col("carried")), F.struct("split_start", "row_number"))
    upto = Window.partitionBy(*split).orderBy("row_number")
    parts = materialize(parts.withColumn("own", F.max(start).over(upto)), "marked-parts")
    last = parts.groupBy(*split).agg(F.max("own").alias("own"))
    before = last.select(*split, F.max("own").over(earlier).alias("inherited"))
    return parts.join(before, split).withColumn("at", F.coalesce("own", "inherited")).drop("held", "carried", "own", "inherited")


def _records(lines: DataFrame) -> DataFrame:
    """CSV records from text lines.

    A line with an odd number of quotes opens or closes a value that spans
    lines.  Only the files that have such a line are put together: a line
    belongs to the record whose first line is the last one with all quotes
    closed before it.
    """
    odd = (F.regexp_count("value", F.lit('"')) % 2).alias("odd")
    marked = lines.select("*", odd)
    spanning = marked.filter("odd = 1").select("source_file").distinct()
    plain = marked.join(spanning, "source_file", "left_anti").drop("odd")
    parts = _starts(marked.join(spanning, "source_file", "left_semi"), "odd", lambda quotes: quotes % 2 == 0)
    text = F.array_sort(F.collect_list(F.struct("split_start", "row_number", "value")))
    joined = (
        parts.groupBy("source_file", DATE_COLUMN, "at")
        .agg(text.alias("parts"))
        .select(
            F.array_join(F.col("parts.value"), "\n").alias("value"), "source_file", "at.split_start", DATE_COLUMN, "at.row_number"
        )
    )
    return plain.unionByName(joined)


def read_customer_batches(spark: SparkSession, root: str, on_bad_file: str = "skip") -> Batches:
    """Customers of all days, columns aligned by name, absent ones NULL.

    The text is read once.  A file's header is its first line; its records are
    parsed by position into as many columns as the widest header has, and one
    more that shows rows with too many fields.  A file with such a row is
    skipped.
    """
    text = spark.read.option("pathGlobFilter", _CSV_FILES).text(root)
    records = _records(with_row_number(with_source(text))).filter(F.trim("value") != "")
    lines = materialize(records, "raw-customers")
    at = F.struct("split_start", "row_number")
    headers = lines.groupBy("source_file").agg(F.min_by("value", at).alias("header"), F.min(at).alias("header_at"))
    widest = headers.agg(F.max(F.size(F.split("header", ",", -1)))).first()[0] or 1
    slots = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(widest + 1)])
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"} | {"multiLine": "true"}

    def fields(value: Column) -> Column:
        """The values of a record as an array."""
        return F.from_csv(value, slots.simpleString()[len("struct<") : -1].replace(":", " "), options)

    def array(parsed: str) -> Column:
        return F.array(*[F.col(f"{parsed}.{name}") for name in slots.names])

    named = headers.withColumn("parsed", fields(F.regexp_replace("header", "^\ufeff", "")))
    filled = F.transform(F.reverse("names"), lambda c: c.isNotNull())
    named = named.withColumn("names", array("parsed")).select(
        "source_file", "header_at",
        F.slice("names", F.lit(1), (F.size("names") - F.array_position(filled, True) + 1).cast("int")).alias("names"),
    )
    named = materialize(named, "headers")
    body = lines.join(named, "source_file").filter(at != F.col("header_at"))
    body = body.withColumn("parsed", fields(F.col("value"))).withColumn("fields", array("parsed"))

    def column(name: str) -> Column:
        place = F.array_position("names", name)
        return F.when(place > 0, F.get("fields", (place - 1).cast("int"))).alias(name)

    overlong = F.exists(F.slice("fields", F.size("names") + 1, widest + 1), lambda f: f.isNotNull())
    staged = body.select(*map(column, RAW_CUSTOMERS.names), overlong.alias("overlong"), DATE_COLUMN, "source_file", "split_start", "row_number")
    staged = materialize(staged, "parsed-customers")
    skipped = materialize(
        staged.filter("overlong").select("source_file", DATE_COLUMN).distinct(), "skipped-customers"
    )
    rows = blank_missing(_without_files(staged, skipped), RAW_CUSTOMERS.names)
    return check_files(Batches(rows.select(*RAW_CUSTOMERS.names, DATE_COLUMN, _input_order()), skipped), on_bad_file)


# -- order lines ---------------------------------------------------------------


_COMMENT = r"(?s)<!--.*?-->"
_CDATA = r"(?s)<!\[CDATA\[.*?\]\]>"
_OPENERS, _CLOSERS = r"<!--|<!\[CDATA\[", r"-->|\]\]>"
# A closing row tag may hold white space, which the line separator does not.
_SPACED_END = rf"</{ROW_TAG}\s+>"

# A plain record: the fields in the order of the schema, each once or absent, among any others, without
# attributes, entities or markup, and with text that the XML parser returns as it stands.
_GAP = r"[ \t\r\n]*+"
# ASCII one by one: such a class is one look-up in a table
_BARE = "".join(rf"\x{c:02X}" for c in range(0x21, 0x7F) if chr(c) not in "<>&") + r"\u00A1-\uD7FF"
_TEXT = rf"[{_BARE}]++(?: ++[{_BARE}]++)*+"
_OTHER = rf"(?:<(?!(?:{'|'.join(ORDER_FIELDS.names)})>)([a-z][a-z0-9_]*+)>(?:{_TEXT})?+</\{{}}>{_GAP})*+"
_PLAIN = rf"^{_GAP}(?:<\?xml [^<>]*+>{_GAP})?+(?:<{ROW_TAG}s>{_GAP})?+<{ROW_TAG}>{_GAP}{_OTHER.format(1)}"
_PLAIN += "".join(
    rf"(?:<{name}>({_TEXT})</{name}>{_GAP})?+{_OTHER.format(2 * k + 3)}" for k, name in enumerate(ORDER_FIELDS.names)
)
_PLAIN += r"\z"
# The same, as writers lay records out: nothing between the elements, and at most one other element, the last.
_FLAT = rf"(?! )(?>[ {_BARE}]+)(?<! )"
_LEAN = rf"^{_GAP}<{ROW_TAG}>" + "".join(rf"(?:<{name}>({_FLAT})</{name}>)?+" for name in ORDER_FIELDS.names)
_LEAN += rf"(?:<(?!(?:{'|'.join(ORDER_FIELDS.names)})>)([a-z][a-z0-9_]*+)>(?:{_FLAT})?+</\{len(ORDER_FIELDS) + 1}>)?+\z"
_MARK = "\x01"  # no character of XML


def parse_order_pieces(pieces: DataFrame) -> DataFrame:
    """Parse text that was cut at each closing row tag.

    Every piece but the last of a file is one record; the last holds only the
    closing root tag.  Comments are removed first.  A comment or CDATA section
    that reaches over a cut leaves a loose marker, and the pieces of its file
    are then to be put together (``unsplit``).  ``ends`` marks a proper end of file.
    Plain records are taken apart by a pattern, all others by the XML parser,
    with the same values.
    """
    value = F.col("value")
    # the values of a plain record, each behind a mark, found by a quick pattern or else by the full one; other
    # pieces go to the XML parser
    cut = pieces.withColumn("marked", value.contains("<!"))
    lean = F.regexp_replace("value", _LEAN, "".join(f"{_MARK}${k + 1}" for k in range(len(ORDER_FIELDS))))
    values = F.regexp_replace("value", _PLAIN, "".join(f"{_MARK}${2 * k + 2}" for k in range(len(ORDER_FIELDS))))
    cut = cut.withColumn("lean", F.when(~F.col("marked"), lean))
    full = F.when(~F.col("marked"), values)
    cut = cut.withColumn("values", F.when(F.col("lean").startswith(_MARK), F.col("lean")).otherwise(full)).drop("lean")
    plain = F.coalesce(F.col("values").startswith(_MARK) & ~value.startswith(_MARK), F.lit(False))
    cut = cut.withColumn("plain", plain).withColumn("values", F.when(F.col("plain"), F.split("values", _MARK)))
    # a piece without such markup, which a byte search tells, is spared the patterns below
    marked = F.col("marked") | value.contains("-->") | value.contains("]]>") | value.rlike(_SPACED_END)
    cut = cut.withColumn("marked", ~F.col("plain") & marked)
    cut = cut.withColumn("body", F.when(F.col("marked"), F.regexp_replace("value", _COMMENT, "")).otherwise(value))
    bare = F.regexp_replace("body", _CDATA, "")
    loose = F.col("marked") & bare.rlike(f"{_OPENERS}|{_CLOSERS}")
    whole = F.when(F.col("marked") & ~loose, F.split("body", _SPACED_END, -1)).otherwise(F.array("body"))
    cut = cut.withColumn("loose", loose).select("*", F.posexplode(whole).alias("piece", "part")).withColumn("body", F.col("part"))
    bare = F.when(F.col("marked"), F.regexp_replace("body", _CDATA, "")).otherwise(F.col("body"))
    starts = F.when(F.col("plain"), 1).otherwise(F.regexp_count(bare, F.lit(rf"<{ROW_TAG}[\s>]")))
    record = F.concat(
        F.regexp_extract("body", rf"(?s)(<{ROW_TAG}(?:\s[^>]*)?>.*)", 1), F.lit(f"</{ROW_TAG}>")
    )
    schema = T.StructType(ORDER_FIELDS.fields + [T.StructField(_CORRUPT, T.StringType())])
    options = {"rowTag": ROW_TAG, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = cut.withColumn("starts", starts).withColumn(
        "line", F.when((F.col("starts") > 0) & ~F.col("plain"), F.from_xml(record, schema, options))
    )

    def field(place: int, name: str) -> Column:
        plainly = F.nullif(F.get("values", F.lit(place)), F.lit(""))
        return F.when(F.col("plain"), plainly).otherwise(F.col(f"line.{name}")).alias(name)

    return parsed.select(
        *[field(k, name) for k, name in enumerate(ORDER_FIELDS.names, 1)],
        (F.col("starts") > 0).alias("is_line"),
        ((F.col("starts") > 1) | F.col(f"line.{_CORRUPT}").isNotNull()).alias("corrupt"),
        F.col("loose").alias("unsplit"),
        ((F.col("starts") == 0) & F.col("body").rlike(r"</[^<>\s]+\s*>\s*$")).alias("ends"),
        "piece",
        DATE_COLUMN,
        "source_file",
        "split_start",
        "row_number",
    )


def _rejoined(pieces: DataFrame, files: DataFrame) -> DataFrame:
    """The files with loose markers, read again, put together over their cuts and parsed.

    A piece continues the one before while more comments or sections were opened
    than closed; only the pieces of one comment or section meet.
    """
    parts = pieces.join(files.filter("unsplit").select("source_file"), "source_file", "left_semi")
    bare = F.regexp_replace(F.regexp_replace("value", _COMMENT, ""), _CDATA, "")
    loose = F.regexp_count(bare, F.lit(_OPENERS)) - F.regexp_count(bare, F.lit(_CLOSERS))
    parts = parts.select("value", DATE_COLUMN, "source_file", "split_start", "row_number", loose.alias("opened"))
    grouped = _starts(parts, "opened", lambda markers: markers <= 0)
    text = F.array_sort(F.collect_list(F.struct("split_start", "row_number", "value")))
    joined = grouped.groupBy("source_file", DATE_COLUMN, "at").agg(text.alias("parts"))
    value = F.array_join(F.col("parts.value"), f"</{ROW_TAG}>")
    return parse_order_pieces(
        joined.select(value.alias("value"), "source_file", "at.split_start", DATE_COLUMN, "at.row_number")
    )


def order_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The text of all XML files, cut after each record.

    The XML reader gives a whole file to one task; text with the closing tag as
    line separator splits at any size.
    """
    return with_row_number(with_source(spark.read.options(**PIECES).text(root)))


def _broken(rows: DataFrame) -> Column:
    return F.bool_or("corrupt") | ~F.bool_or("ends")


def settle_order_files(staged: DataFrame) -> DataFrame:
    """Per file, whether its pieces must be put together and whether it is broken."""
    return staged.groupBy("source_file", DATE_COLUMN).agg(
        F.bool_or("unsplit").alias("unsplit"), _broken(staged).alias("broken")
    )


def stage_pieces(pieces: DataFrame) -> DataFrame:
    """Parsed pieces with the columns that are kept."""
    return parse_order_pieces(pieces).select(*STAGED_ORDERS.names)


def read_order_batches(spark: SparkSession, root: str, on_bad_file: str = "skip") -> Batches:
    """Order lines of all days; a truncated or malformed file is skipped whole."""
    pieces = order_pieces(spark, root)
    staged = materialize(stage_pieces(pieces), "raw-orders", **COMPACT)
    return check_files(settle_orders(staged, pieces), on_bad_file)


def settle_orders(staged: DataFrame, pieces: DataFrame) -> Batches:
    """Choose the lines of the readable files from parsed, written pieces.

    The text is not written with them: ``pieces`` reads it again, if a file has
    to be put together.
    """
    lines, skipped = settle_lines(staged, pieces)
    return Batches(lines.drop("source_file"), skipped)


def settle_lines(staged: DataFrame, pieces: DataFrame) -> Batches:
    """The same, each line with its file."""
    files = materialize(settle_order_files(staged), "order-files")
    lines = staged.filter("is_line")
    bad = files.filter(~F.col("unsplit") & F.col("broken")).select("source_file", DATE_COLUMN)
    if not files.filter("unsplit").isEmpty():
        again = materialize(_rejoined(pieces, files), "rejoined-orders")
        lines = _without_files(lines, files.filter("unsplit")).unionByName(again.filter("is_line"))
        # a marker still loose is a comment or section that never ends
        judged = again.groupBy("source_file", DATE_COLUMN).agg((_broken(again) | F.bool_or("unsplit")).alias("broken"))
        bad = bad.unionByName(judged.filter("broken").select("source_file", DATE_COLUMN))
    skipped = materialize(bad, "skipped-orders")
    rows = resolve_amount(blank_missing(_without_files(lines, skipped), ORDER_FIELDS.names))
    return Batches(rows.select(*RAW_ORDER_LINES.names, DATE_COLUMN, _input_order("piece"), "source_file"), skipped)


def scan_orders_xml(spark: SparkSession, path: str) -> DataFrame:
    """Order lines from XML files of any size; a malformed file fails the scan."""
    rows = read_order_batches(spark, path, on_bad_file="fail").rows
    return rows.select(*RAW_ORDER_LINES.names, DATE_COLUMN)
