"""XML dump reader, and Parquet and CSV readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forumscope.schemas import DUMP_TABLES
from forumscope.session import spent_shuffles_go

#: Holds the text of lines that could not be read; never part of a result.
BROKEN = "_broken"

START = "<row"
#: What follows the start of an element, to its end: attributes, whose values may hold anything but their quote.
ELEMENT = r"""\A(?:\s+[^\s=/>]+\s*=\s*(?:"[^"]*"|'[^']*'))*+\s*(?:/>|>\s*</row\s*>)"""


def read_xml_dump(spark: SparkSession, path: str, table: str, splittable: bool = True) -> DataFrame:
    """Read ``<row .../>`` elements of one dump table with its declared schema.

    ``splittable`` cuts a plain or bzip2 file into many tasks, wherever lines end: the text is cut at each start of an element, which
    attributes cannot hold unescaped, so an element may span lines or share one with others. Gzip is read too, one task a file.
    What stands between elements is dropped; an element without an end, or with values that do not fit the schema, is an error.
    ``splittable=False`` parses whole files, one task a file.
    """
    if not splittable:
        rows = (
            spark.read.format("xml")
            .option("rowTag", "row")
            .option("multiLine", "true")
            .option("columnNameOfCorruptRecord", BROKEN)
            .schema(f"{DUMP_TABLES[table]}, {BROKEN} STRING")
            .load(path)
        )
        return _whole(rows, F.col(BROKEN), F.col(BROKEN).contains("<row"))
    pieces = spark.read.option("lineSep", START).text(path).where(F.col("value").rlike(r"\A[\s/>]"))
    element = F.regexp_extract("value", ELEMENT, 0)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    row = F.from_xml(F.concat(F.lit(START), element), f"{DUMP_TABLES[table]}, {BROKEN} STRING", options)
    rows = pieces.select(F.col("value").alias("_piece"), row.alias("_row")).select("_piece", "_row.*")
    unended = ~F.col("_piece").rlike(ELEMENT)
    return _whole(rows, F.concat(F.lit(START), F.col("_piece")), unended | F.col(BROKEN).isNotNull()).drop("_piece")


def _whole(rows: DataFrame, text: Column, broken: Column) -> DataFrame:
    message = F.concat(F.lit("not a whole element: "), F.substring(text, 1, 200))
    kept = F.when(broken, F.raise_error(message).cast("boolean")).otherwise(F.col("_Id").isNotNull())
    return rows.where(kept).drop(BROKEN)


#: Rows of a compressed file at most: it is read by one task.
FILE_ROWS = 1_000_000


def write_xml_dump(df: DataFrame, path: str, root: str, compression: str = "gzip") -> None:
    """Write a table as ``<row .../>`` elements, one to a line, in files of ``FILE_ROWS`` at most.

    Each element repeats all attribute names, so plain files are several times as large as the table; gzip leaves a small part of that.
    The shuffle files of the table are of no more use then, and go at once.
    """
    rows = df.write.format("xml").option("rowTag", "row").option("rootTag", root).option("compression", compression)
    with spent_shuffles_go(df.sparkSession):
        rows.option("maxRecordsPerFile", FILE_ROWS).save(path)


def write_parquet(df: DataFrame, path: str, overwrite: bool = False, files: int | None = None) -> None:
    """Write Parquet; the file count follows the data size unless the caller fixes it."""
    sized = df.repartition(files) if files else df.hint("rebalance")
    sized.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Scan one folder, or an explicit list of files and folders."""
    return spark.read.parquet(*paths)


def write_csv(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write CSV with a header, optionally one sub-folder for each value of ``partition_by``."""
    df.write.partitionBy(*partition_by).option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read CSV with a header and a declared schema."""
    return spark.read.schema(schema).option("header", "true").csv(path)

