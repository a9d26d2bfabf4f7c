"""Readers, writers and file fingerprints (Spark data sources)."""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .splitscan import Elements, Lines, split_records

# Fixed values from the reference: extension -> format. Excel is recognised but
# has no Spark source here (see README, "Not built"); PDFs go to the document path.
EXTENSIONS = {
    ".csv": "csv",
    ".json": "json",
    ".parquet": "parquet",
    ".xlsx": "excel",
    ".xls": "excel",
    ".pdf": "pdf",
}


def detect_file_type(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in EXTENSIONS:
        raise ValueError(f"Unsupported file type: {ext}")
    return EXTENSIONS[ext]


#: Standard quoting: a quote inside a quoted field is doubled.
CSV_QUOTING = {"quote": '"', "escape": '"'}


#: Options under which the split scans would cut records elsewhere than Spark.
_OWN_CUT = {"quote", "escape", "lineSep", "encoding", "charset", "comment", "mode", "header", "multiLine"}


def _parse(reader, method: str, records: DataFrame) -> DataFrame:
    """Spark's own parser over a column of records (``text``)."""
    spark = records.sparkSession
    strings = getattr(records.select("text")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(getattr(reader._jreader, method)(strings), spark)


def _header_names(record: str) -> list[str]:
    """Column names of a header record, as Spark makes them: empty ones by
    position, repeated ones with their position."""
    names = next(csv.reader([record], strict=True), [])
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def _read_csv_split(spark: SparkSession, path, schema, options) -> DataFrame:
    records = split_records(spark, path, Lines)
    r = spark.read.option("header", False).option("mode", "FAILFAST").option("multiLine", True).options(**CSV_QUOTING, **options)
    body = records.where(~F.col("first"))
    if schema is not None:
        return _parse(r.schema(schema), "csv", body)
    head = records.where("first").orderBy("file").limit(1).collect()
    if not head:
        raise ValueError(f"{path}: no header row")
    return _parse(r.option("inferSchema", True), "csv", body).toDF(*_header_names(head[0]["text"].lstrip("\ufeff")))


def read_csv(
    spark: SparkSession, path: str, schema=None, multi_line: bool = False, split: bool = True, **options
) -> DataFrame:
    """Header row; types inferred over the data unless ``schema`` is given
    (give one at scale: inference is an extra pass); empty field = null. Quotes
    are doubled inside quotes; ``multi_line`` for fields with line breaks. Such a
    file is cut into ranges by quote parity (:mod:`splitscan`) and read by many
    tasks, unless ``split`` is off or options change quoting, comments, lines or
    encoding; a bare quote in an unquoted field is not allowed there, and lines
    end in ``\\n`` or ``\\r\\n``. A row that does not parse raises."""
    options.pop("sheet_name", None)
    if multi_line and split and not _OWN_CUT & options.keys():
        return _read_csv_split(spark, path, schema, options)
    r = spark.read.option("header", True).option("mode", "FAILFAST").option("multiLine", multi_line).options(**CSV_QUOTING)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.options(**options).csv(path)


# microsecond timestamps survive a JSON round trip (Spark's default keeps milliseconds)
JSON_TS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def read_json(
    spark: SparkSession, path: str, schema=None, multi_line: bool | None = None, split: bool = True, **options
) -> DataFrame:
    """JSON records, one per line, or an array of records (on any number of
    lines). Which one is told by how the first file begins, unless ``multi_line``
    says so. An array file is cut between its elements (:mod:`splitscan`) and read
    by many tasks, on one line or many, unless ``split`` is off or options change
    lines, comments or encoding. A record that does not parse raises."""
    array = False
    if multi_line is not False:
        first = spark.read.option("lineSep", "}").text(path).limit(1).collect()  # up to the first brace
        lines = first[0][0].lstrip("\ufeff \t\r\n").splitlines() if first else []
        array = bool(lines) and lines[0].startswith("[")
        if multi_line is None:
            multi_line = array or bool(lines) and lines[0].strip() == "{"
    r = spark.read.option("mode", "FAILFAST").options(**JSON_TS)
    if schema is not None:
        r = r.schema(schema)
    own = {"allowComments", "allowSingleQuotes", "allowBackslashEscapingAnyCharacter"} | _OWN_CUT
    if array and split and not own & options.keys():
        return _parse(r.options(**options), "json", split_records(spark, path, Elements))
    return r.option("multiLine", bool(multi_line)).options(**options).json(path)


def read_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    """Columnar scan; filters and projections reach the reader."""
    return spark.read.options(**options).parquet(path)


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Choose the reader from the extension; PDFs and unknown types raise."""
    kind = detect_file_type(path)
    if kind == "pdf":
        raise ValueError("PDF files produce several tables: use the document operators")
    if kind == "excel":
        raise NotImplementedError("Excel workbooks have no Spark source here; export to CSV")
    options = dict(options)
    options.pop("sheet_name", None)
    return {"csv": read_csv, "json": read_json, "parquet": read_parquet}[kind](spark, path, **options)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str | None = None,
    query: str | None = None,
    partition_column: str | None = None,
    lower_bound=None,
    upper_bound=None,
    num_partitions: int | None = None,
    **options,
) -> DataFrame:
    """A table or a query from a JDBC database. With ``partition_column`` and
    bounds the read is split into ``num_partitions`` parallel range queries."""
    r = spark.read.format("jdbc").option("url", url).options(**options)
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table / query")
    r = r.option("dbtable", table) if table else r.option("query", query)
    if partition_column:
        r = (
            r.option("partitionColumn", partition_column)
            .option("lowerBound", lower_bound)
            .option("upperBound", upper_bound)
            .option("numPartitions", num_partitions or spark.sparkContext.defaultParallelism)
        )
    return r.load()


def jdbc_table_info(spark: SparkSession, url: str, table: str, **options) -> dict:
    """Schema (lazy, no scan) and row count (a COUNT query pushed to the database)."""
    df = read_jdbc(spark, url, table=table, **options)
    n = read_jdbc(spark, url, query=f"SELECT COUNT(*) AS n FROM {table}", **options).first()[0]
    return {"columns": [(f.name, f.dataType.simpleString()) for f in df.schema.fields], "row_count": int(n)}


_MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def write_jdbc(df: DataFrame, url: str, table: str, if_exists: str = "replace", **options) -> None:
    """Write through JDBC, each partition in its own connection."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(_MODES[if_exists]).save()


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header row (one file per partition), standard quoting."""
    df.write.mode(mode).option("header", True).options(**CSV_QUOTING).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON records, one per line."""
    df.write.mode(mode).options(**JSON_TS).json(path)


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON arrays of records, one array file per partition (nothing is
    brought together), an element a line."""

    def run(batches):
        import pyarrow as pa

        lead = "["
        for b in batches:
            records = b.column(0).to_pylist()
            if records:
                yield pa.RecordBatch.from_arrays([pa.array([lead + records[0], *("," + r for r in records[1:])])], names=["value"])
                lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"])], names=["value"])

    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), JSON_TS)
    df.select(record.alias("value")).mapInArrow(run, "value string").write.mode(mode).text(path)


#: Files up to this size are hashed as one value, larger ones in chunks.
WHOLE_FILE_BYTES = 64 << 20


def file_hashes(spark: SparkSession, path: str, glob: str | None = None, whole_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """SHA-256 of every file under ``path`` (path, length, sha256), one row
    per file, in parallel. Larger files are read through the file system in
    chunks, so no cell ever holds more than ``whole_bytes``."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    files = r.load(path)
    small = files.where(F.col("length") <= whole_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole_bytes).select("path", "length")  # the content is not read

    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            out = []
            for uri in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(uri)
                h = hashlib.sha256()
                with store.open_input_stream(at) as stream:
                    while chunk := stream.read(4 << 20):
                        h.update(chunk)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=["path", "length", "sha256"])

    return small.unionByName(large.repartition("path").mapInArrow(run, "path string, length long, sha256 string"))
