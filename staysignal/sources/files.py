"""File sources: the customer CSV, permissive upload parsing, data-file
listing, and the JDBC reader options (SURVEY 2.1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import RAW_COLUMNS, UPLOAD_REQUIRED

_INT_COLS = {"SeniorCitizen": T.IntegerType(), "tenure": T.LongType(), "MonthlyCharges": T.DoubleType()}

# Raw customer file schema: declared, never inferred.
RAW_SCHEMA = T.StructType([T.StructField(c, _INT_COLS.get(c, T.StringType()), True) for c in RAW_COLUMNS])

# Keep the file's own whitespace (' Yes', ' ') and read empty fields as NULL.
CSV_OPTIONS = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
               "nullValue": "", "emptyValue": ""}


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names in the file's first line (an unnamed column is ``_cN``)."""
    return spark.read.options(**CSV_OPTIONS).csv(path).columns


def _read_by_header(spark: SparkSession, path: str, schema: T.StructType, required: list[str] | None,
                    corrupt: str | None = None) -> DataFrame:
    """The file's columns are found by name, whatever their order; columns
    outside ``schema`` (an index column, extras) are dropped, optional ones
    that the file lacks are NULL, and missing required names raise."""
    names = _header(spark, path)
    missing = [c for c in (required if required is not None else schema.names) if c not in names]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    types = {f.name: f.dataType for f in schema.fields}
    full = T.StructType([T.StructField(c, types.get(c, T.StringType()), True) for c in names])
    reader = spark.read.options(**CSV_OPTIONS).option("enforceSchema", "false")
    if corrupt:
        full = full.add(corrupt, T.StringType())
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
    df = reader.schema(full).csv(path)
    out = [F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*out, *([corrupt] if corrupt else []))


def scan_csv(spark: SparkSession, path: str, fallback: str | None = None, schema: T.StructType = RAW_SCHEMA,
             required: list[str] | None = None) -> DataFrame:
    """Read the customer CSV with declared types, columns by header name
    (``required``: all of the schema's); use ``fallback`` when ``path`` does
    not exist."""
    if not path_exists(spark, path):
        if fallback and path_exists(spark, fallback):
            path = fallback
        else:
            raise FileNotFoundError(f"no data file at {path}" + (f" or {fallback}" if fallback else ""))
    return _read_by_header(spark, path, schema, required)


def scan_csv_upload(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA,
                    required: list[str] = UPLOAD_REQUIRED) -> DataFrame:
    """Permissive parse, columns by header name: malformed lines keep their
    text in ``_corrupt_record`` instead of failing the job (no size cap: the
    reader splits the file across tasks); only ``required`` must be there."""
    return _read_by_header(spark, path, schema, required, "_corrupt_record")


def write_csv(df: DataFrame, path: str, index_col: str | None = "_c0") -> None:
    out = df.select(F.monotonically_increasing_id().cast("string").alias(index_col), *df.columns) \
        if index_col else df
    out.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def list_sources(spark: SparkSession, directory: str, glob: str = "*.parquet") -> DataFrame:
    """Data files under ``directory`` by suffix, sorted by path.  Only file
    metadata is read (the ``content`` column is never selected)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(directory))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length").orderBy("file")


def required_columns_check(df: DataFrame, required: list[str]) -> DataFrame:
    """Raise before any job runs when required columns are missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def jdbc_reader(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
                lower: int | None = None, upper: int | None = None, partitions: int = 8,
                fetch_size: int = 10000, properties: dict | None = None) -> DataFrameReader:
    """A partitioned JDBC reader (``SELECT * FROM table`` split into
    ``partitions`` range queries on a numeric column).  Credentials come from
    ``properties``; nothing is embedded here."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch_size)
    if partition_column:
        if lower is None or upper is None:
            raise ValueError("partitioned JDBC reads need lower and upper bounds")
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
              .option("upperBound", upper).option("numPartitions", partitions))
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r
