"""Tables from files: Parquet, ORC, CSV, JSON and text, registered as views so that Catalyst prunes and pushes down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Reader option names of other engines.
OPTIONS = {"delim": "sep", "delimiter": "sep", "nullstr": "nullValue", "dateformat": "dateFormat", "timestampformat": "timestampFormat", "escape": "escape", "quote": "quote", "header": "header", "compression": "compression"}
EXTENSIONS = {"parquet": "parquet", "pq": "parquet", "orc": "orc", "csv": "csv", "tsv": "csv", "json": "json", "ndjson": "json", "jsonl": "json", "txt": "text"}


def read(spark: SparkSession, path: str | list[str], kind: str | None = None, schema=None, **options) -> DataFrame:
    """Read files; the kind comes from the extension unless given."""
    first = path if isinstance(path, str) else path[0]
    kind = EXTENSIONS.get(kind or first.rstrip("/").rsplit(".", 1)[-1].lower(), kind or "parquet")
    reader = spark.read.format(kind).options(**{OPTIONS.get(k.lower(), k): v for k, v in options.items()})
    if first.endswith(".tsv"):
        reader = reader.option("sep", "\t")
    return (reader.schema(schema) if schema is not None else reader).load(path)


def register_directory(spark: SparkSession, path: str, names: list[str] | None = None) -> list[str]:
    """A view for every `<name>.parquet` of a directory, listed through Hadoop so that any store works."""
    if names is None:
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
        names = sorted(f.getPath().getName()[: -len(".parquet")] for f in files if f.getPath().getName().endswith(".parquet"))
    for name in names:
        spark.read.parquet(f"{path}/{name}.parquet").createOrReplaceTempView(name)
    return names
