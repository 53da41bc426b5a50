"""Batch readers. Everything stays lazy; nothing is counted unless asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T, functions as F

from featurelens.operators.columns import raw_name
from featurelens.operators.shared import local_frame
from featurelens.operators.split import hash_sample

EXTENSIONS = {"csv": "csv", "tsv": "tsv", "tab": "tsv", "json": "json", "jsonl": "json", "parquet": "parquet"}
WORKING_FRACTION = 0.1


def read_csv(spark: SparkSession, path: str, header: bool = True, infer: bool = True, sep: str = ",",
             schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV from any file system Spark can reach; a given schema avoids the inference pass."""
    reader = spark.read.options(header=header, sep=sep, **options)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", infer)).csv(path)


def read_tsv(spark: SparkSession, path: str, **kw) -> DataFrame:
    """S3."""
    return read_csv(spark, path, sep="\t", **kw)


def read_json(spark: SparkSession, path: str, multi_line: bool = False, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines, or one document per file."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S5."""
    return spark.read.parquet(path)


def detect_type(spark: SparkSession, source: str, named: dict[str, str] | None = None) -> str:
    """Catalog table, then a path by its extension, then a known name."""
    last = source.rstrip("/").rsplit("/", 1)[-1]
    extension = last.rsplit(".", 1)[-1].lower() if "." in last else ""
    if "/" not in source and spark.catalog.tableExists(source):
        return "table"
    if extension in EXTENSIONS:
        return EXTENSIONS[extension]
    if named and source in named:
        return "named"
    raise ValueError(f"cannot tell what {source!r} is: no table, known extension or known name")


def load_source(spark: SparkSession, source: str | DataFrame, source_type: str = "auto", named: dict[str, str] | None = None,
                **options) -> tuple[DataFrame, dict]:
    """``(DataFrame, metadata)``; the metadata holds what is known without reading the rows."""
    if isinstance(source, DataFrame):
        df, kind = source, "dataframe"
    else:
        kind = detect_type(spark, source, named) if source_type == "auto" else source_type
        if kind == "table":
            df = spark.table(source)
        elif kind == "named":
            return load_source(spark, named[source], "auto", None, **options)
        else:
            readers = {"csv": read_csv, "tsv": read_tsv, "json": read_json, "parquet": read_parquet}
            if kind not in readers:
                raise ValueError(f"unknown source type: {kind}")
            df = readers[kind](spark, source, **options)
    return df, {"format": kind, "columns": len(df.columns), "schema": df.schema.simpleString()}


def read_with_options(df: DataFrame, select: Sequence[str] | None = None, where: str | None = None, sample_percent: float | None = None,
                      limit: int | None = None, seed: int = 42, key: str | Sequence[str] | None = None) -> DataFrame:
    """Sample, filter, project and limit, in this order; Catalyst pushes them to the source.

    The sample is by the hash of ``key``, or of all columns if none is given.
    """
    out = df
    if sample_percent is not None:
        out = hash_sample(out, key or out.columns, sample_percent / 100.0, seed)
    if where:
        out = out.where(where)
    if select:
        out = out.selectExpr(*select)
    return out.limit(limit) if limit is not None else out


def materialise_filtered(df: DataFrame, where: str | None = None, select: Sequence[str] | None = None, table: str | None = None) -> DataFrame:
    """Filtered and projected rows, written for reuse as a table when a name is given, else as a view of the source."""
    out = read_with_options(df, select, where)
    if table is None:
        return out
    out.write.mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def working_sample(df: DataFrame, key: str | Sequence[str], fraction: float = WORKING_FRACTION, seed: int = 42) -> DataFrame:
    """A share of the rows by key hash, on request; a fraction of 1 is the whole table."""
    return hash_sample(df, key, fraction, seed)


def reload_selected(df: DataFrame, selected: Sequence[str], target: str, where: str | None = None) -> DataFrame:
    """Target and the raw columns behind the selected features, same filter, full rows."""
    raw = list(dict.fromkeys(raw_name(c) for c in selected))
    out = df.where(where) if where else df
    return out.select(target, *[c for c in raw if c != target])


def load_datasets(spark: SparkSession, sources: dict[str, str | DataFrame], **options) -> dict[str, DataFrame]:
    """Train and later datasets by name; they must share the columns of the first."""
    out = {name: load_source(spark, s, **options)[0] for name, s in sources.items()}
    first = next(iter(out.values()))
    for name, d in out.items():
        lost = [c for c in first.columns if c not in d.columns]
        if lost:
            raise ValueError(f"dataset {name!r} lacks columns {lost}")
    return out


def preview(df: DataFrame, n: int = 5, count: bool = True) -> tuple[DataFrame, dict]:
    """First rows, schema and sizes."""
    info = {"columns": len(df.columns), "schema": [(f.name, f.dataType.simpleString()) for f in df.schema]}
    if count:
        info["rows"] = df.count()
    return df.limit(n), info


def preview_table(df: DataFrame) -> DataFrame:
    """S14 as a table: one row per column with type, position and the row count."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    names = local_frame(df.sparkSession, rows, "position int, column string, data_type string")
    n = df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("_k", F.lit(1))
    return names.withColumn("_k", F.lit(1)).join(n, "_k").drop("_k")
