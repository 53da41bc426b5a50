"""Helpers for frames whose size depends on the schema, not on the rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows of an aggregated frame that the driver agrees to hold.
SMALL_FRAME_ROWS = 200_000


def local_frame(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """Driver rows as a local relation, whose exact size the optimizer knows."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    table = pa.Table.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema)


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key is a key like any other; the keys of ``right`` are dropped."""
    same = {k: f"_same_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(same)
    return left.join(right, reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(s)) for k, s in same.items()]), how).drop(*same.values())


def pin_small(df: DataFrame, limit: int = SMALL_FRAME_ROWS) -> tuple[DataFrame, list]:
    """Evaluate an aggregated frame once and hold it as a local relation.

    Spark knows the exact size of a local relation, so it broadcasts it only
    when it is under the session's own threshold. Raises above ``limit`` rows.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"aggregated frame has more than {limit} rows")
    return local_frame(df.sparkSession, [tuple(r) for r in rows], df.schema), rows


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        # a folder of this machine only serves a session that runs on this machine
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="featurelens-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def fresh_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
