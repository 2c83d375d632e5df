"""Sources: CSV data, property files, mapping tables and the driver's Parquet tables."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",") -> DataFrame:
    """A CSV file with a header. Without a schema, types are inferred, and whole numbers are read as BIGINT."""
    reader = spark.read.option("header", True).option("sep", sep)
    if schema is not None:
        return reader.schema(schema).csv(path)
    df = reader.option("inferSchema", True).csv(path)
    return df.select(*[df[f"`{f.name}`"].cast("long").alias(f.name) if isinstance(f.dataType, T.IntegerType) else df[f"`{f.name}`"] for f in df.schema.fields])


def read_mapping(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A headerless CSV mapping table: column l0 holds the leaves, l1 to lh ever more general values."""
    df = spark.read.option("header", False).option("sep", sep).csv(path)
    return df.toDF(*[f"l{i}" for i in range(len(df.columns))])


def read_props(path: str) -> dict:
    """The property file of a dataset: qi_index, target, is_category."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def hierarchy_files(folder: str) -> dict[str, str]:
    """Attribute name -> path of each hierarchy file in a folder."""
    return {f.removesuffix(".json"): os.path.join(folder, f) for f in sorted(os.listdir(folder)) if f.endswith(".json")} if os.path.isdir(folder) else {}
