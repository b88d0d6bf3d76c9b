"""Registry tables and legacy documents on storage."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipdex import schemas
from snipdex.operators.registry import uniqueness_violations
from snipdex.session import path_exists, stored


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of a registry table in order; missing ones are NULL."""
    from pyspark.sql import types as T

    fields = T.StructType.fromDDL(schemas.REGISTRY_TABLES[table]).fields
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )


def read_table(spark: SparkSession, base: str, table: str) -> DataFrame:
    """A stored table; columns added later are merged in."""
    return conform(spark.read.option("mergeSchema", "true").parquet(f"{base}/{table}"), table)


def write_table(df: DataFrame, base: str, table: str, mode: str = "overwrite") -> None:
    """Store a table after checking its unique keys, when appending together with what is stored.

    The rows are computed once.  As in SQL, a key with a NULL in any column is not checked.
    """
    rows = stored(conform(df, table), f"new-{table}")
    known = rows
    if mode == "append" and path_exists(df.sparkSession, f"{base}/{table}"):
        known = rows.unionByName(read_table(df.sparkSession, base, table))
    for keys in schemas.UNIQUE_KEYS[table]:
        broken = uniqueness_violations(known.dropna(subset=list(keys)), keys).limit(1).collect()
        if broken:
            raise ValueError(f"{table}: {keys} is not unique, for example {broken[0].asDict()}")
    rows.write.mode(mode).parquet(f"{base}/{table}")


def read_legacy_config(spark: SparkSession, path: str) -> DataFrame:
    """Legacy configuration documents, one per file, keys in any case.

    Known keys are put into the spelling of the schema before the text is parsed; inside a JSON
    string a quoted key would carry backslashes, so values are left alone.
    """
    text = F.col("value")
    for name in sorted(set(re.findall(r"(\w+)[: ]", schemas.LEGACY_CONFIG))):
        text = F.regexp_replace(text, f'(?i)"{name}"\\s*:', f'"{name}":')
    parsed = F.from_json(text, schemas.as_struct(schemas.LEGACY_CONFIG))
    return spark.read.text(path, wholetext=True).select(parsed.alias("d")).filter("d IS NOT NULL").select("d.*")
