"""Readers of report, history and suite documents, always with an explicit schema."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..tables import local_table


def read_reports(spark: SparkSession, path) -> DataFrame:
    """Reports (one JSON document a file) with defaults filled in; a missing required field fails when it runs."""
    raw = spark.read.schema(schemas.REPORT_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return schemas.with_defaults(schemas.checked(raw))


def reports_from(spark: SparkSession, documents: list[dict]) -> DataFrame:
    rows = local_table(spark, [(json.dumps(d),) for d in documents], "value string")
    raw = rows.select(F.from_json("value", schemas.REPORT_SCHEMA).alias("r")).select("r.*")
    return schemas.with_defaults(schemas.checked(raw))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """One row with the snapshots; no file is an empty history."""
    if not os.path.exists(path):
        return local_table(spark, [([],)], schemas.HISTORY_SCHEMA)
    return spark.read.schema(schemas.HISTORY_SCHEMA).option("multiLine", True).json(path)


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    """name, report (a path beside the suite), expected_top_ids, forbidden_ids."""
    s = spark.read.schema(schemas.SUITE_SCHEMA).option("multiLine", True).json(path)
    here = os.path.dirname(os.path.abspath(path))
    return s.select(F.explode("cases").alias("c")).select("c.*").withColumn("report", F.concat(F.lit(here + "/"), "report"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    if not os.path.exists(path):
        return local_table(spark, [], schemas.INDEX_SCHEMA)
    return spark.read.schema(schemas.INDEX_SCHEMA).option("multiLine", True).json(path)
