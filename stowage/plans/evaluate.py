"""Quality of recommendations against a suite of cases, and the gates on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_results(cases: DataFrame, recs: DataFrame, contradictions: DataFrame | None = None) -> DataFrame:
    """cases: name, scan_id, expected_top_ids, forbidden_ids; recs: scan_id, pos, id, policy_safe."""
    seen = recs.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("observed_ids"), F.count_if(~F.col("policy_safe")).alias("unsafe"))
    c = cases.join(seen, "scan_id", "left").withColumns({"observed_ids": F.coalesce("observed_ids", F.array().cast("array<string>")), "unsafe": F.coalesce("unsafe", F.lit(0))})
    if contradictions is not None:
        c = c.join(contradictions, "scan_id", "left")
    else:
        c = c.withColumn("contradiction_count", F.lit(0))
    top = F.slice("observed_ids", 1, 3)
    hits = F.size(F.filter(top, lambda x: F.array_contains(F.col("expected_top_ids"), x)))
    forbidden = F.filter("forbidden_ids", lambda x: F.array_contains(F.col("observed_ids"), x))
    c = c.withColumns({"hits": hits, "forbidden_hits": forbidden, "precision_at_3": F.when(F.size(top) > 0, hits / F.size(top)).otherwise(0.0), "contradiction_count": F.coalesce("contradiction_count", F.lit(0))})
    return c.withColumn("passed", (F.size("forbidden_hits") == 0) & ((F.size("expected_top_ids") == 0) | (F.col("hits") > 0)))


def summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total_cases"), F.count_if("passed").alias("passed_cases"), F.coalesce(F.avg("precision_at_3"), F.lit(0.0)).alias("precision_at_3"),
                       F.coalesce(F.avg((F.col("contradiction_count") > 0).cast("int")), F.lit(0.0)).alias("contradiction_rate"), F.coalesce(F.sum("unsafe"), F.lit(0)).alias("unsafe_recommendations"))


def quality_gate(result: DataFrame, precision: float = 0.70, contradiction: float = 0.05, unsafe: int = 0) -> DataFrame:
    ok = (F.col("precision_at_3") >= precision) & (F.col("contradiction_rate") <= contradiction) & (F.col("unsafe_recommendations") <= unsafe)
    return result.withColumn("passed_gate", ok)


def throughput_gate(current: DataFrame, baseline_mb_s: float, regression: float = 0.15) -> DataFrame:
    return current.withColumn("passed_gate", F.col("avg_throughput_mb_s") >= baseline_mb_s * (1 - regression))
