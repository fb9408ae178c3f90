"""What-if projections over the recommendations that policy allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import local_table

SCENARIOS = (("conservative", ("low",)), ("balanced", ("low", "medium")), ("aggressive", ("low", "medium", "high")))


def blocked(decisions: DataFrame) -> DataFrame:
    """How many recommendations of each scan a policy blocked."""
    return decisions.groupBy("scan_id").agg(F.count_distinct(F.when(F.col("action") == "blocked", F.col("recommendation_id"))).alias("blocked_recommendation_count"))


def plan(scans: DataFrame, recs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Three rows a scan, also where a scenario has no recommendation.  recs: scan_id, pos, id, policy_safe, risk_level,
    space_saving_bytes."""
    spark = recs.sparkSession
    risks = local_table(spark, [(i, s, r) for i, (s, rs) in enumerate(SCENARIOS) for r in rs], "scenario_pos int, scenario_id string, risk_level string")
    base = scans.select("scan_id").distinct().crossJoin(F.broadcast(local_table(spark, [(i, s) for i, (s, _) in enumerate(SCENARIOS)], "scenario_pos int, scenario_id string")))
    held = recs.where("policy_safe").join(F.broadcast(risks), "risk_level").groupBy("scan_id", "scenario_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("recommendation_ids"), F.count(F.lit(1)).alias("recommendation_count"),
        F.coalesce(F.sum("space_saving_bytes"), F.lit(0)).alias("projected_space_saving_bytes"), *(F.count_if(F.col("risk_level") == r).alias(f"risk_{r}") for r in ("low", "medium", "high")))
    out = base.join(held, ["scan_id", "scenario_id"], "left").join(blocked(decisions), "scan_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("recommendation_count", "projected_space_saving_bytes", "risk_low", "risk_medium", "risk_high", "blocked_recommendation_count")}
    out = out.withColumns(zero | {"recommendation_ids": F.coalesce("recommendation_ids", F.array().cast("array<string>"))})
    notes = F.array_compact(F.array(F.when(F.col("recommendation_count") == 0, "nothing that policy allows fits this scenario"),
                                    F.when(F.col("blocked_recommendation_count") > 0, F.concat(F.col("blocked_recommendation_count").cast("string"), F.lit(" blocked by policy and left out")))))
    return out.withColumn("notes", notes).orderBy("scan_id", "scenario_pos")
