"""Weighted votes of correlated evidence groups over voxels.

A group contributes the maximum of its layers, groups are summed; absence is no vote. Two hash
aggregates; rows of a voxel are dealt once, by the voxel, which also serves the inner keys.
Weights are integer hundredths, so sums are exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOXEL = ("t", "y", "x")
# Role weights and defaults of the vote, in hundredths.
ROLE_WEIGHTS = {"prediction": 100, "bridge": 35, "mixed": 50, "extrapolation": 35}


@dataclass(frozen=True)
class VotePolicy:
    threshold: int = 150
    min_sources: int = 2
    min_direct: int = 1
    weights: dict[str, int] = field(default_factory=lambda: dict(ROLE_WEIGHTS))
    use_scores: bool = False  # predictions count score / 255 of their weight, unknown scores nothing
    anchor_score: int = 204  # 0.8 of 255
    anchor_bonus: int = 0


def evidence_role(kind: Column) -> Column:
    """Role of a layer from its mask kind; an unknown kind is an error."""
    return (
        F.when(kind == "yolo", "prediction")
        .when(kind.isin("bridge", "extrapolation"), kind)
        .when(kind == "union", "mixed")
        .otherwise(F.raise_error(F.concat(F.lit("unknown mask kind "), kind)))
    )


def role_weight(role: Column, weights: dict[str, int]) -> Column:
    found = F.lit(None).cast("int")
    for name, weight in weights.items():
        found = F.when(role == name, weight).otherwise(found)
    return found


def group_votes(evidence: DataFrame, policy: VotePolicy, group: str = "grp", scale: Column | None = None) -> DataFrame:
    """(t, y, x, group, vote, direct, anchor): the vote of each group at each voxel, in hundredths times 255."""
    direct = F.col("role") == "prediction"
    value = F.when(direct, F.col("score")).otherwise(255) if policy.use_scores else F.lit(255)
    vote = role_weight(F.col("role"), policy.weights) * value * (scale if scale is not None else 1)
    rows = evidence.select(
        *VOXEL,
        F.col(group).alias("grp"),
        vote.alias("vote"),
        (direct & (vote > 0)).alias("direct"),
        (direct & (F.col("score") >= policy.anchor_score)).alias("anchor"),
    ).repartition(*VOXEL)
    return rows.groupBy(*VOXEL, "grp").agg(
        F.max("vote").alias("vote"), F.bool_or("direct").alias("direct"), F.bool_or("anchor").alias("anchor")
    )


def weighted_vote(evidence: DataFrame, policy: VotePolicy = VotePolicy(), group: str = "grp", scale: Column | None = None) -> DataFrame:
    """(t, y, x, total, sources, direct, anchored, kept) for every candidate voxel."""
    votes = group_votes(evidence, policy, group, scale)
    voxels = votes.groupBy(*VOXEL).agg(
        F.sum("vote").alias("votes"),
        F.count_if(F.col("vote") > 0).alias("sources"),
        F.count_if("direct").alias("direct"),
        F.bool_or("anchor").alias("any_anchor"),
    )
    anchored = F.col("any_anchor") & (F.col("direct") >= 2)
    total = F.col("votes") + F.when(anchored, policy.anchor_bonus * 255).otherwise(0)
    return voxels.select(
        *VOXEL, total.alias("total"), "sources", "direct", anchored.alias("anchored")
    ).withColumn(
        "kept",
        (F.col("total") >= policy.threshold * 255) & (F.col("sources") >= policy.min_sources) & (F.col("direct") >= policy.min_direct),
    )


def by_plane(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("t").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("kept").alias("retained"))


def apply_policies(evidence: DataFrame, policies: DataFrame) -> DataFrame:
    """Retained voxels under each row of a small policy table (name, threshold, min_sources, min_direct): one pass over the voxels."""
    voxels = weighted_vote(evidence).select("total", "sources", "direct")
    summary = voxels.groupBy("total", "sources", "direct").agg(F.count(F.lit(1)).alias("n"))
    kept = (F.col("total") >= F.col("threshold") * 255) & (F.col("sources") >= F.col("min_sources")) & (F.col("direct") >= F.col("min_direct"))
    return (
        summary.join(F.broadcast(policies))
        .groupBy("name")
        .agg(F.sum("n").alias("candidates"), F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("retained"))
    )


def island_weights(largest: DataFrame, low: float = 0.75, high: float = 1.25) -> DataFrame:
    """(grp, role, weight) from (grp, role, largest): log sizes against the quartiles of their role."""
    logs = largest.withColumn("v", F.log1p("largest"))
    quartiles = logs.groupBy("role").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    spread = F.col("q")[2] - F.col("q")[0]
    weight = F.when(spread <= 1e-12, 1.0).otherwise(
        F.least(F.greatest(1 + 0.25 * (F.col("v") - F.col("q")[1]) / spread, F.lit(low)), F.lit(high))
    )
    return logs.join(F.broadcast(quartiles), "role").select("grp", "role", weight.alias("weight"))
