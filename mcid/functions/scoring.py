"""The five factors of an identity score, and the decision made from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    reid: float = 0.55
    temporal: float = 0.20
    camera: float = 0.15
    quality: float = 0.05
    zone: float = 0.05

    def normalized(self) -> "Weights":
        parts = (self.reid, self.temporal, self.camera, self.quality, self.zone)
        total = sum(parts)
        return self if total <= 0 else Weights(*(p / total for p in parts))


@dataclass(frozen=True)
class Policy:
    """Thresholds of the decision; defaults are the reference's."""

    auto_match: float = 0.82
    candidate: float = 0.72
    margin: float = 0.05
    override: float | None = 0.95
    stage3_auto_match: float = 0.92
    new_id_when_ambiguous: bool = True
    window_seconds: int = 86_400
    sigma_seconds: float = 60.0
    use_topology: bool = True
    use_zones: bool = True
    stage3: bool = True

    def weakest_useful_cosine(self, weights: Weights) -> float:
        """No hit below this cosine can change a decision.

        A leading hit passes the candidate threshold only with at least
        ``(candidate - all other factors at 1) / reid`` of cosine (or the override),
        and a second hit matters only within ``margin`` of such a leader.
        """
        w = weights.normalized()
        if w.reid <= 0:
            return -1.0
        others = w.temporal + w.camera + w.quality + w.zone
        leader = (self.candidate - others) / w.reid
        if self.override is not None:
            leader = min(leader, self.override)
        return leader - self.margin


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def temporal(dt_seconds: Column, sigma: float = 60.0) -> Column:
    if sigma <= 0:
        return F.lit(0.0)
    return F.exp(-(dt_seconds * dt_seconds) / (2.0 * sigma * sigma))


def topology(link_enabled: Column) -> Column:
    """1 over an enabled link, 0 over a disabled one, 0.5 when there is none."""
    return F.when(link_enabled.isNull(), 0.5).when(link_enabled, 1.0).otherwise(0.0)


def quality(value: Column) -> Column:
    return F.when(value.isNull(), F.lit(0.5)).otherwise(_unit(value))


def zone(previous: Column, current: Column) -> Column:
    return F.when(previous == current, F.lit(1.0)).otherwise(F.lit(0.5))


def final_score(
    cosine: Column, t: Column, cam: Column, q: Column, z: Column, weights: Weights = Weights()
) -> Column:
    w = weights.normalized()
    return _unit(cosine * w.reid + t * w.temporal + cam * w.camera + q * w.quality + z * w.zone)


def breakdown(
    cosine: Column,
    dt_seconds: Column,
    link_enabled: Column,
    quality_value: Column,
    previous_zone: Column,
    current_zone: Column,
    weights: Weights = Weights(),
    sigma: float = 60.0,
) -> dict[str, Column]:
    """All factors and their blend, keyed as the audit row names them."""
    t, cam = temporal(dt_seconds, sigma), topology(link_enabled)
    q, z = quality(quality_value), zone(previous_zone, current_zone)
    return {
        "reid_similarity": cosine,
        "temporal_score": t,
        "camera_topology_score": cam,
        "quality_score": q,
        "zone_score": z,
        "final_score": final_score(cosine, t, cam, q, z, weights),
    }


def margin(top1: Column, top2: Column) -> Column:
    return F.when(top1.isNull(), 0.0).when(top2.isNull(), 1.0).otherwise(top1 - top2)


def decide(
    top1: Column,
    top2: Column,
    link_enabled: Column,
    final: Column,
    policy: Policy = Policy(),
    auto_match: Column | float | None = None,
) -> Column:
    """match / new / candidate / ambiguous / held, by the first rule that holds."""
    m = margin(top1, top2) > policy.margin
    auto = auto_match if isinstance(auto_match, Column) else F.lit(policy.auto_match if auto_match is None else auto_match)
    rule = F.when(top1.isNull(), "new").when(link_enabled == F.lit(False), "new")
    if policy.override is not None:
        rule = rule.when((top1 >= policy.override) & m, "match")
    return (
        rule.when((final >= auto) & m, "match")
        .when((final >= policy.candidate) & m, "candidate")
        .when(final >= policy.candidate, "ambiguous" if policy.new_id_when_ambiguous else "held")
        .otherwise("new")
    )


def confidence_state(decision: Column) -> Column:
    return (
        F.when(decision.isin("match", "new"), "firm")
        .when(decision == "ambiguous", "ambiguous")
        .otherwise("held")
    )


def stage_label(linked: Column, seen: Column, stage3: bool = True) -> Column:
    """Name of the search stage from the counts of linked and recently seen cameras."""
    if not stage3:
        return F.when(linked == 0, "stage1_same_cam_only").otherwise("stage2_linked_cams")
    return (
        F.when(linked == 0, "stage3_24h_fallback")
        .when(seen > 0, "stage2_3_combined")
        .otherwise("stage2_linked_cams")
    )


def stage_threshold(stage: Column, policy: Policy = Policy()) -> Column:
    return F.when(stage.startswith("stage3"), policy.stage3_auto_match).otherwise(policy.auto_match)


def reason_text(stage: Column, decision: Column, parts: dict[str, Column]) -> Column:
    return F.format_string(
        "stage=%s decision=%s reid=%.3f topo=%.2f temporal=%.3f quality=%.3f zone=%.3f final=%.3f",
        stage,
        decision,
        parts["reid_similarity"],
        parts["camera_topology_score"],
        parts["temporal_score"],
        parts["quality_score"],
        parts["zone_score"],
        parts["final_score"],
    )


def mint_global_id(tracklet_id: Column, camera_id: Column) -> Column:
    """``GID-<8 hex>-<camera suffix>``, the same on every retry of the same row."""
    suffix = F.element_at(F.split(camera_id, "_"), -1)
    return F.concat(F.lit("GID-"), F.upper(F.substring(F.sha2(tracklet_id, 256), 1, 8)), F.lit("-"), suffix)
