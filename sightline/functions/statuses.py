"""Visibility statuses: the ladder that decides them, what counts as visible, and confidence tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses from the strongest to the weakest rung, and sets of them.
COARSE_STATUSES = (
    "in_motion", "unobservable_no_data", "out_of_view", "occluded_inside_closed_fixture", "potentially_visible_inside_open_fixture", "geometrically_occluded", "in_view",
)
REFINED_ONLY = ("observed_visible_in_open_fixture", "observed_not_visible_in_open_fixture", "assumed_not_visible_in_open_fixture")
STATUSES = (*COARSE_STATUSES, *REFINED_ONLY)
#: The reasons that are given for the coarse ones.
REASONS = {
    "in_motion": "object in motion", "unobservable_no_data": "no stable track or mask available", "out_of_view": "projection outside image", "occluded_inside_closed_fixture": "inside a closed fixture",
    "potentially_visible_inside_open_fixture": "inside an open fixture", "geometrically_occluded": "line of sight blocked by scene geometry", "in_view": "in view, not inside a fixture",
}
#: What the pipeline claims of an object's visibility, by status; the others make no claim.
CLAIMS = {
    "in_view": True, "observed_visible_in_open_fixture": True, "occluded_inside_closed_fixture": False, "observed_not_visible_in_open_fixture": False,
    "assumed_not_visible_in_open_fixture": False, "geometrically_occluded": False,
}
VISIBLE = ("in_view", "observed_visible_in_open_fixture", "in_motion")
STABLE = ("in_view", "observed_visible_in_open_fixture")
#: Confidence tiers from the lowest on; what is assumed closed counts as the highest.
CONFIDENCES = ("very_low", "low", "medium", "high", "very_high")
ASSUMED_CLOSED_RANK = 4
#: Names that older files use.
ALIASES = {"visible": "in_view", "ok": "in_view", "moving": "in_motion", "hidden": "out_of_view", "occluded": "geometrically_occluded"}
#: Priorities by which the strongest of overlapping spans is chosen.
PRIORITY = {
    "occluded_inside_closed_fixture": 70, "geometrically_occluded": 60, "observed_not_visible_in_open_fixture": 50, "out_of_view": 40,
    "in_motion": 30, "observed_visible_in_open_fixture": 20, "in_view": 10,
}


def confidence_rank(tier: Column) -> Column:
    """0 for the lowest tier and so on; -1 for an unknown or null one."""
    out = F.when(tier == "assumed_closed", ASSUMED_CLOSED_RANK)
    for i, name in enumerate(CONFIDENCES):
        out = out.when(tier == name, i)
    return out.otherwise(-1)


def status_ladder(in_motion: Column, has_data: Column, in_view: Column, fixture_state: Column, confidence: Column, occluded: Column, least: str = "medium") -> Column:
    """(status, reason, confidence): the first rung that holds.

    Motion, then no data, then out of view, then inside a closed fixture of at least the given confidence, then inside an open one,
    then occluded, then in view. A closed fixture of less confidence counts as none.
    """
    sure = F.coalesce(confidence_rank(confidence) >= CONFIDENCES.index(least), F.lit(False))
    held = lambda c: F.coalesce(c, F.lit(False))
    rung = lambda status, tier=None: F.struct(
        F.lit(status).alias("status"), F.lit(REASONS[status]).alias("reason"), (F.lit(tier).cast("string") if tier is None else tier).alias("confidence")
    )
    return (
        F.when(held(in_motion), rung("in_motion"))
        .when(~held(has_data), rung("unobservable_no_data"))
        .when(~held(in_view), rung("out_of_view"))
        .when(held(fixture_state == "closed") & sure, rung("occluded_inside_closed_fixture", confidence))
        .when(held(fixture_state == "open"), rung("potentially_visible_inside_open_fixture", confidence))
        .when(held(occluded), rung("geometrically_occluded"))
        .otherwise(rung("in_view"))
    )


def fallback_status(status: Column, raw_status: Column, in_view: Column) -> Column:
    """A span's status, else one from the sample: in motion, out of view, or the raw status as it is, which isn't among the visible ones."""
    return F.coalesce(status, F.when(raw_status == "in_motion", "in_motion").when(~F.coalesce(in_view, F.lit(False)), "out_of_view").otherwise(raw_status))


def is_visible(status: Column) -> Column:
    return F.coalesce(status.isin(*VISIBLE), F.lit(False))


def is_stable(status: Column) -> Column:
    return F.coalesce(status.isin(*STABLE), F.lit(False))


def live_visible(flag: Column, raw_status: Column, in_view: Column) -> Column:
    """A precomputed flag; where there is none: in motion, or ok and in view."""
    return F.coalesce(flag, (raw_status == "in_motion") | ((raw_status == "ok") & F.coalesce(in_view, F.lit(False))), F.lit(False))


def usable_sample(visible: Column, stable: Column, pixel: Column) -> Column:
    return F.coalesce(visible & stable & pixel.isNotNull(), F.lit(False))


def queryable(status: Column) -> Column:
    """Whether a status, under its present name, is a stable one."""
    now = status
    for old, new in ALIASES.items():
        now = F.when(status == old, new).otherwise(now)
    return is_stable(now)


def priority(status: Column) -> Column:
    out = F.lit(0)
    for name, p in PRIORITY.items():
        out = F.when(status == name, p).otherwise(out)
    return out


def covers_hidden_window(start: Column, end: Column, query: Column, h: float, video_end: Column, step: float) -> Column:
    """A hidden span covers [query - h, query + h], cut to the video, with half a step to spare."""
    eps = step / 2
    return (start <= F.greatest(F.lit(0.0), query - h) + eps) & (end >= F.least(video_end, query + h) - eps)


def claim(status: Column) -> Column:
    """What the status claims of the object's visibility: true, false, or null for none."""
    out = F.lit(None).cast("boolean")
    for name, visible in CLAIMS.items():
        out = F.when(status == name, visible).otherwise(out)
    return out
