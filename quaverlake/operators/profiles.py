"""Scoring settings: profiles, what overrides them, and the score with all of its terms."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vectors
from .scoring import BPM_SCALE, LOUD_SCALE, YEAR_SCALE, fused

#: The weights, the fusion and the space of each profile, and the weights that a request may move.
PROFILES = {
    "v2": {"clap": 1.0, "lib": 0.4, "genre": 0.3, "bpm": 0.3, "era": 0.1, "key": 0.0, "earfeel": 0.0, "loud": 0.0},
    "sound": {"clap": 1.0, "lib": 0.0, "genre": 0.2, "bpm": 0.0, "era": 1.5, "key": 0.0, "earfeel": 0.25, "artist": 0.12, "loud": 0.0},
    "musicip": {"clap": 1.0, "lib": 0.0, "genre": 0.0, "bpm": 0.0, "era": 0.0, "key": 0.0, "earfeel": 0.0, "artist": 0.0, "loud": 0.0},
}
SPACES = {"v2": ("raw", "raw"), "sound": ("z", "head"), "musicip": ("z", "head")}
FUSIONS = ("raw", "z", "rank")
SLIDERS = ("clap", "lib", "genre", "bpm", "era", "loud")
MOST_WEIGHT = 5.0


@dataclass(frozen=True)
class Settings:
    profile: str
    weights: Mapping[str, float]
    fusion: str = "raw"
    space: str = "raw"
    family_credit: float = 0.0

    @property
    def active(self) -> dict[str, float]:
        return {t: w for t, w in self.weights.items() if w}


def settings(profile: str | None = None, trained: bool = False, has_head: bool = False, saved: Mapping | None = None, weights: Mapping[str, float] | None = None, fusion: str | None = None, space: str | None = None, family_credit: float | None = None) -> Settings:
    """The profile asked for, or that of the library; then a saved file of the same profile, then the caller's own values.

    A library whose fingerprints are of the trained kind, with a head, has "sound".
    "musicip" is only ever asked for, and needs both.  What a saved file has of unknown
    values is passed over; the caller's are errors.
    """
    if profile is not None and profile not in PROFILES:
        raise ValueError(f"profile must be one of {tuple(PROFILES)}, not {profile!r}")
    if profile == "musicip" and not (trained and has_head):
        raise ValueError("profile 'musicip' needs fingerprints of the trained kind and its head")
    profile = profile or ("sound" if trained and has_head else "v2")
    values, (how, where), credit = dict(PROFILES["v2"]) | PROFILES[profile], SPACES[profile], 0.0
    saved = saved if saved and saved.get("profile", "v2") == profile else {}
    values |= saved.get("best_weights", {})
    switches = saved.get("scoring", {})
    how = switches["fusion"] if switches.get("fusion") in FUSIONS else how
    where = switches.get("clap_space", where)
    given = switches.get("family_credit")
    if isinstance(given, (int, float)) and not isinstance(given, bool) and 0 <= given <= 1:
        credit = float(given)
    values |= weights or {}
    how, where, credit = fusion or how, space or where, credit if family_credit is None else float(family_credit)
    if how not in FUSIONS or not 0 <= credit <= 1:
        raise ValueError("fusion must be raw, z or rank, and family_credit between 0 and 1")
    return Settings(profile, values, how, where, credit)


def overridden(base: Settings, params: Mapping[str, str]) -> Settings:
    """A request's weights, from 0 to 5; what is no number is passed over."""
    moved = {}
    for name in SLIDERS:
        try:
            moved[name] = max(0.0, min(float(params[name]), MOST_WEIGHT))
        except (KeyError, TypeError, ValueError):
            continue
    return replace(base, weights=dict(base.weights) | moved)


def genre_closeness(a: Column, b: Column, families_a: Column | None = None, families_b: Column | None = None, credit: float = 0.0) -> Column:
    """Shared tags over all tags, and of what that leaves ``credit`` where the tags share a family; 0 without tags."""
    shared = F.coalesce(text.jaccard(a, b), F.lit(0.0))
    if not credit or families_a is None or families_b is None:
        return shared
    family = F.coalesce(F.arrays_overlap(families_a, families_b), F.lit(False))
    return shared + F.when(family, credit * (1 - shared)).otherwise(0.0)


def artist_affinity(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` with ``artist_term``: 1 for the seed's own artist, else the strongest edge (``a``, ``b``, ``score``) between the two, 0 without one.

    Null where the seed has no artist id, which leaves the term out.
    """
    both = edges.select("a", "b", "score").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    best = both.groupBy(F.col("a").alias("seed_artist_id"), F.col("b").alias("artist_id")).agg(F.max("score").alias("__edge"))
    met = pairs.join(best, ["seed_artist_id", "artist_id"], "left")
    same = F.coalesce(F.col("seed_artist_id") == F.col("artist_id"), F.lit(False))
    term = F.when(F.col("seed_artist_id").isNotNull(), F.when(same, 1.0).otherwise(F.coalesce("__edge", F.lit(0.0))))
    return met.withColumn("artist_term", term).drop("__edge")


def loudness_gap(a: Column, b: Column) -> Column:
    """Loudness is negative, so only null means unknown here."""
    return F.when(a.isNull() | b.isNull(), 0.5).otherwise(F.abs(a - b) / LOUD_SCALE)


def all_terms(pairs: DataFrame, s: Settings) -> DataFrame:
    """The active terms of (seed_*, *) pairs, bigger is better in each; a term that the seed gives no value for is null."""
    side = lambda c: (F.col(f"seed_{c}"), F.col(c))
    key = text.key_compatibility(*[x for c in ("seed_key", "key") for x in (F.col(f"{c}.tonic"), F.col(f"{c}.major"))])
    families = side("families") if "families" in pairs.columns else (None, None)
    terms = {
        "clap": lambda: vectors.dot(*side("vector")),
        "lib": lambda: vectors.dot(*side("descriptor")),
        "genre": lambda: genre_closeness(*side("tags"), *families, s.family_credit),
        "bpm": lambda: -text.gap(*side("bpm"), BPM_SCALE),
        "key": lambda: F.when(F.col("seed_key").isNotNull(), key),
        "era": lambda: -text.gap(*side("year"), YEAR_SCALE),
        "artist": lambda: F.col("artist_term"),
        "loud": lambda: -loudness_gap(*side("lufs")),
        "earfeel": lambda: -F.col("sensation_gap"),
    }
    return pairs.select("seed_id", "id", *[F.round(terms[t](), 9).alias(t) for t in s.active])


def score(pairs: DataFrame, s: Settings) -> DataFrame:
    """``seed_id``, ``id``, the contribution of each active term (``c_*``) and ``score``; an absent term contributes 0."""
    out = fused(all_terms(pairs, s), s.fusion, s.active)
    parts = [F.coalesce(f"c_{t}", F.lit(0.0)).alias(f"c_{t}") for t in s.active]
    return out.select("seed_id", "id", *parts).withColumn("score", sum((F.col(f"c_{t}") for t in s.active), F.lit(0.0)))


def imputed_loudness(rows: DataFrame, least: int = 10) -> DataFrame:
    """``rows`` (``lufs``, ``rms``) with ``loudness``: as measured, else by a straight line over 20 log10 rms, fitted where both are known; null where neither is, or pairs are fewer than ``least``."""
    level = F.when(F.col("rms") > 0, 20 * F.log10("rms"))
    measured = rows.withColumn("__db", level)
    fit = measured.where("lufs IS NOT NULL AND __db IS NOT NULL").agg(F.regr_slope("lufs", "__db").alias("__a"), F.regr_intercept("lufs", "__db").alias("__b"), F.count(F.lit(1)).alias("__n"))
    guess = F.when(F.col("__n") >= least, F.col("__a") * F.col("__db") + F.col("__b"))
    return measured.crossJoin(F.broadcast(fit)).withColumn("loudness", F.coalesce("lufs", guess)).drop("__db", "__a", "__b", "__n")
