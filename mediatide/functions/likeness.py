"""How alike a wanted song and a track are, as column expressions (doubles between 0 and 1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_title, lower, primary_artist, strip

# fixed values: weights, bonuses and thresholds
TITLE_WEIGHT, ARTIST_WEIGHT, LOSSLESS_BONUS, RATE_BONUS = 0.55, 0.40, 0.05, 0.03
BONUS_KINDS = ("flac", "ape", "wav", "alac", "dsf", "dff")
GOOD, ENOUGH = 0.85, 0.65


def _near(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.levenshtein(a, b) / longest))


def title_form(title: Column) -> Column:
    """What a title is compared by: its lower-case and its cleaned form. Worth keeping where a title meets many."""
    low = lower(strip(title))
    return F.struct(low.alias("low"), F.lower(clean_title(low)).alias("clean"))


def artist_form(artist: Column) -> Column:
    """What a wanted artist is compared by: the whole field and its first artist, in lower case."""
    low = lower(strip(artist))
    return F.struct(low.alias("low"), F.lower(primary_artist(low)).alias("first"))


def names_form(names: Column) -> Column:
    """What a track's artists are compared by: each name and all in one text, in lower case."""
    low = F.transform(names, lambda n: lower(strip(n)))
    return F.struct(low.alias("each"), F.array_join(low, " ").alias("all"))


def title_likeness(a: Column, b: Column) -> Column:
    """Of two title forms."""
    la, lb, ca, cb = a["low"], b["low"], a["clean"], b["clean"]
    shared = la.contains(lb) | lb.contains(la) | ((ca != "") & (ca.contains(cb) | cb.contains(ca)))
    longest = F.greatest(F.length(la), F.length(lb))
    part = F.lit(0.80) + F.lit(0.15) * F.least(F.length(la), F.length(lb)) / longest
    return F.when(la == lb, F.lit(1.0)).when((ca == cb) & (ca != ""), F.lit(0.95)).when(shared & (longest > 0), part).otherwise(_near(la, lb))


def artist_likeness(q: Column, names: Column) -> Column:
    """Of an artist form and a names form; an artist not asked for is neutral."""
    low, first, all_ = q["low"], q["first"], names["all"]
    best = F.aggregate(F.filter(names["each"], lambda n: n != ""), F.lit(0.0), lambda m, n: F.greatest(m, F.lit(1.0) - F.levenshtein(first, n) / F.greatest(F.length(first), F.length(n))))
    return (
        F.when(low == "", F.lit(0.7))
        .when(all_.contains(low) | low.contains(all_), F.lit(1.0))
        .when((first != "") & (all_.contains(first) | first.contains(all_)), F.lit(0.92))
        .otherwise(best)
    )


def title_score(wanted: Column, found: Column) -> Column:
    return title_likeness(title_form(wanted), title_form(found))


def artist_score(wanted: Column, names: Column) -> Column:
    """``names`` is the array of the track's artists."""
    return artist_likeness(artist_form(wanted), names_form(names))


def quality_bonus(kind: Column, bitrate: Column) -> Column:
    return F.when(F.coalesce(F.lower(kind).isin(*BONUS_KINDS), F.lit(False)), F.lit(LOSSLESS_BONUS)).when((bitrate >= 320000) | (bitrate == 320), F.lit(RATE_BONUS)).otherwise(F.lit(0.0))


def total_score(title: Column, artist: Column, bonus: Column) -> Column:
    return F.least(F.lit(1.0), title * F.lit(TITLE_WEIGHT) + artist * F.lit(ARTIST_WEIGHT) + bonus)


def candidate_score(song: Column, artist: Column, title: Column, names: Column, kind: Column, bitrate: Column) -> Column:
    """Weighted likeness with a small preference for quality, 1 at most."""
    return total_score(title_score(song, title), artist_score(artist, names), quality_bonus(kind, bitrate))
