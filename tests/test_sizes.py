"""Joins of frames that grow with the input are shuffled: none is gathered in the driver because its files are small."""

import pytest

from mediatide.operators import matching, ordering
from mediatide.plans import registry
from mediatide.session import cut

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def plans(spark, monkeypatch):
    """Gives the first plans of a query and of all that it writes on the way, as Spark makes them of files of 10 MB."""
    written = []

    def seen(df):
        written.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    for module in (matching, ordering):
        monkeypatch.setattr(module, "cut", seen)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10MB", "10485760b")

    def of(name):
        out = registry.queries()[name](spark, SMALL)
        return "\n".join([*written, out._jdf.queryExecution().executedPlan().toString()])

    return of


@pytest.mark.parametrize(("name", "broadcasts"), [("artist_score", 0), ("match_songs", 0), ("library_matched_ids", 1), ("library_unmatched", 1), ("unmatched_list", 1), ("candidate_topk", 0), ("import_report", 0), ("score_candidate", 0), ("title_score", 0), ("library_all_matches", 0)])
def test_nothing_that_grows_is_broadcast(plans, name, broadcasts):
    """What ``ordering.ranked`` hands to every task, one row a partition, is the only broadcast there may be."""
    text = plans(name)
    assert "SortMergeJoin" in text
    assert text.count("BroadcastExchange") == broadcasts


def test_nothing_is_broadcast_once_sizes_are_known(spark):
    """Nor is the plan changed to a broadcast while it runs, when Spark has counted what it shuffled and finds it small."""
    out = registry.queries()["score_candidate"](spark, SMALL)
    assert out.collect()
    text = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "isFinalPlan=true" in text
    assert "SortMergeJoin" in text
    assert "Broadcast" not in text


@pytest.mark.parametrize("name", ["title_score", "score_candidate"])
def test_forms_are_made_before_wishes_meet_tracks(plans, name):
    """Texts are cleaned once a wish and once a track, not once a pair."""
    above, _, below = plans(name).partition("SortMergeJoin")
    assert "regexp_replace" not in above
    assert "regexp_replace" in below


def test_a_wish_is_looked_for_once(spark, monkeypatch):
    """However many songs ask for it; and only the stages that can count are scored."""
    seen = []
    scored = matching._scored
    monkeypatch.setattr(matching, "_scored", lambda found, songs, tracks: seen.append([tuple(r) for r in found.select("song_key", "stage").collect()]) or scored(found, songs, tracks))
    songs = spark.createDataFrame([(k, "Red Shoes (Live)", "Anna") for k in range(1, 41)] + [(41, "Blue", "Anna")], "song_key bigint, song_name string, artist string")
    tracks = spark.createDataFrame([("a", "Red Shoes", ["Anna"], "flac", 0), ("b", "Anna", ["Anna"], "mp3", 0)], "guid string, title string, names array<string>, format string, bitrate int")
    got = {r.song_key: (r.matched, r.track_guid) for r in matching.match_songs(songs, tracks).collect()}
    assert got == {k: (True, "a") for k in range(1, 41)} | {41: (False, "")}
    assert sorted(seen[0]) == [(1, 1), (41, 4)]
