"""Splitting fields, against stated cases and a plain splitter."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mediatide.functions.names import squeeze
from mediatide.operators.multivalue import Grammar, _edit_within, read_grammar, split_fields, split_values

NAMES = ["Rook, Pawn and the Bishops", "Night; Day", "Nor/Wex", "Kettle | Drum", 'The "Low" Tides', "Salt & Cinder", "Feat of Clay", "Vela x Moth", "Plus+Minus Choir", "盐、糖与火柴", "Zoë Ildhurst", "Leonard Pemulier", "Juvesk"]
G = Grammar.of(NAMES)


@pytest.mark.parametrize(
    ("field", "values"),
    [
        (None, []), ("", []), ("  ", []), (";;", []), ("A B; C D", ["A B", "C D"]), (" A B ;C D; ", ["A B", "C D"]), ('"Night; Day";A B', ["Night; Day", "A B"]), ("Night; Day;A B", ["Night; Day", "A B"]),
        ('["A B", "C D", "The \\"Low\\" Tides"]', ["A B", "C D", 'The "Low" Tides']), ('"The ""Low"" Tides", A B', ['The "Low" Tides', "A B"]), ("A B feat. C D ft. E F", ["A B", "C D", "E F"]), ("A B (Feat. C D & E F)", ["A B", "C D", "E F"]),
        ("A B [ft. C D, E F]", ["A B", "C D", "E F"]), ("A B x C D", ["A B", "C D"]), ("A B vs. C D", ["A B", "C D"]), ("A B, C D and E F", ["A B", "C D", "E F"]), ("Anna and Bert", ["Anna and Bert"]), ("A、B，C；D", ["A", "B", "C", "D"]),
        ("A B\\\\C D", ["A B", "C D"]), ("A\tB", ["A", "B"]), ("Pemulier, Leonard", ["Pemulier, Leonard"]), ("Pemuleir, L.", ["Pemuleir, L."]), ("Wandering Lanterns, The", ["Wandering Lanterns, The"]), ("Youth Choir, Orvdran", ["Youth Choir, Orvdran"]),
        ("Xostelka, Luriovia", ["Xostelka", "Luriovia"]), ("nor/wexx", ["nor/wexx"]), ("ROOK, PAWN AND THE BISHOPS", ["ROOK, PAWN AND THE BISHOPS"]), ("The Northern Feathers", ["The Northern Feathers"]), ("X feat. Feat of Clay", ["X", "Feat of Clay"]),
        ("'Nor/Wex' / A B", ["Nor/Wex", "A B"]), ("白塔、盐、糖与火柴", ["白塔", "盐、糖与火柴"]), ('A "odd', ['A "odd']),
    ],
)
def test_fields(field, values):
    assert split_fields(pa.array([field], pa.string()), G).to_pylist() == [values]


@given(st.lists(st.lists(st.text("abç 名", min_size=1, max_size=6).map(str.strip).filter(bool), max_size=5), max_size=8), st.sampled_from([";", "|", "；", "\t", " / "]))
@settings(max_examples=150, deadline=None)
def test_rows_do_not_touch(rows, mark):
    texts = [mark.join(r) for r in rows]
    assert split_fields(pa.array(texts, pa.string()), Grammar()).to_pylist() == [list(r) for r in rows]


def test_sliced_arrays_and_long_texts():
    a = pa.array(["x;y", "a;b", None, ";".join(["n"] * 50_000)], pa.string())
    got = split_fields(a.slice(1), G).to_pylist()
    assert got[0] == ["a", "b"]
    assert got[1] == []
    assert len(got[2]) == 50_000


def test_frames(spark):
    df = spark.createDataFrame([(1, "A;B", "x"), (1, "A;B", "x"), (2, None, "y"), (3, "C", "z"), (None, "D;E", "w")], "id bigint, artist string, pos string")
    got = sorted((r.id or 0, r.pos, r.value) for r in split_values(df, "id", "artist", G, at_least=2).collect())
    assert got == [(0, 1, "D"), (0, 2, "E"), (1, 1, "A"), (1, 1, "A"), (1, 2, "B"), (1, 2, "B")]
    assert split_values(df.limit(0), "id", "artist", G).count() == 0
    assert "Night; Day" in read_grammar(spark.createDataFrame([(n,) for n in [*NAMES, None]], "name string")).protected


def test_near_names_against_all_names():
    """The index of parts finds what a comparison with every protected name finds."""
    rnd = random.Random(9)
    names = ["".join(rnd.choice("abc") for _ in range(rnd.randint(2, 6))) + " & " + "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    g = Grammar.of(names)
    keys = {squeeze(p) for p in g.protected}
    seen = set()
    for _ in range(3000):
        text = "".join(rnd.choice("abc &") for _ in range(rnd.randint(2, 16)))
        key = squeeze(text)
        want = len(key) >= 4 and any(_edit_within(key, k, 1 if len(k) < 8 else 2) for k in keys)
        assert g.near_protected(text) == want, text
        seen.add(want)
    assert seen == {True, False}


def test_many_protected_names_in_one_pass():
    g = Grammar.of([f"Band {k} & Sons" for k in range(5000)] + ["Oak & Elm", "Oak & Elm & Ash"])
    got = split_fields(pa.array(["Band 7 & Sons; Oak & Elm & Ash / X", "Willow & Elm", None, "Band 4999 & sons"]), g).to_pylist()
    assert got == [["Band 7 & Sons", "Oak & Elm & Ash", "X"], ["Willow", "Elm"], [], ["Band 4999 & sons"]]
