import random

import pytest

from mediatide.llm import spellings as S
from mediatide.llm.spellings import alike, distinct_names, entities, givens_of, lcs_ratio, likely_links, likeness, linked_pairs, read_name, without_one
from mediatide.operators.multivalue import Grammar

NAMES = ["Anthony Kesadine", "Anthony Crowvane", "André Garadine", "André Linulier", "Елена Белозвон", "Елена Остравец", "Francisco Ostolt", "Francisco Torlundal", "The Wandering Lanterns", "Garskall String Quartet", "南窗旅人", "ユウナギ工房", "은하역 클럽", "Copper & Sons", "Juquilvia", "Luquilvia", "Theodore Branaxton", "Theodore Orvvane"]
SAME = [
    ("Anthony Kesadine", "Tony Kesadine", "A. Kesadine", "KESADINE, Anthony", "Anthony J. Kesadine", "AnthonyKesadine", "Anthony Kesdaine"), ("The Wandering Lanterns", "Wandering Lanterns, The", "wandering lanterns (band)", "The Wandering Lantrens", "Tha Wandering Lanterns"),
    ("Garskall String Quartet", "Garskall SQ", "Garskall Str. Qt.", "String Quartet of Garskall", "String Quartet, Garskall", "Garskall String Quartte"), ("南窗旅人", "南床旅人", "南窗 旅人", "南窗旅人(Nan Chuang Lüren)", "nan chuang lüren", "NanChuangLüren"),
    ("ユウナギ工房", "ユウナギ・工房", "Yuunagi-Koubou"), ("은하역 클럽", "Eunhayeok Club"), ("Елена Белозвон", "Elena Belozvon", "Лена Белозвон", "Е. Белозвон"), ("Copper & Sons", "Copper and Sons"),
    ("André Garadine", "Andre Garadine", "Garadine A"), ("André Linulier", "ANDRÉ LINULIER"), ("Juquilvia", "J U Q U I L V I A"), ("Luquilvia", "Luquilviaa"),
]


def test_entities(spark):
    rows = [(7, n, k + 1) for group in SAME for k, n in enumerate(reversed(group))] + [(8, "Anthony Kesadine", 3), (8, "Anthony Crowvane", 3)]
    rows += [(7, "Anthony Kesadine; André Garadine", 1), (7, None, 1), (7, "", 1), (7, "未知歌手", 1), (None, "x y", 1), (7, "!!!", 1), (7, "Ab" * 20_000, 1)]
    df = spark.createDataFrame([(lib, n, "clash") for lib, n, k in rows for _ in range(k)], "library_id bigint, artist string, name string")
    names = distinct_names([(df, "library_id", "artist"), (df.limit(0), "library_id", "artist")])
    got = entities(names, Grammar.of(NAMES), NAMES)
    by = {(r.scope, r.name): r.entity for r in got.collect()}
    for group in SAME:
        assert len({by[7, n] for n in group}) == 1, group
    assert len({by[7, g[0]] for g in SAME}) == len(SAME)
    assert by[8, "Anthony Kesadine"] != by[8, "Anthony Crowvane"]
    assert (7, "Anthony Kesadine; André Garadine") not in by
    pairs = {(r.library_id, r.name_a, r.name_b) for r in linked_pairs(got, "library_id").collect()}
    assert pairs == {(7, a, b) for g in SAME for a in g for b in g if a.encode() < b.encode()}
    assert entities(names.limit(0), Grammar.of(NAMES), NAMES).count() == 0


@pytest.mark.parametrize(("a", "b", "same"), [("abc", "abc", True), ("abcd", "acbd", True), ("abc", "ab", True), ("abcd", "abxd", True), ("abcd", "badc", False), ("abc", "xyz", False), ("", "abcd", False), ("abcdef", "abc", False)])
def test_alike(a, b, same):
    assert bool(alike(a, b)) is same


def test_alike_parts_share_what_is_left():
    rnd = random.Random(5)
    for _ in range(3000):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))
        b = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))
        for errors in (1, 2):
            if alike(a, b, errors):
                assert set(without_one(a, errors)) & set(without_one(b, errors)), (a, b)
    for n in (63, 64, 65, 66):
        assert set(without_one("ab" * n)[:]) & set(without_one("ab" * n + "c"))
        assert set(without_one("a" * n + "b")) & set(without_one("a" * n + "cb"))


def test_lcs_against_plain():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        want = 2 * t[-1][-1] / (len(a) + len(b)) if a and b else 0.0
        assert lcs_ratio(a, b) == pytest.approx(want)


def test_established_names_stay_apart():
    g = givens_of(NAMES)
    a, b = read_name("Juquilvia", g), read_name("Luquilvia", g)
    assert likeness(a, b, settled=True) == 0
    assert likeness(a, b, settled=False) > 0


def test_slip_of_a_catalogued_name_in_many_libraries(spark):
    rows = [(lib, n, 2 - k % 2) for lib in range(6) for k, n in enumerate(["Luwynx", "Luwynxx", "Juquilvia", "Luquilvia"])]
    names = spark.createDataFrame(rows, "scope bigint, name string, weight bigint")
    canonical = [*NAMES, "Luwynx"]
    pairs = {tuple(r) for r in linked_pairs(entities(names, Grammar.of(canonical), canonical), "library_id").collect()}
    assert pairs == {(lib, "Luwynx", "Luwynxx") for lib in range(6)}


def _links_of(spark, forms, known=frozenset()):
    df = spark.createDataFrame([(1, f, g, r, w) for f, g, r, w in forms], "scope bigint, form string, given string, rest string, weight bigint")
    return {frozenset((r.form, r.to)) for r in likely_links(df, set(known)).collect()}


@pytest.mark.parametrize("people", [True, False])
def test_crowded_block_is_compared_completely(spark, people):
    """500 forms of one suffix, with one initial of the other part: every pair that brute force finds is found."""
    rnd = random.Random(3)
    forms = {}
    while len(forms) < 500:
        middle = "".join(rnd.choice("abcd") for _ in range(3))
        if people:
            given, rest = rnd.choice(["anna", "anne", "a", "arno", "ann|annabel"]), rnd.choice(["k", "ks", "sk"]) + middle + "strandberg"
            forms[f"{given} {rest}"] = (f"{given} {rest}", given, rest, rnd.randint(1, 4))
        else:
            form = middle + rnd.choice("abcd") + rnd.choice("abcd") + "strandbergquartet"
            forms[form] = (form, "", form, rnd.randint(1, 4))
    forms = list(forms.values())
    brute = {frozenset((a[0], b[0])) for k, a in enumerate(forms) for b in forms[:k] if likeness(a[:3], b[:3], False)}
    assert len(brute) > 500
    assert _links_of(spark, forms) == brute


def test_common_suffix_of_a_hot_library(spark, monkeypatch):
    """The refined blocks find what the plain ones do."""
    rnd = random.Random(4)
    names = {rnd.choice(["anton", "berta", "carla", "a", "b"]) + " " + "".join(rnd.choice("ab") for _ in range(4)) + "mann" for _ in range(120)}
    forms = [(n, n.split()[0], n.split()[1], 1) for n in sorted(names)]
    refined = _links_of(spark, forms)
    monkeypatch.setattr(S, "COMMON", 1_000_000)
    assert refined == _links_of(spark, forms)
    assert refined
