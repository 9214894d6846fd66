from mediatide.llm.catalogmatch import match_titles

CATALOG = [(1, "Silver River Waltz", "The Silver Tunnels"), (2, "Silver River Waltz", "Anthony Kesadine"), (3, "Gió vắng 8", "Jürgen Calhurst"), (4, "麦田电台", "南窗旅人"), (5, "Тихий берег", "Елена Белозвон"), (6, "The Copper Kettle, Pt. 2", "Copper & Sons"), (7, "No More Windows", "Theodore Branaxton"), (8, "새벽 바다", "은하역 클럽"), (9, "Under Paper Harbors", "Rook, Pawn and the Bishops"), (10, "Under Salted Willows", "Rauorfel Chamber Ensemble")]


def test_titles(spark):
    cases = [
        ("silver  river waltz (Live)", "The Silver Tunnels", 1), ("Silver River Waltz", "Tony Kesadine", 2), ("Silvre River Waltz", "Kesadine, Anthony", 2), ("03 - Sіlver River Waltz [Hi-Res]", "A. Kesadine", 2), ("Silver River Waltz", "Nobody Else", 0), ("Silver River Waltz", None, 1), ("Silver River Waltz", "", 1),
        ("Gió vắng 8", "Calhurst, Jurgen", 3), ("Gió vắng 3", "Jürgen Calhurst", 0), ("Gio vang 8 flac", "Jürgen Calhurst; X Y", 3), ("「麦田电台」", "Nan Chuang Lüren", 4), ("麥田電臺", "南床旅人", 4), ("麦田旅馆", "南窗旅人", 0), ("Ｔｈｅ　Copper Kettle Part 2", '"Copper & Sons"|X', 6), ("Copper Kettle, Pt. 2", "Copper and Sons", 6),
        ("Елена Белозвон - Тихий берег", "Elena Belozvon", 5), ("Тихий бере", "Лена Белозвон", 5), ("No More Willows", "Theodore Branaxton", 0), ("새벽 바다 - Live", "Eunhayeok-Club", 8), ("Under_Paper_Harbors_320k", "Rook, Pawn and the Bishops / A B", 9), ("🔥🔥", "X", 0), ("x" * 30_000, "X", 0),
    ]
    rows = [("s", str(k), t, a, 5) for k, (t, a, _) in enumerate(cases)] + [("s", "null", None, "x", 5), ("s", "empty", "", "x", 5)]
    typed = spark.createDataFrame(rows, "src string, row_key string, title string, artist string, catalog_id int")
    catalog = spark.createDataFrame(CATALOG, "catalog_id bigint, title string, artist string")
    got = {r.row_key: r.catalog_id for r in match_titles(spark, typed, catalog).collect()}
    assert {k: got[str(k)] for k in range(len(cases))} == {k: c for k, (_, _, c) in enumerate(cases)}
    assert len(got) == len(cases)
    assert match_titles(spark, typed.limit(0), catalog).count() == 0
    assert {r.catalog_id for r in match_titles(spark, typed, catalog.limit(0)).collect()} == {0}
