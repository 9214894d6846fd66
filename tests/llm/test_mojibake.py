import random

import pytest

from mediatide.llm.mojibake import CHAINS, canonical_texts, damaged_fields, garble, judge, restore, train

WORDS = {
    "es": "Corazón Niña Estación Balcón Melodía Sueño Jardín Canción Último Música Limón Otoño Después Según".split(), "de": "Mädchen Brücke Straße Träume Süden März Äpfel Später Füße Grüne Kühle Wölfe".split(),
    "fr": "Légère Fenêtre Forêt Été Problème Théâtre Février Déjà Passé Drôle Rêve Côté".split(), "ru": "Снежный Далёкий Тихий Последний Ночной Бумажный вокзал почтальон корабль берег сигнал фонарь".split(),
    "zh": "麦田 旧站台 雨巷 风筝 孤灯 微光 铁轨 潮汐 凌晨 长街 电台 书店 旅馆 回声 练习 日记".split(), "ja": "ガラスの ポケットの 夜明けの 遠い 灯台 窓辺 カモメ ダンス シグナル 自転車".split(), "ko": "푸른 조용한 마지막 새벽 하얀 골목 우산 노래 편지 기차".split(),
}


def titles(seed, n):
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        lang = rnd.choice(sorted(WORDS))
        out.add(("" if lang in ("zh", "ja") else " ").join(rnd.sample(WORDS[lang], 2)))
    return sorted(out)


@pytest.fixture(scope="module")
def model():
    return train(titles(1, 500) + ["The Silver Tunnels", "River for Two"])


def test_round_trip():
    for chain in CHAINS:
        for text in titles(2, 40):
            bad = garble(text, chain)
            back = bad and restore(bad, chain)
            assert back in (None, text) or bad == text or "cp" in chain or "1252" in chain or "euc" in chain or "shift" in chain or "big5" in chain or "gb" in chain or "mac" in chain


def test_held_out(model):
    rnd = random.Random(9)
    hits = total = right = 0
    for text in titles(7, 300):
        if text.isascii():
            continue
        assert judge([text, text + " (Live)"], model) == [None, None]
        chain = rnd.choice([c for c in ("utf-8 as latin-1", "utf-8 as web-1252", "gbk as latin-1", "utf-8 as cp1251", "utf-8 as gb18030", "utf-8 twice as web-1252", "cp1251 as latin-1") if (b := garble(text, c)) and b != text and restore(b, c) == text] or [None])
        if not chain:
            continue
        total += 1
        found = judge([garble(text, chain)], model)[0]
        hits += found is not None
        right += bool(found and found.restored == text)
    assert hits >= 0.97 * total
    assert right >= 0.93 * total


def test_parts_and_losses(model):
    bad = garble("Corazón", "utf-8 as latin-1")
    got = judge([f"The Silver Tunnels; {bad}", "Coraz�n", "", "River for Two", bad + "【现场】"], model)
    assert got[0].restored == "The Silver Tunnels; Corazón"
    assert (got[1].chain, got[1].restored) == ("bytes lost", None)
    assert got[2] is got[3] is None
    assert got[4].restored == "Corazón【现场】"


def test_frames(spark, model):
    bad = garble("Далёкий берег", "utf-8 as latin-1")
    rows = [(1, bad, None, "x"), (1, bad, None, "x"), (2, "River for Two", bad, "x"), (3, None, "", "x"), (4, "麦田" * 20_000, "ok", "x")]
    df = spark.createDataFrame(rows, "id bigint, title string, album string, chain string")
    shared = spark.sparkContext.broadcast(model)
    got = sorted((r.row_id, r.field, r.restored) for r in damaged_fields(df, "s", "id", ["title", "album"], shared).collect())
    assert got == [(1, "title", "Далёкий берег"), (1, "title", "Далёкий берег"), (2, "album", "Далёкий берег")]
    assert damaged_fields(df.limit(0), "s", "id", ["title", "album"], shared).count() == 0
    assert canonical_texts([(df, "title")])
