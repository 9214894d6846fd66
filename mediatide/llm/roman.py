"""Names of several scripts written in plain Latin letters, in Python and as SQL."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# fixed values: traditional characters and their simplified forms, side by side
TRADITIONAL = "團团廠厂郵邮樂乐隊队組组電电燈灯來来劇剧舊旧雲云霧雾島岛鹽盐遠远紙纸橋桥鳶鸢風风歸归鐵铁聲声書书門门魚鱼無无車车軌轨館馆記记練练習习調调話话與与後后長长鳥鸟鐘钟號号間间時时畫画開开關关國国愛爱夢梦會会見见語语讀读飛飞馬马東东場场現现園园樓楼潑泼濕湿灣湾涼凉漢汉葉叶個个們们從从聽听說说誰谁還还過过邊边裡里麥麦"
# fixed values: readings of characters used in names
PINYIN = {
    c: r
    for r, chars in (row.split(" ") for row in (
        "ta 塔踏她他榻|tuan 团湍|tai 台抬苔太泰|gong 工公弓宫|mu 木暮目幕牧|ren 人仁任|shao 少绍|he 合河何和|chang 唱厂场畅|ou 偶藕呕|chai 差柴拆|xiao 小晓|you 邮由油游|deng 灯登蹬"
        "|dian 电店殿|nian 年念粘|lai 来莱|xin 信芯心新|nan 南男楠|lü 旅吕侣铝|yue 乐月岳阅|dui 队对兑|shan 山杉衫|ju 剧句具聚|qing 青清轻晴|fu 浮福服符|ye 野夜也业叶|shi 石时十实|chen 沉陈尘晨"
        "|bei 北贝背|zu 组祖阻|yan 盐颜言岩|shuang 霜双|chuang 窗床疮|bai 白百柏|du 渡度杜|que 雀确却|hu 湖胡壶|zhou 舟州周洲|guang 光广|hang 航杭行|hen 痕恨很|zhi 纸指止只|jiu 旧就救|xiang 巷像向项"
        "|an 岸按暗|ting 汀厅听|jing 井景警|dao 岛导倒|yuan 远鸢渊园|wu 雾务物误|qiao 桥乔侨|yun 云芸匀|tang 糖堂唐|yu 与雨羽鱼|huo 火伙"
    ).split("|"))
    for c in chars
}
# fixed values: readings of words in names written with kana
KANJI_WORDS = {"倶楽部": "kurabu", "楽団": "gakudan", "工房": "koubou", "商会": "shoukai", "座": "za"}
# fixed values: readings of kana (row by row, in the vowels' order a i u e o; a dot where there is none)
_KANA_ROWS = {"": "アイウエオ", "k": "カキクケコ", "g": "ガギグゲゴ", "s": "サシスセソ", "z": "ザジズゼゾ", "t": "タチツテト", "d": "ダヂヅデド", "n": "ナニヌネノ", "h": "ハヒフヘホ", "b": "バビブベボ", "p": "パピプペポ", "m": "マミムメモ", "y": "ヤ.ユ.ヨ", "r": "ラリルレロ", "w": "ワ...ヲ"}
KANA = {c: r + v for r, row in _KANA_ROWS.items() for c, v in zip(row, "aiueo", strict=True) if c != "."} | {"シ": "shi", "チ": "chi", "ツ": "tsu", "フ": "fu", "ジ": "ji", "ン": "n", "ヲ": "o", "ー": ""}
# fixed values: romanisation of Hangul by initial, vowel and final
HANGUL = (
    "g kk n d tt r m b pp s ss . j jj ch k t p h".replace(".", "").split(" "),
    "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(" "),
    ". k k k n n n t l k m l l l p l m p p t t ng t t k t p t".replace(".", "").split(" "),
)
KOREAN_WORDS = {"클럽": "club", "밴드": "band"}
# fixed values: Cyrillic and Greek letters in Latin ones
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєў", "a b v g d e zh z i y k l m n o p r s t u f kh ts ch sh shch . y . e yu ya e i i e u".replace(".", "").split(" "), strict=True))
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split(" "), strict=True))
# fixed values: Latin letters that have no decomposition
LATIN = {"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"}

SIMPLIFIED = dict(zip(TRADITIONAL[::2], TRADITIONAL[1::2], strict=True))
_SIMPLE = str.maketrans(SIMPLIFIED)
HAN = re.compile(r"[㐀-鿿]")
_KANA_CHAR = re.compile(r"[ァ-ヶぁ-ゖ]")


@lru_cache(maxsize=1 << 14)
def _letter(c: str) -> str:
    o = ord(c)
    if 0xAC00 <= o < 0xD7A4:
        o -= 0xAC00
        return HANGUL[0][o // 588] + HANGUL[1][o % 588 // 28] + HANGUL[2][o % 28]
    if 0x3041 <= o <= 0x3096:
        c = chr(o + 0x60)
    if c in KANA:
        return KANA[c]
    if c in PINYIN:
        return PINYIN[c]
    base = unicodedata.normalize("NFD", c)[0]
    for table in (CYRILLIC, GREEK, LATIN):
        if c in table:
            return table[c]
        if base in table:
            return table[base]
    return base


def simplify(text: str) -> str:
    return text.translate(_SIMPLE)


def romanise(text: str) -> str:
    """Lower-case text in Latin letters; a word in several scripts is parted where its reading is parted."""
    t = simplify(unicodedata.normalize("NFKC", text).casefold())
    if _KANA_CHAR.search(t):
        for w, r in KANJI_WORDS.items():
            t = t.replace(w, f" {r} ")
    for w, r in KOREAN_WORDS.items():
        t = t.replace(w, r)
    out = []
    for c in t:
        r = c if c < "\x80" else _letter(c)
        out.append(r)
    t = "".join(out)
    return unicodedata.normalize("NFD", t).replace("̈", "").encode("ascii", "ignore").decode() if t.isascii() is False and not HAN.search(t) else t.replace("ü", "u")
