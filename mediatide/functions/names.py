"""Plain helpers on names of people and groups, shared by splitting and linking."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# fixed values: usual short forms of given names
GIVEN_SHORT_FORMS = {
    "alex": "alexander", "sandy": "alexander", "xander": "alexander", "tony": "anthony", "ben": "benjamin", "benny": "benjamin",
    "chris": "christopher", "kit": "christopher", "topher": "christopher", "dora": "dorothea", "dot": "dorothea", "dottie": "dorothea", "thea": "dorothea",
    "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "edward", "teddy": "edward", "beth": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth",
    "betty": "elizabeth", "eliza": "elizabeth", "lisa": "elizabeth", "paco": "francisco", "pancho": "francisco", "fran": "francisco",
    "fred": "frederick", "freddie": "frederick", "freddy": "frederick", "gabi": "gabriela", "gaby": "gabriela", "jo": "josephine", "josie": "josephine",
    "pepe": "jose", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kit ": "katherine", "kay": "katherine",
    "leo": "leonard", "len": "leonard", "lenny": "leonard", "maggie": "margaret", "meg": "margaret", "peg": "margaret", "peggy": "margaret",
    "mick": "michael", "mike": "michael", "mickey": "michael", "nick": "nicholas", "nicky": "nicholas", "tilly": "ottilie", "tillie": "ottilie",
    "pat": "patricia", "patty": "patricia", "trish": "patricia", "tricia": "patricia", "becky": "rebecca", "becca": "rebecca",
    "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "sam": "samuel", "sammy": "samuel", "theo": "theodore",
    "tom": "thomas", "tommy": "thomas", "vicky": "victoria", "vic": "victoria", "tori": "victoria", "bill": "william", "billy": "william", "will": "william", "liam": "william",
    "саша": "александр", "шура": "александр", "настя": "анастасия", "вова": "владимир", "володя": "владимир", "дима": "дмитрий", "митя": "дмитрий",
    "катя": "екатерина", "лена": "елена", "маша": "мария", "миша": "михаил", "михаил": "михаил",
}
GIVEN_SHORT_FORMS.pop("kit ")
# fixed values: short forms that stand for two given names
GIVEN_TWO_WAYS = {"ted": ("edward", "theodore"), "kit": ("christopher", "katherine"), "theo": ("theodore",), "thea": ("dorothea",)}
# fixed values: kinds of ensembles; where one short form fits several, the first is meant
GROUP_KINDS = (
    "symphony orchestra", "string quartet", "string quintet", "string trio", "string orchestra", "jazz trio", "jazz quartet", "jazz quintet", "jazz band", "jazz orchestra", "brass band", "brass quintet", "big band", "steel band",
    "youth choir", "youth orchestra", "boys choir", "chamber ensemble", "chamber orchestra", "chamber choir", "gospel choir", "wind ensemble", "wind quintet", "piano trio", "philharmonic", "philharmonic orchestra",
)
# fixed values: numbers that stand for the beginning of a word
_NUMERALS = {"duo": ("2o", "duo"), "trio": ("3o", "trio"), "quartet": ("4tet", "quartet"), "quintet": ("5tet", "quintet"), "sextet": ("6tet", "sextet")}


def short_word(short: str, word: str) -> bool:
    """Whether a word may be shortened so: its beginning, or its first letter and some of its later consonants in order."""
    if short == word or short in _NUMERALS.get(word, ()):
        return True
    if len(short) < 2 or short[0] != word[0]:
        return False
    if word.startswith(short):
        return True
    at = iter(word[1:])
    return not set("aeiou") & set(short[1:]) and all(c in at for c in short[1:])


@lru_cache(maxsize=1 << 14)
def group_kind(words: tuple[str, ...]) -> str | None:
    """The kind of ensemble that some words mean, written out or shortened; a kind of several words also by its initials."""
    for kind in GROUP_KINDS:
        full = kind.split()
        if len(words) == len(full) and (len(full) > 1 or len(words[0]) > 3) and all(map(short_word, words, full)):
            return kind
        if len(full) > 1 and words == ("".join(w[0] for w in full),):
            return kind
    return None


def group_pattern(kind: str) -> str:
    """The same as a regular expression for lower-case Latin letters."""
    full = kind.split()
    words = ["(?:" + "|".join([w[0] + (w[1] + "?" if len(full) > 1 else w[1:4]) + "".join(f"{c}?" for c in w[2 if len(full) > 1 else 4 :]), *_NUMERALS.get(w, ())[:1]]) + ")" for w in full]
    initials = ["".join(w[0] for w in full)] if len(full) > 1 else []
    return r"\b(?:" + "|".join(["[^a-z0-9]+".join(words), *initials]) + r")\b[^a-z0-9]*$"


def squeeze(text: str) -> str:
    """Letters and digits only, case and accents folded; ``&`` reads as ``and``; a leading ``the`` is dropped."""
    t = unicodedata.normalize("NFKD", text.casefold().replace("&", " and "))
    t = re.sub(r"^\s*the\s+", "", t)
    return "".join(c for c in t if c.isalnum())


GROUP_WORDS = frozenset(map(squeeze, GROUP_KINDS))
