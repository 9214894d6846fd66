import os
import random

import pytest

from mediatide.llm import encoding as E

pytestmark = pytest.mark.skipif(not os.path.isdir(E.TOKENIZERS), reason="no public tokenizers")


def texts():
    rnd = random.Random(4)
    for alphabet in ("ab", "abcdefghij", "the ing ", "中文字符", "aA1 \n\t", "😀é中", "a", "'s're ll", "   \n"):
        for n in (0, 1, 7, 90, 3000):
            yield "".join(rnd.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize(("split", "leaf"), [(10, 3), (200, 50), (40, 200)])
def test_parts_join_exactly(spark, split, leaf):
    rows = [(k, t, "clash") for k, t in enumerate(texts())]
    rows += [(900, None, "x"), (901, "", "x"), (902, " \n ", "x"), (903, "<|endoftext|>", "x"), (903, "<|endoftext|>", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got: dict[int, list] = {}
    for r in E.encode_corpus(df, "doc_id", "text", split=split, leaf=leaf).collect():
        got.setdefault(r.doc_id, []).append(r.ids)
    enc = E.encoder()
    for k, t, _ in rows:
        assert all(ids == enc.encode_ordinary(t or "") for ids in got[k]), (k, t)
    assert len(got[903]) == 2
    assert E.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_against_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(E.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in texts():
        assert t.encode(text, add_special_tokens=False).ids == E.encoder().encode_ordinary(text)


def test_one_endless_word(spark):
    word = "".join(random.Random(1).choice("abcdefg") for _ in range(120_000))
    df = spark.createDataFrame([(1, word)], "doc_id bigint, text string")
    assert E.encode_corpus(df, "doc_id", "text").first().ids == E.encoder().encode_ordinary(word)


def test_counts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "two words")], "doc_id bigint, text string")
    assert {r.doc_id: r.n_tokens for r in E.count_tokens(df, ["doc_id"], "text").collect()} == {1: 0, 2: 0, 3: 2}
