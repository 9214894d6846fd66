from pyspark.sql import functions as F

from mediatide.llm import residue
from mediatide.llm.mojibake import canonical_texts, train


def test_every_canonical_string_is_read(spark):
    df = spark.range(25_000).select(F.concat(F.lit("Título "), F.col("id").cast("string")).alias("title"))
    assert len(canonical_texts([(df, "title"), (df.limit(1), "title")])) == 25_001


def test_joined_strings_of_every_text_count():
    texts = [f"{k:04d} song{'' if k != 1_001 else chr(0x416)}" for k in range(2_000)]
    # "Ж" ends one text only, and is followed by a wide comma only where that text is joined with itself
    assert chr(0x436) + "，" in train(texts).pair


def test_prose_is_fitted_on_all_texts_to_their_ends(spark):
    """Beyond 4,000 texts, beyond 4,000 characters, and the same models wherever the texts lie."""
    texts = [f"The band moved to Dunholm in {k} and shared a kitchen." for k in range(5_000)] + ["A quiet song. " * 400 + "Zyxqwv."]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 2)], "doc_id bigint, text string")
    whole, apart = residue.distinct_texts(docs, "text"), residue.distinct_texts(docs.repartition(7), "text")
    assert whole.count() == 5_001
    models = residue.fit(docs, "doc_id", "text").value
    same = residue._train_over(apart.repartition(3), "text")
    here = residue.train(texts)
    for order in residue.ORDERS:
        assert (models.tables[order] == same.tables[order]).all()
        assert (models.tables[order] == here.tables[order]).all()
    codes = residue._codes("Zyxqwv")
    assert models.score(codes)[-1, 0] > models.score(codes)[-1, 1:].max()
