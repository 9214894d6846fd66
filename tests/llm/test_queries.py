"""The registered queries of the subpackage on the smallest tables, held against the tables and against each other."""

import os

import pytest

from mediatide.llm import encoding as E
from mediatide.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_plain_titles(spark):
    found, all_ = rows(Q.p1_found(spark, SMALL)), Q.p1_titles(spark, SMALL).collect()
    changed = {(r.src, r.row_key) for r in all_ if r.original != r.plain_text}
    assert found == changed
    assert len(all_) == spark.read.parquet(f"{SMALL}/songs.parquet").count() + spark.read.parquet(f"{SMALL}/tracks.parquet").count()


def test_linked_names(spark):
    entity = {(r.library_id, r.name): r.entity for r in Q.p2_entities(spark, SMALL).collect()}
    found = rows(Q.p2_found(spark, SMALL))
    assert found
    for library, a, b in found:
        assert a.encode() < b.encode()
        assert entity[library, a] == entity[library, b]
    sizes = {}
    for (library, _), e in entity.items():
        sizes[library, e] = sizes.get((library, e), 0) + 1
    assert len(found) == sum(n * (n - 1) // 2 for n in sizes.values())


def test_restored_fields(spark):
    restored = Q.p3_restored(spark, SMALL).collect()
    assert {(r.src, r.row_id, r.field) for r in restored} == rows(Q.p3_found(spark, SMALL))
    # what was restored is not damaged any more
    assert not {r.restored for r in restored if r.restored} & {r.original for r in restored}


def test_unmatched_titles(spark):
    found = Q.p5_found(spark, SMALL).collect()
    assert {(r.src, r.row_key) for r in found if r.catalog_id == 0} == rows(Q.p5_unmatched(spark, SMALL))
    titled = spark.read.parquet(f"{SMALL}/songs.parquet").where("song_name <> ''").count() + spark.read.parquet(f"{SMALL}/tracks.parquet").where("title <> ''").count()
    assert len(found) == titled


def test_ids_decode_to_their_texts(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r.ids for r in Q.p7_ids(spark, SMALL).collect()}
    enc = E.encoder()
    assert {k: enc.decode(v) for k, v in got.items()} == texts
    assert all(v == enc.encode_ordinary(texts[k]) for k, v in got.items())


def test_containers_hold_everything(spark):
    sizes = {r.doc_id: len(r.ids) for r in Q.p7_ids(spark, SMALL).collect()}
    capacity = {r.container_kind: r.capacity_tokens for r in spark.read.parquet(f"{SMALL}/containers.parquet").collect()}
    packed = Q.p8_packed(spark, SMALL).toPandas()
    for kind, room in capacity.items():
        g = packed[packed.container_kind == kind]
        assert g.groupby("container_id").n_tokens.sum().max() <= room
        assert g.groupby("doc_id").n_tokens.sum().to_dict() == sizes
        assert all(sizes[d] > room for d in g[g.piece > 0].doc_id)
    use = {r.container_kind: r for r in Q.p8_use(spark, SMALL).collect()}
    assert {k: r.tokens for k, r in use.items()} == dict.fromkeys(capacity, sum(sizes.values()))
    assert all(0 < r.filled <= 1 for r in use.values())


def test_documents_stay_or_go(spark):
    found, kept = rows(Q.p9_found(spark, SMALL)), {(r.doc_id,) for r in Q.p9_kept(spark, SMALL).collect()}
    assert not found & kept
    assert found | kept == rows(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id"))
    assert {(r.doc_id,) for r in Q.p9_residue(spark, SMALL).collect()} == found
