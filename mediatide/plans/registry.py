"""The library's registered queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.multivalue import read_grammar, split_values
from ..session import spread, table
from . import library, lists

Query = Callable[[SparkSession, str], DataFrame]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every artist field that holds at least two."""
    grammar = read_grammar(table(spark, sf_dir, "catalog_artists"))
    out = []
    for src, key in (("songs", "song_id"), ("audio_fingerprints", "rec_id")):
        rows = split_values(spread(table(spark, sf_dir, src).select(key, "artist")), key, "artist", grammar, at_least=2)
        out.append(rows.select(F.lit(src).alias("src"), F.col(key).alias("row_id"), "pos", "value"))
    return out[0].unionByName(out[1])


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every non-empty artist field, those with one value too."""
    grammar = read_grammar(table(spark, sf_dir, "catalog_artists"))
    out = []
    for src, key in (("songs", "song_id"), ("audio_fingerprints", "rec_id")):
        rows = split_values(spread(table(spark, sf_dir, src).select(key, "artist")), key, "artist", grammar)
        out.append(rows.select(F.lit(src).alias("src"), F.col(key).alias("row_id"), "pos", "value"))
    return out[0].unionByName(out[1])


def queries() -> dict[str, Query]:
    """The library's own queries by name."""
    return {name: run for name, (run, _) in (library.QUERIES | lists.QUERIES).items()} | {"p4_found": p4_found, "p4_values": p4_values}


def oracle_sql() -> dict[str, str]:
    """The SQL of those that have one."""
    return {name: sql for name, (_, sql) in (library.QUERIES | lists.QUERIES).items() if sql}
