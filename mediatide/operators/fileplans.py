"""What is to be done with files, as rows: renaming, copying, recycling, and the records afterwards."""

from __future__ import annotations

import filecmp
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, below, extension, swap_extension
from ..session import cut, spread
from .ordering import ranked


def rename_plan(records: DataFrame) -> DataFrame:
    """``(file_path, target, success, msg)``: each file with its suggested extension."""
    target = swap_extension(F.col("file_path"), F.col("suggested_ext"))
    same = target == F.col("file_path")
    return records.select("file_path", target.alias("target"), F.lit(True).alias("success"), F.when(same, "后缀已一致，无需重命名").otherwise("后缀纠正成功").alias("msg"))


_NUMBERED = r"^(.*)_([1-9][0-9]{0,17})(\.[^./]*)?$"


def apart(plan: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``plan`` with every ``target`` used once and none that is in ``existing`` (``file_path``).

    A wanted name goes to the lowest source path that wants it, if no file has it; all others get ``_1``, ``_2``, …
    before the extension, in order of the source path, skipping numbers that make a name which is wanted itself or
    taken. No two names can be numbered into the same one, as the number is read off its end. Null targets stay null.
    """
    cols = plan.columns
    rows = plan.withColumns({"_file": F.lit(1), "_path": F.col("file_path")})
    if existing is not None:
        taken = existing.select(F.col("file_path").alias("target")).where(F.col("target").isNotNull()).distinct()
        rows = rows.unionByName(taken.select("target", F.lit(0).alias("_file")), allowMissingColumns=True)
    # a file that is there comes first; what stands first has the name
    at = cut(ranked(cut(rows), ["target"], [F.asc("_file"), F.asc("_path")], "_n").withColumn("_want", F.col("_n") - 1))
    stays = (F.col("_want") == 0) | F.col("target").isNull()
    first, others = at.where((F.col("_file") == 1) & stays), at.where((F.col("_file") == 1) & ~stays)
    # numbers that are no longer free: those of wanted names and of files that are there
    names = at.where("_n = 1").select(F.regexp_extract("target", _NUMBERED, 1).alias("_stem"), F.regexp_extract("target", _NUMBERED, 2).try_cast("bigint").alias("_want"), F.regexp_extract("target", _NUMBERED, 3).alias("_ext"))
    used = cut(names.where(F.col("_want").isNotNull()).select(F.concat("_stem", "_ext").alias("target"), "_want").join(others.select("target").distinct(), "target", "left_semi"))
    if used.isEmpty():
        given = others.withColumn("_k", F.col("_want"))
    else:
        # the free number for the j-th is j and one more for each used number with fewer than j free ones before it: its
        # place when the used numbers, less their own place, are sorted in after the j they don't precede
        free_before = ranked(used, ["target"], [F.asc("_want")], "_n").select("target", (F.col("_want") - F.col("_n")).alias("_want"), F.lit(1).alias("_used"))
        both = others.drop("_n").withColumn("_used", F.lit(0)).unionByName(free_before, allowMissingColumns=True)
        given = ranked(both, ["target"], [F.asc("_want"), F.asc("_used")], "_k").where("_used = 0")
    name = F.concat(F.regexp_replace("target", r"\.[^./]*$", ""), F.lit("_"), F.col("_k").cast("string"), F.regexp_extract("target", r"(\.[^./]*)$", 1))
    return first.select(*cols).unionByName(given.withColumn("target", name).select(*cols))


def transfer_plan(records: DataFrame, root: str, out: str, action: str = "copy", keep_structure: bool = True, fix_extension: bool = True, existing: DataFrame | None = None) -> DataFrame:
    """``(file_path, action, target, success, msg)``: files copied or moved below ``out``.

    Any other action changes nothing. Wanted targets that collide with each other or with ``existing`` files are
    told apart.
    """
    if action not in ("copy", "move"):
        return records.select("file_path", F.lit(action).alias("action"), F.col("file_path").alias("target"), F.lit(True).alias("success"), F.lit("仅扫描模式，未改动文件").alias("msg"))
    target = below(F.col("file_path"), root, out, keep_structure)
    if fix_extension:
        target = F.when(F.coalesce("suggested_ext", F.lit("")) != "", swap_extension(target, F.col("suggested_ext"))).otherwise(target)
    msg = "已复制到输出目录" if action == "copy" else "已移动到输出目录"
    return apart(records.select("file_path", F.lit(action).alias("action"), target.alias("target"), F.lit(True).alias("success"), F.lit(msg).alias("msg")), existing)


def recycle_plan(files: DataFrame, root: str, bin_: str, existing: DataFrame | None = None) -> DataFrame:
    """``(file_path, target, success, msg)``: files moved to the recycle folder at their place below ``root``."""
    return apart(files.select("file_path", below(F.col("file_path"), root, bin_).alias("target"), F.lit(True).alias("success"), F.lit("已移入回收站").alias("msg")), existing)


def rewrite_records(records: DataFrame, plan: DataFrame, action: str) -> DataFrame:
    """The records after a plan was carried out.

    A renamed file's record moves to the new path and fits; a copied one notes where to; moved, recycled and
    deleted ones leave.
    """
    done = plan.where("success").select("file_path", F.col("target").alias("_to"))
    rest = records.join(done, "file_path", "left_anti")
    if action == "rename_fix":
        moved = records.join(done, "file_path").withColumns({"file_path": F.col("_to"), "file_name": base_name(F.col("_to")), "current_ext": extension(F.col("_to")), "is_mismatch": F.lit(0), "status": F.lit("已修正后缀")})
        return rest.unionByName(moved.select(*records.columns))
    if action == "copy":
        noted = records.join(done, "file_path").withColumn("status", F.concat(F.lit("已复制到: "), base_name(F.col("_to"))))
        return rest.unionByName(noted.select(*records.columns))
    return rest


def _transfer(source: str, target: str, action: str) -> None:
    """One file; nothing is overwritten, and a second attempt at what was done is no failure."""
    if action == "delete":
        if os.path.exists(source):
            os.remove(source)
        return
    os.makedirs(os.path.dirname(target), exist_ok=True)
    if action != "copy" and not os.path.exists(source) and os.path.exists(target):
        return
    partial = f"{target}.{uuid.uuid4().hex}.part"
    shutil.copy2(source, partial)
    try:
        os.link(partial, target)  # unlike renaming this fails where the name is taken
    except FileExistsError:
        if not filecmp.cmp(partial, target, shallow=False):
            raise
    finally:
        os.remove(partial)
    if action != "copy":
        os.remove(source)


def carry_out(plan: DataFrame, action: str) -> DataFrame:
    """``(file_path, success, result)``: what a plan says, done by the tasks on files that all of them can reach.

    ``result`` is the target or what went wrong. The plan is carried out once, when this is called.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for source, target in zip(batch["file_path"], batch["target"], strict=True):
                try:
                    _transfer(source, target, action)
                    out.append((source, True, target))
                except OSError as e:
                    out.append((source, False, str(e)))
            yield pd.DataFrame(out, columns=["file_path", "success", "result"])

    return cut(spread(plan.select("file_path", "target")).mapInPandas(run, "file_path string, success boolean, result string"))
