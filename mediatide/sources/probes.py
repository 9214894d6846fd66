"""Pluggable extractors that look into files; what fails becomes a row with an error, never an exception."""

from __future__ import annotations

import base64
import hashlib
import json
import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

PROBE_SECONDS, PRINT_SECONDS, BAND_SECONDS = 8, 30, 15
SAMPLE_SECONDS, LEAST_SAMPLE = 120, 100
Extractor = Callable[[str], dict]


def tools() -> dict[str, bool]:
    """Which of the outside tools are there."""
    return {t: shutil.which(t) is not None for t in ("ffprobe", "fpcalc", "ffmpeg")}


def _run(args: list[str], seconds: float) -> bytes:
    return subprocess.run(args, capture_output=True, timeout=seconds, check=True).stdout


def probe(path: str) -> dict:
    """A file's description as JSON text."""
    return {"probe_json": _run(["ffprobe", "-v", "quiet", "-print_format", "json", "-show_format", "-show_streams", path], PROBE_SECONDS).decode()}


def sample_hash(pcm: bytes) -> str:
    """The fingerprint of last resort: a hash of the first seconds of sound."""
    if len(pcm) < LEAST_SAMPLE:
        raise ValueError("too little sound")
    return base64.b64encode(hashlib.sha256(pcm).digest()).decode()


def fingerprint(path: str) -> dict:
    """The first of three ways that works: the fingerprint tool, the codec tool's own, a hash of the sound."""
    have = tools()
    if have["fpcalc"]:
        got = json.loads(_run(["fpcalc", "-json", "-length", str(SAMPLE_SECONDS), path], PRINT_SECONDS))
        return {"fingerprint": got["fingerprint"], "duration": float(got["duration"])}
    if have["ffmpeg"]:
        try:
            text = _run(["ffmpeg", "-v", "quiet", "-i", path, "-t", str(SAMPLE_SECONDS), "-f", "chromaprint", "-"], PRINT_SECONDS).decode()
            return {"fingerprint": text.split("\n")[0].strip(), "duration": 0.0}
        except (subprocess.SubprocessError, UnicodeDecodeError):
            pcm = _run(["ffmpeg", "-v", "quiet", "-i", path, "-t", str(SAMPLE_SECONDS), "-ac", "1", "-ar", "8000", "-f", "s16le", "-"], PRINT_SECONDS)
            return {"fingerprint": sample_hash(pcm), "duration": 0.0}
    raise FileNotFoundError("no tool to fingerprint with")


def band_levels(path: str) -> dict:
    """What the level meter prints for the whole band and above 16, 20 and 22 kHz."""
    out = {}
    for name, low in (("full", 0), ("b16", 16000), ("b20", 20000), ("b22", 22000)):
        filters = (f"highpass=f={low}," if low else "") + "astats"
        run = subprocess.run(["ffmpeg", "-ss", "20", "-t", "25", "-i", path, "-af", filters, "-f", "null", "-"], capture_output=True, timeout=BAND_SECONDS, check=False)
        out[name + "_text"] = run.stderr.decode(errors="replace")
    return out


def extract(files: DataFrame, extractor: Extractor, schema: str, workers: int | None = None) -> DataFrame:
    """``file_path``, the extractor's columns (``schema``), ``is_failed`` and ``error_msg`` for each file.

    Parallelism is the number of partitions, ``workers`` if given.
    """
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["file_path"]:
                try:
                    got = extractor(path)
                    rows.append((path, *(got.get(n) for n in names), 0, ""))
                except Exception as e:  # noqa: BLE001 - any failure of a tool is a row
                    rows.append((path, *(None for _ in names), 1, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["file_path", *names, "is_failed", "error_msg"])

    spread = files.select("file_path").repartition(workers) if workers else files.select("file_path")
    return spread.mapInPandas(run, f"file_path string, {schema}, is_failed int, error_msg string")
