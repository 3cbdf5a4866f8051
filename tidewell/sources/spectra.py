"""Reading spectra from mzML files, a file per task, streamed element by element."""

from __future__ import annotations

import base64
import io
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file_name string, scan int, ms_level int, rt double, precursor_mz double, iso_low double, iso_high double, mzs array<double>, intensities array<double>"
#: Accessions of the controlled vocabulary.
MS_LEVEL, START_TIME, MINUTE = "MS:1000511", "MS:1000016", "UO:0000031"
TARGET, LOWER, UPPER, SELECTED = "MS:1000827", "MS:1000828", "MS:1000829", "MS:1000744"
F32, F64, ZLIB, MZ_ARRAY, INTENSITY_ARRAY = "MS:1000521", "MS:1000523", "MS:1000574", "MS:1000514", "MS:1000515"
#: Half width of an isolation window that isn't stated.
HALF_WIDTH = 12.5


def _parameters(element) -> dict[str, tuple[str, str]]:
    return {p.get("accession"): (p.get("value", ""), p.get("unitAccession", "")) for p in element.iter() if p.tag.endswith("}cvParam") or p.tag == "cvParam"}


def _array(element) -> tuple[str, list[float]]:
    import numpy as np

    known = _parameters(element)
    text = next((b.text for b in element.iter() if b.tag.endswith("binary")), None) or ""
    raw = base64.b64decode(text)
    raw = zlib.decompress(raw) if ZLIB in known and raw else raw
    kind = "mz" if MZ_ARRAY in known else "intensity" if INTENSITY_ARRAY in known else ""
    return kind, np.frombuffer(raw, "<f4" if F32 in known else "<f8").astype(float)


def spectrum(element, index: int) -> dict | None:
    """A row of a spectrum element; None for a fragment spectrum without precursor or peaks."""
    known = _parameters(element)
    level = int(known.get(MS_LEVEL, ("1", ""))[0])
    time, unit = known.get(START_TIME, ("0", MINUTE))
    arrays = dict(_array(a) for a in element.iter() if a.tag.endswith("binaryDataArray"))
    mzs, ys = arrays.get("mz", []), arrays.get("intensity", [])
    target = known.get(TARGET, known.get(SELECTED))
    if level > 1 and (target is None or not len(mzs)):
        return None
    center = float(target[0]) if target and level > 1 else None
    low, high = (float(known.get(k, (HALF_WIDTH, ""))[0]) for k in (LOWER, UPPER))
    order = sorted(range(len(mzs)), key=lambda i: mzs[i])
    return {
        "scan": index,
        "ms_level": level,
        "rt": float(time) if unit == MINUTE else float(time) / 60,
        "precursor_mz": float(known.get(SELECTED, target)[0]) if center is not None else None,
        "iso_low": center - low if center is not None else None,
        "iso_high": center + high if center is not None else None,
        "mzs": [float(mzs[i]) for i in order],
        "intensities": [float(ys[i]) for i in order],
    }


def read_mzml(spark: SparkSession, path: str, batch: int = 500) -> DataFrame:
    """All spectra of the files at ``path`` (a file, folder or pattern); sorted places, times in minutes, scans from 0."""
    shape = spark.createDataFrame([], SCHEMA).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for name, content in zip(files.column(0).to_pylist(), files.column(1).to_pylist(), strict=True):
                rows, index = [], 0
                for _, element in ET.iterparse(io.BytesIO(content)):
                    if element.tag.endswith("}spectrum") or element.tag == "spectrum":
                        row = spectrum(element, index)
                        index += 1
                        element.clear()
                        if row is not None:
                            rows.append({"file_name": name.rsplit("/", 1)[-1].rsplit(".", 1)[0], **row})
                        if len(rows) >= batch:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mzML").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def fragment_spectra(spectra: DataFrame) -> DataFrame:
    return spectra.filter(F.col("ms_level") == 2)


def survey_spectra(spectra: DataFrame) -> DataFrame:
    return spectra.filter(F.col("ms_level") == 1).select("file_name", "scan", "rt", "mzs", "intensities")
