"""Reading catalogues of expected items: fragment tables as text, SQLite containers, cached tables."""

from __future__ import annotations

import sqlite3
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.dedup import renumbered

#: Header names of each logical column, matched without case.
ALIASES = {
    "precursor_mz": "PrecursorMz Q1 precursor_mz",
    "charge": "PrecursorCharge Charge prec.z",
    "modified_sequence": "ModifiedPeptide ModifiedSequence FullUniModPeptideName modified_sequence",
    "fragment_mz": "FragmentMz ProductMz Q3 frag_mz",
    "intensity": "RelativeIntensity LibraryIntensity Intensity",
    "sequence": "StrippedPeptide PeptideSequence Sequence",
    "rt": "Tr_recalibrated iRT NormalizedRetentionTime RT RetentionTime",
    "ion_type": "FragmentType IonType FragmentIonType",
    "ordinal": "FragmentNumber FragmentSeriesNumber IonNumber",
    "fragment_charge": "FragmentCharge ProductCharge",
    "loss": "FragmentLossType LossType",
    "proteins": "ProteinId ProteinGroup ProteinIds UniprotID",
    "genes": "Genes GeneName Gene",
    "decoy": "Decoy IsDecoy",
}
REQUIRED = ("precursor_mz", "charge", "modified_sequence", "fragment_mz", "intensity")


def resolve_headers(columns: list[str]) -> dict[str, str]:
    """Logical name to the header in use; a missing required column is an error."""
    by_name = {c.strip().lower(): c for c in columns}
    found = {k: next((by_name[a.lower()] for a in names.split() if a.lower() in by_name), None) for k, names in ALIASES.items()}
    if missing := [k for k in REQUIRED if found[k] is None]:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(columns)}")
    return {k: v for k, v in found.items() if v is not None}


def fragment_rows(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated fragment table with its logical columns, absent ones null."""
    raw = spark.read.csv(path, sep="\t", header=True)
    names = resolve_headers(raw.columns)
    kinds = dict.fromkeys(("precursor_mz", "fragment_mz", "intensity", "rt"), "double") | dict.fromkeys(("charge", "ordinal", "fragment_charge"), "int")
    return raw.select(*[(F.col(f"`{names[k]}`") if k in names else F.lit(None)).try_cast(kinds.get(k, "string")).alias(k) for k in ALIASES])


def entries(rows: DataFrame, least_fragments: int = 3) -> DataFrame:
    """One row per modified sequence and charge, its fragments by intensity; items of fewer fragments are left out."""
    fragment = F.struct((-F.col("intensity")).alias("_o"), F.col("fragment_mz").alias("mz"), "intensity", "ion_type", "ordinal", "fragment_charge", "loss")
    grouped = rows.filter(F.col("modified_sequence").isNotNull() & F.col("charge").isNotNull() & F.col("fragment_mz").isNotNull()).groupBy("modified_sequence", "charge")
    merged = grouped.agg(F.min("precursor_mz").alias("precursor_mz"), F.avg("rt").alias("rt"), F.max("sequence").alias("sequence"), F.max("proteins").alias("proteins"), F.max("genes").alias("genes"), F.array_sort(F.collect_list(fragment)).alias("_f"))
    split = lambda c: F.coalesce(F.filter(F.transform(F.split(c, "[;,]"), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))
    fragments = F.transform("_f", lambda f: f.dropFields("_o"))
    return merged.filter(F.size("_f") >= least_fragments).select("modified_sequence", "charge", "precursor_mz", "rt", "sequence", split(F.col("proteins")).alias("proteins"), split(F.col("genes")).alias("genes"), fragments.alias("fragments"))


def unpack_peaks(mz: Column, intensity: Column, n: Column) -> Column:
    """(mzs, intensities) of packed little-endian blobs, compressed by zlib or not; intensities of 4 or 8 bytes, largest 1."""

    @F.pandas_udf("mzs array<double>, intensities array<double>")
    def unpack(mz_blobs, intensity_blobs, counts):
        import numpy as np
        import pandas as pd

        def raw(blob: bytes | None, sizes: tuple[int, ...]) -> bytes:
            if blob is None or len(blob) in sizes:
                return blob or b""
            return zlib.decompress(blob)

        out = []
        for a, b, n in zip(mz_blobs, intensity_blobs, counts, strict=True):
            n = int(n or 0)
            x = np.frombuffer(raw(a, (8 * n,)), "<f8")
            packed = raw(b, (4 * n, 8 * n))
            y = np.frombuffer(packed, "<f8" if len(packed) == 8 * n else "<f4").astype(float)
            if len(x) != n or len(y) != n:
                raise ValueError(f"{n} peaks announced, {len(x)} places and {len(y)} intensities found")
            out.append((x, y / y.max() if n and y.max() > 0 else y))
        return pd.DataFrame(out, columns=["mzs", "intensities"])

    return unpack(mz, intensity, n)


def sqlite_table(spark: SparkSession, path: str, query: str, schema: str, batch: int = 5000) -> DataFrame:
    """Rows of a SQLite file that all executors can open, read in one task and dealt out again.

    A container is one file with one reader; the rows are repartitioned for what follows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
                cursor = con.execute(query)
                while rows := cursor.fetchmany(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    empty = spark.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(empty.schema)
    types, names = arrow.types, arrow.names
    return spark.range(0, 1, 1, 1).mapInArrow(run, schema).repartition(spark.sparkContext.defaultParallelism)


def spectral_library(spark: SparkSession, path: str) -> DataFrame:
    """Reference spectra of a SQLite library with their peaks and proteins."""
    spectra = sqlite_table(spark, path, "SELECT id, peptideSeq, peptideModSeq, precursorMZ, precursorCharge, retentionTime, numPeaks, peakMZ, peakIntensity FROM RefSpectra LEFT JOIN RefSpectraPeaks ON RefSpectraID = id", "id long, sequence string, modified_sequence string, precursor_mz double, charge int, rt double, n_peaks int, mz_blob binary, intensity_blob binary").dropDuplicates(["id"])
    proteins = sqlite_table(spark, path, "SELECT RefSpectraId, accession FROM RefSpectraProteins JOIN Proteins ON Proteins.id = ProteinId", "id long, accession string")
    owners = proteins.groupBy("id").agg(F.array_sort(F.collect_set("accession")).alias("proteins"))
    peaks = unpack_peaks(F.col("mz_blob"), F.col("intensity_blob"), F.col("n_peaks"))
    return spectra.join(owners, "id", "left").withColumn("p", peaks).select("id", "sequence", "modified_sequence", "precursor_mz", "charge", "rt", "p.mzs", "p.intensities", F.coalesce("proteins", F.array().cast("array<string>")).alias("proteins"))


def unpack_plain(mz: Column, intensity: Column) -> Column:
    """(mzs, intensities) of uncompressed little-endian blobs of doubles, or of singles where the sizes don't fit doubles."""

    @F.pandas_udf("mzs array<double>, intensities array<double>")
    def unpack(mz_blobs, intensity_blobs):
        import numpy as np
        import pandas as pd

        out = []
        for a, b in zip(mz_blobs, intensity_blobs, strict=True):
            a, b = a or b"", b or b""
            width = 8 if len(a) % 8 == 0 and len(b) % 8 == 0 else 4
            if len(a) % width or len(b) % width:
                raise ValueError(f"blobs of {len(a)} and {len(b)} bytes hold no numbers of 8 or 4 bytes")
            x, y = (np.frombuffer(v, f"<f{width}").astype(float) for v in (a, b))
            n = min(len(x), len(y))
            out.append((x[:n], y[:n]))
        return pd.DataFrame(out, columns=["mzs", "intensities"])

    return unpack(mz, intensity)


def entry_library(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a SQLite library with tables ``entries`` and ``peaks``, or, where there are none, the precursors of ``peptidetoprotein`` without fragments.

    Columns: entry_id (in the order of sequence and charge), modified_sequence, charge,
    precursor_mz, rt (minutes, 0 if unknown), mzs, intensities, proteins.
    """
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        tables = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    none = F.array().cast("array<double>")
    if "entries" in tables:
        query = "SELECT e.PeptideModSeq, e.PrecursorCharge, e.PrecursorMz, e.RTInSeconds, e.ProteinAccession, p.MassArray, p.IntensityArray FROM entries e LEFT JOIN peaks p ON e.PeptideModSeq = p.PeptideModSeq AND e.PrecursorCharge = p.PrecursorCharge"
        rows = sqlite_table(spark, path, query, "modified_sequence string, charge int, precursor_mz double, seconds double, protein string, mz_blob binary, intensity_blob binary")
        both = F.col("mz_blob").isNotNull() & F.col("intensity_blob").isNotNull()
        peaks = unpack_plain(F.when(both, F.col("mz_blob")), F.when(both, F.col("intensity_blob")))
        rows = rows.withColumn("p", peaks).withColumn("mzs", F.col("p.mzs")).withColumn("intensities", F.col("p.intensities"))
    else:
        rows = sqlite_table(spark, path, "SELECT DISTINCT PeptideModSeq, PrecursorCharge, PrecursorMz FROM peptidetoprotein", "modified_sequence string, charge int, precursor_mz double")
        rows = rows.withColumn("seconds", F.lit(None).cast("double")).withColumn("protein", F.lit(None).cast("string")).withColumn("mzs", none).withColumn("intensities", none)
    rows = rows.withColumn("rt", F.coalesce(F.col("seconds") / 60, F.lit(0.0))).withColumn("proteins", F.filter(F.array("protein"), lambda x: x.isNotNull()))
    return renumbered(rows.drop("seconds", "protein", "p", "mz_blob", "intensity_blob"), ["modified_sequence", "charge", "precursor_mz"])


#: Headers of result tables of error-rate tools, lower-cased.
RESULT_HEADERS = {
    "psm_id": ("specid", "psm_id", "psmid"),
    "peptide": ("peptide",),
    "score": ("score", "mokapot_score", "mokapot score"),
    "q": ("q-value", "qvalue", "mokapot_qvalue", "mokapot q-value"),
    "pep": ("posterior_error_prob", "pep", "mokapot_pep"),
}


def external_results(spark: SparkSession, path: str) -> DataFrame:
    """(psm_id, peptide, score, q, pep) of a tab-separated result table; rows without an id go, numbers that can't be read are 0, 1 and 1."""
    raw = spark.read.csv(path, sep="\t", header=True, mode="PERMISSIVE")
    by_name = {c.lower(): c for c in raw.columns}
    found = {k: next((by_name[n] for n in names if n in by_name), None) for k, names in RESULT_HEADERS.items()}
    column = lambda k: F.lit(None).cast("string") if found[k] is None else F.col(f"`{found[k]}`")
    number = lambda k, other: F.coalesce(column(k).try_cast("double"), F.lit(other))
    rows = raw.select(column("psm_id").alias("psm_id"), F.coalesce(column("peptide"), F.lit("")).alias("peptide"), number("score", 0.0).alias("score"), number("q", 1.0).alias("q"), number("pep", 1.0).alias("pep"))
    return rows.filter("psm_id IS NOT NULL")


def pack(values: list[float], code: str) -> bytes:
    """Little-endian bytes, by zlib if that is shorter."""
    raw = struct.pack(f"<{len(values)}{code}", *values)
    packed = zlib.compress(raw)
    return packed if len(packed) < len(raw) else raw
