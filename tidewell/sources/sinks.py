"""Writing results: scored rows, reports, model input, and library tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import sequences


def write_scores(scores: DataFrame, path: str, run: str = "file_name", **facts: str) -> None:
    """Scored rows as zstd Parquet, a folder per run, and the facts (versions, hashes) they hold for beside them."""
    scores.write.option("compression", "zstd").partitionBy(run).parquet(path)
    spark = scores.sparkSession
    spark.createDataFrame([(k, str(v)) for k, v in sorted(facts.items())], "name string, value string").coalesce(1).write.json(f"{path}.facts")


def facts_match(spark, path: str, **facts: str) -> bool:
    """Whether the scores at ``path`` were written with these facts."""
    held = {r["name"]: r["value"] for r in spark.read.schema("name string, value string").json(f"{path}.facts").collect()}
    return all(held.get(k) == str(v) for k, v in facts.items())


def report(rows: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """``rows`` as text columns, numbers with fixed decimals."""
    return rows.select(*[F.format_string(f"%.{decimals[c]}f", F.col(c)).alias(c) if c in decimals else F.col(c).cast("string").alias(c) for c in rows.columns])


def write_report(rows: DataFrame, path: str, decimals: dict[str, int]) -> None:
    report(rows, decimals).write.csv(path, sep="\t", header=True)


def model_input(rows: DataFrame, features: list[str]) -> DataFrame:
    """id, label (1 or -1), charge_1 to charge_5, features, and the sequence between flanks."""
    charges = [F.when(F.col("charge") == z, 1).otherwise(0).alias(f"charge_{z}") for z in range(1, 6)]
    name = F.concat_ws("_", "file_name", "modified_sequence", F.col("charge").cast("string"), F.col("scan").cast("string"))
    return rows.select(name.alias("id"), F.when(F.col("decoy"), -1).otherwise(1).alias("label"), "scan", *charges, *features, F.concat(F.lit("-."), "modified_sequence", F.lit(".-")).alias("peptide"))


def group_report(groups: DataFrame, threshold: float) -> DataFrame:
    """Groups with q up to the threshold, lists joined by semicolons, best first."""
    lists = [c for c, kind in groups.dtypes if kind.startswith("array")]
    joined = [F.array_join(F.array_sort(c), ";").alias(c) if c in lists else F.col(c) for c in groups.columns]
    return groups.filter(F.col("q") <= threshold).select(*joined).orderBy("q", "group_id")


def library_tables(entries: DataFrame) -> dict[str, DataFrame]:
    """Tables of a spectral library from (entry_id, modified_sequence, charge, precursor_mz, rt, start, end, proteins, mzs, intensities).

    spectra, peaks (exploded), modifications (places from 1, masses), proteins with ids by accession, and their links.
    """
    spectra = entries.select(F.col("entry_id").alias("id"), "modified_sequence", "charge", "precursor_mz", "rt", "start", "end", F.size("mzs").alias("n_peaks"))
    peaks = entries.select(F.col("entry_id").alias("id"), F.posexplode(F.arrays_zip("mzs", "intensities")).alias("place", "p")).select("id", "place", F.col("p.mzs").alias("mz"), F.col("p.intensities").alias("intensity"))
    links = entries.select(F.col("entry_id").alias("id"), F.explode("proteins").alias("accession")).distinct()
    from tidewell.operators.dedup import renumbered

    proteins = renumbered(links.select("accession").distinct(), ["accession"], "protein_id")
    masses = sequences.bracketed_masses(sequences.mass_notation(F.col("modified_sequence")))
    modifications = entries.select(F.col("entry_id").alias("id"), F.explode(masses).alias("m")).select("id", (F.col("m.position") + 1).alias("position"), F.col("m.mass").alias("mass"))
    return {"spectra": spectra, "peaks": peaks, "modifications": modifications, "proteins": proteins, "links": links.join(proteins, "accession").select("id", "protein_id")}


def write_calibration(curves: DataFrame, path: str, keys: list[str]) -> None:
    """A JSON line per curve, as ``read_calibration`` reads it."""
    curves.select(*keys, "knots", "fitted", "residuals", "sd", "mad", "n").write.json(path, ignoreNullFields=False)


def read_calibration(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Curves as ``local_fit`` gives them."""
    schema = ", ".join(f"`{k}` string" for k in keys) + ", knots array<double>, fitted array<double>, residuals array<double>, sd double, mad double, n long"
    return spark.read.schema(schema).json(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Pairs of target and decoy as CSV with a header, in the order of their first column, missing values empty."""
    pairs.orderBy(pairs.columns[0]).write.csv(path, header=True, nullValue="")
