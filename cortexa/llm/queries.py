"""The corpus operators' queries, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import brown_lm, decontaminate, exact_dedup, language_id, license_scan, line_dedup, merkle, packing, periodic_runs, resampling, simhash, substring_dedup, toxicity
from .common import documents


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


QUERIES = {
    "op1_license_scan": lambda spark, sf_dir: license_scan.scan(documents(spark, sf_dir)),
    "op2_simhash_near_dedup": lambda spark, sf_dir: simhash.near_duplicates(documents(spark, sf_dir)),
    "op3_brown_lm": lambda spark, sf_dir: brown_lm.lm_scores(documents(spark, sf_dir)),
    "op4_language_id": lambda spark, sf_dir: language_id.language_id(documents(spark, sf_dir)),
    "op5_toxicity": lambda spark, sf_dir: toxicity.toxicity(documents(spark, sf_dir), _read(spark, sf_dir, "labels")),
    "op6_exact_dedup": lambda spark, sf_dir: exact_dedup.exact_dedup(documents(spark, sf_dir)),
    "op7_substring_dedup": lambda spark, sf_dir: substring_dedup.substring_dedup(documents(spark, sf_dir), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256"),
    "op8_merkle_fixity": lambda spark, sf_dir: merkle.fixity_audit(_read(spark, sf_dir, "pages")),
    "op9_best_fit_packing": lambda spark, sf_dir: packing.best_fit(documents(spark, sf_dir)),
    "op10_decontamination": lambda spark, sf_dir: decontaminate.contained(documents(spark, sf_dir), _read(spark, sf_dir, "benchmark")),
    "op11_line_dedup": lambda spark, sf_dir: line_dedup.line_dedup(documents(spark, sf_dir), texts=False),
    "op12_periodic_runs": lambda spark, sf_dir: periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.planted(documents(spark, sf_dir)))),
    "op13_importance_resampling": lambda spark, sf_dir: resampling.resample(documents(spark, sf_dir), _read(spark, sf_dir, "benchmark")),
}

SQL = {
    "op1_license_scan": license_scan.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op8_merkle_fixity": merkle.SQL,
    "op10_decontamination": decontaminate.SQL,
    "op11_line_dedup": line_dedup.SQL,
    "op13_importance_resampling": resampling.SQL,
}
