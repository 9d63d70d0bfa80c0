"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, exact_dedup, lang_id, license_scan, packing, pii, simhash, substring_dedup, toxicity, url_filter
from tessera.llm.common import small_batches


def job(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_license_scan": job(license_scan.query),
    "op2_substring_dedup": job(substring_dedup.query),
    "op3_packing": job(packing.query),
    "op4_toxicity": job(toxicity.query),
    "op5_decontamination": job(decontamination.query),
    "op6_url_filter": job(url_filter.query),
    "op7_simhash": job(simhash.query),
    "op8_exact_dedup": job(exact_dedup.query),
    "op9_pii": job(pii.query),
    "op10_lang_id": job(lang_id.query),
}
SQL = {"op5_decontamination": decontamination.SQL, "op8_exact_dedup": exact_dedup.SQL}
