"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prismflow.llm import bpe, collocations, decontaminate, exact, jaccard, langid, licenses, negatives, repeats, secret_scan, simhash, token_counts, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        langid.op1_language_id,
        decontaminate.op2_decontamination,
        token_counts.op3_token_counts,
        warc.op4_warc_revisits,
        bpe.op5_bpe,
        simhash.op6_simhash,
        repeats.op7_suffix_dedup,
        exact.op8_exact_dedup,
        licenses.op9_license_scan,
        secret_scan.op10_secret_scan,
        negatives.op11_hard_negatives,
        collocations.op12_collocations,
        jaccard.op13_ngram_jaccard,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontaminate.OP2_SQL, "op4_warc_revisits": warc.OP4_SQL, "op8_exact_dedup": exact.OP8_SQL, "op9_license_scan": licenses.OP9_SQL, "op11_hard_negatives": negatives.OP11_SQL, "op12_collocations": collocations.OP12_SQL, "op13_ngram_jaccard": jaccard.OP13_SQL}
