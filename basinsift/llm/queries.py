"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basinsift.llm import ann, hard_negatives, lattice_lm, line_dedup, packing, periodic, pieces, quality, simhash, sketch, toxicity, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": sketch.op1_fingerprints,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_packing": packing.op3_packing,
        "op4_nearest": ann.op4_nearest,
        "op5_warc": warc.op5_warc,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_simhash": simhash.op7_simhash,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_quality": quality.op9_quality,
        "op10_lattice_lm": lattice_lm.op10_lattice_lm,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_periodic_runs": periodic.op12_periodic_runs,
        "op13_line_dedup": line_dedup.op13_line_dedup,
        # Columns of two of them that SQL can express.
        "fingerprints_edited": sketch.fingerprints_edited,
        "lattice_base": lattice_lm.lattice_base,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.OP2_SQL,
        "op5_warc": warc.OP5_SQL,
        "op11_hard_negatives": hard_negatives.OP11_SQL,
        "op13_line_dedup": line_dedup.OP13_SQL,
        "fingerprints_edited": sketch.EDITED_SQL,
        "lattice_base": lattice_lm.BASE_SQL,
    }
