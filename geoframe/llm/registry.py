"""Queries of this subpackage and, where SQL can express one, the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, decontaminate, lines, pii, quality, rlz, secrets, simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_neighbours": quality.op1_quality_neighbours,
    "op2_template_decontamination": decontaminate.op2_template_decontamination,
    "op3_tool_links": chat.op3_tool_links,
    "op4_nn_descent": ann.op4_nn_descent,
    "op5_substring_rlz": rlz.op5_substring_rlz,
    "op6_surrogates": pii.op6_surrogates,
    "op7_line_neighbourhood": lines.op7_line_neighbourhood,
    "op8_simhash_golay": simhash.op8_simhash_golay,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_secret_ownership": secrets.op10_secret_ownership,
}

ORACLES: dict[str, str] = {
    "op3_tool_links": chat.OP3_SQL,
    "op5_substring_rlz": rlz.OP5_SQL,
    "op7_line_neighbourhood": lines.OP7_SQL,
    "op10_secret_ownership": secrets.OP10_SQL,
}
