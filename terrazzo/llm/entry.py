"""Queries of the training-data operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query, module, function.
QUERIES = (
    ("op1_simhash", "simhash", "op1"),
    ("op2_line_dedup", "linededup", "op2"),
    ("op3_toxicity", "toxicity", "op3"),
    ("op4_spotsigs", "spotsigs", "op4"),
    ("op5_suffix_dedup", "suffixes", "op5"),
    ("op6_secrets", "secret_scan", "op6"),
    ("op7_embeddings", "embeddings", "op7"),
    ("op8_substring", "substring", "op8"),
    ("op9_mixing", "mixing", "op9"),
    ("op10_sentencepiece", "spiece", "op10"),
)


def _query(module: str, function: str):
    return getattr(import_module(f"terrazzo.llm.{module}"), function)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict:
    return {name: _query(module, function) for name, module, function in QUERIES} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    from terrazzo.llm import linededup, mixing

    return {"op2_line_dedup": linededup.ORACLE, "op9_mixing": mixing.ORACLE}
