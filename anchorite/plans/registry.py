"""All queries of the entity-linking engine, by operator id, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from . import model, queries_code, queries_link, queries_sql, spark_forms

INPUTS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "embeddings")


def run_sql(spark: SparkSession, sf_dir: str, query: str | tuple[str, str]) -> DataFrame:
    """A query over the tables of a folder; only those that it names are opened."""
    text = model.sql(query, spark=True)
    for name in INPUTS:
        if f" {name}" in text:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text)


def _query(text: str | tuple[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, text)


def _texts() -> dict[str, str | tuple[str, str]]:
    """All SQL queries; a later definition of an operator takes the place of an earlier one."""
    return queries_sql.QUERIES | queries_link.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    code = {name: partial(q, run_sql) for name, q in queries_code.QUERIES.items()}
    return {name: _query(text) for name, text in (_texts() | spark_forms.QUERIES).items()} | code


def oracles() -> dict[str, str]:
    out = dict(queries_code.ORACLES)
    for name, text in _texts().items():
        q = model.sql(text, spark=False)
        for a, b in queries_sql.ORACLE_WORDS.items():
            q = q.replace(a, b)
        out[name] = q
    return out
