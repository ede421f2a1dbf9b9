"""Queries with their SQL, and the views both sides derive from the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Views in SQL that Spark and DuckDB both run.
VIEWS: dict[str, str] = {}


def _named(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def _closure(sql: str) -> list[str]:
    """The views that a statement needs, in order of definition."""
    need: set[str] = set()
    todo = [sql]
    while todo:
        for n in _named(todo.pop(), VIEWS):
            if n not in need:
                need.add(n)
                todo.append(VIEWS[n])
    return [n for n in VIEWS if n in need]


def with_views(sql: str) -> str:
    """The statement with the views that it needs as common table expressions."""
    ctes = [f"{n} as ({VIEWS[n]})" for n in _closure(sql)]
    if not ctes:
        return sql
    body = sql.strip()
    recursive = "recursive " if re.search(r"using key", body) else ""
    if m := re.match(r"with (recursive )?", body):
        return f"with {recursive}{', '.join(ctes)}, {body[m.end():]}"
    return f"with {recursive}{', '.join(ctes)} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables below ``sf_dir``."""
    return run_sql(spark, sf_dir, f"select * from {name}")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    text = with_views(sql)
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(from|join)\s+{t}\b", text)}
    for t in used:
        text = re.sub(rf"\b(from|join)(\s+){t}\b", rf"\1\2{{{t}}}", text)
    return spark.sql(text, **used)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Register the function below under ``name``."""

        def keep(f):
            assert name not in self.queries, name
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = with_views(sql)
            return f

        return keep
