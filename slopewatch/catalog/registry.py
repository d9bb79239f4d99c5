"""Registry of the queries and the tables they run on."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slopewatch.catalog.views import SPARK_NAMES, TABLES, VIEWS
from slopewatch.session import bounded_tasks, prepare

Build = Callable[["Frames"], DataFrame]
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


# Plans of tables and views (never data), kept per application and folder.
_PLANS: dict[tuple[str, str], dict[str, DataFrame]] = {}


class Frames:
    """The tables of one data folder and the stand-in views over them, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = bounded_tasks(prepare(spark))
        self.sf_dir = sf_dir
        key = (spark.sparkContext.applicationId, sf_dir)
        self._made = _PLANS.setdefault(key, {})
        if any(df.sparkSession is not spark for df in self._made.values()):
            self._made = _PLANS[key] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = VIEWS[name]
                for theirs, ours in SPARK_NAMES.items():
                    text = text.replace(theirs, ours)
                needs = used_names(text)
                self._made[name] = self.spark.sql(
                    re.sub(r"\b(" + "|".join(needs) + r")\b(?!\.)", r"{\1}", text) if needs else text,
                    **{n: self[n] for n in needs},
                )
        return self._made[name]


def used_names(text: str) -> list[str]:
    """Tables and views a statement reads from."""
    known = set(TABLES) | set(VIEWS)
    found = re.findall(r"\b(?:from|join)\s+([a-z_]+)", text, flags=re.I)
    return [n for n in dict.fromkeys(found) if n in known]


def with_views(text: str) -> str:
    """Prefix a statement with the stand-in views it needs, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order or name in TABLES:
            return
        for need in used_names(VIEWS[name]):
            add(need)
        order.append(name)

    for name in used_names(text):
        add(name)
    if not order:
        return text
    ctes = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    body = text.strip()
    if body.lower().startswith("with recursive "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query and, where SQL can express it, its counterpart."""

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = with_views(sql)
        return build

    return register


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Build) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(Frames(spark, sf_dir))

    return {name: bind(build) for name, build in QUERIES.items()}
