"""Named queries over the derived contest tables and the SQL each is checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faceoff.operators import clean, longform, rating
from faceoff.session import path_state, shared_folder, write_and_reread
from faceoff.sources import derived
from faceoff.sources.games import game_schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Contests:
    """The given tables and the contest tables Spark derives from all of their rows.

    Pairing, maps and series are written once per session and folder into the shared folder and read back,
    as an ingestion job would store them: later queries then scan parquet with pushed filters and
    pruned columns instead of repeating the joins. The wide rows are projections of these narrow tables.
    """

    _written: dict[tuple, DataFrame] = {}

    def __init__(self, spark: SparkSession, folder: str, by_customer: bool = False) -> None:
        self.spark, self.folder, self.by_customer = spark, folder, by_customer

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        state = tuple(path_state(self.spark, f"{self.folder}/{t}.parquet") for t in derived.TABLES)
        key = (self.spark.sparkContext.applicationId, self.folder, state, self.by_customer, name)
        if key not in self._written:
            self._written[key] = write_and_reread(build(), f"contests-{name}")
        return self._written[key]

    def stored_csv(self, name: str, rows: DataFrame) -> str:
        """Folder of CSV files with a header that hold the columns of game files, in reverse order."""
        have = [n for n in reversed(game_schema().names) if n in rows.columns]
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        rows.select(*have).write.option("header", True).csv(path)
        return path

    def table(self, name: str) -> DataFrame:
        return derived.table(self.spark, self.folder, name)

    def derive(self, name: str) -> DataFrame:
        return derived.derive(self.spark, self.folder, name, self.by_customer)

    def pairing(self) -> DataFrame:
        return self.stored("pairing", lambda: self.derive("pairing"))

    def maps(self) -> DataFrame:
        return self.stored("maps", lambda: derived.maps(self.spark, self.folder, self.pairing()))

    def map_rows(self) -> DataFrame:
        return derived.map_rows(self.maps())

    def series_rows(self) -> DataFrame:
        return derived.series_rows(self.stored("series", lambda: derived.series(self.pairing(), self.maps())))

    def raw(self) -> DataFrame:
        return self.series_rows().unionByName(self.map_rows())

    def matches(self) -> DataFrame:
        return self.stored("matches", lambda: clean.load_series(self.raw()))

    def long(self) -> DataFrame:
        return longform.side_long(self.matches())

    def replay(self) -> DataFrame:
        """The K = 32 replay over one pool, with the contest columns reports need."""
        return self.stored("replay", lambda: rating.elo_replay(
            rating.one_pool(self.matches()), ["pool"]))


def query(name: str, sql: str | None = None):
    """Register ``fn(contests) -> DataFrame`` under ``name`` with its check SQL, if there is one."""
    def register(fn: Callable[[Contests], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")      # instants and dates agree
            return fn(Contests(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn
    return register


def with_tables(sql: str) -> str:
    """Put the derived tables in front of a check query as common table expressions."""
    from faceoff.plans.check_tables import CHECK_TABLES

    body = sql.strip()
    parts = [f"{k} AS ({v})" for k, v in derived.CHAIN.items()]
    parts += [f"{k} AS ({v})" if "(" not in k else f"{k} AS {v}" for k, v in CHECK_TABLES.items()]
    if body.upper().startswith("WITH "):
        parts.append(body[5:])
        return "WITH RECURSIVE " + ",\n".join(parts)
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
