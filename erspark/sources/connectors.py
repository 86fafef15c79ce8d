"""Named connectors behind one interface; stores are reached by Spark's own readers."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Connector:
    """Base: ``read`` gives a DataFrame, ``write`` takes one; settings may come from the environment."""

    prefix = ""

    def __init__(self, spark: SparkSession, **settings):
        self.spark, self.settings = spark, settings

    def setting(self, name: str, default: str | None = None) -> str | None:
        return self.settings.get(name) or os.environ.get(f"{self.prefix}_{name}".upper()) or default

    def read(self, table: str | None = None, query: str | None = None) -> DataFrame:
        raise NotImplementedError

    def write(self, df: DataFrame, table: str, mode: str = "append") -> None:
        raise NotImplementedError


class JdbcConnector(Connector):
    """Any JDBC store; large tables are read in parallel by ``partition_column``."""

    url = ""

    def options(self) -> dict:
        return {k: v for k, v in {"url": self.setting("url", self.url), "user": self.setting("user"), "password": self.setting("password"), "driver": self.setting("driver"),
                                  "fetchsize": self.setting("fetchsize", "10000")}.items() if v}

    def read(self, table=None, query=None, partition_column=None, lower=None, upper=None, partitions=None):
        r = self.spark.read.format("jdbc").options(**self.options())
        if partition_column:
            r = r.options(partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions or 16)
            return r.option("dbtable", table or f"({query}) q").load()
        return r.option("query", query).load() if query else r.option("dbtable", table).load()

    def write(self, df, table, mode="append"):
        w = df.write.format("jdbc").options(**self.options()).option("dbtable", table)
        w.option("truncate", mode == "replace").mode("overwrite" if mode == "replace" else "append").save()

    def table_exists(self, table: str) -> bool:
        try:
            self.read(table).schema
        except Exception:
            return False
        return True

    def get_row_count(self, table: str) -> int:
        return self.read(table).count()


class PostgresConnector(JdbcConnector):
    prefix = "POSTGRES"


class SnowflakeConnector(JdbcConnector):
    prefix = "SNOWFLAKE"


class BigQueryConnector(JdbcConnector):
    prefix = "BIGQUERY"


class CatalogConnector(Connector):
    """Tables of Spark's own catalogue."""

    def read(self, table=None, query=None):
        return self.spark.sql(query) if query else self.spark.table(table)

    def write(self, df, table, mode="append"):
        df.write.mode("overwrite" if mode == "replace" else "append").saveAsTable(table)

    def list_tables(self) -> list[str]:
        return [t.name for t in self.spark.catalog.listTables()]


class _RestReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.names = options, schema.names

    def partitions(self):
        return [InputPartition(i) for i in range(int(self.options.get("pages", "1")))]

    def read(self, partition):
        import json
        from urllib.request import Request, urlopen

        url = self.options["url"].replace("{page}", str(partition.value + int(self.options.get("firstPage", "1"))))
        headers = json.loads(self.options.get("headers", "{}"))
        body = self.options.get("body")
        with urlopen(Request(url, data=body.encode() if body else None, headers=headers), timeout=60) as r:
            found = json.load(r)
        for step in filter(None, self.options.get("path", "").split(".")):
            found = found[step]
        for row in found:
            yield tuple(None if (v := row.get(n)) is None else v if isinstance(v, str) else json.dumps(v) for n in self.names)


class RestSource(DataSource):
    """``spark.read.format("erspark_rest")``: pages of a JSON service (REST or a GraphQL body), a task a page."""

    @classmethod
    def name(cls):
        return "erspark_rest"

    def schema(self):
        return ", ".join(f"`{c}` string" for c in self.options["columns"].split(","))

    def reader(self, schema):
        return _RestReader(dict(self.options), schema)


class RestConnector(Connector):
    """Services such as CRMs: options ``url``, ``columns``, ``path``, ``pages``, ``headers``, ``body``."""

    prefix = "REST"

    def read(self, table=None, query=None):
        self.spark.dataSource.register(RestSource)
        return self.spark.read.format("erspark_rest").options(**{k: str(v) for k, v in self.settings.items()}).load()


REGISTRY: dict[str, Callable[..., Connector]] = {
    "postgres": PostgresConnector, "snowflake": SnowflakeConnector, "bigquery": BigQueryConnector, "jdbc": JdbcConnector,
    "databricks": CatalogConnector, "duckdb": CatalogConnector, "catalog": CatalogConnector, "hubspot": RestConnector, "salesforce": RestConnector, "rest": RestConnector, "graphql": RestConnector,
}


def register_connector(name: str, build: Callable[..., Connector]) -> None:
    REGISTRY[name] = build


def connector(name: str, spark: SparkSession, **settings) -> Connector:
    if name not in REGISTRY:
        raise ValueError(f"no such connector: {name}")
    return REGISTRY[name](spark, **settings)


def golden_to_source(source: DataFrame, golden: DataFrame, membership: DataFrame, columns: list[str], key: str = "__row_id__") -> DataFrame:
    """``source`` with ``columns`` of its members overwritten by their golden record."""
    g = golden.select("__cluster_id__", *(F.col(c).alias(f"__g_{c}") for c in columns))
    out = source.join(membership, key, "left").join(g, "__cluster_id__", "left")
    return out.withColumns({c: F.coalesce(f"__g_{c}", c) for c in columns}).drop("__cluster_id__", *(f"__g_{c}" for c in columns))


def materialize_table(spark: SparkSession, source: str, target: str, config=None, part: str = "golden", **how) -> None:
    """A table of the catalog deduplicated into another, as a step of a transformation project: golden records, clusters or membership."""
    from erspark import api

    r = api.dedupe_df(spark.table(source), config, **how)
    getattr(r, part).write.mode("overwrite").saveAsTable(target)
