"""Connectors to exported provider pages: what a provider's pages mean, under one interface."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.sources import provider as P


@dataclass(frozen=True)
class Connector:
    """Tables of a provider's exported pages; a further provider is a further instance in ``CONNECTORS``."""

    name: str
    repositories: Callable[[DataFrame], DataFrame]
    trees: Callable[[DataFrame], DataFrame]
    history: Callable[[DataFrame], DataFrame]
    content: Callable[[Column], Column] = P.content_of


def _of(name: str, history: Callable[[DataFrame], DataFrame]) -> Connector:
    return Connector(name, lambda pages: P.provider_repositories(pages, name), lambda pages: P.provider_trees(pages, name), history)


def _by_files(pages: DataFrame) -> DataFrame:
    return P.history_pages(pages).drop("blob_sha")


CONNECTORS = {name: _of(name, history) for name, history in (("github", _by_files), ("gitea", _by_files), ("gitlab", P.change_pages), ("bitbucket", _by_files), ("azure", _by_files))}


def connector(name: str) -> Connector:
    if name not in CONNECTORS:
        raise ValueError(f"unknown provider {name!r}; known are {', '.join(sorted(CONNECTORS))}")
    return CONNECTORS[name]


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page, body, and what the folders key=value above a file say) of the JSON files of an export, each a page.

    The page number is the number in the file's name. Files are read by Spark, from any store that it reads.
    """
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", False).text(folder)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return rows.withColumn("page", F.regexp_extract(name, r"([0-9]+)[^0-9]*$", 1).try_cast("int")).withColumnRenamed("value", "body")
