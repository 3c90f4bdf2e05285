"""Model registry and cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cache_repos(files: DataFrame) -> DataFrame:
    """A row for each repository in a cache listing (path, size): ``models--owner--name`` folders, bytes and files."""
    repo = F.regexp_extract("path", r"/models--([^/]+)/", 1)
    return files.select(F.replace(repo, F.lit("--"), F.lit("/")).alias("repo"), "size", "path").where("repo != ''").groupBy("repo").agg(F.sum("size").alias("bytes"), F.count("*").alias("files"), F.bool_or(F.col("path").endswith(".incomplete")).alias("incomplete"))


def model_status(registry: DataFrame, cache: DataFrame) -> DataFrame:
    """Each registered model with what the cache has: ready, partial or missing."""
    joined = registry.join(cache, "repo", "left")
    state = F.when(F.col("files").isNull(), F.lit("missing")).when(F.col("incomplete") | (F.col("bytes") < F.coalesce("expected_bytes", F.lit(0))), F.lit("partial")).otherwise(F.lit("ready"))
    return joined.select(*registry.columns, F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("files", F.lit(0)).alias("files"), state.alias("state"))


def orphans(registry: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached repositories that no registered model uses."""
    return cache.join(registry.select("repo"), "repo", "left_anti")


def all_required_ready(status: DataFrame) -> DataFrame:
    """One row: whether every required model is ready; true without any."""
    return status.where("required").agg(F.coalesce(F.bool_and(F.col("state") == "ready"), F.lit(True)).alias("ready"), F.count_if(F.col("state") != "ready").alias("missing"))


def resolve(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """The repository of each requested model: by name or alias, else itself if it is a path; else null, as remote names aren't taken."""
    names = registry.select(F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("model"), F.col("repo").alias("found"))
    local = F.when(F.col("model").startswith("/") | F.col("model").startswith("./"), F.col("model"))
    return requests.join(names.dropDuplicates(["model"]), "model", "left").select(*requests.columns, F.coalesce("found", local).alias("repo"))
