"""Immutable builds: tables first, then a manifest, then the pointer readers follow."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "2.0"
POINTER = "version bigint, build_id string, index_identity string"
MANIFEST = "build_id string, schema_version string, status string, settings string, tables array<string>"


def identity(settings: dict, length: int = 20) -> str:
    """Hash of the settings that decide a build's content."""
    canonical = json.dumps(settings, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(canonical.encode()).hexdigest()[:length]


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def pointer(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Version and id of the active build; one small row reaches the driver."""
    row = _read(spark, f"{root}/current", POINTER).agg(F.max(F.struct("version", "build_id")).alias("p")).first()
    return (row.p.version, row.p.build_id) if row and row.p else (0, None)


def stage(spark: SparkSession, root: str, tables: dict[str, DataFrame], settings: dict) -> str:
    """Write the tables of a build.  The active build is never overwritten; an inactive one is rewritten."""
    build_id = identity(settings)
    if pointer(spark, root)[1] == build_id:
        raise RuntimeError(f"build {build_id} is active and will not be overwritten")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{root}/build_id={build_id}/{name}")
    _manifest(spark, root, build_id, "CORPUS_READY", settings, sorted(tables))
    return build_id


def _manifest(spark: SparkSession, root: str, build_id: str, status: str, settings: dict, names: list[str]) -> None:
    row = [(build_id, SCHEMA_VERSION, status, json.dumps(settings, sort_keys=True), names)]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/build_id={build_id}/manifest")


def manifest(spark: SparkSession, root: str, build_id: str) -> DataFrame:
    return _read(spark, f"{root}/build_id={build_id}/manifest", MANIFEST)


def publish(spark: SparkSession, root: str, build_id: str, indexes: dict[str, DataFrame], index_settings: dict) -> str:
    """Add index tables, mark the build READY and append the pointer; the append is the commit."""
    staged = manifest(spark, root, build_id).first()
    if staged is None or staged.status != "CORPUS_READY":
        raise RuntimeError(f"build {build_id} is not staged")
    for name, table in indexes.items():
        table.write.mode("overwrite").parquet(f"{root}/build_id={build_id}/{name}")
    index_identity = identity({"build_id": build_id, **index_settings})
    settings = {**json.loads(staged.settings), **index_settings, "index_identity": index_identity}
    _manifest(spark, root, build_id, "READY", settings, sorted({*staged.tables, *indexes}))
    version = pointer(spark, root)[0] + 1
    spark.createDataFrame([(version, build_id, index_identity)], POINTER).coalesce(1).write.mode("append").json(f"{root}/current")
    return index_identity


def read(spark: SparkSession, root: str, name: str, require_ready: bool = True) -> DataFrame:
    """A table of the active build, after checking its schema version and readiness."""
    build_id = pointer(spark, root)[1]
    if build_id is None:
        raise RuntimeError("no active build")
    row = manifest(spark, root, build_id).first()
    if row is None or row.schema_version != SCHEMA_VERSION:
        raise RuntimeError("the active build has another schema version")
    if require_ready and row.status != "READY":
        raise RuntimeError("the active build is not READY")
    return spark.read.parquet(f"{root}/build_id={build_id}/{name}")
