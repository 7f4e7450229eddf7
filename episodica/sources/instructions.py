"""Versioned instruction texts: files P_<major>_<minor>.md and an append-only registry table."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = r"P_(\d+)_(\d+)\.md$"
REGISTRY = "instruction_id string, version string, body string, sha256 string, notes string, created_by string"
AUDIT = "audit_id long, principal string, action string, resource_type string, resource_id string, after string, request_id string"


class InstructionConflict(ValueError):
    """A version registered with another text."""


def version_of(name: str) -> str:
    m = re.search(NAME, name)
    if not m:
        raise ValueError(f"{name!r} isn't named P_<major>_<minor>.md")
    return f"P/{m[1]}.{m[2]}"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(version, sha256, text) of every instruction file."""
    rows = spark.read.option("pathGlobFilter", "P_*_*.md").text(folder, wholetext=True).withColumn("file", F.input_file_name())
    part = lambda k: F.regexp_extract("file", NAME, k)
    return rows.filter(F.col("file").rlike(NAME)).select(F.concat(F.lit("P/"), part(1), F.lit("."), part(2)).alias("version"), F.sha2("value", 256).alias("sha256"), F.col("value").alias("text"))


class Registry:
    """Two small tables under a folder; registering an equal text again changes nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _table(self, name: str, ddl: str) -> DataFrame:
        from .store import read

        held = read(self.spark, self.root, name)
        return held if held is not None else self.spark.createDataFrame([], ddl)

    def _append(self, name: str, ddl: str, row: tuple) -> None:
        self.spark.createDataFrame([row], ddl).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def register(self, version: str, text: str, sha256: str, principal: str, notes: str | None = None, request_id: str | None = None) -> str:
        own = hashlib.sha256(text.encode()).hexdigest()
        if own != sha256:
            raise ValueError(f"{version} comes with {sha256} but its text has {own}")
        if held := self.get(version):
            if held["sha256"] != own:
                raise InstructionConflict(f"{version} is registered with {held['sha256']}; register a new version")
            return held["instruction_id"]
        name = f"ins_{own[:16]}"
        self._append("instructions", REGISTRY, (name, version, text, own, notes, principal))
        last = self._table("audit", AUDIT).agg(F.coalesce(F.max("audit_id"), F.lit(0))).first()[0]
        after = f'{{"lines": {len(text.splitlines()) or 1}, "sha256": "{own}", "version": "{version}"}}'
        self._append("audit", AUDIT, (last + 1, principal, "instruction.register", "instruction", name, after, request_id))
        return name

    def _one(self, where) -> dict | None:
        row = self._table("instructions", REGISTRY).filter(where).first()
        return row.asDict() if row else None

    def get(self, version: str) -> dict | None:
        return self._one(F.col("version") == version)

    def get_by_hash(self, sha256: str) -> dict | None:
        return self._one(F.col("sha256") == sha256)

    def load(self, version: str) -> str:
        if not (held := self.get(version)):
            raise KeyError(f"no registered instruction {version!r}")
        return held["body"]

    def versions(self) -> list[str]:
        return [r[0] for r in self._table("instructions", REGISTRY).select("version").orderBy("version").collect()]

    def audit_records(self, resource_id: str) -> DataFrame:
        return self._table("audit", AUDIT).filter(F.col("resource_id") == resource_id).orderBy("audit_id")
