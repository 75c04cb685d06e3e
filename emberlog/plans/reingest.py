"""Ingests of growing or changing folders that read only the files that changed.

A folder `out` holds versions. Each version adds the records, diagnostics and stats of the
files it read, and a manifest: for every source that is there, the file's time and
length, the profile, and the version that read it. The manifest is written last; a
version without a complete one counts for nothing and is written again. Nothing stored is
changed or deleted, so readers of an older version are not disturbed. One writer at a time.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..profile import Profile, to_json
from ..session import prepared
from .ingest import IngestResult

MANIFEST = "session_id string, source_path string, path string, modified timestamp, length long, made_by string, read_in long"
KINDS = ("records", "diagnostics", "stats")


@dataclass(frozen=True)
class Reingest:
    """The version that holds now, and how many files were read, were as before, and have gone."""

    version: int
    read: int
    kept: int
    gone: int


def escaped(paths: list[str]) -> list[str]:
    """Paths of single files as Spark's readers take them, which would expand some characters."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]


def latest_version(spark: SparkSession, out: str) -> int:
    """The number of the last complete version; 0 if there is none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{out}/manifest/version=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return max((int(re.search(r"version=(\d+)", str(f.getPath()))[1]) for f in found), default=0)


def manifest(spark: SparkSession, out: str, version: int) -> DataFrame:
    if version == 0:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest/version={version}")


def listing(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_path, path, modified, length) of files; no contents are read."""
    m = F.col("_metadata")
    return prepared(spark).read.format("binaryFile").load(paths).select(m["file_path"].alias("source_path"), "path", m["file_modification_time"].alias("modified"), m["file_size"].alias("length"))


def reingest(spark: SparkSession, paths: str | list[str], profile: Profile, out: str, session_id: str = "default", **more) -> Reingest:
    """Brings out up to date with the files at paths, as one session; other sessions in out stay.

    A file is read if it is new, if its time or length differ, or if it was read by
    another profile or other options; a file that is replaced within the resolution of times by one of the
    same length goes unseen. Files that have gone leave the session. If nothing differs,
    nothing is written and no contents are read. Names of changed files pass through the
    driver, as those of any Spark read.
    """
    from ..sources.registry import ingest

    version = latest_version(spark, out)
    made_by = hashlib.sha256(f"{to_json(profile)} {sorted(more.items())}".encode()).hexdigest()
    before = manifest(spark, out, version)
    own = before.where(F.col("session_id") == session_id).drop("path")
    there = listing(spark, paths).withColumn("made_by", F.lit(made_by))
    same = [*there.drop("path").columns]
    kept = there.join(own, same).select("session_id", "source_path", "path", "modified", "length", "made_by", "read_in")
    changed = there.join(own, same, "left_anti")
    names = sorted(r["path"] for r in changed.select("path").collect())
    as_before = there.count() - len(names)
    gone = own.join(there.select("source_path"), "source_path", "left_anti").count()
    if not names and not gone:
        return Reingest(version, 0, as_before, 0)
    new = version + 1
    if names:
        result = ingest(spark, escaped(names), profile, session_id, **more).once()
        for kind in KINDS:
            getattr(result, kind).write.mode("overwrite").parquet(f"{out}/{kind}/version={new}")
    read = changed.select(F.lit(session_id).alias("session_id"), "source_path", "path", "modified", "length", "made_by", F.lit(new).cast("long").alias("read_in"))
    others = before.where(F.col("session_id") != session_id)
    others.unionByName(kept).unionByName(read).write.mode("overwrite").parquet(f"{out}/manifest/version={new}")
    return Reingest(new, len(names), as_before, gone)


def current(spark: SparkSession, out: str, version: int | None = None) -> IngestResult:
    """What a version (the last, if none is given) holds. Only folders of versions that it uses are read."""
    version = latest_version(spark, out) if version is None else version
    if version == 0:
        raise ValueError(f"nothing is stored under {out}")
    used = manifest(spark, out, version).select("session_id", "source_path", "read_in")
    versions = sorted(r["read_in"] for r in used.select("read_in").distinct().collect())

    def of(kind: str) -> DataFrame:
        # The schema is known from any version; a version that no source refers to is not listed.
        rows = spark.read.option("basePath", f"{out}/{kind}").parquet(*[f"{out}/{kind}/version={v}" for v in versions] or [f"{out}/{kind}"])
        keys = [rows["session_id"] == used["session_id"], rows["source_path"] == used["source_path"], rows["version"] == used["read_in"]]
        return rows.join(used, keys, "left_semi").drop("version")

    return IngestResult(of("records"), lambda: of("diagnostics"), lambda: of("stats"))


def vanished(spark: SparkSession, out: str, version: int) -> DataFrame:
    """(session_id, record_id) of records of the version before that this one lacks. Only sources that changed or went are looked at."""
    keys = ["session_id", "record_id"]
    if version <= 1:
        return spark.createDataFrame([], "session_id string, record_id string")
    old, new = manifest(spark, out, version - 1), manifest(spark, out, version)
    place = ["session_id", "source_path"]
    left = old.join(new, [*place, "read_in"], "left_anti").select(*place)
    came = new.where(F.col("read_in") == version).select(*place)
    was = current(spark, out, version - 1).records.join(left, place, "left_semi").select(*keys)
    now = current(spark, out, version).records.join(came, place, "left_semi").select(*keys)
    return was.join(now, keys, "left_anti")


def state_after(state: DataFrame, spark: SparkSession, out: str, version: int) -> DataFrame:
    """The analyst state (see operators.state) of records that are still there in this version."""
    return state.join(vanished(spark, out, version), ["session_id", "record_id"], "left_anti")
