"""Snapshots of slot and delta tables: back up, list, restore."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotlake.functions.names import last_segment
from slotlake.plans.lake import Lake
from slotlake.schema import SLOTS, delta_name, main_name, other_slot
from slotlake.session import folders_with, literal_path, path_exists
from slotlake.sources.datasets import MissingDatasetError, load_prebuilt

SUFFIX = ".parquet"


def snapshot_stamp(now: datetime | None = None) -> str:
    return (now or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H-%M-%SZ")


def backup(lake: Lake, name: str, root: str, now: datetime | None = None) -> str:
    """Write `<root>/<table>-<UTC time>.parquet`; returns its name. Two snapshots in
    one second get different names."""
    stem = f"{name}-{snapshot_stamp(now)}"
    filename, n = f"{stem}{SUFFIX}", 1
    while path_exists(lake.spark, f"{root}/{filename}"):
        n += 1
        filename = f"{stem}-{n}{SUFFIX}"
    lake.rows_of(name).write.parquet(f"{root}/{filename}")
    return filename


def list_snapshots(spark: SparkSession, root: str, table: str, kind: str) -> DataFrame:
    """Completed snapshots of a table, newest first: filename, key, size, time.

    `kind` is `main` or `delta`. A snapshot is complete once its folder holds the
    success marker; only the files of such folders are listed, none is read.
    """
    prefix = f"{table}_main_" if kind == "main" else f"{table}_delta-"
    done = folders_with(spark, f"{root}/{literal_path(prefix)}*{SUFFIX}/_SUCCESS")
    if not done:
        return spark.createDataFrame([], "filename string, key string, size bigint, last_modified timestamp")
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .load([literal_path(folder) for folder in done])
        .select("path", "length", "modificationTime")
    )
    parent = F.regexp_replace("path", r"/[^/]*\z", "")
    name = last_segment(parent)
    return (
        files.groupBy(name.alias("filename"), parent.alias("key"))
        .agg(
            F.sum("length").alias("size"),
            F.max("modificationTime").alias("last_modified"),
        )
        .orderBy(F.desc("last_modified"), F.desc("filename"))
    )


def slot_of_snapshot(filename: str, table: str) -> str:
    hit = re.search(re.escape(table) + "_main_(.)", filename)
    if not hit:
        raise ValueError(f"no slot in the snapshot name {filename}")
    if hit.group(1) not in SLOTS:
        raise ValueError(f"{filename} names no known slot")
    return hit.group(1)


def restore(lake: Lake, table: str, root: str, filename: str, kind: str = "main") -> str:
    """Bring a snapshot back. A delta is replaced in place; a main table goes to the
    idle slot, is swapped in, and the slot that was live is dropped."""
    schema = lake.registry.get(table).struct
    path = f"{root}/{filename}"
    if kind == "delta":
        if not filename.startswith(delta_name(table) + "-"):
            raise MissingDatasetError(f"{filename} is not a snapshot of {delta_name(table)}")
        df = load_prebuilt(lake.spark, path, schema)
        lake.load_table(df, delta_name(table))
        return delta_name(table)
    slot_of_snapshot(filename, table)
    df = load_prebuilt(lake.spark, path, schema)
    old = lake.active_slot(table)
    new = other_slot(old)
    lake.create_table(delta_name(table))
    lake.load_table(df, main_name(table, new))
    lake.rotate(table, new, other_slot(new))
    return main_name(table, new)
