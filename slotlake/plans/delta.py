"""The delta table's loads: a ledger of what was appended, compacted in tiers.

Files of a load are a partition of the table `<table>_delta_loads`. The ledger tells
which partition holds which load, and the delta table is a view that names those
partitions. A change writes files, adds their partition, which nobody sees yet, makes
the next record of the ledger, and replaces the view: that one step shows the new and
hides the old. A query keeps the partitions that it was planned with, and their files
stay for a grace period.
"""

from __future__ import annotations

import re
import time
import uuid
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from slotlake.plans.commits import CommitLog
from slotlake.schema import delta_name
from slotlake.session import delete_path, path_exists

if TYPE_CHECKING:
    from slotlake.plans.lake import Lake

LOAD_ID = "load_id"
NUMBERED = r"(.*)-(0|[1-9]\d*)"


def loads_name(table: str) -> str:
    return f"{delta_name(table)}_loads"


class Ledger:
    """State: `loads` by id, each with its part, path and rows; `merged`, ids of loads
    that are in a compacted one; `upto`, by prefix the number up to which all ids
    `<prefix>-<number>` are; `hidden`, parts out of view, with path and time."""

    def __init__(self, lake: Lake, table: str):
        self.lake, self.table = lake, table
        self.spark = lake.spark
        self.log = CommitLog(lake.spark, f"{lake.root}/_ledger/{lake.database}/{table}")

    # --- the catalog's side ----------------------------------------------------

    def create(self) -> bool:
        """The loads table and the view over it; a no-op if they exist."""
        lake = self.lake
        if lake.exists(delta_name(self.table)):
            return False
        schema = lake.registry.get(self.table).struct
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        location = lake.new_location(delta_name(self.table))
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {lake.sql_name(loads_name(self.table))} ({columns}, {LOAD_ID} STRING) "
            f"USING parquet PARTITIONED BY ({LOAD_ID}) LOCATION '{location}'"
        )
        self.repair()
        return True

    def show(self) -> None:
        """Replace the view by what the ledger says, until the ledger stays the same."""
        lake, seen = self.lake, None
        names = ", ".join(f"`{f.name}`" for f in lake.registry.get(self.table).struct)
        while True:
            version, state = self.log.latest()
            if version == seen:
                return
            parts = sorted(x["part"] for x in state.get("loads", {}).values())
            lake.replace_view(
                delta_name(self.table),
                f"SELECT {names} FROM {lake.sql_name(loads_name(self.table))} "
                f"WHERE {LOAD_ID} IN ({', '.join(map(repr, parts or ['']))})",
            )
            seen = version

    def _add_part(self, part: str, path: str) -> None:
        name = loads_name(self.table)
        self.spark.sql(
            f"ALTER TABLE {self.lake.sql_name(name)} ADD IF NOT EXISTS "
            f"PARTITION ({LOAD_ID} = '{part}') LOCATION '{path}'"
        )
        self.spark.catalog.refreshTable(f"{self.lake.database}.{name}")

    def _parts(self) -> set[str]:
        rows = self.spark.sql(f"SHOW PARTITIONS {self.lake.sql_name(loads_name(self.table))}").collect()
        return {r[0].split("=", 1)[1] for r in rows}

    def repair(self) -> None:
        """Bring the view to what the ledger says, behind a driver that was lost."""
        _, state = self.log.latest()
        missing = {x["part"]: x["path"] for x in state.get("loads", {}).values()}
        if missing:
            for part in missing.keys() - self._parts():
                self._add_part(part, missing[part])
        self.show()

    # --- loads -----------------------------------------------------------------

    def known(self, state: dict, load: str) -> bool:
        """Whether a load is part of a compacted one."""
        hit = re.fullmatch(NUMBERED, load, re.DOTALL)
        if hit and int(hit[2]) <= state.get("upto", {}).get(hit[1], -1):
            return True
        return load in state.get("merged", [])

    def write(self, df: DataFrame) -> dict:
        """A part that nobody sees yet: name, path and rows."""
        part = uuid.uuid4().hex
        path = f"{self.lake.new_location(delta_name(self.table))}/{LOAD_ID}={part}"
        seen = Observation(f"load-{part}")
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        return {"part": part, "path": path, "rows": seen.get["rows"]}

    def append(self, df: DataFrame, load: str | None = None) -> bool:
        """Add rows as a load; see `register`. A load that was compacted is not even
        written again."""
        load = load or uuid.uuid4().hex
        return not self.known(self.log.latest()[1], load) and self.register(self.write(df), load)

    def register(self, part: dict, load: str) -> bool:
        """Make a written part the load of that id. One that has the id already is
        replaced by it; if it is in a compacted load by now, the part is dropped.
        Whether the part was taken."""
        self._add_part(part["part"], part["path"])

        def change(state: dict) -> dict:
            if self.known(state, load):
                return _hide(state, [part])
            loads = state.get("loads", {})
            return _hide(state | {"loads": loads | {load: part}}, [loads[load]] if load in loads else [])

        state = self.log.update(change)
        self.show()
        return part["part"] in [x["part"] for x in state["loads"].values()]

    def replace(self, df: DataFrame) -> None:
        """Only these rows from now on. An error while writing changes nothing. Ids of
        earlier loads are forgotten, so they can be loaded again."""
        part = self.write(df)
        self._add_part(part["part"], part["path"])
        own = {"loads": {f"replace:{part['part']}": part}, "merged": [], "upto": {}}
        self.log.update(lambda state: _hide(state | own, list(state.get("loads", {}).values())))
        self.show()

    def _merge(self, part: dict, group: dict[str, dict]) -> bool:
        """Show a written part in place of the loads it was made of, unless one of them
        was replaced meanwhile."""
        self._add_part(part["part"], part["path"])

        def change(state: dict) -> dict:
            loads = state.get("loads", {})
            if any(loads.get(load) != old for load, old in group.items()):
                return _hide(state, [part])
            kept = {load: x for load, x in loads.items() if load not in group}
            state = state | {"loads": kept | {f"compact:{part['part']}": part}}
            return _hide(_merged(state, list(group)), list(group.values()))

        state = self.log.update(change)
        self.show()
        return part["part"] in [x["part"] for x in state["loads"].values()]

    # --- compaction ------------------------------------------------------------

    def compact(self, fan_in: int | None = None) -> int:
        """Rewrite loads as one; how many loads there were when it began.

        With `fan_in`, only groups of that many loads of like size (a power of it) are
        rewritten, so a row is written again about log(rows) times in all. Loads that
        are added meanwhile are left alone, and so is a group of which one was
        replaced. Loads in a compacted one keep their ids: if they are repeated, they
        are known, and not added again.
        """
        self.repair()
        _, state = self.log.latest()
        loads = state.get("loads", {})
        groups = [sorted(loads)]
        if fan_in:
            tiers: dict[int, list[str]] = {}
            for load in sorted(loads):
                size, tier = max(1, loads[load]["rows"]), 0
                while size >= fan_in:
                    size, tier = size // fan_in, tier + 1
                tiers.setdefault(tier, []).append(load)
            groups = [g for g in tiers.values() if len(g) >= fan_in]
        schema = self.lake.registry.get(self.table).struct
        for group in groups:
            if len(group) > 1:
                # an empty load may have no file at all
                paths = [loads[k]["path"] for k in group if path_exists(self.spark, loads[k]["path"])]
                part = self.write(self.spark.read.schema(schema).parquet(*paths))
                self._merge(part, {k: loads[k] for k in group})
        return len(loads)

    def vacuum(self, grace_seconds: int) -> int:
        """Delete the parts that were hidden longer ago than the grace period."""
        limit = time.time() - grace_seconds
        _, state = self.log.latest()
        old = {part: x["path"] for part, x in state.get("hidden", {}).items() if x["since"] <= limit}
        if not old:
            return 0
        name = self.lake.sql_name(loads_name(self.table))
        for part, path in old.items():
            self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({LOAD_ID} = '{part}')")
            delete_path(self.spark, path)
        self.log.update(lambda s: s | {"hidden": {k: x for k, x in s["hidden"].items() if k not in old}})
        return len(old)


def _hide(state: dict, parts: list[dict]) -> dict:
    now = {x["part"]: {"path": x["path"], "since": time.time()} for x in parts}
    return state | {"hidden": state.get("hidden", {}) | now, "loads": state.get("loads", {})}


def _merged(state: dict, gone: list[str]) -> dict:
    """Remember the ids of loads that are now in another. Numbered ones are kept as one
    number a prefix, up to which none is missing, so the ledger does not grow with them."""
    merged = set(state.get("merged", [])) | {k for k in gone if not k.startswith(("compact:", "replace:"))}
    upto = dict(state.get("upto", {}))
    for prefix in {k.rpartition("-")[0] for k in merged if re.fullmatch(NUMBERED, k, re.DOTALL)}:
        last = upto.get(prefix, -1)
        while f"{prefix}-{last + 1}" in merged:
            last += 1
            merged.discard(f"{prefix}-{last}")
        if last >= 0:
            upto[prefix] = last
    return state | {"merged": sorted(merged), "upto": upto}
