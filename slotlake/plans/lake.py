"""Main + delta tables with two main slots, behind one unified view.

Data files live under `root`; the catalog holds one table per slot, the delta table
and the view. A view replace is the swap: readers see the old slot or the new one,
never a mix, and running queries keep the files they planned with.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotlake.functions import rows as R
from slotlake.functions.records import delimiter_of
from slotlake.operators import numbering as N
from slotlake.plans.commits import CommitLog
from slotlake.plans.delta import Ledger, loads_name
from slotlake.schema import SLOTS, Registry, base_name, delta_name, main_name, other_slot
from slotlake.session import delete_path, literal_path, marked_before, path_exists, touch
from slotlake.sinks.files import write_rejects
from slotlake.sources.datasets import load_prebuilt
from slotlake.sources.delimited import Before, delimited_part, lines_part, source_parts

REJECTED = "rejected"
PART = "_part"
# Parts of files are written together up to so many bytes, or files, in all.
TOGETHER_BYTES, TOGETHER_FILES = 1 << 30, 1000
DROPPED = "_DROPPED"


class DuplicateImportError(RuntimeError):
    """An import of this table is already running."""


class ImportFailedError(RuntimeError):
    """The import stopped before its swap; the old data is still live."""


@dataclass(frozen=True)
class ImportReport:
    job_id: str
    table: str
    slot: str
    processed: int
    failed: int
    last_line: int


def _together(sizes: list[tuple[int, int, int]]) -> int:
    """How many of the parts (number, bytes, files) are written together; one at least."""
    n = size = count = 0
    for _, more, files in sizes:
        size, count = size + more, count + files
        if n and (size > TOGETHER_BYTES or count > TOGETHER_FILES):
            break
        n += 1
    return n


class Lake:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        registry: Registry,
        database: str = "default",
        grace_seconds: int = 3600,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.registry = registry
        self.database = database
        self.grace_seconds = grace_seconds
        if database != "default":
            spark.sql(
                f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{self.root}/_database'"
            )

    # --- names and places ----------------------------------------------------

    def sql_name(self, name: str) -> str:
        return f"`{self.database}`.`{name}`"

    @property
    def rejects_path(self) -> str:
        return f"{self.root}/_rejects/{self.database}"

    def new_location(self, name: str) -> str:
        """Every load gets its own directory, so files under a reader stay put."""
        return f"{self.root}/{self.database}/{name}/{uuid.uuid4().hex}"

    # --- tables --------------------------------------------------------------

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.database}.{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.sql_name(name))

    def schema_of(self, name: str) -> T.StructType:
        """Schema of a table as stored, else as declared for its base name."""
        if self.exists(name):
            return self.table(name).schema
        return self.registry.for_derived(name).struct

    def create_table(self, name: str, location: str | None = None) -> bool:
        """Typed table under the schema of its base name; a no-op if it exists. A delta
        table is a view over its loads (see `Ledger`)."""
        if name.endswith("_delta"):
            return self.delta(base_name(name)).create()
        schema = self.registry.for_derived(name).struct
        if self.exists(name):
            return False
        self.spark.catalog.createTable(
            f"{self.database}.{name}", path=location or self.new_location(name), source="parquet", schema=schema
        )
        return True

    def delta(self, table: str) -> Ledger:
        return Ledger(self, table)

    def rows_of(self, name: str) -> DataFrame:
        """Declared columns of a slot, delta or unified table."""
        return self.table(name).select(
            *[F.col(f"`{f.name}`") for f in self.registry.for_derived(name).struct]
        )

    def location_of(self, name: str) -> str:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.sql_name(name)}")
        return rows.where("col_name = 'Location'").head().data_type

    def drop_table(self, name: str, keep_files: bool = False) -> bool:
        """Drop a slot or delta table if it exists. `keep_files` leaves the data to
        queries that still read it; `vacuum` deletes it after the grace period."""
        if not self.exists(name):
            return False
        location = self.location_of(name)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.sql_name(name)}")
        if not keep_files:
            delete_path(self.spark, location)
        elif path_exists(self.spark, location):
            touch(self.spark, f"{location}/{DROPPED}")
        return True

    def vacuum(self, grace_seconds: int | None = None) -> int:
        """Delete the files of tables dropped longer ago than the grace period."""
        grace = self.grace_seconds if grace_seconds is None else grace_seconds
        gone = []
        for depth in ("*/*", "*/*/*"):
            pattern = f"{self.root}/{self.database}/{depth}/{DROPPED}"
            gone += marked_before(self.spark, pattern, grace)
        for location in gone:
            delete_path(self.spark, location)
        hidden = [
            self.delta(name).vacuum(grace) for name in self.registry.names() if self.exists(delta_name(name))
        ]
        return len(gone) + sum(hidden)

    def load_table(self, df: DataFrame, name: str) -> int:
        """Replace a table's rows by `df`; creates it if absent. Returns the rows."""
        if name.endswith("_delta"):
            self.create_table(name)
            self.delta(base_name(name)).replace(self._typed(name, df))
        else:
            location = self.new_location(name)
            self._typed(name, df).write.parquet(location)
            self.drop_table(name, keep_files=True)
            self.create_table(name, location)
        return self.table(name).count()

    def _typed(self, name: str, df: DataFrame) -> DataFrame:
        schema = self.registry.for_derived(name).struct
        return df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema])

    def append_delta(self, table: str, df: DataFrame, load_id: str | None = None) -> bool:
        """Live changes go to the delta table. A load that is repeated under its id
        replaces what it wrote before, or adds nothing if that was compacted. Whether
        the rows were taken."""
        self.create_table(delta_name(table))
        return self.delta(table).append(self._typed(delta_name(table), df), load_id)

    def compact_delta(self, table: str, fan_in: int | None = None) -> int:
        """Rewrite the delta table's loads as one, or, with `fan_in`, tier by tier;
        returns how many loads there were (see `Ledger.compact`). Rows may be appended,
        and loads repeated, at any time."""
        return self.delta(table).compact(fan_in)

    def tables(self) -> DataFrame:
        """Name, type and (for unified tables) active slot of everything here."""
        rows, hidden = [], {loads_name(name) for name in self.registry.names()}
        for t in self.spark.catalog.listTables(self.database):
            if t.isTemporary or t.name in hidden:
                continue
            unified = t.tableType == "VIEW" and t.name in self.registry.tables
            rows.append(
                (
                    t.name,
                    "distributed" if unified else "rt",
                    self.active_slot(t.name) if unified else "",
                )
            )
        return self.spark.createDataFrame(rows, "name string, type string, slot string")

    # --- slots ---------------------------------------------------------------

    def active_slot(self, table: str) -> str:
        """Live slot, empty if the table has no unified view yet."""
        if not self.exists(table):
            return ""
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.sql_name(table)}")
        hit = rows.where("col_name = 'View Text'").head()
        return next((s for s in SLOTS if hit and f"`{main_name(table, s)}`" in hit.data_type), "")

    def swap(self, table: str, slot: str) -> None:
        """Point the unified view at a main slot (and the delta), in one step."""
        if slot not in SLOTS:
            raise ValueError(f"slot must be one of {SLOTS}, got {slot!r}")
        names = ", ".join(f"`{f.name}`" for f in self.registry.get(table).struct)
        self.replace_view(
            table,
            f"SELECT {names} FROM {self.sql_name(main_name(table, slot))} "
            f"UNION ALL SELECT {names} FROM {self.sql_name(delta_name(table))}",
        )

    def replace_view(self, name: str, select: str) -> None:
        """Give a view its text in one step of the catalog. (CREATE OR REPLACE would drop
        it first, and be two.)"""
        if not self.exists(name):
            self.spark.sql(f"CREATE VIEW IF NOT EXISTS {self.sql_name(name)} AS {select}")
        self.spark.sql(f"ALTER VIEW {self.sql_name(name)} AS {select}")

    def rotate(self, table: str, new: str, old: str) -> None:
        """Make `new` live and drop `old`; both must be slots, and differ."""
        if new not in SLOTS or old not in SLOTS:
            raise ValueError("new and old slot must be 'a' or 'b'")
        if new == old:
            raise ValueError("new and old slot are the same")
        if not self.exists(main_name(table, new)):
            raise ValueError(f"{main_name(table, new)} does not exist")
        self.swap(table, new)
        self.drop_table(main_name(table, old), keep_files=True)
        self.vacuum()

    def ensure_tables(self, slots: dict[str, str] | None = None) -> None:
        """Main and delta tables and the view for every registered table; the other
        slot is dropped. Safe to repeat."""
        for name in self.registry.names():
            slot = (slots or {}).get(name) or self.active_slot(name) or "a"
            self.create_table(delta_name(name))
            self.create_table(main_name(name, slot))
            self.swap(name, slot)
            self.drop_table(main_name(name, other_slot(slot)), keep_files=True)

    # --- import --------------------------------------------------------------

    def read_source(
        self, table: str, path: str, method: str | None = None, header: bool | None = None
    ) -> DataFrame:
        """Converted rows of a source file: typed columns plus `_reject`.

        `bulk` parses quotes, detects ids and is strict about booleans; `indexer`
        splits plain lines, always makes new ids and takes any boolean.
        """
        return self._read(table, path, delimiter_of(path), method, header)[0].drop(N.FILE_NO)

    def _read(
        self, table: str, path: str | list[str], sep: str, method: str | None, header: bool | None,
        before: Before | None = None,
    ) -> tuple[DataFrame, list[tuple[str, Before]]]:
        """`read_source` of some of a source's files, and those that have records, with
        what comes before the next."""
        schema = self.registry.get(table)
        method = method or schema.import_method
        header = schema.has_header if header is None else header
        if method == "bulk":
            raw, after = delimited_part(self.spark, path, len(schema.columns), sep, header, before=before)
        elif method == "indexer":
            raw, after = lines_part(self.spark, path, sep, header, before)
        else:
            raise ValueError(f"unknown import method {method!r}")
        return R.convert_rows(raw, schema.columns, method == "indexer", (N.FILE_NO,)), after

    def load_part(self, converted: DataFrame, location: str) -> dict:
        """Write converted rows, good and rejected ones apart, in one pass; returns
        the counters of what was written."""
        seen = Observation(f"import-{uuid.uuid4().hex}")
        (
            converted.withColumn(REJECTED, F.col(R.REJECT).isNotNull())
            .observe(
                seen,
                F.count_if(~F.col(REJECTED)).alias("processed"),
                F.count_if(F.col(REJECTED)).alias("failed"),
                F.coalesce(F.max("line_no"), F.lit(0)).alias("last_line"),
            )
            .write.partitionBy(REJECTED)
            .parquet(location)
        )
        return seen.get

    def rejects(self, job_id: str | None = None) -> DataFrame:
        schema = f"{R.REJECT_DDL}, job_id string"
        if not path_exists(self.spark, self.rejects_path):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(self.rejects_path)
        return df.where(F.col("job_id") == job_id) if job_id else df

    def import_table(
        self,
        table: str,
        path: str,
        method: str | None = None,
        header: bool | None = None,
        max_failed: int | None = None,
        part_lines: int | None = None,
        resume: bool | None = False,
        part_bytes: int | None = None,
    ) -> ImportReport:
        """Load a file into the idle slot, then swap it in and drop the old slot.

        Until the swap nothing of the live table changes. Only one import of a table
        runs at a time; another is refused. `max_failed` turns too many rejects into
        a failure.

        The slot is built in parts: of whole files of about `part_bytes` bytes in all,
        each of which is read by its own part alone, whose numbers go on behind the
        parts before; or of `part_lines` lines each, for which each part reads the
        source again; or in one. Small parts of files are written many at a time (see
        `_build_by_files`). After parts are written, the job's record says so. A failure
        leaves the finished parts, and `resume` goes on behind them, in the same slot: the table it swaps in holds all parts. It is
        refused if there is no such job for this table and path, or if that one read
        the file otherwise; None resumes if there is one. With False an import starts
        anew and what an earlier job left is deleted.

        Every step is safe to repeat, so a job whose driver was lost at any point can be
        resumed after `unlock_import`; if that one is alive after all, its next step is
        refused.
        """
        if part_lines and part_bytes:
            raise ValueError("parts are either of lines or of files")
        how = {"method": method, "header": header, "part_lines": part_lines, "part_bytes": part_bytes}
        with self._only_import(table) as (job, save):
            again = job.get("status") == "failed" and job.get("path") == path
            if resume and not again:
                raise ImportFailedError(f"{table}: no failed import of {path} to resume")
            if again and resume is not False:
                if job["how"] != how:
                    raise ImportFailedError(f"{table}: {path} was begun with {job['how']}")
            else:
                if job.get("location") and job["status"] != "completed":
                    delete_path(self.spark, job["location"])
                slot = other_slot(self.active_slot(table))
                job = {
                    "job_id": uuid.uuid4().hex, "table": table, "path": path, "slot": slot,
                    "location": self.new_location(main_name(table, slot)), "how": how,
                    "parts": [], "processed": 0, "failed": 0, "last_line": 0, "upto": 0, "built": False,
                }
            try:
                save(job | {"status": "running", "error": ""})
                if not job["built"]:
                    self._build_slot(job, save, max_failed)
                self._finish_slot(job, save)
            except Exception as exc:
                if not job["parts"]:
                    delete_path(self.spark, job["location"])
                save(job | {"status": "failed", "error": str(exc).split("\n")[0]})
                raise
            save(job | {"status": "completed", "error": ""})
        self.drop_table(main_name(table, other_slot(job["slot"])), keep_files=True)
        self.vacuum()
        return ImportReport(
            job["job_id"], table, job["slot"], job["processed"], job["failed"], job["last_line"]
        )

    def _build_slot(self, job: dict, save: Callable[[dict], None], max_failed: int | None) -> None:
        """Write the parts behind those that the job has; counts each as it is done."""
        if job["how"]["part_bytes"]:
            return self._build_by_files(job, save, max_failed)
        part_lines = job["how"]["part_lines"]
        converted = self.read_source(job["table"], job["path"], job["how"]["method"], job["how"]["header"])
        while True:
            start = job["upto"]
            rest = R.after_line(converted, start) if start else converted
            if part_lines:
                rest = rest.where(F.col("line_no") <= start + part_lines)
            counts = self._add_part(job, rest, max_failed)
            job["upto"] = start + part_lines if part_lines else job["last_line"]
            full = part_lines and counts["processed"] + counts["failed"] == part_lines
            job["built"] = not part_lines or not (full or R.after_line(converted, job["upto"]).head(1))
            save(job | {"status": "running", "error": ""})
            if job["built"]:
                return

    def _build_by_files(self, job: dict, save: Callable[[dict], None], max_failed: int | None) -> None:
        """Parts of whole files. The list of files is written when the job begins, so a
        resume has the same parts; a part knows how many records and files come before
        it, and reads its own files only.

        Parts that follow each other are read and written together, in the same jobs of
        Spark, up to `TOGETHER_BYTES`; each has its own folder and counts. If that fails,
        half as many are tried, so that the parts ahead of a broken one are finished."""
        how, listed = job["how"], f"{job['location']}/_files"
        if not path_exists(self.spark, f"{listed}/_SUCCESS"):
            parts = source_parts(self.spark, job["path"], how["part_bytes"])
            parts.write.mode("overwrite").parquet(listed)
        schema = f"part bigint, path string, length bigint, {N.FILE} string"
        files = self.spark.read.schema(schema).parquet(listed)
        sizes = files.groupBy("part").agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))
        sizes = [tuple(r) for r in sizes.orderBy("part").collect()]
        sep, some = delimiter_of(job["path"]), len(sizes)
        if not sizes:  # says what an empty source is
            self._read(job["table"], [job["path"]], sep, how["method"], how["header"], Before())
            job["built"] = True
        while not job["built"]:
            rest = sizes[len(job["parts"]) :]
            numbers = [part for part, *_ in rest[: min(some, _together(rest))]]
            own = files.where(F.col("part").between(numbers[0], numbers[-1])).orderBy(N.FILE).collect()
            try:
                self._add_parts(job, numbers, own, sep, max_failed)
            except ImportFailedError:
                raise
            except Exception:
                if len(numbers) == 1:
                    raise
                some = len(numbers) // 2
                continue
            some = 2 * len(numbers)
            job["built"] = len(job["parts"]) == len(sizes)
            save(job | {"status": "running", "error": ""})

    def _add_parts(self, job: dict, numbers: list[int], files: list, sep: str, max_failed: int | None) -> None:
        """Write the parts of these numbers, and count those before the first that has
        too many rejects."""
        how, before = job["how"], Before(**job.get("before", {}))
        paths = [literal_path(f.path) for f in files]
        converted, after = self._read(job["table"], paths, sep, how["method"], how["header"], before)
        of, ends = {f[N.FILE]: f.part for f in files}, {}
        for file, end in after:
            ends[of[file]] = end
        folder = f"{job['location']}/parts-{len(job['parts']):05}"
        delete_path(self.spark, folder)  # of a run that stopped midway
        owner = F.lit([of[file] for file, _ in after]).cast("array<bigint>")
        rows = converted.withColumn(PART, F.get(owner, F.col(N.FILE_NO).cast("int") - 1)).drop(N.FILE_NO)
        rows = rows.withColumn(REJECTED, F.col(R.REJECT).isNotNull())
        rows.write.partitionBy(PART, REJECTED).parquet(folder)
        written = self.spark.read.schema(f"line_no bigint, {PART} bigint, {REJECTED} boolean").parquet(folder)
        counted = written.groupBy(PART, REJECTED).agg(F.count("*"), F.max("line_no")).collect()
        counts = {(part, bad): (n, last) for part, bad, n, last in counted}
        for k, number in enumerate(numbers):
            (good, good_last), (bad, bad_last) = (counts.get((number, bad), (0, 0)) for bad in (False, True))
            if max_failed is not None and job["failed"] + bad > max_failed:
                for late in numbers[k:] if k else ():
                    delete_path(self.spark, f"{folder}/{PART}={late}")
                if not k:
                    delete_path(self.spark, folder)
                raise ImportFailedError(f"{job['table']}: {job['failed'] + bad} rows rejected")
            job["parts"].append(f"{folder}/{PART}={number}")
            job["processed"] += good
            job["failed"] += bad
            job["last_line"] = max(job["last_line"], good_last, bad_last)
            if number in ends:
                job["before"] = asdict(ends[number])
                job["upto"] = ends[number].records

    def _add_part(self, job: dict, rows: DataFrame, max_failed: int | None) -> dict:
        part = f"{job['location']}/part-{len(job['parts']):05}"
        delete_path(self.spark, part)  # of a run that stopped midway
        counts = self.load_part(rows, part)
        failed = job["failed"] + counts["failed"]
        if max_failed is not None and failed > max_failed:
            delete_path(self.spark, part)
            raise ImportFailedError(f"{job['table']}: {failed} rows rejected")
        job["parts"].append(part)
        job["processed"] += counts["processed"]
        job["failed"] = failed
        job["last_line"] = max(job["last_line"], counts["last_line"])
        return counts

    def _finish_slot(self, job: dict, save: Callable[[dict], None]) -> None:
        """Make the parts a table, check its rows, store the rejects, and swap."""
        table, name = job["table"], main_name(job["table"], job["slot"])
        self.create_table(delta_name(table))
        if self.active_slot(table) == job["slot"] and self._is_at(name, job["location"]):
            return  # swapped by a driver that was lost right behind it
        bad = [f"{part}/{REJECTED}=true" for part in job["parts"]]
        bad = [part for part in bad if path_exists(self.spark, part)]
        if bad:
            rejects = self.spark.read.schema(f"{R.REJECT} {R.REJECT_TYPE}").parquet(*bad)
            if not self.rejects(job["job_id"]).head(1):
                write_rejects(rejects.select(f"{R.REJECT}.*"), self.rejects_path, job["job_id"])
            for part in bad:
                delete_path(self.spark, part)
        save(job | {"status": "running", "error": ""})  # nobody has taken the job over
        self.drop_table(name, keep_files=True)
        self.spark.catalog.createTable(
            f"{self.database}.{name}", path=job["location"], source="parquet",
            schema=self.registry.get(table).struct, recursiveFileLookup="true",
        )
        committed = self.table(name).count()
        if committed != job["processed"]:
            self.spark.sql(f"DROP TABLE {self.sql_name(name)}")
            raise ImportFailedError(
                f"{name}: {committed} rows committed, {job['processed']} converted"
            )
        self.swap(table, job["slot"])

    def _is_at(self, name: str, location: str) -> bool:
        """Whether a table's files are in the folder of that (unique) name."""
        folder = location.rstrip("/").rpartition("/")[2]
        return self.exists(name) and self.location_of(name).rstrip("/").endswith("/" + folder)

    # --- the record of a table's import ----------------------------------------

    def _imports(self, table: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.root}/_imports/{self.database}/{table}")

    @contextmanager
    def _only_import(self, table: str):
        """Claim the table's import record; gives the record of the import before and a
        function that writes it anew. Both the claim and every write are the next
        record of a log, which only one caller can make."""
        log, owner, before = self._imports(table), uuid.uuid4().hex, {}

        def claim(state: dict) -> dict:
            if state.get("status") == "running":
                raise DuplicateImportError(f"{table}: an import is running; see unlock_import()")
            before.clear()
            before.update(state)
            return state | {"table": table, "status": "running", "owner": owner}

        def held(state: dict) -> bool:
            return state.get("status") == "running" and state.get("owner") == owner

        def save(job: dict) -> None:
            def write(state: dict) -> dict:
                if not held(state):
                    raise ImportFailedError(f"{table}: another import has taken over")
                return job | {"owner": owner}

            log.update(write)

        log.update(claim)
        try:
            yield dict(before), save
        finally:
            log.update(lambda state: {"status": "idle"} | before if held(state) else None)

    def unlock_import(self, table: str) -> None:
        """Take the import from a driver that is lost; its job counts as failed and can
        be resumed."""
        taken = {"status": "failed", "error": "the import was interrupted"}
        self._imports(table).update(lambda state: state | taken if state.get("status") == "running" else None)

    def import_jobs(self) -> DataFrame:
        """The record of the last import of each table."""
        path = f"{self.root}/_imports/{self.database}"
        schema = (
            "job_id string, table string, path string, slot string, status string, error string, "
            "processed bigint, failed bigint, last_line bigint"
        )
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        records = self.spark.read.schema(schema).json(f"{path}/*/*.json")
        row = F.struct(*records.columns)
        newest = records.groupBy("table").agg(F.max_by(row, "_metadata.file_name").alias("job"))
        return newest.select("job.*").where("job_id IS NOT NULL")

    def import_prebuilt(self, table: str, path: str) -> str:
        """Load a published dataset into the idle slot and swap it in."""
        schema = self.registry.get(table).struct
        new = other_slot(self.active_slot(table))
        df = load_prebuilt(self.spark, path, schema)
        self.create_table(delta_name(table))
        self.load_table(df, main_name(table, new))
        self.swap(table, new)
        self.drop_table(main_name(table, other_slot(new)), keep_files=True)
        self.vacuum()
        return new
