"""Declared table schemas: logical column types, registry, derived names."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from slotlake.session import read_small_text

# The closed list of logical column types with the server DDL type
# each one stands for.
DDL_TYPES = {
    "field": "text",
    "field_string": "text",
    "attr_uint": "uint",
    "attr_bigint": "bigint",
    "attr_float": "float",
    "attr_bool": "bool",
    "attr_timestamp": "timestamp",
    "attr_string": "string",
    "attr_multi": "multi",
    "attr_multi_64": "multi64",
    "attr_json": "json",
}

SPARK_TYPES: dict[str, T.DataType] = {
    "field": T.StringType(),
    "field_string": T.StringType(),
    "attr_uint": T.LongType(),
    "attr_bigint": T.LongType(),
    "attr_float": T.DoubleType(),
    "attr_bool": T.BooleanType(),
    "attr_timestamp": T.LongType(),
    "attr_string": T.StringType(),
    "attr_multi": T.ArrayType(T.LongType()),
    "attr_multi_64": T.ArrayType(T.LongType()),
    "attr_json": T.StringType(),
}

STRING_TYPES = frozenset({"field", "field_string", "attr_string"})
NUMERIC_TYPES = frozenset({"attr_uint", "attr_bigint", "attr_float", "attr_timestamp"})

# Import behaviour when a table says nothing.
DEFAULT_IMPORT_METHOD = "bulk"
DEFAULT_CLUSTER_MAIN = True
DEFAULT_HA_STRATEGY = "nodeads"
DEFAULT_RETRY_COUNT = 0
DEFAULT_MEM_LIMIT = "2G"

SLOTS = ("a", "b")


class SchemaError(ValueError):
    """The declared schema is not usable."""


@dataclass(frozen=True)
class Column:
    name: str
    type: str

    @property
    def is_string(self) -> bool:
        return self.type in STRING_TYPES

    @property
    def is_numeric(self) -> bool:
        return self.type in NUMERIC_TYPES


def columns_of(*pairs: tuple[str, str]) -> list[Column]:
    return validate([Column(n, t) for n, t in pairs])


def validate(columns: list[Column]) -> list[Column]:
    if not columns:
        raise SchemaError("there is no column")
    for i, col in enumerate(columns):
        if not col.name:
            raise SchemaError(f"column {i} has empty name")
        if col.type not in DDL_TYPES:
            raise SchemaError(f"column {col.name!r} has unknown type {col.type!r}")
    return columns


def struct_type(columns: list[Column]) -> T.StructType:
    """Spark schema of a table: `id` first, logical type kept as metadata."""
    fields = [T.StructField("id", T.LongType())]
    fields += [
        T.StructField(c.name, SPARK_TYPES[c.type], metadata={"logical_type": c.type})
        for c in columns
    ]
    return T.StructType(fields)


def create_table_text(table: str, columns: list[Column]) -> str:
    """DDL text in the server's own type names."""
    parts = ["id bigint"] + [f"{c.name} {DDL_TYPES[c.type]}" for c in columns]
    return f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(parts)})"


# --- derived names -----------------------------------------------------------


def main_name(table: str, slot: str) -> str:
    return f"{table}_main_{slot}"


def delta_name(table: str) -> str:
    return f"{table}_delta"


def base_name(table: str) -> str:
    for suffix in (*(f"_main_{s}" for s in SLOTS), "_delta"):
        if table.endswith(suffix):
            return table[: -len(suffix)]
    return table


def other_slot(slot: str | None) -> str:
    """The slot an import may write: `b` while `a` is live, else `a`."""
    return "b" if slot == "a" else "a"


# --- configuration -----------------------------------------------------------


def parse_columns(text: str) -> list[Column]:
    try:
        doc = json.loads(text)
    except json.JSONDecodeError as exc:
        raise SchemaError(f"parsing config JSON: {exc}") from exc
    raw = doc.get("columns") or [] if isinstance(doc, dict) else []
    return validate([Column(c.get("name", ""), c.get("type", "")) for c in raw])


def load_columns(path: str, spark: SparkSession | None = None) -> list[Column]:
    """Column list of one table from a JSON file."""
    return parse_columns(read_small_text(spark, path))


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: list[Column]
    import_method: str = DEFAULT_IMPORT_METHOD
    cluster_main: bool = DEFAULT_CLUSTER_MAIN
    ha_strategy: str = DEFAULT_HA_STRATEGY
    agent_retry_count: int = DEFAULT_RETRY_COUNT
    mem_limit: str = DEFAULT_MEM_LIMIT
    has_header: bool | None = None

    @property
    def struct(self) -> T.StructType:
        return struct_type(self.columns)


@dataclass
class Registry:
    """Table name -> schema and behaviour; derived names resolve to their base."""

    tables: dict[str, TableSchema] = field(default_factory=dict)

    def add(self, schema: TableSchema) -> "Registry":
        validate(schema.columns)
        self.tables[schema.name] = schema
        return self

    def names(self) -> list[str]:
        return sorted(self.tables)

    def get(self, name: str) -> TableSchema:
        if name not in self.tables:
            raise KeyError(f"{name} is not a registered table")
        return self.tables[name]

    def for_derived(self, name: str) -> TableSchema:
        base = base_name(name)
        if base not in self.tables:
            raise KeyError(f"{name}: its base {base} is not registered")
        return self.tables[base]

    def to_df(self, spark: SparkSession) -> DataFrame:
        """Registry as a small frame, for joins by base name."""
        rows = [
            (t.name, t.import_method, t.cluster_main, t.ha_strategy,
             t.agent_retry_count, t.mem_limit, t.has_header, len(t.columns))
            for t in (self.tables[n] for n in self.names())
        ]
        return spark.createDataFrame(
            rows,
            "name string, import_method string, cluster_main boolean, "
            "ha_strategy string, agent_retry_count int, mem_limit string, "
            "has_header boolean, n_columns int",
        )


def parse_registry(text: str) -> Registry:
    """Registry from a YAML map of tables (JSON is a subset and needs no YAML
    package)."""
    try:
        doc = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as exc:  # pragma: no cover - depends on the image
            raise SchemaError("a YAML registry needs the yaml package") from exc
        doc = yaml.safe_load(text)
    registry = Registry()
    for name, body in (doc or {}).items():
        cfg = body.get("config") or {}
        cols = (body.get("schema") or {}).get("columns") or []
        keep = {
            "import_method": cfg.get("importMethod") or None,
            "cluster_main": cfg.get("clusterMain"),
            "ha_strategy": cfg.get("haStrategy") or None,
            "agent_retry_count": cfg.get("agentRetryCount"),
            "mem_limit": cfg.get("memLimit") or None,
            "has_header": cfg.get("hasHeader"),
        }
        registry.add(
            TableSchema(
                name=name,
                columns=[Column(c.get("name", ""), c.get("type", "")) for c in cols],
                **{k: v for k, v in keep.items() if v is not None},
            )
        )
    return registry


def load_registry(path: str, spark: SparkSession | None = None) -> Registry:
    return parse_registry(read_small_text(spark, path))


def parse_datasets(text: str) -> list[tuple[str, str]]:
    """Dataset configuration: JSON map table -> source path, sorted by name."""
    return sorted(json.loads(text).items())
