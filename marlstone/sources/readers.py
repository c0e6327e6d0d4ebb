"""Readers and writers: attribute CSV, wide uploads, JSON lines, upserts and patches, scoped tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hard limit of a listing.
MOST = 200


def eav_csv(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Attribute rows of a CSV with a header: key, field_name, field_value as text. A key's rows need not be adjacent."""
    schema = ", ".join(x for x in (extra, "key string, field_name string, field_value string") if x)
    return spark.read.schema(schema).option("header", True).option("emptyValue", "\x02").option("nullValue", "\x01").csv(path).replace("\x02", "")


def wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of which dotted headers become struct fields; an empty cell is null. Headers with two points or a bracket
    (lists) are an error."""
    flat = spark.read.option("header", True).csv(path)
    groups: dict[str, list[str]] = {}
    plain = []
    for name in flat.columns:
        head, _, leaf = name.partition(".")
        if "." in leaf or "[" in name:
            raise ValueError(f"column {name}: lists and deeper levels can't stand in a CSV")
        if leaf:
            groups.setdefault(head, []).append(leaf)
        else:
            plain.append(name)
    structs = [F.struct(*[F.col(f"`{head}.{leaf}`").alias(leaf) for leaf in leaves]).alias(head) for head, leaves in groups.items()]
    return flat.select(*[f"`{c}`" for c in plain], *structs)


def wide_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of a JSON list, or of an object with a list `records`."""
    envelope = T.StructType([*schema.fields, T.StructField("records", T.ArrayType(schema))])
    rows = spark.read.schema(envelope).option("multiLine", True).json(path)
    inside = rows.where("records is not null").select(F.inline("records"))
    return rows.where("records is null").drop("records").unionByName(inside)


class PatientSource(Protocol):
    """Anything that yields records as rows."""

    def records(self) -> DataFrame: ...


class TableSource:
    """Records of a table."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def records(self) -> DataFrame:
        return self.rows


class RestSource:
    """A pull from a service; none is configured."""

    def records(self) -> DataFrame:
        raise NotImplementedError("no service is configured")


def priorities(entries: DataFrame) -> DataFrame:
    """title, priority of entries with a title and a positive priority, the least per title, ordered."""
    kept = entries.where("title is not null and priority > 0")
    return kept.groupBy("title").agg(F.min("priority").alias("priority")).orderBy("priority", "title")


def newest(rows: DataFrame, equal: Mapping[str, object], order: Sequence[str], limit: int) -> DataFrame:
    """Rows with the values given, newest first, MOST at most."""
    for name, value in equal.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows.orderBy(*[F.col(c).desc() for c in order]).limit(min(limit, MOST))


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines under a schema; blank lines are skipped by the reader."""
    return spark.read.schema(schema).json(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(base)) if fs.exists(base) else []


def current(path: str) -> str:
    """The path of a table's last version, for any reader."""
    versions = _versions(SparkSession.getActiveSession(), path)
    if not versions:
        raise FileNotFoundError(path)
    return f"{path}/v{versions[-1]}"


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str]) -> None:
    """Replaces rows of the same key and adds the others, as a new version of the table; readers of the old one go on."""
    versions = _versions(spark, path)
    if versions:
        old = spark.read.parquet(f"{path}/v{versions[-1]}").join(rows.select(*keys), list(keys), "left_anti")
        rows = old.unionByName(rows)
    rows.write.parquet(f"{path}/v{(versions[-1] if versions else 0) + 1}")


def patched(rows: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the columns of patch where it has the key and a value."""
    names = [c for c in patch.columns if c not in keys]
    joined = rows.join(patch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in names]), list(keys), "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in rows.columns])


def scoped(rows: DataFrame, column: str, value: object) -> DataFrame:
    """The rows of one subject; without a subject none."""
    return rows.where(F.lit(False)) if value is None else rows.where(F.col(column) == F.lit(value))
