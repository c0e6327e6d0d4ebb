"""Entity-attribute-value rows into one typed row per entity, by log-structured upserts.

Rows of one batch of loading become a sparse wide delta per entity: a map from attribute to cell, each cell with the
version (loaded_at, row_id) of its last row. Runs of deltas compact cell by cell to the latest version; a compacted run
is a delta like any other, so later batches merge into it without the older rows.

Defined cases: keys match without outer blanks, attributes without case, outer blanks and with blank or hyphen for
underscore; rows with a null or blank key, or an attribute outside the field list, hold no cell; a null loaded_at is
the earliest version; repeated rows change nothing; an empty table gives an empty result with all columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut, small_rows

# Marks of a missing value, and readings of booleans and sexes.
NULL_MARKS = ["", "none", "null", "na", "n/a", "nan"]
TRUE = ["true", "1", "yes", "y", "t"]
FALSE = ["false", "0", "no", "n", "f"]
SEXES = {"m": "male", "male": "male", "f": "female", "female": "female"}
SQL_TYPES = {"int": "int", "double": "double", "boolean": "boolean", "sex": "string", "timestamp": "timestamp_ntz", "string": "string"}
MOST_FIELDS = 2000

OUTER = r"(?U)^\s+|\s+$"


@dataclass(frozen=True)
class Field:
    name: str
    value_type: str
    unit: str | None = None
    transform: str | None = None
    family: str | None = None


def fields(spec: DataFrame) -> list[Field]:
    """The field list; its size is fixed by the form that it describes, not by the data."""
    rows = small_rows(spec.select("field_name", "value_type", "unit", "transform_name", "family").distinct(), MOST_FIELDS)
    return [Field(*r) for r in sorted(rows, key=lambda r: r.field_name)]


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, OUTER, "")


def field_key(name: Column) -> Column:
    """An attribute name in the field list's spelling."""
    return F.translate(F.lower(stripped(name)), " -", "__")


def is_null_mark(value: Column) -> Column:
    return value.isNull() | F.lower(stripped(value)).isin(NULL_MARKS)


def as_number(value: Column, unit: str | None, whole: bool) -> Column:
    """A number of digits with a sign at most, one point or comma inside, the unit behind; else null."""
    text = F.lower(stripped(value))
    if unit:
        text = F.when(text.endswith(unit.lower()), stripped(F.substring(text, F.lit(1), F.length(text) - len(unit)))).otherwise(text)
    shape = r"^[+-]?[0-9]+$" if whole else r"^[+-]?[0-9]+([.,][0-9]+)?$"
    return F.when(text.rlike(shape), F.replace(text, F.lit(","), F.lit(".")).try_cast("int" if whole else "double"))


def as_boolean(value: Column) -> Column:
    text = F.lower(stripped(value))
    return F.when(text.isin(TRUE), True).when(text.isin(FALSE), False)


def as_sex(value: Column) -> Column:
    text = F.lower(stripped(value))
    out = F.lit(None).cast("string")
    for name, sex in SEXES.items():
        out = F.when(text == name, sex).otherwise(out)
    return out


def as_timestamp(value: Column) -> Column:
    """A day alone, or with a blank or T and hours and minutes, seconds at will (T only with seconds); else null."""
    text = stripped(value)
    day, minute, second = r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}:[0-9]{2}", r":[0-9]{2}"
    full = (
        F.when(text.rlike(rf"^{day}$"), F.concat(text, F.lit(" 00:00:00")))
        .when(text.rlike(rf"^{day} {minute}$"), F.concat(text, F.lit(":00")))
        .when(text.rlike(rf"^{day}[ T]{minute}{second}$"), F.translate(text, "T", " "))
    )
    return F.try_to_timestamp(full, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def typed(value: Column, field: Field) -> Column:
    """The readable value of a field, or null. Null marks are not readable."""
    kind = field.value_type
    if kind in ("int", "double"):
        out = as_number(value, field.unit, kind == "int")
    elif kind == "boolean":
        out = as_boolean(value)
    elif kind == "sex":
        out = as_sex(value)
    elif kind == "timestamp":
        out = as_timestamp(value)
    else:
        out = stripped(value)
    return F.when(~is_null_mark(value), out)


def reading(value: Column, field: Column, listed: Sequence[Field]) -> Column:
    """The readable value in one spelling, as text, by the type of the row's field."""
    groups: dict[tuple[str, str | None], list[str]] = {}
    for f in listed:
        groups.setdefault((f.value_type, f.unit), []).append(f.name)
    out = F.lit(None).cast("string")
    for (kind, unit), names in groups.items():
        out = F.when(field.isin(names), typed(value, Field("", kind, unit)).cast("string")).otherwise(out)
    return out


def upserts(rows: DataFrame, listed: Sequence[Field]) -> DataFrame:
    """record_key, batch, field, cell of every row that holds one; batch is the day of loading."""
    key = stripped(F.col("key"))
    name = field_key(F.col("field_name"))
    kept = rows.select(key.alias("record_key"), name.alias("field"), "field_value", "loaded_at", "row_id").where(
        (F.col("record_key") != "") & F.col("field").isin([f.name for f in listed])
    )
    value = reading(F.col("field_value"), F.col("field"), listed)
    state = F.when(is_null_mark(F.col("field_value")), "missing").when(F.col("reading").isNotNull(), "readable").otherwise("unreadable")
    return kept.withColumn("reading", value).select(
        "record_key",
        F.to_date("loaded_at").alias("batch"),
        "field",
        F.struct("loaded_at", "row_id", "reading", state.alias("state")).alias("cell"),
    )


def _latest(cells: DataFrame, by: list[str], first: bool) -> DataFrame:
    least = F.min("cell.reading") if first else F.min("least")
    most = F.max("cell.reading") if first else F.max("most")
    return cells.groupBy(*by).agg(F.max("cell").alias("cell"), least.alias("least"), most.alias("most"))


def deltas(rows: DataFrame, listed: Sequence[Field]) -> DataFrame:
    """record_key, batch, cells: one sparse wide delta per entity and batch.

    Cells aggregate before the shuffle; a delta holds at most one cell per listed field.
    """
    cells = _latest(upserts(rows, listed), ["record_key", "batch", "field"], first=True)
    entry = F.struct("field", F.struct("cell", "least", "most"))
    return cells.groupBy("record_key", "batch").agg(F.map_from_entries(F.collect_list(entry)).alias("cells"))


def compact(runs: DataFrame) -> DataFrame:
    """record_key, field, cell, least, most: the latest version of each cell over all runs of deltas, with the least and
    greatest readable value ever loaded."""
    cells = runs.select("record_key", F.explode("cells").alias("field", "entry")).select("record_key", "field", "entry.*")
    return _latest(cells, ["record_key", "field"], first=False)


def as_run(compacted: DataFrame) -> DataFrame:
    """A compacted run in the form of a delta, to merge with later batches."""
    entry = F.struct("field", F.struct("cell", "least", "most"))
    return compacted.groupBy("record_key").agg(
        F.to_date(F.max("cell.loaded_at")).alias("batch"), F.map_from_entries(F.collect_list(entry)).alias("cells")
    )


def found(compacted: DataFrame) -> DataFrame:
    """record_key, field_name, kind: cells whose last row is unreadable, cells with different readable values."""
    unreadable = F.when(F.col("cell.state") == "unreadable", F.lit("unreadable"))
    conflict = F.when(F.col("least") != F.col("most"), F.lit("conflict"))
    kinds = F.explode(F.array_compact(F.array(unreadable, conflict)))
    return compacted.select("record_key", F.col("field").alias("field_name"), kinds.alias("kind"))


def wide(rows: DataFrame, compacted: DataFrame, records: DataFrame, listed: Sequence[Field]) -> DataFrame:
    """record_key, patient_id, a typed column per listed field, maternal_risk_factors: one row per record key.

    Weights in kg come out in grams. A risk factor is present, absent, or not assessed where its last value is missing
    or unreadable. patient_id is that of the record ingested last with one; keys without a record have none. Keys whose
    rows hold no listed field have a row of nulls.
    """
    keys = rows.select(stripped(F.col("key")).alias("record_key")).where("record_key != ''").distinct()
    columns = []
    for f in listed:
        value = F.max(F.when(F.col("field") == f.name, F.col("cell.reading"))).cast(SQL_TYPES[f.value_type])
        columns.append((F.round(value * 1000, 1) if f.transform == "kg_to_g" else value).alias(f.name))
    shaped = compacted.groupBy("record_key").agg(*columns) if columns else compacted.select("record_key").distinct()
    patients = (
        records.where("patient_id is not null")
        .groupBy(stripped(F.col("record_key")).alias("record_key"))
        .agg(F.max(F.struct("ingested_at", "patient_id")).alias("last"))
        .select("record_key", F.col("last.patient_id").alias("patient_id"))
    )
    factors = [f.name for f in listed if f.family == "maternal_risk_factors"]
    status = [
        F.struct(
            F.lit(n).alias("name"),
            F.when(F.col(n), "present").when(~F.col(n), "absent").otherwise("not assessed").alias("status"),
        )
        for n in factors
    ]
    risk = F.array(*status) if status else F.array().cast("array<struct<name:string,status:string>>")
    out = keys.join(shaped, "record_key", "left").join(patients, "record_key", "left")
    return out.select("record_key", "patient_id", *[f.name for f in listed], risk.alias("maternal_risk_factors"))


def compacted_cells(rows: DataFrame, listed: Sequence[Field]) -> DataFrame:
    """The whole path: deltas written as a run, then compacted."""
    return compact(cut(deltas(rows, listed)))


def nested(wide_rows: DataFrame, spec: DataFrame, identity: dict[str, str], defaults: dict[str, str] | None = None) -> DataFrame:
    """One nested record per row of wide(), by the targets of the field list: record_key, schema_version, dataset_provenance,
    record_id, mrn, single values under their path's struct, vitals as a list, families as lists of what was assessed,
    date_of_birth.

    spec: field_name, target, family, value_type (a settings table). `vitals.0.x` targets make one entry of vitals with
    recorded_at from the admission; an entry without any value is none. A family lists its members that were assessed,
    present or not; what wasn't is left out, never false. date_of_birth is the admission less the days of life.
    identity: templates with {key} for record_id and mrn, and plain values for schema_version and dataset_provenance;
    defaults fill top-level text paths that no field gave.
    """
    rows = small_rows(spec.select("field_name", "target", "family", "value_type").distinct(), MOST_FIELDS)
    single: dict[str, list] = {}
    families: dict[str, list[str]] = {}
    plain = []
    for r in sorted(rows, key=lambda r: r.field_name):
        if r.family is not None:
            families.setdefault(r.target, []).append(r.field_name)
        elif "." in r.target:
            head, leaf = r.target.split(".", 1)
            single.setdefault(head, []).append((leaf.removeprefix("0."), r.field_name))
        else:
            plain.append((r.target, r.field_name))
    columns = [F.col("record_key")]
    for name, template in identity.items():
        before, _, after = template.partition("{key}")
        value = F.concat(F.lit(before), "record_key", F.lit(after)) if "{key}" in template else F.lit(template)
        columns.append(value.alias(name))
    columns += [F.col(field).alias(target) for target, field in plain]
    admitted, days = None, None
    for head, leaves in single.items():
        entry = F.struct(*[F.col(field).alias(leaf) for leaf, field in leaves])
        known = F.lit(False)
        for _, field in leaves:
            known = known | F.col(field).isNotNull()
        if head == "vitals":
            at = next((f for leaf, f in single.get("encounter", []) if leaf == "admitted_at"), None)
            stamped = F.struct(*[F.col(field).alias(leaf) for leaf, field in leaves], (F.col(at) if at else F.lit(None).cast("timestamp_ntz")).alias("recorded_at"))
            columns.append(F.filter(F.array(F.when(known, stamped)), lambda v: v.isNotNull()).alias("vitals"))
        else:
            columns.append(F.when(known, entry).alias(head))
        if head == "encounter":
            places = dict(leaves)
            admitted, days = places.get("admitted_at"), places.get("day_of_life")
    for target, members in families.items():
        items = F.array(*[F.when(F.col(m).isNotNull(), F.struct(F.lit(m).alias("name"), F.col(m).alias("present"))) for m in members])
        columns.append(F.array_compact(items).alias(target))
    if admitted and days:
        columns.append(F.date_sub(F.to_date(admitted), F.col(days)).alias("date_of_birth"))
    columns += [F.lit(v).alias(n) for n, v in (defaults or {}).items() if n not in {t for t, _ in plain} | set(single) | set(families)]
    return wide_rows.select(*columns)
