"""Nested records: latest entries, features, criteria, concepts, presence, near-duplicates.

Three-valued throughout: what was not assessed stays null and is never taken for false.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.operators.joins import against_all


def latest_per_key(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row per key by the order; a maximum over structs, so nothing is gathered."""
    rest = [c for c in rows.columns if c not in by]
    key = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rest])
    return rows.groupBy(*by).agg(F.max(key).alias("_m")).select(*by, *[F.col(f"_m.{c}").alias(c) for c in rest])


def latest_timed(items: Column, time: str) -> Column:
    """The entry of the greatest time, the first of equal ones; without any time the last entry; null for none."""
    best = F.array_max(F.transform(items, lambda x: x[time]))
    timed = F.filter(items, lambda x: x[time] == best)
    return F.when(best.isNotNull(), F.get(timed, F.lit(0))).when(F.size(items) > 0, F.element_at(items, -1))


def latest_by_name(items: Column, name: str, time: str) -> Column:
    """Per name the entry that a strictly newer one would replace: the first of the greatest time, in order of first sight."""
    names = F.array_distinct(F.transform(items, lambda x: x[name]))
    return F.transform(names, lambda n: latest_timed(F.filter(items, lambda x: x[name] == n), time))


def features(record: DataFrame, key: str, numbers: Mapping[str, Column], flags: Mapping[str, Column]) -> DataFrame:
    """key, path, num, flag: one row per feature that is known."""
    kind = "struct<path:string,num:double,flag:boolean>"
    rows = [F.struct(F.lit(p).alias("path"), c.cast("double").alias("num"), F.lit(None).cast("boolean").alias("flag")).cast(kind) for p, c in numbers.items()]
    rows += [F.struct(F.lit(p).alias("path"), F.lit(None).cast("double").alias("num"), c.alias("flag")).cast(kind) for p, c in flags.items()]
    known = F.filter(F.array(*rows), lambda r: r["num"].isNotNull() | r["flag"].isNotNull())
    return record.select(key, F.inline(known))


def present(index: Column, path: Column, groups: Sequence[str]) -> Column:
    """Whether a path is present in a map path -> boolean: itself, or for a repeated group any entry of it."""
    parts = F.split(path, "[.]", 2)
    head, leaf = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    within = F.exists(
        F.map_entries(index), lambda e: e["key"].startswith(F.concat(head, F.lit("."))) & e["key"].endswith(F.concat(F.lit("."), leaf)) & e["value"]
    )
    return F.when(F.array_contains(F.map_keys(index), path), F.element_at(index, path)).when(head.isin(list(groups)) & leaf.isNotNull(), within).otherwise(F.lit(False))


def compares(op: Column, value: Column, limit: Column, high: Column | None = None) -> Column:
    """value op limit for > < >= <= =, and between low and high inclusive; null for another operator or a null value."""
    out = (
        F.when(op == ">", value > limit).when(op == "<", value < limit).when(op == ">=", value >= limit).when(op == "<=", value <= limit).when(op == "=", value == limit)
    )
    return out if high is None else out.when(op == "between", (value >= limit) & (value <= high))


def mapped_fields(criteria: DataFrame, synonyms: DataFrame) -> DataFrame:
    """criteria (field, ...) with path: that of the longest synonym within the field's text, null for none.

    synonyms (synonym, path) are a fixed list. Distinct fields meet it, not criteria.
    """
    fields = criteria.select("field").distinct()
    hit = fields.join(synonyms, F.instr(F.lower(F.trim("field")), F.col("synonym")) > 0)
    best = hit.groupBy("field").agg(F.max(F.struct(F.length("synonym").alias("n"), "synonym", "path")).alias("b")).select("field", "b.path")
    return criteria.join(best, "field", "left")


def area_question(
    records: DataFrame, openings: Mapping[str, str], facts: Mapping[str, Sequence[str]], bands: DataFrame, repeats: int = 1, prefix: str = "", suffix: str = ""
) -> DataFrame:
    """key, area, text: the question of each area about each record, its opening `repeats` times, then only the area's facts.

    records: key, age_days, gestation, setting, weight_now, weight_birth (grams), factors (array<struct<name, status>>),
    vitals (map of names to numbers). facts: area -> of age_band, age, gestation, setting, weight, factors, vitals. An
    unknown fact leaves no line; the current weight goes before that at birth, which is noted behind it.
    """
    listed = banded(records, bands, "age_days") if bands is not None else records.withColumn("band", F.lit(None).cast("string"))
    kilos = lambda c: F.regexp_replace(F.format_string("%.3f", F.col(c).cast("double") / 1000), r"\.?0+$", "")
    now, birth = F.col("weight_now"), F.col("weight_birth")
    note = F.when(now.isNull(), "birth weight").when(birth.isNotNull(), F.concat(F.lit("current weight; birth weight "), kilos("weight_birth"), F.lit(" kg"))).otherwise("current weight")
    weight = F.when(F.coalesce(now, birth).isNotNull(), F.concat(F.lit("Weight (kg): "), F.when(now.isNotNull(), kilos("weight_now")).otherwise(kilos("weight_birth")), F.lit(" ("), note, F.lit(")")))
    factors = F.array_join(F.transform(F.filter("factors", lambda f: f["status"] != "not assessed"), lambda f: F.concat_ws(": ", f["name"], f["status"])), "; ")
    vitals = F.array_join(F.transform(F.array_sort(F.map_entries("vitals")), lambda e: F.concat_ws(" ", e["key"], e["value"].cast("string"))), ", ")
    out = None
    for area, opening in openings.items():
        has = set(facts[area])
        aged = F.col("age_days").isNotNull()
        parts = []
        if "age_band" in has:
            parts.append(F.when(aged, F.concat_ws("", F.lit("is aged "), "age_days", F.lit(" days"), F.when(F.col("band").isNotNull(), F.concat(F.lit(" ("), "band", F.lit(")"))))))
        elif "age" in has:
            parts.append(F.when(aged, F.concat_ws(" ", F.lit("is"), "age_days", F.lit("days old"))))
        if "gestation" in has:
            parts.append(F.when(F.col("gestation").isNotNull(), F.concat_ws(" ", F.lit("born at"), F.col("gestation").cast("string"), F.lit("weeks gestation"))))
        if "setting" in has:
            parts.append(F.when(F.coalesce("setting", F.lit("")) != "", F.concat_ws(" ", F.lit("currently in"), "setting")))
        told = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
        lines = [F.lit(f"{prefix}{opening}{suffix}\n")] * repeats
        lines.append(F.when(F.size(told) > 0, F.concat(F.lit("The newborn patient "), F.array_join(told, ", "), F.lit("."))))
        lines.append(weight if "weight" in has else F.lit(None).cast("string"))
        lines.append(F.when(factors != "", F.concat(F.lit("Maternal risk factors: "), factors)) if "factors" in has else F.lit(None).cast("string"))
        lines.append(F.when(vitals != "", F.concat(F.lit("Vitals: "), vitals)) if "vitals" in has else F.lit(None).cast("string"))
        part = listed.select("key", F.lit(area).alias("area"), F.array_join(F.array_compact(F.array(*lines)), "\n").alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def snapshots(records: DataFrame, digest: Column) -> DataFrame:
    """mrn_hash, snapshot_no, record_id: the records of each patient, told by a keyed digest, in the order in which they came."""
    rows = records.select(digest.alias("mrn_hash"), "record_id", "ingested_at").distinct()
    order = Window.partitionBy("mrn_hash").orderBy(F.col("ingested_at").asc_nulls_first(), "record_id")
    return rows.withColumn("snapshot_no", F.row_number().over(order)).select("mrn_hash", "snapshot_no", "record_id")


def evaluated(criteria: DataFrame, known: DataFrame) -> DataFrame:
    """criteria (criterion_id, path, operator, value) against features (key, path, num): key, criterion_id, matched;
    matched is null where the path is unknown, the feature is absent or is no number."""
    every = against_all(criteria, known.select("key").distinct())
    joined = every.join(known.select("key", "path", "num"), ["key", "path"], "left")
    return joined.select("key", "criterion_id", compares(F.col("operator"), F.col("num"), F.col("value")).alias("matched"))


def concepts_of(known: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """key, concept of the vocabulary (concept, field, operator, low, high) that fire: thresholds, between, present (true
    only), value (any number). An absent field never fires."""
    joined = known.join(vocabulary, F.col("path") == F.col("field"))
    op = F.col("operator")
    fires = F.when(op == "present", F.col("flag")).when(op == "value", F.col("num").isNotNull()).otherwise(compares(op, F.col("num"), F.col("low"), F.col("high")))
    return joined.where(F.coalesce(fires, F.lit(False))).select("key", "concept")


def augmented(queries: DataFrame, fired: DataFrame) -> DataFrame:
    """queries (query_id, key, text) with the concepts of their key behind the text, in order, and whether any fired."""
    listed = fired.groupBy("key").agg(F.array_sort(F.collect_set("concept")).alias("terms"))
    joined = queries.join(listed, "key", "left")
    text = F.concat_ws("; ", "text", F.array_join("terms", "; "))
    return joined.select("query_id", F.when(F.col("terms").isNull(), F.col("text")).otherwise(text).alias("text"), F.col("terms").isNotNull().alias("fired"))


def stages(matches: DataFrame, least: int = 1) -> DataFrame:
    """key, stage: the only heading of which all evaluated criteria (at least so many) pass; uncertain for none or several.

    matches: key, heading, matched.
    """
    judged = matches.where("matched is not null").groupBy("key", "heading").agg(F.bool_and("matched").alias("all_pass"), F.count("*").alias("n"))
    winners = judged.where(F.col("all_pass") & (F.col("n") >= least)).groupBy("key").agg(F.count("*").alias("k"), F.min("heading").alias("heading"))
    keys = matches.select("key").distinct()
    return keys.join(winners, "key", "left").select("key", F.when(F.col("k") == 1, F.col("heading")).otherwise("uncertain").alias("stage"))


def missing_paths(required: DataFrame, index: DataFrame) -> DataFrame:
    """key, path, position: required paths (key, path, position) without a present entry (key, path), first place per path."""
    gone = required.join(index.select("key", "path").distinct(), ["key", "path"], "left_anti")
    return gone.groupBy("key", "path").agg(F.min("position").alias("position"))


def flat_presence(schema: T.StructType, prefix: str = "", column: Column | None = None) -> dict[str, Column]:
    """path -> whether it holds a value, for every leaf of a schema; lists count as held if they have an entry."""
    out: dict[str, Column] = {}
    for f in schema.fields:
        at = F.col(f.name) if column is None else column[f.name]
        name = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out |= flat_presence(f.dataType, f"{name}.", at)
        elif isinstance(f.dataType, T.ArrayType):
            out[name] = at.isNotNull() & (F.size(at) > 0)
        else:
            out[name] = at.isNotNull()
    return out


def presence_index(df: DataFrame, key: str) -> DataFrame:
    """key, field_index map<string, boolean> built from the schema."""
    paths = flat_presence(T.StructType([f for f in df.schema.fields if f.name != key]))
    return df.select(key, F.map_from_entries(F.array(*[F.struct(F.lit(p), c) for p, c in paths.items()])).alias("field_index"))


def banded(rows: DataFrame, bands: DataFrame, value: str) -> DataFrame:
    """rows with the band (low inclusive, high exclusive, null open) that holds their value; bands are a fixed list."""
    inside = (F.col("low").isNull() | (F.col(value) >= F.col("low"))) & (F.col("high").isNull() | (F.col(value) < F.col("high")))
    return rows.join(bands, inside, "left")


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of distinct sets (set_key, findings) with a Jaccard similarity of at least the threshold, both ways
    round and each with itself. Sets meet on their rarest elements (prefix filter), so every pair shares one."""
    counts = sets.select(F.explode("findings").alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    ordered = sets.select("set_key", F.explode("findings").alias("f")).join(counts, "f").groupBy("set_key").agg(F.array_sort(F.collect_list(F.struct("n", "f"))).alias("s"))
    keep = F.size("s") - F.ceil(F.size("s") * threshold).cast("int") + 1
    keys = ordered.select("set_key", F.explode(F.slice(F.transform("s", lambda x: x["f"]), 1, keep)).alias("f"))
    met = keys.select(F.col("set_key").alias("a"), "f").join(keys.select(F.col("set_key").alias("b"), "f"), "f").select("a", "b").distinct()
    both = met.join(sets.select(F.col("set_key").alias("a"), F.col("findings").alias("fa")), "a").join(sets.select(F.col("set_key").alias("b"), F.col("findings").alias("fb")), "b")
    jaccard = F.size(F.array_intersect("fa", "fb")) / F.size(F.array_union("fa", "fb"))
    return both.select("a", "b", jaccard.alias("similarity")).where(F.col("similarity") >= threshold)


def similar_records(rows: DataFrame, threshold: float, tolerances: Mapping[str, float]) -> DataFrame:
    """id_a < id_b of records (id, findings array, vitals...) alike in findings (Jaccard) and in every shared vital.

    Records with the same findings are one set while sets are compared, so a frequent finding joins sets, not records. A
    record without findings is like nothing.
    """
    keyed = rows.where(F.size("findings") > 0).withColumn("findings", F.array_sort(F.array_distinct("findings")))
    keyed = keyed.withColumn("set_key", F.array_join("findings", "\x01"))
    links = similar_sets(keyed.select("set_key", "findings").distinct(), threshold)
    vitals = list(tolerances)
    left = keyed.select(F.col("set_key").alias("a"), F.col("id").alias("id_a"), *[F.col(v).alias(f"{v}_a") for v in vitals])
    right = keyed.select(F.col("set_key").alias("b"), F.col("id").alias("id_b"), *[F.col(v).alias(f"{v}_b") for v in vitals])
    fits = F.col("id_a") < F.col("id_b")
    for name, within in tolerances.items():
        fits = fits & F.coalesce(F.abs(F.col(f"{name}_a") - F.col(f"{name}_b")) <= within, F.lit(True))
    return links.join(left, "a").join(right, "b").where(fits).select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


def similar_links(rows: DataFrame, threshold: float, tolerances: Mapping[str, float]) -> DataFrame:
    """id, n_links, closest of the records that similar_records() would link, without a row per pair of records.

    Records alike in findings and in every vital are one class, and classes meet: those of linked sets whose first vital
    lies in the same or a neighbouring bucket of its tolerance, or is unknown. What a class links to counts for all its
    records; copies of one record count as each other's links.
    """
    vitals = list(tolerances)
    keyed = rows.where(F.size("findings") > 0).withColumn("findings", F.array_sort(F.array_distinct("findings")))
    keyed = keyed.withColumn("set_key", F.array_join("findings", "\x01"))
    links = similar_sets(keyed.select("set_key", "findings").distinct(), threshold)
    classes = keyed.groupBy("set_key", *vitals).agg(F.count("*").alias("n")).withColumn("class", F.xxhash64("set_key", *vitals))
    first = vitals[0] if vitals else None
    # An unknown first vital fits any: such a class stands in the bucket -1 of every class besides its own place.
    bucket = F.floor(F.col(first) / tolerances[first]).cast("bigint") if first else F.lit(0).cast("bigint")
    left = classes.select(F.col("set_key").alias("a"), F.col("class").alias("class_a"), *[F.col(v).alias(f"{v}_a") for v in vitals], F.explode(F.when(bucket.isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("known"), bucket.alias("_k"))
    left = left.select("*", F.explode(F.when((F.col("known") == 1), F.array(F.col("_k") - 1, F.col("_k"), F.col("_k") + 1)).otherwise(F.array(F.lit(None).cast("bigint")))).alias("_bucket"))
    right = classes.select(F.col("set_key").alias("b"), F.col("class").alias("class_b"), F.col("n").alias("n_b"), *[F.col(v).alias(f"{v}_b") for v in vitals], bucket.alias("_bucket"))
    fits = F.lit(True)
    for name, within in tolerances.items():
        fits = fits & F.coalesce(F.abs(F.col(f"{name}_a") - F.col(f"{name}_b")) <= within, F.lit(True))
    near = links.join(left.where("known = 1"), "a").join(right.where("_bucket is not null"), ["b", "_bucket"])
    # A known value with an unknown one, and an unknown one with everything.
    half = links.join(left.where("known = 0 and _k is not null").drop("_bucket"), "a").join(right.where("_bucket is null").drop("_bucket"), "b")
    open_ = links.join(left.where("_k is null").drop("_bucket"), "a").join(right.drop("_bucket"), "b")
    columns = ["class_a", "class_b", "n_b", "similarity"]
    met = near.where(fits).select(*columns).unionByName(half.where(fits).select(*columns)).unionByName(open_.where(fits).select(*columns))
    own = (F.col("class_a") == F.col("class_b")).cast("bigint")
    counted = met.groupBy("class_a").agg(F.sum(F.col("n_b") - own).alias("n_links"), F.max(F.when((F.col("n_b") - own) > 0, F.col("similarity"))).alias("closest"))
    named = keyed.select("id", F.xxhash64("set_key", *vitals).alias("class_a"))
    return named.join(counted.where("n_links > 0"), "class_a").select("id", "n_links", F.round("closest", 6).alias("closest"))


def link_counts(pairs: DataFrame) -> DataFrame:
    """id, n_links, closest of the records that have links, from pairs id_a, id_b, similarity."""
    sides = F.array(F.col("id_a"), F.col("id_b"))
    return pairs.select(F.explode(sides).alias("id"), "similarity").groupBy("id").agg(F.count("*").alias("n_links"), F.max("similarity").alias("closest"))
