"""Predicates and policies on payload columns, null-safe where a null must pass or fail.

Defined cases: a null status never fits a list; a null review status passes an exclusion; policies without an exact row
fall back to the wildcard, then to deny.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Review states that keep a chunk from retrieval.
NOT_RETRIEVABLE = ["pending", "rejected", "excluded"]
MASK = "***"


def payload(
    statuses: Sequence[str] = (), any_tags: Sequence[str] = (), titles: Sequence[str] = (), not_titles: Sequence[str] = (),
    documents: Sequence[str] = (), not_review: Sequence[str] = (),
) -> Column:
    """The conjunction of the conditions given, over columns status, topic_tags, document_title, document_id, review_status."""
    out = F.lit(True)
    if statuses:
        out = out & F.col("status").isin(list(statuses))
    if any_tags:
        out = out & F.arrays_overlap("topic_tags", F.array(*[F.lit(t) for t in any_tags]))
    if titles:
        out = out & F.col("document_title").isin(list(titles))
    if not_titles:
        out = out & (F.col("document_title").isNull() | ~F.col("document_title").isin(list(not_titles)))
    if documents:
        out = out & F.col("document_id").isin(list(documents))
    if not_review:
        out = out & (F.col("review_status").isNull() | ~F.col("review_status").isin(list(not_review)))
    return out


def retrievable() -> Column:
    """Active and not held: the one predicate of every channel's corpus."""
    return payload(statuses=["active"], not_review=NOT_RETRIEVABLE)


def effects(requests: DataFrame, policy: DataFrame) -> DataFrame:
    """requests (role, purpose, field_path) with effect: the exact row's, else the role and purpose's wildcard, else deny."""
    exact = policy.select("role", "purpose", "field_path", F.col("effect").alias("exact"))
    wild = policy.where("field_path = '*'").select("role", "purpose", F.col("effect").alias("wild"))
    joined = requests.join(exact, ["role", "purpose", "field_path"], "left").join(wild, ["role", "purpose"], "left")
    return joined.select("role", "purpose", "field_path", F.coalesce("exact", "wild", F.lit("deny")).alias("effect"))


def masked(df: DataFrame, effect_of: dict[str, str], never: Sequence[str] = ()) -> DataFrame:
    """The allowed columns as they are, masked ones as MASK where not null, the others left out."""
    columns = []
    for name in df.columns:
        effect = "deny" if name in never else effect_of.get(name, effect_of.get("*", "deny"))
        if effect == "allow":
            columns.append(F.col(name))
        elif effect == "mask":
            columns.append(F.when(F.col(name).isNotNull(), F.lit(MASK)).alias(name))
    return df.select(*columns)


def batch_faults(records: DataFrame, required: Sequence[str]) -> DataFrame:
    """dataset_id, n_records, n_blank, accepted: whether every record of a batch has all required attestations, none
    blank or a TODO. A batch passes or fails as a whole."""
    bad = F.lit(False)
    for name in required:
        text = F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
        bad = bad | (text == "") | F.upper(text).startswith("TODO")
    out = records.groupBy("dataset_id").agg(F.count("*").alias("n_records"), F.count_if(bad).alias("n_blank"))
    return out.withColumn("accepted", F.col("n_blank") == 0)


# What an attestation of a de-identified dataset must state.
ATTESTED = ["source", "collection_period", "site", "deidentification_method", "deidentification_standard", "consent_basis", "licence", "attested_by", "attested_date"]


def guarded(records: DataFrame, attestations: DataFrame, synthetic: str, deidentified: str, stated: Sequence[str] = ATTESTED) -> tuple[DataFrame, DataFrame]:
    """The records of accepted batches, and dataset_id, n_records, accepted, reason of every batch.

    records: dataset_id, dataset_provenance, ... A batch passes whole or not at all: every record synthetic, or every
    record de-identified and the batch attested (one row with all of `stated`, none blank or a TODO).
    """
    blank = F.lit(False)
    for name in stated:
        text = F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
        blank = blank | (text == "") | F.upper(text).startswith("TODO")
    told = attestations.groupBy("dataset_id").agg(F.bool_or(~blank).alias("complete"))
    kinds = records.groupBy("dataset_id").agg(
        F.count("*").alias("n_records"), F.bool_and(F.coalesce(F.col("dataset_provenance") == synthetic, F.lit(False))).alias("_s"),
        F.bool_and(F.coalesce(F.col("dataset_provenance") == deidentified, F.lit(False))).alias("_d"),
    )
    complete = F.coalesce("complete", F.lit(False))
    reason = F.when(F.col("_s"), "synthetic").when(F.col("_d") & complete, "attested").when(F.col("_d"), "attestation_missing").otherwise("provenance_unknown")
    batches = kinds.join(told, "dataset_id", "left").withColumn("reason", reason).withColumn("accepted", F.col("reason").isin("synthetic", "attested"))
    batches = batches.select("dataset_id", "n_records", "accepted", "reason")
    return records.join(batches.where("accepted").select("dataset_id"), "dataset_id", "left_semi"), batches


def retrieval_item(candidates: DataFrame) -> DataFrame:
    """The fields of a retrieved item; review_status is put over the copy in meta (map<string, string>), unknown states and
    kinds take their defaults."""
    base = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    meta = F.map_concat(F.map_filter(base, lambda k, _: k != "review_status"), F.create_map(F.lit("review_status"), "review_status"))
    return candidates.select(
        "chunk_id", "score", "section_path", "section_number", "page_start", "page_end", "char_start", "char_end", "document_id", "document_title",
        "document_version_id", "version_label", "effective_date", F.coalesce("status", F.lit("active")).alias("version_status"),
        F.coalesce("chunk_type", F.lit("prose")).alias("chunk_type"), "text", "heading", meta.alias("meta"),
    )


def first_rule(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first rule that holds; a null condition doesn't."""
    out = F.lit(otherwise)
    for holds, name in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def in_scope_fields(vocabulary: DataFrame, listed: Sequence[str]) -> DataFrame:
    """Rows of which the field is listed, or lies under a listed prefix that ends in a point."""
    exact = [f for f in listed if not f.endswith(".")]
    fits = F.col("field").isin(exact)
    for prefix in (f for f in listed if f.endswith(".")):
        fits = fits | F.col("field").startswith(prefix)
    return vocabulary.where(fits)
