"""Review queue, action log, audit trail and the tables an enrichment run persists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.text import text_or
from partloom.operators.common import first_by, growing, last_by, materialize, same_key
from partloom.functions.scoring import valid_lov
from partloom.sources.tables import merge, row_id
from partloom.vocab import DEFAULT, Vocabulary

STATUS_OF = {"APPROVE": "APPROVED", "REJECT": "REJECTED", "EDIT": "EDITED"}
DEFAULT_REVIEWER = "catalog_specialist"


def status_of(action: Column) -> Column:
    chain = F.when(action == "APPROVE", "APPROVED")
    return chain.when(action == "REJECT", "REJECTED").when(action == "EDIT", "EDITED")


def review_state(queue: DataFrame, actions: DataFrame) -> DataFrame:
    """Current state of every review: the last action decides, the last edit sets the value.

    The log is reduced per review with mergeable aggregates, so a review with a very long history
    costs no more than its share of the scan.
    """
    when = F.struct("ts", "action_id")
    edit = F.col("action_type") == "EDIT"
    last = actions.groupBy("review_id").agg(
        F.max_by(F.struct("action_type", "reviewer", "ts"), when).alias("_last"),
        F.max_by("new_value", F.when(edit, when)).alias("_edited"),
        F.count("*").alias("actions"),
    ).withColumnRenamed("review_id", "_rid")
    joined = queue.join(last, same_key("review_id", "_rid"), "left")
    return joined.select(
        *queue.columns,
        F.coalesce(status_of(F.col("_last.action_type")), F.lit("PENDING")).alias("status"),
        F.coalesce("_edited", "suggested_value").alias("current_value"),
        F.when(
            F.col("_last").isNotNull(), F.coalesce(F.col("_last.reviewer"), F.lit(DEFAULT_REVIEWER))
        ).alias("assigned_to"),
        F.col("_last.ts").alias("resolved_at"),
        F.coalesce("actions", F.lit(0)).alias("actions"),
    )


def review_audit(actions: DataFrame) -> DataFrame:
    """One audit event per action."""
    return actions.select(
        F.col("action_id").alias("audit_id"),
        F.concat(F.lit("HITL_REVIEW_"), status_of(F.col("action_type"))).alias("event_type"),
        F.lit("REVIEW_QUEUE").alias("entity_type"),
        F.col("review_id").cast("string").alias("entity_id"),
        F.coalesce("reviewer", F.lit(DEFAULT_REVIEWER)).alias("reviewer"),
        status_of(F.col("action_type")).alias("decision"),
        "new_value", "ts",
    )


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page of a listing; Spark keeps only ``offset + limit`` rows per task for it."""
    return df.orderBy(*order).offset(offset).limit(limit)


def pending_queue(state: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    pending = state.where(F.col("status") == "PENDING")
    return page(pending, [F.asc("confidence"), F.desc("created_at"), F.asc("review_id")], offset, limit)


def audit_trail(
    audit: DataFrame, entity_type: str | None = None, entity_id: str | None = None
) -> DataFrame:
    if entity_type is not None:
        audit = audit.where(F.col("entity_type") == entity_type)
    if entity_id is not None:
        audit = audit.where(F.col("entity_id") == entity_id)
    return audit


def review_listing(state: DataFrame, products: DataFrame, product_key: str) -> DataFrame:
    right = products.withColumnRenamed(product_key, "_pk")
    return state.join(right, same_key("product_id", "_pk"), "left").drop("_pk")


def latest_run(runs: DataFrame, key: str, created: str, tie: str) -> DataFrame:
    """Newest run per product."""
    return last_by(runs, [key], [F.col(created), F.col(tie)])


def upsert_products(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Products with new ones added; the first incoming row of an unknown key creates it."""
    first = first_by(incoming, list(keys), [F.col(ordinal)])
    new = first.join(stored.select(*keys), list(keys), "left_anti")
    return (
        stored.withColumn("origin", F.lit("existing"))
        .unionByName(new.withColumn("origin", F.lit("created")), allowMissingColumns=True)
    )


def upsert_sources(fetches: DataFrame, retrieved: str, tie: str) -> DataFrame:
    """One source row per brand and part number, the newest fetch."""
    return last_by(fetches, ["brand", "mpn"], [F.col(retrieved), F.col(tie)])


def source_evidences(sources: DataFrame) -> DataFrame:
    """One row per snippet of a source."""
    return sources.select("brand", "mpn", F.explode("snippets").alias("spec_key", "_s")).select(
        "brand", "mpn", "spec_key", F.col("_s.evidence").alias("raw_snippet"),
        F.col("_s.value").alias("extracted_value"), F.lit(1.0).alias("confidence"),
    )


# ------------------------------------------------------------------ persisted tables of one run


def persist_products(enriched: DataFrame) -> DataFrame:
    return enriched.select(
        "_ordinal", F.col("Mfg_Part_Num").alias("mfg_part_num"), F.col("Part_Desc").alias("part_desc"),
        F.col("Part_Manuf").alias("raw_manuf"),
        F.coalesce(F.col("final.brand"), F.col("brand")).alias("canonical_brand"),
        F.when(F.col("needs_review"), "review_required").otherwise("completed").alias("status"),
    )


def persist_runs(enriched: DataFrame) -> DataFrame:
    return enriched.select(
        "_ordinal", "source_mode", F.col("confidence").alias("confidence_score"), "provenance_score",
        F.round("lov_score", 6).alias("lov_score"), "rule_score", "invoice_desc", "mobile_desc",
        "product_title", "long_desc", "short_desc",
    )


def provenance_rows(enriched: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Value, source, evidence and confidence per field, one row each."""
    snippets = F.col("ev.snippets")

    def evidence(name: str, default: Column) -> Column:
        hit = F.try_element_at(snippets, F.lit(name))
        return F.coalesce(
            F.when(hit["evidence"] != "", hit["evidence"]), F.when(hit["value"] != "", hit["value"]), default
        )

    value = lambda n: F.col(f"final.{n}")
    defaults = {
        "brand": F.concat(F.lit("Resolved from '"), F.coalesce("Part_Manuf", F.lit("None")), F.lit("'")),
        "item_type": F.concat(F.lit("Extracted from '"), F.substring("desc_clean", 1, 60), F.lit("'")),
        "voltage": F.lit("Extracted voltage rating"),
        "dimensions": F.lit("Converted fractional size"),
        "material": F.lit("Extracted material specification"),
    }
    rows = []
    for name, default in defaults.items():
        lov = F.lit(True) if name in ("brand", "dimensions") else valid_lov(name, value(name), vocab)
        own = F.try_element_at("field_confidences", F.lit(name))
        spare = F.col("brand_score") if name == "brand" else F.col("confidence")
        rows.append(
            F.struct(
                F.lit(name).alias("field"), value(name).alias("value"),
                (default if name == "brand" else evidence(name, default)).alias("evidence"),
                F.coalesce(own, spare).alias("confidence"), lov.alias("is_lov_validated"),
            )
        )
    source = F.struct(
        text_or(F.coalesce("ev.source_url", F.lit("")), "distributor_feed").alias("source_url"),
        F.coalesce("ev.source_type", F.lit("distributor_feed")).alias("source_type"),
    )
    return enriched.select("_ordinal", source.alias("_src"), F.explode(F.array(*rows)).alias("_r")).select(
        "_ordinal", "_r.field", "_r.value", "_src.source_url", "_src.source_type", "_r.evidence",
        "_r.confidence", "_r.is_lov_validated",
    )


def persist_attributes(provenance: DataFrame) -> DataFrame:
    """Extracted attributes with a value."""
    return provenance.where(F.col("value") != "").select(
        "_ordinal", F.initcap(F.replace("field", F.lit("_"), F.lit(" "))).alias("attribute_label"),
        F.col("value").alias("attribute_value"), "source_url", "source_type",
        F.col("evidence").alias("evidence_text"), "confidence", "is_lov_validated",
    )


def persist_review_queue(enriched: DataFrame) -> DataFrame:
    return enriched.where("needs_review").select(
        "_ordinal", F.lit("INVOICE_DESC / ATTRIBUTES").alias("field_name"),
        F.col("Part_Desc").alias("original_value"), F.col("invoice_desc").alias("suggested_value"),
        F.col("invoice_desc").alias("current_value"),
        F.lit("Confidence score below 90% threshold").alias("reason"), "confidence",
        F.lit("PENDING").alias("status"),
    )


def persist_audit(enriched: DataFrame) -> DataFrame:
    return enriched.select(
        "_ordinal", F.lit("ENRICHMENT_COMPLETED").alias("event_type"), F.lit("PRODUCT").alias("entity_type"),
        F.col("Mfg_Part_Num").alias("entity_id"), "confidence", "source_mode", "needs_review",
    )




def related_tables(enriched: DataFrame, batch: Column) -> dict[str, DataFrame]:
    """Products, runs, attributes, review items and audit events of a batch, with identifiers and references.

    A product is known by its part number, description and raw manufacturer as they were sent; a run by its product and batch; an
    attribute by its run and label; a review item and an audit event by their run.  Rows that repeat a product in a batch are one
    product with one run; ``_ordinal`` says which row came last.
    """
    product = row_id(F.col("Mfg_Part_Num"), F.col("Part_Desc"), F.col("Part_Manuf"))
    latest = enriched.groupBy(product.alias("product_id")).agg(F.max("_ordinal").alias("_ordinal"))
    latest = materialize(latest.withColumn("run_id", row_id(F.col("product_id"), batch)), "related-ids")
    ids = lambda rows: rows.join(growing(latest), "_ordinal")
    attributes = ids(persist_attributes(provenance_rows(enriched))).drop("product_id")
    return {
        "products": ids(persist_products(enriched)).drop("run_id"),
        "runs": ids(persist_runs(enriched)),
        "attributes": attributes.withColumn("attribute_id", row_id(F.col("run_id"), F.col("attribute_label"))),
        "review_queue": ids(persist_review_queue(enriched)).withColumn("review_id", row_id(F.col("run_id"), F.col("field_name"))),
        "audit_events": ids(persist_audit(enriched)).withColumn("event_id", row_id(F.col("run_id"), F.col("event_type"))),
    }


#: The key of each related table, and the tables its references lead to.
RELATED = {
    "products": ("product_id", {}),
    "runs": ("run_id", {"product_id": "products"}),
    "attributes": ("attribute_id", {"run_id": "runs"}),
    "review_queue": ("review_id", {"product_id": "products", "run_id": "runs"}),
    "audit_events": ("event_id", {"product_id": "products", "run_id": "runs"}),
}


def persist_related(enriched: DataFrame, path: str, batch: Column) -> dict[str, list[int]]:
    """Merge one batch into the related tables below ``path``; the buckets of each table that were written."""
    spark = enriched.sparkSession
    tables = related_tables(enriched, batch)
    return {name: merge(spark, f"{path}/{name}", tables[name], key, [F.col("_ordinal")]) for name, (key, _) in RELATED.items()}
