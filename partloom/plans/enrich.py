"""The enrichment of a raw feed: clean, resolve, classify, extract, validate, describe, score, shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom import vocab as V
from partloom.functions import extract as X
from partloom.functions.text import blank_to_null, clean_placeholders, present, strip
from partloom.operators import attributes as A
from partloom.operators import delivery as D
from partloom.operators import validate as Q
from partloom.operators.fuzzy import Masters, resolve_entity_join
from partloom.operators.entity import resolve_entity
from partloom.vocab import DEFAULT, Vocabulary

_EMPTY_EVIDENCE = (
    "struct<source_url:string,source_type:string,http_status:int,text:string,"
    "spec_sections:map<string,string>,content_hash:string,"
    "snippets:map<string,struct<value:string,evidence:string>>>"
)
_EMPTY_MODEL = A.MODEL_SCHEMA


def prepare(feed: DataFrame) -> DataFrame:
    """Cleaned texts and the one brand column that says something."""
    named = [F.when(~strip(F.col(c)).isin(V.BRAND_PLACEHOLDERS), blank_to_null(F.col(c))) for c in V.BRAND_DEFAULTS]
    df = feed.withColumn("raw_brand", F.coalesce(*named))
    empty = ~present(F.col("Mfg_Part_Num")) & ~present(F.col("Part_Desc"))
    return df.withColumns(
        {
            "status": F.when(empty, "ERROR").otherwise("SUCCESS"),
            "desc_clean": F.coalesce(clean_placeholders(F.col("Part_Desc")), F.col("Part_Desc")),
            "manuf_clean": clean_placeholders(F.col("Part_Manuf")),
            "brand_clean": clean_placeholders(F.col("raw_brand")),
        }
    )


def resolve(feed: DataFrame, vocab: Vocabulary = DEFAULT, masters: Masters | None = None) -> DataFrame:
    """Brand, manufacturer and category; from ``masters`` if there are tables, else from the lists that come with the package."""
    columns = ("desc_clean", "Mfg_Part_Num", "brand_clean", "manuf_clean")
    df = resolve_entity(prepare(feed), *columns, vocab) if masters is None else resolve_entity_join(prepare(feed), *columns, masters)
    return df.withColumn(
        "category", X.category(F.col("desc_clean"), F.col("Mfg_Part_Num"), F.col("brand"))
    )


def extract(
    feed: DataFrame,
    evidence: DataFrame | None = None,
    replies: DataFrame | None = None,
    vocab: Vocabulary = DEFAULT,
    spread: int | None = None,
    masters: Masters | None = None,
) -> DataFrame:
    """Resolved feed with ``attrs``, ``raw_specs``, ``spec_sections``, ``ev`` and ``source_mode``.

    Evidence and replies are looked up by part number in one join at the start, while rows are narrow; the brand decides later
    which page of the part is taken.  A feed that was joined with its lookups before, as streams are, is taken as it is.  ``spread`` is the caller's, for a feed in one small file: the number of tasks
    it is dealt to.
    """
    lookups = [A.evidence_lookup(A.prepare_evidence(evidence), "_evidence_ordinal")] if evidence is not None else []
    lookups += [A.reply_lookup(replies)] if replies is not None else []
    if lookups:
        feed = A.join_lookups(feed, "Mfg_Part_Num", lookups, spread)
    elif spread:
        feed = feed.repartition(spread)
    df = resolve(feed, vocab, masters)
    if "_part" in feed.columns:
        df = df.withColumn("ev", A.chosen_evidence(F.col("brand"))).drop("_part", "_brands")
    else:
        df = df.withColumn("ev", F.lit(None).cast(_EMPTY_EVIDENCE))
    if "_content" in feed.columns:
        df = A.parsed_reply(df)
    else:
        df = df.withColumn("model", F.lit(None).cast(_EMPTY_MODEL))
    df = A.evidence_specs(df, "desc_clean", "category", vocab)
    df = A.heuristic_attributes(df, "desc_clean", "Mfg_Part_Num", vocab)
    df = A.merge_attributes(df, "brand", "Mfg_Part_Num")
    return df.withColumn("spec_sections", F.col("tech.listed")).drop("tech", "tech_specs", "heur", "model")


def validated(feed, evidence=None, replies=None, vocab: Vocabulary = DEFAULT, spread: int | None = None, masters: Masters | None = None) -> DataFrame:
    return Q.validate_attributes(extract(feed, evidence, replies, vocab, spread, masters), "category", vocab)


def scored(feed, evidence=None, replies=None, vocab: Vocabulary = DEFAULT, spread: int | None = None, masters: Masters | None = None) -> DataFrame:
    """Validated rows with channel texts, confidence, tier and the review decision."""
    df = validated(feed, evidence, replies, vocab, spread, masters)
    df = D.channel_descriptions(
        df,
        F.coalesce(F.col("final.brand"), F.col("brand")),
        F.coalesce(blank_to_null(F.col("final.mpn")), F.col("Mfg_Part_Num")),
    )
    df = Q.add_confidence(df, F.col("invoice_desc"), F.col("source_mode"), vocab)
    failed = F.col("status") == "ERROR"
    tier = F.when(failed, "HITL_REQUIRED").otherwise(F.col("review_tier"))
    return df.withColumns(
        {
            "source_mode": F.when(failed, "ERROR").otherwise(F.col("source_mode")),
            "confidence": F.when(failed, F.lit(0.0)).otherwise(F.col("confidence")),
            "review_tier": tier,
            "needs_review": failed | F.col("validator_review") | (tier != "AUTO_APPROVED"),
        }
    )


def enrich(feed, evidence=None, replies=None, vocab: Vocabulary = DEFAULT, spread: int | None = None, masters: Masters | None = None) -> DataFrame:
    """Everything the delivery record is made of, one narrow row per feed row."""
    df = D.combined_specs(scored(feed, evidence, replies, vocab, spread, masters))
    df = D.align_slots(df)
    df = df.withColumn(
        "part_key", F.upper(strip(F.coalesce(blank_to_null(F.col("Mfg_Part_Num")), F.col("final.mpn"), F.lit(""))))
    ).withColumn("_url_brand", F.coalesce(blank_to_null(F.col("final.brand")), F.col("brand")))
    return D.add_brand_url(df, "_url_brand", F.col("part_key"), vocab).drop("_url_brand")


def record_cells() -> dict[str, Column]:
    """Delivery cells of ``enrich`` rows; failed rows get the guaranteed fallback record."""
    raw = {c: F.col(c) for c in V.FEED_COLUMNS}
    good = D.delivery_cells(raw)
    stand_in = D.fallback_cells(
        {"Mfg_Part_Num": strip(raw["Mfg_Part_Num"]), "Part_Desc": strip(raw["Part_Desc"]),
         "Part_Manuf": strip(raw["Part_Manuf"])}
    )
    failed = F.col("status") == "ERROR"
    return {
        h: cell if stand_in_is_blank(h) else F.when(failed, stand_in[h]).otherwise(cell)
        for h, cell in good.items()
    }


_FALLBACK_FILLED = {
    "PART_NUMBER", "Mfg_Part_Num", "MANUFACTURER_PART_NUMBER", "Part_Desc", "Part_Manuf",
    "MANUFACTURER_NAME", "BRAND_NAME", "Product Name", "INVOICE_DESC", "MOBILE_DESC",
    "Actual Image (Yes/No)", "E1_Brand", "Unilog_Brand", "DIB_Brand", "SHORT_DESC", "LONG_DESC1",
    "RETAIL_DESC", "Selling Qty", "Selling UOM", "Country Of Origin", "Discontinued",
    "SKU - MY_PART_NUMBER", "MFR URL",
}


def stand_in_is_blank(header: str) -> bool:
    """Columns that are empty in the fallback and, for a row without any text, in the record too."""
    return header not in _FALLBACK_FILLED and not header.startswith("ATTRIBUTE_LABEL")


def delivery(enriched: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return D.project_delivery(enriched, record_cells(), list(keys))
