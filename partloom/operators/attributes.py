"""Attributes of a part: rules over the description, official evidence, external model replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions import extract as X
from partloom.functions.text import blank_to_null, let, strip
from partloom.functions.units import with_unit
from partloom.functions.web import content_hash, json_from_reply
from partloom.operators.entity import without_marks
from partloom.vocab import DEFAULT, Vocabulary

ATTRIBUTES = [
    "brand", "item_type", "mpn", "voltage", "dimensions", "mounting", "material", "series", "mfr_url",
]
SPECS_TYPE = "array<struct<k:string,v:string>>"
MODEL_SCHEMA = (
    "struct<brand:string,item_type:string,mpn:string,voltage:string,dimensions:string,"
    "mounting:string,material:string,series:string,mfr_url:string,raw_specs:map<string,string>,"
    "_bad:string>"
)

# FIXED VALUES: what makes a line of an official page evidence for an attribute, how the value is
# read from it, and how much of the line is kept.
SNIPPET_RULES = {
    "voltage": (r"voltage|120v|120 v|240v|240 v", r"(?i)(\b\d+(?:/\d+)?\s*(?:v(?:olt)?s?|kv)\b)", None, 40),
    "amperage": (r"amp|current|\b\d+\s*a\b", r"(?i)(\b\d+(?:\.\d+)?\s*(?:a(?:mp)?s?|ma)\b)", None, 40),
    "material": (r"material|stainless steel|carbide|aluminum", None, ("stainless", "Stainless Steel"), 40),
    "dimensions": (r"dimension|width|depth|diameter", None, None, 60),
    "mounting": (r"mounting|built-in|freestanding|wall mount", None, ("built-in", "Built-In"), 40),
}
EVIDENCE_CHARS = 160


def _speaks_of(marker: str):
    return lambda line: F.lower(line).rlike(marker)


def _describe(value_pattern: str | None, fixed: tuple[str, str] | None, keep: int):
    def body(line: Column) -> Column:
        value = F.substring(line, 1, keep)
        if value_pattern:
            value = F.when(
                line.rlike(value_pattern), F.regexp_extract(line, value_pattern, 1)
            ).otherwise(value)
        if fixed:
            value = F.when(F.contains(F.lower(line), F.lit(fixed[0])), fixed[1]).otherwise(value)
        evidence = F.substring(line, 1, EVIDENCE_CHARS)
        return F.when(
            line.isNotNull(), F.struct(value.alias("value"), evidence.alias("evidence"))
        )

    return body


def snippets(text: Column) -> Column:
    """Map of attribute to (value, evidence): the first line of the text that speaks of it.

    All inside the row, so a document is never taken apart and shuffled back together.
    """
    lines = F.filter(
        F.transform(
            F.when(F.contains(text, F.lit("\n")), F.split(text, "\n")).otherwise(
                F.split(text, r"\.")
            ),
            lambda s: strip(s),
        ),
        lambda s: F.length(s) >= 3,
    )

    def told(own: Column) -> Column:
        found = []
        for name, rule in SNIPPET_RULES.items():
            line = F.get(F.filter(own, _speaks_of(rule[0])), F.lit(0))
            body = F.get(F.transform(F.array(line), _describe(*rule[1:])), F.lit(0))
            found.append(F.struct(F.lit(name).alias("key"), body.alias("value")))
        return F.map_from_entries(F.filter(F.array(*found), lambda e: e["value"].isNotNull()))

    return let(lines, told)  # cut into lines once, not once for each attribute


def prepare_evidence(evidence: DataFrame) -> DataFrame:
    """Add hash and snippets to fetched pages (brand, mpn, source_url, source_type, http_status, text,
    spec_sections)."""
    return evidence.withColumn("content_hash", content_hash(F.col("text"))).withColumn(
        "snippets", snippets(F.col("text"))
    )


def evidence_lookup(evidence: DataFrame, order: str) -> DataFrame:
    """(_key, _part, _brands): one row per part number: its first page, and the first page of every brand that has one.

    Pages are reduced to one per part number and brand before they meet, so a part fetched very often costs one row a task, and
    a row here holds as many pages as the part number has brands.  Pages without a part number are left out.
    """
    payload = [c for c in evidence.columns if c not in ("brand", "mpn", order)]
    keyed = evidence.select(
        F.upper(strip(F.col("mpn"))).alias("_key"), F.upper(without_marks(F.col("brand"))).alias("_eb"), F.struct(F.col(order).alias("o"), F.struct(*payload).alias("ev")).alias("_e")
    ).where("_key <> ''")
    first = keyed.groupBy("_key", "_eb").agg(F.min_by("_e", F.col("_e.o")).alias("_e"))
    named = F.collect_list(F.when(F.col("_eb") != "", F.struct("_eb", F.col("_e.ev").alias("ev"))))
    return first.groupBy("_key").agg(F.min_by(F.col("_e.ev"), F.col("_e.o")).alias("_part"), F.map_from_entries(named).alias("_brands"))


def reply_lookup(replies: DataFrame) -> DataFrame:
    """(_key, _content): the least reply of each part number."""
    return replies.groupBy(F.upper(strip(F.col("mpn"))).alias("_key")).agg(F.min("content").alias("_content"))


def join_lookups(df: DataFrame, mpn: str, lookups: Sequence[DataFrame], spread: int | None = None) -> DataFrame:
    """``df`` with the columns of ``lookups``, each with one row per ``_key``, by part number.

    The lookups are joined with each other first, so ``df`` is exchanged once, and as narrow as the caller has it here.  A part
    number that very many rows have is an ordinary skewed left side; with ``spread``, for a small feed in one file, rows
    are dealt to that many tasks by part number.
    """
    all_keys = lookups[0]
    for more in lookups[1:]:
        all_keys = all_keys.join(more, "_key", "full_outer")
    left = df.withColumn("_m", F.upper(strip(F.col(mpn))))
    left = left.repartition(spread, "_m") if spread else left
    return left.join(all_keys.hint("merge"), F.col("_m") == F.col("_key"), "left").drop("_m", "_key")


def chosen_evidence(brand: Column) -> Column:
    """Of a row with ``_part`` and ``_brands``: the page of the row's brand, else the first page of the part."""
    own = F.upper(without_marks(F.coalesce(brand, F.lit(""))))
    return F.coalesce(F.try_element_at("_brands", own), F.col("_part"))


def join_evidence(df: DataFrame, evidence: DataFrame, brand: str, mpn: str, order: str) -> DataFrame:
    """Add ``ev``: evidence for the same brand and part, else for the part number alone; none without a part number."""
    joined = join_lookups(df, mpn, [evidence_lookup(evidence, order)])
    return joined.withColumn("ev", chosen_evidence(F.col(brand))).drop("_part", "_brands")


def merge_specs(base: Column, over: Column) -> Column:
    """Ordered union of two spec lists: a repeated name keeps its place and takes the later value."""
    # names are bound once: a function of a column that stands in a lambda is evaluated for every element
    kept = let(
        F.transform(over, lambda s: s["k"]),
        lambda names: F.transform(
            base,
            lambda s: F.struct(
                s["k"].alias("k"),
                F.when(
                    F.array_contains(names, s["k"]),
                    F.get(over, F.array_position(names, s["k"]).cast("int") - 1)["v"],
                )
                .otherwise(s["v"])
                .alias("v"),
            ),
        ),
    )
    new = let(
        F.transform(base, lambda s: s["k"]),
        lambda known: F.filter(over, lambda s: ~F.array_contains(known, s["k"])),
    )
    return F.concat(kept, new)


def no_specs() -> Column:
    return F.array().cast(SPECS_TYPE)


def spec_value(specs: Column, name: str) -> Column:
    return F.get(F.filter(specs, lambda s: s["k"] == name), F.lit(0))["v"]


def evidence_specs(df: DataFrame, desc: str, category: str, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Add ``tech``: attributes read from evidence first and from the description otherwise.

    Expects ``ev`` with ``spec_sections`` and ``snippets``; without evidence ``ev`` is null.
    """
    text = F.coalesce(F.col(desc), F.lit(""))
    sections, snips = F.col("ev.spec_sections"), F.col("ev.snippets")

    def section(name: str) -> Column:
        return F.try_element_at(sections, F.lit(name))

    def snippet(name: str) -> Column:
        return F.try_element_at(snips, F.lit(name))["value"]

    amperage = F.coalesce(
        with_unit(section("Amperage Rating"), "A"),
        snippet("amperage"),
        X.capture(text, X.AMPERAGE_DECIMAL, " A"),
    )
    sound = F.coalesce(
        with_unit(section("Sound Level"), "dBA", "dBA", "dB"),
        snippet("sound_level"),
        X.capture(text, X.SOUND_LEVEL, " dBA"),
    )
    mount = F.coalesce(section("Mounting Type"), snippet("mounting"))
    mount = F.when(F.contains(F.lower(mount), F.lit("built")), "Built-In").otherwise(mount)
    footprint = F.concat(section("Width"), F.lit(" W x "), section("Depth"), F.lit(" D"))
    listed = F.transform(
        F.coalesce(F.map_entries(sections), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: F.struct(
            e["key"].alias("k"),
            F.when(
                e["key"] == "Number of Wash Cycles", F.replace(e["value"], F.lit(".0"), F.lit(""))
            )
            .otherwise(e["value"])
            .alias("v"),
        ),
    )
    derived = F.filter(
        F.array(
            X.spec("Amperage", amperage),
            X.spec("SoundLevel", sound),
            X.spec("DepthWithDoorOpen", section("Depth With Door Open")),
        ),
        lambda s: s["v"].isNotNull(),
    )
    dishwasher = F.contains(F.lower(F.col(category)), F.lit("dishwasher")) | F.contains(
        F.lower(text), F.lit("dishwasher")
    )
    df = df.withColumn(
        "tech",
        F.struct(
            F.when(dishwasher, "Dishwasher").alias("item_type"),
            F.coalesce(
                with_unit(section("Voltage Rating"), "V"), snippet("voltage"), X.voltage(text)
            ).alias("voltage"),
            amperage.alias("amperage"),
            sound.alias("sound_level"),
            F.coalesce(
                section("Size"), footprint, snippet("dimensions"), X.measured_dimensions(text, vocab)
            ).alias("dimensions"),
            F.coalesce(mount, X.first_rule(text, X.EVIDENCE_MOUNTING_RULES)).alias("mounting"),
            F.coalesce(
                section("Material"), X.first_rule(text, X.MATERIAL_RULES[:1])
            ).alias("material"),
            listed.alias("listed"),
            derived.alias("derived"),
        ),
    )
    return df.withColumn("tech_specs", merge_specs(F.col("tech.listed"), F.col("tech.derived")))


def heuristic_attributes(df: DataFrame, desc: str, mpn: str, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Add ``heur``: attributes from ordered rules over the description alone."""
    text = F.coalesce(F.col(desc), F.lit(""))
    df = df.withColumn("_dims", X.dimensions(text, vocab))
    return df.withColumn(
        "heur",
        F.struct(
            X.item_type(text).alias("item_type"),
            F.coalesce(blank_to_null(strip(F.col(mpn))), X.part_number(text)).alias("mpn"),
            X.voltage(text).alias("voltage"),
            F.col("_dims").alias("dimensions"),
            X.mounting(text).alias("mounting"),
            X.material(text).alias("material"),
            X.raw_specs(text, F.col("_dims")).alias("raw_specs"),
        ),
    ).drop("_dims")


def join_model_output(df: DataFrame, replies: DataFrame, mpn: str) -> DataFrame:
    """Add ``model``: the parsed reply of an external model for the part, null when unusable."""
    return parsed_reply(join_lookups(df, mpn, [reply_lookup(replies)]))


def parsed_reply(joined: DataFrame) -> DataFrame:
    """``_content`` parsed as ``model``."""
    joined = joined.withColumn("_json", json_from_reply(F.col("_content"))).withColumn(
        "_parsed",
        F.from_json(
            "_json", MODEL_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
        ),
    )
    usable = F.col("_parsed").isNotNull() & F.col("_parsed._bad").isNull() & F.col("_json").startswith("{")
    return joined.withColumn("model", F.when(usable, F.col("_parsed"))).drop(
        "_content", "_json", "_parsed"
    )


def merge_attributes(df: DataFrame, brand: str, mpn: str) -> DataFrame:
    """Add ``attrs``, ``raw_specs`` and ``source_mode`` from ``tech``, ``model`` and ``heur``.

    Evidence beats the model; a row without a usable model reply falls back to the heuristics.
    """
    live = F.col("model").isNotNull()

    def pick(name: str) -> Column:
        other = F.when(live, F.col(f"model.{name}")).otherwise(F.col(f"heur.{name}"))
        return F.coalesce(blank_to_null(F.col(f"tech.{name}")), other).alias(name)

    canonical = blank_to_null(F.col(brand))
    model_specs = F.coalesce(
        F.transform(
            F.map_entries("model.raw_specs"),
            lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")),
        ),
        no_specs(),
    )
    df = df.withColumn(
        "attrs",
        F.struct(
            F.coalesce(canonical, F.when(live, F.col("model.brand"))).alias("brand"),
            pick("item_type"),
            F.coalesce(
                blank_to_null(F.col(mpn)),
                F.when(live, F.col("model.mpn")).otherwise(F.col("heur.mpn")),
            ).alias("mpn"),
            pick("voltage"),
            pick("dimensions"),
            pick("mounting"),
            pick("material"),
            F.when(live, F.col("model.series")).alias("series"),
            F.when(live, F.col("model.mfr_url")).alias("mfr_url"),
        ),
    )
    df = df.withColumn("_base", F.when(live, model_specs).otherwise(F.col("heur.raw_specs")))
    df = df.withColumn("raw_specs", merge_specs(F.col("_base"), F.col("tech_specs")))
    return df.withColumn(
        "source_mode", source_mode(live, F.col("ev.http_status"))
    ).drop("_base")


def source_mode(live: Column, http_status: Column) -> Column:
    return (
        F.when(live & F.coalesce(http_status == 200, F.lit(False)), "MANUFACTURER_SOURCE")
        .when(live, "LIVE_NIM")
        .otherwise("OFFLINE_HEURISTIC")
    )


def attribute_columns(prefix: str = "attrs", names: Sequence[str] = ATTRIBUTES) -> dict[str, Column]:
    return {n: F.col(f"{prefix}.{n}") for n in names}
