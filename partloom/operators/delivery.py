"""Channel descriptions, attribute slots and the 252-column delivery record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom import vocab as V
from partloom.functions.extract import spec
from partloom.functions.invoice import compress_invoice
from partloom.functions.text import (
    blank_to_null, clean_placeholders, let, literal_table, lookup, strip, text_or,
)
from partloom.functions.units import split_value_unit
from partloom.operators.attributes import SPECS_TYPE, attribute_columns, spec_value
from partloom.operators.entity import add_brand_match, without_marks
from partloom.vocab import DEFAULT, Vocabulary

DESCRIPTIONS = ["invoice_desc", "mobile_desc", "short_desc", "long_desc", "product_title"]
MOBILE_LIMIT = 80

# FIXED VALUES: item-type keywords that choose an invoice layout.
FAUCET = r"faucet"
FITTING = r"fitting|elbow|tee|coupling|adapter|union|nipple|flange"
ABRASIVE = r"disc|belt|wheel|blade|cut-off|cutoff|abrasive|grinding"
APPLIANCE = r"dishwasher|washer|dryer|refrigerator|range|oven"

# FIXED VALUES: assertions the delivery format makes for every record.
DELIVERY_DEFAULTS = {
    "Selling Qty": "1", "Selling UOM": "EA", "Country Of Origin": "US", "Discontinued": "No",
}


def _filled(c: Column) -> Column:
    return blank_to_null(c)


def _suffixed(c: Column, suffix: str) -> Column:
    """``c`` with `` suffix`` unless it already ends with that word."""
    tail = suffix.lower()
    return F.when(F.endswith(F.lower(c), F.lit(tail)), c).otherwise(F.concat(c, F.lit(f" {suffix}")))


def _unless_has(c: Column, word: str, text: str) -> Column:
    return F.when(F.contains(F.lower(c), F.lit(word)), c).otherwise(F.concat(c, F.lit(f" {text}")))


def _whole(c: Column, otherwise: Column) -> Column:
    """Whole-number text of a numeric value (``5.0`` to ``5``)."""
    return F.when(
        c.isNotNull(), F.coalesce(c.try_cast("double").try_cast("bigint").cast("string"), otherwise)
    )


def _tight(c: Column) -> Column:
    return F.upper(F.replace(c, F.lit(" "), F.lit("")))


def _invoice_parts(a: dict[str, Column], s: dict[str, Column]) -> Column:
    kind = F.lower(F.col("_type"))
    head = F.upper(F.col("_type"))
    join = lambda *parts: F.concat_ws(" ", *parts)
    faucet = join(
        head, a["mounting"], s["FlowRate"], F.coalesce(s["Finish"], a["material"])
    )
    fitting = join(head, a["dimensions"], s["ConnectionType"], a["material"], s["PressureRating"])
    abrasive = join(
        head, a["dimensions"], s["ArborSize"], F.coalesce(s["Grit"], a["material"]), s["PackQuantity"]
    )
    stainless = lambda c: F.when(F.contains(F.lower(c), F.lit("stainless")), "SST").otherwise(F.upper(c))
    machine = join(
        F.when(F.contains(kind, F.lit("dishwasher")), "DISHWASHER").otherwise(head),
        F.when(F.contains(F.lower(a["mounting"]), F.lit("built")), "BLTLN").otherwise(
            F.upper(a["mounting"])
        ),
        _whole(s["Number of Wash Cycles"], F.upper(s["Number of Wash Cycles"])),
        stainless(a["material"]),
        stainless(s["Color"]),
        _tight(a["voltage"]),
        _tight(s["Amperage"]),
    )
    depth = _tight(s["DepthWithDoorOpen"])
    depth = F.when(F.endswith(depth, F.lit("IN")), depth).otherwise(F.concat(depth, F.lit("IN")))
    depth_fits = depth.isNotNull() & (F.length(machine) + 1 + F.length(depth) <= V.INVOICE_LIMIT)
    appliance = join(machine, F.when(depth_fits, depth).otherwise(_tight(s["SoundLevel"])))
    general = join(head, a["mounting"], a["material"], a["voltage"], a["dimensions"])
    return (
        F.when(kind.rlike(FAUCET), faucet)
        .when(kind.rlike(FITTING), fitting)
        .when(kind.rlike(ABRASIVE), abrasive)
        .when(kind.rlike(APPLIANCE), appliance)
        .otherwise(general)
    )


_DESCRIBED_SPECS = [
    "FlowRate", "ConnectionType", "PressureRating", "Finish", "Grit", "ArborSize", "PackQuantity",
    "Amperage", "SoundLevel", "Series", "Number of Wash Cycles", "DepthWithDoorOpen",
    "Minimum Height", "Maximum Height", "Color", "With", "Additional Information",
]


def channel_descriptions(
    df: DataFrame, brand: Column, mpn: Column, manufacturer: Column | None = None
) -> DataFrame:
    """Add the five channel texts of ``final`` and ``raw_specs``."""
    a = {n: _filled(c) for n, c in attribute_columns("final").items()}
    wanted = [_filled(spec_value(F.col("raw_specs"), n)).alias(n) for n in _DESCRIBED_SPECS]
    df = df.withColumns(
        {
            "_s": F.struct(*wanted),
            "_type": F.coalesce(strip(a["item_type"]), F.lit("Commercial Product")),
            "_brand": F.coalesce(strip(_filled(brand)), F.lit("UNASSIGNED")),
            "_mpn": F.coalesce(strip(mpn), F.lit("")),
        }
    )
    s = {n: F.col("_s")[n] for n in _DESCRIBED_SPECS}
    kind, who, part = F.col("_type"), F.col("_brand"), F.col("_mpn")
    maker = F.lit(None).cast("string")
    if manufacturer is not None:
        maker = strip(_filled(manufacturer))
        maker = F.when((maker != "") & (F.upper(maker) != F.upper(who)), maker)
    mounted = F.concat(a["mounting"], F.lit(" Mounting"))
    mounted_once = _suffixed(a["mounting"], "Mounting")
    cycles = _whole(s["Number of Wash Cycles"], s["Number of Wash Cycles"])
    wash = F.concat(cycles, F.lit("-Wash Cycle"))
    other_color = F.when(F.upper(s["Color"]) != F.upper(a["material"]), s["Color"])
    mobile = F.concat_ws(", ", maker, who, kind, s["Series"], part, mounted_once, a["material"])
    long_text = F.concat_ws(
        ", ",
        F.concat_ws(" ", strip(F.concat(who, F.lit(" "), kind)), s["With"]),
        s["Series"],
        F.concat(cycles, F.lit(" Wash Cycles")),
        F.when(F.endswith(a["voltage"], F.lit("V")), a["voltage"]).otherwise(
            F.concat(a["voltage"], F.lit(" V"))
        ),
        F.when(F.endswith(s["Amperage"], F.lit("A")), s["Amperage"]).otherwise(
            F.concat(s["Amperage"], F.lit(" A"))
        ),
        mounted_once,
        a["dimensions"],
        _unless_has(s["DepthWithDoorOpen"], "depth", "Depth With Door Open"),
        _unless_has(s["Minimum Height"], "minimum height", "Minimum Height"),
        _unless_has(s["Maximum Height"], "maximum height", "Maximum Height"),
        F.when(F.endswith(s["SoundLevel"], F.lit("dBA")), s["SoundLevel"]).otherwise(
            F.concat(s["SoundLevel"], F.lit(" dBA Sound Level"))
        ),
        a["material"],
        s["Color"],
        F.concat(F.lit("Additional Information: "), s["Additional Information"]),
    )
    df = df.withColumns({"_invoice": _invoice_parts(a, s), "_mobile": mobile})
    cut = F.when(
        F.length("_mobile") > MOBILE_LIMIT, F.rtrim(F.substring("_mobile", 1, MOBILE_LIMIT))
    ).otherwise(F.col("_mobile"))
    short = F.concat_ws(
        ", ", who, s["Series"], part, kind, s["With"], mounted, wash, a["material"], other_color
    )
    own_series = F.when(F.lower(s["Series"]) != F.lower(who), s["Series"])
    title = F.concat_ws(", ", who, own_series, kind, mounted, wash, a["material"], other_color)
    return df.withColumns(
        {
            "invoice_desc": compress_invoice(F.col("_invoice")), "mobile_desc": cut, "short_desc": short,
            "long_desc": long_text, "product_title": title,
        }
    ).drop("_s", "_type", "_brand", "_mpn", "_invoice", "_mobile")


def fact_descriptions(facts: dict[str, Column]) -> dict[str, Column]:
    """Descriptions from plain facts, without category layouts or compression."""
    f = {k: _filled(v) for k, v in facts.items()}
    get = lambda name: f.get(name, F.lit(None).cast("string"))
    mpn = F.coalesce(strip(get("mpn")), F.lit(""))
    brand = strip(F.coalesce(get("brand_name"), get("oem_name"), F.lit("Unbranded")))
    title = strip(F.coalesce(get("product_name"), F.lit("Product")))
    series = _filled(strip(get("series")))
    mount, material, color = get("mounting_type"), get("material"), get("color")
    cycles, volts, amps, sound = (get(n) for n in ("cycles", "voltage", "amperage", "sound_level"))
    sst = F.when(F.contains(F.lower(material), F.lit("stainless")), "SST")
    lead = lambda c, text="{}": F.concat(F.lit(text.split("{}")[0]), c, F.lit(text.split("{}")[1]))
    none = F.lit("")
    with_part = F.coalesce(lead(get("with_feature"), " {}"), none)
    tail = F.concat(
        F.coalesce(lead(mount, ", {} Mounting"), none), F.coalesce(lead(cycles, ", {}-Wash Cycle"), none),
        F.coalesce(lead(material, ", {}"), none), F.coalesce(lead(color, ", {}"), none),
    )

    def unit(c: Column, ending: str, text: str) -> Column:
        return F.when(F.contains(c, F.lit(ending)), c).otherwise(lead(c, text))

    def ends(c: Column, ending: str, text: str) -> Column:
        return F.when(F.endswith(c, F.lit(ending)), c).otherwise(lead(c, text))

    return {
        "MOBILE_DESC": F.substring(
            F.concat_ws(
                ", ", _filled(brand), _filled(title), series, _filled(mpn), lead(mount, "{} Mounting")
            ),
            1, MOBILE_LIMIT,
        ),
        "INVOICE_DESC": F.substring(
            F.concat_ws(
                " ", _filled(F.upper(title)),
                F.when(F.contains(F.lower(mount), F.lit("built")), "BLTLN").otherwise(F.upper(mount)),
                sst, sst, lead(volts, "{}V"), lead(amps, "{}A"), lead(sound, "{}DBA"),
            ),
            1, V.INVOICE_LIMIT,
        ),
        "SHORT_DESC": strip(
            F.concat(
                brand, F.coalesce(lead(series, " {}"), none), F.lit(" "), mpn, F.lit(" "), title,
                with_part, tail,
            )
        ),
        "LONG_DESC1": F.concat_ws(
            ", ", F.concat(brand, F.lit(" "), title, with_part), series,
            ends(cycles, "Cycles", "{} Wash Cycles"), ends(volts, "V", "{} V"), ends(amps, "A", "{} A"),
            lead(mount, "{} Mounting"), get("size"),
            unit(get("depth_door_open"), "Depth", "{} in Depth With Door Open"),
            unit(get("min_height"), "Height", "{} Minimum Height"),
            unit(get("max_height"), "Height", "{} Maximum Height"),
            unit(sound, "Sound", "{} dBA Sound Level"), material, color,
            lead(get("additional_info"), "Additional Information: {}"),
        ),
        "RETAIL_DESC": strip(F.concat(F.concat_ws(" ", series, title), tail)),
        "MARKETING_DESCRIPTION": F.coalesce(strip(get("marketing_evidence")), none),
    }


# ------------------------------------------------------------------ taxonomy and slots


def taxonomy(item_type: Column) -> Column:
    """(Dept, Class, Fine, Classpath) of the first keyword the item type contains."""
    names = ("Dept", "Class", "Fine", "Classpath")

    def entry(values) -> Column:
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)])

    kind = F.lower(F.coalesce(item_type, F.lit("")))
    (word, *values), *rest = V.TAXONOMY
    chain = F.when(F.contains(kind, F.lit(word)), entry(values))
    for word, *values in rest:
        chain = chain.when(F.contains(kind, F.lit(word)), entry(values))
    return chain.otherwise(entry([""] * 4))


def combined_specs(df: DataFrame) -> DataFrame:
    """Add ``specs``: evidence sections, then attributes they lack, then the remaining raw specs.

    Expects ``final``, ``raw_specs`` and ``spec_sections`` (an ordered spec list).
    """
    a = {n: _filled(c) for n, c in attribute_columns("final").items()}
    listed = F.transform("spec_sections", lambda s: s["k"])
    pairs = [
        ("Voltage Rating", ["Voltage Rating", "Voltage"], a["voltage"]),
        ("Size", ["Size", "Dimensions"], a["dimensions"]),
        ("Mounting Type", ["Mounting Type", "Mounting"], a["mounting"]),
        ("Material", ["Material"], a["material"]),
    ]
    derived = F.filter(
        F.array(
            *[
                F.when(
                    value.isNotNull()
                    & ~F.arrays_overlap(listed, F.array(*[F.lit(n) for n in names])),
                    spec(label, value),
                )
                for label, names, value in pairs
            ]
        ),
        lambda s: s.isNotNull(),
    )
    df = df.withColumn("_front", F.concat(F.col("spec_sections"), derived))
    rest = let(
        F.transform("_front", lambda s: s["k"]),
        lambda front: F.filter(
            "raw_specs", lambda s: ~F.array_contains(front, s["k"]) & (s["k"] != "spec_sections")
        ),
    )
    return df.withColumn("specs", F.concat(F.col("_front"), rest)).drop("_front")


def _slot_list(kind: str) -> Column:
    return literal_table(
        [{"label": label, "names": names} for label, names in V.SLOTS[kind]],
        "array<struct<label:string,names:array<string>>>",
    )


def slot_kind(item_type: Column) -> Column:
    text = F.lower(F.coalesce(item_type, F.lit("")))
    (kind, words), *rest = V.SLOT_KEYWORDS
    chain = F.when(text.rlike("|".join(words)), kind)
    for kind, words in rest:
        chain = chain.when(text.rlike("|".join(words)), kind)
    return chain.otherwise("default")


def _normal_name(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(c, r"[_\-\s]+", " ")))


def _slot(label: Column, value: Column) -> Column:
    empty = F.struct(label.alias("label"), F.lit("").alias("value"), F.lit("").alias("uom"))
    split = let(
        split_value_unit(value),
        lambda v: F.struct(label.alias("label"), v["value"].alias("value"), v["uom"].alias("uom")),
    )
    return F.when(value != "", split).otherwise(empty)


def _blank_slot() -> Column:
    return F.struct(F.lit("").alias("label"), F.lit("").alias("value"), F.lit("").alias("uom"))


def _pad(slots: Column, size: int) -> Column:
    return F.concat(slots, F.array_repeat(_blank_slot(), F.greatest(F.lit(size) - F.size(slots), F.lit(0))))


def align_slots(df: DataFrame, specs: str = "specs", item_type: str = "final.item_type") -> DataFrame:
    """Add ``slots``: 50 (label, value, uom), and ``overflow``: what does not fit into them.

    Slots 1..15 belong to fixed labels of the item kind and stay in place when empty; other specs follow from slot 16 in their own
    order, and in ``overflow`` beyond slot 50."""
    df = df.withColumn(
        "_named",
        F.transform(
            specs, lambda s: F.struct(_normal_name(s["k"]).alias("n"), s["k"].alias("k"), s["v"].alias("v"))
        ),
    )
    df = df.withColumn("_reversed", F.reverse(F.transform("_named", lambda s: s["n"])))
    size = F.size("_named")
    # of specs whose names normalize alike the last one counts
    df = df.withColumn(
        "_lookup",
        F.map_from_entries(
            F.transform(
                F.array_distinct("_reversed"),
                lambda n: F.struct(
                    n.alias("key"),
                    F.get(
                        F.col("_named"),
                        size - F.array_position(F.col("_reversed"), n).cast("int"),
                    ).alias("value"),
                ),
            )
        ),
    )
    kinds = [k for k, _ in V.SLOT_KEYWORDS]
    chosen = F.when(F.col("_kind") == kinds[0], _slot_list(kinds[0]))
    for kind in kinds[1:]:
        chosen = chosen.when(F.col("_kind") == kind, _slot_list(kind))
    df = df.withColumn("_kind", slot_kind(F.col(item_type)))
    # bound, since a column that is named once, and in a lambda, is unfolded there and evaluated for every name of every slot
    df = df.withColumn(
        "_matched",
        let(
            F.col("_lookup"),
            lambda known: F.transform(
                chosen.otherwise(_slot_list("default")),
                lambda slot: F.struct(
                    slot["label"].alias("label"),
                    F.get(
                        F.filter(
                            F.transform(slot["names"], lambda n: F.try_element_at(known, n)),
                            lambda hit: hit.isNotNull(),
                        ),
                        F.lit(0),
                    ).alias("hit"),
                ),
            ),
        ),
    )
    fixed = F.transform("_matched", lambda m: _slot(m["label"], m["hit"]["v"]))
    lowered = lambda s: F.lower(s["k"])
    open_ = let(
        F.transform("_matched", lambda m: m["hit"]["k"]),
        lambda used: F.filter(
            F.col("_named"),
            lambda s: ~F.coalesce(F.array_contains(used, s["k"]), F.lit(False))
            & ~lowered(s).isin(V.SLOT_EXCLUDED_SPECS)
            & ~F.startswith(lowered(s), F.lit("item_features"))
            & (strip(F.coalesce(s["v"], F.lit(""))) != ""),
        ),
    )
    extra = F.transform(open_, lambda s: _slot(s["k"], s["v"]))
    df = df.withColumns({"_fixed": _pad(fixed, 15), "_extra": extra})
    return _split_slots(df, F.col("_fixed"), F.col("_extra")).drop("_named", "_reversed", "_lookup", "_kind", "_matched", "_fixed", "_extra")


def align_fact_slots(df: DataFrame, category: str, facts: str) -> DataFrame:
    """Simpler slotting of an array of (label, value, uom): case-insensitive labels, no aliases; ``overflow`` as above."""
    text = F.upper(F.coalesce(F.col(category), F.lit("")))
    labels = lambda kind: literal_table(V.FACT_SLOT_LABELS[kind], "array<string>")
    df = df.withColumn(
        "_labels",
        F.when(F.contains(text, F.lit("DISHWASHER")), labels("DISHWASHER"))
        .when(F.contains(text, F.lit("TOOL")), labels("POWER_TOOL"))
        .otherwise(labels("GENERAL")),
    )
    named = F.filter(facts, lambda f: f["label"] != "")
    fixed = F.transform(
        "_labels",
        lambda name: F.struct(
            name.alias("label"),
            F.element_at(
                F.concat(
                    F.array(_blank_slot()),
                    F.filter(named, lambda f: F.lower(f["label"]) == F.lower(name)),
                ),
                -1,
            ).alias("hit"),
        ),
    )
    fixed = F.transform(
        fixed,
        lambda s: F.struct(
            s["label"].alias("label"),
            F.coalesce(s["hit"]["value"], F.lit("")).alias("value"),
            F.coalesce(s["hit"]["uom"], F.lit("")).alias("uom"),
        ),
    )
    known = F.transform("_labels", lambda n: F.lower(n))
    extra = F.transform(
        F.filter(named, lambda f: ~F.array_contains(known, F.lower(f["label"]))),
        lambda f: F.struct(
            f["label"].alias("label"),
            F.coalesce(f["value"], F.lit("")).alias("value"),
            F.coalesce(f["uom"], F.lit("")).alias("uom"),
        ),
    )
    df = df.withColumns({"_fixed": _pad(fixed, 15), "_extra": extra})
    return _split_slots(df, F.col("_fixed"), F.col("_extra")).drop("_labels", "_fixed", "_extra")


def _split_slots(df: DataFrame, fixed: Column, extra: Column) -> DataFrame:
    room = V.SLOT_COUNT - 15
    rest = F.when(F.size(extra) > room, F.slice(extra, room + 1, F.greatest(F.size(extra) - room, F.lit(0)))).otherwise(F.slice(extra, 1, 0))
    return df.withColumns({"slots": F.concat(fixed, _pad(F.slice(extra, 1, room), room)), "overflow": rest})


def overflow_long(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per spec that the slots of a record have no room for, numbered on from the last slot."""
    rows = df.select(*keys, F.posexplode("overflow").alias("_p", "_s"))
    return rows.select(*keys, (F.col("_p") + V.SLOT_COUNT + 1).alias("slot"), "_s.label", "_s.value", "_s.uom")


def slots_long(df: DataFrame, keys: list[str], slots: str = "slots") -> DataFrame:
    """One row per labelled slot."""
    return (
        df.select(*keys, F.posexplode(slots).alias("_p", "_s"))
        .where(F.col("_s.label") != "")
        .select(*keys, (F.col("_p") + 1).alias("slot"), "_s.label", "_s.value", "_s.uom")
    )


def unpivot_slots(df: DataFrame, keys: list[str]) -> DataFrame:
    """The 150 slot columns of delivery records as rows, unlabelled slots left out."""
    cell = lambda part, i: F.coalesce(F.col(f"`ATTRIBUTE_{part} {i}`"), F.lit(""))
    slots = F.array(
        *[
            F.struct(
                cell("LABEL", i).alias("label"), cell("VALUE", i).alias("value"), cell("UOM", i).alias("uom")
            )
            for i in range(1, V.SLOT_COUNT + 1)
        ]
    )
    return slots_long(df.select(*[F.col(f"`{k}`") for k in keys], slots.alias("slots")), keys)


# ------------------------------------------------------------------ record


def add_brand_url(df: DataFrame, brand: str, mpn: Column, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Add ``brand_url``: product page on the site of the (resolved) brand, else empty."""
    domains = {without.strip().lower(): d for without, d in (
        (name.replace("®", "").replace("™", ""), d) for name, d in vocab.domains.items()
    )}
    df = df.withColumn("_direct", lookup(domains, F.lower(without_marks(F.col(brand)))))
    df = add_brand_match(df, brand, "_resolved", 0.80, vocab, F.col("_direct").isNull())
    domain = F.coalesce("_direct", lookup(domains, F.lower(without_marks(F.col("_resolved.brand")))))
    return df.withColumn(
        "brand_url",
        F.coalesce(F.concat(F.lit("https://"), domain, F.lit("/product/"), mpn), F.lit("")),
    ).drop("_direct", "_resolved")


_COPIED_SPECS = [
    "Ref URL 1", "Ref URL 2", "With", "Standard/Approvals", "Warranty", "Product Image",
    "Alternate Image 1", "Alternate Image 2", "Alternate Image 3", "Alternate Image 4",
    "Specification Sheet",
]


def delivery_cells(raw: dict[str, Column], defaults: dict[str, str] = DELIVERY_DEFAULTS) -> dict[str, Column]:
    """Delivery column name to expression over an enriched row.

    ``raw`` maps feed columns to expressions; expects ``part_key``, ``final``, ``manufacturer``,
    ``brand``, ``raw_specs``, ``slots``, ``brand_url`` and the five descriptions.
    """
    key = F.col("part_key")
    brand = F.coalesce(_filled(F.col("final.brand")), _filled(F.col("brand")), F.lit(""))
    maker = F.coalesce(_filled(F.col("manufacturer")), brand)
    specs = F.col("raw_specs")
    value = lambda name: _filled(spec_value(specs, name))
    tax = taxonomy(F.col("final.item_type"))
    cells = {h: F.lit("") for h in V.DELIVERY_HEADERS}
    for name in ("PART_NUMBER", "Mfg_Part_Num", "MANUFACTURER_PART_NUMBER"):
        cells[name] = key
    desc = raw["Part_Desc"]
    cells["Part_Desc"] = F.coalesce(clean_placeholders(desc), desc)
    cells["SKU - MY_PART_NUMBER"] = F.coalesce(value("SKU"), key)
    for name, default in V.BRAND_DEFAULTS.items():
        cells[name] = text_or(raw[name], default)
    cells["Part_Manuf"] = text_or(raw["Part_Manuf"], maker)
    cells["MANUFACTURER_NAME"], cells["BRAND_NAME"] = maker, brand
    for name in ("Dept", "Class", "Fine", "Classpath"):
        cells[name] = tax[name]
    cells["MFR URL"] = F.coalesce(value("MFR URL"), _filled(F.col("final.mfr_url")), F.col("brand_url"))
    for name in _COPIED_SPECS:
        cells[name] = F.coalesce(spec_value(specs, name), F.lit(""))
    cells["MARKETING_DESCRIPTION"] = F.coalesce(
        value("MARKETING_DESCRIPTION"), value("Marketing Description"), F.lit("")
    )
    cells["Product Name"] = F.coalesce(
        value("Product Name"), _filled(F.col("final.item_type")), F.col("product_title")
    )
    features = F.from_json(spec_value(specs, "features"), "array<string>")
    for i in range(1, 12):
        cells[f"ITEM_FEATURES_{i}"] = F.coalesce(
            value(f"ITEM_FEATURES_{i}"), F.get(features, F.lit(i - 1)), F.lit("")
        )
    for column, source in zip(
        ("INVOICE_DESC", "MOBILE_DESC", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC"), DESCRIPTIONS
    ):
        cells[column] = F.col(source)
    cells["Actual Image (Yes/No)"] = F.when(value("Product Image").isNotNull(), "Yes").otherwise("No")
    cells.update({name: F.lit(text) for name, text in defaults.items()})
    for i in range(1, V.SLOT_COUNT + 1):
        slot = F.get("slots", F.lit(i - 1))
        for part in ("LABEL", "VALUE", "UOM"):
            cells[f"ATTRIBUTE_{part} {i}"] = slot[part.lower()]
    return cells


def fallback_cells(facts: dict[str, Column]) -> dict[str, Column]:
    """A record for a row that could not be processed: every required column is filled."""
    get = lambda name: _filled(facts[name]) if name in facts else F.lit(None).cast("string")
    first = lambda *names, default="": strip(F.coalesce(*[get(n) for n in names], F.lit(default)))
    mpn = first("Mfg_Part_Num", "mpn", "PART_NUMBER")
    desc = strip(
        F.coalesce(get("Part_Desc"), get("SHORT_DESC"), _filled(mpn), F.lit("Commercial Product"))
    )
    maker = first("Part_Manuf", "MANUFACTURER_NAME", default="Commercial Manufacturer")
    brand = strip(
        F.coalesce(get("BRAND_NAME"), get("Unilog_Brand"), _filled(maker), F.lit("Commercial Brand"))
    )
    name = strip(
        F.coalesce(get("Product Name"), get("PRODUCT_NAME"), F.substring(desc, 1, 30))
    )
    cells = {h: F.coalesce(facts.get(h, F.lit("")), F.lit("")) for h in V.DELIVERY_HEADERS}
    invoice = F.substring(
        strip(
            F.upper(
                F.concat(F.substring(brand, 1, 8), F.lit(" "), F.substring(name, 1, 15), F.lit(" "), mpn)
            )
        ),
        1, V.INVOICE_LIMIT,
    )
    guaranteed = {
        "PART_NUMBER": mpn, "Mfg_Part_Num": mpn, "MANUFACTURER_PART_NUMBER": mpn,
        "MANUFACTURER_NAME": maker, "BRAND_NAME": brand, "Product Name": name,
        "INVOICE_DESC": invoice,
        "MOBILE_DESC": F.substring(strip(F.concat_ws(" ", brand, name, mpn)), 1, 60),
        "Actual Image (Yes/No)": F.lit("No"),
    }
    for column, value in guaranteed.items():
        cells[column] = text_or(cells[column], value)
    return cells


def batch_fallback_cells(mpn: Column, desc: Column, manuf: Column) -> dict[str, Column]:
    """The shorter stand-in a batch job writes for a row that keeps failing."""
    maker = F.coalesce(_filled(manuf), F.lit("UNASSIGNED"))
    cells = {h: F.lit("") for h in V.DELIVERY_HEADERS}
    cells.update(
        {
            "PART_NUMBER": mpn, "Mfg_Part_Num": mpn, "Part_Desc": desc,
            "MANUFACTURER_NAME": maker, "BRAND_NAME": maker,
            "INVOICE_DESC": F.upper(F.substring(desc, 1, V.INVOICE_LIMIT)),
            "MOBILE_DESC": F.substring(desc, 1, 78),
            "Product Name": F.substring(desc, 1, 80),
            "Actual Image (Yes/No)": F.lit("No"),
        }
    )
    return cells


def project_delivery(df: DataFrame, cells: dict[str, Column], keys: list[str] = []) -> DataFrame:
    """Exactly the 252 delivery columns, in order, in one projection."""
    return df.select(*keys, *[cells[h].alias(h) for h in V.DELIVERY_HEADERS])


__all__ = ["SPECS_TYPE"] + [
    "add_brand_url", "align_fact_slots", "align_slots", "batch_fallback_cells", "channel_descriptions",
    "combined_specs", "delivery_cells", "fact_descriptions", "fallback_cells", "project_delivery",
    "slots_long", "taxonomy", "unpivot_slots",
]
