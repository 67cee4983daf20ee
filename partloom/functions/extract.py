"""Ordered, first-match-wins rules that read attributes out of a part description."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom.functions.text import let, strip, title_each
from partloom.functions.units import space_units
from partloom.vocab import DEFAULT, Vocabulary

# FIXED VALUES: category keywords, first hit wins, no hit is General Commercial.
CATEGORY_RULES = [
    ("Dishwasher", r"\b(dishwasher|dish\s*washer)\b"),
    ("Appliances", r"\b(refrigerator|fridge|range|oven|washing\s*machine|washer|dryer|water\s*heater)\b"),
    ("Faucets", r"\b(faucet|pre-rinse|prerinse|spout|lavatory\s*faucet|kitchen\s*faucet)\b"),
    ("Fittings", r"\b(pipe\s*fitting|tube\s*fitting|elbow|tee|coupling|adapter|union|nipple|bushing|reducer|flange|npt|mnpt|fnpt)\b"),
    ("Abrasives/Cutting Tools", r"\b(cut-off|cutoff|cut\s*off|sanding\s*belt|abrasive\s*disc|grinding\s*wheel|saw\s*blade|blade|disc|stikit|abranet|cubitron|hiolit|flap\s*disc)\b"),
]
DEFAULT_CATEGORY = "General Commercial"

# FIXED VALUES: material, mounting, item type and finish patterns in the order they are tried.
# Alternatives without a common \b are meant so: "Blade" matches inside a longer word.
MATERIAL_RULES = [
    ("Stainless Steel", r"\b(?:SS|Stainless(?:\s*Steel)?|SST)\b"),
    ("Chrome Plated Brass", r"\b(?:Chrome(?:\s*Plated)?\s*Brass)\b"),
    ("Brass", r"\b(?:Solid\s*Brass|Brass)\b"),
    ("Copper", r"\b(?:Copper)\b"),
    ("Cast Iron", r"\b(?:Cast\s*Iron)\b"),
    ("Ductile Iron", r"\b(?:Ductile\s*Iron)\b"),
    ("Aluminum", r"\b(?:Aluminum|Alum)\b"),
    ("Aluminum Oxide", r"\b(?:Aluminum\s*Oxide|Alox)\b"),
    ("Zirconia Alumina", r"\b(?:Zirconia(?:\s*Alumina)?)\b"),
    ("Carbide", r"\b(?:Carbide(?:\s*Tipped)?)\b"),
    ("Carbon Steel", r"\b(?:Carbon(?:\s*Steel)?|Metal)\b"),
]
MOUNTING_RULES = [
    ("Built-In", r"\bBuilt[- ]?in\b"),
    ("Deck Mount", r"\bDeck[- ]?Mount(?:ed)?\b"),
    ("Wall Mount", r"\bWall[- ]?Mount(?:ed)?\b"),
    ("Centerset", r"\bCenterset\b"),
    ("Widespread", r"\bWidespread\b"),
    ("Single Hole", r"\bSingle[- ]?Hole\b"),
    ("Freestanding", r"\bFreestanding\b"),
    ("Leg", r"\bLeg\b"),
]
ITEM_TYPE_RULES = [
    ("Pre-Rinse Faucet", r"\bPre[- ]?Rinse(?:\s*Faucet)?\b"),
    ("Kitchen Faucet", r"\bKitchen\s*Faucet\b"),
    ("Lavatory Faucet", r"\bLavatory\s*Faucet|Lav\s*Faucet\b"),
    ("Commercial Faucet", r"\bCommercial\s*Faucet\b"),
    ("Faucet", r"\bFaucet\b"),
    ("Elbow", r"\b(?:90|45)?\s*Elbow\b"),
    ("Tee", r"\bTee\b"),
    ("Coupling", r"\bCoupling\b"),
    ("Adapter", r"\bAdapter\b"),
    ("Union", r"\bUnion\b"),
    ("Pipe Fitting", r"\bPipe\s*Fitting\b"),
    ("Flange", r"\bFlange\b"),
    ("Cut-Off Disc", r"\bCut[- ]?Off\s*(?:Disc|Wheel)\b"),
    ("Sanding Belt", r"\bSanding\s*Belt\b"),
    ("Abrasive Disc", r"\bAbrasive\s*Disc|Stikit|Abranet|Hiolit\b"),
    ("Grinding Wheel", r"\bGrinding\s*Wheel\b"),
    ("Saw Blade", r"\bSaw\s*Blade|Blade\b"),
    ("Drill Bit", r"\bDrill\s*Bit|Bit\b"),
    ("Dishwasher", r"\bDishwasher\b"),
    ("Refrigerator", r"\bRefrigerator\b"),
    ("Range", r"\bRange|Oven\b"),
    ("Washing Machine", r"\bWashing\s*Machine|Washer\b"),
    ("Dryer", r"\bDryer\b"),
]
FINISH_RULES = [
    ("Chrome", r"\b(?:Polished\s*Chrome|Chrome|CP)\b"),
    ("Brushed Nickel", r"\b(?:Brushed\s*Nickel|BN)\b"),
    ("Matte Black", r"\b(?:Matte\s*Black|MB)\b"),
]
EVIDENCE_MOUNTING_RULES = [("Built-In", r"\bBuilt[- ]?in\b"), ("Leg", r"\bLeg\b"), ("Freestanding", r"\bFreestanding\b")]

# FIXED VALUES: measured attributes.
VOLTAGE = r"(?i)\b(\d{2,3}(?:\.\d+)?)\s*(?:v(?:olts?)?)\b"
DIMENSIONS = (
    r"""(?i)\b((?:\d+[- ])?\d+(?:/\d+)?(?:\.\d+)?\s*(?:in(?:ch(?:es)?)?|\"|'|ft|mm|cm)(?:\s*[xX]\s*(?:\d+[- ])?\d+(?:/\d+)?(?:\.\d+)?\s*(?:in(?:ch(?:es)?)?|\"|'|ft|mm|cm)?)*)\b"""
)
PLAIN_DIMENSIONS = r"(?i)\b(\d+(?:[-/]\d+)?(?:\.\d+)?\s*[xX]\s*\d+(?:[-/]\d+)?(?:\.\d+)?(?:\s*[xX]\s*\d+(?:[-/]\d+)?(?:\.\d+)?)?)\b"
FLOW_RATE = r"(?i)\b(\d+(?:\.\d+)?)\s*(?:gpm|gal/min)\b"
PIPE_THREAD = r"(?i)\b(MNPT|FNPT|NPT)\b"
CONNECTION = r"(?i)\b(Compression|Socket Weld|Push-to-Connect|Press|Flanged|Soldered|Threaded)\b"
PRESSURE_PSI = r"(?i)\b(\d+)\s*(?:psi|psig)\b"
PRESSURE_LB = r"(?i)\b(\d+)\s*(?:lb|#)\b"
GRIT = r"\b(?:P|p-?)(\d{2,4})\b|\b(\d{2,4})\s*(?:Grit|grit)\b"
ARBOR = r"(?i)x\s*(\d+(?:/\d+)?(?:\.\d+)?\s*(?:in|\"|mm)?)\s*(?:arbor|hole|disc|wheel)?\b"
AMPERAGE = r"(?i)\b(\d+)\s*(?:a|amps?|amperage)\b"
AMPERAGE_DECIMAL = r"(?i)\b(\d+(?:\.\d+)?)\s*(?:a|amps?|amperage)\b"
SOUND_LEVEL = r"(?i)\b(\d+)\s*(?:dba|db)\b"
PACK_QUANTITY = r"(?i)\b(\d+)\s*(?:pc|pack|pk|disc/box)\b"
LEADING_PART_NUMBER = r"^([A-Z0-9\-]+)"


# Lower-case text every match of a rule contains (one of them, when several are given).  Looking for
# it costs a fraction of the regex, and most rules do not apply to most descriptions.
_HINTS = {
    "Dishwasher": "dish", "Faucets": "faucet rinse spout", "Stainless Steel": "ss", "Brass": "brass",
    "Chrome Plated Brass": "chrome", "Copper": "copper", "Cast Iron": "cast", "Ductile Iron": "ductile",
    "Aluminum": "alum", "Aluminum Oxide": "alum alox", "Zirconia Alumina": "zirconia",
    "Carbide": "carbide", "Carbon Steel": "carbon metal", "Built-In": "built", "Deck Mount": "deck",
    "Wall Mount": "wall", "Centerset": "centerset", "Widespread": "widespread", "Single Hole": "single",
    "Freestanding": "freestanding", "Leg": "leg", "Pre-Rinse Faucet": "rinse",
    "Kitchen Faucet": "faucet", "Lavatory Faucet": "faucet", "Commercial Faucet": "faucet",
    "Faucet": "faucet", "Elbow": "elbow", "Tee": "tee", "Coupling": "coupling", "Adapter": "adapter",
    "Union": "union", "Pipe Fitting": "fitting", "Flange": "flange", "Cut-Off Disc": "cut",
    "Sanding Belt": "sanding", "Abrasive Disc": "abrasive stikit abranet hiolit",
    "Grinding Wheel": "grinding", "Saw Blade": "blade", "Drill Bit": "bit",
    "Refrigerator": "refrigerator", "Range": "range oven", "Washing Machine": "wash", "Dryer": "dryer",
    "Chrome": "chrome cp", "Brushed Nickel": "nickel bn", "Matte Black": "black mb",
}


def _holds(text: Column, words: str) -> Column:
    first, *rest = words.split()
    test = F.contains(text, F.lit(first))
    for word in rest:
        test = test | F.contains(text, F.lit(word))
    return test


def first_rule(c: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first rule that matches."""

    def chain(text: Column) -> Column:
        out = None
        for label, pattern in rules:
            test = text.rlike(f"(?i){pattern}")
            if label in _HINTS:
                test = _holds(text, _HINTS[label]) & test
            out = F.when(test, label) if out is None else out.when(test, label)
        return out.otherwise(F.lit(default))

    return let(F.lower(c), chain)


# the same for measured attributes; a pattern that is not listed is always tried
_CAPTURE_HINTS = {
    "FLOW_RATE": "gpm gal/min", "PRESSURE_PSI": "psi", "PRESSURE_LB": "lb #", "SOUND_LEVEL": "db",
}


def capture(c: Column, pattern: str, suffix: str = "", prefix: str = "", group: int = 1) -> Column:
    """One group of the first match between fixed affixes; null when nothing matches."""
    hit = F.regexp_extract(c, pattern, group)
    if prefix or suffix:
        hit = F.concat(F.lit(prefix), hit, F.lit(suffix))
    test = c.rlike(pattern)
    for name, words in _CAPTURE_HINTS.items():
        if globals()[name] == pattern:
            test = _holds(F.lower(c), words) & test
    return F.when(test, hit)


def category(desc: Column, mpn: Column, brand: Column) -> Column:
    none = F.lit("")
    text = F.lower(
        F.concat_ws(" ", F.coalesce(desc, none), F.coalesce(mpn, none), F.coalesce(brand, none))
    )
    return first_rule(text, CATEGORY_RULES, DEFAULT_CATEGORY)


def voltage(c: Column) -> Column:
    return capture(c, VOLTAGE, " V")


def measured_dimensions(c: Column, vocab: Vocabulary = DEFAULT) -> Column:
    """Dimensions that carry a unit, in standard spelling."""
    return F.when(
        c.rlike(DIMENSIONS), space_units(strip(F.regexp_extract(c, DIMENSIONS, 1)), vocab)
    )


def dimensions(c: Column, vocab: Vocabulary = DEFAULT) -> Column:
    """Dimensions with a unit, else a bare ``AxB`` or ``AxBxC``."""
    plain = F.when(
        c.rlike(PLAIN_DIMENSIONS),
        space_units(strip(F.regexp_extract(c, PLAIN_DIMENSIONS, 1)), vocab),
    )
    return F.coalesce(measured_dimensions(c, vocab), plain)


def material(c: Column) -> Column:
    return first_rule(c, MATERIAL_RULES)


def mounting(c: Column) -> Column:
    return first_rule(c, MOUNTING_RULES)


def item_type(c: Column) -> Column:
    return first_rule(c, ITEM_TYPE_RULES)


def part_number(c: Column) -> Column:
    return capture(strip(c), LEADING_PART_NUMBER)


def _connection(c: Column) -> Column:
    thread = F.when(_holds(F.lower(c), "npt") & c.rlike(PIPE_THREAD), F.upper(F.regexp_extract(c, PIPE_THREAD, 1)))
    joint = F.when(
        c.rlike(CONNECTION), title_each(F.lower(F.regexp_extract(c, CONNECTION, 1)))
    )
    return F.coalesce(thread, joint)


def _grit(c: Column) -> Column:
    both = F.concat(F.regexp_extract(c, GRIT, 1), F.regexp_extract(c, GRIT, 2))
    return F.when(c.rlike(GRIT), F.concat(F.lit("P"), both))


def _arbor(c: Column, dims: Column) -> Column:
    size = F.regexp_extract(c, ARBOR, 1)
    return F.when(
        c.rlike(ARBOR) & (dims != "") & ~F.contains(dims, size),
        strip(F.replace(size, F.lit('"'), F.lit(" in"))),
    )


def spec(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("k"), value.alias("v"))


def raw_specs(c: Column, dims: Column) -> Column:
    """Category-specific specs as an ordered array of (name, value); absent ones are left out."""
    found = F.array(
        spec("FlowRate", capture(c, FLOW_RATE, " GPM")),
        spec("ConnectionType", _connection(c)),
        spec(
            "PressureRating",
            F.coalesce(capture(c, PRESSURE_PSI, " PSI"), capture(c, PRESSURE_LB, " LB")),
        ),
        spec("Grit", _grit(c)),
        spec("ArborSize", _arbor(c, dims)),
        spec("Finish", first_rule(c, FINISH_RULES)),
        spec("Amperage", capture(c, AMPERAGE, " A")),
        spec("SoundLevel", capture(c, SOUND_LEVEL, " dBA")),
        spec("PackQuantity", capture(c, PACK_QUANTITY, " PK")),
    )
    return F.filter(found, lambda s: s["v"].isNotNull())
