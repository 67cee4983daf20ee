"""Master data: brands, units, fractions, vocabularies, category schemas, delivery headers.

Everything in this file is data.  The blocks marked FIXED VALUES must equal the published catalog
standard for results to agree with it, so they are written out plainly.  These tables come with the package and do not
grow with the data; master tables that do are DataFrames, which ``operators.master`` joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import cached_property

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: raw feed columns, delivery headers
# ---------------------------------------------------------------------------------------------

FEED_COLUMNS = ["Mfg_Part_Num", "Part_Desc", "E1_Brand", "Unilog_Brand", "DIB_Brand", "Part_Manuf"]

PART_ALIASES = ["Mfg_Part_Num", "PART_NUMBER", "MPN", "Part_Number"]
DESC_ALIASES = ["Part_Desc", "Description", "PART_DESC"]
MANUF_ALIASES = ["Part_Manuf", "Manufacturer", "PART_MANUF"]

SLOT_COUNT = 50
FEATURE_COUNT = 20

_HEADERS_BEFORE_FEATURES = [
    "MFR URL", "Ref URL 1", "Ref URL 2", "Ref URL 3", "Ref URL 4", "Ref URL 5", "PART_NUMBER", "Dept", "Class",
    "Fine", "SKU - MY_PART_NUMBER", "Mfg_Part_Num", "Part_Desc", "E1_Brand", "Unilog_Brand", "DIB_Brand",
    "Part_Manuf", "MANUFACTURER_NAME", "BRAND_NAME", "TRADE_NAME", "MANUFACTURER_PART_NUMBER",
    "ALTERNATE_PART_NUMBER", "Classpath", "MOBILE_DESC", "INVOICE_DESC", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC",
    "MARKETING_DESCRIPTION",
]

_HEADERS_BEFORE_SLOTS = ["With", "Standard/Approvals", "Prop 65", "Application", "Includes", "Product Name"]

_HEADERS_AFTER_SLOTS = [
    "UPC", "EAN", "GTIN", "UNSPSC", "Warranty", "List Price", "Selling Qty", "Selling UOM",
    "Standard Packaging Information", "LENGTH", "LENGTH_UOM", "HEIGHT", "HEIGHT_UOM", "WIDTH", "WIDTH_UOM", "WEIGHT",
    "WEIGHT_UOM", "VOLUME", "VOLUME_UOM", "Product Image", "Alternate Image 1", "Alternate Image 2",
    "Alternate Image 3", "Alternate Image 4", "SDS", "SDS_1", "Warranty Information", "Catalog",
    "Specification Sheet", "Instruction/Installation Manual", "Service Manual", "Owners/User Manual", "Line Drawing",
    "MTR", "RoHS", "Full Engineering Drawing", "Energy Star Guide", "Technical Bulletin", "Submittal",
    "Compatibility Chart", "Size Chart", "Product Label/Insert", "Video Link", "Video Link 1", "Country Of Origin",
    "Discontinued", "Actual Image (Yes/No)",
]

FEATURE_HEADERS = [f"ITEM_FEATURES_{i}" for i in range(1, FEATURE_COUNT + 1)]
SLOT_HEADERS = [
    f"ATTRIBUTE_{part} {i}" for i in range(1, SLOT_COUNT + 1) for part in ("LABEL", "VALUE", "UOM")
]
DELIVERY_HEADERS = [
    *_HEADERS_BEFORE_FEATURES, *FEATURE_HEADERS, *_HEADERS_BEFORE_SLOTS, *SLOT_HEADERS, *_HEADERS_AFTER_SLOTS,
]

REQUIRED_HEADERS = [
    "PART_NUMBER", "Mfg_Part_Num", "Part_Desc", "MANUFACTURER_NAME", "BRAND_NAME", "MANUFACTURER_PART_NUMBER",
    "INVOICE_DESC", "MOBILE_DESC", "Product Name", "Actual Image (Yes/No)",
]

LEAK_EXEMPT_HEADERS = ["E1_Brand", "Unilog_Brand", "DIB_Brand", "TRADE_NAME"]

_COMPARED_BEFORE_FEATURES = [
    "BRAND_NAME", "MANUFACTURER_NAME", "MANUFACTURER_PART_NUMBER", "MOBILE_DESC", "INVOICE_DESC", "SHORT_DESC",
    "LONG_DESC1", "RETAIL_DESC", "MARKETING_DESCRIPTION", "Classpath", "Dept", "Class", "Fine", "MFR URL",
    "Product Name", "With", "Standard/Approvals", "Warranty", "Country Of Origin", "Discontinued", "Selling Qty",
    "Selling UOM", "Product Image", "Specification Sheet", "Actual Image (Yes/No)",
]
COMPARISON_FIELDS = [
    *_COMPARED_BEFORE_FEATURES, *FEATURE_HEADERS, *SLOT_HEADERS, "UPC", "EAN", "GTIN", "UNSPSC",
]

# Comparison fields on which "5" and "5.0" are never the same thing.
NON_NUMERIC_FIELDS = [
    "PART_NUMBER", "Mfg_Part_Num", "MANUFACTURER_PART_NUMBER", "SKU - MY_PART_NUMBER", "ALTERNATE_PART_NUMBER",
    "MOBILE_DESC", "INVOICE_DESC", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC", "MARKETING_DESCRIPTION", "MFR URL",
    "Ref URL 1", "Ref URL 2", "Ref URL 3", "Ref URL 4", "Ref URL 5", "UPC", "EAN", "GTIN", "UNSPSC", "Product Name",
    "Classpath", "Dept", "Class", "Fine", "BRAND_NAME", "MANUFACTURER_NAME", "TRADE_NAME", "E1_Brand", "Unilog_Brand",
    "DIB_Brand", "Part_Manuf",
]

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: null words and placeholder noise
# ---------------------------------------------------------------------------------------------

NULL_WORDS = ["nan", "none", "null", "<na>", "n/a", "tbd", "unknown", "???", ""]
EMPTY_WORDS = ["", "nan", "none", "null"]
FIELD_PLACEHOLDERS = [
    "-- unbranded --", "-- no unilog brand --", "-- no dib brand --",
    "n/a", "none", "null", "unknown", "undefined",
]
BRAND_PLACEHOLDERS = [
    "-- Unbranded --", "-- No Unilog Brand --", "-- No DIB Brand --", "-", "nan", "None",
]
BRAND_DEFAULTS = {
    "E1_Brand": "-- Unbranded --",
    "Unilog_Brand": "-- No Unilog Brand --",
    "DIB_Brand": "-- No DIB Brand --",
}

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: brands
# ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Brand:
    name: str
    manufacturer: str
    aliases: tuple[str, ...] = ()
    domain: str | None = None
    prefixes: tuple[str, ...] = ()


# canonical name, legal manufacturer, aliases, web domain, part-number prefixes
BRANDS = (
    Brand(
        "FRIGIDAIRE®", "Rheem Manufacturing",
        ("frigidaire", "frigid air", "frigidaire appliances", "frigidaire professional"),
        "www.frigidaire.com", ("pdsh", "ffbd", "fgid", "fdpc", "ffcd", "fgip"),
    ),
    Brand(
        "WHIRLPOOL®", "Whirlpool Corporation",
        ("whirlpool", "whirlpool corporation", "whirlpool appliances"),
        "www.whirlpool.com", ("wdts", "wdt", "wdp", "wdfe", "wdra", "wdf"),
    ),
    Brand(
        "MILWAUKEE®", "Milwaukee Electric Tool Corporation",
        ("milwaukee", "milwaukee accessory", "milwaukee tool", "milwaukee electric"),
        "www.milwaukeetool.com", ("48-", "49-", "28", "27", "26"),
    ),
    Brand(
        "FREUD®", "Robert Bosch Tool Corporation",
        ("freud", "freud inc", "freud tools"),
        "www.freudtools.com", ("dcb", "dbds", "ds", "d07", "d10", "d12"),
    ),
    Brand(
        "DIABLO®", "Freud Tools / Robert Bosch Tool Corporation",
        ("diablo", "diablo saw blades", "diablo tools"),
        "www.diablotools.com", ("dcb", "dbds", "d07", "d10", "d12"),
    ),
    Brand(
        "3M™", "3M Company",
        ("3m", "3m company", "3m commercial", "3m abrasives"),
        "www.3m.com", ("3mabr-", "3m", "71000", "7000"),
    ),
    Brand(
        "DEWALT®", "Stanley Black & Decker",
        ("dewalt", "black & decker/dewlt", "black & decker", "dewalt industrial"),
        "www.dewalt.com", ("dwa", "dw", "dcm", "dcs"),
    ),
    Brand(
        "SATCO®", "Satco Products Inc",
        ("satco", "satco prod inc", "satco products", "nuvo"),
        "www.satco.com", ("65-", "62-", "s9", "s11", "s12"),
    ),
    Brand(
        "LEVITON®", "Leviton Manufacturing Co., Inc.",
        ("leviton", "leviton mfg co", "leviton manufacturing"),
        "www.leviton.com", ("lev", "5262", "5362"),
    ),
    Brand(
        "FESTOOL®", "Festool GmbH",
        ("festool", "festool usa", "festool tools"),
        "www.festoolusa.com", ("57", "49", "20"),
    ),
    Brand(
        "SOUTHWIRE®", "Southwire Company",
        ("southwire", "southwire/g turner", "southwire company"),
        "www.southwire.com", ("sw", "55"),
    ),
    Brand(
        "KICHLER®", "Kichler Lighting LLC",
        ("kichler", "kichler lighting", "kichler lighting group"),
        "www.kichler.com", ("37", "42", "43", "45", "52", "55"),
    ),
    Brand(
        "MAKITA®", "Makita Corporation",
        ("makita", "makita usa inc", "makita tools"),
        "www.makitatools.com", ("mak", "a-", "b-", "t-", "e-"),
    ),
    Brand(
        "BOISE CASCADE®", "Boise Cascade Company",
        ("boise cascade", "boise cascade building materials"),
        "www.bc.com", ("1513", "1516"),
    ),
    Brand(
        "KREG®", "Kreg Tool Company",
        ("kreg", "kreg tool company", "kreg tools"),
        "www.kregtool.com", ("kreg", "khc", "kpc"),
    ),
    Brand(
        "EDGE SAFETY®", "Edge Eyewear",
        ("edge safety", "edge eyewear", "edge safety products"),
        "www.edgeeyewear.com", ("ts", "vs", "dz"),
    ),
    Brand(
        "U.S. TAPE®", "U.S. Tape Company",
        ("u.s. tape", "u s tape company", "us tape"),
        "www.ustape.com", ("58", "59"),
    ),
    Brand(
        "PARKSITE®", "Parksite Inc.",
        ("parksite", "parksite inc"),
        "www.parksite.com", ("pk",),
    ),
    Brand(
        "PHILIPS LIGHTING®", "Signify N.V.",
        ("philips", "philips lighting", "phillips lighting"),
        "www.lighting.philips.com", ("pl",),
    ),
    Brand(
        "SQUARE D®", "Schneider Electric",
        ("square d", "squared", "square d company"),
        "www.se.com", ("hom", "qo", "pk"),
    ),
    Brand(
        "EATON®", "Eaton Corporation",
        ("eaton", "eaton corporation", "eaton electrical", "cutler-hammer"),
        "www.eaton.com", ("br", "ch"),
    ),
    Brand(
        "BOSCH®", "Robert Bosch GmbH",
        ("bosch", "robert bosch", "bosch power tools"),
        "www.boschtools.com", ("11", "12", "16", "31", "40"),
    ),
    Brand(
        "KLEIN TOOLS®", "Klein Tools Inc.",
        ("klein tools", "klein", "klein tools inc"),
        "www.kleintools.com", ("d2", "11", "32"),
    ),
    Brand(
        "MIRKA®", "Mirka Ltd.",
        ("mirka", "mirka abrasives", "mirka abrasives inc", "mirus"),
        "www.mirka.com", ("mirk", "23-", "9a-"),
    ),
)

DISTRIBUTOR_TOKENS = [
    "cooperative", "coop", "appde", "dealers", "distributor", "distributing", "wholesale",
    "supply llc", "electric inc", "building materials", "enterprises", "palmer donavin",
    "jam industrial", "fenton bros", "wesco", "graybar", "grainger",
]

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: units, fractions, global vocabularies, attribute definitions
# ---------------------------------------------------------------------------------------------

# spelling: standard unit
UNITS = {
    "in": "in", "inch": "in", "inches": "in", '"': "in", "ft": "ft", "foot": "ft", "feet": "ft", "'": "ft", "v": "V",
    "volt": "V", "volts": "V", "a": "A", "amp": "A", "amps": "A", "amperage": "A", "w": "W", "watt": "W",
    "watts": "W", "hz": "Hz", "hertz": "Hz", "rpm": "RPM", "dba": "dBA", "db": "dBA", "decibel": "dBA",
    "decibels": "dBA", "mm": "mm", "millimeter": "mm", "cm": "cm", "centimeter": "cm", "m": "m", "meter": "m",
    "lb": "lb", "lbs": "lb", "pound": "lb", "pounds": "lb", "oz": "oz", "ounce": "oz", "pk": "PK", "pack": "PK",
    "package": "PK", "pc": "PC", "piece": "PC", "pieces": "PC", "ea": "EA", "each": "EA", "gpm": "GPM", "psi": "PSI",
}

# decimal: fraction
FRACTIONS = {
    0.125: "1/8", 0.25: "1/4", 0.375: "3/8", 0.5: "1/2", 0.625: "5/8", 0.75: "3/4", 0.875: "7/8", 0.0625: "1/16",
    0.1875: "3/16", 0.3125: "5/16", 0.4375: "7/16", 0.5625: "9/16", 0.6875: "11/16", 0.8125: "13/16", 0.9375: "15/16",
}

GLOBAL_LOVS = {
    "item_type": [
        "Dishwasher", "Refrigerator", "Range", "Microwave", "Oven", "Cut-Off Disc", "Saw Blade", "Grinding Wheel",
        "Flap Disc", "Wire Wheel", "Drill Bit", "Faucet", "Kitchen Faucet", "Lavatory Faucet", "Commercial Faucet",
        "Pipe Fitting", "Tube Fitting", "Elbow", "Tee", "Coupling", "Adapter", "Union", "Nipple", "Switch",
        "Receptacle", "Wire", "Cable", "Luminaire", "Light Bulb", "Safety Glasses",
    ],
    "mounting": [
        "Built-In", "Built-in Mounting", "Freestanding", "Leg", "Leg Mounting", "Undercounter", "Wall Mount",
        "Panel Mount", "Surface Mount", "Flush Mount", "Deck Mount",
    ],
    "material": [
        "Stainless Steel", "SST", "Aluminum", "Carbon Steel", "Brass", "Solid Brass", "Chrome Plated Brass", "Copper",
        "Plastic", "Ceramic", "Carbide", "Bi-Metal",
    ],
    "voltage": ["120 V", "240 V", "208 V", "277 V", "480 V", "12 V", "18 V", "20 V"],
    "finish": ["Chrome", "Polished Chrome", "Brushed Nickel", "Matte Black", "Stainless Steel"],
    "grit": ["P36", "P40", "P60", "P80", "P120", "P150", "P180", "P220", "P320", "P400"],
    "arbor_size": ["1/4 in", "3/8 in", "1/2 in", "5/8 in", "7/8 in", "1 in", "20 mm", "5/8-11 in"],
}

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: category schemas
# ---------------------------------------------------------------------------------------------

CATEGORY_REQUIRED = {
    "Faucets": ["brand", "item_type", "mpn", "mounting"],
    "Fittings": ["brand", "item_type", "mpn", "material", "connection_type"],
    "Abrasives/Cutting Tools": ["brand", "item_type", "mpn", "dimensions", "material"],
    "Appliances": ["brand", "item_type", "mpn", "voltage", "dimensions"],
    "Dishwasher": ["brand", "item_type", "mpn", "voltage", "dimensions"],
    "Saw Blade": ["brand", "item_type", "mpn", "dimensions"],
    "Cut-Off Disc": ["brand", "item_type", "mpn", "dimensions"],
    "General Commercial": ["brand", "item_type", "mpn"],
}

CATEGORY_LOVS = {
    "Faucets": {
        "item_type": [
            "Faucet", "Commercial Faucet", "Kitchen Faucet", "Lavatory Faucet", "Pre-Rinse Faucet", "Utility Faucet",
            "Bar Faucet",
        ],
        "mounting": ["Deck Mount", "Wall Mount", "Centerset", "Widespread", "Single Hole", "Vessel", "Floor Mount"],
        "material": ["Brass", "Solid Brass", "Chrome Plated Brass", "Stainless Steel", "Zinc", "Bronze"],
        "flow_rate": ["0.5 GPM", "1.0 GPM", "1.2 GPM", "1.5 GPM", "1.8 GPM", "2.0 GPM", "2.2 GPM"],
        "finish": [
            "Chrome", "Polished Chrome", "Brushed Nickel", "Matte Black", "Stainless Steel", "Brass",
            "Oil Rubbed Bronze",
        ],
    },
    "Fittings": {
        "item_type": [
            "Pipe Fitting", "Tube Fitting", "Elbow", "Tee", "Coupling", "Adapter", "Union", "Nipple", "Bushing",
            "Reducer", "Cap", "Plug", "Flange",
        ],
        "material": [
            "Brass", "Stainless Steel", "Copper", "Carbon Steel", "PVC", "CPVC", "Cast Iron", "Ductile Iron",
            "Malleable Iron", "PEX", "Bronze",
        ],
        "connection_type": [
            "NPT", "MNPT", "FNPT", "Threaded", "Compression", "Socket Weld", "Butt Weld", "Flanged",
            "Push-to-Connect", "Soldered", "Press",
        ],
        "pressure_rating": ["125 LB", "150 LB", "150 PSI", "300 LB", "300 PSI", "600 PSI", "1000 PSI", "2000 PSI", "3000 PSI"],
    },
    "Abrasives/Cutting Tools": {
        "item_type": [
            "Cut-Off Disc", "Cut-Off Wheel", "Sanding Belt", "Abrasive Disc", "Saw Blade", "Grinding Wheel",
            "Flap Disc", "Wire Wheel", "Drill Bit", "Carbide Bur",
        ],
        "material": [
            "Aluminum Oxide", "Ceramic", "Silicon Carbide", "Zirconia Alumina", "Diamond", "Carbide",
            "High Speed Steel", "Bi-Metal", "Carbon Steel",
        ],
        "grit": [
            "P36", "P40", "P60", "P80", "P120", "P150", "P180", "P220", "P320", "P400", "P600", "36 Grit", "60 Grit",
            "80 Grit", "120 Grit",
        ],
        "arbor_size": ["1/4 in", "3/8 in", "1/2 in", "5/8 in", "7/8 in", "1 in", "20 mm", "5/8-11 in"],
    },
    "Appliances": {
        "item_type": [
            "Dishwasher", "Built-In Dishwasher", "Commercial Dishwasher", "Refrigerator", "Range", "Oven",
            "Washing Machine", "Dryer", "Water Heater",
        ],
        "voltage": ["120 V", "240 V", "120/240 V", "208 V", "277 V", "480 V"],
        "amperage": ["10 A", "15 A", "20 A", "30 A", "50 A"],
        "mounting": ["Built-In", "Freestanding", "Leg", "Undercounter", "Wall Mount"],
        "material": ["Stainless Steel", "Plastic", "Cast Iron", "Porcelain"],
        "sound_level": ["38 dBA", "41 dBA", "44 dBA", "47 dBA", "50 dBA"],
    },
    "Dishwasher": {
        "item_type": ["Dishwasher", "Built-In Dishwasher", "Commercial Dishwasher"],
        "mounting": ["Built-In", "Freestanding", "Leg", "Undercounter"],
        "material": ["Stainless Steel", "Plastic", "Cast Iron", "Porcelain"],
        "voltage": ["120 V", "240 V", "120/240 V", "480 V"],
    },
    "Saw Blade": {
        "item_type": ["Saw Blade", "Circular Saw Blade", "Miter Saw Blade", "Table Saw Blade", "Reciprocating Saw Blade"],
        "material": ["Carbide", "High Speed Steel", "Diamond", "Bi-Metal", "Carbon Steel"],
    },
    "Cut-Off Disc": {
        "item_type": ["Cut-Off Disc", "Cut-Off Wheel", "Grinding Wheel", "Abrasive Disc"],
        "material": ["Aluminum Oxide", "Ceramic", "Silicon Carbide", "Zirconia Alumina"],
    },
    "General Commercial": {
        "mounting": ["Built-In", "Freestanding", "Leg", "Wall Mount", "Surface Mount", "Deck Mount"],
        "material": ["Stainless Steel", "Aluminum", "Carbon Steel", "Carbide", "Plastic", "Brass", "Bronze"],
        "voltage": ["120 V", "240 V", "120/240 V", "480 V", "12 V", "18 V", "20 V"],
    },
}

# spelling: canonical value, by category and field
CATEGORY_SYNONYMS = {
    "Faucets": {
        "mounting": {
            "deck": "Deck Mount", "deck mount": "Deck Mount", "deck-mount": "Deck Mount", "wall": "Wall Mount",
            "wall mount": "Wall Mount", "wall-mount": "Wall Mount", "centerset": "Centerset",
            "center set": "Centerset", "center-set": "Centerset", "widespread": "Widespread",
            "wide spread": "Widespread", "single hole": "Single Hole", "1 hole": "Single Hole",
        },
        "flow_rate": {
            "0.5gpm": "0.5 GPM", "0.5 gpm": "0.5 GPM", "1.0gpm": "1.0 GPM", "1.2gpm": "1.2 GPM", "1.5gpm": "1.5 GPM",
            "1.5 gpm": "1.5 GPM", "1.8gpm": "1.8 GPM", "2.0gpm": "2.0 GPM", "2.2gpm": "2.2 GPM", "2.2 gpm": "2.2 GPM",
        },
        "material": {
            "chrome brass": "Chrome Plated Brass", "chrome-plated brass": "Chrome Plated Brass",
            "solid brass": "Solid Brass", "brass": "Brass", "ss": "Stainless Steel", "sst": "Stainless Steel",
            "stainless": "Stainless Steel",
        },
        "finish": {
            "cp": "Chrome", "polished chrome": "Polished Chrome", "bn": "Brushed Nickel",
            "brushed nickel": "Brushed Nickel", "mb": "Matte Black", "matte black": "Matte Black",
            "orb": "Oil Rubbed Bronze",
        },
        "item_type": {
            "faucet": "Faucet", "kitchen faucet": "Kitchen Faucet", "lav faucet": "Lavatory Faucet",
            "lavatory faucet": "Lavatory Faucet", "pre rinse": "Pre-Rinse Faucet", "prerinse": "Pre-Rinse Faucet",
        },
    },
    "Fittings": {
        "connection_type": {
            "npt": "NPT", "mnpt": "MNPT", "male npt": "MNPT", "fnpt": "FNPT", "fem npt": "FNPT", "female npt": "FNPT",
            "threaded": "Threaded", "compression": "Compression", "sweat": "Soldered", "press fit": "Press",
        },
        "pressure_rating": {
            "150psi": "150 PSI", "300psi": "300 PSI", "600psi": "600 PSI", "150#": "150 LB", "150 lb": "150 LB",
            "300#": "300 LB", "300 lb": "300 LB",
        },
        "material": {
            "ss": "Stainless Steel", "sst": "Stainless Steel", "brs": "Brass", "cu": "Copper", "ci": "Cast Iron",
            "di": "Ductile Iron", "mi": "Malleable Iron",
        },
        "item_type": {
            "90 elbow": "Elbow", "45 elbow": "Elbow", "elbow": "Elbow", "tee": "Tee", "coupling": "Coupling",
            "adapter": "Adapter", "union": "Union",
        },
    },
    "Abrasives/Cutting Tools": {
        "material": {
            "alum oxide": "Aluminum Oxide", "alox": "Aluminum Oxide", "aluminum oxide": "Aluminum Oxide",
            "zirconia": "Zirconia Alumina", "zirconia alumina": "Zirconia Alumina", "carbide tipped": "Carbide",
            "tct": "Carbide", "hss": "High Speed Steel", "bimetal": "Bi-Metal", "bi metal": "Bi-Metal",
        },
        "grit": {
            "p-80": "P80", "80 grit": "P80", "p80": "P80", "p-120": "P120", "120 grit": "P120", "p120": "P120",
            "p-150": "P150", "150 grit": "P150", "p150": "P150", "p-180": "P180", "p-220": "P220", "p-320": "P320",
        },
        "arbor_size": {'7/8"': "7/8 in", '5/8"': "5/8 in", "20mm": "20 mm", '1"': "1 in"},
        "item_type": {
            "cutoff disc": "Cut-Off Disc", "cut off disc": "Cut-Off Disc", "cut-off disc": "Cut-Off Disc",
            "cutoff wheel": "Cut-Off Wheel", "sanding disc": "Abrasive Disc", "sanding belt": "Sanding Belt",
            "sawblade": "Saw Blade", "saw blade": "Saw Blade",
        },
    },
    "Appliances": {
        "material": {
            "ss": "Stainless Steel", "sst": "Stainless Steel", "stainless": "Stainless Steel",
            "stainless-steel": "Stainless Steel", "ss steel": "Stainless Steel",
        },
        "mounting": {
            "builtin": "Built-In", "built in": "Built-In", "built-in": "Built-In", "undercounter": "Built-In",
            "under-counter": "Built-In", "freestanding": "Freestanding", "free standing": "Freestanding",
            "leg mount": "Leg",
        },
        "voltage": {
            "120v": "120 V", "120 v": "120 V", "120 volt": "120 V", "120 volts": "120 V", "240v": "240 V",
            "240 v": "240 V",
        },
        "item_type": {"dw": "Dishwasher", "dish washer": "Dishwasher", "dish-washer": "Dishwasher"},
    },
    "Dishwasher": {
        "material": {"ss": "Stainless Steel", "sst": "Stainless Steel", "stainless": "Stainless Steel"},
        "mounting": {
            "builtin": "Built-In", "built in": "Built-In", "undercounter": "Built-In", "freestanding": "Freestanding",
            "leg mount": "Leg",
        },
        "voltage": {"120v": "120 V", "240v": "240 V"},
        "item_type": {"dw": "Dishwasher", "dish washer": "Dishwasher"},
    },
    "Saw Blade": {
        "material": {"carbide tipped": "Carbide", "tct": "Carbide", "hss": "High Speed Steel", "bimetal": "Bi-Metal"},
        "item_type": {"sawblade": "Saw Blade", "circular blade": "Circular Saw Blade"},
    },
    "Cut-Off Disc": {
        "item_type": {"cutoff disc": "Cut-Off Disc", "cut off disc": "Cut-Off Disc", "cut-off wheel": "Cut-Off Wheel"},
        "material": {"alum oxide": "Aluminum Oxide", "alox": "Aluminum Oxide", "zirconia": "Zirconia Alumina"},
    },
    "General Commercial": {
        "material": {"ss": "Stainless Steel", "sst": "Stainless Steel", "alum": "Aluminum"},
        "mounting": {"builtin": "Built-In", "built in": "Built-In", "freestanding": "Freestanding"},
        "voltage": {"120v": "120 V", "240v": "240 V"},
    },
}

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: taxonomy and attribute slots
# ---------------------------------------------------------------------------------------------

# item-type keyword | Dept | Class | Fine | Classpath
TAXONOMY = [
    ("dishwasher", "Appliances", "Large Appliances", "Dishwashers",
     "Appliances & Consumer Electronics>Kitchen Appliances>Built-In Dishwashers"),
    ("faucet", "Plumbing", "Faucets & Stems", "Kitchen Faucets", "Plumbing>Faucets>Kitchen Faucets"),
    ("saw", "Tools & Hardware", "Power Tool Accessories", "Saw Blades",
     "Tools & Hardware>Power Tool Accessories>Saw Blades"),
    ("disc", "Tools & Hardware", "Abrasives", "Cutting Discs",
     "Tools & Hardware>Abrasives>Cutting & Grinding Discs"),
    ("elbow", "Plumbing", "Pipe Fittings", "Elbows", "Plumbing>Pipe & Fittings>Elbows"),
]

# slot label, and the spec names that fill it: the first present one wins
_SLOT_NAMES = {
    "dishwasher": [
        ("Series", ["series"]),
        ("Model", ["model", "model_number"]),
        ("Number of Wash Cycles", ["number of wash cycles", "wash cycles", "cycles", "number of cycles"]),
        ("Voltage Rating", ["voltage rating", "voltage", "volts"]),
        ("Amperage Rating", ["amperage rating", "amperage", "amps"]),
        ("Mounting Type", ["mounting type", "mounting"]),
        ("Plug Type", ["plug type"]),
        ("Size", ["size", "overall dimensions", "dimensions"]),
        ("Depth With Door Open", ["depth with door open", "depth open"]),
        ("Minimum Height", ["minimum height", "min height"]),
        ("Maximum Height", ["maximum height", "max height"]),
        ("Sound Level", ["sound level", "sound", "dba"]),
        ("Material", ["material", "tub material"]),
        ("Color", ["color", "finish"]),
        ("Additional Information", ["additional information", "features", "notes"]),
    ],
    "faucet": [
        ("Series", ["series"]),
        ("Model", ["model", "model_number"]),
        ("Flow Rate", ["flow rate", "flowrate", "gpm"]),
        ("Mounting Type", ["mounting type", "mounting"]),
        ("Connection Type", ["connection type", "connection"]),
        ("Connection Size", ["connection size"]),
        ("Spout Reach", ["spout reach"]),
        ("Finish", ["finish", "color"]),
        ("Material", ["material"]),
        ("Additional Information", ["additional information", "notes"]),
    ],
    "fitting": [
        ("Series", ["series"]),
        ("Model", ["model", "model_number"]),
        ("Connection Type", ["connection type", "connection"]),
        ("Connection Size", ["connection size", "size"]),
        ("Pressure Rating", ["pressure rating", "pressure"]),
        ("Material", ["material"]),
        ("Additional Information", ["additional information", "notes"]),
    ],
    "abrasive": [
        ("Item Type", ["item type", "type"]),
        ("Dimensions", ["dimensions", "size"]),
        ("Grit", ["grit", "grit rating"]),
        ("Arbor Size", ["arbor size", "arbor"]),
        ("Abrasive Material", ["abrasive material", "material"]),
        ("Pack Quantity", ["pack quantity", "pack qty", "quantity"]),
        ("Additional Information", ["additional information", "notes"]),
    ],
    "default": [
        ("Series", ["series"]),
        ("Model", ["model", "model_number"]),
        ("Item Type", ["item type", "type"]),
        ("Voltage Rating", ["voltage rating", "voltage"]),
        ("Amperage Rating", ["amperage rating", "amperage"]),
        ("Dimensions", ["dimensions", "size"]),
        ("Mounting Type", ["mounting type", "mounting"]),
        ("Material", ["material"]),
        ("Color", ["color", "finish"]),
        ("Sound Level", ["sound level"]),
        ("Additional Information", ["additional information", "notes"]),
    ],
}

# item-type keywords that choose a slot list, in order
SLOT_KEYWORDS = [
    ("dishwasher", ["dishwasher", "appliance"]),
    ("faucet", ["faucet"]),
    ("fitting", ["fitting", "elbow", "tee", "coupling", "adapter", "union", "flange"]),
    ("abrasive", ["disc", "belt", "wheel", "blade", "cut-off", "abrasive", "grinding"]),
]

# specs with a delivery column of their own never go to the overflow slots
SLOT_EXCLUDED_SPECS = [
    "classpath", "dept", "class", "fine", "product image", "alternate image 1", "alternate image 2",
    "alternate image 3", "alternate image 4", "specification sheet", "with", "standard/approvals",
    "warranty", "marketing_description", "marketing description", "product name", "item type",
    "item_type", "spec_sections", "spec sections", "ref url 1", "ref url 2", "ref url 3",
    "ref url 4", "ref url 5",
]

SLOT_UOMS = ["V", "A", "dBA", "in", "GPM", "PSI", "kW-hr"]

FACT_SLOT_LABELS = {
    "DISHWASHER": [
        "Series", "Model", "Number of Wash Cycles", "Voltage Rating", "Amperage Rating", "Mounting Type", "Plug Type",
        "Size", "Depth With Door Open", "Minimum Height", "Maximum Height", "Sound Level", "Material", "Color",
        "Additional Information",
    ],
    "POWER_TOOL": [
        "Series", "Model", "Voltage Rating", "Battery Capacity", "Motor Type", "Chuck Size", "No Load RPM",
        "Max Torque", "Amperage Rating", "Power Source", "Tool Length", "Tool Weight", "Width", "Height",
        "Additional Information",
    ],
    "GENERAL": [
        "Series", "Model", "Type", "Material", "Color", "Voltage Rating", "Amperage Rating", "Power Rating",
        "Capacity", "Size", "Length", "Width", "Height", "Weight", "Additional Information",
    ],
}

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: invoice abbreviations, in the order they are tried
# ---------------------------------------------------------------------------------------------

INVOICE_LIMIT = 40
INVOICE_ALWAYS = [
    ("STAINLESS STEEL", "SST"), ("BUILT-IN", "BLTLN"), ("BUILT IN", "BLTLN"),
    ("UNDER-COUNTER", "UNDRCTR"), ("UNDER COUNTER", "UNDRCTR"), ("FREESTANDING", "FRSTD"),
    ("FREE STANDING", "FRSTD"), ("CARBON STEEL", "CS"), ("ALUMINUM", "ALUM"),
    ("HIGH SPEED STEEL", "HSS"), ("PACKAGE", "PK"),
]
INVOICE_WHILE_LONG = [
    ("DISHWASHER", "DISHWSHR"), ("RECIPROCATING", "RECIP"), ("SANDING BELT", "SND BELT"),
    ("CUT-OFF DISC", "CUT OFF DISC"), ("CUT OFF DISC", "CUT OFF DISC"), ("ABRASIVE DISC", "ABR DISC"),
    ("MEASURING TAPE", "TAPE"), ("SAFETY GLASSES", "SAFETY GLS"), ("CIRCULAR SAW", "CIRC SAW"),
    ("PACKAGE", "PK"), ("PACK", "PK"), ("PIECES", "PC"), ("PIECE", "PC"), ("DIAMETER", "DIA"),
    ("MOUNTING", "MNT"), ("DIMENSION", "DIM"), ("DIMENSIONS", "DIM"), ("COMMERCIAL", "COMM"),
    ("INDUSTRIAL", "IND"), ("STANDARD", "STD"), ("PREMIUM", "PREM"), ("INCHES", "IN"), ("INCH", "IN"),
    ("VOLTS", "V"), ("VOLT", "V"), ("AMPERAGE", "A"), ("AMPS", "A"), ("AMP", "A"), ("HERTZ", "HZ"),
    ("DECIBELS", "DBA"), ("DECIBEL", "DBA"),
    (" WITH", ""), (" FOR", ""), (" AND", ""), (" THE", ""), (" PREMIUM", ""), (" STANDARD", ""),
    (" COMMERCIAL", ""),
]


# ---------------------------------------------------------------------------------------------
# Typed access
# ---------------------------------------------------------------------------------------------


def spec_key(name: str) -> str:
    """Spec names compare without case, and with runs of blank, dash and underscore as one blank."""
    return re.sub(r"[_\-\s]+", " ", name).strip().lower()


SLOTS = {kind: [(label, [spec_key(n) for n in names]) for label, names in slots] for kind, slots in _SLOT_NAMES.items()}

_MIN_EMBEDDED_ALIAS = 4


@dataclass(frozen=True)
class Vocabulary:
    """The master tables one job runs with.  ``extend`` merges overrides; a later row wins."""

    brands: tuple[Brand, ...] = BRANDS
    units: dict[str, str] = field(default_factory=lambda: dict(UNITS))
    fractions: dict[float, str] = field(default_factory=lambda: dict(FRACTIONS))
    lovs: dict[str, list[str]] = field(default_factory=lambda: dict(GLOBAL_LOVS))
    category_required: dict[str, list[str]] = field(default_factory=lambda: dict(CATEGORY_REQUIRED))
    category_lovs: dict[str, dict[str, list[str]]] = field(default_factory=lambda: dict(CATEGORY_LOVS))
    category_synonyms: dict[str, dict[str, dict[str, str]]] = field(default_factory=lambda: dict(CATEGORY_SYNONYMS))
    distributors: tuple[str, ...] = tuple(DISTRIBUTOR_TOKENS)

    def extend(self, brands=(), units=None, fractions=None, lovs=None) -> "Vocabulary":
        merged_lovs = {k: list(v) for k, v in self.lovs.items()}
        for name, values in (lovs or {}).items():
            have = merged_lovs.setdefault(name.strip().lower(), [])
            have.extend(v for v in values if v not in have)
        return replace(
            self,
            brands=self.brands + tuple(brands),
            units={**self.units, **{k.strip().lower(): v.strip() for k, v in (units or {}).items()}},
            fractions={**self.fractions, **(fractions or {})},
            lovs=merged_lovs,
        )

    @cached_property
    def aliases(self) -> dict[str, str]:
        """Spelling to canonical brand, in the order spellings are tried."""
        table: dict[str, str] = {}
        for b in self.brands:
            for spelling in (b.name.lower(), *(a.strip().lower() for a in b.aliases)):
                if spelling:
                    table[spelling] = b.name
        return table

    @cached_property
    def embedded_aliases(self) -> list[tuple[str, str]]:
        return [(a, c) for a, c in self.aliases.items() if len(a) >= _MIN_EMBEDDED_ALIAS]

    @cached_property
    def prefixes(self) -> dict[str, str]:
        """Part-number prefix to brand; where brands share a prefix the last registered keeps it."""
        table: dict[str, str] = {}
        for b in self.brands:
            for p in b.prefixes:
                table[p.strip().lower()] = b.name
        return table

    @cached_property
    def canonical(self) -> list[str]:
        return list(dict.fromkeys(b.name for b in self.brands))

    @cached_property
    def manufacturers(self) -> dict[str, str]:
        return {b.name.lower(): b.manufacturer for b in self.brands}

    @cached_property
    def domains(self) -> dict[str, str]:
        return {b.name: b.domain for b in self.brands if b.domain}


DEFAULT = Vocabulary()

assert len(DELIVERY_HEADERS) == 252, len(DELIVERY_HEADERS)
assert len(COMPARISON_FIELDS) == 199, len(COMPARISON_FIELDS)
