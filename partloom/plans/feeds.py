"""Catalog-shaped views over the generic star-schema tables.

The scalar rules are plain SQL text with only ``CASE``, ``%``, ``||`` and ``CAST`` in it, so any SQL
engine can be handed the same text.  ``k`` is the part key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom import vocab as V
from partloom.operators.fuzzy import Masters
from partloom.operators.master import dimension


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FEED_SQL = {
    "Mfg_Part_Num": """CASE WHEN k % 97 = 0 THEN ''
        WHEN k % 53 = 0 THEN 'DUP-' || CAST(k - k % 530 AS STRING)
        WHEN k % 8 = 0 THEN 'PDSH' || CAST(k AS STRING)
        WHEN k % 8 = 1 THEN 'WDTS' || CAST(k AS STRING)
        WHEN k % 8 = 2 THEN '49-94-' || CAST(k AS STRING)
        WHEN k % 8 = 3 THEN 'DCB' || CAST(k AS STRING)
        WHEN k % 8 = 4 THEN '5B-332-' || CAST(k AS STRING)
        WHEN k % 8 = 5 THEN 'HOM' || CAST(k AS STRING)
        WHEN k % 8 = 6 THEN 'ELB-' || CAST(k AS STRING)
        ELSE 'K-' || CAST(k AS STRING) || '-VS' END""",
    "Part_Desc": """CASE WHEN k % 89 = 0 THEN '' ELSE
        CASE k % 8 WHEN 0 THEN 'Dishwasher SS 120v 50.25in -- Unbranded --'
        WHEN 1 THEN 'Built-In Dishwasher 120V 10A 41dBA (2435)'
        WHEN 2 THEN '5in x 0.045in x 7/8in Metal Cut Off Disc 10pk'
        WHEN 3 THEN 'Diablo 1/2in x 18in Sanding Belt 6pc TBD'
        WHEN 4 THEN '5in P80 Abrasive Disc -- No DIB Brand --'
        WHEN 5 THEN 'Circuit Breaker 50A 240v'
        WHEN 6 THEN '1/2 in 90 Degree Elbow 150 PSI NPT Brass'
        ELSE 'Single Hole Kitchen Faucet 1.5 GPM Chrome' END
        || ' ' || p_name || ' ' || CAST(p_size AS STRING) || '.25in' END""",
    "E1_Brand": "CASE WHEN k % 5 = 0 THEN p_brand ELSE '-- Unbranded --' END",
    "Unilog_Brand": "'-- No Unilog Brand --'",
    "DIB_Brand": "CASE WHEN k % 4 = 0 THEN 'frigid air' ELSE '-- No DIB Brand --' END",
    "Part_Manuf": """CASE k % 6 WHEN 0 THEN 'FRIGIDAIRE' WHEN 1 THEN 'Whirlpool Corporation'
        WHEN 2 THEN 'Milwaukee Accessory (4031)' WHEN 3 THEN 'Freud Inc (2435)'
        WHEN 4 THEN 'Appliance Dealers Cooperative (APPDE)' ELSE s_name END""",
    "source_type": """CASE k % 5 WHEN 0 THEN 'LIVE_NIM' WHEN 1 THEN 'OFFLINE_HEURISTIC'
        WHEN 2 THEN 'MANUFACTURER_SOURCE' WHEN 3 THEN 'manufacturer_official_html'
        ELSE 'distributor_feed' END""",
}

EVIDENCE_BRAND_SQL = """CASE k % 8 WHEN 0 THEN 'FRIGIDAIRE®' WHEN 1 THEN 'Whirlpool' WHEN 2 THEN 'Other'
    WHEN 3 THEN 'DIABLO®' ELSE '' END"""
EVIDENCE_TEXT_SQL = """CASE WHEN k % 6 = 0 THEN 'Voltage Rating: 120 V
Amperage: 15 A
Material: Stainless Steel
Width: 24 in
Built-in mounting' ELSE 'Rated voltage 120 V. Current draw is 12 amps. Wall mount carbide unit. Depth 3 in' END"""
# spec sections in page order; a null value means the page does not list it
SECTION_SQL = {
    "Series": "CASE WHEN k % 2 = 0 THEN 'Professional Series' END",
    "Number of Wash Cycles": "CASE WHEN k % 8 < 2 THEN '5.0' END",
    "Voltage Rating": "CASE WHEN k % 9 = 0 THEN '240' WHEN k % 4 < 2 THEN '120 V' END",
    "Amperage Rating": "CASE WHEN k % 4 = 0 THEN '15A' END",
    "Mounting Type": "CASE WHEN k % 12 = 0 THEN 'Built-in Mounting' WHEN k % 8 = 1 THEN 'Leg' END",
    "Size": "CASE WHEN k % 5 = 0 THEN '24.5in' END",
    "Width": "CASE WHEN k % 5 = 1 THEN '24 in' END",
    "Depth": "CASE WHEN k % 5 = 1 THEN '25 in' END",
    "Depth With Door Open": "CASE WHEN k % 8 = 0 THEN '50-1/4 in' END",
    "Minimum Height": "CASE WHEN k % 8 = 0 THEN '33 in' END",
    "Sound Level": "CASE WHEN k % 8 = 1 THEN '47dB' END",
    "Material": "CASE WHEN k % 7 = 0 THEN 'Stainless' WHEN k % 7 = 1 THEN 'Porcelain' END",
    "Color": "CASE WHEN k % 2 = 1 THEN 'White' END",
    "Warranty": "CASE WHEN k % 3 = 0 THEN '1 Year' END",
    "Plug Style": "CASE WHEN k % 10 = 0 THEN '' ELSE 'NEMA 5-15' END",
}
MODEL_SQL = """CASE WHEN k % 14 = 0 THEN 'no structured reply'
    WHEN k % 22 = 0 THEN '{"item_type": "Dishwasher", "voltage": '
    ELSE CASE WHEN k % 10 = 0 THEN '```json
' ELSE '' END
    || '{"item_type": "' || CASE WHEN k % 4 = 0 THEN 'dw' ELSE 'Switch' END
    || '", "voltage": "' || CASE WHEN k % 12 = 0 THEN '120/240 V' ELSE '240v' END
    || '", "mounting": "builtin", "material": "sst", "series": "Series ' || CAST(k % 3 AS STRING)
    || '", "raw_specs": {"Color": "Black", "With": "Energy Star", "Amperage": "9 A"}}'
    || CASE WHEN k % 10 = 0 THEN '
```' ELSE '' END END"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dirty feed row per part, with its position in the file."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "k")
    suppliers = table(spark, sf_dir, "supplier")
    n = suppliers.count()
    names = suppliers.select((F.col("s_suppkey") % n).alias("_supplier"), "s_name")
    joined = part.join(names, F.col("k") % n == F.col("_supplier"), "left")
    return joined.select(
        F.col("k").alias("_ordinal"), *[F.expr(sql).alias(name) for name, sql in FEED_SQL.items()]
    )


def with_short_columns(df: DataFrame) -> DataFrame:
    """The same feed under the header spellings of a short upload."""
    return df.select(
        "_ordinal",
        F.col("Mfg_Part_Num").alias("PART_NUMBER"),
        F.col("Part_Desc").alias("Description"),
        F.col("Part_Manuf").alias("Manufacturer"),
    )


#: Brands that a catalog adds: one for each part.
PART_BRAND_SQL = "p_name || ' ' || substr(md5(CAST(p_partkey AS STRING)), 1, 5)"


def master_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, brand): the brands that come with the package, then one for each part, then the suppliers."""
    own = spark.createDataFrame(list(enumerate(V.DEFAULT.canonical)), "ord bigint, brand string")
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000).alias("ord"), F.expr(PART_BRAND_SQL).alias("brand"))
    suppliers = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("ord"), F.col("s_name").alias("brand"))
    return own.unionByName(parts).unionByName(suppliers)


def masters(spark: SparkSession, sf_dir: str) -> Masters:
    """Master tables that grow with the parts and suppliers."""
    suppliers, rows = table(spark, sf_dir, "supplier"), lambda pairs: dimension(spark, pairs)
    aliases = [(i, a, b) for i, (a, b) in enumerate(V.DEFAULT.aliases.items())]
    more = suppliers.select((F.col("s_suppkey") + 1_000_000).alias("ord"), F.lower("s_name").alias("alias"), F.upper("s_name").alias("brand"))
    prefixes = suppliers.select(F.concat(F.lit("hom"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_name").alias("value"))
    makers = suppliers.select(F.lower("s_name").alias("key"), F.concat(F.col("s_name"), F.lit(" Inc")).alias("value"))
    return Masters(
        master_brands(spark, sf_dir), spark.createDataFrame(aliases, "ord bigint, alias string, brand string").unionByName(more),
        rows(V.DEFAULT.prefixes.items()).unionByName(prefixes), rows(V.DEFAULT.manufacturers.items()).unionByName(makers),
    )


def without_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the parts that were once returned as a single piece: they have no reference record."""
    return table(spark, sf_dir, "lineitem").where("l_quantity = 1 AND l_returnflag = 'R'").select("l_partkey").distinct()


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched official pages of the parts that were ever ordered in quantity; the others have none."""
    ordered = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select("l_partkey").distinct()
    rows = feed(spark, sf_dir).where("Mfg_Part_Num <> ''").join(ordered, F.col("_ordinal") == F.col("l_partkey"), "left_semi")
    # dealt out while they are narrow: the parts are one small file, and reading a page takes a thousand times what reading its row takes
    rows = rows.repartition(spark.sparkContext.defaultParallelism, "_ordinal")
    k = rows.withColumnRenamed("_ordinal", "k").withColumnRenamed("Mfg_Part_Num", "mpn")
    sections = F.filter(
        F.array(
            *[
                F.struct(F.lit(name).alias("key"), F.expr(sql).alias("value"))
                for name, sql in SECTION_SQL.items()
            ]
        ),
        lambda s: s["value"].isNotNull(),
    )
    return k.select(
        F.col("k").alias("_evidence_ordinal"),
        F.expr(EVIDENCE_BRAND_SQL).alias("brand"),
        "mpn",
        F.concat(F.lit("https://www.frigidaire.com/p/"), F.lower("mpn")).alias("source_url"),
        F.lit("manufacturer_official_html").alias("source_type"),
        F.expr("CASE WHEN k % 4 = 3 THEN 404 ELSE 200 END").alias("http_status"),
        F.expr(EVIDENCE_TEXT_SQL).alias("text"),
        F.map_from_entries(sections).alias("spec_sections"),
    )


def model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of an external model for every part with a number: plain, fenced, broken."""
    rows = feed(spark, sf_dir).where("Mfg_Part_Num <> ''")
    return rows.withColumnRenamed("_ordinal", "k").select(
        "k", F.col("Mfg_Part_Num").alias("mpn"), F.expr(MODEL_SQL).alias("content")
    )


TRACKING_SQL = {
    "row_index": "event_id",
    "mfg_part_num": "'EV-' || CAST(event_id AS STRING)",
    "batch_id": "event_id % 7",
    "stage": "event_type",
    "client": "user_id",
    "ts": "ts",
    "status": "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'SUCCESS' END",
    "source_mode": """CASE WHEN event_type = 'error' THEN 'ERROR'
        WHEN event_id % 5 = 0 THEN 'LIVE_NIM' WHEN event_id % 5 = 1 THEN 'OFFLINE_HEURISTIC'
        WHEN event_id % 5 = 2 THEN 'MANUFACTURER_SOURCE' WHEN event_id % 5 = 3 THEN 'CACHE'
        ELSE 'FALLBACK' END""",
    "cache_hit": "event_id % 5 = 3",
    "sourcing_attempted": "event_id % 6 <> 0",
    "sourcing_success": "event_id % 6 > 2",
    "source_domain": """CASE WHEN event_id % 6 > 2 THEN CASE event_id % 4 WHEN 0 THEN 'www.frigidaire.com'
        WHEN 1 THEN 'www.whirlpool.com' ELSE 'www.3m.com' END END""",
    "source_type": """CASE event_id % 4 WHEN 0 THEN 'manufacturer_official_html' WHEN 1 THEN 'pdf'
        WHEN 2 THEN 'distributor_feed' ELSE '' END""",
    "sourcing_failure_reason": """CASE WHEN event_id % 6 BETWEEN 1 AND 2 THEN CASE event_id % 9
        WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'NOT_FOUND' WHEN 2 THEN 'DOMAIN_NOT_ALLOWED'
        WHEN 3 THEN 'TEAPOT' ELSE 'HTTP_ERROR' END END""",
    "llm_attempted": "event_type <> 'error'",
    "llm_failed": "event_type = 'error' OR event_id % 5 = 1",
    "llm_error": "CASE WHEN event_id % 2 = 0 THEN 'HTTP 429' END",
    "llm_timeout": "event_id % 50 = 0",
    "retry_count": "event_id % 3",
    "processing_time_ms": "value",
    "confidence": "CAST((event_id % 100) AS DOUBLE) / CAST(100 AS DOUBLE)",
    "review_required": "event_id % 100 < 80 OR event_id % 11 = 0",
    "schema_valid": "event_id % 13 <> 0",
}


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One processing record per event."""
    return table(spark, sf_dir, "events").select(
        *[F.expr(sql).alias(name) for name, sql in TRACKING_SQL.items()]
    )


REVIEW_ACTION_SQL = {
    "action_id": "event_id",
    "review_id": "user_id",
    "action_type": "CASE event_id % 3 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'REJECT' ELSE 'EDIT' END",
    "new_value": "CASE WHEN event_id % 3 = 2 THEN 'VALUE ' || CAST(event_id AS STRING) END",
    "reviewer": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'reviewer' || CAST(event_id % 4 AS STRING) END",
    "ts": "ts",
}


def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        *[F.expr(sql).alias(name) for name, sql in REVIEW_ACTION_SQL.items()]
    )


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One queue entry per customer."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("review_id"),
        F.col("c_custkey").alias("product_id"),
        F.concat(F.lit("INVOICE "), F.col("c_name")).alias("suggested_value"),
        (F.col("c_custkey") % 90 / F.lit(100.0)).alias("confidence"),
        F.expr("TIMESTAMP '2023-12-01 00:00:00' + make_interval(0,0,0,0,0,CAST(c_custkey % 5000 AS INT),0)")
        .alias("created_at"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded files, one per page: a name, header names and raw content."""
    pages = table(spark, sf_dir, "pages")
    headers = F.expr(
        "CASE page_id % 5 "
        + " ".join(f"WHEN {i} THEN array({', '.join(repr(h) for h in hs)})" for i, hs in MANIFEST_HEADERS.items())
        + " END"
    )
    return pages.select(
        "page_id",
        F.expr(MANIFEST_NAME_SQL).alias("file_name"),
        headers.alias("headers"),
        F.encode(F.expr(MANIFEST_CONTENT_SQL), "UTF-8").alias("content"),
    )


_H = V.FEED_COLUMNS
MANIFEST_HEADERS = {
    0: _H,
    1: _H[:5],
    2: _H + ["Extra"],
    3: [_H[1], _H[0], *_H[2:]],
    4: [*_H[:5], "Maker"],
}
MANIFEST_NAME_SQL = """CASE page_id % 7 WHEN 0 THEN 'feed.csv' WHEN 1 THEN 'FEED.CSV' WHEN 2 THEN 'feed.xlsx'
    WHEN 3 THEN 'feed.exe' WHEN 4 THEN '' ELSE 'part.csv' END"""
MANIFEST_CONTENT_SQL = """CASE page_id % 6 WHEN 0 THEN 'MZ' || html WHEN 1 THEN html WHEN 2 THEN 'a,b' || url
    WHEN 3 THEN 'x,=CMD|y'
    WHEN 4 THEN 'Mfg_Part_Num,' || url || repeat(' ', 9000) || '<SCRIPT' ELSE 'Mfg_Part_Num,' || url END"""
