import pytest
from pyspark.sql import functions as F

from partloom.functions import extract as X
from partloom.functions import invoice, scoring, text, units, web
from partloom.operators import entity

c = F.col


def apply(spark, expression, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["r"] for r in rows.select("i", expression.alias("r")).orderBy("i").collect()]


def test_placeholders(spark):
    got = apply(
        spark, text.clean_placeholders(c("c")),
        ["PDSH4816AF Dishwasher SS 120v (2435) -- Unbranded -- [placeholder] N/A", "-- No Unilog Brand --", "N/A", "TBD", None, "Tee (red) x", " a b "],
    )
    assert got == ["PDSH4816AF Dishwasher SS 120v", None, None, None, None, "Tee x", "a b"]


def test_unit_spacing(spark):
    pairs = {
        "24in": "24 in", "120v": "120 V", "15a": "15 A", "60hz": "60 Hz", "47db": "47 dBA", "10pk": "10 PK",
        "50lbs": "50 lb", "24 inches wide": "24 in wide", "5in x 7/8in": "5 in x 7/8 in",
    }
    assert apply(spark, units.space_units(c("c")), list(pairs)) == list(pairs.values())


def test_fractions(spark):
    pairs = {
        "50.25 in": "50-1/4 in", "24.125 in": "24-1/8 in", "0.5 in": "1/2 in", "7.75 in": "7-3/4 in",
        "24.25 x 35.5 in": "24-1/4 x 35-1/2 in", "5.25gpm": "5.25gpm", "1.5 GPM": "1-1/2 GPM", "3.254 in": "3-1/4 in",
        ".33 in": ".33 in",
    }
    assert apply(spark, units.decimals_to_fractions(c("c")), list(pairs)) == list(pairs.values())


def test_invoice(spark):
    (got,) = apply(spark, invoice.compress_invoice(c("c")), ["FRIGIDAIRE STAINLESS STEEL BUILT-IN DISHWASHER 120 V 50.25 IN"])
    assert len(got) <= 40 and got == got.upper()
    assert all(w in got for w in ("SST", "BLTLN", "DISHWSHR"))


def test_numeric_sanity(spark):
    rows = spark.createDataFrame(
        [("voltage", "120 V", True), ("voltage", "50000 V", False), ("amperage", "-10 A", False), ("dimensions", "5000 in", False), ("grit", "none", True)],
        "f string, v string, want boolean",
    )
    assert rows.where(units.numeric_sanity(c("f"), c("v")) != c("want")).count() == 0


def test_item_types_follow_rule_order(spark):
    got = apply(spark, X.item_type(c("c")), ["Pre-Rinse Kitchen Faucet", "90 Elbow Tee", "orbit", "Ranger", "Lovely oven", "Blades", None])
    assert got == ["Pre-Rinse Faucet", "Elbow", "Drill Bit", "Range", "Range", None, None]


def test_aluminum_oxide_is_only_reached_by_its_short_form(spark):
    assert apply(spark, X.material(c("c")), ["Aluminum Oxide disc", "ALOX disc"]) == ["Aluminum", "Aluminum Oxide"]


def test_hints_never_hide_a_match(spark):
    """Every rule still fires on a text made of its own words."""
    samples = [
        (X.ITEM_TYPE_RULES, ["pre rinse", "KITCHEN  FAUCET", "lav faucet", "cut-off wheel", "Hiolit", "SAW BLADE", "Washer", "dryer", "bit"]),
        (X.MATERIAL_RULES, ["sst", "CHROME PLATED BRASS", "cast iron", "Ductile Iron", "alum", "carbide tipped", "metal", "Zirconia"]),
        (X.FINISH_RULES, ["CP", "bn", "MB", "brushed nickel"]),
        (X.CATEGORY_RULES, ["dish washer", "prerinse", "spout", "fridge", "mnpt", "cubitron"]),
    ]
    for rules, texts in samples:
        assert all(r is not None for r in apply(spark, X.first_rule(c("c"), rules), texts))


def test_brands(spark):
    rows = spark.createDataFrame([(v,) for v in (
        "frigid air", "Frigidaire Appliances", "Freud Inc", "Milwaukee Tool (4031)", "Mirka Abrasives Inc (MIRUS)", "Acme Custom Industrial Pumps LLC")], "t string")
    got = {r["t"]: r["hit"] for r in entity.add_brand_match(rows, "t", "hit", 0.8).collect()}
    assert [got[k]["brand"] for k in list(got)[:5]] and got["frigid air"]["brand"] == "FRIGIDAIRE®"
    assert got["Frigidaire Appliances"]["brand"] == "FRIGIDAIRE®" and got["Freud Inc"]["brand"] == "FREUD®"
    assert got["Milwaukee Tool (4031)"]["brand"] == "MILWAUKEE®" and got["Mirka Abrasives Inc (MIRUS)"]["brand"] == "MIRKA®"
    assert got["Acme Custom Industrial Pumps LLC"]["score"] == 0.0


def test_prefix_is_last_writer_and_longest(spark):
    assert apply(spark, entity.brand_by_prefix(c("c")), ["DCB12", "11x", "pk9", "55-1", "wdts1", "3MABR-1", ""]) == [
        "DIABLO®", "KLEIN TOOLS®", "SQUARE D®", "KICHLER®", "WHIRLPOOL®", "3M™", None]


def test_alias_join_equals_inlined_lookup(spark):
    texts = ["new klein tools set by bosch", "black & decker/dewlt saw", "u.s. tape 25ft", "cutler-hammer br", "nothing", "robert bosch diablo"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    joined = entity.embedded_alias_join(rows, "i", "t", entity.alias_table(spark))
    both = joined.withColumn("inline", entity.brand_by_embedded_alias(c("t")))
    assert both.where(~c("inline").eqNullSafe(c("embedded_brand"))).count() == 0
    assert both.where("inline is not null").count() == 5


def test_url_screen(spark):
    urls = ["https://www.frigidaire.com/x", "http://www.frigidaire.com/x", "https://a.se.com:443/q", "https://10.0.0.1/", "https://evilse.com/", None]
    assert apply(spark, web.url_allowed(c("c")), urls) == [True, False, True, False, False, False]


@pytest.mark.parametrize("source,status,score", [("manufacturer_official_html", 200, 1.0), ("official", None, 0.95), ("LIVE_NIM", None, 0.85), ("distributor_feed", 200, 0.7), ("OFFLINE_HEURISTIC", None, 0.4), (None, None, 0.7)])
def test_provenance(spark, source, status, score):
    row = spark.createDataFrame([(source, status)], "s string, h int").select(scoring.provenance(c("s"), c("h")).alias("p")).first()
    assert row["p"] == score


def test_rewards(spark):
    rows = spark.createDataFrame([
        ("DISHWASHER SST 120 V 50-1/4 IN", "Built-In Stainless Steel 120 V 50-1/4 in"),
        ("Frigidaire Dishwasher with very long text beyond forty 120v 50.25in -- Unbranded --", "120v 50.25in"),
    ], "i string, a string")
    out = rows.select(scoring.rewards(c("i"), c("a"), F.concat_ws(" ", "i", "a")).alias("r")).collect()
    assert set(out[0]["r"]) == {1.0} and set(out[1]["r"]) == {0.0}
