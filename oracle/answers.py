"""The expected answer of every query as one DuckDB statement."""

from __future__ import annotations

import re

from partloom import vocab as V
from partloom import queries as QS
from partloom.functions import extract as X
from partloom.functions import scoring as S
from partloom.functions import web as W
from partloom.plans import feeds

from oracle.base import (
    DECIMAL, GLUED, RAW_SPEC_SQL, capture, clean, clean_cell, compress, cte, dimensions, distributor, filled, fractions, grab,
    has, measured_dimensions, present, provenance, q, query, reply_json, rules, sanitize, share, space_units, strip, table,
    valid_lov, with_unit, words, ws, D, WS, CONFLICTS, squish, lines_of, snippets_of, _markers as snippet_markers,
)

ANSWERS: dict[str, str] = {}
# the key both compared sides are matched on
ukey = lambda e: "upper(" + strip(f"coalesce({e}, '')") + ")"


def answer(name: str, sql: str) -> None:
    ANSWERS[name] = query(sql)


def on_feed(name: str, **columns: str) -> None:
    answer(name, "SELECT _ordinal, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM feed")


PD = "Part_Desc"

# ------------------------------------------------------------------ delivered records

_b = f"coalesce({filled('e.f_brand')}, {filled('e.brand')}, '')"
_plain = lambda e: "lower(" + strip(f"translate({e}, '®™', '')") + ")"
cte(
    "delivered0",
    f"SELECT e.*, {_b} AS brand_final, d1.domain AS dom1, d2.domain AS dom2 FROM enriched e LEFT JOIN domain_rows d1 ON d1.brand_key = {_plain(_b)} "
    f"LEFT JOIN brand_match bm ON bm.t = {_b} AND bm.score >= 0.80 LEFT JOIN domain_rows d2 ON d2.brand_key = {_plain('bm.brand')}",
)
_tax = lambda i: "CASE " + " ".join(f"WHEN contains(lower(f_item_type), {q(t[0])}) THEN {q(t[i])}" for t in V.TAXONOMY) + " ELSE '' END"
_spec = lambda n: f"coalesce(list_filter(raw_specs, lambda s: s.k = {q(n)})[1].v, '')"
_maker = f"coalesce({filled('manufacturer')}, brand_final)"
_fb_maker = f"CASE WHEN {strip('Part_Manuf')} <> '' THEN {strip('Part_Manuf')} ELSE 'Commercial Manufacturer' END"
_err = lambda bad, good: f"CASE WHEN status = 'ERROR' THEN {bad} ELSE {good} END"
_fb_inv = f"substr({strip('upper(substr(' + _fb_maker + ', 1, 8) || ' + q(' ') + ' || ' + q('Commercial Prod') + ' || ' + q(' ') + ')')}, 1, 40)"
_fb_mob = f"substr({strip('(' + _fb_maker + ') || ' + q(' Commercial Product '))}, 1, 60)"
VALUED = {
    "MFR URL": _err("''", f"coalesce({filled(_spec('MFR URL'))}, {filled('f_mfr_url')}, 'https://' || coalesce(dom1, dom2) || '/product/' || part_key, '')"),
    "PART_NUMBER": "part_key", "MANUFACTURER_PART_NUMBER": "part_key",
    "Dept": _tax(1), "Class": _tax(2), "Fine": _tax(3), "Classpath": _tax(4),
    "Part_Desc": _err("''", f"coalesce({clean(PD)}, {PD})"), "E1_Brand": _err("''", f"CASE WHEN E1_Brand <> '' THEN E1_Brand ELSE '-- Unbranded --' END"),
    "Part_Manuf": _err(strip("Part_Manuf"), f"CASE WHEN Part_Manuf <> '' THEN Part_Manuf ELSE {_maker} END"),
    "MANUFACTURER_NAME": _err(_fb_maker, _maker), "BRAND_NAME": _err(_fb_maker, "brand_final"),
    "MOBILE_DESC": _err(_fb_mob, "mobile_desc"), "INVOICE_DESC": _err(_fb_inv, "invoice_desc"),
    "SHORT_DESC": _err("''", "short_desc"), "LONG_DESC1": _err("''", "long_desc"), "RETAIL_DESC": _err("''", "product_title"),
    "Product Name": _err("'Commercial Product'", f"coalesce({filled(_spec('Product Name'))}, {filled('f_item_type')}, product_title)"),
    "With": _spec("With"), "Standard/Approvals": _spec("Standard/Approvals"), "Warranty": _spec("Warranty"),
    "Country Of Origin": _err("''", "'US'"), "Discontinued": _err("''", "'No'"), "Selling Qty": _err("''", "'1'"), "Selling UOM": _err("''", "'EA'"),
    "Actual Image (Yes/No)": "'No'",
}
snake = QS._snake
cte("delivered", "SELECT *, " + ", ".join(f"{e} AS d_{snake(n)}" for n, e in VALUED.items()) + " FROM delivered0")
_flat = [n for n in V.COMPARISON_FIELDS if n in VALUED]
cte("field_rows", table("field", ["i", "field", "numeric_ok"], [(i, n, not (n in V.NON_NUMERIC_FIELDS or n.startswith("ATTRIBUTE_LABEL") or n.startswith("ITEM_FEATURES"))) for i, n in enumerate(V.COMPARISON_FIELDS)]).replace("True", "true").replace("False", "false"))
cte(
    "valued_cells",
    "SELECT _ordinal, unnest([" + ", ".join(f"{{'field': {q(n)}, 'value': d_{snake(n)}}}" for n in _flat) + "], recursive := true) FROM delivered "
    + "".join(f"UNION ALL SELECT s._ordinal, 'ATTRIBUTE_{p} ' || slot, {'label' if p == 'LABEL' else 'value' if p == 'VALUE' else 'uom'} FROM slots s JOIN enriched e USING (_ordinal) WHERE status <> 'ERROR' " for p in ("LABEL", "VALUE", "UOM")),
)
cte(
    "cells",
    "SELECT e._ordinal, e.part_key, f.i, f.field, f.numeric_ok, coalesce(v.value, '') AS value FROM enriched e CROSS JOIN field_rows f LEFT JOIN valued_cells v ON v._ordinal = e._ordinal AND v.field = f.field",
)
_pert = (
    "CASE WHEN (_ordinal + i) % 36 = 0 THEN '' WHEN (_ordinal + i) % 44 = 0 THEN 'X' WHEN (_ordinal + i) % 12 = 0 THEN lower(value) "
    "WHEN (_ordinal + i) % 20 = 0 THEN replace(value, '®', '') WHEN (_ordinal + i) % 7 = 0 AND regexp_matches(value, '^[0-9]+$') THEN value || '.0' ELSE value END"
)
cte(
    "golden",
    "SELECT _ordinal, CASE WHEN l_partkey IS NULL THEN part_key ELSE 'GOLD-' || _ordinal END AS gkey, i, field, numeric_ok, "
    f"CASE WHEN l_partkey IS NULL THEN {_pert} ELSE value END AS value FROM cells LEFT JOIN no_reference ON l_partkey = _ordinal WHERE part_key <> ''",
)
cte(
    "compared",
    "SELECT g.gkey AS mfg_part_num, g.field AS field_name, g.numeric_ok, "
    f"CASE WHEN lower({strip('g.value')}) IN ('', 'nan', 'none', 'null') THEN '' ELSE {strip('g.value')} END AS expected_value, "
    f"CASE WHEN lower({strip('o.value')}) IN ('', 'nan', 'none', 'null') THEN '' ELSE {strip('o.value')} END AS actual_value "
    "FROM golden g JOIN (SELECT gkey, min(_ordinal) AS m FROM golden GROUP BY 1) f ON f.gkey = g.gkey AND f.m = g._ordinal "
    "JOIN (SELECT part_key, min(_ordinal) AS m FROM enriched GROUP BY 1) a ON a.part_key = g.gkey JOIN cells o ON o._ordinal = a.m AND o.i = g.i",
)
_n = lambda e: f"translate(lower({e}), '®™', '')"
_num = "numeric_ok AND regexp_matches(expected_value, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') AND coalesce(try_cast(expected_value AS DOUBLE) = try_cast(actual_value AS DOUBLE), false)"
cte(
    "comparison",
    "SELECT mfg_part_num, field_name, expected_value, actual_value, "
    f"CASE WHEN expected_value = '' THEN 'EXPECTED_EMPTY' WHEN expected_value = actual_value THEN 'EXACT_MATCH' WHEN {_n('expected_value')} = {_n('actual_value')} OR ({_num}) THEN 'NORMALIZED_MATCH' ELSE 'MISMATCH' END AS comparison_type, "
    f"CASE WHEN expected_value IN ('', actual_value) THEN '' WHEN {_n('expected_value')} = {_n('actual_value')} THEN 'case_insensitive_trademark_stripped' WHEN {_num} THEN 'numeric_representation_equivalence' ELSE '' END AS normalization_rule FROM compared",
)
_cnt = lambda k: f"count_if(comparison_type = '{k}')::BIGINT"
cte(
    "records",
    f"SELECT *, normalized_matches = 0 AND mismatches = 0 AS exact_record_match, mismatches = 0 AS normalized_record_match, "
    f"{share('exact_matches', 'exact_matches + normalized_matches + mismatches')} AS strict_accuracy_pct, "
    f"{share('exact_matches + normalized_matches', 'exact_matches + normalized_matches + mismatches')} AS normalized_accuracy_pct FROM "
    f"(SELECT mfg_part_num, count(*) AS total_compared_fields, {_cnt('EXACT_MATCH')} AS exact_matches, {_cnt('NORMALIZED_MATCH')} AS normalized_matches, "
    f"{_cnt('MISMATCH')} AS mismatches, {_cnt('EXPECTED_EMPTY')} AS expected_empty, count_if(actual_value <> '')::BIGINT AS actual_filled FROM comparison GROUP BY 1)",
)

# ------------------------------------------------------------------ sources and sinks

answer("feed_csv_scan", "SELECT _ordinal, " + ", ".join(f"{n} AS {n.lower()}" for n in V.FEED_COLUMNS) + " FROM feed")
answer(
    "feed_multiline_scan",
    "SELECT _ordinal, Mfg_Part_Num AS mpn, CASE _ordinal % 3 WHEN 0 THEN replace(Part_Desc, ' ', chr(10)) WHEN 1 THEN 'a \"b\"' || chr(10) || chr(10) || Part_Desc ELSE Part_Desc END AS description FROM feed",
)
answer("feed_encoding_fallback", "SELECT _ordinal, Mfg_Part_Num AS mpn, Part_Desc || ' façade' AS description FROM feed")
answer("feed_column_alias", "SELECT _ordinal, Mfg_Part_Num AS mpn, Part_Desc AS description, Part_Manuf AS manufacturer FROM feed")
cte("ingest0", f"SELECT _ordinal, {clean_cell('Mfg_Part_Num')} AS m, {clean_cell(PD)} AS t, {clean_cell('Part_Manuf')} AS manufacturer FROM feed")
cte(
    "ingested",
    "SELECT *, NOT malformed AND row_number() OVER (PARTITION BY malformed, upper(mpn) ORDER BY _ordinal) > 1 AS duplicate FROM (SELECT _ordinal, manufacturer, m = '' AND t = '' AS malformed, "
    "CASE WHEN m = '' AND t <> '' THEN 'AUTO-GEN-' || (_ordinal + 1) ELSE m END AS mpn, CASE WHEN t <> '' THEN t ELSE m END AS description FROM ingest0)",
)
answer("feed_ingest", "SELECT _ordinal, mpn, description, manufacturer, malformed, duplicate FROM ingested")
answer(
    "feed_ingest_summary",
    "SELECT count_if(NOT malformed)::BIGINT AS total_records_queued, count_if(NOT malformed AND NOT duplicate)::BIGINT AS unique_mpns, count_if(duplicate)::BIGINT AS duplicates_detected, count_if(malformed)::BIGINT AS malformed_rows_skipped FROM ingested",
)
answer(
    "golden_scan",
    f"SELECT match_key, max(_ordinal) AS _ordinal, arg_max({PD}, _ordinal) AS Part_Desc FROM (SELECT *, upper({strip('Mfg_Part_Num')}) AS match_key FROM feed) WHERE match_key <> '' GROUP BY 1",
)
_md5 = lambda cols: "md5(" + " || '|' || ".join(f"coalesce({x}, '')" for x in cols) + ")"
_half = lambda cols, at: f"sum(('0x' || substr({_md5(cols)}, {at}, 16))::UBIGINT::HUGEINT)::VARCHAR"
_print = lambda cols: f"count(*) AS row_count, {_half(cols, 1)} AS digest_high, {_half(cols, 17)} AS digest_low"
answer("dataset_fingerprint", f"SELECT {_print(V.FEED_COLUMNS)} FROM feed")
cte("overrides", "SELECT lower(p_brand) AS alias, max(p_type) AS brand FROM part GROUP BY 1 UNION ALL SELECT 'bosch', max(p_brand) FROM part WHERE p_partkey % 500 = 0")
answer("master_dim_load", "SELECT coalesce(o.alias, a.alias) AS alias, coalesce(o.brand, a.brand) AS brand FROM alias_rows a FULL JOIN overrides o USING (alias)")
answer(
    "master_dim_sync",
    "SELECT coalesce(o.alias, a.alias) AS alias, coalesce(o.brand, a.brand) AS brand, CASE WHEN a.alias IS NULL THEN 'insert' WHEN o.alias IS NULL THEN 'keep' ELSE 'update' END AS action FROM alias_rows a FULL JOIN overrides o USING (alias)",
)
answer(
    "delivery_csv_sink",
    "SELECT part_key, d_invoice_desc AS invoice_desc, d_long_desc1 AS long_desc, coalesce(CASE WHEN status <> 'ERROR' THEN s.value END, '') AS value_4, d_country_of_origin AS country FROM delivered d LEFT JOIN slots s ON s._ordinal = d._ordinal AND s.slot = 4",
)
cte(
    "damaged",
    "SELECT d._ordinal, d.part_key, CASE WHEN d._ordinal % 15 = 0 THEN lower(d_invoice_desc) WHEN d._ordinal % 17 = 0 THEN d_invoice_desc || ' ' || d_short_desc ELSE d_invoice_desc END AS inv, "
    "CASE WHEN d._ordinal % 23 = 0 THEN '-- Unbranded --' ELSE d_warranty END AS war, d.* EXCLUDE (_ordinal, part_key) FROM delivered d",
)
_req = {"PART_NUMBER": "part_key", "Mfg_Part_Num": "part_key", "Part_Desc": "d_part_desc", "MANUFACTURER_NAME": "d_manufacturer_name", "BRAND_NAME": "d_brand_name",
        "MANUFACTURER_PART_NUMBER": "part_key", "INVOICE_DESC": "inv", "MOBILE_DESC": "d_mobile_desc", "Product Name": "d_product_name", "Actual Image (Yes/No)": "'No'"}
_leak = rf"(?i)--{WS}*(?:Unbranded|No{WS}+Unilog{WS}+Brand|No{WS}+DIB{WS}+Brand){WS}*--|\[placeholder\]"
_glued1 = r"(?i)^\d+(\.\d+)?(in|v|a|w|hz|dba|lbs?|mm|cm)$"
cte(
    "damaged_slots",
    "SELECT d._ordinal, g.slot, CASE WHEN g.slot = 4 AND d._ordinal % 19 = 0 THEN '120v' WHEN d.status = 'ERROR' THEN '' ELSE coalesce(s.value, '') END AS value "
    "FROM damaged d CROSS JOIN (SELECT unnest(range(1, 51)) AS slot) g LEFT JOIN slots s ON s._ordinal = d._ordinal AND s.slot = g.slot",
)
_leak_cells = {n: f"d_{snake(n)}" for n in VALUED if n not in ("E1_Brand", "INVOICE_DESC", "Warranty")} | {"INVOICE_DESC": "inv", "Warranty": "war"}
cte(
    "issues",
    "".join(f"SELECT _ordinal, 1 AS grp, {i} AS ord, {q(n)} AS column_name, 'MISSING_REQUIRED' AS issue_type, 'Required column ''{n}'' is empty' AS message, '' AS actual_value FROM damaged WHERE {strip(e)} = '' UNION ALL " for i, (n, e) in enumerate(_req.items()))
    + "SELECT _ordinal, 1, 20, 'INVOICE_DESC', 'LENGTH_EXCEEDED', 'INVOICE_DESC exceeds 40 characters (length: ' || length(inv) || ')', inv FROM damaged WHERE length(inv) > 40 UNION ALL "
    "SELECT _ordinal, 1, 21, 'INVOICE_DESC', 'INVALID_CASING', 'INVOICE_DESC must be strictly UPPERCASE', inv FROM damaged WHERE inv <> upper(inv) "
    + "".join(f"UNION ALL SELECT _ordinal, 2, {V.DELIVERY_HEADERS.index(n)}, {q(n)}, 'PLACEHOLDER_LEAK', 'Uncleaned placeholder token detected in column ''{n}''', {e} FROM damaged WHERE {has(e, _leak)} " for n, e in _leak_cells.items())
    + f"UNION ALL SELECT _ordinal, 3, slot, 'ATTRIBUTE_VALUE ' || slot, 'INVALID_UOM', 'Glued UOM detected in ATTRIBUTE_VALUE ' || slot || ': ''' || {strip('value')} || '''', {strip('value')} FROM damaged_slots WHERE slot <= 15 AND {has(strip('value'), _glued1)}",
)
answer("validated_export", "SELECT part_key, sink, count(*) AS records FROM (SELECT part_key, CASE WHEN _ordinal IN (SELECT _ordinal FROM issues) THEN 'quarantine' ELSE 'delivery' END AS sink FROM damaged) GROUP BY ALL")
_jr = reply_json("content")
answer(
    "training_jsonl_sink",
    f"SELECT trim(mpn) AS request, CASE WHEN ok THEN json_extract_string(CASE WHEN ok THEN j END, '$.item_type') END AS item_type, CASE WHEN ok THEN json_extract_string(CASE WHEN ok THEN j END, '$.voltage') END AS voltage, NOT ok AS wrapped FROM (SELECT mpn, {_jr} AS j, json_valid({_jr}) AS ok FROM model_output)",
)
answer("run_artifacts", "SELECT run_id, batch_id, count(*) AS total_items, count_if(review_required)::BIGINT AS review_needed_count FROM tracking CROSS JOIN (VALUES ('r1'), ('r2')) r(run_id) GROUP BY ALL")
answer(
    "persist_products",
    "SELECT _ordinal, Mfg_Part_Num AS mfg_part_num, Part_Desc AS part_desc, Part_Manuf AS raw_manuf, coalesce(f_brand, brand) AS canonical_brand, CASE WHEN needs_review THEN 'review_required' ELSE 'completed' END AS status FROM enriched",
)
answer(
    "persist_runs",
    "SELECT _ordinal, source_mode, confidence AS confidence_score, provenance_score, round(lov_score, 6) AS lov_score, rule_score, invoice_desc, mobile_desc, product_title, long_desc, short_desc FROM enriched",
)
_rule = {"dimensions": "has_decimal_inch", "voltage": "has_glued_uom"}


def field_conf(f):
    lov = f"CASE WHEN {valid_lov(f, 'f_' + f)} THEN 1.0 ELSE 0.0 END" if f in ("item_type", "mounting", "material", "voltage") else "1.0"
    rule = f"CASE WHEN {_rule[f]} THEN 0.5 ELSE 1.0 END" if f in _rule else "1.0"
    return f"CASE WHEN {present('f_' + f)} THEN round(0.40::DOUBLE * provenance_score + 0.35::DOUBLE * ({lov})::DOUBLE + 0.25::DOUBLE * ({rule})::DOUBLE, 3) END"


FC = ["brand", "item_type", "voltage", "dimensions", "mounting", "material"]
cte("field_conf", " UNION ALL ".join(f"SELECT _ordinal, {q(f)} AS field, {field_conf(f)} AS confidence FROM enriched" for f in FC))
answer("field_confidence", "SELECT * FROM field_conf WHERE confidence IS NOT NULL")
_ev = lambda n, d: f"coalesce(nullif(se_{n}, ''), nullif(sn_{n}, ''), {d})"
_prov = {
    "brand": ("'Resolved from ''' || coalesce(Part_Manuf, 'None') || ''''", "true"),
    "item_type": ("'Extracted from ''' || substr(desc_clean, 1, 60) || ''''", valid_lov("item_type", "f_item_type")),
    "voltage": (_ev("voltage", "'Extracted voltage rating'"), valid_lov("voltage", "f_voltage")),
    "dimensions": (_ev("dimensions", "'Converted fractional size'"), "true"),
    "material": (_ev("material", "'Extracted material specification'"), valid_lov("material", "f_material")),
}
cte(
    "prov",
    " UNION ALL ".join(
        f"SELECT e._ordinal, {q(f)} AS field, f_{f} AS value, CASE WHEN coalesce(source_url, '') <> '' THEN source_url ELSE 'distributor_feed' END AS source_url, "
        f"CASE WHEN ek IS NOT NULL THEN 'manufacturer_official_html' ELSE 'distributor_feed' END AS source_type, {ev} AS evidence, coalesce(c.confidence, {'brand_score' if f == 'brand' else 'e.confidence'}) AS confidence, {lov} AS is_lov_validated "
        f"FROM enriched e LEFT JOIN field_conf c ON c._ordinal = e._ordinal AND c.field = {q(f)}"
        for f, (ev, lov) in _prov.items()
    ),
)
answer("provenance_rows", "SELECT * FROM prov")
answer(
    "persist_attributes",
    "SELECT _ordinal, CASE field WHEN 'item_type' THEN 'Item Type' ELSE upper(field[1]) || field[2:] END AS attribute_label, value AS attribute_value, source_url, source_type, evidence AS evidence_text, confidence, is_lov_validated FROM prov WHERE value <> ''",
)
answer(
    "persist_review_queue",
    "SELECT _ordinal, 'INVOICE_DESC / ATTRIBUTES' AS field_name, Part_Desc AS original_value, invoice_desc AS suggested_value, invoice_desc AS current_value, 'Confidence score below 90% threshold' AS reason, confidence, 'PENDING' AS status FROM enriched WHERE needs_review",
)
answer("persist_audit", "SELECT _ordinal, 'ENRICHMENT_COMPLETED' AS event_type, 'PRODUCT' AS entity_type, Mfg_Part_Num AS entity_id, confidence, source_mode, needs_review FROM enriched")

answer(
    "persist_related",
    "SELECT e.Mfg_Part_Num AS mfg_part_num, CASE WHEN e.needs_review THEN 'review_required' ELSE 'completed' END AS status, e.confidence AS confidence_score, "
    "CASE p.field WHEN 'item_type' THEN 'Item Type' ELSE upper(p.field[1]) || p.field[2:] END AS attribute_label, p.value AS attribute_value, 0 AS rewritten, 0::BIGINT AS unresolved "
    "FROM prov p JOIN enriched e ON e._ordinal = p._ordinal WHERE p.value <> '' AND e._ordinal IN (SELECT max(_ordinal) FROM enriched GROUP BY Mfg_Part_Num, Part_Desc, Part_Manuf)",
)
_lines = "SELECT _ordinal AS k, _ordinal // 5000 AS file_no, concat_ws('|', " + ", ".join(V.FEED_COLUMNS) + ") AS v FROM feed"
_leaves = (
    "SELECT file_no, start // 4096 AS leaf, sha256(string_agg(start || ':' || sha256(v), ',' ORDER BY start)) AS digest FROM "
    "(SELECT *, coalesce(sum(strlen(v) + 1) OVER (PARTITION BY file_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM {}) GROUP BY ALL"
)
answer(
    "file_fingerprint",
    f"WITH lines AS ({_lines}), changed AS (SELECT k, file_no, CASE WHEN k % 5000 = 2500 THEN reverse(v) ELSE v END AS v FROM lines), "
    f"l0 AS ({_leaves.format('lines')}), c0 AS ({_leaves.format('changed')}), "
    "whole AS (SELECT file_no, sum(strlen(v) + 1)::BIGINT AS bytes, sha256(string_agg(v || chr(10), '' ORDER BY k)) AS sha256 FROM lines GROUP BY ALL), "
    "l1 AS (SELECT file_no, leaf // 16 AS node, sha256(string_agg(leaf || ':' || digest, ',' ORDER BY leaf)) AS digest FROM l0 GROUP BY ALL), "
    "l2 AS (SELECT file_no, node // 16 AS node, sha256(string_agg(node || ':' || digest, ',' ORDER BY node)) AS digest FROM l1 GROUP BY ALL), "
    "l3 AS (SELECT file_no, node // 16 AS node, sha256(string_agg(node || ':' || digest, ',' ORDER BY node)) AS digest FROM l2 GROUP BY ALL), "
    "differ AS (SELECT file_no, count(*) AS changed_ranges, min(leaf) * 4096 AS first_changed FROM (SELECT file_no, leaf FROM l0 FULL JOIN c0 USING (file_no, leaf) WHERE l0.digest IS DISTINCT FROM c0.digest) GROUP BY ALL) "
    "SELECT file_no, bytes, (SELECT count(*) FROM l0 WHERE l0.file_no = w.file_no) AS leaves, sha256(bytes || ':' || CASE WHEN bytes <= 4096 THEN (SELECT digest FROM l0 WHERE l0.file_no = w.file_no LIMIT 1) "
    "WHEN bytes <= 65536 THEN (SELECT digest FROM l1 WHERE l1.file_no = w.file_no LIMIT 1) WHEN bytes <= 1048576 THEN (SELECT digest FROM l2 WHERE l2.file_no = w.file_no LIMIT 1) "
    "ELSE (SELECT digest FROM l3 WHERE l3.file_no = w.file_no LIMIT 1) END) AS root, sha256, coalesce(changed_ranges, 0) AS changed_ranges, first_changed FROM whole w LEFT JOIN differ USING (file_no)",
)

# ------------------------------------------------------------------ cleaning and scalars

on_feed("clean_placeholders", description=clean(PD), manufacturer=clean("Part_Manuf"), e1_brand=clean("E1_Brand"))
answer(
    "sanitize_input_row",
    "SELECT *, row_error IS NULL AS row_valid FROM (SELECT *, CASE WHEN coalesce(Mfg_Part_Num, '') = '' THEN 'Missing or invalid Mfg_Part_Num' WHEN coalesce(Part_Desc, '') = '' THEN 'Missing or invalid Part_Desc' END AS row_error FROM (SELECT _ordinal, "
    + ", ".join(f"{sanitize(n)} AS {n}" for n in V.FEED_COLUMNS) + " FROM feed))",
)
on_feed("uom_spacing", spaced=space_units(PD))
on_feed("decimal_to_fraction", fractions=fractions(PD))
cte("unit_rows", table("unit", ["spelling", "standard"], list(D.units.items())))
answer("uom_normalize", rf"SELECT _ordinal, unit, coalesce(standard, unit) AS standard FROM (SELECT _ordinal, unnest(regexp_extract_all({PD}, '\d\s*([A-Za-z]+)', 1)) AS unit FROM feed) LEFT JOIN (SELECT spelling, CASE WHEN spelling = 'pc' THEN 'Piece' ELSE standard END AS standard FROM unit_rows) ON spelling = lower(unit)")
on_feed("invoice_compress", invoice=compress("concat_ws(' ', Part_Manuf, Part_Desc)"))
_first = r"try_cast(regexp_extract(Part_Desc, '[-+]?(?:\d*\.\d+|\d+)') AS DOUBLE)"
answer(
    "numeric_sanity",
    f"SELECT _ordinal, field, coalesce(CASE field WHEN 'voltage' THEN n > 0 AND n <= 1000 WHEN 'amperage' THEN n > 0 AND n <= 2000 WHEN 'dimensions' THEN n > 0 AND n <= 1000 WHEN 'sound_level' THEN n BETWEEN 0 AND 150 ELSE n >= 0 END, true) AS sane "
    f"FROM (SELECT _ordinal, {_first} AS n FROM feed) CROSS JOIN (VALUES ('voltage'), ('amperage'), ('dimensions'), ('sound_level'), ('other')) f(field)",
)
_kind = f"coalesce({rules(PD, X.ITEM_TYPE_RULES)}, 'Product')"
_base = f"concat_ws(', ', coalesce({strip(filled('Part_Manuf'))}, 'UNASSIGNED'), {_kind}, CASE WHEN _ordinal % 2 = 0 THEN 'Professional Series' END, {strip('Mfg_Part_Num')})"
answer(
    "mobile_desc_calibrated",
    "SELECT _ordinal, CASE WHEN length(f) < 60 THEN substr(f || ' - Industrial Grade ' || kind, 1, 78) WHEN length(f) > 80 THEN regexp_replace(substr(f, 1, 80), ' [^ ]*$', '') ELSE f END AS mobile "
    f"FROM (SELECT _ordinal, kind, CASE WHEN dims <> '' AND length(b) + length(dims) + 2 <= 78 THEN b || ', ' || dims ELSE b END AS f FROM (SELECT _ordinal, {_kind} AS kind, {dimensions(PD)} AS dims, {_base} AS b FROM feed))",
)
_u2 = grab(strip("spec"), r"^([\d\-/.\s]+)\s*([A-Za-z]+)$", 2)
answer(
    "split_value_uom",
    f"SELECT _ordinal, spec, CASE WHEN {_u2} IN ({words(V.SLOT_UOMS)}) THEN {strip(grab(strip('spec'), r'^([\d\-/.\s]+)\s*([A-Za-z]+)$'))} ELSE {strip('spec')} END AS value, CASE WHEN {_u2} IN ({words(V.SLOT_UOMS)}) THEN {_u2} ELSE '' END AS uom "
    f"FROM (SELECT _ordinal, unnest([{capture(PD, X.VOLTAGE, ' V')}, CASE WHEN dims IS NULL THEN '' ELSE {fractions('dims')} END, {capture(PD, X.FLOW_RATE, ' GPM')}, {rules(PD, X.MATERIAL_RULES)}]) AS spec FROM (SELECT *, {dimensions(PD)} AS dims FROM feed)) WHERE spec IS NOT NULL",
)
_nc = "concat_ws(' ', ' FRIGIDAIRE® ', Part_Manuf)"
_tr = lambda e: f"translate({e}, '®™', '')"
on_feed("normalize_compare", strict=_tr(f"lower({strip(_nc)})"), loose=f"lower({strip(_tr(strip(_nc)))})", equal="true")
answer("numeric_equiv", "SELECT p_partkey, p_partkey % 3 = 0 AS equal FROM part")
_st = strip(rf"regexp_replace(regexp_replace({strip('content')}, '(?is)^```(?:json)?\s*', ''), '(?s)\s*```$', '')")
answer(
    "json_from_model_text",
    f"SELECT k, CASE WHEN s = '' THEN 'Empty LLM content' WHEN NOT json_valid(s) THEN 'JSONDecodeError' WHEN json_type(CASE WHEN json_valid(s) THEN s END) <> 'OBJECT' THEN 'Parsed JSON is not a dictionary' ELSE 'OK' END AS status, "
    f"CASE WHEN json_valid(j) THEN json_extract_string(CASE WHEN json_valid(j) THEN j END, '$.item_type') END AS item_type FROM (SELECT k, {_st} AS s, {_jr} AS j FROM model_output)",
)
_html = r"regexp_replace(html, '(?s)<!--.*?-->|<![^>]*>', ' ', 'g')"
for _e in W.DROPPED_ELEMENTS:
    _rx = r"(?is)<embed\b[^>]*>" if _e == "embed" else rf"(?is)<{_e}\b[^>]*>.*?(?:</{_e}\s*>|\z)"
    _html = f"regexp_replace({_html}, {q(_rx)}, ' ', 'g')"
_html = f"regexp_replace({_html}, '(?s)<[/a-zA-Z][^>]*>', ' ', 'g')"
_num = r"regexp_extract(e, '([0-9a-fA-F]+);', 1)"
_code = f"(CASE WHEN starts_with(lower(e), '&#x') THEN try_cast('0x' || {_num} AS BIGINT) ELSE try_cast({_num} AS BIGINT) END)"
_char = f"CASE WHEN {_code} > 0 AND {_code} < 1114112 AND NOT {_code} BETWEEN 55296 AND 57343 THEN chr({_code}::INT) ELSE chr(65533) END"
_raw, _html = _html, f"list_reduce(list_distinct(regexp_extract_all(h, '&#[xX][0-9a-fA-F]+;|&#[0-9]+;')), lambda h0, e: replace(h0, e, {_char}), h)"
for _ent, _ch in W.ENTITIES.items():
    _html = f"replace({_html}, {q(_ent)}, {q(_ch)})"
answer("html_technical_text", f"SELECT page_id, {squish(_html)} AS text FROM (SELECT page_id, {_raw} AS h FROM pages)")
_inside = lambda h, dom: f"({h} = {dom} OR ends_with({h}, '.' || {dom}))"
_urls = QS.URL_SQL.replace("array(", "list_value(", 1)
cte("page_urls", f"SELECT page_id, unnest(range(len(us)))::INT AS variant, unnest(us) AS u, brand FROM (SELECT page_id, {_urls} AS us, {QS.URL_BRAND_SQL} AS brand FROM pages)")
cte("page_hosts", r"SELECT page_id, variant, brand, u, regexp_replace(split_part(split_part(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)', 1)), '@', -1), ':', 1), '^www[.]', '') AS h FROM page_urls")
_safe = f"starts_with(lower(u), 'https://') AND h <> '' AND h NOT IN ({words(W.LOCAL_HOSTS)}) AND NOT (regexp_matches(h, {q(W.IP_LITERAL)}) AND regexp_matches(h, {q(W.RESERVED_IP)}))"
cte("brand_domains", table("bd", ["bname", "dom"], [(n, d.removeprefix("www.")) for n, d in D.domains.items()]))
answer(
    "url_allowlist",
    f"SELECT page_id, variant, {_safe} AND coalesce(bool_or({_inside('h', 'dom')}), false) AS any_brand, {_safe} AND coalesce(bool_or({_inside('h', 'dom')} AND bname = brand), false) AS own_brand FROM page_hosts CROSS JOIN brand_domains GROUP BY page_id, variant, u, h, brand",
)
cte("exact_domains", table("ed", ["bname", "site"], list(D.domains.items())))
answer(
    "official_url",
    f"SELECT _ordinal, CASE WHEN Mfg_Part_Num <> '' THEN 'https://' || site || '/products/' || lower({strip('Mfg_Part_Num')}) END AS candidate, coalesce('https://' || coalesce(dom1, dom2) || '/product/' || part_key, '') AS brand_url FROM delivered0 LEFT JOIN exact_domains ON bname = {strip('brand')}",
)
_cn = rf"(?i){WS}*(?:\(\w+\)|LLC|Inc\.?|Corp\.?|Co\.?|Supply|Accessory|Tools?|Company|Products?)\b"
answer(
    "resolver_query_clean",
    f"SELECT _ordinal, CASE WHEN q1 <> '' THEN q1 ELSE x END AS query FROM (SELECT _ordinal, x, {strip('regexp_replace(x, ' + q(_cn) + ', ' + q('') + ', ' + q('g') + ')')} AS q1 FROM (SELECT _ordinal, {clean('Part_Manuf')} AS x FROM feed))",
)
answer("content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")

# ------------------------------------------------------------------ extraction

cte("descs", f"SELECT _ordinal, Mfg_Part_Num, {clean(PD)} AS t, Part_Desc, Part_Manuf FROM feed")
_ct = "lower(coalesce(t, '') || ' ' || Mfg_Part_Num || ' ' || coalesce(Part_Manuf, ''))"
answer("category_detect", f"SELECT _ordinal, {rules(_ct, X.CATEGORY_RULES, q(X.DEFAULT_CATEGORY))} AS category FROM descs")
on_feed("extract_voltage", value=capture(PD, X.VOLTAGE, " V"))
on_feed("extract_dimensions", value=dimensions(PD))
on_feed("extract_material", value=rules(PD, X.MATERIAL_RULES))
on_feed("extract_mounting", value=rules(PD, X.MOUNTING_RULES))
on_feed("extract_item_type", value=rules(PD, X.ITEM_TYPE_RULES))
on_feed("extract_mpn_fallback", value=capture(strip(PD), X.LEADING_PART_NUMBER))
_specs = "list_filter([" + ", ".join(f"{{'k': {q(n)}, 'v': {e}}}" for n, e in RAW_SPEC_SQL.items()) + "], lambda s: s.v IS NOT NULL)"
answer(
    "extract_raw_specs",
    f"SELECT _ordinal, p - 1 AS position, s.k AS spec, s.v AS value FROM (SELECT _ordinal, unnest(l) AS s, generate_subscripts(l, 1) AS p FROM (SELECT _ordinal, {_specs} AS l FROM (SELECT _ordinal, t AS desc_clean, {dimensions('t')} AS h_dimensions FROM descs)))",
)
answer(
    "evidence_spec_extract",
    "SELECT _ordinal, t_item_type AS item_type, t_voltage AS voltage, t_amperage AS amperage, t_sound AS sound_level, t_dimensions AS dimensions, t_mounting AS mounting, t_material AS material FROM tech",
)
answer(
    "conversation_jsonl_sink",
    "SELECT conv_id AS id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS position, role, coalesce(text, '') AS content FROM conversations",
)
# The query's rule in full: a word ends where no letter, digit or mark of any script follows, a vertical tab is a blank, letters of the
# units are ASCII ones, and the capital dotted I is small as i with its dot. RE2's \b, \s and (?i) and DuckDB's lower() say otherwise.
_blank, _edge = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]", r"[^\p{L}\p{Nd}\p{Mn}_]"
_told_trim = lambda e: f"regexp_replace({e}, '^{_blank}+|{_blank}+$', '', 'g')"
_told_lower = "lower(replace({}, chr(304), 'i' || chr(775)))"
_told = dict(snippet_markers)
_told["voltage"] = (*_told["voltage"][:2], rf"(?:^|{_edge})(\d+(?:/\d+)?[\s\x{{0b}}]*(?:[vV](?:[oO][lL][tT])?[sS]?|[kK][vV]))(?:$|{_edge})")
_told["amperage"] = (
    rf"amp|current|(?:^|{_edge})\d+[\s\x{{0b}}]*a(?:$|{_edge})", _told["amperage"][1],
    rf"(?:^|{_edge})(\d+(?:\.\d+)?[\s\x{{0b}}]*(?:[aA](?:[mM][pP])?[sS]?|[mM][aA]))(?:$|{_edge})",
)
_page_text = f"trim(regexp_replace({_html}, '{_blank}+', ' ', 'g'))"
cte("page_texts", f"SELECT page_id AS ek, {_page_text} AS text FROM (SELECT page_id, {_raw} AS h FROM pages)")
cte("fetched_lines", lines_of("evidence", _told_trim))
cte("page_lines", lines_of("page_texts", _told_trim))
cte("doc_lines", lines_of("(SELECT doc_id AS ek, text FROM documents)", _told_trim))
answer(
    "evidence_snippets",
    " UNION ALL ".join(
        f"SELECT '{source}' AS source, ek AS id, spec_key, value, evidence FROM ({snippets_of(lines, _told, _told_lower)})"
        for source, lines in (("evidence", "fetched_lines"), ("page", "page_lines"), ("document", "doc_lines"))
    ),
)
answer(
    "model_output_merge",
    "SELECT _ordinal, " + ", ".join(f"a_{n} AS {n}" for n in ("brand", "item_type", "mpn", "voltage", "dimensions", "mounting", "material", "series", "mfr_url"))
    + ", array_to_string(list_transform(raw_specs, lambda s: s.k || '=' || coalesce(s.v, '')), ';') AS raw_specs FROM extracted",
)
answer("source_mode_label", "SELECT _ordinal, source_mode FROM enriched")

# ------------------------------------------------------------------ joins

_pfx = f"(SELECT arg_max(p.brand, length(p.prefix)) FROM prefix_rows p WHERE starts_with(lower({strip('f.Mfg_Part_Num')}), p.prefix))"
cte("all_prefixes", "SELECT prefix, brand FROM prefix_rows UNION ALL SELECT 'k-' || p_partkey, p_brand FROM part")
answer("brand_prefix_join", f"SELECT _ordinal, arg_max(p.brand, length(p.prefix)) AS brand FROM feed f LEFT JOIN all_prefixes p ON starts_with(lower({strip('f.Mfg_Part_Num')}), p.prefix) GROUP BY 1")
answer("brand_alias_exact", f"SELECT _ordinal, a.brand FROM (SELECT _ordinal, lower({clean('Part_Manuf')}) AS m FROM feed) LEFT JOIN (SELECT alias, brand FROM alias_rows UNION ALL SELECT lower(s_name), s_name FROM supplier) a ON a.alias = m")
cte("held", f"SELECT d._ordinal, arg_min(a.brand, a.ord) AS brand FROM descs d JOIN alias_rows a ON length(a.alias) >= 4 AND regexp_matches(lower(concat_ws(' ', t, Part_Manuf)), a.pattern) GROUP BY 1")
answer("brand_alias_contains", "SELECT _ordinal, brand FROM feed LEFT JOIN held USING (_ordinal)")
cte("long_held", "SELECT d._ordinal, arg_min(p_brand, p_partkey) AS brand FROM descs d JOIN part ON contains(lower(concat_ws(' ', t, Part_Manuf)) || ' ', 'chrome ' || lower(p_name) || ' ' || p_size || '.25in supplier#') GROUP BY 1")
answer("brand_alias_join", "SELECT _ordinal, coalesce(h.brand, l.brand) AS brand FROM feed LEFT JOIN held h USING (_ordinal) LEFT JOIN long_held l USING (_ordinal)")


def _fuzzy() -> str:
    """The similarity match over the texts of that query instead of the feed's."""
    from oracle import base

    texts = (
        f"SELECT DISTINCT unnest([x, x || ' tools', x[1:2] || 'x' || x[4:]]) AS t FROM (SELECT DISTINCT {clean('Part_Manuf')} AS x FROM feed) WHERE x IS NOT NULL"
    )
    own = {"texts": texts}
    names = ["texts", "known_texts", "fuzzy_texts", "scored_texts", "brand_match"]
    parts = [f"{n} AS MATERIALIZED ({base.CTES[n]})" for n in ("base", "feed", "alias_rows", "brand_rows")]
    parts += [f"{n} AS MATERIALIZED ({own.get(n, base.CTES[n])})" for n in names]
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT t AS text, CASE WHEN score >= 0.80 THEN brand ELSE "
        + strip("t") + " END AS brand, CASE WHEN score >= 0.80 THEN round(score, 3) ELSE 0.0::DOUBLE END AS score FROM brand_match"
    )


ANSWERS["brand_fuzzy_topk"] = _fuzzy()


def _joined_masters(select: str, texts: str | None = None) -> str:
    """The resolution chain over master tables that grow with parts and suppliers."""
    from oracle import base

    norm = r"trim(regexp_replace(lower(brand), '[^\p{L}\p{N}]', ' ', 'g'))"
    toks = f"list_sort(list_filter(string_split_regex({norm}, ' +'), lambda w: w <> ''))"
    brands = (
        f"SELECT rnk, brand FROM ({base.CTES['brand_rows']}) UNION ALL SELECT p_partkey + 1000, {feeds.PART_BRAND_SQL} FROM part "
        "UNION ALL SELECT s_suppkey + 1000000000, s_name FROM supplier"
    )
    pattern = r"'\b' || regexp_replace(lower(s_name), '([^\w\s])', '\\\1', 'g') || '\b'"
    own = {
        "brand_rows": f"SELECT rnk, {norm} AS norm, {toks} AS toks, array_to_string({toks}, ' ') AS ordered, brand FROM ({brands})",
        "alias_rows": f"SELECT ord, alias, brand, pattern FROM ({base.CTES['alias_rows']}) UNION ALL SELECT s_suppkey + 1000000, lower(s_name), upper(s_name), {pattern} FROM supplier",
        "prefix_rows": f"SELECT prefix, brand FROM ({base.CTES['prefix_rows']}) UNION ALL SELECT 'hom' || s_suppkey, s_name FROM supplier",
        "maker_rows": f"SELECT brand_key, maker FROM ({base.CTES['maker_rows']}) UNION ALL SELECT lower(s_name), s_name || ' Inc' FROM supplier",
    }
    if texts:
        own |= {"texts": texts, "known_texts": "SELECT t, NULL AS exact_brand, NULL AS held_brand FROM texts"}
    names = ["base", "feed", "brand_rows", "alias_rows", "prefix_rows", "maker_rows", "cleaned", "cleaned2", "texts", "known_texts", "fuzzy_texts", "scored_texts", "brand_match", "prefixed", "resolved0", "resolved"]
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({own.get(n, base.CTES[n])})" for n in names) + "\n" + select


ANSWERS["brand_fuzzy_join"] = _joined_masters(
    "SELECT t AS text, brand, round(score, 3) AS score FROM brand_match WHERE score >= 0.80",
    "SELECT DISTINCT unnest([brand[1:2] || 'x' || brand[4:], brand || ' tools']) AS t FROM brand_rows WHERE rnk >= 1000",
)
ANSWERS["resolve_entity_join"] = _joined_masters("SELECT _ordinal, brand, manufacturer, supplier, brand_score, brand_source FROM resolved")
ANSWERS["enrich_join"] = _joined_masters("SELECT _ordinal, status, brand, manufacturer, category FROM resolved")
answer("resolve_entity", "SELECT _ordinal, brand, manufacturer, supplier, brand_score, brand_source FROM resolved")
on_feed("is_distributor", distributor=distributor("Part_Manuf"))
answer(
    "manufacturer_of_brand",
    f"SELECT _ordinal, coalesce(maker, {strip(_tr('b'))}, '') AS manufacturer FROM (SELECT _ordinal, coalesce({_pfx}, Part_Manuf) AS b FROM feed f) LEFT JOIN maker_rows ON brand_key = lower({strip('b')})",
)
answer("evidence_join", "SELECT _ordinal, source_url, http_status FROM with_ev LEFT JOIN evidence USING (ek)")
cte("gold_keys", "SELECT _ordinal, lower(Mfg_Part_Num) AS Mfg_Part_Num, Part_Desc FROM feed WHERE _ordinal NOT IN (FROM no_reference) UNION ALL SELECT _ordinal, 'gold-' || _ordinal, Part_Desc FROM feed WHERE _ordinal IN (FROM no_reference)")
cte("in_keys", f"SELECT DISTINCT {ukey('Mfg_Part_Num')} AS match_key FROM feed WHERE {ukey('Mfg_Part_Num')} <> ''")
cte("ref_keys", f"SELECT DISTINCT {ukey('Mfg_Part_Num')} AS match_key FROM gold_keys WHERE {ukey('Mfg_Part_Num')} <> ''")
cte("key_status", "SELECT coalesce(a.match_key, b.match_key) AS match_key, CASE WHEN b.match_key IS NULL THEN 'input_only' WHEN a.match_key IS NULL THEN 'golden_only' ELSE 'matched' END AS status FROM in_keys a FULL JOIN ref_keys b ON a.match_key = b.match_key")
answer("key_match", "SELECT * FROM key_status")
answer(
    "golden_lookup",
    f"SELECT match_key, min(_ordinal) AS _ordinal, arg_min(Part_Desc, _ordinal) AS Part_Desc FROM (SELECT *, {ukey('Mfg_Part_Num')} AS match_key FROM gold_keys) WHERE match_key IN (SELECT {ukey('Mfg_Part_Num')} FROM feed) AND match_key <> '' GROUP BY 1",
)
for _n, _not in (("ground_truth_only", ""), ("ground_truth_missing", "NOT")):
    answer(_n, f"SELECT _ordinal, {ukey('Mfg_Part_Num')} AS match_key FROM feed WHERE {ukey('Mfg_Part_Num')} {_not} IN (SELECT match_key FROM ref_keys)")
answer("golden_compare", "SELECT * FROM comparison")
_loose = lambda e: f"translate(CASE WHEN lower({strip(e)}) IN ('', 'nan', 'none', 'null') THEN '' ELSE lower({strip(_tr(strip(e)))}) END, '-', ' ')"
_slot_no = "regexp_extract(field, '([0-9]+)$', 1)::INT"
cte("gold_slots", f"SELECT _ordinal, {_slot_no} AS slot, max(value) FILTER (field LIKE 'ATTRIBUTE_LABEL%') AS label, max(value) FILTER (field LIKE 'ATTRIBUTE_VALUE%') AS value FROM golden WHERE field LIKE 'ATTRIBUTE%' GROUP BY ALL")
cte("own_slots", f"SELECT _ordinal, {_slot_no} AS slot, max(value) FILTER (field LIKE 'ATTRIBUTE_LABEL%') AS label, max(value) FILTER (field LIKE 'ATTRIBUTE_VALUE%') AS value FROM cells WHERE field LIKE 'ATTRIBUTE%' GROUP BY ALL")


def label_match(gold: str, on: str) -> str:
    return (
        f"SELECT g.*, coalesce(p.value, '') AS predicted, coalesce(p.value, '') <> '' AND {_loose('g.value')} = {_loose('coalesce(p.value, ' + q('') + ')')} AS matched FROM (SELECT * FROM {gold} WHERE label <> '' AND value <> '') g "
        f"LEFT JOIN own_slots p ON p._ordinal = {on} AND {_loose('p.label')} = {_loose('g.label')} QUALIFY row_number() OVER (PARTITION BY g._ordinal, {on}, g.slot ORDER BY p.slot) = 1"
    )


answer("attribute_label_match", f"SELECT _ordinal, label, value AS expected, predicted, matched FROM ({label_match('gold_slots', 'g._ordinal')})")
_status = "CASE action_type WHEN 'APPROVE' THEN 'APPROVED' WHEN 'REJECT' THEN 'REJECTED' ELSE 'EDITED' END"
cte(
    "review_state",
    "SELECT q.review_id, q.product_id, q.suggested_value, q.confidence, q.created_at, coalesce(l.status, 'PENDING') AS status, coalesce(l.edited, q.suggested_value) AS current_value, CASE WHEN l.status IS NOT NULL THEN coalesce(l.reviewer, 'catalog_specialist') END AS assigned_to, l.ts AS resolved_at, coalesce(l.n, 0) AS actions "
    f"FROM review_queue q LEFT JOIN (SELECT review_id, arg_max({_status}, (ts, action_id)) AS status, first(reviewer ORDER BY ts DESC, action_id DESC) AS reviewer, max(ts) AS ts, arg_max(new_value, (ts, action_id)) FILTER (action_type = 'EDIT') AS edited, count(*) AS n FROM review_actions GROUP BY 1) l USING (review_id)",
)
answer("review_product_join", "SELECT review_id, status, current_value, p_name, p_brand FROM review_state LEFT JOIN part ON p_partkey = product_id")
answer(
    "run_over_run",
    "SELECT *, CASE WHEN previous IS NULL THEN 'first' WHEN difference > 0 THEN 'up' WHEN difference < 0 THEN 'down' ELSE 'same' END AS trend FROM (SELECT *, round(value - previous, 4) AS difference FROM (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY run) AS previous FROM "
    "(SELECT date_trunc('day', ts)::TIMESTAMP AS run, stage AS metric, round(avg(confidence), 4) AS value FROM tracking GROUP BY ALL)))",
)

# ------------------------------------------------------------------ validation

answer("required_check", "SELECT _ordinal, field, reason FROM violations WHERE grp = 1")
answer("lov_normalize", "SELECT _ordinal, field, raw_value, reason, action, suggestion FROM violations WHERE grp = 2")
answer("evidence_conflict", "SELECT _ordinal, field, raw_value, reason, action, suggestion FROM violations WHERE grp = 3")
answer("attr_guardrails", "SELECT _ordinal, f_voltage AS voltage, f_dimensions AS dimensions FROM final")
answer(
    "validation_result",
    "SELECT _ordinal, category, passed_lov AND passed_rules AS is_valid, passed_lov, passed_rules, NOT (passed_lov AND passed_rules) AS validator_review, n_violations AS violation_count, n_reasons::BIGINT AS reason_count FROM enriched",
)
answer("provenance_score", f"SELECT _ordinal, {provenance('source_type', 'CASE WHEN _ordinal % 2 = 0 THEN 200 END')} AS score FROM feed")
answer("lov_match_score", "SELECT _ordinal, lov_checked, lov_valid, round(lov_score, 6) AS lov_score FROM enriched")
answer("rule_compliance_score", "SELECT _ordinal, has_glued_uom, has_decimal_inch, rule_score FROM enriched")
answer(
    "confidence",
    "SELECT _ordinal, confidence, review_tier, needs_review, printf('Confidence %.3f mathematically derived from: Provenance=%.3f (weight 40%%), LOV Match=%.3f (%d/%d attributes valid, weight 35%%), Rule Compliance=%.3f (weight 25%%). Tier: %s.', "
    "confidence, provenance_score, round(lov_score, 3), lov_valid, greatest(lov_checked, 1), round(rule_score, 3), review_tier) AS explanation FROM enriched WHERE status = 'SUCCESS'",
)
answer("needs_review_route", "SELECT _ordinal, needs_review, CASE WHEN needs_review THEN 'review_required' ELSE 'completed' END AS route, review_tier FROM enriched")
_hdr = "CASE page_id % 5 " + " ".join(f"WHEN {i} THEN [{words(h)}]" for i, h in feeds.MANIFEST_HEADERS.items()) + " END"
cte("uploads", f"SELECT page_id, {_hdr} AS headers, [{words(V.FEED_COLUMNS)}] AS want, {feeds.MANIFEST_NAME_SQL} AS file_name, {feeds.MANIFEST_CONTENT_SQL} AS content FROM pages")
cte("upload_sets", "SELECT *, list_filter(want, lambda h: NOT list_contains(headers, h)) AS missing, list_filter(headers, lambda h: NOT list_contains(want, h)) AS unexpected FROM uploads")
cte("upload_order", "SELECT *, CASE WHEN len(headers) = 6 AND len(missing) = 0 AND len(unexpected) = 0 THEN len(list_filter(range(1, 7), lambda i: headers[i] <> want[i])) ELSE 0 END AS misordered FROM upload_sets")
answer(
    "schema_structure_check",
    "SELECT page_id, len(headers) AS column_count, len(missing) AS missing, len(unexpected) AS unexpected, misordered, len(headers) = 6 AND len(missing) = 0 AND len(unexpected) = 0 AND misordered = 0 AS structure_valid FROM upload_order",
)
answer("header_sets", "SELECT page_id, array_to_string(missing, ',') AS missing, array_to_string(unexpected, ',') AS unexpected FROM upload_sets")
answer("schema_row_issues", "SELECT _ordinal, column_name, issue_type, message, actual_value FROM issues")
cte(
    "schema_results",
    "SELECT d._ordinal AS row_index, d._ordinal + 1 AS row_number, part_key AS mfg_part_num, count(issue_type) AS issue_count, count(issue_type) = 0 AS is_schema_valid, "
    "coalesce(string_agg(DISTINCT issue_type, '; ' ORDER BY issue_type), '') AS issue_types, coalesce(string_agg('[' || column_name || '] ' || message, ' | ' ORDER BY grp, ord), '') AS issue_messages FROM damaged d LEFT JOIN issues i USING (_ordinal) GROUP BY d._ordinal, part_key",
)
answer("schema_row_summary", "SELECT * FROM schema_results")
_schema = f"SELECT count(*) AS total_records_checked, count_if(is_schema_valid)::BIGINT AS schema_pass_count, count_if(NOT is_schema_valid)::BIGINT AS schema_fail_count, {share('count_if(is_schema_valid)', 'count(*)')} AS schema_pass_rate_pct FROM schema_results"
answer(
    "schema_report",
    "SELECT 252 AS total_columns_found, 252 AS expected_column_count, true AS column_count_valid, true AS headers_valid, true AS order_valid, '' AS missing_headers, '' AS unexpected_headers, "
    "count(*) AS total_rows_checked, count_if(is_schema_valid)::BIGINT AS valid_rows_count, count_if(NOT is_schema_valid)::BIGINT AS invalid_rows_count, coalesce(sum(issue_count), 0)::BIGINT AS issues, "
    "count_if(NOT is_schema_valid) = 0 AS is_valid, '252-Column Structural Schema: 100% COMPLIANT | Row Verification: ' || count_if(is_schema_valid) || '/' || count(*) || ' rows valid' AS summary FROM schema_results",
)
answer("schema_metrics", _schema)
answer("schema_failures", "SELECT row_number, mfg_part_num, issue_count, issue_types FROM schema_results WHERE NOT is_schema_valid")
_m = strip("Mfg_Part_Num")
answer(
    "input_validation",
    f"WITH x AS (SELECT _ordinal AS row_index, {_m} AS mfg_part_num, row_number() OVER (PARTITION BY {_m} ORDER BY _ordinal) AS rn, {strip(PD)} = '' AS nodesc FROM feed) "
    "SELECT row_index, mfg_part_num, 'Mfg_Part_Num' AS field, 'MISSING_KEY' AS error_type, 'Mfg_Part_Num is empty or null' AS message FROM x WHERE mfg_part_num = '' "
    "UNION ALL SELECT row_index, mfg_part_num, 'Mfg_Part_Num', 'DUPLICATE_KEY', 'Duplicate Mfg_Part_Num: ' || mfg_part_num FROM x WHERE mfg_part_num <> '' AND rn > 1 "
    "UNION ALL SELECT row_index, mfg_part_num, 'Part_Desc', 'MISSING_DESCRIPTION', 'Part_Desc is empty or null' FROM x WHERE nodesc",
)
_rg = r"(?i)(?:^|[^A-Za-z0-9_])\d+(?:\.\d+)?(?:in|inch|ft|v|volt|a|amp|w|watt|hz|rpm|dba|db|psi|oz|lb|mm|cm|m)\b"
_rd = r"(?i)(?:^|[^A-Za-z0-9_])\d*\.\d+\s*(?:in|inch(?:es)?|\"|in\.)\b"
_rp = rf"(?i)--{WS}*(?:Unbranded|No{WS}+Unilog{WS}+Brand|No{WS}+DIB{WS}+Brand|Unassigned|Not{WS}+Applicable|N/A){WS}*--"
cte("rewarded0", f"SELECT _ordinal, inv, attr_text, concat_ws(' ', inv, attr_text) AS full_text, {strip('inv')} AS si FROM (SELECT _ordinal, CASE WHEN _ordinal % 3 = 0 THEN {compress(PD)} ELSE Part_Desc END AS inv, concat_ws(' ', CASE WHEN _ordinal % 2 = 0 THEN {space_units(PD)} ELSE Part_Desc END, Part_Manuf) AS attr_text FROM feed)")
_one = lambda t: f"CASE WHEN {t} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_rn = [f"{n}_reward" for n in S.REWARDS]
cte(
    "rewarded",
    "SELECT *, round((" + " + ".join(_rn) + ") / 5, 4) AS score, (" + " + ".join(_rn) + ") = 5 AS passed FROM (SELECT _ordinal, "
    + ", ".join(
        f"{_one(t)} AS {n}"
        for n, t in zip(_rn, [
            "si <> '' AND length(si) <= 40", r"si = upper(si) AND regexp_matches(si, '\p{L}')", f"NOT {has('CASE WHEN attr_text <> ' + q('') + ' THEN attr_text ELSE full_text END', _rg)}",
            f"NOT {has('full_text', _rd)}", f"NOT {has('full_text', _rp)}",
        ])
    )
    + " FROM rewarded0)",
)
answer("compliance_reward", "SELECT * FROM rewarded")
answer("compliance_reward_agg", "SELECT count(*) AS records, round(avg(score), 4) AS mean_score, round(count_if(passed) / count(*), 4) AS perfect_rate FROM rewarded")
answer(
    "supplier_leakage",
    f"SELECT count(*) AS records, count_if({distributor('brand')})::BIGINT AS brand_leaks, count_if({distributor('manufacturer')})::BIGINT AS manufacturer_leaks, count_if({distributor('brand')} OR {distributor('manufacturer')})::BIGINT AS leaking_records FROM enriched",
)
_head = "lower(content)"
_danger = " OR ".join(f"contains({_head}, {q(p)})" for p in W.DANGEROUS_CONTENT)
answer(
    "upload_content_screen",
    f"SELECT page_id, file_name, CASE WHEN file_name = '' THEN 'EMPTY_NAME' WHEN NOT regexp_matches(lower(file_name), '[.](csv|xlsx)$') THEN 'EXTENSION' WHEN starts_with(content, 'MZ') THEN 'EXECUTABLE' "
    f"WHEN ends_with(lower(file_name), '.xlsx') THEN 'NOT_A_WORKBOOK' WHEN {_danger} THEN 'ACTIVE_CONTENT' ELSE 'ACCEPTED' END AS verdict FROM uploads",
)

# ------------------------------------------------------------------ delivery

answer("channel_descriptions", "SELECT _ordinal, invoice_desc, mobile_desc, short_desc, long_desc, product_title FROM enriched")
answer("taxonomy_map", f"SELECT _ordinal, {_tax(1)} AS dept, {_tax(2)} AS class, {_tax(3)} AS fine, {_tax(4)} AS classpath FROM enriched")
answer("slot_align", "SELECT * FROM slots")
answer("slots_unpivot", "SELECT s.* FROM slots s JOIN enriched USING (_ordinal) WHERE status <> 'ERROR'")
answer("combined_specs", "SELECT _ordinal, p - 1 AS position, s.k AS spec, s.v AS value FROM (SELECT _ordinal, unnest(specs) AS s, generate_subscripts(specs, 1) AS p FROM specs)")
_proj = ", ".join(
    f"coalesce(CASE WHEN status <> 'ERROR' THEN s{n.split()[-1]}.{n.split('_')[1].split()[0].lower()} END, '') AS {snake(n)}" if n.startswith("ATTRIBUTE_") else f"d_{snake(n)} AS {snake(n)}"
    for n in QS._PROJECTED
)
answer("delivery_project", f"SELECT d._ordinal, {_proj} FROM delivered d LEFT JOIN slots s4 ON s4._ordinal = d._ordinal AND s4.slot = 4 LEFT JOIN slots s16 ON s16._ordinal = d._ordinal AND s16.slot = 16")
answer(
    "delivery_fallback",
    "SELECT _ordinal, m AS part_number, b AS manufacturer_name, b AS brand_name, n AS product_name, substr(" + strip("upper(substr(b, 1, 8) || ' ' || substr(n, 1, 15) || ' ' || m)") + ", 1, 40) AS invoice_desc, "
    f"substr({strip('concat_ws(' + q(' ') + ', b, n, m)')}, 1, 60) AS mobile_desc, 'No' AS actual_image__yes_no FROM (SELECT *, {strip('substr(t, 1, 30)')} AS n FROM (SELECT _ordinal, {_m} AS m, CASE WHEN {strip('Part_Manuf')} <> '' THEN {strip('Part_Manuf')} ELSE 'Commercial Manufacturer' END AS b, "
    f"CASE WHEN Part_Desc <> '' THEN {strip(PD)} WHEN {_m} <> '' THEN {_m} ELSE 'Commercial Product' END AS t FROM feed))",
)
answer("batch_fallback", "SELECT _ordinal, Mfg_Part_Num AS part_number, CASE WHEN Part_Manuf <> '' THEN Part_Manuf ELSE 'UNASSIGNED' END AS manufacturer_name, upper(substr(Part_Desc, 1, 40)) AS invoice_desc, substr(Part_Desc, 1, 78) AS mobile_desc, substr(Part_Desc, 1, 80) AS product_name FROM feed")
cte("fact_labels", table("fl", ["fkind", "slot", "label"], [(k, i, l) for k, ls in V.FACT_SLOT_LABELS.items() for i, l in enumerate(ls, 1)]))
cte("fact_rows", "SELECT _ordinal, fkind, s.k AS label, s.v AS value, pos FROM (SELECT _ordinal, CASE WHEN contains(upper(coalesce(f_item_type, '')), 'DISHWASHER') THEN 'DISHWASHER' WHEN contains(upper(coalesce(f_item_type, '')), 'TOOL') THEN 'POWER_TOOL' ELSE 'GENERAL' END AS fkind, unnest(specs) AS s, generate_subscripts(specs, 1) AS pos FROM specs)")
cte("fact_kind", "SELECT _ordinal, CASE WHEN contains(upper(coalesce(f_item_type, '')), 'DISHWASHER') THEN 'DISHWASHER' WHEN contains(upper(coalesce(f_item_type, '')), 'TOOL') THEN 'POWER_TOOL' ELSE 'GENERAL' END AS fkind FROM specs")
answer(
    "slot_align_v2",
    "SELECT k._ordinal, l.slot, l.label, coalesce(arg_max(coalesce(r.value, ''), r.pos), '') AS value, CASE WHEN count(r.pos) > 0 THEN 'u' ELSE '' END AS uom FROM fact_kind k JOIN fact_labels l USING (fkind) LEFT JOIN fact_rows r ON r._ordinal = k._ordinal AND lower(r.label) = lower(l.label) GROUP BY k._ordinal, l.slot, l.label "
    "UNION ALL SELECT _ordinal, slot, label, value, 'u' FROM (SELECT _ordinal, 15 + row_number() OVER (PARTITION BY _ordinal ORDER BY pos) AS slot, label, coalesce(value, '') AS value FROM fact_rows r WHERE label <> '' AND NOT EXISTS (SELECT 1 FROM fact_labels l WHERE l.fkind = r.fkind AND lower(l.label) = lower(r.label))) WHERE slot <= 50",
)

# ------------------------------------------------------------------ aggregates

_has = lambda n: f"count_if({strip('coalesce(' + n + ', ' + q('') + ')')} <> '')"
answer(
    "input_profile",
    "SELECT count(*) AS total_records, " + ", ".join(
        f"{_has(x)}::BIGINT AS {n}_present, (count(*) - {_has(x)})::BIGINT AS {n}_missing, {share(_has(x), 'count(*)')} AS {n}_completeness_pct" for x, n in (("Mfg_Part_Num", "mpn"), ("Part_Desc", "desc"), ("Part_Manuf", "manuf"))
    ) + ", " + ", ".join(f"count_if(regexp_matches({n}, '(?i)--.*--|unbranded'))::BIGINT AS {n.lower()}_placeholders" for n in V.BRAND_DEFAULTS)
    + f", ({_has('Mfg_Part_Num')} - count(DISTINCT nullif({_m}, '')))::BIGINT AS mpn_duplicates, (SELECT count(*) FROM (SELECT {_m} FROM feed WHERE {_m} <> '' GROUP BY 1 HAVING count(*) > 1)) AS mpn_repeated_values FROM feed",
)
_feed_cells = ["PART_NUMBER", "Mfg_Part_Num", "MANUFACTURER_PART_NUMBER", "SKU - MY_PART_NUMBER"]
_extra_cells = ["MFR URL", "Dept", "Class", "Fine", "Classpath", "Part_Desc", "E1_Brand", "Part_Manuf"]
_known = [n for n in VALUED if n not in ("PART_NUMBER", "MANUFACTURER_PART_NUMBER")]
_pop = " + ".join(f"({strip('d_' + snake(n))} <> '')::INT" for n in _known) + f" + 3 * ({strip('part_key')} <> '')::INT + (part_key <> '' AND status <> 'ERROR')::INT + 2 * (status <> 'ERROR')::INT"
cte("slot_fill", "SELECT _ordinal, sum((label <> '')::INT + (value <> '')::INT + (uom <> '')::INT) AS n FROM slots GROUP BY 1")
answer(
    "golden_profile",
    f"SELECT _ordinal AS mfg_part_num, p AS populated_fields, 252 AS total_fields, round(p / 252 * 100, 2) AS density_pct FROM (SELECT _ordinal, ({_pop} + CASE WHEN status <> 'ERROR' THEN n ELSE 0 END)::BIGINT AS p FROM delivered JOIN slot_fill USING (_ordinal))",
)
_ks = lambda s: f"count_if(status = '{s}')"
answer(
    "golden_coverage",
    f"SELECT {_ks('matched')}::BIGINT AS matched, {_ks('input_only')}::BIGINT AS records_without_ground_truth, {_ks('golden_only')}::BIGINT AS golden_only, {share(_ks('matched'), _ks('matched') + ' + ' + _ks('input_only'))} AS coverage_pct FROM key_status",
)
answer(
    "batch_summary",
    "SELECT batch_id, count(*) AS total_items, count_if(NOT review_required)::BIGINT AS approved_count, count_if(review_required)::BIGINT AS review_needed_count, count_if(confidence >= 0.90)::BIGINT AS confidence_ge_90_count, count_if(confidence < 0.90)::BIGINT AS confidence_lt_90_count, round(avg(confidence), 3) AS average_confidence FROM tracking GROUP BY 1",
)
_pctl = lambda x, p: f"list_sort(list({x}))[least(floor(count({x}) * {p}::DOUBLE), count({x}) - 1)::BIGINT + 1]"


def conf_metrics(source, review, keys=""):
    ge, mid, low = "count_if(confidence >= 0.90)", "count_if(confidence >= 0.75 AND confidence < 0.90)", "count_if(confidence < 0.75)"
    auto = f"count_if(NOT {review} AND confidence >= 0.90)"
    n = "count(*)"
    return (
        f"SELECT {keys + ', ' if keys else ''}{_pctl('confidence', '0.5')} AS median_confidence, {n} AS records, round(avg(confidence), 4) AS average_confidence, min(confidence) AS minimum_confidence, max(confidence) AS maximum_confidence, "
        f"{ge}::BIGINT AS ge_90_count, {share(ge, n)} AS ge_90_pct, {mid}::BIGINT AS between_75_89_count, {share(mid, n)} AS between_75_89_pct, {low}::BIGINT AS lt_75_count, {share(low, n)} AS lt_75_pct, "
        f"{auto}::BIGINT AS auto_approved_count, {share(auto, n)} AS auto_approval_rate_pct, ({n} - {auto})::BIGINT AS review_required_count, {share(f'{n} - {auto}', n)} AS hitl_rate_pct FROM {source} {'GROUP BY ' + keys if keys else ''}"
    )


answer("confidence_metrics", conf_metrics("enriched", "needs_review", "category"))
answer("confidence_metrics_total", conf_metrics("tracking", "review_required"))
_ci = lambda x: f"count_if({x})::BIGINT"
_live, _fall = "source_mode IN ('LIVE_NIM', 'MANUFACTURER_SOURCE')", "source_mode IN ('OFFLINE_HEURISTIC', 'FALLBACK')"
answer(
    "source_mode_metrics",
    f"SELECT count(*) AS total_records, {_ci('llm_attempted')} AS llm_requests, {_ci(_live)} AS successful_llm_requests, {_ci('status = ' + q('ERROR'))} AS failed_llm_requests, {_ci('llm_timeout')} AS timeouts, sum(retry_count)::BIGINT AS retry_count, "
    f"{_ci('source_mode = ' + q('LIVE_NIM'))} AS live_nim, {_ci(_fall)} AS offline_heuristic, {_ci('source_mode = ' + q('MANUFACTURER_SOURCE'))} AS manufacturer_source, {_ci('source_mode = ' + q('CACHE'))} AS cache, {_ci('status = ' + q('ERROR') + ' OR source_mode = ' + q('ERROR'))} AS error, "
    f"{share('count_if(' + _live + ')', 'count(*)')} AS live_nim_rate, {share('count_if(' + _fall + ')', 'count(*)')} AS fallback_rate, {share('count_if(' + _live + ')', 'count_if(llm_attempted)')} AS llm_success_rate FROM tracking",
)
_lat = lambda keys: (
    f"SELECT {keys + ', ' if keys else ''}{_pctl('processing_time_ms', '0.5')} AS p50_ms, {_pctl('processing_time_ms', '0.95')} AS p95_ms, {_pctl('processing_time_ms', '0.99')} AS p99_ms, count(*) AS count, round(avg(processing_time_ms), 2) AS avg_ms, min(processing_time_ms) AS min_ms, max(processing_time_ms) AS max_ms "
    f"FROM tracking WHERE processing_time_ms <> 0 {'GROUP BY ' + keys if keys else ''}"
)
answer("latency_stats", _lat("stage"))
answer("latency_stats_total", _lat(""))
_lm = "lower(source_mode)"
answer(
    "run_metrics",
    f"SELECT count(*) AS total_input_records, {_ci('status = ' + q('SUCCESS'))} AS total_processed, {_ci('status <> ' + q('SUCCESS'))} AS total_failed, {_ci('schema_valid')} AS total_schema_valid, {_ci('NOT schema_valid')} AS total_schema_invalid, {_ci(_lm + ' IN (' + words(['nim', 'nvidia']) + ')')} AS nim_count, "
    f"{_ci(_lm + ' = ' + q('fallback'))} AS fallback_count, {_ci(_lm + ' = ' + q('cache'))} AS cache_hit_count, {_ci(_lm + ' NOT IN (' + words(['nim', 'nvidia', 'fallback', 'cache']) + ')')} AS heuristic_count, {_ci('review_required')} AS hitl_required_count, round(count_if(review_required) / count(*), 6) AS hitl_rate FROM tracking",
)
_at = "count_if(sourcing_attempted OR coalesce(source_domain, '') <> '')"
_reasons = ["DOMAIN_NOT_ALLOWED", "NOT_FOUND", "TIMEOUT", "HTTP_ERROR", "PARSE_ERROR", "NO_EVIDENCE", "NO_SOURCE"]
answer(
    "sourcing_metrics",
    f"SELECT {_at}::BIGINT AS attempts, {_ci('sourcing_success')} AS success, ({_at} - count_if(sourcing_success))::BIGINT AS failure, {_ci('cache_hit')} AS cache_hits, ({_at} - count_if(cache_hit))::BIGINT AS cache_misses, {share('count_if(sourcing_success)', _at)} AS success_rate, {share('count_if(cache_hit)', _at)} AS cache_hit_rate, "
    "count_if(contains(upper(source_type), 'HTML'))::BIGINT AS type_html, count_if(source_type = 'pdf')::BIGINT AS type_pdf, count_if(source_type = 'distributor_feed')::BIGINT AS type_other, "
    + ", ".join(f"count_if(sourcing_failure_reason = '{r}')::BIGINT AS reason_{r.lower()}" for r in _reasons) + f", count_if(sourcing_failure_reason NOT IN ({words(_reasons)}))::BIGINT AS reason_other FROM tracking",
)
answer("source_domains", "SELECT source_domain, count(*) AS records FROM tracking WHERE source_domain <> '' GROUP BY 1")
cte(
    "accuracy",
    f"SELECT *, {share('exact_matches', 'comparable_values')} AS strict_accuracy_pct, {share('exact_matches + normalized_matches', 'comparable_values')} AS normalized_accuracy_pct FROM (SELECT field_name, {_cnt('EXACT_MATCH')} AS exact_matches, {_cnt('NORMALIZED_MATCH')} AS normalized_matches, {_cnt('MISMATCH')} AS mismatches, "
    f"{_cnt('EXPECTED_EMPTY')} AS expected_empty, count_if(comparison_type <> 'EXPECTED_EMPTY')::BIGINT AS comparable_values FROM comparison GROUP BY 1) WHERE comparable_values > 0",
)
answer("field_accuracy", "SELECT * FROM accuracy")
_tot = "sum(exact_matches) + sum(normalized_matches) + sum(mismatches)"
_rec = (
    "SELECT count(*) AS golden_records_evaluated, sum(total_compared_fields)::BIGINT AS total_fields_compared, sum(exact_matches)::BIGINT AS exact_matches, sum(normalized_matches)::BIGINT AS normalized_matches, sum(mismatches)::BIGINT AS mismatches, sum(expected_empty)::BIGINT AS expected_empty, "
    f"{share('sum(exact_matches)', _tot)} AS strict_field_accuracy_pct, {share('sum(exact_matches) + sum(normalized_matches)', _tot)} AS normalized_field_accuracy_pct, {_ci('exact_record_match')} AS exact_record_matches, {_ci('normalized_record_match')} AS normalized_record_matches, "
    f"{share('count_if(exact_record_match)', 'count(*)')} AS exact_record_match_rate_pct, {share('count_if(normalized_record_match)', 'count(*)')} AS normalized_record_match_rate_pct, "
    f"{_ci('NOT exact_record_match AND normalized_accuracy_pct > 0')} AS partial_matches, {_ci('normalized_accuracy_pct = 0')} AS complete_mismatches FROM records"
)
cte("record_totals", _rec)
answer("record_accuracy", "SELECT * FROM record_totals")
answer("record_counts", "SELECT * FROM records")
answer(
    "worst_fields",
    "SELECT * FROM (SELECT field_name AS field, round((exact_matches + normalized_matches) / comparable_values, 4) AS accuracy, comparable_values AS total FROM accuracy ORDER BY accuracy, field LIMIT 20) WHERE accuracy < 1.0",
)
_cor, _exp = "exact_matches + normalized_matches", "exact_matches + normalized_matches + mismatches"
answer(
    "attribute_prf",
    "SELECT *, round(2 * precision_pct * recall_completeness_pct / greatest(precision_pct + recall_completeness_pct, 1e-6), 2) AS f1_score_pct FROM (SELECT mfg_part_num, "
    f"{_exp} AS expected_attributes, actual_filled AS actual_attributes, {_cor} AS correct_attributes, greatest({_exp} - ({_cor}), 0) AS missing_attributes, greatest(actual_filled - ({_exp}), 0) AS extra_attributes, mismatches AS incorrect_attributes, {share(_cor, 'actual_filled')} AS precision_pct, {share(_cor, _exp)} AS recall_completeness_pct FROM records)",
)
_fu = "upper(field_name)"
cte(
    "errors",
    "SELECT mfg_part_num, 'SCHEMA' AS error_category, '252_COLUMN_SCHEMA' AS field, 'Valid 252-column schema' AS expected, issue_messages AS actual, 'Schema failure in row ' || row_number || ': ' || issue_types AS message FROM schema_results WHERE NOT is_schema_valid "
    "UNION ALL SELECT mfg_part_num, 'SOURCE', 'MANUFACTURER_SOURCING', 'Official source specs', sourcing_failure_reason, 'Source failure: ' || sourcing_failure_reason FROM tracking WHERE sourcing_failure_reason <> '' "
    "UNION ALL SELECT mfg_part_num, 'LLM', 'NEMOTRON_EXTRACTION', 'Successful structured extraction', coalesce(llm_error, 'Extraction failed'), 'NIM rate limit or extraction failure' FROM tracking WHERE llm_failed "
    f"UNION ALL SELECT mfg_part_num, CASE WHEN {has(_fu, 'BRAND|MANUF')} THEN 'BRAND' WHEN {has(_fu, 'DESC|MARKETING')} THEN 'DESCRIPTION' WHEN contains({_fu}, 'UOM') THEN 'UOM' WHEN {has(_fu, 'URL|IMAGE|SPEC')} THEN 'SOURCE' WHEN {has(_fu, 'DEPT|CLASS')} THEN 'TAXONOMY' ELSE 'ATTRIBUTE' END, "
    "field_name, expected_value, actual_value, 'Ground truth mismatch on ' || field_name FROM comparison WHERE comparison_type = 'MISMATCH'",
)
answer("error_taxonomy", "SELECT * FROM errors")
answer("error_category_share", "SELECT error_category, count(*) AS errors, round(count(*) / sum(count(*)) OVER () * 100, 1) AS share_pct FROM errors GROUP BY 1")

# scorecard: the reference row of a key is its last
cte("truth_last", "SELECT g.* FROM golden g JOIN (SELECT gkey, max(_ordinal) AS m FROM golden GROUP BY 1) l ON l.gkey = g.gkey AND l.m = g._ordinal")
_fin = "concat_ws('|', f_brand, f_item_type, f_mpn, f_voltage, f_dimensions, f_mounting, f_material, f_series, f_mfr_url)"
_inv = strip("invoice_desc")
cte(
    "flagged",
    f"SELECT _ordinal, part_key, Mfg_Part_Num, confidence, length({_inv}) <= 40 AND {_inv} = upper({_inv}) AND NOT {has(f'lower({_inv})', '-- unbranded --|-- no unilog brand --|n/a|tbd')} AS invoice_ok, NOT {has(f'lower({_fin})', '120v|24in|15a')} AS uom_ok, "
    rf"NOT coalesce(regexp_matches(f_dimensions, '\.25 in|\.5 in|\.75 in|\.125 in'), false) AS fraction_ok FROM enriched WHERE Mfg_Part_Num <> ''",
)
cte(
    "truth_fields",
    f"SELECT o._ordinal, count(*) FILTER (t.value <> '') AS field_total, count_if(t.value <> '' AND {_loose('t.value')} = {_loose('o.value')})::BIGINT AS field_matches, "
    f"bool_or({_loose('t.value')} = {_loose('o.value')}) FILTER (t.field = 'BRAND_NAME') AS brand_ok, "
    f"max(t.value) FILTER (t.field = 'Product Name') AS tp, max(t.value) FILTER (t.field = 'Fine') AS tf, max(o.value) FILTER (t.field = 'Product Name') AS op FROM cells o JOIN truth_last t ON t.gkey = o.part_key AND t.i = o.i WHERE o.part_key <> '' GROUP BY 1",
)
cte(
    "truth_slots",
    f"SELECT o._ordinal AS own, t._ordinal, {_slot_no} AS slot, max(t.value) FILTER (t.field LIKE 'ATTRIBUTE_LABEL%') AS label, max(t.value) FILTER (t.field LIKE 'ATTRIBUTE_VALUE%') AS value FROM flagged o JOIN truth_last t ON t.gkey = o.part_key WHERE t.field LIKE 'ATTRIBUTE%' GROUP BY ALL",
)
cte("truth_labels", f"SELECT own, count(*) AS attribute_total, count_if(matched)::BIGINT AS attribute_matches FROM ({label_match('truth_slots', 'g.own')}) GROUP BY 1")
_tc = "coalesce(nullif(tp, ''), tf)"
cte(
    "scored_rows",
    f"SELECT f._ordinal, t._ordinal IS NOT NULL AS has_truth, invoice_ok, uom_ok, fraction_ok, confidence, brand_ok, CASE WHEN t._ordinal IS NOT NULL THEN true END AS mpn_ok, {_loose(_tc)} = {_loose('op')} AS category_ok, field_total, field_matches, "
    "part_key = upper(Mfg_Part_Num) AS schema_ok, CASE WHEN t._ordinal IS NOT NULL THEN coalesce(attribute_total, 0) END AS attribute_total, CASE WHEN t._ordinal IS NOT NULL THEN coalesce(attribute_matches, 0) END AS attribute_matches FROM flagged f LEFT JOIN truth_fields t USING (_ordinal) LEFT JOIN truth_labels l ON l.own = f._ordinal",
)
answer("compliance_flags", "SELECT * FROM scored_rows")
_rate = lambda a, b: f"CASE WHEN {b} > 0 THEN round({a} / {b}, 4) END"
_core, _alone = "count_if(has_truth AND brand_ok AND mpn_ok AND category_ok AND invoice_ok AND uom_ok)", "count_if(NOT has_truth AND invoice_ok AND uom_ok AND confidence >= 0.90)"
_card = (
    f"SELECT count(*) AS total_rows, {_ci('has_truth')} AS ground_truth_records, {_core}::BIGINT AS exact_with_truth, {_alone}::BIGINT AS exact_by_rules, {_rate(f'({_core} + {_alone})', 'count(*)')} AS exact_match_rate, {_rate('sum(field_matches)', 'sum(field_total)')} AS field_accuracy, "
    f"{_rate('count_if(category_ok)', 'count_if(has_truth)')} AS category_accuracy, {_rate('count_if(brand_ok)', 'count_if(has_truth)')} AS brand_accuracy, {_rate('count_if(mpn_ok)', 'count_if(has_truth)')} AS mpn_accuracy, {_rate('sum(attribute_matches)', 'sum(attribute_total)')} AS attribute_accuracy, "
    f"{_rate('count_if(schema_ok)', 'count(*)')} AS schema_compliance, {_rate('count_if(uom_ok)', 'count(*)')} AS uom_compliance, {_rate('count_if(fraction_ok)', 'count(*)')} AS fraction_compliance, {_rate('count_if(invoice_ok)', 'count(*)')} AS invoice_compliance, "
    f"{_ci('confidence >= 0.90')} AS high_confidence, {_ci('confidence >= 0.75 AND confidence < 0.90')} AS moderate_confidence, {_ci('confidence < 0.75')} AS low_confidence, round(avg(confidence), 3) AS average_confidence FROM scored_rows"
)
cte("card", _card)
answer("compliance_scorecard", "SELECT * FROM card")
answer("scorecard", "SELECT total_rows, ground_truth_records, exact_match_rate, field_accuracy, brand_accuracy, category_accuracy, attribute_accuracy FROM card")
answer(
    "readiness",
    "WITH m AS (SELECT (SELECT count_if(status = 'SUCCESS') / count(*) * 100 FROM enriched) AS p, (SELECT count_if(source_mode IN ('LIVE_NIM', 'MANUFACTURER_SOURCE')) FROM enriched) AS live, (SELECT round(count_if(is_schema_valid) / count(*) * 100, 2) FROM schema_results) AS s, strict_field_accuracy_pct AS a, normalized_field_accuracy_pct AS b, exact_record_match_rate_pct AS x, normalized_record_match_rate_pct AS y FROM record_totals), "
    "g AS (SELECT *, p >= 99 AS ip, s >= 99 AS sp, a >= 85 AS fo, a >= 50 OR b >= 50 AS fp, x >= 50 OR y >= 50 AS ro, x > 0 OR y > 0 AS rp FROM m) "
    "SELECT 'INPUT_PROCESSING' AS criterion, CASE WHEN ip THEN 'PASS' ELSE 'FAIL' END AS status FROM g UNION ALL SELECT 'SCHEMA_COMPLIANCE', CASE WHEN sp THEN 'PASS' ELSE 'FAIL' END FROM g "
    "UNION ALL SELECT 'NEMOTRON_LLM', CASE WHEN live > 0 THEN 'PASS' ELSE 'CONDITIONALLY_PASS' END FROM g UNION ALL SELECT 'GROUND_TRUTH_FIELD_ACCURACY', CASE WHEN fo THEN 'PASS' WHEN fp THEN 'CONDITIONALLY_PASS' ELSE 'FAIL' END FROM g "
    "UNION ALL SELECT 'GROUND_TRUTH_RECORD_ACCURACY', CASE WHEN ro THEN 'PASS' WHEN rp THEN 'CONDITIONALLY_PASS' ELSE 'FAIL' END FROM g "
    "UNION ALL SELECT 'OVERALL', CASE WHEN ip AND sp AND fo AND ro AND live > 0 THEN 'PRODUCTION_READY' WHEN ip AND sp AND fp THEN 'CONDITIONALLY_READY' ELSE 'NOT_READY' END FROM g",
)
answer("predictions_hash", f"SELECT {_print(['part_key', 'invoice_desc', 'mobile_desc', 'long_desc', 'source_mode'])} FROM enriched")
_rt = lambda x: f"round(count_if({x}) / count(*), 4)"
answer(
    "telemetry_snapshot",
    f"SELECT stage, {_pctl('processing_time_ms', '0.95')} AS p95_ms, count(*) AS count, round(avg(processing_time_ms), 2) AS avg_ms, round(min(processing_time_ms), 2) AS min_ms, round(max(processing_time_ms), 2) AS max_ms, {_rt('cache_hit')} AS cache_hit_rate, {_rt(_fall)} AS fallback_rate, {_rt('review_required')} AS hitl_rate, {_rt('NOT schema_valid')} AS schema_failure_rate FROM tracking GROUP BY 1",
)
answer("failure_log", "SELECT batch_id, coalesce(llm_error, 'Max retries exceeded') AS error, count(*) AS failures, sum(retry_count)::BIGINT AS retries, min(mfg_part_num) AS first_part FROM tracking WHERE status = 'ERROR' GROUP BY ALL")

# ------------------------------------------------------------------ windows, listings, sets

answer("duplicate_flags", "SELECT _ordinal, Mfg_Part_Num, row_number() OVER (PARTITION BY Mfg_Part_Num ORDER BY _ordinal) > 1 AS dup_first, count(*) OVER (PARTITION BY Mfg_Part_Num) > 1 AS dup_all FROM feed WHERE Mfg_Part_Num <> ''")
answer(
    "product_upsert",
    "WITH r AS (SELECT _ordinal, Mfg_Part_Num AS mpn, Part_Manuf AS brand FROM feed WHERE Mfg_Part_Num <> ''), st AS (SELECT mpn, brand, min(_ordinal) AS _ordinal FROM r WHERE _ordinal % 3 = 0 GROUP BY ALL) "
    "SELECT _ordinal, mpn, brand, 'existing' AS origin FROM st UNION ALL SELECT min(_ordinal), mpn, brand, 'created' FROM r WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.mpn = r.mpn AND st.brand = r.brand) GROUP BY mpn, brand",
)
answer("product_listing", "SELECT _ordinal, Mfg_Part_Num AS mfg_part_num, 'review_required' AS status FROM enriched WHERE needs_review ORDER BY _ordinal DESC LIMIT 30 OFFSET 20")
cte("fetches", "SELECT ek, brand, mpn, http_status, ek AS src FROM evidence UNION ALL SELECT ek + 1000000, brand, mpn, 304, ek FROM evidence WHERE ek % 2 = 0")
cte("newest_fetch", "SELECT brand, mpn, arg_max(http_status, ek) AS http_status, max(ek) AS _evidence_ordinal, arg_max(src, ek) AS src FROM fetches GROUP BY 1, 2")
answer("source_upsert", "SELECT brand, mpn, http_status, _evidence_ordinal FROM newest_fetch")
answer("source_evidences", "SELECT brand, mpn, spec_key, evidence AS raw_snippet, value AS extracted_value, 1.0::DOUBLE AS confidence FROM newest_fetch JOIN snippets ON ek = src")
answer(
    "latest_benchmark",
    "SELECT batch_id, row_index, mfg_part_num FROM tracking WHERE status = 'ERROR' AND batch_id = (SELECT arg_max(batch_id, (m, batch_id)) FROM (SELECT batch_id, max(ts) AS m FROM tracking GROUP BY 1))",
)
answer(
    "benchmark_runs",
    "SELECT (row_number() OVER (ORDER BY m DESC, batch_id DESC))::INT AS position, batch_id, strftime(m, '%Y-%m-%d %H:%M:%S') AS created_at, total_rows, failed_rows, avg_confidence FROM "
    "(SELECT batch_id, max(ts) AS m, count(*) AS total_rows, count_if(status = 'ERROR')::BIGINT AS failed_rows, round(avg(confidence), 6) AS avg_confidence FROM tracking GROUP BY 1)",
)
answer("latest_run", "SELECT client, ts, row_index, source_mode, confidence FROM tracking QUALIFY row_number() OVER (PARTITION BY client ORDER BY ts DESC, row_index DESC) = 1")
answer("review_current", "SELECT * EXCLUDE (created_at, product_id) FROM review_state")
answer("pending_queue", "SELECT review_id, confidence, status FROM review_state WHERE status = 'PENDING' ORDER BY confidence, created_at DESC, review_id LIMIT 50 OFFSET 10")
cte("audit", f"SELECT action_id AS audit_id, 'HITL_REVIEW_' || {_status} AS event_type, 'REVIEW_QUEUE' AS entity_type, review_id::STRING AS entity_id, coalesce(reviewer, 'catalog_specialist') AS reviewer, {_status} AS decision, new_value, ts FROM review_actions")
answer("review_audit", "SELECT * FROM audit")
answer("audit_trail", "SELECT * FROM audit WHERE entity_id = '7'")
answer("page", "SELECT row_index, stage, confidence FROM tracking ORDER BY row_index LIMIT 100 OFFSET 200")
answer(
    "rolling_failure_rate",
    "SELECT row_index, client, outcomes, round(rate, 6) AS failure_rate, outcomes = 10 AND rate >= 0.5 AS tripped FROM (SELECT row_index, client, count(*) OVER w AS outcomes, avg((status = 'ERROR')::INT) OVER w AS rate FROM tracking WINDOW w AS (PARTITION BY client ORDER BY ts, row_index ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))",
)
_win = lambda iv: f"count(*) OVER (PARTITION BY client ORDER BY ts RANGE BETWEEN INTERVAL '{iv}' PRECEDING AND CURRENT ROW)"
answer("rate_window", f"SELECT row_index, client, {_win('60 seconds')} AS requests_in_window, {_win('60 seconds')} > 120 AS over_limit FROM tracking")
answer("rate_window_wide", f"SELECT row_index, client, {_win('6 hours')} AS requests_in_window FROM tracking")
_prog = "batch_id, count(*) AS total_items, count_if(status = 'SUCCESS')::BIGINT AS processed_items"
answer("progress", f"SELECT {_prog}, round(count_if(status = 'SUCCESS') / count(*) * 100, 1) AS progress_pct, count_if(confidence >= 0.90)::BIGINT AS high_confidence_count, count_if(confidence < 0.90)::BIGINT AS review_needed_count FROM tracking GROUP BY 1")
answer(
    "key_sets",
    "SELECT CASE status WHEN 'matched' THEN 'both' WHEN 'input_only' THEN 'left' ELSE 'right' END AS part, match_key FROM key_status",
)
_one_row = ("dataset_profile", "schema_metrics", "source_metrics", "confidence_metrics", "golden_metrics")
_many = {
    "schema_validation_results": "SELECT 1 FROM schema_results", "golden_comparison": "SELECT 1 FROM comparison", "error_analysis": "SELECT 1 FROM errors",
    "field_metrics": "SELECT field_name FROM comparison GROUP BY 1 HAVING count_if(comparison_type <> 'EXPECTED_EMPTY') > 0",
}
answer(
    "evaluation_artifacts",
    " UNION ALL ".join([*[f"SELECT 'r1' AS run_id, '{n}' AS artifact, 1::BIGINT AS rows" for n in _one_row], *[f"SELECT 'r1', '{n}', count(*) FROM ({sql})" for n, sql in _many.items()]]),
)
answer("error_union", "SELECT error_category, field, actual, count(*) AS errors FROM errors GROUP BY ALL")

# ------------------------------------------------------------------ streams and whole runs

answer("enrich_stream", "SELECT _ordinal, brand, category, source_mode, confidence, invoice_desc, needs_review FROM enriched")
answer(
    "telemetry_windows",
    "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, stage, count(*) AS records, sum(processing_time_ms::DECIMAL(12, 2))::DOUBLE AS total_ms, max(processing_time_ms::DECIMAL(12, 2))::DOUBLE AS max_ms, count_if(status = 'ERROR')::BIGINT AS failures "
    "FROM (SELECT *, date_trunc('hour', ts) AS w FROM tracking) GROUP BY w, stage",
)
answer(
    "telemetry_sliding",
    "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, stage, count(*) AS records, sum(processing_time_ms::DECIMAL(12, 2))::DOUBLE AS total_ms, max(processing_time_ms::DECIMAL(12, 2))::DOUBLE AS max_ms, count_if(status = 'ERROR')::BIGINT AS failures "
    "FROM (SELECT *, time_bucket(INTERVAL '30 minutes', ts) - to_minutes(30 * unnest([0, 1, 2, 3])) AS w FROM tracking) GROUP BY w, stage",
)
answer(
    "review_state_stream",
    f"SELECT review_id, action_id, 'HITL_REVIEW_' || {_status} AS event_type, {_status} AS status, last_value(new_value IGNORE NULLS) OVER w AS current_value, coalesce(reviewer, 'catalog_specialist') AS reviewer, row_number() OVER w AS sequence FROM review_actions WINDOW w AS (PARTITION BY review_id ORDER BY ts, action_id ROWS UNBOUNDED PRECEDING)",
)
_v = lambda n: f"nullif(list_filter(raw_specs, lambda s: s.k = {q(n)})[1].v, '')"
cte(
    "fact_cols",
    f"SELECT _ordinal, {strip('coalesce(nullif(brand, ' + q('') + '), ' + q('Unbranded') + ')')} AS b, coalesce(nullif(f_item_type, ''), 'Product') AS t, {_v('Series')} AS ser, {_v('With')} AS wi, nullif(f_mounting, '') AS mo, {_v('Number of Wash Cycles')} AS cy, nullif(f_voltage, '') AS vo, {_v('Amperage')} AS am, nullif(f_dimensions, '') AS sz, "
    f"{_v('DepthWithDoorOpen')} AS dp, {_v('Minimum Height')} AS mi, {_v('SoundLevel')} AS so, nullif(f_material, '') AS ma, {_v('Color')} AS co, {_v('Warranty')} AS ad, {strip('coalesce(Mfg_Part_Num, ' + q('') + ')')} AS m FROM enriched",
)
_tail = "coalesce(', ' || mo || ' Mounting', '') || coalesce(', ' || cy || '-Wash Cycle', '') || coalesce(', ' || ma, '') || coalesce(', ' || co, '')"
_st2 = "CASE WHEN contains(lower(ma), 'stainless') THEN 'SST' END"
_ew = lambda x, w, t: f"CASE WHEN ends_with({x}, '{w}') THEN {x} ELSE {x} || '{t}' END"
_cw = lambda x, w, t: f"CASE WHEN contains({x}, '{w}') THEN {x} ELSE {x} || '{t}' END"
answer(
    "channel_descriptions_v2",
    "SELECT _ordinal, substr(concat_ws(', ', nullif(b, ''), t, ser, nullif(m, ''), mo || ' Mounting'), 1, 80) AS mobile_desc, "
    f"substr(concat_ws(' ', upper(t), CASE WHEN contains(lower(mo), 'built') THEN 'BLTLN' ELSE upper(mo) END, {_st2}, {_st2}, vo || 'V', am || 'A', so || 'DBA'), 1, 40) AS invoice_desc, "
    f"{strip('b || coalesce(' + q(' ') + ' || ser, ' + q('') + ') || ' + q(' ') + ' || m || ' + q(' ') + ' || t || coalesce(' + q(' ') + ' || wi, ' + q('') + ') || ' + _tail)} AS short_desc, "
    f"concat_ws(', ', b || ' ' || t || coalesce(' ' || wi, ''), ser, {_ew('cy', 'Cycles', ' Wash Cycles')}, {_ew('vo', 'V', ' V')}, {_ew('am', 'A', ' A')}, mo || ' Mounting', sz, {_cw('dp', 'Depth', ' in Depth With Door Open')}, {_cw('mi', 'Height', ' Minimum Height')}, {_cw('so', 'Sound', ' dBA Sound Level')}, ma, co, 'Additional Information: ' || ad) AS long_desc1, "
    f"{strip('concat_ws(' + q(' ') + ', ser, t) || ' + _tail)} AS retail_desc, '' AS marketing_description FROM fact_cols",
)
# the log of a client is the list of its admitted times, carried along its requests in order
_kept = "list_filter(acc.log, lambda t: t >= x.t - 21600000000)"
_step = (
    f"{{'t': x.t, 'id': x.id, 'log': CASE WHEN len({_kept}) < 2 THEN list_append({_kept}, x.t) ELSE {_kept} END, "
    f"'out': list_append(acc.out, {{'id': x.id, 'ok': len({_kept}) < 2, 'n': least(len({_kept}) + 1, 2)}})}}"
)
answer(
    "rate_admission",
    "SELECT client, r.id AS event_id, r.ok AS admitted, r.n::INT AS in_window FROM (SELECT client, unnest(list_reduce(list_prepend("
    "{'t': 0::BIGINT, 'id': 0::BIGINT, 'log': []::BIGINT[], 'out': []::STRUCT(id BIGINT, ok BOOLEAN, n BIGINT)[]}, "
    f"list({{'t': epoch_us(ts), 'id': row_index, 'log': []::BIGINT[], 'out': []::STRUCT(id BIGINT, ok BOOLEAN, n BIGINT)[]}} ORDER BY ts, row_index)), lambda acc, x: {_step}).out) AS r "
    "FROM tracking GROUP BY client)",
)
answer("progress_stream", f"SELECT {_prog}, count_if(confidence >= 0.90)::BIGINT AS high_confidence_count FROM tracking GROUP BY 1")
answer("ingest_dedup_stream", "SELECT DISTINCT upper(Mfg_Part_Num) AS mpn_key FROM feed WHERE Mfg_Part_Num <> ''")
answer(
    "guardrails",
    f"SELECT _ordinal, cleaned, spaced, fractions, {compress('fractions')} AS invoice FROM (SELECT *, {fractions('spaced')} AS fractions FROM (SELECT _ordinal, cleaned, {space_units('cleaned')} AS spaced FROM (SELECT _ordinal, coalesce(t, Part_Desc) AS cleaned FROM descs)))",
)
answer(
    "enrich",
    "SELECT _ordinal, status, brand, manufacturer, category, source_mode, f_item_type AS item_type, f_mpn AS mpn, f_voltage AS voltage, f_dimensions AS dimensions, f_mounting AS mounting, f_material AS material, f_series AS series, f_mfr_url AS mfr_url, invoice_desc, mobile_desc, confidence, review_tier, needs_review FROM enriched",
)
answer(
    "evaluate",
    f"WITH c AS ({conf_metrics('enriched', 'needs_review')}), s AS ({_schema}), u AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS metric, {n}::DOUBLE AS value FROM record_totals" for n in ("golden_records_evaluated", "strict_field_accuracy_pct", "normalized_field_accuracy_pct", "mismatches"))
    + " UNION ALL " + " UNION ALL ".join(f"SELECT '{n}', {n}::DOUBLE FROM c" for n in ("records", "average_confidence", "median_confidence", "hitl_rate_pct"))
    + " UNION ALL " + " UNION ALL ".join(f"SELECT '{n}', {n}::DOUBLE FROM s" for n in ("schema_pass_count", "schema_pass_rate_pct")) + ") SELECT * FROM u",
)
