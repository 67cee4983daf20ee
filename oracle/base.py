"""SQL building blocks: scalar expressions as text, and common table expressions by name."""

from __future__ import annotations

import re

from partloom import vocab as V
from partloom.functions import extract as X
from partloom.plans import feeds

D = V.DEFAULT
WS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return ", ".join(q(i) for i in items)


def strip(e):
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def squish(e):
    return f"trim(regexp_replace({e}, '{WS}+', ' ', 'g'))"


def has(e, rx):
    return f"regexp_matches({e}, {q(rx)})"


def grab(e, rx, group=1):
    return f"regexp_extract({e}, {q(rx)}, {group})"


def filled(e):
    return f"nullif({e}, '')"


SUPPLIER = rf"(?i){WS}*\({WS}*(?:\d{{3,6}}|[A-Z]{{3,6}}){WS}*\)"
NOISE = (
    rf"(?i)--{WS}*(?:Unbranded|No{WS}+Unilog{WS}+Brand|No{WS}+DIB{WS}+Brand|Unassigned|Not{WS}+Applicable"
    rf"|N/A|TBD|Unknown|None|Null){WS}*--|\[(?:placeholder|tbd|unknown|n/a)\]|\b(?:TBD|N/A|None|Null|Unknown|\?\?\?)\b"
)


def clean(e):
    x = squish(f"regexp_replace(regexp_replace({e}, {q(SUPPLIER)}, ' ', 'g'), {q(NOISE)}, ' ', 'g')")
    return f"CASE WHEN lower({x}) IN ({words(V.NULL_WORDS)}) THEN NULL ELSE {x} END"


def sanitize(e):
    return f"CASE WHEN lower({strip(e)}) IN ({words(V.FIELD_PLACEHOLDERS)}) THEN NULL ELSE {strip(e)} END"


def clean_cell(e):
    s = strip(f"coalesce({e}, '')")
    return f"CASE WHEN lower({s}) IN ({words(V.EMPTY_WORDS)}) THEN '' ELSE {s} END"


UNIT_SPELLINGS = [
    ("in", r"in(?:ches|ch)?"), ("ft", r"(?:ft|feet|foot)"), ("V", r"v(?:olts?)?"), ("A", r"a(?:mps?|mperage)?"),
    ("W", r"w(?:atts?)?"), ("Hz", "hz"), ("RPM", "rpm"), ("dBA", "dba?"), ("mm", "mm"), ("cm", "cm"), ("m", "m"),
    ("lb", "lbs?"), ("oz", "oz"), ("PK", "pk"), ("PC", "pc"), ("EA", "ea"),
]


def space_units(e):
    """A replacement per unit: RE2 has no look-behind, so the digit is captured and put back."""
    for standard, rx in UNIT_SPELLINGS:
        e = f"regexp_replace({e}, {q(rf'(?i)([0-9]){WS}*{rx}' + chr(92) + 'b')}, {q(chr(92) + '1 ' + standard)}, 'g')"
    for standard, mark in (("in", '"'), ("ft", "'")):
        rx = rf"([0-9]){WS}*{mark}(\w|{WS}|$)"
        e = f"regexp_replace({e}, {q(rx)}, {q(chr(92) + '1 ' + standard + chr(92) + '2')}, 'g')"
    return f"coalesce({squish(e)}, '')"


def fractions(e):
    """Split around the decimals; what follows each decides whether it is a measurement."""
    num = r"[0-9]*\.[0-9]+"
    part = "try_cast('0.' || regexp_extract(tok, '[.]([0-9]+)$', 1) AS DOUBLE)"
    arms = " ".join(f"WHEN abs({v!r}::DOUBLE - round({part}, 5)) < 0.005::DOUBLE THEN {q(t)}" for v, t in D.fractions.items())
    whole = "regexp_replace(regexp_extract(tok, '^([0-9]*)', 1), '^0+', '')"
    frac = f"(CASE {arms} END)"
    value = f"(CASE WHEN {frac} IS NULL THEN tok WHEN {whole} <> '' THEN {whole} || '-' || {frac} ELSE {frac} END)"
    measured = "(nxt = '' OR regexp_matches(nxt, '^[^0-9A-Za-z_]') OR regexp_matches(nxt, '(?i)^(in|ft|mm|cm|x)'))"
    gaps, toks = f"regexp_split_to_array({e}, {q(num)})", f"regexp_extract_all({e}, {q(num)})"
    pick = f"CASE WHEN {measured} THEN {value} ELSE tok END".replace("nxt", f"({gaps})[i + 1]")
    pieces = f"list_transform({toks}, lambda tok, i: ({gaps})[i] || {pick})"
    joined = f"array_to_string({pieces}, '') || ({gaps})[-1]"
    return f"coalesce({squish(joined)}, '')"


def compress(e):
    base = f"upper({squish(f'coalesce({clean(e)}, {e})')})"
    for term, short in V.INVOICE_ALWAYS:
        base = f"replace({base}, {q(term)}, {q(short)})"
    steps = ", ".join(f"{{'t': {q(t)}, 's': {q(s)}}}" for t, s in V.INVOICE_WHILE_LONG)
    fold = f"list_reduce([{steps}], lambda acc, x: CASE WHEN length(acc) <= 40 THEN acc ELSE trim(replace(acc, x.t, x.s)) END, {base})"
    return (
        f"coalesce(list_transform([{fold}], lambda t: CASE WHEN length(t) <= 40 THEN t "
        f"ELSE rtrim(regexp_replace(substr(t, 1, 40), ' [^ ]*$', '')) END)[1], '')"
    )


def rules(e, table, default="NULL"):
    arms = " ".join(f"WHEN {has(e, '(?i)' + rx)} THEN {q(label)}" for label, rx in table)
    return f"CASE {arms} ELSE {default} END"


def capture(e, rx, suffix="", prefix="", group=1):
    return f"CASE WHEN {has(e, rx)} THEN {q(prefix)} || {grab(e, rx, group)} || {q(suffix)} END"


def measured_dimensions(e):
    return f"CASE WHEN {has(e, X.DIMENSIONS)} THEN {space_units(strip(grab(e, X.DIMENSIONS)))} END"


def dimensions(e):
    plain = f"CASE WHEN {has(e, X.PLAIN_DIMENSIONS)} THEN {space_units(strip(grab(e, X.PLAIN_DIMENSIONS)))} END"
    return f"coalesce({measured_dimensions(e)}, {plain})"


def table(name, columns, rows):
    def cell(v):
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return "[" + ", ".join(cell(x) for x in v) + "]"
        return q(v) if isinstance(v, str) else repr(v)

    body = ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS {name}_rows({', '.join(columns)})"


def share(a, b, digits=2):
    return f"round(({a}) / greatest(({b}), 1) * 100, {digits})"


CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def query(sql: str, replaced: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the named tables it uses, in the order they were defined."""
    tables = {**CTES, **(replaced or {})}
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in set(re.findall(r"[a-z_][a-z_0-9]*", text)) & tables.keys():
            if name not in needed:
                needed.add(name)
                todo.append(tables[name])
    parts = [f"{n} AS MATERIALIZED ({tables[n]})" for n in tables if n in needed]
    if parts and sql.startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + sql[len("WITH "):]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql


# ------------------------------------------------------------------ fixtures

cte(
    "base",
    "SELECT p_partkey AS k, p_name, p_brand, p_size, s_name FROM part LEFT JOIN "
    "supplier ON p_partkey % (SELECT count(*) FROM supplier) = s_suppkey % (SELECT count(*) FROM supplier)",
)
cte("feed", "SELECT k AS _ordinal, " + ", ".join(f"{sql} AS {n}" for n, sql in feeds.FEED_SQL.items()) + " FROM base")

cte("no_reference", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 1 AND l_returnflag = 'R'")
_sections = ", ".join(f"{{'k': {q(n)}, 'v': {sql}}}" for n, sql in feeds.SECTION_SQL.items())
cte(
    "evidence",
    f"SELECT k AS ek, {feeds.EVIDENCE_BRAND_SQL} AS brand, Mfg_Part_Num AS mpn, "
    "'https://www.frigidaire.com/p/' || lower(Mfg_Part_Num) AS source_url, "
    "CASE WHEN k % 4 = 3 THEN 404 ELSE 200 END AS http_status, "
    f"{feeds.EVIDENCE_TEXT_SQL} AS text, "
    f"list_filter([{_sections}], lambda s: s.v IS NOT NULL) AS sections "
    "FROM (SELECT _ordinal AS k, Mfg_Part_Num FROM feed) WHERE Mfg_Part_Num <> '' AND k IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)",
)
cte(
    "model_output",
    f"SELECT k, Mfg_Part_Num AS mpn, {feeds.MODEL_SQL} AS content "
    "FROM (SELECT _ordinal AS k, Mfg_Part_Num FROM feed) WHERE Mfg_Part_Num <> ''",
)
cte("tracking", "SELECT " + ", ".join(f"{sql} AS {n}" for n, sql in feeds.TRACKING_SQL.items()) + " FROM events")
cte("review_actions", "SELECT " + ", ".join(f"{sql} AS {n}" for n, sql in feeds.REVIEW_ACTION_SQL.items()) + " FROM events")
cte(
    "review_queue",
    "SELECT c_custkey AS review_id, c_custkey AS product_id, 'INVOICE ' || c_name AS suggested_value, "
    "(c_custkey % 90) / 100.0::DOUBLE AS confidence, "
    "TIMESTAMP '2023-12-01 00:00:00' + to_minutes(CAST(c_custkey % 5000 AS INT)) AS created_at FROM customer",
)

# ------------------------------------------------------------------ snippets

_line = "list_filter(list_transform(CASE WHEN contains(text, chr(10)) THEN string_split(text, chr(10)) ELSE string_split(text, '.') END, lambda s: {s}), lambda s: length(s) >= 3)"


def lines_of(source: str, trim=strip) -> str:
    return f"SELECT ek, {_line.format(s=trim('s'))} AS lines FROM {source}"


cte("ev_lines", lines_of("evidence"))
_markers = {
    "voltage": (r"voltage|120v|120 v|240v|240 v", "CASE WHEN {m} THEN {g} ELSE substr(s, 1, 40) END", r"(?i)(\b\d+(?:/\d+)?\s*(?:v(?:olt)?s?|kv)\b)"),
    "amperage": (r"amp|current|\b\d+\s*a\b", "CASE WHEN {m} THEN {g} ELSE substr(s, 1, 40) END", r"(?i)(\b\d+(?:\.\d+)?\s*(?:a(?:mp)?s?|ma)\b)"),
    "material": (r"material|stainless steel|carbide|aluminum", "CASE WHEN contains(lower(s), 'stainless') THEN 'Stainless Steel' ELSE substr(s, 1, 40) END", ""),
    "dimensions": (r"dimension|width|depth|diameter", "substr(s, 1, 60)", ""),
    "mounting": (r"mounting|built-in|freestanding|wall mount", "CASE WHEN contains(lower(s), 'built-in') THEN 'Built-In' ELSE substr(s, 1, 40) END", ""),
}


def snippets_of(lines: str, markers=_markers, lower="lower({})") -> str:
    lx, ls = lower.format("x"), lower.format("s")
    return " UNION ALL ".join(
        f"SELECT ek, {q(n)} AS spec_key, {(v.format(m=has('s', rx), g=grab('s', rx)) if rx else v).replace('lower(s)', ls)} AS value, substr(s, 1, 160) AS evidence "
        f"FROM (SELECT ek, list_filter(lines, lambda x: regexp_matches({lx}, {q(mk)}))[1] AS s FROM {lines}) WHERE s IS NOT NULL"
        for n, (mk, v, rx) in markers.items()
    )


cte("snippets", snippets_of("ev_lines"))
cte(
    "ev_wide",
    "SELECT e.*, " + ", ".join(f"max(s.value) FILTER (s.spec_key = {q(n)}) AS sn_{n}, max(s.evidence) FILTER (s.spec_key = {q(n)}) AS se_{n}" for n in _markers)
    + " FROM evidence e LEFT JOIN snippets s USING (ek) GROUP BY ALL",
)

# ------------------------------------------------------------------ brands

cte("alias_rows", table("alias", ["ord", "alias", "brand", "pattern"], [(i, a, b, r"\b" + re.escape(a) + r"\b") for i, (a, b) in enumerate(D.aliases.items())]))
cte("prefix_rows", table("prefix", ["prefix", "brand"], list(D.prefixes.items())))


def _norm(name):
    return re.sub(r"[\W_]", " ", name.lower()).strip()


cte(
    "brand_rows",
    table("brand", ["rnk", "norm", "toks", "ordered", "brand"],
          [(i, _norm(n), sorted(_norm(n).split()), " ".join(sorted(_norm(n).split())), n) for i, n in enumerate(D.canonical)]),
)
cte("maker_rows", table("maker", ["brand_key", "maker"], list(D.manufacturers.items())))
cte("domain_rows", table("domain", ["brand_key", "domain"], [(n.replace("®", "").replace("™", "").lower(), d) for n, d in D.domains.items()]))


def distributor(e):
    return f"coalesce(regexp_matches(lower({strip(e)}), {q('|'.join(re.escape(t) for t in D.distributors))}), false)"


_named = ", ".join(
    f"CASE WHEN {strip(c)} NOT IN ({words(V.BRAND_PLACEHOLDERS)}) THEN {filled(c)} END" for c in V.BRAND_DEFAULTS
)
cte(
    "cleaned",
    f"SELECT *, coalesce({_named}) AS raw_brand, "
    f"CASE WHEN {strip('Mfg_Part_Num')} = '' AND {strip('Part_Desc')} = '' THEN 'ERROR' ELSE 'SUCCESS' END AS status, "
    f"coalesce({clean('Part_Desc')}, Part_Desc) AS desc_clean, {clean('Part_Manuf')} AS manuf_clean FROM feed",
)
cte("cleaned2", f"SELECT *, {clean('raw_brand')} AS brand_clean FROM cleaned")
cte(
    "texts",
    "SELECT DISTINCT t FROM (SELECT desc_clean AS t FROM cleaned2 UNION ALL SELECT brand_clean FROM cleaned2 "
    f"UNION ALL SELECT manuf_clean FROM cleaned2) WHERE {strip('t')} <> ''",
)
cte(
    "known_texts",
    f"SELECT t, max(a.brand) FILTER (a.alias = lower({strip('t')})) AS exact_brand, "
    f"arg_min(a.brand, a.ord) FILTER (length(a.alias) >= 4 AND regexp_matches(lower({strip('t')}), a.pattern)) AS held_brand "
    "FROM texts CROSS JOIN alias_rows a GROUP BY t",
)
cte(
    "fuzzy_texts",
    "SELECT t, x AS query, list_sort(list_filter(string_split_regex(x, ' +'), lambda w: w <> '')) AS toks FROM "
    r"(SELECT t, trim(regexp_replace(lower(t), '[^\p{L}\p{N}]', ' ', 'g')) AS x FROM known_texts WHERE exact_brand IS NULL AND held_brand IS NULL) WHERE x <> ''",
)
_ratio = lambda a, b: f"(1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}), 1))"
_scale = "(CASE WHEN lng <= sht * 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END)"
cte(
    "scored_texts",
    f"SELECT t, brand, rnk, CASE WHEN lng < sht * 1.5 THEN greatest({_ratio('query', 'norm')}, "
    f"0.95::DOUBLE * (CASE WHEN list_has_all(toks, btoks) OR list_has_all(btoks, toks) THEN 1.0::DOUBLE ELSE {_ratio('array_to_string(toks, chr(32))', 'ordered')} END)) "
    f"WHEN contains(query, norm) OR contains(norm, query) THEN {_scale} WHEN list_has_any(toks, btoks) THEN 0.95::DOUBLE * {_scale} ELSE 0.0::DOUBLE END AS score "
    "FROM (SELECT f.t, f.query, f.toks, b.toks AS btoks, b.norm, b.ordered, b.brand, b.rnk, "
    "greatest(length(query), length(norm)) AS lng, least(length(query), length(norm)) AS sht FROM fuzzy_texts f CROSS JOIN brand_rows b)",
)
cte(
    "brand_match",
    "SELECT k.t, coalesce(k.exact_brand, k.held_brand, s.brand) AS brand, "
    "CASE WHEN k.exact_brand IS NOT NULL THEN 1.0::DOUBLE WHEN k.held_brand IS NOT NULL THEN 0.95::DOUBLE ELSE s.score END AS score "
    "FROM known_texts k LEFT JOIN (SELECT t, arg_max(brand, (score, -rnk)) AS brand, max(score) AS score FROM scored_texts GROUP BY t) s USING (t)",
)
cte(
    "prefixed",
    "SELECT _ordinal, arg_max(p.brand, length(p.prefix)) AS pfx FROM cleaned2 JOIN prefix_rows p "
    f"ON starts_with(lower({strip('Mfg_Part_Num')}), p.prefix) GROUP BY _ordinal",
)
cte(
    "resolved0",
    "SELECT c.*, CASE WHEN p.pfx IS NOT NULL THEN {'b': p.pfx, 's': 1.0::DOUBLE, 'o': 'prefix'} "
    "WHEN d.score >= 0.85 THEN {'b': d.brand, 's': round(d.score, 3), 'o': 'description'} "
    f"WHEN n.score >= 0.80 AND {strip('brand_clean')} NOT IN ({words(V.BRAND_PLACEHOLDERS)}) THEN {{'b': n.brand, 's': round(n.score, 3), 'o': 'brand_column'}} "
    f"WHEN m.score >= 0.80 AND NOT {distributor('manuf_clean')} THEN {{'b': m.brand, 's': round(m.score, 3), 'o': 'manufacturer'}} "
    "ELSE {'b': CASE WHEN brand_clean <> '' AND NOT starts_with(brand_clean, '--') THEN brand_clean ELSE coalesce(manuf_clean, '') END, 's': NULL, 'o': 'fallback'} END AS hit "
    "FROM cleaned2 c LEFT JOIN prefixed p USING (_ordinal) LEFT JOIN brand_match d ON d.t = desc_clean "
    "LEFT JOIN brand_match n ON n.t = brand_clean LEFT JOIN brand_match m ON m.t = manuf_clean",
)
_cat_text = "lower(coalesce(desc_clean, '') || ' ' || coalesce(Mfg_Part_Num, '') || ' ' || coalesce(hit.b, ''))"
cte(
    "resolved",
    "SELECT r.* EXCLUDE (hit), hit.b AS brand, coalesce(maker, " + strip("translate(hit.b, '®™', '')") + ") AS manufacturer, "
    f"coalesce({strip('manuf_clean')}, '') AS supplier, "
    "CASE WHEN hit.o = 'fallback' THEN CASE WHEN hit.b <> '' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END ELSE hit.s END AS brand_score, hit.o AS brand_source, "
    f"{rules(_cat_text, X.CATEGORY_RULES, q(X.DEFAULT_CATEGORY))} AS category "
    f"FROM resolved0 r LEFT JOIN maker_rows ON brand_key = lower({strip('hit.b')})",
)

# ------------------------------------------------------------------ evidence and model reply per row

_plain = lambda e: "upper(" + strip(f"translate({e}, '®™', '')") + ")"
cte("ev_key", f"SELECT *, {_plain('brand')} AS ebrand, upper({strip('mpn')}) AS empn FROM ev_wide")
cte(
    "with_ev",
    "SELECT r.*, coalesce(b.e, p.e) AS ek FROM resolved r "
    "LEFT JOIN (SELECT ebrand, empn, min(ek) AS e FROM ev_key GROUP BY ALL) b "
    f"ON b.empn = upper({strip('r.Mfg_Part_Num')}) AND b.ebrand = {_plain('r.brand')} "
    "LEFT JOIN (SELECT empn, min(ek) AS e FROM ev_key GROUP BY ALL) p "
    f"ON p.empn = upper({strip('r.Mfg_Part_Num')})",
)
cte("reply_one", f"SELECT upper({strip('mpn')}) AS rm, min(content) AS content FROM model_output GROUP BY 1")
_fenced, _braces = r"(?s)```(?:json)?\s*(\{.*?\})\s*```", r"(?s)(\{.*\})"


def reply_json(e):
    return f"CASE WHEN {has(e, _fenced)} THEN {grab(e, _fenced)} WHEN {has(e, _braces)} THEN {grab(e, _braces)} ELSE {strip(e)} END"


cte("reply", f"SELECT rm, CASE WHEN json_valid(j) AND starts_with(j, '{{') THEN j END AS j FROM (SELECT rm, {reply_json('content')} AS j FROM reply_one)")


def sect(name):
    return f"list_filter(sections, lambda s: s.k = {q(name)})[1].v"


def with_unit(value, unit, *bare):
    x = value
    for b in bare or (unit,):
        x = f"replace({x}, {q(b)}, '')"
    return f"CASE WHEN ends_with({value}, {q(' ' + unit)}) THEN {value} ELSE {strip(x)} || {q(' ' + unit)} END"


_t = "coalesce(desc_clean, '')"
_mount = f"coalesce({sect('Mounting Type')}, sn_mounting)"
cte(
    "tech",
    "SELECT w.*, e.source_url, e.http_status, e.sections, " + ", ".join(f"e.sn_{n}, e.se_{n}" for n in _markers) + ", r.j, "
    f"CASE WHEN contains(lower(category), 'dishwasher') OR contains(lower({_t}), 'dishwasher') THEN 'Dishwasher' END AS t_item_type, "
    f"coalesce({with_unit(sect('Voltage Rating'), 'V')}, sn_voltage, {capture(_t, X.VOLTAGE, ' V')}) AS t_voltage, "
    f"coalesce({with_unit(sect('Amperage Rating'), 'A')}, sn_amperage, {capture(_t, X.AMPERAGE_DECIMAL, ' A')}) AS t_amperage, "
    f"coalesce({with_unit(sect('Sound Level'), 'dBA', 'dBA', 'dB')}, {capture(_t, X.SOUND_LEVEL, ' dBA')}) AS t_sound, "
    f"coalesce({sect('Size')}, {sect('Width')} || ' W x ' || {sect('Depth')} || ' D', sn_dimensions, {measured_dimensions(_t)}) AS t_dimensions, "
    f"coalesce(CASE WHEN contains(lower({_mount}), 'built') THEN 'Built-In' ELSE {_mount} END, {rules(_t, X.EVIDENCE_MOUNTING_RULES)}) AS t_mounting, "
    f"coalesce({sect('Material')}, {rules(_t, X.MATERIAL_RULES[:1])}) AS t_material, "
    f"{dimensions(_t)} AS h_dimensions "
    "FROM with_ev w LEFT JOIN ev_wide e USING (ek) LEFT JOIN reply r ON r.rm = upper(" + strip("w.Mfg_Part_Num") + ")",
)


def js(name):
    return f"json_extract_string(j, '$.{name}')"


_conn = (
    f"coalesce(CASE WHEN {has(_t, X.PIPE_THREAD)} THEN upper({grab(_t, X.PIPE_THREAD)}) END, "
    f"CASE WHEN {has(_t, X.CONNECTION)} THEN CASE lower({grab(_t, X.CONNECTION)}) "
    "WHEN 'compression' THEN 'Compression' WHEN 'socket weld' THEN 'Socket Weld' WHEN 'push-to-connect' THEN 'Push-To-Connect' "
    "WHEN 'press' THEN 'Press' WHEN 'flanged' THEN 'Flanged' WHEN 'soldered' THEN 'Soldered' ELSE 'Threaded' END END)"
)
_arbor = (
    f"CASE WHEN {has(_t, X.ARBOR)} AND h_dimensions <> '' AND NOT contains(h_dimensions, {grab(_t, X.ARBOR)}) "
    f"THEN {strip('replace(' + grab(_t, X.ARBOR) + ', chr(34), ' + q(' in') + ')')} END"
)
RAW_SPEC_SQL = {
    "FlowRate": capture(_t, X.FLOW_RATE, " GPM"),
    "ConnectionType": _conn,
    "PressureRating": f"coalesce({capture(_t, X.PRESSURE_PSI, ' PSI')}, {capture(_t, X.PRESSURE_LB, ' LB')})",
    "Grit": f"CASE WHEN {has(_t, X.GRIT)} THEN 'P' || {grab(_t, X.GRIT, 1)} || {grab(_t, X.GRIT, 2)} END",
    "ArborSize": _arbor,
    "Finish": rules(_t, X.FINISH_RULES),
    "Amperage": capture(_t, X.AMPERAGE, " A"),
    "SoundLevel": capture(_t, X.SOUND_LEVEL, " dBA"),
    "PackQuantity": capture(_t, X.PACK_QUANTITY, " PK"),
}
HEUR_SPECS = "list_filter([" + ", ".join(f"{{'k': {q(n)}, 'v': {sql}}}" for n, sql in RAW_SPEC_SQL.items()) + "], lambda s: s.v IS NOT NULL)"
cte(
    "extracted0",
    f"SELECT *, {HEUR_SPECS} AS h_specs, "
    "CASE WHEN j IS NOT NULL THEN list_transform(json_keys(j, '$.raw_specs'), lambda n: {'k': n, 'v': json_extract_string(j, '$.raw_specs.\"' || n || '\"')}) END AS m_specs, "
    "list_transform(coalesce(sections, []), lambda s: {'k': s.k, 'v': CASE WHEN s.k = 'Number of Wash Cycles' THEN replace(s.v, '.0', '') ELSE s.v END}) AS listed, "
    f"list_filter([{{'k': 'Amperage', 'v': t_amperage}}, {{'k': 'SoundLevel', 'v': t_sound}}, {{'k': 'DepthWithDoorOpen', 'v': {sect('Depth With Door Open')}}}], lambda s: s.v IS NOT NULL) AS derived "
    "FROM tech",
)


def merge(base, over):
    keep = f"list_transform({base}, lambda s: {{'k': s.k, 'v': CASE WHEN list_contains(list_transform({over}, lambda o: o.k), s.k) THEN list_filter({over}, lambda o: o.k = s.k)[1].v ELSE s.v END}})"
    return f"list_concat({keep}, list_filter({over}, lambda o: NOT list_contains(list_transform({base}, lambda s: s.k), o.k)))"


cte("extracted1", f"SELECT *, {merge('listed', 'derived')} AS tech_specs, CASE WHEN j IS NOT NULL THEN coalesce(m_specs, []) ELSE h_specs END AS base_specs FROM extracted0")


def _pick(name, heur):
    return f"coalesce({filled('t_' + name)}, CASE WHEN j IS NOT NULL THEN {js(name)} ELSE {heur} END) AS a_{name}"


cte(
    "extracted",
    f"SELECT *, {merge('base_specs', 'tech_specs')} AS raw_specs, "
    f"coalesce({filled('brand')}, {js('brand')}) AS a_brand, {_pick('item_type', rules(_t, X.ITEM_TYPE_RULES))}, "
    f"coalesce({filled('Mfg_Part_Num')}, CASE WHEN j IS NOT NULL THEN {js('mpn')} ELSE coalesce({filled(strip('Mfg_Part_Num'))}, {capture(strip(_t), X.LEADING_PART_NUMBER)}) END) AS a_mpn, "
    f"{_pick('voltage', capture(_t, X.VOLTAGE, ' V'))}, {_pick('dimensions', 'h_dimensions')}, {_pick('mounting', rules(_t, X.MOUNTING_RULES))}, "
    f"{_pick('material', rules(_t, X.MATERIAL_RULES))}, {js('series')} AS a_series, {js('mfr_url')} AS a_mfr_url, "
    "CASE WHEN j IS NOT NULL AND http_status = 200 THEN 'MANUFACTURER_SOURCE' WHEN j IS NOT NULL THEN 'LIVE_NIM' ELSE 'OFFLINE_HEURISTIC' END AS mode0 FROM extracted1",
)

# ------------------------------------------------------------------ validation

cte("lov_rows", table("lov", ["category", "field", "lv", "canonical"], [(c, f, v.lower(), v) for c, fs in D.category_lovs.items() for f, vs in fs.items() for v in vs]))
cte("syn_rows", table("syn", ["category", "field", "lv", "canonical"], [(c, f, k, v) for c, fs in D.category_synonyms.items() for f, d in fs.items() for k, v in d.items()]))
cte("required_rows", table("required", ["category", "field"], [(c, f) for c, fs in D.category_required.items() for f in fs]))
LOV_FIELDS = ["item_type", "material", "mounting", "voltage"]
cte("attr_long", " UNION ALL ".join(f"SELECT _ordinal, category, {q(f)} AS field, a_{f} AS raw FROM extracted" for f in LOV_FIELDS))
cte(
    "lov_check",
    f"SELECT a._ordinal, a.category, a.field, a.raw, c AS cleaned, bound, "
    "CASE WHEN NOT bound OR coalesce(raw, '') = '' THEN raw WHEN c IS NULL THEN NULL ELSE coalesce(l.canonical, s.canonical, raw) END AS value, "
    "CASE WHEN NOT bound OR coalesce(raw, '') = '' OR c IS NULL OR l.canonical IS NOT NULL THEN NULL WHEN s.canonical IS NOT NULL THEN 'normalized' ELSE 'rejected' END AS action "
    f"FROM (SELECT *, {clean('raw')} AS c, (category, field) IN (SELECT (category, field) FROM lov_rows) AS bound FROM attr_long) a "
    "LEFT JOIN lov_rows l ON l.category = a.category AND l.field = a.field AND l.lv = lower(c) "
    "LEFT JOIN syn_rows s ON s.category = a.category AND s.field = a.field AND s.lv = lower(c)",
)
cte(
    "final0",
    "SELECT e.*, " + ", ".join(f"n.n_{f}" for f in LOV_FIELDS) + " FROM extracted e JOIN (SELECT _ordinal, "
    + ", ".join(f"max(value) FILTER (field = {q(f)}) AS n_{f}" for f in LOV_FIELDS) + " FROM lov_check GROUP BY 1) n USING (_ordinal)",
)
cte(
    "final",
    "SELECT *, a_brand AS f_brand, n_item_type AS f_item_type, a_mpn AS f_mpn, n_mounting AS f_mounting, n_material AS f_material, "
    f"CASE WHEN n_voltage <> '' THEN {space_units('n_voltage')} ELSE n_voltage END AS f_voltage, "
    f"CASE WHEN a_dimensions <> '' THEN {fractions(space_units('a_dimensions'))} ELSE a_dimensions END AS f_dimensions, a_series AS f_series, a_mfr_url AS f_mfr_url FROM final0",
)
_attr = {f: f"a_{f}" for f in ("brand", "item_type", "mpn", "voltage", "dimensions", "mounting", "material")}
_empty = " ".join(f"WHEN {q(f)} THEN coalesce({strip(c)}, '') = ''" for f, c in _attr.items())
CONFLICTS = ["dimensions", "material", "mounting", "voltage"]
cte(
    "violations",
    "SELECT _ordinal, 1 AS grp, r.field, NULL AS raw_value, 'Required attribute ''' || r.field || ''' is missing for category ''' || f.category || '''' AS reason, 'missing_required' AS action, NULL AS suggestion "
    f"FROM final f JOIN required_rows r ON r.category = f.category WHERE CASE r.field {_empty} ELSE true END "
    "UNION ALL SELECT _ordinal, 2, field, cleaned, CASE WHEN action = 'normalized' THEN 'Value ''' || cleaned || ''' normalized via deterministic synonym rule to ''' || value || '''' "
    "ELSE 'Value ''' || cleaned || ''' is outside allowed vocabulary for ' || category || ' and has no synonym mapping' END, action, CASE WHEN action = 'normalized' THEN value END FROM lov_check WHERE action IS NOT NULL "
    + "".join(
        f"UNION ALL SELECT _ordinal, 3, {q(n)}, f_{n}, 'Extracted value ''' || f_{n} || ''' conflicts with official manufacturer datasheet evidence ''' || sn_{n} || '''', 'evidence_conflict', sn_{n} "
        f"FROM final WHERE contains(sn_{n}, '120') AND contains(f_{n}, '240') AND NOT contains(f_{n}, '120/240') "
        for n in CONFLICTS
    ),
)
cte(
    "flags",
    "SELECT _ordinal, count(v.action) AS n_violations, NOT coalesce(bool_or(action = 'rejected'), false) AS passed_lov, "
    "NOT coalesce(bool_or(action IN ('missing_required', 'evidence_conflict')), false) AS passed_rules, "
    "coalesce(count_if(action IN ('missing_required', 'rejected', 'evidence_conflict')), 0) AS n_reasons FROM final LEFT JOIN violations v USING (_ordinal) GROUP BY 1",
)

# ------------------------------------------------------------------ channel texts

_described = [
    "FlowRate", "ConnectionType", "PressureRating", "Finish", "Grit", "ArborSize", "PackQuantity", "Amperage", "SoundLevel",
    "Series", "Number of Wash Cycles", "DepthWithDoorOpen", "Minimum Height", "Maximum Height", "Color", "With", "Additional Information",
]
_s = {n: "s_" + re.sub(r"\W", "", n.lower()) for n in _described}
cte(
    "described0",
    "SELECT *, " + ", ".join(f"{filled(f'list_filter(raw_specs, lambda s: s.k = {q(n)})[1].v')} AS {c}" for n, c in _s.items()) + ", "
    + ", ".join(f"{filled('f_' + a)} AS x_{a}" for a in ("mounting", "material", "voltage", "dimensions")) + ", "
    f"coalesce({strip(filled('f_item_type'))}, 'Commercial Product') AS kind, "
    f"coalesce({strip('coalesce(nullif(f_brand, ' + q('') + '), nullif(brand, ' + q('') + '))')}, 'UNASSIGNED') AS who, "
    f"{strip('coalesce(' + filled('f_mpn') + ', Mfg_Part_Num)')} AS mpn_text FROM final",
)


def ws(sep, *parts):
    return f"concat_ws({q(sep)}, {', '.join(parts)})"


def unless(e, test, otherwise):
    return f"CASE WHEN {test} THEN {e} ELSE {otherwise} END"


_tight = lambda e: f"upper(replace({e}, ' ', ''))"
_sst = lambda e: f"CASE WHEN contains(lower({e}), 'stainless') THEN 'SST' ELSE upper({e}) END"
_whole = lambda e, other: f"CASE WHEN {e} IS NOT NULL THEN coalesce(CAST(CAST(trunc(try_cast({e} AS DOUBLE)) AS BIGINT) AS STRING), {other}) END"
_cyc = _s["Number of Wash Cycles"]
_machine = ws(
    " ", "CASE WHEN contains(lower(kind), 'dishwasher') THEN 'DISHWASHER' ELSE upper(kind) END",
    "CASE WHEN contains(lower(x_mounting), 'built') THEN 'BLTLN' ELSE upper(x_mounting) END", _whole(_cyc, f"upper({_cyc})"),
    _sst("x_material"), _sst(_s["Color"]), _tight("x_voltage"), _tight(_s["Amperage"]),
)
_depth = f"CASE WHEN ends_with({_tight(_s['DepthWithDoorOpen'])}, 'IN') THEN {_tight(_s['DepthWithDoorOpen'])} ELSE {_tight(_s['DepthWithDoorOpen'])} || 'IN' END"
cte("described1", f"SELECT *, {_machine} AS machine, {_depth} AS depth_text FROM described0")
_k = "lower(kind)"
_layout = (
    f"CASE WHEN contains({_k}, 'faucet') THEN {ws(' ', 'upper(kind)', 'x_mounting', _s['FlowRate'], 'coalesce(' + _s['Finish'] + ', x_material)')} "
    f"WHEN {has(_k, 'fitting|elbow|tee|coupling|adapter|union|nipple|flange')} THEN {ws(' ', 'upper(kind)', 'x_dimensions', _s['ConnectionType'], 'x_material', _s['PressureRating'])} "
    f"WHEN {has(_k, 'disc|belt|wheel|blade|cut-off|cutoff|abrasive|grinding')} THEN {ws(' ', 'upper(kind)', 'x_dimensions', _s['ArborSize'], 'coalesce(' + _s['Grit'] + ', x_material)', _s['PackQuantity'])} "
    f"WHEN {has(_k, 'dishwasher|washer|dryer|refrigerator|range|oven')} THEN {ws(' ', 'machine', 'CASE WHEN length(machine) + 1 + length(depth_text) <= 40 THEN depth_text ELSE ' + _tight(_s['SoundLevel']) + ' END')} "
    f"ELSE {ws(' ', 'upper(kind)', 'x_mounting', 'x_material', 'x_voltage', 'x_dimensions')} END"
)
_once = unless("x_mounting", "ends_with(lower(x_mounting), 'mounting')", "x_mounting || ' Mounting'")
_cycles = _whole(_cyc, _cyc)
_color = f"CASE WHEN upper({_s['Color']}) <> upper(x_material) THEN {_s['Color']} END"
_mobile = ws(", ", "who", "kind", _s["Series"], "mpn_text", _once, "x_material")
_hasnt = lambda e, w, t: unless(e, f"contains(lower({e}), {q(w)})", f"{e} || {q(' ' + t)}")
_ends = lambda e, w, t: unless(e, f"ends_with({e}, {q(w)})", f"{e} || {q(t)}")
_long = ws(
    ", ", ws(" ", strip("who || ' ' || kind"), _s["With"]), _s["Series"], f"({_cycles}) || ' Wash Cycles'",
    _ends("x_voltage", "V", " V"), _ends(_s["Amperage"], "A", " A"), _once, "x_dimensions",
    _hasnt(_s["DepthWithDoorOpen"], "depth", "Depth With Door Open"), _hasnt(_s["Minimum Height"], "minimum height", "Minimum Height"),
    _hasnt(_s["Maximum Height"], "maximum height", "Maximum Height"), _ends(_s["SoundLevel"], "dBA", " dBA Sound Level"),
    "x_material", _s["Color"], f"'Additional Information: ' || {_s['Additional Information']}",
)
_own_series = f"CASE WHEN lower({_s['Series']}) <> lower(who) THEN {_s['Series']} END"
cte("described2", f"SELECT *, {_layout} AS layout_text, {_mobile} AS mobile_text FROM described1")
cte(
    "described",
    f"SELECT *, {compress('layout_text')} AS invoice_desc, CASE WHEN length(mobile_text) > 80 THEN rtrim(substr(mobile_text, 1, 80)) ELSE mobile_text END AS mobile_desc, "
    f"{ws(', ', 'who', _s['Series'], 'mpn_text', 'kind', _s['With'], 'x_mounting || ' + q(' Mounting'), f'({_cycles}) || ' + q('-Wash Cycle'), 'x_material', _color)} AS short_desc, {_long} AS long_desc, "
    f"{ws(', ', 'who', _own_series, 'kind', 'x_mounting || ' + q(' Mounting'), f'({_cycles}) || ' + q('-Wash Cycle'), 'x_material', _color)} AS product_title FROM described2",
)

# ------------------------------------------------------------------ confidence


def provenance(e, status="NULL"):
    k = f"lower({strip(e)})"
    return (
        f"CASE WHEN coalesce({e}, '') = '' THEN 0.70 WHEN contains({k}, 'official') THEN CASE WHEN {status} = 200 THEN 1.0 ELSE 0.95 END "
        f"WHEN contains({k}, 'nim') THEN 0.85 WHEN contains({k}, 'distributor') OR contains({k}, 'supplier') THEN 0.70 "
        f"WHEN contains({k}, 'unverifiable') OR contains({k}, 'heuristic') THEN 0.40 ELSE 0.70 END::DOUBLE"
    )


def valid_lov(field, e):
    return f"coalesce(lower({strip(e)}) IN ({words(v.lower() for v in D.lovs[field])}), false)"


def present(e):
    return f"coalesce({strip(e)} <> '', false)"


SCORED = ["item_type", "mounting", "material", "voltage"]
GLUED = r"(?i)\b\d+(\.\d+)?(in|v|a|w|hz|dba|lbs?|mm|cm)\b"
DECIMAL = r"(?i)\b\d+\.(25|5|75|125|375|625|875|0625|1875)\s*in\b"
_texts = ["f_brand", "f_item_type", "f_mpn", "f_voltage", "f_dimensions", "f_mounting", "f_material", "f_series", "f_mfr_url"]
_any = lambda rx: "(" + " OR ".join(f"coalesce({has(t, rx)}, false)" for t in _texts) + ")"
cte(
    "scored0",
    f"SELECT *, {provenance('mode0')} AS provenance_score, " + " + ".join(f"{present('f_' + f)}::INT" for f in SCORED) + " AS lov_checked, "
    + " + ".join(f"{valid_lov(f, 'f_' + f)}::INT" for f in SCORED) + f" AS lov_valid, {_any(GLUED)} AS has_glued_uom, {_any(DECIMAL)} AS has_decimal_inch FROM described",
)
cte(
    "scored1",
    "SELECT *, CASE WHEN lov_checked > 0 THEN lov_valid::DOUBLE / lov_checked ELSE 1.0::DOUBLE END AS lov_score, "
    "(CASE WHEN invoice_desc <> '' AND length(invoice_desc) <= 40 THEN 0.25 ELSE 0 END + CASE WHEN invoice_desc <> '' AND invoice_desc = upper(invoice_desc) THEN 0.25 ELSE 0 END "
    "+ CASE WHEN has_glued_uom THEN 0 ELSE 0.25 END + CASE WHEN has_decimal_inch THEN 0 ELSE 0.25 END)::DOUBLE AS rule_score FROM scored0",
)
cte(
    "scored2",
    "SELECT *, CASE WHEN status = 'ERROR' THEN 0.0::DOUBLE ELSE round(least(greatest(0.40::DOUBLE * provenance_score + 0.35::DOUBLE * lov_score + 0.25::DOUBLE * rule_score, 0), 1), 3) END AS confidence, "
    "round(least(greatest(0.40::DOUBLE * provenance_score + 0.35::DOUBLE * lov_score + 0.25::DOUBLE * rule_score, 0), 1), 3) AS confidence0, "
    "CASE WHEN status = 'ERROR' THEN 'ERROR' ELSE mode0 END AS source_mode FROM scored1",
)
cte(
    "enriched",
    "SELECT *, CASE WHEN confidence >= 0.90 THEN 'AUTO_APPROVED' WHEN confidence >= 0.75 THEN 'REVIEW' ELSE 'HITL_REQUIRED' END AS review_tier, "
    f"(status = 'ERROR' OR NOT (passed_lov AND passed_rules) OR confidence < 0.90) AS needs_review, "
    f"upper({strip('coalesce(' + filled('Mfg_Part_Num') + ', f_mpn, ' + q('') + ')')}) AS part_key "
    "FROM scored2 JOIN flags USING (_ordinal)",
)

# ------------------------------------------------------------------ slots and delivery

_front_pairs = [("Voltage Rating", ["Voltage Rating", "Voltage"], "x_voltage"), ("Size", ["Size", "Dimensions"], "x_dimensions"),
                ("Mounting Type", ["Mounting Type", "Mounting"], "x_mounting"), ("Material", ["Material"], "x_material")]
_front = ", ".join(
    f"{{'k': {q(l)}, 'v': CASE WHEN NOT list_has_any(list_transform(listed, lambda s: s.k), [{words(ns)}]) THEN {c} END}}" for l, ns, c in _front_pairs
)
cte("specs0", f"SELECT _ordinal, raw_specs, f_item_type, list_concat(listed, list_filter([{_front}], lambda s: s.v IS NOT NULL)) AS front FROM enriched")
cte(
    "specs",
    "SELECT _ordinal, f_item_type, list_concat(front, list_filter(raw_specs, lambda s: NOT list_contains(list_transform(front, lambda f: f.k), s.k) AND s.k <> 'spec_sections')) AS specs FROM specs0",
)
_kinds = " ".join(
    "WHEN " + " OR ".join(f"contains(lower(coalesce(f_item_type, '')), {q(w)})" for w in ws_) + f" THEN {q(k)}" for k, ws_ in V.SLOT_KEYWORDS
)
cte("slot_rows", table("slot", ["slot_kind", "slot", "label", "alias_ord", "alias"], [(k, i, l, j, a) for k, sl in V.SLOTS.items() for i, (l, al) in enumerate(sl, 1) for j, a in enumerate(al)]))
_spec_name = "regexp_replace(s.k, " + q(r"[_\-\s]+") + ", ' ', 'g')"
cte(
    "spec_long",
    "SELECT _ordinal, slot_kind, pos, s.k AS k, s.v AS v, " + f"lower({strip(_spec_name)}) AS nk "
    f"FROM (SELECT _ordinal, CASE {_kinds} ELSE 'default' END AS slot_kind, unnest(specs) AS s, generate_subscripts(specs, 1) AS pos FROM specs)",
)
cte(
    "slot_hits",
    "SELECT _ordinal, slot, label, arg_min({'k': k, 'v': v}, alias_ord) AS hit FROM (SELECT o._ordinal, r.slot, r.label, r.alias_ord, arg_max(l.k, l.pos) AS k, arg_max(l.v, l.pos) AS v "
    f"FROM (SELECT _ordinal, CASE {_kinds} ELSE 'default' END AS slot_kind FROM specs) o JOIN slot_rows r ON r.slot_kind = o.slot_kind "
    "JOIN spec_long l ON l._ordinal = o._ordinal AND l.nk = r.alias GROUP BY ALL) GROUP BY ALL",
)
cte(
    "slot_extra",
    "SELECT _ordinal, row_number() OVER (PARTITION BY _ordinal ORDER BY pos) AS rn, k AS label, v FROM spec_long l "
    f"WHERE {strip('coalesce(v, ' + q('') + ')')} <> '' AND lower(k) NOT IN ({words(V.SLOT_EXCLUDED_SPECS)}) AND NOT starts_with(lower(k), 'item_features') "
    "AND NOT EXISTS (SELECT 1 FROM slot_hits h WHERE h._ordinal = l._ordinal AND h.hit.k = l.k)",
)
_sv = strip("coalesce(v, '')")
_unit = grab(_sv, r"^([\d\-/.\s]+)\s*([A-Za-z]+)$", 2)
cte(
    "slots",
    f"SELECT _ordinal, slot, label, CASE WHEN {_unit} IN ({words(V.SLOT_UOMS)}) THEN {strip(grab(_sv, r'^([\d\-/.\s]+)\s*([A-Za-z]+)$'))} ELSE {_sv} END AS value, "
    f"CASE WHEN {_unit} IN ({words(V.SLOT_UOMS)}) THEN {_unit} ELSE '' END AS uom FROM ("
    f"SELECT o._ordinal, r.slot, r.label, h.hit.v AS v FROM (SELECT _ordinal, CASE {_kinds} ELSE 'default' END AS slot_kind FROM specs) o "
    "JOIN (SELECT DISTINCT slot_kind, slot, label FROM slot_rows) r USING (slot_kind) LEFT JOIN slot_hits h ON h._ordinal = o._ordinal AND h.slot = r.slot "
    "UNION ALL SELECT _ordinal, rn + 15, label, v FROM slot_extra WHERE rn <= 35)",
)
