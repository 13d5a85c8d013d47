"""The registered queries said again in plain SQL for another engine.

Queries are written over named building blocks; `build` puts the blocks a query
needs in front of it as common table expressions.  Only fixed values and the texts
that define the derived tables are shared with the library.
"""

from __future__ import annotations

import re

from packwise.functions import fixed_values as V
from packwise.sources import derived as D


# ------------------------------------------------------------------ small text helpers
def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(words: list[str]) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def has(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def ext(col: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({col}, {q(pattern)}, {group}), '')"


def allof(col: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({col}, {q(pattern)}, {group})"


def sub(col: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({col}, {q(pattern)}, {q(replacement)}, 'g')"


def any_in(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in dict.fromkeys(words)) + ")"


def strip(col: str, chars: str = " \t\n\r\x0b\x0c") -> str:
    return f"trim({col}, {q(chars)})"


def title(col: str) -> str:
    runs = f"regexp_extract_all(lower({col}), '(\\p{{L}}+|\\P{{L}}+)', 1)"
    return f"array_to_string(list_transform({runs}, lambda t: upper(t[1]) || t[2:]), '')"


def fx(col: str, places: int) -> str:
    return f"printf('%.{places}f', CAST({col} AS DOUBLE))"


def rnd(col: str, places: int) -> str:
    return f"CAST({fx(col, places)} AS DOUBLE)"


def unit(col: str) -> str:
    key = f"regexp_replace(trim(lower({col})), '\\s+', ' ', 'g')"
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in V.UNIT_ALIASES.items())
    return f"CASE {key} {cases} ELSE {col} END"


def say(key: str, *values: str) -> str:
    parts = V.REASONS[key].split("{}")
    out = [q(parts[0])]
    for v, rest in zip(values, parts[1:]):
        out += [v, q(rest)]
    return " || ".join(out)


def known(col: str) -> str:
    s = strip(f"coalesce({col}, '')")
    return f"(CASE WHEN lower({s}) IN ({', '.join(q(w) for w in V.MISSING_WORDS)}) THEN '' ELSE {s} END)"


EXACT_MEAN = "CAST(sum(CAST({c} AS DECIMAL(20,12))) AS DOUBLE) / nullif(count({c}), 0)"


def exact_mean(col: str) -> str:
    return EXACT_MEAN.format(c=col)


BLOCKS: dict[str, str] = {}
ORACLE: dict[str, str] = {}
RECURSIVE: set[str] = set()


# ------------------------------------------------------------------ derived tables
BLOCKS["panels"] = (
    "SELECT panel_no, " + ", ".join(f"{e} AS {n}" for n, e in D.PANEL_COLUMNS.items())
    + " FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY " + ", ".join(D.PANEL_ORDER)
    + ") AS panel_no FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
    " JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"
)
BLOCKS["label_lines"] = (
    "SELECT insp_no, panel_no, unnest(range(1, 13)) AS line_no, unnest([" + ", ".join(D.LABEL_LINES) + "]) AS text FROM panels"
)
BLOCKS["label_words"] = (
    "SELECT insp_no, panel_no, line_no, unnest(range(1, len(w) + 1)) AS word_no, unnest(w) AS text"
    " FROM (SELECT *, string_split(text, ' ') AS w FROM label_lines)"
)
BLOCKS["token_boxes"] = (
    "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in D.TOKEN_COLUMNS.items()) + " FROM label_words"
)
BLOCKS["tokens"] = (
    "SELECT insp_no, panel_no, line_no * 100 + word_no AS seq, text, confidence, x_min, y_min,"
    " CAST(x_min + width AS INT) AS x_max, CAST(y_min + height AS INT) AS y_max, line_no, word_no FROM token_boxes"
)
BLOCKS["second_pass"] = f"""
SELECT insp_no, panel_no, seq, text, {D.SECOND_PASS['confidence']} AS confidence, x_min + dx AS x_min, y_min + dy AS y_min,
  x_max + dx AS x_max, y_max + dy AS y_max
FROM (SELECT *, {D.SECOND_PASS['dx']} AS dx, {D.SECOND_PASS['dy']} AS dy FROM tokens WHERE {D.SECOND_PASS['keep']})"""
BLOCKS["declared"] = D.DECLARED.format(orders="orders")
BLOCKS["user_profiles"] = D.PROFILES.format(customer="customer")
BLOCKS["uploads"] = D.UPLOADS.format(part="part")
BLOCKS["status_events"] = D.STATUS_EVENTS.format(events="events")
BLOCKS["regions"] = (
    "SELECT insp_no, panel_no, k, " + ", ".join(f"{e} AS {n}" for n, e in D.REGION_COLUMNS.items())
    + " FROM (SELECT *, unnest(range(0, 6)) AS k FROM panels)"
)
BLOCKS["panel_metrics"] = (
    "SELECT insp_no, panel_no, " + ", ".join(f"{e} AS {n}" for n, e in D.METRIC_COLUMNS.items())
    + " FROM panels WHERE pk % 10 <> 9"
)


# ------------------------------------------------------------------ extraction
def sanitized(col: str) -> str:
    out = f"translate({col}, {q(V.SANITIZE_CHARS_FROM)}, {q(V.SANITIZE_CHARS_TO)})"
    for pattern, replacement in V.SANITIZE_STEPS:
        out = sub(out, pattern, replacement)
    return out


def number(col: str) -> str:
    return f"TRY_CAST(replace({col}, ',', '') AS DOUBLE)"


def commodity(col: str) -> str:
    ordered = sorted(V.COMMODITIES, key=len, reverse=True)
    cases = " ".join(
        "WHEN " + has(col, r"\b" + r"\s*".join(c.split()) + r"\b") + f" THEN {q(c)}" for c in ordered
    )
    return f"CASE {cases} END"


def define_fields(p: str, source: str, keys: list[str]) -> None:
    """Blocks `{p}_fields` (and helpers) extracting all fields from a block with keys, line_no, text."""
    k = ", ".join(keys)
    BLOCKS[f"{p}_san"] = f"SELECT {k}, line_no, {sanitized('text')} AS text FROM {source}"
    amount = (
        f"coalesce({ext('text', V.CURRENCY_AMOUNT, 1)}, {ext('text', V.SLASH_AMOUNT, 1)}, {ext('text', V.BARE_AMOUNT, 1)})"
    )
    stop = " OR ".join(
        [any_in("upper(st)", V.MAKER_STOP_WORDS)]
        + [has("st", x) for x in (V.MRP_KEYWORD, V.CARE_KEYWORD, V.ORIGIN, V.NET_QTY, V.PHONE, V.EMAIL)]
    )
    care_stop = " OR ".join(
        [any_in("upper(st)", V.CARE_STOP_WORDS)]
        + [has("st", x) for x in (V.MAKER_KEYWORD, V.MRP_KEYWORD, V.NET_QTY, V.MFG_DATE)]
    )
    BLOCKS[f"{p}_one"] = f"""
SELECT {k}, line_no, text, st, upper(text) AS up, lower(text) AS lo, contains(upper(text), 'TAX') AS tax,
  CASE WHEN {any_in('upper(text)', V.AHEAD_PRICE_SKIP)} OR {has('text', V.DATE_LIKE)} THEN NULL
    WHEN {number(amount)} >= 0.5 OR {any_in('text', V.AHEAD_PRICE_MARKS)} THEN {amount} END AS amt,
  {ext('text', V.STANDALONE_QTY, 1)} AS sqv, {ext('text', V.STANDALONE_QTY, 2)} AS squ,
  {ext('text', V.DATE_ONLY, 1)} AS dt, ({stop}) AS mstop, {has('st', V.PIN_6)} AS pin, ({care_stop}) AS cstop
FROM (SELECT *, {strip('text')} AS st FROM {p}_san)"""
    leads = ", ".join(
        f"lead({c}, {i}) OVER w AS {c}{i}"
        for c, n in (("st", 4), ("mstop", 4), ("pin", 4), ("cstop", 4), ("tax", 3), ("amt", 3), ("sqv", 1), ("squ", 1), ("dt", 1))
        for i in range(1, n + 1)
    )
    BLOCKS[f"{p}_ahead"] = f"SELECT *, {leads} FROM {p}_one WINDOW w AS (PARTITION BY {k} ORDER BY line_no)"

    def block(stop_col: str, pin: bool) -> list[str]:
        going, out = "true", []
        for i in (1, 2, 3, 4):
            going = f"({going} AND st{i} IS NOT NULL AND NOT {stop_col}{i})"
            out.append(going)
            if pin:
                going = f"({going} AND NOT pin{i})"
        return out

    maker_takes = block("mstop", True)
    maker_tail = ", ".join(f"CASE WHEN {t} THEN nullif(st{i}, '') END" for i, t in enumerate(maker_takes, 1))
    care_takes = block("cstop", False)
    care_tail = " || ".join(f"CASE WHEN {t} THEN ' ' || st{i} ELSE '' END" for i, t in enumerate(care_takes, 1))
    rest = f"CASE WHEN {has('text', V.MAKER_KEYWORD)} THEN {strip(f'regexp_extract(text, {q('(?s)' + V.MAKER_KEYWORD + '(.*)$')}, 1)', ' :.-')} END"
    corp = f"CASE WHEN {has('text', V.MAKER_CORPORATE)} AND NOT {any_in('up', V.MAKER_CONTEXT_SKIP)} THEN {strip('text', ' :.-')} END"
    phrases = [
        f"WHEN " + " OR ".join(f"contains(up, {q(ph + c)})" for ph in V.ORIGIN_PHRASES) + f" THEN {q(c)}"
        for c in V.PHRASE_COUNTRIES
    ]
    countries = ", ".join(q(c) for c in V.LABEL_COUNTRIES)
    BLOCKS[f"{p}_two"] = f"""
SELECT *, {ext('text', V.MRP_FULL, 1)} AS full_amt, {has('text', V.MRP_KEYWORD)} AS price_key,
  coalesce({ext('text', V.CURRENCY_AMOUNT, 1)}, {ext('text', V.SLASH_AMOUNT, 1)}, amt1, amt2, amt3) AS apart,
  (tax OR coalesce(tax1, false) OR coalesce(tax2, false) OR coalesce(tax3, false)) AS taxed,
  {ext('text', V.NET_QTY, 1)} AS nqv, {ext('text', V.NET_QTY, 2)} AS nqu,
  {ext('text', V.MFG_DATE, 1)} AS mdt,
  regexp_split_to_array({ext('text', V.ORIGIN, 1)}, '\\s+') AS ow, CASE {' '.join(phrases)} END AS ophrase,
  {rest} AS mrest, {corp} AS mcorp,
  CASE WHEN {has('text', V.CARE_KEYWORD)} THEN text || {care_tail} END AS cblock,
  {strip(ext('text', V.GENERIC_KEYWORD, 1), ' :.-,')} AS gname,
  CASE WHEN NOT {any_in('up', V.COMMODITY_LINE_SKIP)} THEN {commodity('lo')} END AS glist,
  {strip(f"regexp_replace(st, '[^A-Za-z\\s]', '', 'g')")} AS gclean,
  {ext('text', V.UNIT_SALE_PRICE, 1)} AS uspv, {ext('text', V.UNIT_SALE_PRICE, 2)} AS uspu
FROM {p}_ahead"""
    clean1 = strip(sub("cblock", V.CARE_KEYWORD, ""), " :,.-|")
    clean2 = strip(f"regexp_replace({clean1}, {q(V.CARE_LEAD_IN)}, '')", " :,.-|")
    BLOCKS[f"{p}_care"] = f"""
SELECT {k}, line_no, {allof('cblock', V.PHONE)} AS phones, {allof('cblock', V.EMAIL)} AS emails,
  {ext('cblock', V.WEBSITE)} AS site, {clean2} AS clean FROM {p}_two WHERE cblock IS NOT NULL"""
    addr = "list_reduce(list_concat(phones, emails), lambda a, f: replace(a, f, ''), clean)"
    addr = sub(addr, V.CARE_CONTACT_LABEL, "")
    addr = strip(f"regexp_replace({addr}, {q(V.CARE_ADDRESS_LEAD_IN)}, '')", " :,.-|")
    BLOCKS[f"{p}_care_value"] = f"""
SELECT {k}, line_no, CASE WHEN items <> '' THEN CASE WHEN length(addr) > 8 THEN items || ', ' || addr ELSE items END
    WHEN length(clean) > 5 THEN clean END AS value
FROM (SELECT *, {addr} AS addr, concat_ws(', ', 'Phone: ' || phones[1], 'Email: ' || emails[1], 'Website: ' || site) AS items
  FROM {p}_care)"""
    ignored = " OR ".join(f"contains(lower(s), {q(w)})" for w in V.IGNORED_SITES)
    big = 1 << 40
    named = f"CASE WHEN len(ow) > 0 AND lower(array_to_string(ow[1:2], ' ')) IN ({countries}) THEN lower(array_to_string(ow[1:2], ' ')) WHEN len(ow) > 0 AND lower(ow[1]) IN ({countries}) THEN lower(ow[1]) ELSE ophrase END"
    place = f"{any_in('up', V.INDIAN_PLACES)} AND ({has('up', V.PIN_5_OR_6)} OR contains(up, 'INDIA') OR {any_in('up', V.CORPORATE_WORDS)})"
    first_block = strip(f"concat_ws(', ', nullif(mrest, ''), {maker_tail})", " ,.-")
    second_block = strip(f"concat_ws(', ', nullif(mcorp, ''), {maker_tail})", " ,.-")
    gwords = f"regexp_extract_all(gname, '(\\S+)', 1)"
    cwords = f"regexp_extract_all(gclean, '(\\S+)', 1)"
    gtitle = (
        f"line_no <= 3 AND {any_in('up', V.TITLE_CONTEXT_WORDS)} AND NOT list_has_any(regexp_extract_all(up, '([A-Z]+)', 1), {lst(V.TITLE_EXCLUDED_WORDS)})"
        f" AND length(gclean) BETWEEN 4 AND 40 AND len({cwords}) BETWEEN 1 AND 4"
        f" AND len(list_filter({cwords}, lambda t: NOT regexp_matches(t, '(?i)[aeiouy]'))) = 0"
    )
    cand = {
        "mrp": ("0", f"""CASE WHEN price_key AND full_amt IS NOT NULL AND ({number('full_amt')} >= 0.5 OR {any_in('text', V.PRICE_MARKS)})
            THEN CASE WHEN contains(text, '₹') THEN '₹ ' ELSE 'Rs. ' END || full_amt || CASE WHEN taxed THEN {q(V.TAX_SUFFIX)} ELSE '' END
            WHEN price_key AND apart IS NOT NULL THEN '₹ ' || apart || CASE WHEN taxed THEN {q(V.TAX_SUFFIX)} ELSE '' END END"""),
        "manufacture_date": (
            f"CASE WHEN mdt IS NULL AND NOT coalesce({any_in('up', V.DATE_NEXT_LINE_WORDS)} AND dt1 IS NOT NULL, false) THEN 1 ELSE 0 END",
            f"coalesce(mdt, CASE WHEN {any_in('up', V.DATE_NEXT_LINE_WORDS)} THEN dt1 END, CASE WHEN {any_in('up', V.DATE_FALLBACK_WORDS)} THEN dt END)",
        ),
        "country_of_origin": (
            f"CASE WHEN {named} IS NULL THEN 1 ELSE 0 END",
            f"CASE WHEN {named} IS NOT NULL THEN {title(named)} WHEN {place} THEN 'India' END",
        ),
        "unit_sale_price": ("0", f"CASE WHEN uspv IS NOT NULL THEN CASE WHEN contains(text, '₹') THEN '₹ ' ELSE 'Rs. ' END || uspv || ' / ' || {unit('uspu')} END"),
        "phone": ("0", ext("text", V.PHONE)),
        "email": ("0", ext("text", V.EMAIL)),
        "site": ("0", f"list_filter({allof('text', V.WEBSITE)}, lambda s: NOT ({ignored}))[1]"),
    }
    qty2 = f"{any_in('up', V.NET_QTY_WORDS)} AND sqv1 IS NOT NULL"
    qty3 = f"NOT {any_in('lo', V.NUTRITION_WORDS)} AND sqv IS NOT NULL AND (NOT contains(sqv, '.') OR TRY_CAST(sqv AS DOUBLE) = floor(TRY_CAST(sqv AS DOUBLE)))"
    cand["net_quantity"] = (
        f"CASE WHEN nqv IS NOT NULL THEN 0 WHEN {qty2} THEN 1 ELSE 2 END",
        f"CASE WHEN nqv IS NOT NULL THEN nqv || ' ' || {unit('nqu')} WHEN {qty2} THEN sqv1 || ' ' || {unit('squ1')} WHEN {qty3} THEN sqv || ' ' || {unit('squ')} END",
    )
    m1 = f"CASE WHEN {has('mrest', V.PIN_6)} THEN {strip('mrest', ' ,.-')} WHEN mrest IS NOT NULL AND length({first_block}) >= 5 THEN {first_block} END"
    m2 = f"CASE WHEN mcorp IS NOT NULL AND {has('text', V.PIN_6)} THEN mcorp WHEN mcorp IS NOT NULL AND length({second_block}) >= 8 THEN {second_block} END"
    cand["manufacturer"] = (f"CASE WHEN ({m1}) IS NULL THEN 1 ELSE 0 END", f"coalesce({m1}, {m2})")
    g1 = f"CASE WHEN length(gname) >= 3 THEN CASE WHEN len({gwords}) > 8 THEN array_to_string({gwords}[1:8], ' ') ELSE gname END END"
    cand["generic_name"] = (
        f"CASE WHEN length(gname) >= 3 THEN 0 WHEN glist IS NOT NULL THEN 1 ELSE 2 END",
        title(f"coalesce({g1}, glist, CASE WHEN {gtitle} THEN gclean END)"),
    )
    for name, (rank, value) in cand.items():
        BLOCKS[f"{p}_{name}"] = (
            f"SELECT {k}, arg_min(value, rank) AS {name}, min(rank) AS rank FROM (SELECT {k}, ({rank}) * {big} + line_no AS rank, {value} AS value"
            f" FROM {p}_two) WHERE value IS NOT NULL GROUP BY {k}"
        )
    BLOCKS[f"{p}_care_line"] = (
        f"SELECT {k}, arg_min(value, line_no) AS care FROM {p}_care_value WHERE value IS NOT NULL GROUP BY {k}"
    )
    using = f"USING ({k})"
    contact = "nullif(concat_ws(', ', 'Phone: ' || phone, 'Email: ' || email, 'Website: ' || site), '')"
    BLOCKS[f"{p}_keys"] = f"SELECT DISTINCT {k} FROM {source}"
    BLOCKS[f"{p}_consumer_care"] = (
        f"SELECT {k}, coalesce(care, {contact}) AS consumer_care FROM {p}_keys LEFT JOIN {p}_care_line {using} LEFT JOIN {p}_phone {using}"
        f" LEFT JOIN {p}_email {using} LEFT JOIN {p}_site {using}"
    )
    BLOCKS[f"{p}_fields"] = (
        f"SELECT {k}, {', '.join(V.EXTRACTED_FIELDS)} FROM {p}_keys "
        + " ".join(f"LEFT JOIN {p}_{f} {using}" for f in V.EXTRACTED_FIELDS)
    )
    BLOCKS[f"{p}_repaired"] = (
        f"SELECT {k}, {repair('mrp')} AS mrp, {repair('net_quantity')} AS net_quantity, {repair('manufacture_date')} AS manufacture_date,"
        f" country_of_origin, manufacturer, consumer_care, generic_name, unit_sale_price FROM {p}_fields"
    )


def nearest(token: str, vocabulary: list[str], limit: int) -> str:
    """First word with the least edit distance within the limit."""
    scored = (
        f"list_filter(list_transform({lst(vocabulary)}, lambda w, i: {{'d': levenshtein({token}, upper(w)), 'i': i, 'w': w}}), lambda s: s.d <= {limit})"
    )
    return f"list_min({scored}).w"


def repair(col: str) -> str:
    token = "upper(regexp_replace(p, '^[^\\w]+|[^\\w]+$', '', 'g'))"
    preserved = ", ".join(q(w) for w in V.PRESERVED_WORDS)
    corrupted = ", ".join(q(w) for w in V.KNOWN_CORRUPTED)
    lower = "(lower(p) = p AND upper(p) <> p)"
    month, unit_ = nearest(token, V.MONTH_WORDS, 1), nearest(token, V.REPAIR_UNITS, 1)
    part = (
        f"CASE WHEN {token} IN ({preserved}) THEN p WHEN length({token}) = 3 AND {month} IS NOT NULL THEN {month}"
        f" WHEN length({token}) >= 4 AND {unit_} IS NOT NULL THEN CASE WHEN {lower} THEN lower({unit_}) ELSE {unit_} END"
        f" WHEN regexp_full_match(p, '\\p{{L}}+') AND {token} NOT IN ({corrupted}) THEN p"
        f" WHEN regexp_matches(p, '[0-9]') OR ({has(token, V.CONFUSABLE_ONLY)} AND length({token}) >= 2)"
        f" THEN translate(p, {q(V.CONFUSABLE_FROM)}, {q(V.CONFUSABLE_TO)}) ELSE p END"
    )
    return f"array_to_string(list_transform({allof(col, V.REPAIR_PARTS, 1)}, lambda p: {part}), '')"


PANEL = ["insp_no", "panel_no"]
define_fields("lab", "label_lines", PANEL)
BLOCKS["doc_lines"] = f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line_no, t AS text
FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, {strip('unnest(ls)')} AS t
  FROM (SELECT doc_id, regexp_split_to_array(text, {q(V.LINE_BREAKS)}) AS ls FROM documents)) WHERE t <> ''"""
define_fields("doc", "doc_lines", ["doc_id"])


def usp_parts(price: str, quantity: str) -> str:
    """Columns p, qn, un for the suggested unit price."""
    plain = f"split_part(replace({price}, ',', ''), '(', 1)"
    return (
        f"TRY_CAST({ext(plain, V.PRICE_NUMBER, 1)} AS DOUBLE) AS p, TRY_CAST({ext(quantity, V.PRICED_QUANTITY, 1)} AS DOUBLE) AS qn,"
        f" {unit(ext(quantity, V.PRICED_QUANTITY, 2))} AS un"
    )


COUNTS = ", ".join(q(u) for u in V.COUNT_UNITS)
SINGULAR = "CASE WHEN ends_with(un, 's') AND length(un) > 2 THEN un[:-2] ELSE un END"


def usp_select(source: str, keep: str) -> str:
    """keep, primary, secondary, amount, unit for every row of a block with mrp and net_quantity."""
    big = f"qn > 1000"
    amount = (
        f"CASE WHEN un IN ('ml', 'g') AND NOT {big} THEN (p / qn) * 100.0 WHEN un IN ('ml', 'g') THEN p / (qn / 1000.0)"
        f" WHEN un IN ('L', 'kg') OR un IN ({COUNTS}) THEN p / qn END"
    )
    per = (
        f"CASE WHEN un = 'ml' AND NOT {big} THEN '100 ml' WHEN un IN ('ml', 'L') THEN 'L' WHEN un = 'g' AND NOT {big} THEN '100 g'"
        f" WHEN un IN ('g', 'kg') THEN 'kg' WHEN un IN ({COUNTS}) THEN {SINGULAR} END"
    )
    second = (
        f"CASE WHEN un IN ('ml', 'g') AND NOT {big} THEN {fx('p / qn', 2)} || ' / ' || un"
        f" WHEN un IN ('ml', 'g') THEN {fx(rnd('(p / qn) * 100', 2), 2)} || ' / 100 ' || un"
        f" WHEN un = 'L' THEN {fx('(p / qn) / 10.0', 2)} || ' / 100 ml' WHEN un = 'kg' THEN {fx('(p / qn) / 10.0', 2)} || ' / 100 g'"
        f" WHEN un IN ({COUNTS}) THEN {fx('p / qn', 2)} || ' / unit' END"
    )
    return f"""
SELECT {keep}, CASE WHEN ok THEN '₹ ' || {fx('amount', 2)} || ' / ' || per END AS "primary",
  CASE WHEN ok THEN '₹ ' || second END AS secondary, CASE WHEN ok THEN {rnd('amount', 2)} END AS amount, CASE WHEN ok THEN per END AS unit
FROM (SELECT *, coalesce(p > 0 AND qn > 0 AND amount IS NOT NULL, false) AS ok FROM (SELECT *,
  CASE WHEN p > 0 AND qn > 0 THEN {amount} END AS amount, {per} AS per, CASE WHEN p > 0 AND qn > 0 THEN {second} END AS second
  FROM (SELECT *, {usp_parts('mrp', 'net_quantity')} FROM {source})))"""


for name, field in {
    "x1_price": "mrp", "x2_net_quantity": "net_quantity", "x3_manufacture_date": "manufacture_date",
    "x4_country": "country_of_origin", "x5_manufacturer": "manufacturer", "x6_consumer_care": "consumer_care",
    "x7_generic_name": "generic_name", "x8_unit_price": "unit_sale_price",
}.items():
    ORACLE[name] = f"SELECT insp_no, panel_no, {field} FROM lab_keys LEFT JOIN lab_{field} USING (insp_no, panel_no)"
ORACLE["x9_standard_unit"] = (
    f"SELECT unit, {unit('unit')} AS canonical, count(*) AS n FROM (SELECT {ext('text', V.STANDALONE_QTY, 2)} AS unit FROM label_lines)"
    " WHERE unit IS NOT NULL GROUP BY 1, 2"
)
ORACLE["x10_suggested_unit_price"] = usp_select("declared", "insp_no")
plain = "split_part(replace(mrp, ',', ''), '(', 1)"


def js2(e: str) -> str:
    """Two decimals, exact ties upwards."""
    return f"(CASE WHEN ({e}) * 8 = floor(({e}) * 8) AND CAST(floor(({e}) * 8) AS BIGINT) % 8 IN (1, 5) THEN {fx(f'({e}) + 0.001', 2)} ELSE {fx(e, 2)} END)"


def js_price(e: str, per: str) -> str:
    return f"'₹ ' || {js2(e)} || ' / {per}'"


ORACLE["x10_client_unit_price"] = f"""
SELECT insp_no, coalesce(CASE WHEN NOT coalesce(p > 0 AND q > 0, false) THEN ''
  WHEN u IN ('ml', 'millilitre', 'millilitres') THEN CASE WHEN q < 1000 THEN {js_price('(p / q) * 100', '100 ml')} || ' | ' || {js_price('p / q', 'ml')}
    ELSE {js_price('p / (q / 1000)', 'L')} || ' | ' || {js_price('(p / q) * 100', '100 ml')} END
  WHEN u IN ('l', 'ltr', 'litre', 'litres', 'liter') THEN {js_price('p / q', 'L')} || ' | ' || {js_price('p / q / 10', '100 ml')}
  WHEN u IN ('g', 'gm', 'gram', 'grams') THEN CASE WHEN q < 1000 THEN {js_price('(p / q) * 100', '100 g')} || ' | ' || {js_price('p / q', 'g')}
    ELSE {js_price('p / (q / 1000)', 'kg')} END
  WHEN u IN ('kg', 'kilogram') THEN {js_price('p / q', 'kg')}
  WHEN u IN ('units', 'unit', 'pcs', 'nos') THEN {js_price('p / q', 'unit')} END, '') AS prices
FROM (SELECT insp_no, TRY_CAST({ext(plain, V.CLIENT_PRICE_NUMBER, 1)} AS DOUBLE) AS p,
  TRY_CAST({ext('net_quantity', V.CLIENT_PRICED_QUANTITY, 1)} AS DOUBLE) AS q, lower({ext('net_quantity', V.CLIENT_PRICED_QUANTITY, 2)}) AS u FROM declared)"""


def filled_unit_price(source: str) -> str:
    """All columns of the block with the unit price filled in."""
    inner = usp_select(source, "*")
    return (
        f"SELECT * REPLACE (CASE WHEN coalesce(unit_sale_price, '') = '' THEN \"primary\" || {q(V.CALCULATED_SUFFIX)} ELSE unit_sale_price END AS unit_sale_price)"
        f" FROM ({inner})"
    )


BLOCKS["declared_filled"] = filled_unit_price("declared")
ORACLE["x11_calculated_unit_price"] = "SELECT insp_no, unit_sale_price FROM declared_filled"
ORACLE["x12_numeric_repair"] = f"""
SELECT value, {repair('value')} AS repaired, count(*) AS n FROM (SELECT unnest([translate(mrp, '015', 'OlS'), translate(net_quantity, '018', 'OIB'),
  translate(net_quantity, 'eia', 'cln'), translate(manufacture_date, 'SEP02', '5EPOZ'), manufacture_date]) AS value FROM declared)
WHERE value IS NOT NULL GROUP BY 1, 2"""
vocab = V.REPAIR_UNITS + ["rod", "ring", "gear", "bold", "small", "reed"]
ORACLE["x13_fuzzy_word"] = (
    f"SELECT word, coalesce({nearest('upper(word)', vocab, 2)}, word) AS matched FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)"
)
nums = lst(["900.00", "910.10", "925.55", "999.90"])
ORACLE["x14_fuzzy_number"] = f"""
SELECT price, CASE WHEN b.d <= 1 THEN b.w ELSE price END AS matched FROM (SELECT price, list_min(list_transform({nums},
  lambda w, i: {{'d': levenshtein(price, w), 'i': i, 'w': w}})) AS b FROM (SELECT DISTINCT CAST(price AS VARCHAR) AS price FROM panels))"""
ORACLE["x13_vocabulary_table"] = """
WITH asked AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM benchmark),
known AS (SELECT DISTINCT unnest(regexp_extract_all(html, '[A-Za-z]+')) AS w FROM pages),
near AS (SELECT word, w, levenshtein(upper(word), upper(w)) AS d FROM asked JOIN known ON abs(length(word) - length(w)) <= 1 WHERE length(word) >= 2),
best AS (SELECT word, arg_min(w, (d, w)) AS w FROM near WHERE d <= 1 GROUP BY word)
SELECT word, coalesce(CASE WHEN word = lower(word) THEN lower(w) ELSE w END, word) AS matched FROM asked LEFT JOIN best USING (word)"""
ORACLE["x14_vocabulary_table"] = """
WITH asked AS (SELECT DISTINCT CAST(c_acctbal AS VARCHAR) AS value FROM customer),
known AS (SELECT DISTINCT CAST(s_acctbal AS VARCHAR) AS w FROM supplier),
best AS (SELECT value, arg_min(w, (levenshtein(value, w), w)) AS w FROM asked JOIN known ON levenshtein(value, w) <= 1 GROUP BY value)
SELECT value, coalesce(w, value) AS matched FROM asked LEFT JOIN best USING (value)"""
ORACLE["x15_all_fields_of_raw_text"] = "SELECT * FROM doc_fields"
ORACLE["x15_all_fields_of_labels"] = "SELECT * FROM lab_repaired"
ORACLE["x16_missing_critical_fields"] = (
    "SELECT insp_no, panel_no, concat_ws(',', CASE WHEN mrp IS NULL THEN 'mrp' END, CASE WHEN net_quantity IS NULL THEN 'net_quantity' END,"
    " CASE WHEN manufacture_date IS NULL THEN 'manufacture_date' END) AS missing FROM lab_fields"
)

# ------------------------------------------------------------------ tokens and lines
ORACLE["f1_missing_words"] = (
    f"SELECT insp_no, {known('manufacturer')} AS maker, {known('importer')} AS importer, {known('packer')} <> '' AS has_packer FROM declared"
)


def marked(col: str, pattern: str, replacement: str, inner: str) -> str:
    pieces = f"string_split(regexp_replace({col}, {q(pattern)}, {replacement}, 'g'), chr(1))"
    return f"array_to_string(list_transform({pieces}, lambda p, i: CASE WHEN i % 2 = 0 THEN {inner} ELSE p END), '')"


def cleaned(col: str) -> str:
    t = f"trim(regexp_replace(nfc_normalize({col}), {q(V.TOKEN_SPACES)}, ' ', 'g'))"
    t = f"CASE WHEN {t} IN ({', '.join(q(c) for c in V.LONE_NOISE_CHARS)}) THEN '' ELSE {t} END"
    t = marked(t, V.ZERO_IN_QUANTITY, "'\\1' || chr(1) || '\\2' || chr(1) || '\\3'", "repeat('0', length(p))")
    t = marked(t, V.ZERO_IN_PRICE, "chr(1) || '\\0' || chr(1)", "translate(p, 'ODod', '0000')")
    t = sub(t, V.COLLAPSED_COUNT, "\\1 \\2")
    t = sub(t, V.PHONE_LABEL_TYPO, "Ph: \\1")
    t = sub(t, V.EMAIL_DOT_TYPO, "@\\1.\\2")
    return sub(t, V.RUPEE_TYPO, "Rs. \\1/-")


ORACLE["f2_clean_tokens"] = (
    f"SELECT text AS raw, {cleaned('text')} AS clean, count(*) AS n FROM (SELECT unnest([text, translate(text, '0', 'O') || ' g']) AS text FROM tokens) GROUP BY 1, 2"
)
BLOCKS["token_texts"] = f"SELECT text AS raw, {cleaned('text')} AS clean FROM (SELECT DISTINCT text FROM tokens)"
BLOCKS["kept_tokens"] = (
    "SELECT t.* REPLACE (c.clean AS text) FROM tokens t JOIN token_texts c ON t.text = c.raw WHERE t.confidence >= 0.34 AND c.clean <> ''"
)
ORACLE["f3_filter_tokens"] = "SELECT insp_no, panel_no, seq, text, confidence FROM kept_tokens"
ORACLE["f4_positive_confidence"] = (
    f"SELECT insp_no, {rnd(exact_mean('c'), 4)} AS mean_confidence FROM (SELECT insp_no, CASE WHEN confidence - 0.5 > 0 THEN confidence - 0.5 END AS c FROM tokens) GROUP BY 1"
)
VERTICAL = "(greatest(1, y_max - y_min) >= 1.8 * greatest(1, x_max - x_min) AND greatest(1, y_max - y_min) >= 35)"
ORACLE["f5_vertical_tokens"] = f"SELECT insp_no, count(*) AS vertical_tokens FROM tokens WHERE {VERTICAL} GROUP BY 1"
ORACLE["f6_sanitize_lines"] = "SELECT insp_no, panel_no, line_no, text FROM lab_san"
ORACLE["f25_recovery_needed"] = f"""
SELECT insp_no, panel_no, coalesce(n, 0) AS token_count, coalesce(n, 0) < 18 OR coalesce(m, 0) < 0.65 OR least(sz * 40, 1400) < 500 AS needs_recovery
FROM panels LEFT JOIN (SELECT insp_no, panel_no, count(*) AS n, {exact_mean('confidence')} AS m FROM tokens GROUP BY 1, 2) USING (insp_no, panel_no)"""
ORACLE["f26_rescale_boxes"] = (
    "SELECT insp_no, panel_no, seq, concat_ws(',', " + ", ".join(
        f"CASE WHEN insp_no % 2 = 0 THEN CAST(round_even({c} / 1.5, 0) AS INT) ELSE {c} END" for c in ("x_min", "y_min", "x_max", "y_max")
    ) + ") AS box FROM tokens"
)
ORACLE["f27_polygon_boxes"] = (
    "SELECT insp_no, panel_no, seq, concat_ws(',', " + ", ".join(
        f"CAST(round_even({c} + {d}, 0) AS INT)" for c, d in (("x_min", 0.25), ("y_min", 0.75), ("x_max", 0.25), ("y_max", 0.75))
    ) + ") AS box FROM tokens"
)

TOKEN_STRUCT = "{'source': source, 'seq': seq, 'text': text, 'confidence': confidence, 'x1': x_min, 'y1': y_min, 'x2': x_max, 'y2': y_max}"


def iou(a: str, b: str) -> str:
    inter = f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
    area = "(greatest(0, {r}.x2 - {r}.x1) * greatest(0, {r}.y2 - {r}.y1))"
    union = f"({area.format(r=a)} + {area.format(r=b)} - {inter})"
    return f"(CASE WHEN {inter} = 0 OR {union} <= 0 THEN 0.0 ELSE CAST({inter} AS DOUBLE) / {union} END)"


def define_merge(p: str, first: str, second: str) -> None:
    """Block `{p}_merged`: the two-pass merge as a recursion over the second pass's tokens, panel by panel."""
    BLOCKS[f"{p}_a"] = (
        f"SELECT insp_no, panel_no, list({TOKEN_STRUCT} ORDER BY seq) AS acc FROM (SELECT *, 1 AS source FROM {first}) GROUP BY 1, 2"
    )
    BLOCKS[f"{p}_b"] = (
        f"SELECT insp_no, panel_no, list({TOKEN_STRUCT} ORDER BY seq) AS todo FROM (SELECT *, 2 AS source FROM {second}) GROUP BY 1, 2"
    )
    BLOCKS[f"{p}_fold"] = f"""
SELECT insp_no, panel_no, 1 AS i, acc, coalesce(todo, []) AS todo FROM {p}_a LEFT JOIN {p}_b USING (insp_no, panel_no)
UNION ALL
SELECT insp_no, panel_no, i + 1, CASE WHEN best >= 0.40 THEN list_transform(acc, lambda m, j: CASE WHEN j = list_position(ious, best)
    AND (t.confidence > m.confidence + 0.10 OR length(t.text) > length(m.text) + 3)
    THEN {{'source': m.source, 'seq': m.seq, 'text': t.text, 'confidence': t.confidence, 'x1': t.x1, 'y1': t.y1, 'x2': t.x2, 'y2': t.y2}} ELSE m END)
  ELSE list_append(acc, t) END, todo
FROM (SELECT *, list_max(ious) AS best FROM (SELECT *, list_transform(acc, lambda m: {iou('m', 't')}) AS ious
  FROM (SELECT *, todo[i] AS t FROM {p}_fold WHERE i <= len(todo))))"""
    RECURSIVE.add(f"{p}_fold")
    BLOCKS[f"{p}_merged"] = f"""
SELECT insp_no, panel_no, m.source AS source, m.seq AS seq, m.text AS text, m.confidence AS confidence, m.x1 AS x_min, m.y1 AS y_min, m.x2 AS x_max, m.y2 AS y_max
FROM (SELECT insp_no, panel_no, unnest(acc) AS m FROM {p}_fold WHERE i = len(todo) + 1)"""


define_merge("two", "tokens", "second_pass")
ORACLE["j1_two_pass_merge"] = "SELECT insp_no, panel_no, source, seq, text, confidence, x_min, y_min, x_max, y_max FROM two_merged"
ORACLE["u3_rescued_tokens"] = "SELECT source, count(*) AS tokens FROM two_merged GROUP BY 1"


def define_lines(p: str, source: str, more: str = "") -> None:
    """Block `{p}_lines`: rows, columns and side-bars of the tokens of each panel, by recursion over tokens in reading order."""
    th, gh = "greatest(1, t.y2 - t.y1)", "greatest(1, g.hi - g.lo)"
    fits = (
        f"(CAST(greatest({th}, {gh}) AS DOUBLE) / least({th}, {gh}) <= 2.2 AND"
        f" CAST(greatest(0, least(t.y2, g.hi) - greatest(t.y1, g.lo)) AS DOUBLE) / least({th}, {gh}) >= 0.45)"
    )
    BLOCKS[f"{p}_todo"] = (
        f"SELECT insp_no, panel_no{more}, list({{'y1': y_min, 'x1': x_min, 'seq': seq, 'text': text, 'confidence': confidence, 'x2': x_max, 'y2': y_max}}"
        f" ORDER BY y_min, x_min, seq) AS todo FROM {source} WHERE NOT {VERTICAL} GROUP BY ALL"
    )
    BLOCKS[f"{p}_rows"] = f"""
SELECT insp_no, panel_no{more}, 0 AS i, CAST([] AS STRUCT(lo INT, hi INT)[]) AS groups, CAST([] AS BIGINT[]) AS member, todo FROM {p}_todo
UNION ALL
SELECT insp_no, panel_no{more}, i + 1,
  CASE WHEN spot = 0 THEN list_append(groups, {{'lo': CAST(t.y1 AS INT), 'hi': CAST(t.y2 AS INT)}})
    ELSE list_transform(groups, lambda g, j: CASE WHEN j = spot THEN {{'lo': least(g.lo, t.y1), 'hi': greatest(g.hi, t.y2)}} ELSE g END) END,
  list_append(member, CASE WHEN spot = 0 THEN CAST(len(groups) + 1 AS BIGINT) ELSE CAST(spot AS BIGINT) END), todo
FROM (SELECT *, coalesce(list_position(list_transform(groups, lambda g: {fits}), true)  , 0) AS spot
  FROM (SELECT *, todo[i + 1] AS t FROM {p}_rows WHERE i < len(todo)))"""
    RECURSIVE.add(f"{p}_rows")
    BLOCKS[f"{p}_placed"] = f"""
SELECT insp_no, panel_no{more}, grp, ord, t.seq AS seq, t.text AS text, t.confidence AS confidence, t.x1 AS x_min, t.y1 AS y_min, t.x2 AS x_max, t.y2 AS y_max
FROM (SELECT insp_no, panel_no{more}, unnest(member) AS grp, unnest(range(0, len(todo))) AS ord, unnest(todo) AS t FROM {p}_rows WHERE i = len(todo))"""
    BLOCKS[f"{p}_split"] = split_sql(f"{p}_placed", "grp", "ord", more)
    BLOCKS[f"{p}_flat"] = f"""
SELECT insp_no, panel_no{more}, grp, sub, trim(string_agg(text, ' ' ORDER BY x_min, ord)) AS text, {rnd(exact_mean('confidence'), 4)} AS confidence,
  min(x_min) AS x_min, min(y_min) AS y_min, max(x_max) AS x_max, max(y_max) AS y_max, count(*) AS token_count FROM {p}_split GROUP BY ALL"""
    BLOCKS[f"{p}_lines"] = f"""
SELECT insp_no, panel_no{more}, row_number() OVER (PARTITION BY insp_no, panel_no{more} ORDER BY y_min, kind, o1, o2) AS line_no, text, confidence, x_min, y_min, x_max, y_max, token_count
FROM (SELECT insp_no, panel_no{more}, 0 AS kind, grp AS o1, sub AS o2, text, confidence, x_min, y_min, x_max, y_max, token_count FROM {p}_flat
  UNION ALL SELECT insp_no, panel_no{more}, 1, seq, 0, text, confidence, x_min, y_min, x_max, y_max, 1 FROM {source} WHERE {VERTICAL})"""


def split_sql(source: str, grp: str, ord_: str, more: str = "") -> str:
    w = f"(PARTITION BY insp_no, panel_no{more}, {grp} ORDER BY x_min, {ord_})"
    return f"""
SELECT *, sum(fresh) OVER {w} AS sub FROM (SELECT *, CASE WHEN x_min - px > 4.0 * ((ph + (y_max - y_min)) / 2.0) AND x_min - px > 120 THEN 1 ELSE 0 END AS fresh
  FROM (SELECT *, lag(x_max) OVER {w} AS px, lag(y_max - y_min) OVER {w} AS ph FROM {source}))"""


define_lines("raw", "tokens")
define_lines("kept", "kept_tokens")
# the library numbers groups within a strip: bring the panel-wide numbers to the same form
BLOCKS["raw_strips"] = """
SELECT *, max(CASE WHEN reach IS NULL OR y_min >= reach THEN y_min END) OVER (PARTITION BY insp_no, panel_no ORDER BY y_min, x_min, seq) AS band
FROM (SELECT *, max(y_max) OVER (PARTITION BY insp_no, panel_no ORDER BY y_min RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM raw_placed)"""
ORACLE["w3_row_groups"] = (
    "SELECT insp_no, panel_no, seq, CAST(band AS BIGINT) AS band, dense_rank() OVER (PARTITION BY insp_no, panel_no, band ORDER BY grp) AS grp FROM raw_strips"
)
ORACLE["w4_column_split"] = "SELECT insp_no, panel_no, seq, CAST(sub AS BIGINT) AS sub FROM raw_split"
ORACLE["e14_line_rollup"] = "SELECT insp_no, panel_no, text, confidence, x_min, y_min, x_max, y_max, token_count FROM raw_flat"
ORACLE["w5_line_order"] = "SELECT insp_no, panel_no, line_no, text, y_min FROM raw_lines"
ORACLE["u2_horizontal_and_vertical_lines"] = "SELECT insp_no, panel_no, text, confidence, x_min, y_min, x_max, y_max, token_count FROM raw_lines"
ORACLE["w6_normalize"] = "SELECT * FROM kept_lines"
ORACLE["e10_recognition_telemetry"] = f"""
SELECT insp_no, panel_no, coalesce(token_count, 0) AS token_count, coalesce(mean_confidence, 1.0) AS mean_confidence
FROM (SELECT DISTINCT insp_no, panel_no FROM label_lines) LEFT JOIN (
  SELECT insp_no, panel_no, count(*) AS token_count, {rnd(exact_mean('confidence'), 4)} AS mean_confidence
  FROM tokens WHERE insp_no % 50 <> 0 GROUP BY 1, 2) USING (insp_no, panel_no)"""
ORACLE["w1_lookahead_lines"] = (
    "SELECT insp_no, panel_no, line_no, " + ", ".join(f"lead(text, {i}) OVER w AS next{i}" for i in (1, 2, 3, 4))
    + " FROM label_lines WINDOW w AS (PARTITION BY insp_no, panel_no ORDER BY line_no)"
)
ORACLE["w2_first_match_ranks"] = f"""
SELECT insp_no, panel_no, rank // {1 << 40} AS pass_no, rank % {1 << 40} AS line_no FROM lab_keys LEFT JOIN lab_net_quantity USING (insp_no, panel_no)"""
ORACLE["w10_ordered_regions"] = (
    "SELECT insp_no, panel_no, CAST(row_number() OVER (PARTITION BY insp_no, panel_no ORDER BY y, x, k) AS INTEGER) AS place, k, y, x FROM regions"
)
ORACLE["j8_commodity_lines"] = (
    f"SELECT commodity, count(*) AS lines FROM (SELECT {commodity('lower(text)')} AS commodity FROM label_lines) WHERE commodity IS NOT NULL GROUP BY 1"
)
UPPER_WORDS = "regexp_extract_all(upper(text), '([A-Z]+)', 1)"
ORACLE["e16_excluded_title_words"] = (
    f"SELECT list_has_any({UPPER_WORDS}, {lst(V.TITLE_EXCLUDED_WORDS)}) AS excluded, count(*) AS lines FROM label_lines GROUP BY 1"
)
ORACLE["u5_excluded_words_found"] = (
    f"SELECT word, count(*) AS lines FROM (SELECT unnest(list_distinct(list_intersect({UPPER_WORDS}, {lst(V.TITLE_EXCLUDED_WORDS)}))) AS word FROM label_lines) GROUP BY 1"
)

# second-pass words in the zone of each field, read as labels of their own
BLOCKS["zoned"] = """
SELECT insp_no, panel_no, field, seq, clean AS text, confidence, x_min, y_min, x_max, y_max FROM (
  SELECT *, unnest(list_filter([CASE WHEN cy >= 400 AND cy < 800 AND cx >= 400 AND cx < 1000 THEN 'mrp' END,
    CASE WHEN cy >= 320 AND cy < 720 AND cx >= 0 AND cx < 600 THEN 'net_quantity' END,
    CASE WHEN cy >= 400 AND cy < 800 AND cx >= 0 AND cx < 600 THEN 'manufacture_date' END], lambda f: f IS NOT NULL)) AS field
  FROM (SELECT *, (x_min + x_max) / 2.0 AS cx, (y_min + y_max) / 2.0 AS cy FROM second_pass)) SEMI JOIN open_fields USING (insp_no, panel_no, field) JOIN token_texts ON text = raw
WHERE confidence >= 0.34 AND clean <> ''"""
BLOCKS["open_fields"] = " UNION ALL ".join(  # critical fields a panel lacks after the first pass
    f"SELECT insp_no, panel_no, {q(f)} AS field FROM (SELECT insp_no, panel_no FROM panels) LEFT JOIN one_repaired USING (insp_no, panel_no) WHERE coalesce({f}, '') = ''"
    for f in V.RETRY_ZONES
)
define_lines("zone", "zoned", ", field")
define_fields("zon", "zone_lines", ["insp_no", "panel_no", "field"])
for name in ("mrp", "net_quantity", "manufacture_date"):
    BLOCKS[f"zone_{name}"] = f"SELECT insp_no, panel_no, {name} AS retry_{name} FROM zon_repaired WHERE field = {q(name)}"
ORACLE["x16_zone_retry"] = f"SELECT insp_no, panel_no, {', '.join(V.RETRY_ZONES)} FROM one_retried"

# ------------------------------------------------------------------ visual checks
ORACLE["f18_target_size"] = """
SELECT file_no, CASE WHEN width < 32 OR height < 32 THEN 'too small' WHEN width > 8192 OR height > 8192 THEN 'too large' END AS reject_reason,
  CASE WHEN width >= 32 AND height >= 32 AND width <= 8192 AND height <= 8192 THEN CASE WHEN greatest(width, height) > 1280
    THEN greatest(CAST(round_even(width * (1280.0::DOUBLE / greatest(width, height)), 0) AS INT), 32) ELSE width END END AS target_width,
  CASE WHEN width >= 32 AND height >= 32 AND width <= 8192 AND height <= 8192 THEN CASE WHEN greatest(width, height) > 1280
    THEN greatest(CAST(round_even(height * (1280.0::DOUBLE / greatest(width, height)), 0) AS INT), 32) ELSE height END END AS target_height FROM uploads"""
ORACLE["f19_padding"] = """
SELECT file_no, CASE WHEN width / greatest(height, 1) > 3.0 THEN greatest(20, CAST(floor(height * 0.15::DOUBLE) AS INT)) ELSE 20 END AS padding,
  width / greatest(height, 1) > 3.0 AS padding_applied FROM uploads"""
KEEP_REGION = (
    "width >= 50 AND height >= 10 AND width * height >= 180 AND width * height / 1400000 <= 0.45 AND width / height >= 0.30"
    " AND height / 1400 <= 0.75 AND NOT (height / 1400 > 0.25 AND width < 90)"
)
ORACLE["f20_region_filter"] = f"SELECT insp_no, panel_no, k, x, y, width, height FROM regions WHERE {KEEP_REGION}"
GOOD_BOX = "x >= 0 AND y >= 0 AND width > 0 AND height > 0 AND x + width <= 1000 AND y + height <= 1400"
NORMAL = ", ".join(f"{rnd(f'{c} / {s}', 6)} AS {c}_normalized" for c, s in (("x", 1000), ("y", 1400), ("width", 1000), ("height", 1400)))
ORACLE["f21_normalized_regions"] = f"SELECT insp_no, panel_no, k, {NORMAL} FROM regions WHERE {GOOD_BOX}"
ORACLE["f21_rejected_regions"] = (
    f"SELECT CASE WHEN x < 0 OR y < 0 OR width <= 0 OR height <= 0 THEN 'not positive' ELSE 'outside the image' END AS problem, count(*) AS boxes FROM regions WHERE NOT ({GOOD_BOX}) GROUP BY 1"
)
ORACLE["f22_letter_height"] = f"""
SELECT insp_no, panel_no, k, CASE WHEN height - 20 > 0 AND dpi IS NOT NULL THEN {rnd('CAST(height - 20 AS DOUBLE) / dpi * 25.4', 6)} END AS physical_height_mm,
  CASE WHEN height - 20 <= 0 THEN 'invalid' WHEN dpi IS NULL THEN 'unknown_scale' ELSE 'measured' END AS status
FROM regions JOIN panel_metrics USING (insp_no, panel_no)"""
READ = "CASE WHEN sharpness >= 45 AND contrast >= 22 THEN 'good' WHEN sharpness < 45 AND contrast < 22 THEN 'poor' ELSE 'review' END"
ORACLE["f23_readability"] = f"SELECT insp_no, panel_no, {READ} AS readability FROM panel_metrics"
BLOCKS["kept_medians"] = f"""
SELECT insp_no, panel_no, list(height ORDER BY height)[count(*) // 2 + 1] AS median_height, count(*) AS region_count
FROM regions JOIN panel_metrics USING (insp_no, panel_no) WHERE {KEEP_REGION} GROUP BY 1, 2"""
BLOCKS["visuals"] = f"""
SELECT insp_no, panel_no,
  CASE WHEN sharpness IS NULL THEN {q(V.UNCHECKED_READABILITY)} ELSE CASE {READ} WHEN 'good' THEN 'GOOD (Sharpness: ' || {fx('sharpness', 1)} || ')' WHEN 'poor' THEN 'POOR' ELSE 'REVIEW' END END AS readability,
  CASE WHEN sharpness IS NOT NULL THEN {rnd('median_height / coalesce(dpi, 150.0) * 25.4::DOUBLE', 2)} END AS font_height,
  CASE WHEN sharpness IS NULL THEN 'Uncertain' ELSE 'Principal Display Panel (' || coalesce(region_count, 0) || ' regions detected)' END AS placement,
  CASE WHEN sharpness IS NULL THEN 150.0::DOUBLE ELSE dpi END AS dpi
FROM panels LEFT JOIN panel_metrics USING (insp_no, panel_no) LEFT JOIN kept_medians USING (insp_no, panel_no)"""
ORACLE["f24_visual_checks"] = "SELECT * FROM visuals"
ORACLE["e13_median_region_height"] = (
    "SELECT insp_no, panel_no, list(height ORDER BY height)[count(*) // 2 + 1] AS median_height, count(*) AS region_count FROM regions GROUP BY 1, 2"
)
BLOCKS["stored_boxes"] = f"""
SELECT insp_no, panel_no, x, y, width, height, {NORMAL},
  row_number() OVER (PARTITION BY insp_no, panel_no ORDER BY y, x, width, height) - 1 AS pos, count(*) OVER (PARTITION BY insp_no, panel_no) AS n
FROM regions WHERE {GOOD_BOX}"""
ORACLE["s7_visual_documents"] = f"""
SELECT insp_no, panel_no, v.readability AS readability, v.font_height AS font_height, v.placement AS placement, v.dpi AS dpi, sharpness, contrast,
  image_width, image_height, coalesce(n, 0) AS region_count, pos, y, x, width, height, x_normalized, y_normalized, width_normalized, height_normalized
FROM visuals v JOIN panel_metrics USING (insp_no, panel_no) LEFT JOIN stored_boxes USING (insp_no, panel_no)"""
BLOCKS["first_visuals"] = """
SELECT insp_no, v.readability AS readability, v.font_height AS font_height,
  CASE WHEN n > 1 THEN 'Multi-panel (' || n || ' panels analyzed: Front, Back & Information Panels)' ELSE v.placement END AS placement, v.dpi AS dpi, n AS panel_count
FROM (SELECT insp_no, arg_min(v, panel_no) AS v, count(*) AS n FROM visuals v GROUP BY 1)"""
ORACLE["e12_visual_merge"] = "SELECT * FROM first_visuals"

# ------------------------------------------------------------------ rules
K = [f for f in V.TEXT_FIELDS]
NO = ("NOT_APPLICABLE", "NULL")


def chain(*cases: tuple[str, str | None, str]) -> tuple[str, str]:
    """(condition, status, reason) in order -> status and reason expressions."""
    status = "CASE " + " ".join(f"WHEN {c} THEN {q(s or 'NOT_APPLICABLE')}" for c, s, _ in cases) + " ELSE 'NOT_APPLICABLE' END"
    reason = "CASE " + " ".join(f"WHEN {c} THEN {r if s else 'NULL'}" for c, s, r in cases) + " END"
    return status, reason


def f(name: str) -> str:
    return f"k_{name}"


maker, packer, imp, coo, gen, qty, mrp, usp, mfd, bb, care, veg = (
    f(n) for n in (
        "manufacturer", "packer", "importer", "country_of_origin", "generic_name", "net_quantity", "mrp", "unit_sale_price",
        "manufacture_date", "best_before", "consumer_care", "veg_nonveg_mark",
    )
)
bare_usp = f"trim(regexp_replace({usp}, {q(V.CALCULATED_MARK)}, '', 'g'))"
calc = has(usp, V.CALCULATED_MARK)
liquid = f"({any_in(f'lower({qty})', V.LIQUID_WORDS)} OR contains(lower(k_category), 'beverage'))"
suggestion = f"CASE WHEN {liquid} THEN \"primary\" || ' (or ' || secondary || ')' ELSE \"primary\" END"
printed = f"{bare_usp} <> '' AND NOT {calc}"
place = known("placement")
missing5 = " + ".join(f"CAST({f(n)} = '' AS INT)" for n in ("manufacturer", "generic_name", "net_quantity", "mrp", "consumer_care"))
tier_n = f"TRY_CAST({ext(qty, V.RULE_QUANTITY, 1)} AS DOUBLE)"
tier_u = f"lower({ext(qty, V.RULE_QUANTITY, 2)})"
tier_v = f"(CASE WHEN {tier_u} IN ({', '.join(q(u) for u in V.KILO_UNITS)}) THEN {tier_n} * 1000.0 ELSE {tier_n} END)"
TIER = f"CAST(CASE WHEN {tier_v} IS NULL OR {tier_v} <= 50 THEN 1.0 WHEN {tier_v} <= 200 THEN 2.0 WHEN {tier_v} <= 1000 THEN 4.0 ELSE 6.0 END AS DOUBLE)"
RULE_SQL: dict[str, tuple[str, str]] = {
    "R6-01": chain(
        (f"{maker} = ''", "FAIL", say("R6-01.missing")),
        (f"NOT ({has(maker, V.RULE_ADDRESS)} OR {any_in(f'lower({maker})', V.MAKER_ADDRESS_WORDS)})", "REVIEW", say("R6-01.review", f"left({maker}, 60)")),
        ("true", "PASS", say("R6-01.pass", f"left({maker}, 80)")),
    ),
    "R6-02": chain(
        (f"{packer} = '' OR ({maker} <> '' AND lower({packer}) = lower({maker}))", None, ""),
        (f"NOT ({has(packer, V.RULE_ADDRESS)} OR {any_in(f'lower({packer})', V.PACKER_ADDRESS_WORDS)})", "REVIEW", say("R6-02.review", f"left({packer}, 60)")),
        ("true", "PASS", say("R6-02.pass", f"left({packer}, 80)")),
    ),
    "R6-03": chain(
        ("is_imported = false", None, ""),
        (f"is_imported AND {imp} = ''", "FAIL", say("R6-03.missing")),
        ("is_imported", "PASS", say("R6-03.pass", f"left({imp}, 80)")),
        (f"{imp} <> ''", "PASS", say("R6-03.pass", f"left({imp}, 60)")),
    ),
    "R6-04": chain(
        (f"{coo} = '' AND is_imported", "FAIL", say("R6-04.missing")),
        (f"{coo} = '' AND is_imported = false", None, ""),
        (f"{coo} = ''", "REVIEW", say("R6-04.unknown")),
        (f"NOT {any_in(f'lower({coo})', V.RULE_COUNTRIES)}", "REVIEW", say("R6-04.review", coo)),
        ("true", "PASS", say("R6-04.pass", coo)),
    ),
    "R6-05": chain(
        (f"{gen} = ''", "FAIL", say("R6-05.missing")),
        (f"len(regexp_split_to_array({gen}, '\\s+')) = 1 AND left({gen}, 1) BETWEEN 'A' AND 'Z' AND length({gen}) < 8 AND lower({gen}) NOT IN ({', '.join(q(c) for c in V.RULE_COMMODITIES)})",
         "REVIEW", say("R6-05.review", gen)),
        ("true", "PASS", say("R6-05.pass", gen)),
    ),
    "R6-06": chain(
        ("NOT coalesce(is_multi_product, false)", None, ""),
        (f"NOT {has(gen, V.MULTI_ITEM_LIST)}", "REVIEW", say("R6-06.review")),
        ("true", "PASS", say("R6-06.pass")),
    ),
    "R6-07": chain(
        (f"{qty} = ''", "FAIL", say("R6-07.missing")),
        (has(qty, V.RULE_MISLEADING), "REVIEW", say("R6-07.misleading", f"regexp_extract({qty}, {q(V.RULE_MISLEADING)}, 1)")),
        (f"NOT {has(qty, V.RULE_QUANTITY)}", "REVIEW", say("R6-07.review", qty)),
        ("true", "PASS", say("R6-07.pass", qty)),
    ),
    "R6-08": chain(
        (f"{mrp} = ''", "FAIL", say("R6-08.missing")),
        (f"NOT ({has(mrp, V.RULE_CURRENCY)} AND {has(mrp, '[0-9]')})", "REVIEW", say("R6-08.review", mrp)),
        ("true", "PASS", say("R6-08.pass", mrp)),
    ),
    "R6-09": chain(
        (f"{printed} AND NOT {has(bare_usp, V.RULE_UNIT_PRICE)}", "REVIEW", say("R6-09.format", bare_usp)),
        (f"{printed} AND length(regexp_extract({bare_usp}, '\\d+\\.(\\d+)', 1)) > 2", "REVIEW", say("R6-09.decimals", bare_usp)),
        (printed, "PASS", say("R6-09.pass", bare_usp)),
        (calc, "REVIEW", say("R6-09.calculated", bare_usp)),
        ('"primary" IS NOT NULL', "FAIL", say("R6-09.suggested", suggestion)),
        ("true", "FAIL", say("R6-09.missing")),
    ),
    "R6-10": chain(
        (f"{mfd} = ''", "FAIL", say("R6-10.missing")),
        (f"NOT {has(mfd, V.RULE_DATE)}", "FAIL", say("R6-10.format", mfd)),
        (has(mfd, V.EXPIRY_WORDS), "REVIEW", say("R6-10.review")),
        ("true", "PASS", say("R6-10.pass", mfd)),
    ),
    "R6-11": chain(
        (f"{bb} = '' AND NOT {has(mfd, V.EXPIRY_WORDS)}", None, ""),
        (f"{bb} = ''", "REVIEW", say("R6-11.review")),
        (f"NOT {has(bb, V.RULE_DATE)}", "FAIL", say("R6-11.format", bb)),
        ("true", "PASS", say("R6-11.pass", bb)),
    ),
    "R6-12": chain(
        (f"{care} = ''", "FAIL", say("R6-12.missing")),
        (f"NOT ({has(care, V.RULE_PHONE)} OR {has(care, V.RULE_EMAIL)})", "REVIEW", say("R6-12.review")),
        ("true", "PASS", say("R6-12.pass", f"left({care}, 80)")),
    ),
    "R6-13": chain(
        (f"NOT {any_in('lower(k_category)', V.DIMENSION_CATEGORIES)}", None, ""),
        (f"NOT {has(f'({gen} || {q(chr(32))} || {qty})', V.DIMENSION)}", "REVIEW", say("R6-13.review", "k_category")),
        ("true", "PASS", say("R6-13.pass")),
    ),
    "R6-14": chain(("true", "PASS", say("R6-14.pass", "CASE WHEN k_category = '' THEN 'General' ELSE k_category END"))),
    "R6-15": chain(
        ("NOT coalesce(is_gm_food, false)", None, ""),
        (f"{place} = ''", "REVIEW", say("R6-15.review")),
        (f"NOT contains(lower({place}), 'top')", "FAIL", say("R6-15.fail")),
        ("true", "PASS", say("R6-15.pass")),
    ),
    "R6-16": chain(
        (f"{veg} = ''", None, ""),
        (any_in(f"lower({veg})", V.VEG_WORDS), "PASS", say("R6-16.green")),
        (any_in(f"lower({veg})", V.NONVEG_WORDS), "PASS", say("R6-16.red")),
        ("true", "REVIEW", say("R6-16.review", veg)),
    ),
    "R6-17": chain(
        ("NOT coalesce(is_ecommerce, false)", None, ""),
        (f"({missing5}) > 0", "FAIL", say("R6-17.missing", f"CAST({missing5} AS VARCHAR)")),
        (f"is_imported AND {coo} = ''", "FAIL", say("R6-17.origin")),
        ("true", "PASS", say("R6-17.pass")),
    ),
    "RULE7": chain(
        ("font_height IS NULL", "REVIEW", say("RULE7.review")),
        (f"font_height < {TIER}", "FAIL", say("RULE7.fail", fx("font_height", 2), fx(TIER, 1))),
        ("true", "PASS", say("RULE7.pass", fx("font_height", 2), fx(TIER, 1))),
    ),
    "RULE8": chain(
        ("coalesce(placement, '') = ''", "REVIEW", say("RULE8.missing")),
        (any_in("upper(placement)", V.OFF_PANEL_WORDS), "REVIEW", say("RULE8.review", "placement")),
        ("true", "PASS", say("RULE8.pass", "placement")),
    ),
    "RULE9": chain(
        ("coalesce(readability, '') = ''", "REVIEW", say("RULE9.missing")),
        (any_in("upper(readability)", V.POOR_WORDS), "REVIEW", say("RULE9.poor")),
        (any_in("upper(readability)", V.FAIR_WORDS), "REVIEW", say("RULE9.fair", "readability")),
        ("true", "PASS", say("RULE9.pass", "readability")),
    ),
}


def define_judged(p: str, source: str, carry: str, mean: str = "token_confidence") -> None:
    """Blocks `{p}_rules` (long form) and `{p}_judged` for a block of records with an `insp_no`-like key in `carry`."""
    BLOCKS[f"{p}_known"] = (
        "SELECT *, " + ", ".join(f"{known(c)} AS k_{c}" for c in V.TEXT_FIELDS)
        + f", coalesce(category, '') AS k_category FROM ({usp_select(source, '*')})"
    )
    BLOCKS[f"{p}_rules"] = " UNION ALL ".join(
        f"SELECT {carry}, {i} AS rule_no, {q(rid)} AS rule_id, {q(name)} AS name, {RULE_SQL[rid][0]} AS status, {RULE_SQL[rid][1]} AS reason, {q(ref)} AS legal_ref FROM {p}_known"
        for i, (rid, name, ref) in enumerate(V.RULES, 1)
    )
    BLOCKS[f"{p}_judged"] = f"""
SELECT r.*, s.status AS status, CAST(s.score AS DOUBLE) AS score, s.violations AS violations, s.reviews AS reviews,
  {rnd(f'greatest(0.0, coalesce({mean}, 0.9) - s.reviews * 0.03::DOUBLE)', 4)} AS confidence, len(s.violations) AS violation_count
FROM {source} r JOIN (SELECT {carry}, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'REVIEW') THEN 'REVIEW' ELSE 'PASS' END AS status,
  {rnd("coalesce(CAST(count(*) FILTER (status = 'PASS') AS DOUBLE) / nullif(count(*) FILTER (status <> 'NOT_APPLICABLE'), 0), 0)", 4)} AS score,
  coalesce(list(name || ': ' || reason ORDER BY rule_no) FILTER (status IN ('FAIL', 'REVIEW')), []) AS violations, count(*) FILTER (status = 'REVIEW') AS reviews
  FROM {p}_rules GROUP BY ALL) s USING ({carry})"""


define_judged("dec", "declared", "insp_no")
for name, rid in {
    "r1_maker_address": "R6-01", "r2_packer": "R6-02", "r3_importer": "R6-03", "r4_origin": "R6-04", "r5_generic_name": "R6-05",
    "r6_multi_product": "R6-06", "r7_net_quantity": "R6-07", "r8_price": "R6-08", "r9_unit_price": "R6-09",
    "r10_manufacture_date": "R6-10", "r11_best_before": "R6-11", "r12_consumer_care": "R6-12", "r13_dimensions": "R6-13",
    "r14_category_gateway": "R6-14", "r15_gm_mark": "R6-15", "r16_veg_mark": "R6-16", "r17_ecommerce": "R6-17",
    "r18_font_height": "RULE7", "r19_placement": "RULE8", "r20_legibility": "RULE9",
}.items():
    ORACLE[name] = f"SELECT insp_no, {RULE_SQL[rid][0]} AS status, {RULE_SQL[rid][1]} AS reason FROM dec_known"
ORACLE["r21_font_tier"] = f"SELECT insp_no, {TIER} AS least_height FROM dec_known"
ORACLE["r22_all_rules"] = "SELECT insp_no, rule_no, rule_id, status, reason, legal_ref FROM dec_rules"
VIOLATIONS = "array_to_string(violations, ' | ') AS violations"
ORACLE["e1_compliance"] = f"SELECT insp_no, status, score, {VIOLATIONS} FROM dec_judged"
ORACLE["e1_compliance_from_rows"] = """
SELECT insp_no, p AS passed, fl AS failed, rv AS reviews, status, score FROM dec_judged JOIN (SELECT insp_no, count(*) FILTER (status = 'PASS') AS p,
  count(*) FILTER (status = 'FAIL') AS fl, count(*) FILTER (status = 'REVIEW') AS rv FROM dec_rules GROUP BY 1) USING (insp_no)"""
ORACLE["e2_confidence"] = "SELECT insp_no, confidence FROM dec_judged"
ORACLE["e15_missing_and_review_counts"] = f"SELECT insp_no, {missing5} AS missing, reviews FROM dec_known JOIN (SELECT insp_no, reviews FROM dec_judged) USING (insp_no)"

# ------------------------------------------------------------------ panels and packages


def merged(field: str, order: str = "panel_no") -> str:
    return f"arg_max({field}, {{'n': length(trim({field})), 'p': -{order}}}) FILTER ({field} <> '') AS {field}"


ORACLE["e11_panel_merge"] = (
    "SELECT user_no, " + ", ".join(merged(c, "insp_no") for c in V.TEXT_FIELDS) + ", "
    + ", ".join(f"CASE WHEN bool_or({c}) THEN true END AS {c}" for c in V.FLAG_FIELDS) + ", count(*) AS panel_count FROM declared GROUP BY 1"
)
ORACLE["u1_tokens_of_all_panels"] = (
    "SELECT insp_no, row_number() OVER (PARTITION BY insp_no ORDER BY panel_no, seq) AS token_no, panel_no, text FROM tokens"
)
REST = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in V.TEXT_FIELDS if c not in V.EXTRACTED_FIELDS) + ", " + ", ".join(
    f"CAST(NULL AS BOOLEAN) AS {c}" for c in V.FLAG_FIELDS
)
BLOCKS["lab_priced"] = filled_unit_price("lab_repaired")
BLOCKS["pack_merged"] = "SELECT insp_no, " + ", ".join(merged(c) for c in V.EXTRACTED_FIELDS) + " FROM one_priced GROUP BY 1"
BLOCKS["pack_priced"] = filled_unit_price("pack_merged")
BLOCKS["token_means"] = (
    f"SELECT insp_no, {exact_mean('c')} AS token_confidence FROM (SELECT insp_no, CASE WHEN confidence > 0 THEN confidence END AS c FROM recovered) GROUP BY 1"
)
BLOCKS["packages"] = f"""
SELECT o_orderkey AS insp_no, {q(V.DEFAULT_CATEGORY)} AS category, {', '.join(V.EXTRACTED_FIELDS)}, {REST}, readability, font_height, placement, token_confidence
FROM orders LEFT JOIN pack_priced ON o_orderkey = pack_priced.insp_no LEFT JOIN first_visuals ON o_orderkey = first_visuals.insp_no
LEFT JOIN token_means ON o_orderkey = token_means.insp_no"""
define_judged("pack", "packages", "insp_no")
ORACLE["p2_multi_panel_inspections"] = f"SELECT insp_no, {', '.join(V.EXTRACTED_FIELDS)}, status, score, confidence, {VIOLATIONS} FROM pack_judged"

# single panels: recovery, merge, lines, extraction, zone retry
BLOCKS["shaky"] = f"""
SELECT insp_no, panel_no FROM panels LEFT JOIN (SELECT insp_no, panel_no, count(*) AS n, {exact_mean('confidence')} AS m FROM tokens GROUP BY 1, 2) USING (insp_no, panel_no)
WHERE coalesce(n, 0) < 18 OR coalesce(m, 0) < 0.65"""
BLOCKS["second_needed"] = "SELECT s.* FROM second_pass s SEMI JOIN shaky USING (insp_no, panel_no)"
define_merge("rec", "tokens", "second_needed")
BLOCKS["recovered"] = (
    "SELECT insp_no, panel_no, row_number() OVER (PARTITION BY insp_no, panel_no ORDER BY source, seq) AS place, source, seq, text, confidence, x_min, y_min, x_max, y_max FROM rec_merged"
)
BLOCKS["kept_recovered"] = (
    "SELECT r.insp_no, r.panel_no, r.place AS seq, c.clean AS text, r.confidence, r.x_min, r.y_min, r.x_max, r.y_max"
    " FROM recovered r JOIN token_texts c ON r.text = c.raw WHERE r.confidence >= 0.34 AND c.clean <> ''"
)
define_lines("one", "kept_recovered")
define_fields("one", "one_lines", PANEL)
RETRIED = [name for name in V.RETRY_ZONES]
BLOCKS["one_retried"] = (
    "SELECT insp_no, panel_no, " + ", ".join(f"coalesce({c}, retry_{c}) AS {c}" for c in RETRIED) + ", "
    + ", ".join(c for c in V.EXTRACTED_FIELDS if c not in RETRIED)
    + " FROM (SELECT insp_no, panel_no FROM panels) LEFT JOIN one_repaired USING (insp_no, panel_no) "
    + " ".join(f"LEFT JOIN zone_{c} USING (insp_no, panel_no)" for c in RETRIED)
)
BLOCKS["one_priced"] = filled_unit_price("one_retried")
BLOCKS["one_means"] = (
    f"SELECT insp_no, panel_no, {exact_mean('c')} AS token_confidence FROM (SELECT insp_no, panel_no, CASE WHEN confidence > 0 THEN confidence END AS c FROM recovered) GROUP BY 1, 2"
)
BLOCKS["one_records"] = f"""
SELECT insp_no, panel_no, {q(V.DEFAULT_CATEGORY)} AS category, {', '.join(V.EXTRACTED_FIELDS)}, {REST}, readability, font_height, placement, token_confidence
FROM one_priced LEFT JOIN visuals USING (insp_no, panel_no) LEFT JOIN one_means USING (insp_no, panel_no)"""
define_judged("one", "one_records", "insp_no, panel_no")
ORACLE["p1_single_panel_inspections"] = f"SELECT insp_no, panel_no, {', '.join(V.EXTRACTED_FIELDS)}, status, score, confidence FROM one_judged"

REFUSED = (
    f"CASE WHEN n > 10 THEN 'batch too large' WHEN coalesce(content_type, '') <> '' AND content_type NOT IN ({', '.join(q(c) for c in V.ALLOWED_CONTENT_TYPES)}) THEN 'invalid type'"
    f" WHEN size_bytes = 0 THEN 'empty' WHEN size_bytes > {V.MAX_UPLOAD_BYTES} THEN 'too large' END"
)
BLOCKS["admission"] = f"SELECT file_no, batch_no, n AS batch_files, {REFUSED} AS reject_reason FROM (SELECT *, count(*) OVER (PARTITION BY batch_no) AS n FROM uploads)"
ORACLE["f17_upload_admission"] = "SELECT * FROM admission"
BLOCKS["batch_records"] = f"""
SELECT r.* FROM one_records r JOIN panels p USING (insp_no, panel_no) JOIN admission a ON p.pk = a.file_no WHERE a.reject_reason IS NULL"""
define_judged("batch", "batch_records", "insp_no, panel_no")
ORACLE["p3_batch_inspections"] = "SELECT insp_no, panel_no, status, score, confidence FROM batch_judged"
BLOCKS["corrected"] = """
SELECT * REPLACE ('250 g' AS net_quantity, '' AS manufacturer, CASE WHEN insp_no % 2 = 0 THEN 'Household' ELSE category END AS category,
  CASE WHEN insp_no % 4 = 0 THEN true ELSE is_ecommerce END AS is_ecommerce) FROM declared WHERE insp_no % 9 = 0"""
define_judged("cor", "corrected", "insp_no")
ORACLE["j9_override_merge"] = "SELECT insp_no, net_quantity, mrp, manufacturer, category, is_ecommerce, status, score FROM cor_judged"
ORACLE["p4_override_and_store"] = """
SELECT insp_no, status, score, confidence, net_quantity, 1 AS version FROM dec_judged WHERE insp_no % 9 <> 0
UNION ALL SELECT insp_no, status, score, confidence, net_quantity, 2 FROM cor_judged"""
BLOCKS["newest_events"] = "SELECT * FROM status_events QUALIFY row_number() OVER (PARTITION BY insp_no ORDER BY version DESC) = 1"


def measures_sql(source: str, by: str = "") -> str:
    c = exact_mean("confidence")
    return f"""
SELECT {by + ', ' if by else ''}count(*) AS total, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed,
  count(*) FILTER (status = 'REVIEW') AS review, coalesce({rnd("CAST(count(*) FILTER (status = 'PASS') AS DOUBLE) / nullif(count(*), 0) * 100", 1)}, 0.0) AS rate,
  CAST(coalesce(sum(violation_count), 0) AS BIGINT) AS violations, coalesce({rnd(f'({c}) * 100', 1)}, 0.0) AS confidence FROM {source} {'GROUP BY ' + by if by else ''}"""


BLOCKS["after_corrections"] = """
SELECT * FROM (SELECT insp_no, status, confidence, len(violations) AS violation_count FROM dec_judged WHERE insp_no % 9 <> 0
UNION ALL SELECT insp_no, status, confidence, len(violations) FROM cor_judged) WHERE insp_no % 4 <> 1"""
BLOCKS["dated_events"] = "SELECT *, strftime(created_at, '%Y-%m-%d') AS day FROM newest_events"
ORACLE["p5_live_kpis"] = measures_sql("dated_events", "day")

# ------------------------------------------------------------------ store
BLOCKS["rec"] = """
SELECT *, 'INS-' || strftime(created_at, '%Y%m%d') || '-' || upper(left(sha256(CAST(insp_no AS VARCHAR)), 6)) AS inspection_id FROM dec_judged"""
BLOCKS["kept"] = """
SELECT *, CASE WHEN insp_no % 3 <> 0 THEN CAST(user_no AS VARCHAR) END AS user_id, CAST(user_no AS VARCHAR) AS inspector_id,
  CASE WHEN insp_no % 4 <> 0 THEN '/api/uploads/' || insp_no || '.jpg' END AS image_url,
  CASE WHEN insp_no % 5 = 0 THEN '/api/uploads/o' || insp_no || '.png' END AS annotated_image_url,
  CASE WHEN insp_no % 6 = 0 THEN [] ELSE list_transform(range(1, insp_no % 6 + 1), lambda i: '/api/uploads/' || insp_no || '_' || i || '.jpg') END AS image_urls FROM rec"""
ORACLE["s1_scan_records"] = "SELECT inspection_id, status, product_name, mrp, placement, score FROM kept"
ORACLE["s2_stored_tokens"] = """
SELECT inspection_id, i AS token_no, 'w' || i AS text, coalesce(token_confidence, 0.5::DOUBLE) / i AS confidence, CAST(i * 10.0 AS DOUBLE) AS x_min, 5.0::DOUBLE AS y_min,
  CAST(i * 10.0 + 8 AS DOUBLE) AS x_max, 25.0::DOUBLE AS y_max FROM (SELECT *, unnest(range(1, token_count + 2)) AS i FROM kept)"""
ORACLE["s3_rule_rows"] = "SELECT rule_id, status, count(*) AS n FROM dec_rules GROUP BY 1, 2"
ORACLE["s4_append_and_read_back"] = "SELECT inspection_id, status, score, net_quantity, placement, violation_count FROM kept"
ORACLE["s5_upsert_newest_version"] = "SELECT insp_no, version, status, violation_count FROM newest_events"
ORACLE["s6_delete_owned"] = "SELECT insp_no, user_no FROM declared WHERE NOT (insp_no % 2 = 0 AND user_no = 7)"
ORACLE["s6_deleted_count"] = "SELECT count(*) AS deleted FROM declared WHERE insp_no % 2 = 0"
ORACLE["s8_required_declarations"] = " UNION ALL ".join(
    f"SELECT {q(n)} AS field, {q(label)} AS label, count(*) AS missing FROM declared WHERE {known(n)} = '' HAVING count(*) > 0" for n, label, _, _ in V.DECLARATIONS
)
ORACLE["f7_record_normalization"] = """
SELECT inspection_id, coalesce(user_id, inspector_id) AS user_id, annotated_image_url,
  array_to_string(CASE WHEN len(image_urls) > 0 THEN image_urls WHEN image_url IS NOT NULL THEN [image_url] ELSE [] END, ' | ') AS image_urls,
  coalesce(annotated_image_url, '') AS annotated_image_urls FROM kept"""

# ------------------------------------------------------------------ search
ORACLE["f8_status_filter"] = "SELECT insp_no, status FROM rec WHERE status = 'REVIEW'"
ORACLE["f8b_inspector_filter"] = "SELECT insp_no, user_no FROM rec WHERE user_no = 11"
BLOCKS["owners"] = """
SELECT insp_no, CASE WHEN insp_no % 3 <> 0 THEN printf('00000000-0000-0000-0000-%012d', CAST(user_no AS BIGINT)) END AS user_id,
  CASE WHEN insp_no % 2 = 0 THEN 'i' || CAST(user_no % 5 AS VARCHAR) ELSE '' END AS inspector_id FROM rec"""
ORACLE["f8b_inspector_or_owner"] = """
SELECT insp_no, 'account' AS form FROM owners WHERE user_id = '00000000-0000-0000-0000-000000000011'
UNION ALL SELECT insp_no, 'no account' FROM owners
UNION ALL SELECT insp_no, 'inspector' FROM owners WHERE inspector_id = 'i3' OR (inspector_id = '' AND user_id = 'i3')
UNION ALL SELECT insp_no, 'owner' FROM owners WHERE inspector_id = '' AND user_id = '00000000-0000-0000-0000-000000000011'"""
ORACLE["f9_name_wildcard_search"] = "SELECT insp_no, product_name FROM rec WHERE product_name ILIKE '%duct_1%'"
ORACLE["f9_name_or_id_search"] = (
    "SELECT insp_no, product_name FROM rec WHERE contains(lower(coalesce(product_name, '')), 'ct 1') OR contains(lower(inspection_id), 'ct 1')"
)
ORACLE["f10_history_search"] = (
    "SELECT insp_no, product_name, status FROM rec WHERE status = 'FAIL' AND contains(lower(inspection_id || ' ' || coalesce(product_name, '') || ' ' || coalesce(CAST(user_no AS VARCHAR), '')), 'product 3')"
)
ORACLE["f9_indexed_wildcard_search"] = " UNION ALL ".join(
    f"SELECT '{p}' AS search, insp_no, product_name FROM rec WHERE product_name ILIKE '%{p}%'" for p in ("duct_1", "prod%t 12", "9_")
)
ORACLE["f9_indexed_name_or_id_search"] = ORACLE["f9_name_or_id_search"]
ORACLE["f10_indexed_history_search"] = ORACLE["f10_history_search"]
ORACLE["f11_owner_rows"] = "SELECT inspection_id, user_id FROM kept WHERE user_id = '7' OR inspector_id = '7'"
ORACLE["f12_uuid_owner"] = """
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN left(h, 8) || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] END AS owner
FROM (SELECT *, md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer)"""
ORACLE["f13_point_lookup"] = "SELECT insp_no, inspection_id, status FROM rec WHERE insp_no = (SELECT min(insp_no) FROM rec WHERE user_no = 7)"
ORACLE["f13_lookup_in_log"] = """
SELECT asked_by, insp_no, inspection_id, CASE WHEN user_no = 7 AND place = 2 THEN 'PASS' ELSE status END AS status,
  CASE WHEN user_no = 7 AND place = 2 THEN 2 ELSE 1 END AS version
FROM (SELECT *, row_number() OVER (PARTITION BY user_no = 7 ORDER BY insp_no) AS place FROM rec) AS r
CROSS JOIN (SELECT unnest(['owner', 'administrator']) AS asked_by) AS a
WHERE (user_no = 7 AND place <= 2) OR (asked_by = 'administrator' AND user_no <> 7 AND place = 1)"""
ROLE = "CASE WHEN lower(trim(coalesce(raw_role, 'inspector'))) IN ('admin', 'administrator') THEN 'admin' ELSE 'inspector' END"
ORACLE["f14_roles"] = f"SELECT user_no, {ROLE} AS role, lower(coalesce(raw_role, '')) IN ('admin', 'administrator') AS admin FROM user_profiles"
PLACEHOLDERS = ", ".join(q(n) for n in V.PLACEHOLDER_NAMES)
tidy = "trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
readable = tidy.format(c="regexp_replace(split_part(email, '@', 1), '[._-]+', ' ', 'g')")
ORACLE["f15_display_names"] = f"""
SELECT user_no, coalesce(full_name, split_part(email, '@', 1), 'Enforcement Officer') AS profile_name,
  CASE WHEN {tidy.format(c='full_name')} <> '' AND lower({tidy.format(c='full_name')}) NOT IN ({PLACEHOLDERS}) THEN {tidy.format(c='full_name')}
    WHEN {readable} <> '' AND lower({readable}) NOT IN ({PLACEHOLDERS}) THEN array_to_string(list_transform(string_split({readable}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')
    WHEN lower(coalesce(raw_role, '')) IN ('admin', 'administrator') THEN 'Admin' ELSE 'User' END AS display_name FROM user_profiles"""
stem = "replace(regexp_replace(filename, '\\.[^.]*$', ''), '_', ' ')"
ORACLE["f16_product_names"] = f"SELECT file_no, {title(stem)} AS product FROM uploads"
ORACLE["w7_page"] = "SELECT inspection_id, created_at, status FROM rec WHERE status = 'FAIL' ORDER BY created_at DESC, inspection_id LIMIT 20 OFFSET 40"
ORACLE["w7_page_after_row"] = """
SELECT inspection_id, created_at, status FROM rec WHERE status = 'FAIL' AND (created_at < TIMESTAMP '1997-01-01' OR (created_at = TIMESTAMP '1997-01-01' AND inspection_id > ''))
ORDER BY created_at DESC, inspection_id LIMIT 20"""
ORACLE["w7_total"] = "SELECT count(*) AS total FROM rec WHERE status = 'FAIL'"

# ------------------------------------------------------------------ accounts
BLOCKS["stored_profiles"] = f"SELECT user_no, full_name, CASE WHEN user_no % 10 <> 3 THEN {ROLE} END AS role FROM user_profiles WHERE has_profile"
ORACLE["j2_profile_lookup"] = """
SELECT u.user_no AS user_no, email, CASE WHEN p.user_no IS NOT NULL THEN p.full_name ELSE coalesce(u.full_name, 'Inspector') END AS full_name,
  CASE WHEN r IN ('admin', 'inspector', 'user') THEN r ELSE 'inspector' END AS role
FROM (SELECT u.*, CASE WHEN p.user_no IS NOT NULL THEN p.role ELSE coalesce(raw_role, 'inspector') END AS r FROM user_profiles u LEFT JOIN stored_profiles p ON u.user_no = p.user_no) u
LEFT JOIN stored_profiles p ON u.user_no = p.user_no"""
BLOCKS["made_profiles"] = f"SELECT user_no, coalesce(full_name, split_part(email, '@', 1), 'Enforcement Officer') AS full_name, {ROLE} AS role FROM user_profiles"
ORACLE["j3_profile_backfill"] = (
    "SELECT user_no, full_name, role FROM stored_profiles UNION ALL SELECT user_no, full_name, role FROM made_profiles WHERE user_no NOT IN (SELECT user_no FROM stored_profiles)"
)
ORACLE["j4_profile_upsert"] = (
    "SELECT user_no, coalesce(p.full_name, m.full_name) AS full_name, coalesce(p.role, m.role) AS role FROM stored_profiles p FULL JOIN made_profiles m USING (user_no)"
)
ORACLE["j5_unknown_owner"] = "SELECT insp_no, CASE WHEN user_no IN (SELECT user_no FROM stored_profiles) THEN user_no END AS user_no FROM declared"
ORACLE["j6_owner_backfill"] = "SELECT inspection_id, coalesce(user_id, inspector_id) AS user_id, inspector_id FROM kept"
ORACLE["j7_batch_merge"] = "SELECT insp_no, version, status FROM newest_events"
ORACLE["u4_rows_not_in_batch"] = "SELECT insp_no, version, status FROM status_events WHERE version = 1 AND insp_no NOT IN (SELECT insp_no FROM status_events WHERE version = 2)"

# ------------------------------------------------------------------ analytics
ALIASES = ", ".join(
    f'{m} AS "{k}"' for k, m in {
        "total_inspections": "total", "total": "total", "compliant_count": "passed", "compliant": "passed", "pass_count": "passed",
        "violations_count": "failed", "non_compliant": "failed", "fail_count": "failed", "review_count": "review", "review": "review",
        "compliance_rate_pct": "rate", "compliance_rate": "rate", "total_violations_flagged": "violations", "recent_alerts": "violations",
        "average_confidence": "confidence", "confidence": "confidence",
    }.items()
)
ORACLE["e3_dashboard"] = f"SELECT {ALIASES} FROM ({measures_sql('rec')})"
ORACLE["p4_dashboard_after_corrections"] = f"SELECT {ALIASES} FROM ({measures_sql('after_corrections')})"
ORACLE["e4_client_stats"] = """
SELECT count(*) AS total, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'REVIEW') AS review,
  CAST(count(*) FILTER (status = 'PASS') AS DOUBLE) / count(*) * 100 AS rate, CAST(sum(violation_count) AS BIGINT) AS alerts FROM rec"""
ORACLE["e4_normalized_stats"] = f'SELECT total, passed AS "pass", failed AS "fail", review, rate, violations AS alerts FROM ({measures_sql("rec")})'
BLOCKS["flagged"] = "SELECT r.*, inspection_id, created_at FROM dec_rules r JOIN rec USING (insp_no) WHERE r.status IN ('FAIL', 'REVIEW')"
ORACLE["e5_rule_counts"] = 'SELECT name, count(*) AS "count" FROM flagged GROUP BY 1'
ORACLE["w8_most_violated_rules"] = """
SELECT rule, "count" FROM (SELECT name AS rule, count(*) AS "count", min({'t': -epoch_us(created_at), 'i': inspection_id, 'r': rule_no}) AS f FROM flagged GROUP BY 1)
ORDER BY "count" DESC, f LIMIT 8"""
ORACLE["w9_recent_violations"] = """
SELECT inspection_id, pos, violation FROM (SELECT inspection_id, created_at, unnest(range(0, len(violations))) AS pos, unnest(violations) AS violation FROM rec)
ORDER BY created_at DESC, inspection_id, pos LIMIT 8"""
ORACLE["e6_by_category"] = f"""
SELECT category, n AS "count", CAST(floor(CAST(n AS DOUBLE) / sum(n) OVER () * 100 + 0.5) AS BIGINT) AS percent FROM (
  SELECT coalesce(nullif(category, ''), {q(V.DEFAULT_CATEGORY)}) AS category, count(*) AS n FROM declared GROUP BY 1)"""
ORACLE["e7_outcomes"] = """
SELECT insp_no, count(*) FILTER (status = 'PASS') AS obeyed, count(*) FILTER (status = 'FAIL') AS not_obeyed, count(*) FILTER (status NOT IN ('PASS', 'FAIL')) AS review FROM dec_rules GROUP BY 1"""
ABSENT = "({c} IS NULL OR trim({c}) = '' OR regexp_matches({c}, " + q(V.CLAUSE_ABSENT) + "))"
BLOCKS["clause_rows"] = " UNION ALL ".join(
    f"SELECT insp_no, status, violations, {i} AS n, {q(clause)} AS clause, {q(name)} AS name, NOT {ABSENT.format(c=field)} AS ok, {q(reason)} AS bad, 'Declared and verified on packaging' AS good FROM rec"
    for i, (field, clause, name, reason) in enumerate(V.CLAUSES, 1)
) + f"""
UNION ALL SELECT insp_no, status, violations, 9, 'Rule 7', {q(V.FONT_CLAUSE[1])}, font_height >= 1.0,
  'Font height ' || h || ' mm is below statutory 1.0 mm minimum.', 'Compliant height: ' || h || ' mm (≥ 1.0 mm)'
FROM (SELECT *, regexp_replace(CAST(font_height AS VARCHAR), '\\.0$', '') AS h FROM rec WHERE font_height <> 0)"""
# a violation text is added unless a listed failure, or the clause text of one, already covers it; an added
# text covers later equal texts and any text containing 'infringement'
BLOCKS["extra_rows"] = """
SELECT insp_no, status, 100 + row_number() OVER (PARTITION BY insp_no ORDER BY pos) AS n, v AS name FROM (
  SELECT r.insp_no, r.status, pos, v FROM (SELECT insp_no, status, unnest(range(1, len(violations) + 1)) AS pos, unnest(violations) AS v FROM rec) r
  WHERE NOT EXISTS (SELECT 1 FROM clause_rows c WHERE c.insp_no = r.insp_no AND NOT c.ok AND (contains(lower(c.name), lower(v)) OR contains(lower(v), lower(c.clause)))))"""
BLOCKS["all_outcomes"] = """
SELECT insp_no, status, n, name, CASE WHEN ok THEN good ELSE bad END AS reason, CASE WHEN ok THEN 'obeyed' ELSE 'not_obeyed' END AS outcome FROM clause_rows
UNION ALL SELECT insp_no, status, n, name, 'Statutory violation flagged during inspection', 'not_obeyed' FROM extra_rows"""
ORACLE["e7_outcomes_without_rules"] = """
SELECT insp_no, row_number() OVER (PARTITION BY insp_no ORDER BY n) AS rule_no, name, reason,
  CASE WHEN status = 'REVIEW' AND n = min(CASE WHEN outcome = 'not_obeyed' THEN n END) OVER (PARTITION BY insp_no) THEN 'review' ELSE outcome END AS outcome FROM all_outcomes"""
buckets = " ".join(f"WHEN {has('name', p)} THEN {i}" for i, (_, p) in enumerate(V.VIOLATION_BUCKETS, 1) if p)
ORACLE["e8_violation_buckets"] = f"""
SELECT bucket_no, bucket, coalesce(n, 0) AS "count", CAST(floor(CAST(coalesce(n, 0) AS DOUBLE) / greatest(max(coalesce(n, 0)) OVER (), 1) * 100 + 0.5) AS BIGINT) AS percent
FROM (VALUES {', '.join(f'({i}, {q(b)})' for i, (b, _) in enumerate(V.VIOLATION_BUCKETS, 1))}) s(bucket_no, bucket)
LEFT JOIN (SELECT CASE {buckets} ELSE {len(V.VIOLATION_BUCKETS)} END AS bucket_no, count(*) AS n FROM dec_rules WHERE status = 'FAIL' GROUP BY 1) USING (bucket_no)"""


def pct(c: str) -> str:
    return f"least(100, greatest(0, CAST(floor(CASE WHEN {c} <= 1 THEN {c} * 100 ELSE {c} END + 0.5) AS BIGINT)))"


ORACLE["e9_shown_score_and_confidence"] = f"""
SELECT insp_no, CASE WHEN insp_no % 2 = 1 THEN {pct('score')} ELSE CAST(floor(CAST(ob AS DOUBLE) / n * 100 + 0.5) AS BIGINT) END AS score,
  CASE WHEN insp_no % 2 = 1 THEN {pct('confidence')} ELSE coalesce(CAST(floor(token_confidence * 100 + 0.5) AS BIGINT), 0) END AS confidence
FROM rec JOIN (SELECT insp_no, count(*) AS n, count(*) FILTER (status = 'PASS') AS ob FROM dec_rules GROUP BY 1) USING (insp_no)"""
ORACLE["f29_percentages"] = (
    f"SELECT event_id, CASE WHEN event_id % 7 <> 0 AND value IS NOT NULL THEN {pct('(value / 10)')} END AS percent FROM events"
)
ORACLE["f30_bands"] = f"""
SELECT insp_no, CASE WHEN s >= 80 THEN 'compliant' WHEN s >= 50 THEN 'needs review' ELSE 'non-compliant' END AS score_band,
  CASE WHEN c >= 80 THEN 'High Certainty' WHEN c >= 60 THEN 'Moderate' ELSE 'Low Certainty' END AS confidence_band
FROM (SELECT insp_no, {pct('score')} AS s, {pct('confidence')} AS c FROM rec)"""

# ------------------------------------------------------------------ reports
ORACLE["s9_declaration_audit"] = " UNION ALL ".join(
    f"SELECT insp_no, {i} AS row_no, {q(label)} AS label, coalesce(nullif({c}, ''), 'MISSING') AS \"value\","
    f" CASE WHEN lower(coalesce(nullif({c}, ''), 'missing')) IN ('missing', 'none', 'null') THEN 'NON-COMPLIANT' ELSE 'VERIFIED' END AS audit FROM rec"
    for i, (label, c) in enumerate(V.CERTIFICATE_ROWS, 1)
)
ORACLE["s10_certificate_head"] = f"""
SELECT insp_no, coalesce(nullif(product_name, ''), 'N/A') AS product, coalesce(nullif(category, ''), 'FMCG / Packaged') AS category,
  CASE status WHEN 'PASS' THEN 'COMPLIANT (PASS)' WHEN 'FAIL' THEN 'NON-COMPLIANT (FAIL)' ELSE 'UNDER REVIEW' END AS status_text,
  coalesce(readability, 'N/A') AS readability, CASE WHEN coalesce(font_height, 0) <> 0 THEN {fx('font_height', 2)} || ' mm' ELSE 'Pending Calibration' END AS font_height,
  coalesce(placement, 'Standard Display Panel') AS placement FROM rec"""
BLOCKS["numbered"] = "SELECT insp_no, unnest(range(1, len(violations) + 1)) AS violation_no, unnest(violations) AS violation FROM rec"
ORACLE["s10_numbered_violations"] = "SELECT * FROM numbered"
ORACLE["s11_evidence_images"] = (
    "SELECT inspection_id, array_to_string((CASE WHEN len(image_urls) > 0 THEN image_urls WHEN image_url IS NOT NULL THEN [image_url] ELSE [] END)[1:4], ' | ') AS evidence FROM kept"
)
ORACLE["s12_export_fields"] = " UNION ALL ".join(
    [f"SELECT insp_no, {q(c.replace('_', ' ').upper())} AS label, {c} AS \"value\" FROM rec WHERE {c} <> ''" for c in V.TEXT_FIELDS]
    + [f"SELECT insp_no, {q(c.replace('_', ' ').upper())}, 'true' FROM rec WHERE {c}" for c in V.FLAG_FIELDS]
)
ORACLE["f28_violation_parts"] = """
SELECT insp_no, violation_no, CASE WHEN contains(violation, ':') THEN trim(split_part(violation, ':', 1)) END AS title,
  CASE WHEN contains(violation, ':') THEN trim(violation[strpos(violation, ':') + 1:]) ELSE violation END AS detail FROM numbered"""
ORACLE["f31_trusted_urls"] = """
SELECT page_id, address, CASE WHEN starts_with(address, '/api/uploads/') THEN t <> '' AND NOT contains(t, '..') AND NOT starts_with(t, '/')
    AND len(list_filter(string_split(t, '/'), lambda s: starts_with(s, '.') AND s <> '.')) = 0
  ELSE regexp_matches(address, '^https://store\\.example\\.com/storage/v1/object/(public|sign)/label-pictures/') AND NOT regexp_matches(address, '#.')
    AND (regexp_matches(address, '^[^?]*/sign/') OR NOT regexp_matches(address, '\\?.')) END AS trusted
FROM (SELECT *, substr(address, 14) AS t FROM (SELECT page_id, unnest([url,
  'https://store.example.com/storage/v1/object/' || ['public/label-pictures/', 'sign/label-pictures/', 'public/other/', 'private/label-pictures/'][page_id % 4 + 1] || tail,
  '/api/uploads/' || CASE page_id % 3 WHEN 0 THEN '../' WHEN 1 THEN '.x/' ELSE '' END || tail]) AS address
  FROM (SELECT *, regexp_replace(url, '^https?://[^/]*/', '') AS tail FROM pages)))"""


# ------------------------------------------------------------------ assembly
def build(sql: str) -> str:
    """The query with every block it uses, directly or indirectly, as common table expressions."""
    order: list[str] = []

    def visit(text: str, seen: tuple[str, ...] = ()) -> None:
        for name in re.findall(r"[a-z_0-9]+", re.sub(r"'(?:[^']|'')*'", "''", text)):
            if name in BLOCKS and name not in seen and name not in order:
                visit(BLOCKS[name], (*seen, name))
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    head = "WITH RECURSIVE " if any(n in RECURSIVE for n in order) else "WITH "
    return head + ",\n".join(f"{n} AS ({BLOCKS[n]})" for n in order) + "\n" + sql


def oracle_queries() -> dict[str, str]:
    return {name: build(sql) for name, sql in ORACLE.items()}
