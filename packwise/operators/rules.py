"""The twenty statutory rules.

`rule_results` is one array expression over a record's columns: the rules never
shuffle.  Each rule is a chain of `when`s that yields struct<status, reason>; a
chain without a match means the rule does not apply.

A record has the columns of `fixed_values.TEXT_FIELDS` and `FLAG_FIELDS`, plus
`readability`, `font_height`, `placement` and `category`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import declared, fill, fixed, has_any, known, match, strip
from ..functions.units import suggested_unit_price

PASS, FAIL, REVIEW, NA = "PASS", "FAIL", "REVIEW", "NOT_APPLICABLE"
RESULT_TYPE = "struct<status:string,reason:string>"


def _say(status: str, key: str, *values: Column) -> Column:
    template = V.REASONS[key]
    reason = fill(template, *values) if values else F.lit(template)
    return F.struct(F.lit(status).alias("status"), reason.alias("reason"))


def _first(*cases: tuple[Column, Column | None]) -> Column:
    """The outcome of the first true condition; None and no match stand for 'not applicable'."""
    na = F.struct(F.lit(NA).alias("status"), F.lit(None).cast("string").alias("reason"))
    chain = F
    for condition, outcome in cases:
        chain = chain.when(condition, na if outcome is None else outcome)
    return chain.otherwise(na)



def maker_address() -> Column:
    v = F.col("k_manufacturer")
    addressed = v.rlike(V.RULE_ADDRESS) | has_any(F.lower(v), V.MAKER_ADDRESS_WORDS)
    return _first(
        (v == "", _say(FAIL, "R6-01.missing")),
        (~addressed, _say(REVIEW, "R6-01.review", F.left(v, F.lit(60)))),
        (F.lit(True), _say(PASS, "R6-01.pass", F.left(v, F.lit(80)))),
    )


def packer_address() -> Column:
    v, maker = F.col("k_packer"), F.col("k_manufacturer")
    addressed = v.rlike(V.RULE_ADDRESS) | has_any(F.lower(v), V.PACKER_ADDRESS_WORDS)
    return _first(
        ((v == "") | ((maker != "") & (F.lower(v) == F.lower(maker))), None),
        (~addressed, _say(REVIEW, "R6-02.review", F.left(v, F.lit(60)))),
        (F.lit(True), _say(PASS, "R6-02.pass", F.left(v, F.lit(80)))),
    )


def importer() -> Column:
    v, imported = F.col("k_importer"), F.col("is_imported")
    return _first(
        (imported == F.lit(False), None),
        (imported & (v == ""), _say(FAIL, "R6-03.missing")),
        (imported, _say(PASS, "R6-03.pass", F.left(v, F.lit(80)))),
        (v != "", _say(PASS, "R6-03.pass", F.left(v, F.lit(60)))),
    )


def origin() -> Column:
    v, imported = F.col("k_country_of_origin"), F.col("is_imported")
    return _first(
        ((v == "") & imported, _say(FAIL, "R6-04.missing")),
        ((v == "") & (imported == F.lit(False)), None),
        (v == "", _say(REVIEW, "R6-04.unknown")),
        (~has_any(F.lower(v), V.RULE_COUNTRIES), _say(REVIEW, "R6-04.review", v)),
        (F.lit(True), _say(PASS, "R6-04.pass", v)),
    )


def generic_name() -> Column:
    v = F.col("k_generic_name")
    # a single short capitalized word that is not a commodity looks like a brand
    brand = (
        ~v.rlike(r"\s")
        & v.rlike(r"^\p{Lu}")
        & (F.length(v) < 8)
        & ~F.lower(v).isin(V.RULE_COMMODITIES)
    )
    return _first(
        (v == "", _say(FAIL, "R6-05.missing")),
        (brand, _say(REVIEW, "R6-05.review", v)),
        (F.lit(True), _say(PASS, "R6-05.pass", v)),
    )


def multi_product() -> Column:
    listed = F.col("k_generic_name").rlike(V.MULTI_ITEM_LIST)
    return _first(
        (~F.coalesce(F.col("is_multi_product"), F.lit(False)), None),
        (~listed, _say(REVIEW, "R6-06.review")),
        (F.lit(True), _say(PASS, "R6-06.pass")),
    )


def net_quantity() -> Column:
    v = F.col("k_net_quantity")
    return _first(
        (v == "", _say(FAIL, "R6-07.missing")),
        (v.rlike(V.RULE_MISLEADING), _say(REVIEW, "R6-07.misleading", match(v, V.RULE_MISLEADING, 1))),
        (~v.rlike(V.RULE_QUANTITY), _say(REVIEW, "R6-07.review", v)),
        (F.lit(True), _say(PASS, "R6-07.pass", v)),
    )


def price() -> Column:
    v = F.col("k_mrp")
    return _first(
        (v == "", _say(FAIL, "R6-08.missing")),
        (~(v.rlike(V.RULE_CURRENCY) & v.rlike(r"\d+")), _say(REVIEW, "R6-08.review", v)),
        (F.lit(True), _say(PASS, "R6-08.pass", v)),
    )


def unit_price() -> Column:
    raw, category = F.col("k_unit_sale_price"), F.lower(F.col("k_category"))
    calculated = raw.rlike(V.CALCULATED_MARK)
    v = strip(F.regexp_replace(raw, V.CALCULATED_MARK, ""))
    # "l" alone counts as a liquid word, so any quantity with the letter l is a liquid
    liquid = has_any(F.lower(F.col("k_net_quantity")), V.LIQUID_WORDS) | category.contains("beverage")
    suggestion = F.col("suggestion")
    text = F.when(
        liquid, F.concat(suggestion["primary"], F.lit(" (or "), suggestion["secondary"], F.lit(")"))
    ).otherwise(suggestion["primary"])
    printed = (v != "") & ~calculated
    return _first(
        (printed & ~v.rlike(V.RULE_UNIT_PRICE), _say(REVIEW, "R6-09.format", v)),
        # only the first decimal fraction counts
        (printed & (F.length(F.regexp_extract(v, r"\d+\.(\d+)", 1)) > 2), _say(REVIEW, "R6-09.decimals", v)),
        (printed, _say(PASS, "R6-09.pass", v)),
        (calculated, _say(REVIEW, "R6-09.calculated", v)),
        (suggestion.isNotNull(), _say(FAIL, "R6-09.suggested", text)),
        (F.lit(True), _say(FAIL, "R6-09.missing")),
    )


def manufacture_date() -> Column:
    v = F.col("k_manufacture_date")
    return _first(
        (v == "", _say(FAIL, "R6-10.missing")),
        (~v.rlike(V.RULE_DATE), _say(FAIL, "R6-10.format", v)),
        (v.rlike(V.EXPIRY_WORDS), _say(REVIEW, "R6-10.review")),
        (F.lit(True), _say(PASS, "R6-10.pass", v)),
    )


def best_before() -> Column:
    v, hinted = F.col("k_best_before"), F.col("k_manufacture_date").rlike(V.EXPIRY_WORDS)
    return _first(
        ((v == "") & ~hinted, None),
        (v == "", _say(REVIEW, "R6-11.review")),
        (~v.rlike(V.RULE_DATE), _say(FAIL, "R6-11.format", v)),
        (F.lit(True), _say(PASS, "R6-11.pass", v)),
    )


def consumer_care() -> Column:
    v = F.col("k_consumer_care")
    return _first(
        (v == "", _say(FAIL, "R6-12.missing")),
        (~(v.rlike(V.RULE_PHONE) | v.rlike(V.RULE_EMAIL)), _say(REVIEW, "R6-12.review")),
        (F.lit(True), _say(PASS, "R6-12.pass", F.left(v, F.lit(80)))),
    )


def dimensions() -> Column:
    category = F.col("k_category")
    text = F.concat_ws(" ", F.col("k_generic_name"), F.col("k_net_quantity"))
    return _first(
        (~has_any(F.lower(category), V.DIMENSION_CATEGORIES), None),
        (~text.rlike(V.DIMENSION), _say(REVIEW, "R6-13.review", category)),
        (F.lit(True), _say(PASS, "R6-13.pass")),
    )


def commodity_gateway() -> Column:
    category = F.coalesce(F.nullif(F.col("k_category"), F.lit("")), F.lit("General"))
    return _say(PASS, "R6-14.pass", category)


def gm_mark() -> Column:
    place = known(F.col("placement"))
    return _first(
        (~F.coalesce(F.col("is_gm_food"), F.lit(False)), None),
        (place == "", _say(REVIEW, "R6-15.review")),
        (~F.lower(place).contains("top"), _say(FAIL, "R6-15.fail")),
        (F.lit(True), _say(PASS, "R6-15.pass")),
    )


def veg_mark() -> Column:
    v = F.col("k_veg_nonveg_mark")
    low = F.lower(v)
    return _first(
        (v == "", None),
        (has_any(low, V.VEG_WORDS), _say(PASS, "R6-16.green")),  # "non-veg" contains "veg" and ends here
        (has_any(low, V.NONVEG_WORDS), _say(PASS, "R6-16.red")),
        (F.lit(True), _say(REVIEW, "R6-16.review", v)),
    )


ECOMMERCE_FIELDS = ["manufacturer", "generic_name", "net_quantity", "mrp", "consumer_care"]


def missing_count() -> Column:
    """How many of the five fields an online listing needs are missing."""
    total = F.lit(0)
    for f in ECOMMERCE_FIELDS:
        total = total + (F.col(f"k_{f}") == "").cast("int")
    return total


def ecommerce() -> Column:
    gone = missing_count()
    return _first(
        (~F.coalesce(F.col("is_ecommerce"), F.lit(False)), None),
        (gone > 0, _say(FAIL, "R6-17.missing", gone.cast("string"))),
        (F.col("is_imported") & (F.col("k_country_of_origin") == ""), _say(FAIL, "R6-17.origin")),
        (F.lit(True), _say(PASS, "R6-17.pass")),
    )


def least_font_height(quantity: Column) -> Column:
    """Minimum letter height in mm for a declared quantity (counts use the gram tiers)."""
    number = match(quantity, V.RULE_QUANTITY, 1).try_cast("double")
    kilo = F.lower(match(quantity, V.RULE_QUANTITY, 2)).isin(V.KILO_UNITS)
    amount = F.when(kilo, number * 1000.0).otherwise(number)
    chain = F.when(amount.isNull(), F.lit(1.0))
    for bound, height in V.FONT_TIERS[:-1]:
        chain = chain.when(amount <= bound, F.lit(height))
    return chain.otherwise(F.lit(V.FONT_TIERS[-1][1]))


def font_height() -> Column:
    h, least = F.col("font_height"), F.col("least_height")
    return _first(
        (h.isNull(), _say(REVIEW, "RULE7.review")),
        (h < least, _say(FAIL, "RULE7.fail", fixed(h, 2), fixed(least, 1))),
        (F.lit(True), _say(PASS, "RULE7.pass", fixed(h, 2), fixed(least, 1))),
    )


def placement() -> Column:
    v = F.coalesce(F.col("placement"), F.lit(""))
    return _first(
        (v == "", _say(REVIEW, "RULE8.missing")),
        (has_any(F.upper(v), V.OFF_PANEL_WORDS), _say(REVIEW, "RULE8.review", v)),
        (F.lit(True), _say(PASS, "RULE8.pass", v)),
    )


def legibility() -> Column:
    v = F.coalesce(F.col("readability"), F.lit(""))
    return _first(
        (v == "", _say(REVIEW, "RULE9.missing")),
        (has_any(F.upper(v), V.POOR_WORDS), _say(REVIEW, "RULE9.poor")),
        (has_any(F.upper(v), V.FAIR_WORDS), _say(REVIEW, "RULE9.fair", v)),
        (F.lit(True), _say(PASS, "RULE9.pass", v)),
    )


CHECKS = {
    "R6-01": maker_address, "R6-02": packer_address, "R6-03": importer, "R6-04": origin, "R6-05": generic_name,
    "R6-06": multi_product, "R6-07": net_quantity, "R6-08": price, "R6-09": unit_price, "R6-10": manufacture_date,
    "R6-11": best_before, "R6-12": consumer_care, "R6-13": dimensions, "R6-14": commodity_gateway, "R6-15": gm_mark,
    "R6-16": veg_mark, "R6-17": ecommerce, "RULE7": font_height, "RULE8": placement, "RULE9": legibility,
}


def with_known_values(records: DataFrame) -> DataFrame:
    """Add what several rules share, once: cleaned fields, the suggested unit price, the least letter height."""
    cleaned = records.select(
        "*",
        *[known(F.col(f)).alias(f"k_{f}") for f in V.TEXT_FIELDS],
        F.coalesce("category", F.lit("")).alias("k_category"),
    )
    return cleaned.select(
        "*",
        suggested_unit_price(F.col("mrp"), F.col("net_quantity")).alias("suggestion"),
        least_font_height(F.col("k_net_quantity")).alias("least_height"),
    )


def evaluate(records: DataFrame, rule_ids: list[str] | None = None) -> DataFrame:
    """Records plus `rule_results`, an array of the outcome of every rule in fixed order."""
    chosen = [r for r in V.RULES if rule_ids is None or r[0] in rule_ids]
    outcomes = with_known_values(records).select(
        *records.columns, *[CHECKS[rule]().alias(f"o_{rule}") for rule, _, _ in chosen]
    )
    results = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule_id"),
                F.lit(name).alias("name"),
                F.col(f"`o_{rule}`")["status"].alias("status"),
                F.col(f"`o_{rule}`")["reason"].alias("reason"),
                F.lit(ref).alias("legal_ref"),
            )
            for rule, name, ref in chosen
        ]
    )
    return outcomes.select(*records.columns, results.alias("rule_results"))


def one_rule(records: DataFrame, rule_id: str, keys: list[str]) -> DataFrame:
    """Keys, status and reason of a single rule; only the columns that rule reads are touched."""
    out = with_known_values(records).select(*keys, CHECKS[rule_id]().alias("o"))
    return out.select(*keys, F.col("o.status").alias("status"), F.col("o.reason").alias("reason"))


def long_form(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """One row per record and rule, with the rule's position."""
    return evaluated.select(*keys, F.posexplode("rule_results").alias("pos", "r")).select(
        *keys, (F.col("pos") + 1).alias("rule_no"), "r.*"
    )
