"""Every registered query: name -> callable(spark, folder) -> DataFrame.

All of them read the given tables whole, directly or through `sources.derived`.
Names start with the identifier of the capability they show.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import fuzzy, text as text_fn, units, urls
from ..operators import compliance, declare, lines as line_ops, panels as panel_ops, rules, tokens as token_ops, visual, vocabulary
from ..operators.declare import extract_fields
from ..operators.ordering import dealt, number_dealt, with_lookahead
from ..schemas import STORED, from_stored, to_stored
from ..session import shared_folder, staged
from ..sources import derived, store, text_index, version_log
from ..sources.tables import table
from ..streaming import live_kpis
from . import accounts, analytics, inspect, report, search, uploads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEYS = ["insp_no", "panel_no"]
BOX = ["y", "x", "width", "height", "x_normalized", "y_normalized", "width_normalized", "height_normalized"]  # in the order of stored boxes


def query(name: str):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return keep


# ------------------------------------------------------------------ shared inputs
def _evaluated(records: DataFrame) -> DataFrame:
    return inspect.judge(records).withColumn(
        "inspection_id", inspect.inspection_id(F.col("insp_no"), F.col("created_at"))
    ).withColumn("violation_count", F.size("violations"))


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluated records, one per order, with ids and owners."""
    return _evaluated(derived.declared_records(spark, folder).repartition("insp_no"))


_SAVED: dict[tuple[str, str], str] = {}


def saved(spark: SparkSession, folder: str) -> DataFrame:
    """The evaluated records read back from the store, as every search, dashboard and report does.

    They are written once per application into the shared folder.  Filters on status, date and
    owner are then answered from file statistics instead of judging every record again.  Declared
    values are dealt out and ordered before they are judged; judged records move no more.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SAVED:
        path = f"{shared_folder(spark)}/inspections-{uuid.uuid4().hex}"
        store.append(_evaluated(store.placed(derived.declared_records(spark, folder))), path)
        _SAVED[key] = path
    return spark.read.parquet(_SAVED[key]).drop(store.MONTH)


def rule_rows(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["inspection_id", "insp_no", "created_at", "user_no", "category"]
    return rules.long_form(saved(spark, folder), keys)


def _owner():
    n = F.col("insp_no")
    return F.when(n % 3 != 0, F.col("user_no").cast("string"))


def with_images(records: DataFrame) -> DataFrame:
    """Image addresses and owner columns for the stored layout, by number of the record."""
    n = F.col("insp_no")
    url = F.concat(F.lit("/api/uploads/"), n.cast("string"), F.lit(".jpg"))
    urls_ = F.transform(
        F.sequence(F.lit(1), (n % 6).cast("int")),
        lambda i: F.concat(F.lit("/api/uploads/"), n.cast("string"), F.lit("_"), i.cast("string"), F.lit(".jpg")),
    )
    none = F.lit(None).cast("string")
    return records.select(
        "*",
        F.lit(1).cast("long").alias("version"),
        _owner().alias("user_id"),
        F.col("user_no").cast("string").alias("inspector_id"),
        F.concat(F.lit("IMG-"), n.cast("string")).alias("image_id"),
        F.when(n % 4 != 0, url).alias("image_url"),
        F.when(n % 5 == 0, F.concat(F.lit("/api/uploads/o"), n.cast("string"), F.lit(".png"))).otherwise(none).alias(
            "annotated_image_url"
        ),
        F.when(n % 6 != 0, urls_).otherwise(F.array().cast("array<string>")).alias("image_urls"),
        F.array().cast("array<string>").alias("annotated_image_urls"),
        F.lit(None).cast("double").alias("dpi"),
        F.struct(
            F.transform(
                F.sequence(F.lit(1), F.col("token_count") + 1),
                lambda i: F.struct(
                    F.concat(F.lit("w"), i.cast("string")).alias("text"),
                    (F.coalesce(F.col("token_confidence"), F.lit(0.5)) / i).alias("confidence"),
                    F.array(i * 10.0, F.lit(5.0), i * 10.0 + 8, F.lit(25.0)).alias("bbox"),
                ),
            ).alias("texts")
        ).alias("ocr_raw"),
    )


def stored(spark: SparkSession, folder: str) -> DataFrame:
    return to_stored(with_images(saved(spark, folder)))


def words(col: str, alias: str | None = None):
    """An array of texts as one text, for comparing across engines."""
    return F.array_join(F.col(col), " | ").alias(alias or col)


# ------------------------------------------------------------------ extraction
EXTRACTION = {
    "x1_price": "mrp",
    "x2_net_quantity": "net_quantity",
    "x3_manufacture_date": "manufacture_date",
    "x4_country": "country_of_origin",
    "x5_manufacturer": "manufacturer",
    "x6_consumer_care": "consumer_care",
    "x7_generic_name": "generic_name",
    "x8_unit_price": "unit_sale_price",
}


def _one_field(field: str) -> Query:
    return lambda spark, folder: extract_fields(derived.label_lines(spark, folder), [field])


for _name, _field in EXTRACTION.items():
    QUERIES[_name] = _one_field(_field)


@query("x9_standard_unit")
def _(spark, folder):
    lines = derived.label_lines(spark, folder).select("text")
    unit = text_fn.match(F.col("text"), V.STANDALONE_QTY, 2)
    return (
        lines.select(unit.alias("unit")).where("unit is not null")
        .groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
        .select("unit", units.standard_unit(F.col("unit")).alias("canonical"), "n")
    )


@query("x10_suggested_unit_price")
def _(spark, folder):
    r = derived.declared_records(spark, folder)
    return r.select("insp_no", units.suggested_unit_price(F.col("mrp"), F.col("net_quantity")).alias("s")).select(
        "insp_no", "s.*"
    )


@query("x10_client_unit_price")
def _(spark, folder):
    r = derived.declared_records(spark, folder)
    return r.select(
        "insp_no", F.array_join(units.client_unit_price(F.col("mrp"), F.col("net_quantity")), " | ").alias("prices")
    )


@query("x11_calculated_unit_price")
def _(spark, folder):
    r = panel_ops.fill_unit_price(derived.declared_records(spark, folder))
    return r.select("insp_no", "unit_sale_price")


def _noisy_numbers(spark, folder):
    """Declared numbers with look-alike letters put in."""
    r = derived.declared_records(spark, folder)
    return r.select(
        "insp_no",
        F.explode(
            F.array(
                F.translate("mrp", "015", "OlS"),
                F.translate("net_quantity", "018", "OIB"),
                F.translate("net_quantity", "eia", "cln"),
                F.translate("manufacture_date", "SEP02", "5EPOZ"),
                F.col("manufacture_date"),
            )
        ).alias("value"),
    ).where("value is not null")


@query("x12_numeric_repair")
def _(spark, folder):
    r = _noisy_numbers(spark, folder).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return r.select("value", fuzzy.repair_numeric(F.col("value")).alias("repaired"), "n")


@query("x13_fuzzy_word")
def _(spark, folder):
    w = table(spark, folder, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    vocabulary = [u for u in V.REPAIR_UNITS] + ["rod", "ring", "gear", "bold", "small", "reed"]
    return w.select("word", fuzzy.fuzzy_match(F.col("word"), vocabulary, 2).alias("matched"))


@query("x14_fuzzy_number")
def _(spark, folder):
    p = derived.panels(spark, folder).select(F.col("price").cast("string").alias("price")).distinct()
    return p.select(
        "price", fuzzy.fuzzy_number(F.col("price"), ["900.00", "910.10", "925.55", "999.90"], 1).alias("matched")
    )


def _letters(rows, column: str):
    return rows.select(F.explode(F.regexp_extract_all(column, F.lit("([A-Za-z]+)"), F.lit(1))).alias("word")).distinct()


@query("x13_vocabulary_table")
def _(spark, folder):
    """Words of the benchmark items, repaired by the vocabulary of all pages."""
    asked, known = _letters(table(spark, folder, "benchmark"), "text"), _letters(table(spark, folder, "pages"), "html")
    return vocabulary.match_words(asked, known, limit=1).select("word", "matched")


@query("x14_vocabulary_table")
def _(spark, folder):
    """Account balances, matched with those of the suppliers."""
    asked = table(spark, folder, "customer").select(F.col("c_acctbal").cast("string").alias("value")).distinct()
    known = table(spark, folder, "supplier").select(F.col("s_acctbal").cast("string").alias("value")).distinct()
    return vocabulary.match_numbers(asked, known, limit=1).select("value", "matched")


@query("x15_all_fields_of_raw_text")
def _(spark, folder):
    docs = declare.lines_of_text(table(spark, folder, "documents"), ["doc_id"], "text")
    return extract_fields(docs, keys=["doc_id"])


@query("x15_all_fields_of_labels")
def _(spark, folder):
    return extract_fields(derived.label_lines(spark, folder), repair=True)


@query("x16_missing_critical_fields")
def _(spark, folder):
    p = derived.panels_dealt(spark, folder)
    f = extract_fields(derived.label_lines(spark, folder, p), inspect.CRITICAL)
    return f.select(*KEYS, F.array_join(inspect.missing_critical(), ",").alias("missing"))


@query("x16_zone_retry")
def _(spark, folder):
    p = derived.panels_dealt(spark, folder)
    panels, tokens, second = _recovered(spark, folder, p)
    return inspect.panel_declarations(panels, tokens, second).select(*KEYS, *inspect.CRITICAL)


# ------------------------------------------------------------------ lines and tokens
@query("f1_missing_words")
def _(spark, folder):
    r = derived.declared_records(spark, folder)
    return r.select(
        "insp_no", text_fn.known(F.col("manufacturer")).alias("maker"), text_fn.known(F.col("importer")).alias("importer"),
        text_fn.declared(F.col("packer")).alias("has_packer"),
    )


@query("f2_clean_tokens")
def _(spark, folder):
    t = derived.tokens(spark, folder).select("text", F.concat(F.translate("text", "0", "O"), F.lit(" g")).alias("worn"))
    spread = t.select(F.explode(F.array("text", "worn")).alias("text")).groupBy("text").agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("raw", F.col("text"))
    return token_ops.with_clean_text(spread).select("raw", F.col("text").alias("clean"), "n")


@query("f3_filter_tokens")
def _(spark, folder):
    return token_ops.filter_tokens(derived.tokens(spark, folder, derived.panels_dealt(spark, folder))).select(*KEYS, "seq", "text", "confidence")


@query("f4_positive_confidence")
def _(spark, folder):
    t = derived.tokens(spark, folder).withColumn("confidence", F.col("confidence") - 0.5)
    return t.groupBy("insp_no").agg(
        text_fn.rounded(compliance.mean_positive(F.col("confidence")), 4).alias("mean_confidence")
    )


@query("f5_vertical_tokens")
def _(spark, folder):
    return derived.tokens(spark, folder).where(token_ops.is_vertical()).groupBy("insp_no").agg(
        F.count(F.lit(1)).alias("vertical_tokens")
    )


@query("f6_sanitize_lines")
def _(spark, folder):
    lines = derived.label_lines(spark, folder)
    return lines.select(*KEYS, "line_no", declare.sanitize(F.col("text")).alias("text"))


@query("f25_recovery_needed")
def _(spark, folder):
    p = derived.panels_dealt(spark, folder)
    panels = p.select(
        *KEYS, (F.col("sz") * 40).alias("image_width"), F.lit(1400).alias("image_height")
    )
    return token_ops.needs_recovery(panels, derived.tokens(spark, folder, p))


@query("f26_rescale_boxes")
def _(spark, folder):
    t = derived.tokens(spark, folder, derived.panels_dealt(spark, folder))
    box = token_ops.rescale_box(
        F.array("x_min", "y_min", "x_max", "y_max"), F.when(F.col("insp_no") % 2 == 0, F.lit(1.5)).otherwise(1.0)
    )
    return t.select(*KEYS, "seq", F.array_join(box.cast("array<string>"), ",").alias("box"))


@query("f27_polygon_boxes")
def _(spark, folder):
    t = derived.tokens(spark, folder, derived.panels_dealt(spark, folder))

    def point(x, y):
        return F.struct((F.col(x) + 0.25).alias("x"), (F.col(y) + 0.75).alias("y"))

    corners = F.array(
        point("x_max", "y_min"), point("x_min", "y_min"), point("x_min", "y_max"), point("x_max", "y_max")
    )
    return t.select(*KEYS, "seq", F.array_join(token_ops.polygon_box(corners).cast("array<string>"), ",").alias("box"))


@query("j1_two_pass_merge")
def _(spark, folder):
    p = derived.panels_dealt(spark, folder)
    m = token_ops.merge_passes(derived.tokens(spark, folder, p), derived.second_pass_tokens(spark, folder, p))
    return m.select(*KEYS, "source", "seq", "text", "confidence", "x_min", "y_min", "x_max", "y_max")


@query("u3_rescued_tokens")
def _(spark, folder):
    p = derived.panels_dealt(spark, folder)
    m = token_ops.merge_passes(derived.tokens(spark, folder, p), derived.second_pass_tokens(spark, folder, p))
    return m.groupBy("source").agg(F.count(F.lit(1)).alias("tokens"))


@query("w3_row_groups")
def _(spark, folder):
    t = derived.tokens(spark, folder, derived.panels_dealt(spark, folder)).where(~token_ops.is_vertical())
    g = line_ops.group_rows(t)
    return g.select(*KEYS, "seq", F.col("band").cast("long").alias("band"), "grp")


@query("w4_column_split")
def _(spark, folder):
    t = derived.tokens(spark, folder, derived.panels_dealt(spark, folder)).where(~token_ops.is_vertical())
    return line_ops.split_columns(line_ops.group_rows(t)).select(*KEYS, "seq", F.col("sub").cast("long").alias("sub"))


@query("e14_line_rollup")
def _(spark, folder):
    t = derived.tokens(spark, folder, derived.panels_dealt(spark, folder)).where(~token_ops.is_vertical())
    return line_ops.roll_up(line_ops.split_columns(line_ops.group_rows(t))).select(*KEYS, *line_ops.LINE)


@query("w5_line_order")
def _(spark, folder):
    lines = line_ops.reconstruct(derived.tokens(spark, folder, derived.panels_dealt(spark, folder)))
    return lines.select(*KEYS, "line_no", "text", "y_min")


@query("u2_horizontal_and_vertical_lines")
def _(spark, folder):
    """All lines of the panels: those of rows and columns, and side-bars."""
    lines = line_ops.reconstruct(derived.tokens(spark, folder, derived.panels_dealt(spark, folder)))
    return lines.select(*KEYS, *line_ops.LINE)


@query("w6_normalize")
def _(spark, folder):
    p = derived.panels_dealt(spark, folder)
    lines = line_ops.normalize(derived.tokens(spark, folder, p))
    return lines.select(*KEYS, "line_no", *line_ops.LINE)


@query("e10_recognition_telemetry")
def _(spark, folder):
    p = derived.panels_dealt(spark, folder)
    # panels of every fiftieth inspection came back without any token
    t = derived.tokens(spark, folder, p).where("insp_no % 50 <> 0")
    return token_ops.telemetry(p, t)


@query("w1_lookahead_lines")
def _(spark, folder):
    lines = derived.label_lines(spark, folder)
    out = with_lookahead(lines, KEYS, "line_no", F.struct("text"))
    return out.select(*KEYS, "line_no", *[F.col(f"next{k}.text").alias(f"next{k}") for k in (1, 2, 3, 4)])


@query("w2_first_match_ranks")
def _(spark, folder):
    c = declare.line_candidates(derived.label_lines(spark, folder), ["net_quantity"])
    best = c.groupBy(*KEYS).agg(F.min("c_net_quantity").alias("c"))
    return best.select(
        *KEYS,
        F.floor(F.col("c.rank") / (1 << 40)).cast("long").alias("pass_no"),
        (F.col("c.rank") % (1 << 40)).alias("line_no"),
    )


@query("w10_ordered_regions")
def _(spark, folder):
    r = derived.regions(spark, folder)
    # a panel has as many boxes as its image holds
    order = Window.partitionBy(*KEYS).orderBy("y", "x", "k")
    return r.select(*KEYS, F.row_number().over(order).alias("place"), "k", "y", "x")


@query("j8_commodity_lines")
def _(spark, folder):
    from ..operators.declare.generic import longest_commodity

    lines = derived.label_lines(spark, folder)
    return (
        lines.select(longest_commodity(F.lower("text")).alias("commodity")).where("commodity is not null")
        .groupBy("commodity").agg(F.count(F.lit(1)).alias("lines"))
    )


@query("e16_excluded_title_words")
def _(spark, folder):
    lines = derived.label_lines(spark, folder)
    found = F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit("([A-Z]+)"), F.lit(1)))
    banned = F.array(*[F.lit(w) for w in V.TITLE_EXCLUDED_WORDS])
    return lines.select(F.arrays_overlap(found, banned).alias("excluded")).groupBy("excluded").agg(
        F.count(F.lit(1)).alias("lines")
    )


@query("u5_excluded_words_found")
def _(spark, folder):
    lines = derived.label_lines(spark, folder)
    found = F.regexp_extract_all(F.upper("text"), F.lit("([A-Z]+)"), F.lit(1))
    hit = F.array_intersect(F.array(*[F.lit(w) for w in V.TITLE_EXCLUDED_WORDS]), found)
    return lines.select(F.explode(hit).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("lines"))


# ------------------------------------------------------------------ visual checks
@query("f18_target_size")
def _(spark, folder):
    u = derived.uploads(spark, folder)
    return u.select("file_no", *visual.target_size(F.col("width"), F.col("height")))


@query("f19_padding")
def _(spark, folder):
    u = derived.uploads(spark, folder)
    return u.select("file_no", *visual.padding(F.col("width"), F.col("height")))


@query("f20_region_filter")
def _(spark, folder):
    kept = visual.keep_label_regions(derived.regions(spark, folder), F.lit(1000), F.lit(1400))
    return kept.select(*KEYS, "k", "x", "y", "width", "height")


@query("f21_normalized_regions")
def _(spark, folder):
    r = derived.regions(spark, folder)
    good = r.where(visual.box_problem(F.lit(1000), F.lit(1400)).isNull())
    return good.select(*KEYS, "k", *visual.normalized_boxes(F.lit(1000), F.lit(1400)))


@query("f21_rejected_regions")
def _(spark, folder):
    r = derived.regions(spark, folder).withColumn("problem", visual.box_problem(F.lit(1000), F.lit(1400)))
    return r.where("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("boxes"))


@query("f22_letter_height")
def _(spark, folder):
    p = derived.panels_dealt(spark, folder)
    r = derived.regions(spark, folder, p).join(
        derived.panel_metrics(spark, folder, p).select(*KEYS, "dpi"), KEYS
    )
    return r.select(*KEYS, "k", *visual.physical_height(F.col("height") - 20, F.col("dpi"))).select(
        *KEYS, "k", text_fn.rounded(F.col("physical_height_mm"), 6).alias("physical_height_mm"), "status"
    )


@query("f23_readability")
def _(spark, folder):
    m = derived.panel_metrics(spark, folder)
    return m.select(*KEYS, visual.readability(F.col("sharpness"), F.col("contrast")).alias("readability"))


@query("f24_visual_checks")
def _(spark, folder):
    p = derived.panels_dealt(spark, folder)
    return inspect.visual_records(
        p, derived.panel_metrics(spark, folder, p), derived.regions(spark, folder, p)
    )


@query("e13_median_region_height")
def _(spark, folder):
    return visual.median_heights(derived.regions(spark, folder), KEYS)


@query("s7_visual_documents")
def _(spark, folder):
    p = derived.panels_dealt(spark, folder)
    m = derived.panel_metrics(spark, folder, p)
    r = derived.regions(spark, folder, p).join(m.select(*KEYS, "image_width", "image_height"), KEYS)
    good = r.where(visual.box_problem(F.col("image_width"), F.col("image_height")).isNull())
    boxes = good.select(
        *KEYS, "x", "y", "width", "height", *visual.normalized_boxes(F.col("image_width"), F.col("image_height"))
    )
    v = inspect.visual_records(p, m, derived.regions(spark, folder, p))
    docs = store.visual_documents(v.drop("dpi").join(m, KEYS), boxes, KEYS)
    path = f"{shared_folder(spark)}/visual-{uuid.uuid4().hex}"
    docs.write.option("compression", "gzip").json(path)
    back = spark.read.schema("insp_no bigint, panel_no bigint, summary string, detail string").json(path)
    summary = F.from_json("summary", "visual_checks struct<readability:string,font_height:double,placement:string,dpi:double>")["visual_checks"]
    box = ",".join(f"{c}:{'double' if c.endswith('normalized') else 'int'}" for c in BOX)
    detail = F.from_json(
        "detail",
        f"readability struct<sharpness:double,contrast:double>, dpi double, placement struct<image_width:int,image_height:int,region_count:bigint,regions:array<struct<{box}>>>",
    )
    read = back.select(*KEYS, summary.alias("s"), detail.alias("d")).select(*KEYS, "s", "d", F.posexplode_outer("d.placement.regions").alias("pos", "r"))
    return read.select(
        *KEYS, "s.readability", "s.font_height", "s.placement", "s.dpi", F.col("d.readability.sharpness").alias("sharpness"), F.col("d.readability.contrast").alias("contrast"),
        F.col("d.placement.image_width").alias("image_width"), F.col("d.placement.image_height").alias("image_height"),
        F.col("d.placement.region_count").alias("region_count"), "pos", *[F.col(f"r.{c}").alias(c) for c in BOX],
    )


# ------------------------------------------------------------------ rules
RULE_QUERIES = {
    "r1_maker_address": "R6-01", "r2_packer": "R6-02", "r3_importer": "R6-03", "r4_origin": "R6-04",
    "r5_generic_name": "R6-05", "r6_multi_product": "R6-06", "r7_net_quantity": "R6-07", "r8_price": "R6-08",
    "r9_unit_price": "R6-09", "r10_manufacture_date": "R6-10", "r11_best_before": "R6-11", "r12_consumer_care": "R6-12",
    "r13_dimensions": "R6-13", "r14_category_gateway": "R6-14", "r15_gm_mark": "R6-15", "r16_veg_mark": "R6-16",
    "r17_ecommerce": "R6-17", "r18_font_height": "RULE7", "r19_placement": "RULE8", "r20_legibility": "RULE9",
}


def _rule(rule_id: str) -> Query:
    return lambda spark, folder: rules.one_rule(derived.declared_records(spark, folder).repartition("insp_no"), rule_id, ["insp_no"])


for _name, _id in RULE_QUERIES.items():
    QUERIES[_name] = _rule(_id)


@query("r21_font_tier")
def _(spark, folder):
    r = derived.declared_records(spark, folder)
    return r.select("insp_no", rules.least_font_height(text_fn.known(F.col("net_quantity"))).alias("least_height"))


@query("r22_all_rules")
def _(spark, folder):
    out = rules.long_form(rules.evaluate(derived.declared_records(spark, folder).repartition("insp_no")), ["insp_no"])
    return out.select("insp_no", "rule_no", "rule_id", "status", "reason", "legal_ref")


@query("e1_compliance")
def _(spark, folder):
    return judged(spark, folder).select("insp_no", "status", "score", words("violations"))


@query("e1_compliance_from_rows")
def _(spark, folder):
    long = rules.long_form(rules.evaluate(derived.declared_records(spark, folder).repartition("insp_no")), ["insp_no"])
    return compliance.rollup_long(long, ["insp_no"])


@query("e2_confidence")
def _(spark, folder):
    return judged(spark, folder).select("insp_no", "confidence")


@query("e15_missing_and_review_counts")
def _(spark, folder):
    r = rules.with_known_values(judged(spark, folder))
    return r.select("insp_no", rules.missing_count().alias("missing"), compliance.review_count(F.col("rule_results")).alias("reviews"))


# ------------------------------------------------------------------ panels and packages
def _panel_declarations(spark, folder, of=None):
    return inspect.panel_fields(derived.label_lines(spark, folder, of))


@query("e11_panel_merge")
def _(spark, folder):
    # several orders of one customer stand for the panels of one package
    p = derived.declared_records(spark, folder).withColumn("panel_no", F.col("insp_no"))
    return panel_ops.merge_fields(p, ["user_no"])


@query("e12_visual_merge")
def _(spark, folder):
    p = derived.panels_dealt(spark, folder)
    v = inspect.visual_records(
        p, derived.panel_metrics(spark, folder, p), derived.regions(spark, folder, p)
    )
    return panel_ops.merge_visuals(v, ["insp_no"])


@query("u1_tokens_of_all_panels")
def _(spark, folder):
    t = derived.tokens(spark, folder, derived.panels_dealt(spark, folder, ("insp_no",)))
    numbered = number_dealt(t, ["insp_no"], ["panel_no", "seq"], F.col("panel_no"), "token_no")
    return numbered.select("insp_no", "token_no", "panel_no", "text")


def _inspections(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("insp_no"), F.lit(V.DEFAULT_CATEGORY).alias("category")
    )


def _photographed(p):
    """Panels with image size and category, as an inspection receives them."""
    return p.select(*KEYS, F.lit(1000).alias("image_width"), F.lit(800).alias("image_height"), F.lit(V.DEFAULT_CATEGORY).alias("category"))


def _recovered(spark, folder, p):
    """(panels, staged tokens after recovery, second pass) of a staged panel table."""
    panels, second = _photographed(p), derived.second_pass_tokens(spark, folder, p)
    return panels, staged(inspect.recover(panels, derived.tokens(spark, folder, p), second)), second


def _visuals(spark, folder, p):
    return inspect.visual_records(p, derived.panel_metrics(spark, folder, p), derived.regions(spark, folder, p))


def _kept(spark, folder, records):
    """Append records to a store of their own and read them back, the last step of every inspection job."""
    dates = table(spark, folder, "orders").select(F.col("o_orderkey").alias("insp_no"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    path = f"{shared_folder(spark)}/inspected-{uuid.uuid4().hex}"
    store.append(records.join(dates, "insp_no", "left"), path)
    return store.scan(spark, path)


@query("p1_single_panel_inspections")
def _(spark, folder):
    p = derived.panels_dealt(spark, folder)
    panels, tokens, second = _recovered(spark, folder, p)
    out = _kept(spark, folder, inspect.inspect_panels(panels, tokens, _visuals(spark, folder, p), second))
    return out.select(*KEYS, *V.EXTRACTED_FIELDS, "status", "score", "confidence")


@query("p2_multi_panel_inspections")
def _(spark, folder):
    p = derived.panels_dealt(spark, folder)
    panels, tokens, second = _recovered(spark, folder, p)
    fields = panel_ops.fill_unit_price(inspect.panel_declarations(panels, tokens, second))
    out = inspect.inspect_packages(_inspections(spark, folder), fields, tokens, _visuals(spark, folder, p))
    return _kept(spark, folder, out).select("insp_no", *V.EXTRACTED_FIELDS, "status", "score", "confidence", words("violations"))


@query("p3_batch_inspections")
def _(spark, folder):
    """Accepted files only, each an independent inspection of its own label."""
    files = uploads.admit(derived.uploads(spark, folder)).where("reject_reason is null")
    p = dealt(staged(derived.panels(spark, folder).join(files.select(F.col("file_no").alias("pk")), "pk", "left_semi")), KEYS)
    panels, tokens, second = _recovered(spark, folder, p)
    out = _kept(spark, folder, inspect.inspect_panels(panels, tokens, _visuals(spark, folder, p), second))
    return out.select(*KEYS, "status", "score", "confidence")


def _overrides(spark, folder):
    n = F.col("insp_no")
    return derived.declared_records(spark, folder).where("insp_no % 9 = 0").select(
        "insp_no", F.lit("250 g").alias("net_quantity"), F.lit(None).cast("string").alias("mrp"),
        F.lit("").alias("manufacturer"), F.when(n % 2 == 0, F.lit("Household")).alias("category"),
        F.when(n % 4 == 0, F.lit(True)).alias("is_ecommerce"),
    )


@query("j9_override_merge")
def _(spark, folder):
    out = inspect.apply_overrides(saved(spark, folder), _overrides(spark, folder))
    return out.select("insp_no", "net_quantity", "mrp", "manufacturer", "category", "is_ecommerce", "status", "score")


def _log(spark: SparkSession, records: DataFrame, key: str, summed: bool = False) -> version_log.VersionLog:
    return version_log.of_records(records, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}", key, summed=summed)


def _corrected(spark: SparkSession, folder: str) -> version_log.VersionLog:
    """A log of all records as version 1 and the corrections as version 2."""
    old = saved(spark, folder).withColumn("version", F.lit(1))
    columns = ["insp_no", "version", "created_at", "user_no", "status", "score", "confidence", "violation_count", "net_quantity"]
    log = _log(spark, old.select(*columns), "insp_no", summed=True)
    changed = inspect.apply_overrides(saved(spark, folder), _overrides(spark, folder)).withColumn("version", F.lit(2))
    log.upsert(changed.withColumn("violation_count", F.size("violations")).select(*columns))
    return log


@query("p4_override_and_store")
def _(spark, folder):
    """Corrections are stored as new versions and read back."""
    return _corrected(spark, folder).snapshot().select("insp_no", "status", "score", "confidence", "net_quantity", "version")


@query("p4_dashboard_after_corrections")
def _(spark, folder):
    """After corrections, a deletion and a compaction, from the changes by day alone."""
    log = _corrected(spark, folder)
    log.delete(log.snapshot().where("insp_no % 4 = 1").select("insp_no"), None, True, ["user_no"])
    log.compact()
    return analytics.published(log.measures())


@query("p5_live_kpis")
def _(spark, folder):
    """The events as a stream into the store, then the numbers per day."""
    work = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    schema = table(spark, folder, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    first = source.select(
        F.col("event_id").cast("string").alias("inspection_id"), F.lit(1).alias("version"),
        F.col("ts").alias("created_at"), F.col("event_type"), F.col("event_id"),
    )
    # every twentieth inspection is submitted again as version 2
    stream = first.withColumn(
        "version", F.explode(F.when(F.col("event_id") % 20 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    )
    again = F.col("version") == 2
    status = (
        F.when(again, F.lit("FAIL")).when(F.col("event_type") == "error", F.lit("FAIL"))
        .when(F.col("event_type") == "signup", F.lit("REVIEW")).otherwise("PASS")
    )
    stream = stream.select(
        "inspection_id", "version", "created_at", status.alias("status"),
        F.when(again, F.lit(5)).otherwise((F.col("event_id") % 4).cast("int")).alias("violation_count"),
        F.when(again, F.lit(0.5)).otherwise((F.col("event_id") % 100).cast("double") / 100).alias("confidence"),
    )
    log = version_log.VersionLog(spark, f"{work}/log", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema), summed=True)
    live_kpis.start(stream, log, work).awaitTermination()
    return live_kpis.read_kpis(log)


# ------------------------------------------------------------------ store
@query("s1_scan_records")
def _(spark, folder):
    s = stored(spark, folder)
    return s.select(
        "inspection_id", "status", "product_name", F.col("fields.mrp").alias("mrp"),
        F.col("visual_checks.placement").alias("placement"), F.col("compliance.score").alias("score"),
    )


@query("s2_stored_tokens")
def _(spark, folder):
    return store.stored_tokens(stored(spark, folder))


@query("s3_rule_rows")
def _(spark, folder):
    s = stored(spark, folder).select("inspection_id", F.explode("compliance.rule_results").alias("r"))
    return s.groupBy("r.rule_id", "r.status").agg(F.count(F.lit(1)).alias("n")).select("rule_id", "status", "n")


@query("s4_append_and_read_back")
def _(spark, folder):
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    # dealt out by the owner they will have, with their rule rows packed, and brought into the stored layout afterwards
    records = saved(spark, folder)
    lists = store.lists_of(records)
    laid = store.placed(store.packed(records, lists).withColumn("user_id", _owner()))
    store.append(to_stored(with_images(store.unpacked(laid, lists).drop("user_id"))), path)
    back = from_stored(store.scan(spark, path, STORED))
    return back.select("inspection_id", "status", "score", "net_quantity", "placement", "violation_count")


def _latest_status(spark, folder):
    return derived.status_events(spark, folder)


@query("s5_upsert_newest_version")
def _(spark, folder):
    e = _latest_status(spark, folder)
    log = _log(spark, e.where("version = 1"), "insp_no")
    log.upsert(e.where("version = 2"))
    return log.snapshot().select("insp_no", "version", "status", "violation_count")


def _deletable(spark: SparkSession, folder: str) -> tuple[version_log.VersionLog, DataFrame]:
    records = saved(spark, folder).select("insp_no", F.lit(1).alias("version"), "created_at", "user_no")
    return _log(spark, records, "insp_no"), derived.declared_records(spark, folder).where("insp_no % 2 = 0").select("insp_no")


@query("s6_delete_owned")
def _(spark, folder):
    log, ids = _deletable(spark, folder)
    log.delete(ids, 7, False, ["user_no"])
    return log.snapshot().select("insp_no", "user_no")


@query("s6_deleted_count")
def _(spark, folder):
    log, ids = _deletable(spark, folder)
    return spark.createDataFrame([(log.delete(ids, None, True, ["user_no"]),)], "deleted long")


@query("s8_required_declarations")
def _(spark, folder):
    """Missing required fields by the catalogue, which is read from its JSON document."""
    r = derived.declared_records(spark, folder)
    names = [d[0] for d in V.DECLARATIONS]
    long = r.select("insp_no", *names).unpivot("insp_no", names, "field", "value")
    path = f"{shared_folder(spark)}/declarations-{uuid.uuid4().hex}"
    store.declarations_document(spark).coalesce(1).write.json(path)
    catalogue = store.load_declarations(spark, path).where("required")
    return (
        long.where(~text_fn.declared(F.col("value"))).join(F.broadcast(catalogue), "field")
        .groupBy("field", "label").agg(F.count(F.lit(1)).alias("missing"))
    )


@query("f7_record_normalization")
def _(spark, folder):
    n = store.normalized(stored(spark, folder))
    return n.select(
        "inspection_id", "user_id", "annotated_image_url", words("image_urls"), words("annotated_image_urls")
    )


# ------------------------------------------------------------------ search
@query("f8_status_filter")
def _(spark, folder):
    return saved(spark, folder).where(search.has_status("review")).select("insp_no", "status")


@query("f8b_inspector_filter")
def _(spark, folder):
    return saved(spark, folder).where(search.owned_by(11, "user_no")).select("insp_no", "user_no")


@query("f8b_inspector_or_owner")
def _(spark, folder):
    """Both forms of the filter: by account id, which has to be a UUID, and by inspector or else owner."""
    owners = saved(spark, folder).select(
        "insp_no",
        F.when(F.col("insp_no") % 3 != 0, F.format_string("00000000-0000-0000-0000-%012d", F.col("user_no").cast("long"))).alias("user_id"),
        F.when(F.col("insp_no") % 2 == 0, F.concat(F.lit("i"), (F.col("user_no") % 5).cast("string"))).otherwise("").alias("inspector_id"),
    )
    account = "00000000-0000-0000-0000-000000000011"
    forms = {
        "account": search.owned_by_account(account, "user_id"), "no account": search.owned_by_account("i3", "user_id"),
        "inspector": search.inspected_by("i3"), "owner": search.inspected_by(account),
    }
    each = F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in forms.items()])))
    return owners.select("insp_no", each.alias("form"))


@query("f9_name_wildcard_search")
def _(spark, folder):
    return saved(spark, folder).where(search.name_like("duct_1")).select("insp_no", "product_name")


@query("f9_name_or_id_search")
def _(spark, folder):
    return saved(spark, folder).where(search.name_or_id_contains("CT 1")).select("insp_no", "product_name")


@query("f10_history_search")
def _(spark, folder):
    return saved(spark, folder).where(search.history("Product 3", "FAIL")).select("insp_no", "product_name", "status")


def _indexed(spark, folder, *texts):
    """A trigram index over the stored records; searches read only the blocks it names."""
    path = f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}"
    return text_index.build(saved(spark, folder), list(texts), path, ["product_name", "inspection_id"])


@query("f9_indexed_wildcard_search")
def _(spark, folder):
    built = _indexed(spark, folder, F.col("product_name"))
    found = [built.like(F.col("product_name"), f"%{p}%").select(F.lit(p).alias("search"), "insp_no", "product_name") for p in ("duct_1", "prod%t 12", "9_")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("f9_indexed_name_or_id_search")
def _(spark, folder):
    texts = [F.col("product_name"), F.col("inspection_id")]
    return _indexed(spark, folder, *texts).containing(texts, "CT 1").select("insp_no", "product_name")


@query("f10_indexed_history_search")
def _(spark, folder):
    built = _indexed(spark, folder, search.history_text())
    return built.candidates(["Product 3"]).where(search.history("Product 3", "FAIL")).select("insp_no", "product_name", "status")


@query("f11_owner_rows")
def _(spark, folder):
    s = stored(spark, folder)
    return s.where(search.visible_to("7", False, ["user_id", "inspector_id"])).select("inspection_id", "user_id")


@query("f12_uuid_owner")
def _(spark, folder):
    h = F.md5(F.col("c_custkey").cast("string"))
    shaped = F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)
    )
    owner = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(shaped)
    return table(spark, folder, "customer").select("c_custkey", accounts.uuid_or_null(owner).alias("owner"))


@query("f13_point_lookup")
def _(spark, folder):
    """Account 7, no admin, asks for one record of its own and for one of another account."""
    r = saved(spark, folder)
    own = r.where(search.owned_by(7, "user_no")).agg(F.min("insp_no")).first()[0]
    other = r.where("user_no <> 7").agg(F.max("insp_no")).first()[0]
    asked = [r.where((F.col("insp_no") == i) & search.visible_to(7, False, ["user_no"])) for i in (own, other)]
    return asked[0].unionByName(asked[1]).select("insp_no", "inspection_id", "status")


@query("f13_lookup_in_log")
def _(spark, folder):
    """After a correction and a deletion, account 7 and an administrator ask for the same four records: one of account 7 as
    it was, one corrected, one deleted, and one of another account."""
    r = saved(spark, folder).select("inspection_id", "insp_no", "user_no", "created_at", "status", F.lit(1).alias("version"))
    log = version_log.of_records(r, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}", "inspection_id")
    own = r.where("user_no = 7").orderBy("insp_no").limit(3).select("inspection_id").collect()
    other = r.where("user_no <> 7").orderBy("insp_no").limit(1).select("inspection_id").collect()
    asked = [row[0] for row in own + other]
    log.upsert(r.where(F.col("inspection_id").isin(asked[1:2])).withColumn("status", F.lit("PASS")).withColumn("version", F.lit(2)))
    log.delete(r.where(F.col("inspection_id").isin(asked[2:3])), 7, False, ["user_no"])
    answers = [
        log.lookup(asked, requester, admin, ["user_no"]).select(F.lit(by).alias("asked_by"), "insp_no", "inspection_id", "status", "version")
        for by, requester, admin in (("owner", 7, False), ("administrator", 1, True))
    ]
    return answers[0].unionByName(answers[1])


@query("f14_roles")
def _(spark, folder):
    p = derived.profiles(spark, folder)
    return p.select(
        "user_no", accounts.normalized_role(F.col("raw_role")).alias("role"), accounts.is_admin(F.col("raw_role")).alias("admin")
    )


@query("f15_display_names")
def _(spark, folder):
    p = derived.profiles(spark, folder)
    none = F.lit(None).cast("string")
    return p.select(
        "user_no",
        accounts.profile_name(F.col("full_name"), none, F.col("email")).alias("profile_name"),
        accounts.display_name(F.col("full_name"), none, F.col("email"), F.col("raw_role")).alias("display_name"),
    )


@query("f16_product_names")
def _(spark, folder):
    return derived.uploads(spark, folder).select("file_no", uploads.product_name(F.col("filename")).alias("product"))


@query("f17_upload_admission")
def _(spark, folder):
    return uploads.admit(derived.uploads(spark, folder))


@query("w7_page")
def _(spark, folder):
    return search.page(saved(spark, folder).where(search.has_status("FAIL")), 3, 20).select(
        "inspection_id", "created_at", "status"
    )


@query("w7_page_after_row")
def _(spark, folder):
    r = saved(spark, folder).where(search.has_status("FAIL"))
    return search.page_after(r, F.lit("1997-01-01 00:00:00").cast("timestamp"), F.lit(""), 20).select(
        "inspection_id", "created_at", "status"
    )


@query("w7_total")
def _(spark, folder):
    return search.total(saved(spark, folder).where(search.has_status("FAIL")))


# ------------------------------------------------------------------ accounts
def _stored_profiles(spark, folder):
    p = derived.profiles(spark, folder).where("has_profile")
    role = F.when(F.col("user_no") % 10 != 3, accounts.normalized_role(F.col("raw_role")))
    return p.select("user_no", "full_name", role.alias("role"))


@query("j2_profile_lookup")
def _(spark, folder):
    return accounts.resolve_users(derived.profiles(spark, folder), _stored_profiles(spark, folder))


@query("j3_profile_backfill")
def _(spark, folder):
    return accounts.backfill_profiles(derived.profiles(spark, folder), _stored_profiles(spark, folder))


@query("j4_profile_upsert")
def _(spark, folder):
    return accounts.upsert_profiles(_stored_profiles(spark, folder), derived.profiles(spark, folder))


@query("j5_unknown_owner")
def _(spark, folder):
    r = saved(spark, folder).select("insp_no", "user_no")
    return accounts.drop_unknown_owners(r, _stored_profiles(spark, folder))


@query("j6_owner_backfill")
def _(spark, folder):
    s = stored(spark, folder).select("inspection_id", "user_id", "inspector_id")
    return accounts.backfill_owner(s, "user_id", "inspector_id")


@query("j7_batch_merge")
def _(spark, folder):
    e = _latest_status(spark, folder).select("insp_no", "version", "status")
    return store.replace_batch(e.where("version = 1"), e.where("version = 2"), "insp_no")


@query("u4_rows_not_in_batch")
def _(spark, folder):
    e = _latest_status(spark, folder).select("insp_no", "version", "status")
    return e.where("version = 1").join(e.where("version = 2").select("insp_no"), "insp_no", "left_anti")


# ------------------------------------------------------------------ analytics
@query("e3_dashboard")
def _(spark, folder):
    return analytics.dashboard(saved(spark, folder))


@query("e4_client_stats")
def _(spark, folder):
    return analytics.client_stats(saved(spark, folder))


@query("e4_normalized_stats")
def _(spark, folder):
    return analytics.normalized_stats(analytics.dashboard(saved(spark, folder)))


@query("e5_rule_counts")
def _(spark, folder):
    return analytics.rule_counts(rule_rows(spark, folder))


@query("w8_most_violated_rules")
def _(spark, folder):
    return analytics.most_violated(rule_rows(spark, folder))


@query("w9_recent_violations")
def _(spark, folder):
    return analytics.recent_violations(saved(spark, folder)).select("inspection_id", "pos", "violation")


@query("e6_by_category")
def _(spark, folder):
    return analytics.by_category(saved(spark, folder))


@query("e7_outcomes")
def _(spark, folder):
    o = analytics.outcomes_from_rules(rule_rows(spark, folder), ["insp_no"])
    return o.groupBy("insp_no").agg(
        *[F.count_if(F.col("outcome") == s).alias(s) for s in ("obeyed", "not_obeyed", "review")]
    )


@query("e7_outcomes_without_rules")
def _(spark, folder):
    return analytics.outcomes_from_fields(saved(spark, folder), ["insp_no"]).select(
        "insp_no", "rule_no", "name", "reason", "outcome"
    )


@query("e8_violation_buckets")
def _(spark, folder):
    return analytics.violation_buckets(analytics.outcomes_from_rules(rule_rows(spark, folder), ["insp_no"]))


@query("e9_shown_score_and_confidence")
def _(spark, folder):
    r = saved(spark, folder)
    odd = F.col("insp_no") % 2 == 1
    obeyed = F.size(F.filter("rule_results", lambda x: x["status"] == "PASS"))
    return r.select(
        "insp_no",
        analytics.shown_score(F.when(odd, F.col("score")), obeyed, F.size("rule_results")).alias("score"),
        analytics.shown_confidence(F.when(odd, F.col("confidence")), F.col("token_confidence")).alias("confidence"),
    )


@query("f29_percentages")
def _(spark, folder):
    e = table(spark, folder, "events").select("event_id", (F.col("value") / 10).alias("value"))
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return e.select("event_id", analytics.percentage(raw).alias("percent"))


@query("f30_bands")
def _(spark, folder):
    r = saved(spark, folder)
    return r.select(
        "insp_no",
        analytics.score_band(analytics.percentage(F.col("score"))).alias("score_band"),
        analytics.confidence_band(analytics.percentage(F.col("confidence"))).alias("confidence_band"),
    )


# ------------------------------------------------------------------ reports
@query("s9_declaration_audit")
def _(spark, folder):
    return report.declaration_audit(saved(spark, folder), ["insp_no"])


@query("s10_certificate_head")
def _(spark, folder):
    return report.certificate_head(saved(spark, folder), ["insp_no"])


@query("s10_numbered_violations")
def _(spark, folder):
    return report.numbered_violations(saved(spark, folder), ["insp_no"])


@query("s11_evidence_images")
def _(spark, folder):
    s = stored(spark, folder)
    return s.select(
        "inspection_id", F.array_join(report.evidence(F.col("image_urls"), F.col("image_url")), " | ").alias("evidence")
    )


@query("s12_export_fields")
def _(spark, folder):
    return report.export_fields(saved(spark, folder), ["insp_no"])


@query("f28_violation_parts")
def _(spark, folder):
    v = report.numbered_violations(saved(spark, folder), ["insp_no"])
    return v.select("insp_no", "violation_no", *report.split_violation(F.col("violation")))


@query("f31_trusted_urls")
def _(spark, folder):
    base = F.concat(F.lit("https://store.example.com/storage/v1/object/"), F.element_at(
        F.array(*[F.lit(x) for x in ("public/label-pictures/", "sign/label-pictures/", "public/other/", "private/label-pictures/")]),
        (F.col("page_id") % 4 + 1).cast("int"),
    ))
    tail = F.regexp_replace("url", r"^https?://[^/]*/", "")
    local = F.concat(F.lit("/api/uploads/"), F.when(F.col("page_id") % 3 == 0, F.lit("../")).when(
        F.col("page_id") % 3 == 1, F.lit(".x/")).otherwise(""), tail)
    every = F.explode(F.array(F.col("url"), F.concat(base, tail), local)).alias("address")
    return table(spark, folder, "pages").select("page_id", every).select(
        "page_id", "address", urls.trusted_image_url(F.col("address"), "store.example.com", "label-pictures").alias("trusted")
    )
