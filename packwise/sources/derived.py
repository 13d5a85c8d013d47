"""Label-shaped tables derived from the given star-schema tables.

One order is an inspection, one line item is a photographed panel of it, the
part, supplier and nation supply the printed text, and the customer is the
inspector.  Everything is a deterministic expression over whole tables; the
expression texts are plain SQL that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import dealt, number_within
from ..session import staged
from .tables import table

# The order of the panels of one inspection; together these columns identify a line item.
PANEL_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus",
]

PANEL_COLUMNS = {
    "insp_no": "l_orderkey",
    "user_no": "o_custkey",
    "created_at": "o_orderdate",
    "pk": "l_partkey",
    "sz": "p_size",
    "sk": "l_suppkey",
    "qty": "CAST(l_quantity AS INT)",
    "price": "CAST(p_retailprice AS DECIMAL(12,2))",
    "pname": "p_name",
    "sname": "s_name",
    "nname": "n_name",
    "yy": "year(l_shipdate)",
    "mm": "month(l_shipdate)",
}

_PRICE = "CAST(price AS STRING)"
_MM = "lpad(CAST(mm AS STRING), 2, '0')"
_YY = "CAST(yy AS STRING)"
_QTY = "CAST(qty AS STRING)"
_SK = "CAST(sk AS STRING)"
LABEL_LINES = [
    f"""CASE pk % 6 WHEN 0 THEN 'COMMODITY: ' || pname WHEN 1 THEN 'Potato chips ' || pname WHEN 2 THEN 'TASTY'
        WHEN 3 THEN 'INGREDIENTS: wheat, salt' WHEN 4 THEN 'BRAND ' || pname ELSE 'Pure SoybeanOil & Tea' END""",
    f"""CASE WHEN qty % 5 = 0 THEN 'NET QTY' WHEN qty % 5 = 1 THEN 'NET WT ' || CAST(10 * qty AS STRING) || ' g'
        WHEN qty % 5 = 2 THEN 'NET QUANTITY: ' || {_QTY} || CASE sz % 3 WHEN 0 THEN ' kg' WHEN 1 THEN ' ml' ELSE ' Ltr' END
        WHEN qty % 5 = 3 THEN 'Protein ' || {_QTY} || ' g per serve'
        ELSE {_QTY} || CASE WHEN pk % 3 = 0 THEN '.50 g' ELSE ' TABLETS' END END""",
    "CASE WHEN qty % 5 = 0 THEN CAST(25 * qty AS STRING) || ' g' ELSE 'STORE IN COOL DRY PLACE' END",
    f"""CASE sz % 5 WHEN 0 THEN 'MRP Rs. ' || {_PRICE} || ' (INCL OF ALL TAXES)' WHEN 1 THEN 'M . R . P : ' || {_PRICE}
        WHEN 2 THEN 'MAXIMUM RETAIL PRICE' WHEN 3 THEN 'MRP: ' || {_PRICE} || '/-' ELSE 'BEST QUALITY' END""",
    f"CASE WHEN sz % 5 = 2 THEN 'Rs. ' || {_PRICE} || ' INCL. OF TAXES' ELSE 'LOT A' END",
    f"""CASE pk % 5 WHEN 0 THEN 'PKD: ' || {_MM} || '/' || {_YY} WHEN 1 THEN 'MFD' WHEN 2 THEN 'LOT B'
        WHEN 3 THEN 'MFG: SEP' || {_YY} ELSE 'BEST BEFORE ' || {_MM} || '/05/' || {_YY} END""",
    f"CASE WHEN pk % 5 = 1 THEN {_MM} || '/' || {_YY} ELSE 'LOT C' END",
    "CASE sk % 3 WHEN 0 THEN 'MANUFACTURED BY: ' || sname || ' PVT LTD' WHEN 1 THEN sname || ' INDUSTRIES' ELSE 'LOT D' END",
    f"CASE WHEN sk % 3 <> 2 THEN 'PLOT ' || {_SK} || ', MUMBAI ' || CAST(400000 + sk % 90000 AS STRING) ELSE 'LOT E' END",
    "CASE sk % 4 WHEN 0 THEN 'MADE IN INDIA' WHEN 1 THEN 'COUNTRY OF ORIGIN: ' || nname ELSE 'LOT F' END",
    f"""CASE sz % 4 WHEN 0 THEN 'CUSTOMER CARE: 1800 ' || CAST(1000 + sk % 8000 AS STRING) || ' ' || CAST(2000 + sk % 8000 AS STRING)
        WHEN 1 THEN 'FEEDBACK care' || {_SK} || '@brand.example.com' ELSE 'LOT G' END""",
    "CASE WHEN sz % 6 = 0 THEN 'USP Rs. ' || CAST(CAST(price * 0.1 AS DECIMAL(12,2)) AS STRING) || ' / 100 g' ELSE 'LOT H' END",
]

# word position, confidence and box of each word of a line (word_no is 1-based)
TOKEN_COLUMNS = {
    "confidence": "CAST(30 + (insp_no * 7 + panel_no * 5 + line_no * 3 + word_no * 11) % 70 AS DOUBLE) / 100",
    "x_min": "CAST(10 + (word_no - 1) * 90 + CASE WHEN line_no % 5 = 0 AND word_no >= 4 THEN 400 ELSE 0 END AS INT)",
    "y_min": "CAST(30 * line_no + (insp_no + word_no) % 4 AS INT)",
    "width": "CASE WHEN line_no = 12 AND insp_no % 3 = 0 THEN 12 ELSE 8 * length(text) END",
    "height": "CASE WHEN line_no = 12 AND insp_no % 3 = 0 THEN 60 ELSE 18 + CAST(word_no % 3 AS INT) * 2 END",
}
# the second recognition pass: shifted and surer copies, rescued words, and the rest unchanged is not seen again
SECOND_PASS = {
    "keep": "(insp_no + word_no) % 2 = 0 OR word_no = 1",
    "dy": "CASE WHEN (insp_no + word_no) % 2 = 0 THEN 0 ELSE 400 END",
    "dx": "CASE WHEN (insp_no + word_no) % 2 = 0 THEN 3 ELSE 0 END",
    "confidence": "CASE WHEN (insp_no + word_no) % 2 = 0 THEN least(1.0, confidence + 0.15) ELSE confidence END",
}

# Declared fields covering every rule branch; one row per order.
DECLARED = """
SELECT o_orderkey AS insp_no, o_custkey AS user_no, o_orderdate AS created_at,
  CASE k % 7 WHEN 1 THEN 'Acme' WHEN 2 THEN 'Acme Foods Pvt Ltd, Plot 12, Mumbai 400001' WHEN 3 THEN ' N/A '
    WHEN 4 THEN 'Shree Works, Nagpur Road' WHEN 5 THEN 'Golden Harvest, Pune 411001' WHEN 6 THEN 'Sunrise Traders' END AS manufacturer,
  CASE c % 6 WHEN 1 THEN 'ACME' WHEN 2 THEN 'Pack House' WHEN 3 THEN 'Pack House, 12 Nehru Nagar' WHEN 4 THEN 'none'
    WHEN 5 THEN 'Packers, Delhi 110001' END AS packer,
  CASE k % 4 WHEN 1 THEN 'Global Imports Ltd' WHEN 2 THEN '-' END AS importer,
  CASE c % 5 WHEN 1 THEN 'India' WHEN 2 THEN 'Made in Japan' WHEN 3 THEN 'Atlantis' WHEN 4 THEN '' END AS country_of_origin,
  CASE k % 9 WHEN 1 THEN 'Maggi' WHEN 2 THEN 'Tea' WHEN 3 THEN 'Potato Chips' WHEN 4 THEN 'Soap, Shampoo' WHEN 5 THEN '2 x Jam'
    WHEN 6 THEN 'cloth 20 cm' WHEN 7 THEN 'Namkeen' WHEN 8 THEN 'null' END AS generic_name,
  CASE m % 15 WHEN 1 THEN '500 g' WHEN 2 THEN '1.5 kg' WHEN 3 THEN '250 ml' WHEN 4 THEN '2 L' WHEN 5 THEN '5 gallons'
    WHEN 6 THEN '25 sticks' WHEN 7 THEN '10 tablets' WHEN 8 THEN '4 matches' WHEN 9 THEN 'about 200 g' WHEN 10 THEN '50 g'
    WHEN 11 THEN '1200 ml' WHEN 12 THEN 'Approximately 1 kg' WHEN 13 THEN '0 g' WHEN 14 THEN '12 Units' END AS net_quantity,
  CASE k % 8 WHEN 1 THEN '03/2024' WHEN 2 THEN 'SEP 2024' WHEN 3 THEN 'SEP2024' WHEN 4 THEN 'best before 03/2024'
    WHEN 5 THEN '2024-03' WHEN 6 THEN 'expired' WHEN 7 THEN '12/05' END AS manufacture_date,
  CASE c % 4 WHEN 1 THEN '09/2025' WHEN 2 THEN 'soon' END AS best_before,
  CASE m % 7 WHEN 1 THEN 'Rs. ' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) || ' (INCL. OF ALL TAXES)'
    WHEN 2 THEN '₹ 1,234.50' WHEN 3 THEN '99' WHEN 4 THEN 'Rs. only' WHEN 5 THEN '₹ 2.675' WHEN 6 THEN 'Rs. 45' END AS mrp,
  CASE k % 10 WHEN 1 THEN '₹ 16.00 / 100 ml' WHEN 2 THEN 'Rs. 5.123 / g' WHEN 3 THEN '16 rupees' WHEN 4 THEN '₹ 3.00 / g (Calculated)'
    WHEN 5 THEN 'N/A' END AS unit_sale_price,
  CASE c % 7 WHEN 1 THEN 'Phone: 1800 1234 5678' WHEN 2 THEN 'care@brand.example.com' WHEN 3 THEN 'write to us'
    WHEN 4 THEN 'Customer cell, 12 Long Street, Old Town Square, Near the Railway Station, Pune 411001, +91 98765 43210' WHEN 5 THEN 'na' END AS consumer_care,
  CASE m % 8 WHEN 1 THEN 'green dot' WHEN 2 THEN 'brown dot' WHEN 3 THEN 'non-veg' WHEN 4 THEN 'blue dot' WHEN 5 THEN 'RED' END AS veg_nonveg_mark,
  CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_imported,
  CASE c % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_multi_product,
  CASE m % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_gm_food,
  CASE (k + c) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_ecommerce,
  CASE (k + m) % 6 WHEN 0 THEN 'Household items' WHEN 1 THEN 'Beverage' WHEN 2 THEN 'Textile' WHEN 3 THEN 'Packaged Commodity' WHEN 4 THEN '' END AS category,
  CASE WHEN k % 11 = 0 THEN NULL ELSE 'Product ' || CAST(m % 40 AS STRING) END AS product_name,
  CASE m % 6 WHEN 1 THEN 'GOOD (Sharpness: 55.0)' WHEN 2 THEN 'POOR' WHEN 3 THEN 'Review' WHEN 4 THEN 'POOR (Unchecked)' WHEN 5 THEN 'fair' END AS readability,
  CASE WHEN m % 5 = 0 THEN NULL ELSE CAST(m % 83 AS DOUBLE) / 8 END AS font_height,
  CASE k % 6 WHEN 1 THEN 'Principal Display Panel (3 regions detected)' WHEN 2 THEN 'outside seam' WHEN 3 THEN 'Uncertain'
    WHEN 4 THEN 'Top of panel' WHEN 5 THEN '' END AS placement,
  CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(k % 101 AS DOUBLE) / 100 END AS token_confidence,
  CAST(k % 17 AS INT) AS token_count
FROM (SELECT *, o_orderkey AS k, o_custkey AS c, o_orderkey * 31 + o_custkey * 7 + CAST(floor(o_totalprice) AS BIGINT) AS m FROM {orders})
"""

PROFILES = """
SELECT c_custkey AS user_no,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN ' Enforcement  Officer ' ELSE c_name END AS full_name,
  'u' || CAST(c_custkey AS STRING) || '_' || lower(c_mktsegment) || '@' || lower(c_mktsegment) || '.example' AS email,
  CASE c_custkey % 4 WHEN 0 THEN ' Admin ' WHEN 1 THEN 'administrator' WHEN 2 THEN 'inspector' END AS raw_role,
  c_custkey % 7 <> 0 AS has_profile
FROM {customer}
"""

UPLOADS = """
SELECT p_partkey AS file_no, CAST(floor(p_partkey / 91) * 13 + floor((sqrt(8 * (p_partkey % 91) + 1) - 1) / 2) AS BIGINT) AS batch_no,
  CASE p_size % 6 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' WHEN 3 THEN 'application/pdf'
    WHEN 4 THEN 'application/octet-stream' END AS content_type,
  CASE WHEN p_partkey % 50 = 0 THEN 0 ELSE (p_partkey * 7919) % 20000000 END AS size_bytes,
  'img_' || p_file || '-no' || CAST(p_partkey AS STRING) || '.final.jpg' AS filename,
  CAST((p_partkey * 37) % 9000 AS INT) AS width, CAST((p_partkey * 53) % 5000 AS INT) AS height
FROM (SELECT *, replace(p_name, ' ', '_') AS p_file FROM {part})
"""

STATUS_EVENTS = """
SELECT event_id AS insp_no, 1 AS version, ts AS created_at, user_id AS user_no,
  CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'signup' THEN 'REVIEW' ELSE 'PASS' END AS status,
  CAST(event_id % 4 AS INT) AS violation_count, CAST(event_id % 100 AS DOUBLE) / 100 AS confidence
FROM {events}
UNION ALL
SELECT event_id, 2, ts, user_id, 'FAIL', 5, 0.5 FROM {events} WHERE event_id % 20 = 0
"""


def _sql(spark: SparkSession, folder: str, text: str, *names: str) -> DataFrame:
    return spark.sql(text, **{n: table(spark, folder, n) for n in names})


def panels(spark: SparkSession, folder: str) -> DataFrame:
    """One row per photographed panel, numbered within its inspection."""
    items = number_within(
        table(spark, folder, "lineitem"), ["l_orderkey"], PANEL_ORDER,
        F.struct("l_linenumber", F.floor(F.col("l_partkey") / 64)), "panel_no",
    )
    wide = (
        items.join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return wide.select("panel_no", *[F.expr(e).alias(n) for n, e in PANEL_COLUMNS.items()])


def panels_dealt(spark: SparkSession, folder: str, by: tuple[str, ...] = ("insp_no", "panel_no")) -> DataFrame:
    """Panels staged and dealt out by panel, before lines and words are made of them: a panel is exchanged once, its words never."""
    return dealt(staged(panels(spark, folder)), list(by))


def label_lines(spark: SparkSession, folder: str, of: DataFrame | None = None) -> DataFrame:
    """Twelve printed lines per panel; `of`: a panel table that is already there."""
    return (panels(spark, folder) if of is None else of).select(
        "insp_no", "panel_no", F.posexplode(F.array(*[F.expr(e) for e in LABEL_LINES])).alias("pos", "text")
    ).select("insp_no", "panel_no", (F.col("pos") + 1).alias("line_no"), "text")


def tokens(spark: SparkSession, folder: str, of: DataFrame | None = None) -> DataFrame:
    """Recognized words with confidence and box; `seq` is the detector's output order within a panel."""
    words = label_lines(spark, folder, of).select(
        "insp_no", "panel_no", "line_no", F.posexplode(F.split("text", " ")).alias("pos", "text")
    ).withColumn("word_no", F.col("pos") + 1)
    boxed = words.select("*", *[F.expr(e).alias(n) for n, e in TOKEN_COLUMNS.items()])
    return boxed.select(
        "insp_no", "panel_no", (F.col("line_no") * 100 + F.col("word_no")).alias("seq"), "text", "confidence",
        "x_min", "y_min",
        (F.col("x_min") + F.col("width")).cast("int").alias("x_max"),
        (F.col("y_min") + F.col("height")).cast("int").alias("y_max"),
        "line_no", "word_no",
    )


def second_pass_tokens(spark: SparkSession, folder: str, of: DataFrame | None = None) -> DataFrame:
    """What a second recognition pass over the same panels returns."""
    t = tokens(spark, folder, of).where(SECOND_PASS["keep"])
    t = t.withColumn("dx", F.expr(SECOND_PASS["dx"])).withColumn("dy", F.expr(SECOND_PASS["dy"]))
    return t.select(
        "insp_no", "panel_no", "seq", "text", F.expr(SECOND_PASS["confidence"]).alias("confidence"),
        (F.col("x_min") + F.col("dx")).alias("x_min"), (F.col("y_min") + F.col("dy")).alias("y_min"),
        (F.col("x_max") + F.col("dx")).alias("x_max"), (F.col("y_max") + F.col("dy")).alias("y_max"),
    )


def declared_records(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, DECLARED, "orders")


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, PROFILES, "customer")


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, UPLOADS, "part")


def status_events(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, STATUS_EVENTS, "events")


REGION_COLUMNS = {
    "x": "CAST((pk * 37 + k * 211) % 900 AS INT)",
    "y": "CAST((sk * 53 + k * 97) % 1300 AS INT)",
    "width": "CAST(20 + (qty * 13 + k * 29) % 400 AS INT)",
    "height": "CAST(6 + (pk * 7 + k * 17) % 300 AS INT)",
}
METRIC_COLUMNS = {
    "image_width": "1000",
    "image_height": "1400",
    "sharpness": "CAST(pk % 90 AS DOUBLE) + 0.25",
    "contrast": "CAST(sz % 45 AS DOUBLE)",
    "dpi": "CASE WHEN sz % 3 = 0 THEN NULL ELSE CAST(300 AS DOUBLE) END",
}


def regions(spark: SparkSession, folder: str, of: DataFrame | None = None) -> DataFrame:
    """Six detected boxes per panel."""
    p = (panels(spark, folder) if of is None else of).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return p.select("insp_no", "panel_no", "k", *[F.expr(e).alias(n) for n, e in REGION_COLUMNS.items()])


def panel_metrics(spark: SparkSession, folder: str, of: DataFrame | None = None) -> DataFrame:
    """Image size, sharpness, contrast and scale per panel; panels of part keys ending in 9 were not measured."""
    return (panels(spark, folder) if of is None else of).where("pk % 10 <> 9").select(
        "insp_no", "panel_no", *[F.expr(e).alias(n) for n, e in METRIC_COLUMNS.items()]
    )
