"""Content of certificates and exports as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import fixed, strip


def declaration_audit(records: DataFrame, keys: list[str]) -> DataFrame:
    """Eight rows per record: label, declared value or MISSING, VERIFIED or NON-COMPLIANT."""
    rows = F.array(
        *[F.struct(F.lit(label).alias("label"), F.col(field).alias("v")) for label, field in V.CERTIFICATE_ROWS]
    )
    value = F.coalesce(F.nullif(F.col("r.v"), F.lit("")), F.lit("MISSING"))
    return records.select(*keys, F.posexplode(rows).alias("pos", "r")).select(
        *keys,
        (F.col("pos") + 1).alias("row_no"),
        F.col("r.label").alias("label"),
        value.alias("value"),
        F.when(F.lower(value).isin(V.CERTIFICATE_MISSING), F.lit("NON-COMPLIANT")).otherwise("VERIFIED").alias("audit"),
    )


def certificate_head(records: DataFrame, keys: list[str]) -> DataFrame:
    """Header values and the three visual rows with their defaults."""
    status = F.col("status")
    text = F.when(status == "PASS", F.lit(V.STATUS_TEXT["PASS"])).when(
        status == "FAIL", F.lit(V.STATUS_TEXT["FAIL"])
    ).otherwise(V.STATUS_TEXT_OTHER)
    height = F.col("font_height")
    return records.select(
        *keys,
        F.coalesce(F.nullif(F.col("product_name"), F.lit("")), F.lit("N/A")).alias("product"),
        F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("FMCG / Packaged")).alias("category"),
        text.alias("status_text"),
        F.coalesce("readability", F.lit("N/A")).alias("readability"),
        F.when(F.coalesce(height, F.lit(0.0)) != 0, F.concat(fixed(height, 2), F.lit(" mm")))
        .otherwise("Pending Calibration")
        .alias("font_height"),
        F.coalesce("placement", F.lit("Standard Display Panel")).alias("placement"),
    )


def numbered_violations(records: DataFrame, keys: list[str]) -> DataFrame:
    return records.select(*keys, F.posexplode("violations").alias("pos", "violation")).select(
        *keys, (F.col("pos") + 1).alias("violation_no"), "violation"
    )


def evidence(image_urls: Column, image_url: Column, most: int = 4) -> Column:
    """Up to four panel addresses, else the single one, else nothing."""
    single = F.when(F.coalesce(image_url, F.lit("")) != "", F.array(image_url)).otherwise(
        F.array().cast("array<string>")
    )
    return F.slice(F.when(F.size(F.coalesce(image_urls, F.array().cast("array<string>"))) > 0, image_urls).otherwise(single), 1, most)


def export_fields(records: DataFrame, keys: list[str]) -> DataFrame:
    """Non-empty declared fields with upper-case labels, flags included when true."""
    rows = F.array(
        *[
            F.struct(F.lit(f.replace("_", " ").upper()).alias("label"), F.nullif(F.col(f), F.lit("")).alias("value"))
            for f in V.TEXT_FIELDS
        ],
        *[
            F.struct(
                F.lit(f.replace("_", " ").upper()).alias("label"), F.when(F.col(f), F.lit("true")).alias("value")
            )
            for f in V.FLAG_FIELDS
        ],
    )
    return records.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*").where(F.col("value").isNotNull())


def split_violation(violation: Column) -> list[Column]:
    """Title and detail at the first colon; without one everything is detail."""
    at = F.instr(violation, ":")
    return [
        F.when(at > 0, strip(F.substring_index(violation, ":", 1))).alias("title"),
        F.when(at > 0, strip(F.substring(violation, at + 1, F.length(violation)))).otherwise(violation).alias("detail"),
    ]
