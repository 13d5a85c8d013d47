"""Visual measurements of a panel: regions, letter height, readability, image size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import fixed, rounded


def keep_label_regions(regions: DataFrame, image_width: Column, image_height: Column) -> DataFrame:
    """Boxes that look like text or label regions."""
    r = V.REGION_LIMITS
    w, h = F.col("width"), F.col("height")
    return regions.where(
        (w >= r["min_width"])
        & (h >= r["min_height"])
        & (w * h >= r["min_area"])
        & (w * h / (image_width * image_height) <= r["max_area_ratio"])
        & (w / h >= r["min_aspect_ratio"])
        & (h / image_height <= r["max_height_ratio"])
        & ~((h / image_height > r["tall_ratio"]) & (w < r["min_width_for_tall_region"]))
    )


def box_problem(image_width: Column, image_height: Column) -> Column:
    """Why a box cannot be placed in its image; null for a good box."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    return F.when((x < 0) | (y < 0) | (w <= 0) | (h <= 0), F.lit("not positive")).when(
        (x + w > image_width) | (y + h > image_height), F.lit("outside the image")
    )


def normalized_boxes(image_width: Column, image_height: Column) -> list[Column]:
    """Box position and size as fractions of the image, six decimals."""
    return [
        rounded(F.col("x") / image_width, 6).alias("x_normalized"),
        rounded(F.col("y") / image_height, 6).alias("y_normalized"),
        rounded(F.col("width") / image_width, 6).alias("width_normalized"),
        rounded(F.col("height") / image_height, 6).alias("height_normalized"),
    ]


def physical_height(pixels: Column, dpi: Column) -> list[Column]:
    """Letter height in mm with its status: measured, unknown_scale or invalid."""
    bad = (pixels <= 0) | F.coalesce(dpi <= 0, F.lit(False))
    mm = F.when(~bad & dpi.isNotNull(), pixels.cast("double") / dpi * V.MM_PER_INCH)
    status = F.when(bad, F.lit("invalid")).when(dpi.isNull(), F.lit("unknown_scale")).otherwise("measured")
    return [mm.alias("physical_height_mm"), status.alias("status")]


def readability(sharpness: Column, contrast: Column) -> Column:
    sharp, strong = sharpness >= V.MIN_SHARPNESS, contrast >= V.MIN_CONTRAST
    return F.when(sharp & strong, F.lit("good")).when(~sharp & ~strong, F.lit("poor")).otherwise("review")


def median_heights(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Upper median region height and region count per panel, without collecting a panel.

    Heights are whole pixels: they are counted per value (map-side combine), and the
    median is read off the running counts of the distinct values.
    """
    from pyspark.sql import Window

    counts = regions.groupBy(*keys, "height").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(*keys)
    upto = by.orderBy("height").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.select(*keys, "height", F.sum("n").over(upto).alias("upto"), F.sum("n").over(by).alias("total"))
    # element number total div 2, counted from 0
    return (
        ranked.where(F.col("upto") > F.floor(F.col("total") / 2))
        .groupBy(*keys)
        .agg(F.min("height").alias("median_height"), F.max("total").alias("region_count"))
    )


def visual_checks(panels: DataFrame, metrics: DataFrame, medians: DataFrame, keys: list[str]) -> DataFrame:
    """Assemble the visual record of every panel; a panel without metrics gets the 'unchecked' values."""
    joined = panels.join(metrics, keys, "left").join(medians, keys, "left")
    measured = F.col("sharpness").isNotNull()
    state = readability(F.col("sharpness"), F.col("contrast"))
    label = (
        F.when(state == "good", F.concat(F.lit("GOOD (Sharpness: "), fixed(F.col("sharpness"), 1), F.lit(")")))
        .when(state == "poor", F.lit("POOR"))
        .otherwise("REVIEW")
    )
    count = F.coalesce(F.col("region_count"), F.lit(0))
    height = rounded(
        F.col("median_height") / F.coalesce("dpi", F.lit(V.NOMINAL_DPI)) * V.MM_PER_INCH, 2
    )
    return joined.select(
        *keys,
        F.when(measured, label).otherwise(V.UNCHECKED_READABILITY).alias("readability"),
        F.when(measured, height).alias("font_height"),
        F.when(
            measured,
            F.concat(F.lit("Principal Display Panel ("), count.cast("string"), F.lit(" regions detected)")),
        )
        .otherwise(V.UNCHECKED_PLACEMENT)
        .alias("placement"),
        F.when(measured, F.col("dpi")).otherwise(V.NOMINAL_DPI).alias("dpi"),
    )


def target_size(width: Column, height: Column) -> list[Column]:
    """Admission of image sides and the size the image is scaled to."""
    small = (width < V.MIN_SIDE) | (height < V.MIN_SIDE)
    large = (width > V.MAX_SIDE) | (height > V.MAX_SIDE)
    longest = F.greatest(width, height)
    scale = F.lit(float(V.TARGET_SIDE)) / longest

    def side(s: Column) -> Column:
        # bround: whole-number rounding, ties to even
        scaled = F.greatest(F.bround(s * scale, 0).cast("int"), F.lit(V.MIN_SIDE))
        return F.when(~(small | large), F.when(longest > V.TARGET_SIDE, scaled).otherwise(s))

    reason = F.when(small, F.lit("too small")).when(large, F.lit("too large"))
    return [reason.alias("reject_reason"), side(width).alias("target_width"), side(height).alias("target_height")]


def padding(width: Column, height: Column) -> list[Column]:
    """Border added around wide, short images."""
    wide = width / F.greatest(height, F.lit(1)) > V.PADDING_ASPECT
    grown = F.greatest(F.lit(V.BASE_PADDING), F.floor(height * V.PADDING_HEIGHT_RATIO).cast("int"))
    return [
        F.when(wide, grown).otherwise(V.BASE_PADDING).alias("padding"),
        wide.alias("padding_applied"),
    ]
