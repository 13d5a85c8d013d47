"""Stored records: Parquet by month, the newest version per id, and the documents kept in records.

Changes of a store (corrections, deletions, streams) go through `version_log`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import tasks_for

MONTH = "month"


def with_month(records: DataFrame) -> DataFrame:
    return records.withColumn(MONTH, F.date_format("created_at", "yyyy-MM"))


def months_of(dated: DataFrame) -> list[str | None]:
    """The months a batch touches; their number is bounded by the calendar, not by the rows."""
    return [r[0] for r in dated.select(MONTH).distinct().collect()]


def of_months(records: DataFrame, months: list[str | None]) -> DataFrame:
    """Only these months, as a filter on the partition column, so other partitions are not even listed."""
    chosen = F.col(MONTH).isin([m for m in months if m is not None])
    return records.where(chosen | F.col(MONTH).isNull() if None in months else chosen)


def findable(key: str) -> dict[str, str]:
    """Options of a write whose row groups say which keys they hold, by a Bloom filter sized to what is written: ids are hashes, so
    least and largest values skip nothing. A look-up by id then reads the row groups that may have it."""
    name = f"parquet.bloom.filter.enabled#{key}"
    return {name: "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": str(4 << 20)}


def _order(records: DataFrame) -> list[str]:
    return [MONTH, *(c for c in ("user_id", "user_no", "created_at") if c in records.columns)]


def placed(records: DataFrame, most: int = 50_000) -> DataFrame:
    """Records with their month, dealt out by ranges of month, owner and date and ordered by them: the layout `append` writes.

    What wide columns are made of is dealt out here, and those columns are added afterwards: records are then neither exchanged
    nor sorted once they are wide. A task has about `most` rows, which it sorts in memory. The records are counted first.
    """
    order = _order(records)
    tasks = tasks_for(records.sparkSession, records.count(), most)
    return with_month(records).repartitionByRange(tasks, *order).sortWithinPartitions(*order)


def lists_of(records: DataFrame) -> dict[str, str]:
    """Columns that are lists of texts, or of rows of texts, and their types."""
    kinds = {f.name: f.dataType.simpleString() for f in records.schema}
    plain = {name: re.sub(r"[\w ]+:", "", kind.replace("array<", "").replace("struct<", "").replace(">", "")).split(",") for name, kind in kinds.items()}
    return {name: kind for name, kind in kinds.items() if kind.startswith("array<") and set(plain[name]) == {"string"}}


def packed(records: DataFrame, lists: dict[str, str]) -> DataFrame:
    """These lists as one JSON text each, which an exchange moves in less than half the bytes; `unpacked` gives them back."""
    return records.withColumns({name: F.to_json(name) for name in lists})


def unpacked(records: DataFrame, lists: dict[str, str]) -> DataFrame:
    return records.withColumns({name: F.from_json(name, kind) for name, kind in lists.items()})


def append(records: DataFrame, path: str) -> None:
    """Rows of a month go to few files; the rebalance splits months that are too large for one task.

    Inside a file rows are ordered by owner and date, so filters on them skip row groups. Records that `placed` dealt out have
    their month and are written as they lie.
    """
    if MONTH not in records.columns:
        records = with_month(records).hint("rebalance", MONTH).sortWithinPartitions(*_order(records))
    writer = records.write.mode("append").partitionBy(MONTH)
    writer.options(**findable("inspection_id")).parquet(path)


def scan(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All stored records; with a schema no file has to be opened to plan the read."""
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, {MONTH} string")
    return reader.parquet(path)


def latest(records: DataFrame, key: str = "inspection_id", version: str = "version") -> DataFrame:
    """The newest version per id; a partial aggregate, so ids sent very often are reduced before the shuffle."""
    row = F.struct(*[F.col(c) for c in records.columns])
    order = F.struct(F.col(version), F.xxhash64(F.to_json(row)))  # equal versions: always the same row
    best = records.groupBy(key).agg(F.max_by(row, order).alias("r"))
    return best.select("r.*")


def upserted(old: DataFrame, new: DataFrame, key: str = "inspection_id", version: str = "version") -> DataFrame:
    """Old and new records with the newest version per id; on equal versions the new record wins."""
    order = F.struct(F.col(version), F.col("__new"), F.xxhash64(F.to_json(F.struct(*old.columns))))
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    row = F.struct(*[F.col(c) for c in old.columns])
    return both.groupBy(key).agg(F.max_by(row, order).alias("r")).select("r.*")


def replace_batch(old: DataFrame, batch: DataFrame, key: str = "inspection_id") -> DataFrame:
    """A batch followed by the old records whose id is not in it."""
    return batch.unionByName(old.join(batch.select(key), key, "left_anti"))


def normalized(stored: DataFrame) -> DataFrame:
    """Fill image lists from the visual checks or the single addresses, and the owner from the legacy column."""
    v = F.col("visual_checks")
    empty = F.array().cast("array<string>")

    def present(text: Column) -> Column:
        return F.nullif(text, F.lit(""))

    def non_empty(urls: Column) -> Column:
        return F.when(F.size(urls) > 0, urls)

    overlay = F.coalesce(present(F.col("annotated_image_url")), v["overlay_image"])
    single = F.when(present(F.col("image_url")).isNotNull(), F.array("image_url"))
    single_overlay = F.when(present(overlay).isNotNull(), F.array(overlay))
    changed = {
        "annotated_image_url": overlay,
        "image_urls": F.coalesce(non_empty(F.col("image_urls")), non_empty(v["image_urls"]), single, empty),
        "annotated_image_urls": F.coalesce(
            non_empty(F.col("annotated_image_urls")), non_empty(v["annotated_image_urls"]), single_overlay, empty
        ),
        "user_id": F.coalesce(present(F.col("user_id")), F.col("inspector_id")),
    }
    return stored.select(*[changed.get(c, F.col(c)).alias(c) for c in stored.columns])


def stored_tokens(stored: DataFrame) -> DataFrame:
    """Tokens kept in records, one row each; records without tokens stay as one empty row."""
    return stored.select("inspection_id", F.posexplode_outer("ocr_raw.texts").alias("pos", "t")).select(
        "inspection_id",
        (F.col("pos") + 1).alias("token_no"),
        F.col("t.text").alias("text"),
        F.col("t.confidence").alias("confidence"),
        F.get("t.bbox", F.lit(0)).alias("x_min"),
        F.get("t.bbox", F.lit(1)).alias("y_min"),
        F.get("t.bbox", F.lit(2)).alias("x_max"),
        F.get("t.bbox", F.lit(3)).alias("y_max"),
    )


def visual_documents(visuals: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Summary and detailed visual checks as JSON texts.

    Regions are boxes of one image, so the list per panel is bounded by the image.
    """
    boxes = regions.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "y", "x", "width", "height", "x_normalized", "y_normalized", "width_normalized", "height_normalized"
                )
            )
        ).alias("regions"),
        F.count(F.lit(1)).alias("region_count"),
    )
    joined = visuals.join(boxes, keys, "left")
    return joined.select(
        *keys,
        F.to_json(F.struct(F.struct("readability", "font_height", "placement", "dpi").alias("visual_checks"))).alias(
            "summary"
        ),
        F.to_json(
            F.struct(
                F.struct("sharpness", "contrast").alias("readability"),
                F.struct(
                    "image_width", "image_height", F.coalesce("region_count", F.lit(0)).alias("region_count"), "regions"
                ).alias("placement"),
                F.col("dpi").alias("dpi"),
            )
        ).alias("detail"),
    )


def declarations_catalogue(spark: SparkSession) -> DataFrame:
    """The catalogue of mandatory declarations (eight rows)."""
    from ..functions import fixed_values as V

    return spark.createDataFrame(V.DECLARATIONS, "field string, label string, required boolean, format_hint string")


def declarations_document(spark: SparkSession) -> DataFrame:
    """The catalogue as the one JSON document it is kept in."""
    fields = F.collect_list(F.struct("field", "label", "required", "format_hint"))
    return declarations_catalogue(spark).agg(fields.alias("declarations"))


def load_declarations(spark: SparkSession, path: str) -> DataFrame:
    """The same catalogue from a JSON file with a `declarations` list."""
    schema = "rules_source string, declarations array<struct<field:string,label:string,required:boolean,format_hint:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("declarations"))
