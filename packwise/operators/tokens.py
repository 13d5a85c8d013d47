"""Cleaning, filtering and merging recognized tokens.

A token row has the panel keys, `seq` (output order of the recognizer within the
panel), `text`, `confidence` and the box `x_min, y_min, x_max, y_max`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import let, nfkc, rounded, strip

KEYS = ["insp_no", "panel_no"]
MARK = "\u0001"


def _map_marked(marked: Column, replace_inner) -> Column:
    """Rewrite the pieces between pairs of marks and drop the marks."""
    pieces = F.split(marked, MARK)
    return F.array_join(
        F.transform(pieces, lambda p, i: F.when(i % 2 == 1, replace_inner(p)).otherwise(p)), ""
    )


def clean_text(text: Column, normalized: Column | None = None) -> Column:
    """White space, lone noise characters, and the usual misreadings of a token, in fixed order.

    `normalized` is the text after compatibility normalization, if that was done.
    """
    t = strip(F.regexp_replace(text if normalized is None else normalized, V.TOKEN_SPACES, " "))
    t = F.when(t.isin(V.LONE_NOISE_CHARS), F.lit("")).otherwise(t)
    zeros = F.regexp_replace(t, V.ZERO_IN_QUANTITY, f"$1{MARK}$2{MARK}$3")
    t = _map_marked(zeros, lambda p: F.repeat(F.lit("0"), F.length(p)))
    prices = F.regexp_replace(t, V.ZERO_IN_PRICE, f"{MARK}$0{MARK}")
    t = _map_marked(prices, lambda p: F.translate(p, "ODod", "0000"))
    t = F.regexp_replace(t, V.COLLAPSED_COUNT, "$1 $2")
    t = F.regexp_replace(t, V.PHONE_LABEL_TYPO, "Ph: $1")
    t = F.regexp_replace(t, V.EMAIL_DOT_TYPO, "@$1.$2")
    return F.regexp_replace(t, V.RUPEE_TYPO, "Rs. $1/-")


def outside_ascii() -> Column:
    return F.coalesce(F.col("text").rlike(r"[^\x00-\x7F]"), F.lit(False))


def _with_plain_text(tokens: DataFrame, ascii_only: bool) -> DataFrame:
    text = F.col("text") if ascii_only else F.coalesce(nfkc(F.when(outside_ascii(), F.col("text"))), F.col("text"))
    return tokens.withColumn("__plain", text)


def _touched() -> Column:
    """Without digits, '@' or a noise character nothing but white space can change."""
    return F.col("__plain").rlike(r"[0-9@~`^_|=+<>\\]") | F.lower("__plain").rlike("rs|₹|mrp")


def _spaced() -> Column:
    return strip(F.regexp_replace(F.col("__plain"), V.TOKEN_SPACES, " "))


def with_clean_text(tokens: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Tokens with cleaned text; only text outside ASCII goes through the Arrow function. With `ascii_only` there is none,
    and the tokens stay as they were dealt out."""
    return _cleaned(_with_plain_text(tokens, ascii_only))


def _cleaned(ready: DataFrame) -> DataFrame:
    return ready.withColumn("text", F.when(_touched(), clean_text(F.col("__plain"))).otherwise(_spaced())).drop("__plain")


def filter_tokens(
    tokens: DataFrame, min_confidence: float = V.MIN_TOKEN_CONFIDENCE, ascii_only: bool = False
) -> DataFrame:
    """Cleaned tokens that are not empty and sure enough.

    Only white space and lone noise characters become empty, so that is told before the cleaning: a filter on the cleaned text
    would be moved below it and clean every token twice.
    """
    ready = _with_plain_text(tokens.where(F.col("confidence") >= min_confidence), ascii_only)
    spaced = _spaced()
    return _cleaned(ready.where((spaced != "") & ~(spaced.isin(V.LONE_NOISE_CHARS) & _touched())))


def is_vertical() -> Column:
    """Side-bar text: much taller than wide."""
    w = F.greatest(F.lit(1), F.col("x_max") - F.col("x_min"))
    h = F.greatest(F.lit(1), F.col("y_max") - F.col("y_min"))
    return (h >= V.VERTICAL_ASPECT * w) & (h >= V.VERTICAL_MIN_HEIGHT)


def polygon_box(points: Column) -> Column:
    """Axis-aligned box of an array of (x, y) points, rounded to whole pixels (ties to even)."""
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])
    return F.array(*[F.bround(f(v), 0).cast("int") for f in (F.array_min, F.array_max) for v in (xs, ys)])


def rescale_box(box: Column, factor: Column) -> Column:
    """Bring a box back to original pixels when the image had been enlarged."""
    return F.when(
        factor > 1.001, F.transform(box, lambda b: F.bround(b / factor, 0).cast("int"))
    ).otherwise(box)


def telemetry(panels: DataFrame, tokens: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Token count and mean confidence (four decimals) per panel; a panel without tokens has none and a mean of 1."""
    keys = keys or KEYS
    exact = F.sum(F.col("confidence").cast("decimal(20,12)")).cast("double")
    seen = tokens.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("token_count"),
        rounded(exact / F.count(F.lit(1)), 4).alias("mean_confidence"),
    )
    return panels.select(*keys).join(seen, keys, "left").select(
        *keys, F.coalesce("token_count", F.lit(0)).alias("token_count"), F.coalesce("mean_confidence", F.lit(1.0)).alias("mean_confidence")
    )


def needs_recovery(panels: DataFrame, tokens: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Which panels deserve a second recognition pass: few tokens, low confidence or a small image."""
    keys = keys or KEYS
    exact = F.sum(F.col("confidence").cast("decimal(20,12)")).cast("double")
    stats = tokens.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("token_count"), (exact / F.count(F.lit(1))).alias("mean_confidence")
    )
    joined = panels.join(stats, keys, "left")
    count, mean = F.coalesce("token_count", F.lit(0)), F.coalesce("mean_confidence", F.lit(0.0))
    return joined.select(
        *keys,
        count.alias("token_count"),
        (
            (count < V.RECOVERY_MIN_TOKENS)
            | (mean < V.RECOVERY_MIN_CONFIDENCE)
            | (F.least("image_width", "image_height") < V.RECOVERY_MIN_SIDE)
        ).alias("needs_recovery"),
    )


def _cut(boxes: DataFrame, keys: list[str], low: Column, high: Column, name: str, touching: bool = False) -> DataFrame:
    """Add `name`, the lower end of the run of overlapping intervals (low, high) a row lies in, within its keys.

    One pass over the rows in the order of `low`; it sorts, and spills if need be, but collects nothing. Intervals that
    only touch are one run if `touching`.
    """
    rows = boxes.withColumn("__low", low).withColumn("__high", high)
    along = Window.partitionBy(*keys).orderBy("__low").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("__high").over(along)
    apart = F.col("__low") > reach if touching else F.col("__low") >= reach
    starts = rows.withColumn("__start", F.when(reach.isNull() | apart, F.col("__low")))
    upto = Window.partitionBy(*keys).orderBy("__low").rowsBetween(Window.unboundedPreceding, 0)
    return starts.withColumn(name, F.max("__start").over(upto)).drop("__low", "__high", "__start")


def with_bands(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Add `band`, the top of the horizontal strip a box lies in.

    Strips of one panel do not overlap each other vertically, so boxes of different
    strips never interact.  The rows are exchanged by panel once; what groups by panel
    and band afterwards needs no further exchange.
    """
    return _cut(boxes, keys, F.col("y_min"), F.col("y_max"), "band")


BLOCK = ["__b1", "__b2", "__b3"]


def with_blocks(boxes: DataFrame, keys: list[str], min_iou: float) -> DataFrame:
    """Add the columns of BLOCK: boxes of different blocks overlap by less than `min_iou`.

    Two boxes of at least that overlap share at least `min_iou` of the longer side in each direction, so they still meet
    when `min_iou / 2` of its side is taken off every box at each end. The shrunk boxes of a panel are cut at clean
    gaps: into strips, strips into columns, columns into strips again. A tall side-bar beside the text, or rows whose
    boxes overlap a little, keep nothing together; usually a block is one word as the two passes saw it.
    """
    off = min_iou / 2 - 1e-9  # a little less: rounding must not part boxes that just meet
    y, x = [(F.col(f"{c}_min"), F.col(f"{c}_max"), (F.col(f"{c}_max") - F.col(f"{c}_min")) * off) for c in "yx"]
    for (low, high, less), name in zip((y, x, y), BLOCK, strict=True):
        boxes, keys = _cut(boxes, keys, low + less, high - less, name, touching=True), [*keys, name]
    return boxes


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes."""
    iw = F.greatest(F.lit(0), F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"]))
    ih = F.greatest(F.lit(0), F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"]))

    def area(r: Column) -> Column:
        return F.greatest(F.lit(0), r["x_max"] - r["x_min"]) * F.greatest(F.lit(0), r["y_max"] - r["y_min"])

    inter = iw * ih
    union = area(a) + area(b) - inter
    return F.when((inter == 0) | (union <= 0), F.lit(0.0)).otherwise(inter / union)


TOKEN = ["text", "confidence", "x_min", "y_min", "x_max", "y_max"]


def merge_passes(
    first: DataFrame, second: DataFrame, keys: list[str] | None = None, min_iou: float = V.MERGE_MIN_IOU
) -> DataFrame:
    """Two recognition passes as one token set.

    Every second-pass token, in order, either meets the token it overlaps most in the
    set so far (and replaces it when clearly surer or longer) or joins the set.  The
    order matters only among boxes that may meet, so the fold runs per block (with_blocks);
    a block of n second-pass tokens costs n times its size.  The result keeps
    the place of replaced tokens: `source` 1 and the first pass's `seq`, then added
    tokens with `source` 2.
    """
    keys = keys or KEYS
    if min_iou <= 0:
        raise ValueError("the overlap must be positive")
    both = first.select(*keys, F.lit(1).alias("source"), "seq", *TOKEN).unionByName(
        second.select(*keys, F.lit(2).alias("source"), "seq", *TOKEN)
    )
    blocks = with_blocks(both, keys, min_iou).groupBy(*keys, *BLOCK).agg(
        F.sort_array(F.collect_list(F.struct("source", "seq", *TOKEN))).alias("all"),
        F.count_if(F.col("source") == 2).alias("again"),
    )

    def met(m: Column, token: Column) -> Column:
        """The token of the set after a later token met it."""
        better = (token["confidence"] > m["confidence"] + V.MERGE_CONFIDENCE_GAIN) | (
            F.length(token["text"]) > F.length(m["text"]) + V.MERGE_LENGTH_GAIN
        )
        taken = F.struct(m["source"].alias("source"), m["seq"].alias("seq"), *[token[c].alias(c) for c in TOKEN])
        return F.when(better, taken).otherwise(m)

    def step(acc: Column, token: Column) -> Column:
        ious = F.transform(acc, lambda m: overlap(m, token))

        def place(found: Column) -> Column:
            at = F.array_position(found, F.array_max(found))
            hit = F.coalesce(F.array_max(found) >= min_iou, F.lit(False))
            return F.when(
                hit, F.transform(acc, lambda m, i: F.when(i == at - 1, met(m, token)).otherwise(m))
            ).otherwise(F.concat(acc, F.array(token)))

        return let(ious, place)

    merged = F.aggregate(
        F.filter("all", lambda t: t["source"] == 2), F.filter("all", lambda t: t["source"] == 1), step
    )
    # what most blocks are needs no fold: tokens of one pass alone, or one of each
    one, other = F.get("all", F.lit(0)), F.get("all", F.lit(1))
    pair = F.when(F.coalesce(overlap(one, other) >= min_iou, F.lit(False)), F.array(met(one, other))).otherwise(F.col("all"))
    merged = (
        F.when((F.col("again") == 0) | (F.size("all") == 1), F.col("all"))
        .when((F.col("again") == 1) & (F.size("all") == 2), pair)
        .otherwise(merged)
    )
    return blocks.select(*keys, F.inline(merged))


def in_zone(field: str, image_width: Column, image_height: Column) -> Column:
    """True when the centre of the box lies in the part of the image where the field is usually printed."""
    top, bottom, left, right = V.RETRY_ZONES[field]
    cx = (F.col("x_min") + F.col("x_max")) / 2
    cy = (F.col("y_min") + F.col("y_max")) / 2
    return (
        (cy >= F.floor(image_height * top))
        & (cy < F.floor(image_height * bottom))
        & (cx >= F.floor(image_width * left))
        & (cx < F.floor(image_width * right))
    )
