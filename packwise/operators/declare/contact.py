"""Consumer care contact."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import fixed_values as V
from ...functions.text import any_word, has_any, match, strip

AHEAD = 4
LOOKS_AT = ["stripped", "care_stop"]
EDGE = " :,.-|"


def features() -> dict[str, Column]:
    text = strip(F.col("text"))
    stop = has_any(F.col("upper"), V.CARE_STOP_WORDS)
    for pattern in (V.MAKER_KEYWORD, V.MRP_KEYWORD):
        stop = stop | text.rlike(pattern)
    stop = stop | (F.col("digits") & (text.rlike(V.NET_QTY) | text.rlike(V.MFG_DATE)))
    return {"stripped": text, "care_stop": stop}


def steps() -> list[tuple[str, Column]]:
    text, block = F.col("text"), F.col("care_block")
    joined, going = text, F.lit(True)
    for k in (1, 2, 3, 4):
        n = F.col(f"next{k}")
        going = going & n.isNotNull() & ~n["care_stop"]
        joined = F.concat(joined, F.when(going, F.concat(F.lit(" "), n["stripped"])).otherwise(""))
    cleaned = strip(F.regexp_replace(block, V.CARE_KEYWORD, ""), EDGE)
    cleaned = strip(F.regexp_replace(cleaned, V.CARE_LEAD_IN, ""), EDGE)

    # every phone and e-mail found in the block is taken out wherever it occurs
    address = F.aggregate(
        F.concat(F.col("care_phones"), F.col("care_emails")),
        F.col("care_clean"),
        lambda left, found: F.replace(left, found, F.lit("")),
    )
    address = F.regexp_replace(address, V.CARE_CONTACT_LABEL, "")
    address = strip(F.regexp_replace(address, V.CARE_ADDRESS_LEAD_IN, ""), EDGE)
    return [
        ("care_block", F.when(text.rlike(V.CARE_KEYWORD), joined)),
        ("care_phones", F.regexp_extract_all(block, F.lit(V.PHONE), F.lit(0))),
        ("care_emails", F.regexp_extract_all(block, F.lit(V.EMAIL), F.lit(0))),
        ("care_site", match(block, V.WEBSITE)),
        ("care_clean", cleaned),
        ("care_address", address),
    ]


def _items(phone: Column, email: Column, site: Column) -> Column:
    """`Phone: .., Email: .., Website: ..` of what is present; '' when nothing is."""
    return F.concat_ws(
        ", ",
        F.concat(F.lit("Phone: "), phone),
        F.concat(F.lit("Email: "), email),
        F.concat(F.lit("Website: "), site),
    )


def fallback(phone: Column, email: Column, site: Column) -> Column:
    return F.nullif(_items(phone, email, site), F.lit(""))


def candidates() -> list[tuple[str, Column, Column]]:
    line = F.col("line_no").cast("long")
    text, address, clean = F.col("text"), F.col("care_address"), F.col("care_clean")
    items = _items(
        F.try_element_at("care_phones", F.lit(1)), F.try_element_at("care_emails", F.lit(1)), F.col("care_site")
    )
    value = (
        F.when(F.col("care_block").isNull(), F.lit(None))
        .when(
            items != "",
            F.when(F.length(address) > V.MIN_CARE_ADDRESS_LENGTH, F.concat(items, F.lit(", "), address)).otherwise(
                items
            ),
        )
        .when(F.length(clean) > V.MIN_CARE_BLOCK_LENGTH, clean)
    )
    # The label-wide search for a first phone, e-mail and site never spans lines, so it is ranked per line too.
    ignored = any_word(V.IGNORED_SITES)
    site = F.try_element_at(
        F.filter(
            F.regexp_extract_all(text, F.lit(V.WEBSITE), F.lit(0)), lambda s: ~F.lower(s).rlike(ignored)
        ),
        F.lit(1),
    )
    return [
        ("", line, value),
        ("_phone", line, F.when(F.col("digits"), match(text, V.PHONE))),
        ("_email", line, F.when(text.contains("@"), match(text, V.EMAIL))),
        ("_site", line, F.when(text.contains("."), site)),
    ]
