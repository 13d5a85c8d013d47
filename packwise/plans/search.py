"""Filtering, looking up and paging records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V


def visible_to(requester: str | int | None, admin: bool, owners: list[str]) -> Column:
    """Admins and anonymous service calls see everything, others what they own."""
    if admin or requester is None:
        return F.lit(True)
    mine = F.lit(False)
    for owner in owners:
        mine = mine | F.coalesce(F.col(owner) == requester, F.lit(False))
    return mine


def has_status(status: str | None) -> Column:
    return F.lit(True) if not status else F.col("status") == status.upper()


def owned_by(owner_id: str | int | None, owner: str) -> Column:
    return F.lit(True) if owner_id is None else F.col(owner) == owner_id


def owned_by_account(owner_id: str | None, owner: str) -> Column:
    """Stored accounts are UUIDs: any other id does not filter."""
    return F.col(owner) == owner_id if owner_id and re.search(V.UUID_SHAPE, owner_id) else F.lit(True)


def inspected_by(inspector_id: str | None, inspector: str = "inspector_id", owner: str = "user_id") -> Column:
    """The inspector of a record, or its owner where no inspector is named."""
    named = F.coalesce(F.nullif(F.col(inspector), F.lit("")), F.col(owner))
    return F.lit(True) if not inspector_id else F.coalesce(named == inspector_id, F.lit(False))


def name_like(search: str | None) -> Column:
    """Stored-record search: product name only, % and _ are wildcards."""
    return F.lit(True) if not search else F.col("product_name").ilike(f"%{search}%")


def name_or_id_contains(search: str | None) -> Column:
    """Plain search: literal text in product name or id."""
    if not search:
        return F.lit(True)
    s = search.lower()
    return F.lower(F.coalesce("product_name", F.lit(""))).contains(s) | F.lower("inspection_id").contains(s)


def history_text() -> Column:
    return F.concat_ws(
        " ",
        F.col("inspection_id"),
        F.coalesce("product_name", F.lit("")),
        F.coalesce(F.col("user_no").cast("string"), F.lit("")),
    )


def history(search: str, status_tab: str = "ALL") -> Column:
    """History page: one text of id, name and owner, plus a status tab."""
    text = F.lower(history_text())
    tab = F.lit(True) if status_tab == "ALL" else F.col("status") == status_tab
    return text.contains(search.lower()) & tab


def _page_bounds(page: int, limit: int) -> None:
    if page < 1 or not 1 <= limit <= 100:
        raise ValueError("page must be at least 1 and limit between 1 and 100")


def page(records: DataFrame, page_no: int = 1, limit: int = 10) -> DataFrame:
    """Newest first, ties by id; a top-k plan, never a full sort."""
    _page_bounds(page_no, limit)
    return records.orderBy(F.desc("created_at"), "inspection_id").offset((page_no - 1) * limit).limit(limit)


def page_after(records: DataFrame, created_at: Column, inspection_id: Column, limit: int = 10) -> DataFrame:
    """The page following a given last row; cost does not grow with the page number."""
    _page_bounds(1, limit)
    later = (F.col("created_at") < created_at) | (
        (F.col("created_at") == created_at) & (F.col("inspection_id") > inspection_id)
    )
    if "month" in records.columns:  # the partition column of the store: later months are not read
        later = later & (F.col("month") <= F.date_format(created_at, "yyyy-MM"))
    return records.where(later).orderBy(F.desc("created_at"), "inspection_id").limit(limit)


def total(records: DataFrame) -> DataFrame:
    """Exact number of matching rows."""
    return records.agg(F.count(F.lit(1)).alias("total"))
