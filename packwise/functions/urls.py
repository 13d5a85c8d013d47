"""Which evidence addresses may be fetched."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def trusted_image_url(url: Column, storage_host: str, bucket: str) -> Column:
    """True for a storage object on the configured host, or a safe local upload path."""
    tail = F.substring(url, len(V.UPLOAD_PREFIX) + 1, 1 << 30)
    upload = (
        url.startswith(V.UPLOAD_PREFIX)
        & (tail != "")
        & ~tail.contains("..")
        # no part may be hidden, and the path may not restart at the root
        & ~tail.rlike(r"(^|/)\.[^/]")
        & ~tail.startswith("/")
    )
    rest = F.regexp_extract(url, r"^https://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", 2)
    host = F.regexp_extract(url, r"^https://([^/?#]*)", 1)
    query = F.regexp_extract(url, r"^https://[^/?#]*[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"#(.+)$", 1)
    path_ok = rest.rlike(V.STORAGE_PATH + re.escape(bucket) + "/")
    stored = (
        url.startswith("https://")
        & F.lit(storage_host != "")
        & (host == storage_host)
        & path_ok
        & (fragment == "")
        & (rest.contains("/sign/") | (query == ""))
    )
    return F.coalesce(upload | stored, F.lit(False))
