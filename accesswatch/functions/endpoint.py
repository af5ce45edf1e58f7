"""Endpoint text: cleaning, levels, resource ids and request parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_endpoint(endpoint: Column, versions_only: bool = False) -> Column:
    """Path without parameters, version suffix and trailing slashes.

    By default everything from the first ``/v`` on is cut, whatever follows the
    letter; ``versions_only`` restricts the cut to ``/v`` plus digits.
    """
    path = F.substring_index(endpoint, "?", 1)
    if versions_only:
        path = F.regexp_replace(path, r"/v\d+(/.*)?$", "")
    else:
        path = F.substring_index(path, "/v", 1)
    return F.rtrim(path, F.lit("/"))


def endpoint_levels(endpoint: Column, depth: int = 3) -> list[Column]:
    """One column ``endpoint_level_i`` per path level, ``none`` where absent."""
    parts = F.split(clean_endpoint(endpoint), "/", -1)
    return [
        F.coalesce(F.get(parts, F.lit(i)), F.lit("none")).alias(f"endpoint_level_{i}")
        for i in range(1, depth + 1)
    ]


def resource_path(endpoint: Column) -> Column:
    """Cleaned endpoint without a trailing numeric id: the rule key."""
    return F.regexp_replace(clean_endpoint(endpoint), r"/\d+$", "")


def resource_id(endpoint: Column, base: str | None = "/inventory/items") -> Column:
    """Numeric id right after ``base``; any trailing path id if base is None."""
    if base is None:
        text = F.regexp_extract(F.substring_index(endpoint, "?", 1), r"/(\d+)/?$", 1)
    else:
        text = F.regexp_extract(endpoint, base + r"/(\d+)", 1)
    return text.try_cast("bigint")


def item_key(endpoint: Column) -> Column:
    """Id segment of item or record requests as text, null for other requests."""
    segment = F.get(F.split(endpoint, "/", -1), F.lit(3))
    has_id = endpoint.contains("/items/") | endpoint.contains("/records/")
    return F.when(has_id, F.substring_index(segment, "?", 1))


def request_parameters(endpoint: Column) -> list[Column]:
    """Parts a request string is built from: path, id, export, limit, payload."""
    query = F.when(endpoint.contains("?"), F.substring(endpoint, F.instr(endpoint, "?") + 1, F.length(endpoint)))
    payload = F.regexp_extract(query, r"(?s)(?:^|&)query=(.*)$", 1)
    switches = F.regexp_replace(query, r"(?s)(?:^|&)query=.*$", "")
    return [
        resource_path(endpoint).alias("resource"),
        resource_id(endpoint, None).alias("resource_id"),
        F.coalesce(switches.rlike(r"(?:^|&)export=true(?:&|$)"), F.lit(False)).cast("int").alias("export"),
        F.regexp_extract(switches, r"(?:^|&)limit=(\d+)", 1).try_cast("bigint").alias("limit"),
        F.when(payload != "", payload).alias("payload"),
    ]
