"""Scenario detectors: queries that return candidate events, never scores."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesswatch.functions.endpoint import request_parameters, resource_id, resource_path
from accesswatch.functions.ip import is_internal_ip
from accesswatch.functions.temporal import FEATURE_HOURS, in_unusual_hours
from accesswatch.operators.rolling import TrailingCount, trailing_counts
from accesswatch.operators.sequences import islands, operation_patterns, sequence_runs
from accesswatch.sources.rules import scenario_endpoints, validate_rules

# Which scenarios are a signature alone, and what else they need.
ANY_ROLE = ("sql_injection", "xss", "external_ip_only")
ROLE_BOUND = (
    "delete_patient_records", "delete_billing_invoices", "patient_records_put_del",
    "access_restricted_endpoints", "access_patient_invoices", "delete_login_attempts",
    "delete_admin_logs", "access_patient_records", "admin_suspicious", "privilege_escalation",
    "unauthorized_endpoint_access",
)
MONITORED = ("access_patient_invoices",)
LABELLED_METHODS = {"patient_records_put_del": ("DELETE",)}
INVENTORY, LOGIN, RECORDS, INVOICES = "/inventory/items", "/login/attempts", "/patient/records", "/billing/invoices"
INJECTION = r"(?i)('|%27)\s*(or|and)\s+.+=.+|;\s*(drop|delete|insert|update)\s|union\s+select|--\s*$"
SCRIPT = r"(?i)<\s*script|javascript:|on(error|load)\s*="


def scenario_signatures(spark, rules: dict) -> DataFrame:
    """Signature rows of the scenarios one request can show.

    ``Role`` is null where any role counts; ``needs`` names a further condition.
    """
    rules = validate_rules(rules)
    pairs = rules["ANOMALOUS_ENDPOINTS"]
    rows = []
    for scenario in ANY_ROLE:
        needs = "external" if scenario == "external_ip_only" else None
        rows += [(scenario, e, m, None, needs, "alert", 1) for e, m in pairs.get(scenario, [])]
    rows += [("unusual_time_access", e, m, None, "unusual_time", "alert", 1) for e, m in pairs.get("unusual_ip_access", [])]
    for scenario in ROLE_BOUND:
        severity = "monitor" if scenario in MONITORED else "alert"
        for role, scenarios in rules["ANOMALY_SCENARIOS"].items():
            for e, m in pairs.get(scenario, []) if scenario in scenarios else []:
                labelled = int(m in LABELLED_METHODS.get(scenario, (m,)))
                rows.append((scenario, e, m, role, None, severity, labelled))
    rows = sorted(set(rows), key=str)
    names = ["scenario", "_endpoint", "_method", "_role", "_needs", "severity", "labelled"]
    types = [pa.string()] * 6 + [pa.int32()]
    arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=names))


def tag_scenarios(df: DataFrame, rules: dict, hours: tuple[int, int] = FEATURE_HOURS) -> DataFrame:
    """One row per log and signature scenario it is a candidate for.

    The signature table is part of the rule document, a local relation whose size
    Spark knows, and is probed by (resource, method).
    """
    signatures = scenario_signatures(df.sparkSession, rules)
    on = (
        (resource_path(F.col("Endpoint")) == F.col("_endpoint"))
        & (F.col("HTTP_Method") == F.col("_method"))
        & (F.col("_role").isNull() | (F.col("_role") == F.col("Role")))
    )
    met = (
        F.col("_needs").isNull()
        | ((F.col("_needs") == "external") & ~is_internal_ip(F.col("IP_Address")))
        | ((F.col("_needs") == "unusual_time") & in_unusual_hours(F.col("Timestamp"), hours))
    )
    return df.join(signatures, on).where(met).select(*df.columns, "scenario", "severity", "labelled")


def _on_resources(df: DataFrame, resources) -> DataFrame:
    """Rows whose endpoint begins with one of the resources: a cheap first test."""
    names = sorted(set(resources))
    if len(names) == 1:
        return df.where(F.col("Endpoint").startswith(names[0]))
    return df.where(F.col("Endpoint").rlike(rf"\A(?:{'|'.join(re.escape(n) for n in names)})"))


def _operations(df: DataFrame, resource: str, *methods: str) -> DataFrame:
    """Requests of the given methods on exactly one resource."""
    chosen = _on_resources(df.where(F.col("HTTP_Method").isin(*methods)), [resource])
    return chosen.where(resource_path(F.col("Endpoint")) == resource)


def decoded(text: Column) -> Column:
    """Percent signs and plus signs of a URL decoded; text that is not well-formed stays."""
    return F.coalesce(F.try_url_decode(text), text)


def with_payload(df: DataFrame, pattern: str = INJECTION) -> DataFrame:
    """Requests whose decoded query payload looks like an attack: ``INJECTION`` or ``SCRIPT``."""
    payload = decoded(request_parameters(F.col("Endpoint"))[-1])
    return df.where(F.col("Endpoint").contains("query=")).withColumn("payload", payload).where(F.col("payload").rlike(pattern))


def _signature(df: DataFrame, rules: dict, scenario: str) -> DataFrame:
    pairs = scenario_endpoints(df.sparkSession, validate_rules(rules)).where(F.col("scenario") == scenario)
    pairs = pairs.select(F.col("rule_endpoint").alias("_e"), F.col("HTTP_Method").alias("_m")).coalesce(1).distinct()
    on = (resource_path(F.col("Endpoint")) == F.col("_e")) & (F.col("HTTP_Method") == F.col("_m"))
    return df.join(pairs, on, "left_semi")


def failed_attempt_bursts(df: DataFrame, gap_seconds: int = 10, min_attempts: int = 3) -> DataFrame:
    """Users deleting login attempts again and again, neighbours at most the gap apart."""
    attempts = _operations(df, LOGIN, "DELETE")
    return islands(attempts, ["UserID"], "Timestamp", gap_seconds, min_attempts)


def rapid_inventory_changes(df: DataFrame, within_seconds: int = 20, same_ip: bool = True) -> DataFrame:
    """PUT, DELETE, PUT in a row on one item by one user (from one address)."""
    changes = _operations(df, INVENTORY, "PUT", "DELETE").withColumn("item_id", resource_id(F.col("Endpoint")))
    keys = ["UserID", "item_id"] + (["IP_Address"] if same_ip else [])
    return operation_patterns(
        changes.where("item_id is not null"), keys, "Timestamp", "HTTP_Method", ("PUT", "DELETE", "PUT"), within_seconds
    )


def chain_steps(df: DataFrame, rules: dict, statuses: tuple[int, ...] | None = (500,)) -> DataFrame:
    """Requests that can take part in a chain: ``_injection`` or ``_read`` holds, ``_id`` is the record's id."""
    pairs = validate_rules(rules)["ANOMALOUS_ENDPOINTS"]
    entries = [f"{m} {e}" for e, m in pairs["sql_injection"]]
    reads = [f"{m} {e}" for e, m in pairs["data_exfiltration"]]
    endpoint = F.col("Endpoint")
    step = F.concat_ws(" ", "HTTP_Method", resource_path(endpoint))
    injected = decoded(endpoint).rlike(rf"(?s)[?&]query=.*(?:{INJECTION})") & step.isin(*entries)
    if statuses is not None:
        injected = F.col("HTTP_Response").isin(*statuses) & injected
    methods = sorted({m for _, m in pairs["sql_injection"] + pairs["data_exfiltration"]})
    # Cheap tests first; only rows that can take part are shuffled.
    logs = _on_resources(df.where(F.col("HTTP_Method").isin(*methods)), [e for e, _ in pairs["sql_injection"] + pairs["data_exfiltration"]])
    logs = logs.withColumns({"_injection": injected, "_read": ~endpoint.contains("query=") & step.isin(*reads)})
    return logs.where("_injection or _read").withColumn("_id", resource_id(endpoint, None))


def injection_chains(
    df: DataFrame, rules: dict, within_seconds: int = 300, same_ip: bool = True, statuses: tuple[int, ...] | None = (500,)
) -> DataFrame:
    """Reads of exfiltration endpoints shortly after an injection on the same id.

    One row per read with the number of injections in the window before it:
    a trailing count, so injections and reads are never paired up.
    """
    logs = chain_steps(df, rules, statuses)
    keys = ["UserID", "_id"] + (["IP_Address"] if same_ip else [])
    counted = trailing_counts(
        logs, keys, "Timestamp",
        [TrailingCount("n_injections", within_seconds, F.col("_injection"), F.col("_read"))],
    )
    return counted.where("n_injections > 0").select(*df.columns, F.col("_id").alias("resource_id"), "n_injections")


def frequent_record_updates(df: DataFrame, minutes: int = 5, threshold: int = 3) -> DataFrame:
    """PUTs on patient records with at least ``threshold`` earlier ones in the window."""
    puts = _operations(df, RECORDS, "PUT")
    counted = trailing_counts(puts, ["UserID"], "Timestamp", [TrailingCount("n_earlier", minutes * 60)])
    return counted.where(F.col("n_earlier") >= threshold)


def export_volume(df: DataFrame, rules: dict, min_records: int = 0) -> DataFrame:
    """Records asked for by export requests, per user and hour."""
    exports = _signature(df, rules, "data_exfiltration")
    _, _, export, limit, _ = request_parameters(F.col("Endpoint"))
    exports = exports.withColumns({"_export": export, "_limit": limit}).where("_export = 1")
    return (
        exports.groupBy("UserID", F.date_trunc("hour", "Timestamp").alias("hour_start"))
        .agg(F.count(F.lit(1)).alias("n_exports"), F.coalesce(F.sum("_limit"), F.lit(0)).cast("bigint").alias("n_records"))
        .where(F.col("n_records") >= min_records)
    )


def item_operation_runs(df: DataFrame, rules: dict, endpoints: tuple[str, ...] = (INVENTORY, INVOICES, RECORDS)) -> DataFrame:
    """Runs of PUTs or DELETEs on one item, with the limit of their operation.

    ``closed`` is when the opposite operation followed. A DELETE run is
    ``multiple_delete_same_item``, a PUT run ended by a DELETE
    ``multiple_put_del_same_item``.
    """
    limits = rules["ITEM_OPERATION_TRACKING"]
    resource, item = resource_path(F.col("Endpoint")), resource_id(F.col("Endpoint"), None)
    written = _on_resources(df.where(F.col("HTTP_Method").isin("PUT", "DELETE")), endpoints)
    changes = written.select(
        "Timestamp", "HTTP_Method", resource.alias("resource"), item.alias("resource_id")
    ).where(F.col("resource").isin(*endpoints) & F.col("resource_id").isNotNull())
    runs = sequence_runs(changes, ["resource", "resource_id"], "Timestamp", "HTTP_Method")
    limit = F.when(F.col("HTTP_Method") == "PUT", limits["max_puts_before_del"]).otherwise(limits["max_dels_before_put"])
    scenario = F.when(F.col("HTTP_Method") == "DELETE", "multiple_delete_same_item").when(
        F.col("closed").isNotNull(), "multiple_put_del_same_item"
    )
    return runs.withColumns({"over_limit": F.col("n_events") > limit, "scenario": scenario})


def repeated_item_operations(df: DataFrame, rules: dict) -> DataFrame:
    """Runs longer than their limit."""
    return item_operation_runs(df, rules).where("over_limit and scenario is not null").drop("over_limit")


def update_then_delete(df: DataFrame, rules: dict) -> DataFrame:
    """Items of inventory and billing that were changed and then deleted, per resource."""
    runs = item_operation_runs(df, rules, (INVENTORY, INVOICES)).where("HTTP_Method = 'PUT' and closed is not null")
    scenario = F.when(F.col("resource") == INVENTORY, "inventory_put_del").otherwise("billing_invoices_put_del")
    return runs.select(
        scenario.alias("scenario"), "resource", "resource_id", F.col("n_events").alias("n_puts"), "started",
        F.col("closed").alias("deleted"),
    )


def first_seen_addresses(df: DataFrame, rules: dict) -> DataFrame:
    """First request of a user from an address, where it fits the signature; of one instant that with the least id.

    The earliest instant per (user, address) is a minimum of numbers, so any number of requests combine in hash tables
    before the shuffle; requests meet it in an equality join, and only those of that instant are ordered by id. A
    request without a time comes before all others.
    """
    keys = ["UserID", "IP_Address"]
    rows = df.select(*keys, "Timestamp", "LogID", "Role", "HTTP_Method", "Endpoint")
    rows = rows.withColumn("_t", F.coalesce(F.unix_micros("Timestamp"), F.lit(-(2**63))))
    earliest = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("_t").alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    at_first = rows.join(earliest, [*same, F.col("_t") == F.col("_first")], "left_semi")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("LogID", "Role", "HTTP_Method", "Endpoint"))
    first = at_first.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_t")
    return _signature(first, rules, "unusual_ip_access")
