"""Rule document: defaults, loading, and its tables."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesswatch.functions.endpoint import clean_endpoint

# Role names, scenario weights, endpoint signatures and limits.
_CLINICAL = {
    "high_frequency_put_patient_records": 0.10, "delete_patient_records": 0.05,
    "delete_billing_invoices": 0.05, "patient_records_put_del": 0.15,
    "unusual_ip_access": 0.10, "data_exfiltration": 0.10, "external_ip_only": 0.15,
    "sql_injection": 0.03, "xss": 0.02,
}
ROLE_SCENARIOS = {
    "Doctor": _CLINICAL,
    "Nurse": _CLINICAL,
    "Staff": {
        "rapid_inventory_changes": 0.15, "access_restricted_endpoints": 0.05,
        "inventory_put_del": 0.25, "billing_invoices_put_del": 0.30, "data_exfiltration": 0.05,
        "external_ip_only": 0.05, "multiple_put_del_same_item": 0.10,
        "multiple_delete_same_item": 0.10, "access_patient_invoices": 0.10,
        "sql_injection": 0.02, "xss": 0.02,
    },
    "Admin": {
        "delete_login_attempts": 0.10, "delete_admin_logs": 0.10, "access_patient_records": 0.10,
        "admin_suspicious": 0.20, "data_exfiltration": 0.10, "privilege_escalation": 0.10,
        "multiple_failed_attempts": 0.10, "sql_injection": 0.05, "xss": 0.05,
        "external_ip_only": 0.05, "unauthorized_endpoint_access": 0.10,
    },
}
SCENARIO_ENDPOINTS = {
    "high_frequency_put_patient_records": [("/patient/records", "PUT")],
    "delete_patient_records": [("/patient/records", "DELETE")],
    "delete_billing_invoices": [("/billing/invoices", "DELETE")],
    "patient_records_put_del": [("/patient/records", "PUT"), ("/patient/records", "DELETE")],
    "unusual_ip_access": [("/patient/records", "GET"), ("/lab/results", "GET"), ("/billing/invoices", "GET")],
    "data_exfiltration": [("/patient/records", "GET"), ("/billing/invoices", "GET"), ("/inventory/items", "GET")],
    "external_ip_only": [
        ("/patient/records", "GET"), ("/billing/invoices", "GET"), ("/inventory/items", "GET"),
        ("/patient/appointments", "GET"), ("/patient/invoices", "GET"),
    ],
    "multiple_failed_attempts": [("/login/attempts", "DELETE")],
    "sql_injection": [("/admin/settings", "POST"), ("/patient/records", "GET")],
    "xss": [("/admin/users", "PUT")],
    "rapid_inventory_changes": [
        ("/inventory/items", "PUT"), ("/inventory/items", "DELETE"), ("/inventory/items", "PUT"),
    ],
    "access_restricted_endpoints": [
        ("/lab/results", "GET"), ("/lab/tests", "GET"), ("/lab/tests", "DELETE"), ("/pharmacy/orders", "DELETE"),
    ],
    "access_patient_invoices": [("/patient/invoices", "GET"), ("/patient/invoices", "PUT")],
    "delete_login_attempts": [("/login/attempts", "DELETE")],
    "delete_admin_logs": [("/admin/logs", "DELETE")],
    "access_patient_records": [
        ("/patient/records", "GET"), ("/patient/records", "PUT"), ("/patient/records", "DELETE"),
    ],
    "unauthorized_endpoint_access": [
        ("/patient/records", "GET"), ("/patient/records", "DELETE"), ("/admin/users", "DELETE"),
    ],
    "admin_suspicious": [
        ("/admin/settings", "PATCH"), ("/admin/credentials", "PUT"),
        ("/admin/credentials", "GET"), ("/admin/logs", "GET"),
    ],
    "privilege_escalation": [("/admin/users", "POST"), ("/admin/credentials", "POST")],
}
ENDPOINT_PARAMETERS = {
    "/patient/records": {"id_range": [1000, 9999], "export": True, "limit": 1000},
    "/billing/invoices": {"id_range": [2000, 9999], "export": True, "limit": 500},
    "/inventory/items": {"id_range": [4000, 9999], "export": True, "limit": 300},
    "/admin/settings": {"id_range": [61, 70]},
    "/admin/users": {"id_range": [61, 70]},
    "/admin/credentials": {"id_range": [61, 70]},
    "/login/attempts": {"id_range": [1, 70], "attempts": [3, 10]},
    "/patient/appointments": {"id_range": [500, 1000]},
    "/patient/labs": {"id_range": [1000, 9999]},
    "/patient/insurance": {"id_range": [1000, 9999]},
    "/claims/status": {"id_range": [3000, 9999]},
    "/pharmacy/orders": {"id_range": [5000, 9999]},
    "/pharmacy/refills": {"id_range": [5000, 9999]},
    "/lab/results": {"id_range": [7000, 9999]},
    "/lab/tests": {"id_range": [7000, 9999]},
    "/patient/appointments/confirm": {},
    "/patient/appointments/cancel": {},
    "/patient/scheduling": {},
    "/patient/invoices": {"id_range": [8000, 9999], "export": True, "limit": 400},
}
ROLE_USERS = {
    "Doctor": list(range(1, 21)),
    "Nurse": list(range(21, 46)),
    "Staff": list(range(46, 61)),
    "Admin": list(range(61, 71)),
}
DEFAULT_FEATURE_ENGINEERING = {"unusual_hours": {"start": 21, "end": 6}, "endpoint_parse_depth": 3}
REQUIRED_SECTIONS = ("ANOMALY_SCENARIOS", "ANOMALOUS_ENDPOINTS", "PARAMETERS", "ROLES", "FEATURE_ENGINEERING")

def default_rules() -> dict:
    return {
        "ANOMALY_SCENARIOS": ROLE_SCENARIOS,
        "ANOMALOUS_ENDPOINTS": SCENARIO_ENDPOINTS,
        "PARAMETERS": ENDPOINT_PARAMETERS,
        "ROLES": ROLE_USERS,
        "IP_ADDRESS_GENERATION": {"ip_correlation_threshold": 0.3},
        "ITEM_OPERATION_TRACKING": {"max_puts_before_del": 2, "max_dels_before_put": 2},
        "FEATURE_ENGINEERING": DEFAULT_FEATURE_ENGINEERING,
    }


def validate_rules(rules: dict) -> dict:
    filled = {"FEATURE_ENGINEERING": DEFAULT_FEATURE_ENGINEERING, **rules}
    missing = [s for s in REQUIRED_SECTIONS if s not in filled]
    if missing:
        raise ValueError(f"missing rule sections: {missing}")
    return filled


def load_rules(spark: SparkSession, path: str) -> dict:
    """Rule document from a JSON file on any file system Spark reads."""
    found = spark.read.text(path, wholetext=True).take(2)
    if not found:
        raise FileNotFoundError(f"rule document {path} is empty")
    if len(found) > 1:
        raise ValueError(f"several rule documents under {path}")
    return validate_rules(json.loads(found[0].value))


def _local(spark: SparkSession, rows: list[tuple], **types: pa.DataType) -> DataFrame:
    """A table of the rule document as a local relation, whose size Spark knows."""
    columns = list(zip(*rows)) if rows else [()] * len(types)
    arrays = [pa.array(c, t) for c, t in zip(columns, types.values())]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=list(types)))


_TEXT = pa.string()


def scenario_endpoints(spark: SparkSession, rules: dict) -> DataFrame:
    rows = [(s, e, m) for s, pairs in rules["ANOMALOUS_ENDPOINTS"].items() for e, m in pairs]
    return _local(spark, rows, scenario=_TEXT, rule_endpoint=_TEXT, HTTP_Method=_TEXT)


def role_users(spark: SparkSession, rules: dict) -> DataFrame:
    rows = [(r, int(u)) for r, users in rules["ROLES"].items() for u in users]
    return _local(spark, rows, Role=_TEXT, UserID=pa.int64())


def endpoint_parameters(spark: SparkSession, rules: dict) -> DataFrame:
    rows = [
        (e, *(p.get("id_range") or (None, None)), bool(p.get("export", False)), p.get("limit"))
        for e, p in rules["PARAMETERS"].items()
    ]
    n = pa.int64()
    return _local(spark, rows, rule_endpoint=_TEXT, id_min=n, id_max=n, export=pa.bool_(), limit=n)


def role_rules(spark: SparkSession, rules: dict) -> DataFrame:
    """Every endpoint and method a role may not use, with the scenario behind it."""
    rows = [
        (role, scenario, endpoint, method)
        for role, weights in rules["ANOMALY_SCENARIOS"].items()
        for scenario in weights
        for endpoint, method in rules["ANOMALOUS_ENDPOINTS"].get(scenario, [])
    ]
    table = _local(spark, rows, Role=_TEXT, scenario=_TEXT, rule_endpoint=_TEXT, HTTP_Method=_TEXT)
    return table.withColumn("rule_endpoint", clean_endpoint(F.col("rule_endpoint")))


def authorization_rules(spark: SparkSession, rules: dict) -> DataFrame:
    return role_rules(spark, rules).select("Role", "HTTP_Method", "rule_endpoint").coalesce(1).distinct()
