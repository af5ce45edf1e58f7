import ipaddress
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from accesswatch.operators import stats
from accesswatch.operators.networks import longest_network
from accesswatch.sources import files
from tests.test_plans import plan


def brute_network(ip, networks):
    """(length, label) of the longest network that holds an address."""
    try:
        address = ipaddress.ip_address(ip)
    except ValueError:
        return None
    held = [(n.prefixlen, label) for n, label in networks if n.version == address.version and address in n]
    return max(held, key=lambda x: (x[0], -x[1]), default=None)


def test_networks_of_both_families(spark):
    r = random.Random(3)
    texts = [f"{r.randint(1, 20)}.{r.randint(0, 3)}.0.{r.randint(0, 255)}/{r.randint(0, 32)}" for _ in range(300)]
    texts += [f"2001:{r.randint(0, 3):x}::{r.randint(0, 9):x}/{r.choice([0, 3, 16, 17, 30, 31, 32, 33, 47, 64, 127, 128])}" for _ in range(100)]
    texts += ["10.0.0.7", "::1", "10.0.0.0/8", "10.0.0.0/8"]
    networks = [(ipaddress.ip_network(t, strict=False), i) for i, t in enumerate(texts)]
    bad = [("10.0.0.0/33", -1), ("10.0.0/8", -2), ("x/8", -3), ("10.0.0.0/", -4), (None, -5), ("10.0.0.0/-1", -6), ("::/129", -7)]
    table = spark.createDataFrame([(t, i) for i, t in enumerate(texts)] + bad, "cidr string, label int")
    ips = [f"{r.randint(0, 22)}.{r.randint(0, 4)}.0.{r.randint(0, 255)}" for _ in range(200)]
    ips += [f"2001:{r.randint(0, 4):x}::{r.randint(0, 12):x}" for _ in range(100)] + ["::1", "::ffff:10.0.0.7", "nonsense", "", None, "10.0.0.7", "10.0.0.7"]
    logs = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "id int, IP_Address string")
    found = longest_network(logs, table, ["label"])
    assert found.columns == ["id", "IP_Address", "label"] and "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    want = {i: (brute_network(ip, networks) or (0, None))[1] if ip else None for i, ip in enumerate(ips)}
    assert {row.id: row.label for row in found.collect()} == want
    empty = longest_network(logs, table.where("false"), ["label"])
    assert empty.count() == len(ips) and empty.where("label IS NOT NULL").count() == 0


def rows_made(node, of: str) -> int:
    """Rows that nodes of this name have put out, in the plan that ran."""
    name = node.nodeName()
    below = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else []
    children = node.children()
    below += [children.apply(i) for i in range(children.size())]
    own = node.metrics().get("numOutputRows").get().value() if name == of else 0
    return own + sum(rows_made(x, of) for x in below)


def test_addresses_are_not_repeated_for_each_length(spark):
    """Every length from 0 to 32 in the table: 4000 addresses of two blocks make 17 probes a block, not 33 each."""
    r = random.Random(4)
    ips = [f"10.{i % 2}.{r.randint(0, 255)}.{r.randint(0, 255)}" for i in range(4000)]
    texts = [f"{ips[r.randrange(4000)]}/{bits}" for bits in range(33) for _ in range(8)]
    networks = [(ipaddress.ip_network(t, strict=False), i) for i, t in enumerate(texts)]
    logs = spark.createDataFrame(list(enumerate(ips)), "id int, IP_Address string")
    found = longest_network(logs, spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "cidr string, label int"), ["label"])
    assert {row.id: row.label for row in found.collect()} == {i: brute_network(ip, networks)[1] for i, ip in enumerate(ips)}
    # Rows are parsed in a generator too: those of the logs twice, and the networks.
    assert rows_made(found._jdf.queryExecution().executedPlan(), "Generate") < 4 * 4000


def test_correlations_of_many_columns_with_nulls(spark):
    """200 columns in one pass, against the rows that have both values; far from zero, a constant, NaN, few rows."""
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 200)) @ r.normal(size=(200, 200)) * 0.1 + 1e6
    x[:, 7], x[:, 8] = 5.0, x[:, 9] * -2 + 1
    cells = [[None if r.random() < 0.2 and j % 3 == 0 else float(v) for j, v in enumerate(row)] for row in x]
    for i, row in enumerate(cells):
        row[30] = None if i > 1 else float(i)
        row[31] = None
    names = [f"x{j}" for j in range(200)]
    df = spark.createDataFrame(cells, ", ".join(f"{n} double" for n in names))
    found = stats.correlations(df, names)
    own = np.array([[np.nan if v is None else v for v in row] for row in cells])
    for a, b in [(0, 3), (0, 1), (8, 9), (12, 15), (1, 2), (7, 1), (30, 1), (31, 1), (5, 5), (99, 198)]:
        both = ~np.isnan(own[:, a]) & ~np.isnan(own[:, b])
        u, v = own[both, a], own[both, b]
        if len(u) < 2 or u.std() == 0 or v.std() == 0:
            assert np.isnan(found[a, b])
        else:
            assert found[a, b] == pytest.approx(np.corrcoef(u, v)[0, 1], abs=1e-7)
    long = stats.correlation_pairs(df)
    assert long.count() == 199 * 100 and long.where("feature_1 = 'x7' OR feature_2 = 'x7'").where("correlation IS NOT NULL").count() == 0
    none = stats.correlation_matrix(df.select("x1", "x2").where("false"))
    assert none.count() == 4 and none.where("correlation IS NOT NULL").count() == 0


def test_csv_values_over_lines(spark, tmp_path):
    header = "LogID,UserID,Role,Timestamp,HTTP_Method,Endpoint,IP_Address,HTTP_Response"
    (tmp_path / "a.csv").write_text(f'{header}\na,1,"Nurse\non duty",2024-01-01 00:00:00,GET,"/x\n\n,y",10.0.0.1,200\nb,1,Nurse,2024-01-01 00:00:00,GET,/x,10.0.0.1,200\n')
    (tmp_path / "b.csv").write_text(f"{header}\nc,1,Nurse,2024-01-01 00:00:00,GET,/x,10.0.0.1,200\n")
    (tmp_path / "c.csv").write_text('Timestamp,Role,LogID,IP_Address,Endpoint,HTTP_Method\r\n2024-01-02,"Staff\r\nmember",d,10.0.0.2,/x,PUT\r\n')
    rows = {r.LogID: r for r in files.read_log_csv(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["a", "b", "c", "d"]
    assert (rows["a"].Role, rows["a"].Endpoint, rows["a"].HTTP_Response) == ("Nurse\non duty", "/x\n\n,y", 200)
    assert rows["d"].Role.split() == ["Staff", "member"] and rows["d"].HTTP_Method == "PUT" and rows["d"].UserID is None
    only = files.read_csv_by_name(spark, str(tmp_path / "c.csv"), {})
    assert only.count() == 1 and only.select(F.col("_path").endswith("c.csv")).first()[0]
