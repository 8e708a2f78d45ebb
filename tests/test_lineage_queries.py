"""The lineage queries take every customer's chain of orders, against plain loops over a small table."""

from __future__ import annotations

import random

from tallyspark import catalog


def test_all_chains_get_ancestors_replacements_and_checks(spark, tmp_path):
    rng = random.Random(6)
    orders = [(k, rng.choice([3, 7, 10, 20, 41]), rng.choice(["1-URGENT", "5-LOW"])) for k in range(1, 121)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    chains, identity = {}, {k: p for k, _, p in orders}
    for k, customer, _ in orders:
        chains.setdefault(customer, []).append(k)
    up = {(b, a, j - i) for c in chains.values() for j, b in enumerate(c) for i, a in enumerate(c[:j])}
    found = {name: {tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()} for name in ("ancestry", "history_replacement", "ancestry_violations")}
    assert found["ancestry"] == up
    last = {}
    for c in chains.values():
        having = [(j, k) for j, k in enumerate(c, 1) if k % 5]
        last.update({k: (k, having[-1][1], having[-1][0]) for j, k in having[:-1] if k % 6})
    assert found["history_replacement"] == set(last.values())
    parents = {b: a for b, a, depth in up if depth == 1 and b % 40}
    rules = {(b, "unknown_parent" if a % 40 == 0 else "other_identity") for b, a in parents.items() if a % 40 == 0 or identity[a] != identity[b]}
    assert found["ancestry_violations"] == rules
