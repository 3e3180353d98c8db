"""Joins that hold the nodes, not the edges."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from caseworks.operators import enrich
from caseworks.plans import sizes


def test_related_holds_no_edges(spark, monkeypatch):
    rng = random.Random(9)
    links = [(rng.randrange(40), rng.randrange(40), rng.choice("ab")) for _ in range(200)]
    names, asked = {i: f"n{i}" for i in range(35)}, [1, 2, 2, 3, None, 30]
    edges = spark.createDataFrame(links, "src long, dst long, rel string")
    nodes, ids = spark.createDataFrame(list(names.items()), "id long, name string"), spark.createDataFrame([(i,) for i in asked], "id long")
    found = [(d, i, "out", r, names[d]) for i, d, r in links if i in asked and d in names] + [(s, i, "in", r, names[s]) for s, i, r in links if i in asked and s in names]
    monkeypatch.setattr(enrich, "small", lambda df: sizes.small(df, -1))  # as for large tables
    out = enrich.related(nodes, edges, ids)
    assert out.columns == ["other", "id", "direction", "rel", "name"]
    assert sorted(map(tuple, out.collect())) == sorted(found)
    assert "Sort" not in out._jdf.queryExecution().executedPlan().toString()
    one = enrich.related(nodes, edges, ids, "a", "in")
    assert sorted(map(tuple, one.collect())) == sorted(x for x in found if x[2] == "in" and x[3] == "a")
    assert one.where(F.col("rel").isNull()).count() == 0
