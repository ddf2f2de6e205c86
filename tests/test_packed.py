"""Owners that share keys, counted from packed rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from tessera.operators import library
from tessera.operators.packed import pack, unpack


def test_pack_and_unpack():
    rng = random.Random(1)
    rows = [sorted({rng.choice([-1, 1]) * rng.randrange(1 << rng.randrange(1, 63)) for _ in range(n)}) for n in (1, 5, 40, 3)] + [[-(1 << 63), -1, 0, 127, 128, 16384, (1 << 63) - 1]]
    flat, first = np.array(sum(rows, []), np.int64), np.cumsum([0] + [len(r) for r in rows[:-1]])
    column = pack(flat, first)
    got, size = unpack(pa.concat_arrays([pa.nulls(1, pa.binary()), column, pa.nulls(1, pa.binary())]).slice(1))
    assert got.tolist() == flat.tolist() and size.tolist() == [len(r) for r in rows] + [0]
    assert len(pack(flat[:0], first[:0])) == 0 and len(pack(np.arange(100), np.zeros(1, np.int64))[0].as_py()) == 100
    assert [len(x) for x in unpack(column.slice(0, 0))] == [0, 0]


def brute(links, claims, limit):
    key = lambda s: (s is None, s or 0 if s is None or isinstance(s, int) else s)
    out = set()
    for c in {c for c, _ in claims}:
        own = {k for d, k in claims if d == c and k is not None}
        n = {s: len(own & {k for t, k in links if t == s}) for s in {s for s, _ in links}}
        out |= {(c, s, m) for m, s in sorted(((m, s) for s, m in n.items() if m), key=lambda p: (-p[0], *key(p[1])))[:limit]}
    return out


@pytest.mark.parametrize("kind", ["long", "int", "string"])
@pytest.mark.parametrize("batch", [3, 10000])
def test_candidates_equal_brute_force(spark, kind, batch):
    rng = random.Random(batch)
    name = (lambda i: f"s{i:03d}") if kind == "string" else (lambda i: i * 1000 - 5000)
    links = [(rng.choice([None, *map(name, range(14))]), rng.choice([None, *range(12)])) for _ in range(160)] + [(None, 11)] * 2
    claims = [(rng.choice([None, *range(9)]), rng.choice([None, *range(14)])) for _ in range(150)] + [(70, 11)] * 3 + [(71, 99), (72, 0)]
    left, right = spark.createDataFrame(claims, "claim_id long, concept_id int"), spark.createDataFrame(links, f"strategy_id {kind}, concept_id int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for limit in (1, 4):
            df = library.candidate_strategies(right, left, limit)
            got = [tuple(r) for r in df.collect()]
            assert len(got) == len(set(got)) and set(got) == brute(links, claims, limit)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert df.schema["strategy_id"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)
    assert library.candidate_strategies(right.limit(0), left).count() == 0 == library.candidate_strategies(right, left.limit(0)).count()


def test_pairs_of_claims_and_strategies_are_not_shuffled(spark):
    left, right = (spark.range(300).selectExpr(f"id % 40 as {c}", "id % 7 as concept_id") for c in ("claim_id", "strategy_id"))
    plan = library.candidate_strategies(right, left)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*claim_id[^)]*strategy_id", plan) and "Window" not in plan


@pytest.mark.parametrize("name", ["knw09_candidates", "knw09_candidates_of_all"])
def test_candidate_queries_shuffle_no_pairs(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*claim_id[^)]*strategy_id", plan) and plan.count("held#") > 0
