"""Rows that are the first of all their keys, against the plain form, with equal rows, ties and missing keys."""

import random

from worksight.plans import relational as R


def test_first_of_every_key(spark, tmp_path):
    r = random.Random(7)
    kinds = dict(zip(R.LINE_ORDER, ("long", "int", "long", "long", "double", "double", "double", "double", "string", "string", "string")))
    row = lambda: (r.randint(0, 20), r.randint(1, 2), r.choice([1, 2, 3, None]), r.choice([1, 2, None]), 1.0, r.choice([1.0, 2.0]), 0.0, 0.0, "N", r.choice(["O", "F", None]), "x")
    rows = [row() for _ in range(200)]
    rows += rows[:40]
    spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in kinds.items())).repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    first, want = {}, []
    order = lambda x: tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in x)
    for x in sorted(set(rows), key=order):
        keys = [k for k in (("P", x[0], x[2]), ("S", x[0], x[3], x[9])) if None not in k]
        if [first.setdefault(k, x) == x for k in keys].count(False) == 0 and keys:
            want.append((x[0], x[1], x[2], x[3]))
    got = R.QUERIES["dedupe_first_seen"](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1  # the rows move once
