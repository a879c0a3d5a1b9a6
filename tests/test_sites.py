"""Numbering of the site table without a window over all rows."""

from __future__ import annotations

import random

from fieldstate.operators import sites


def test_numbers_follow_names_and_regions(spark):
    rng = random.Random(5)
    names = {"".join(rng.choice("abé-Z0") for _ in range(rng.randrange(0, 5))) for _ in range(60)}
    rows = [(n, r, rng.random() < 0.3) for n in [*sorted(names), None] for r in rng.sample(range(1000, 9000), rng.randrange(1, 4))]
    table = spark.createDataFrame(rng.sample(rows, len(rows)), "phenocam_name string, roi_id int, is_ltar boolean")
    got = sorted(tuple(r) for r in sites.site_table(table).collect())
    ordered = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    assert got == [(k, n, "yes" if flag else "no", r) for k, (n, r, flag) in enumerate(ordered, 1)]


def test_no_window_over_all_rows(spark):
    table = spark.createDataFrame([("a", 1, True)], "phenocam_name string, roi_id int, is_ltar boolean")
    plan = sites.site_table(table)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_empty_table(spark):
    assert sites.site_table(spark.createDataFrame([], "phenocam_name string, roi_id int, is_ltar boolean")).collect() == []
