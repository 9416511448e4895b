"""The batch from lines to records, on lines that fit, leave the grid, or lie where there is no way."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gridloom.config import V2
from gridloom.grid import Grid
from gridloom.plans import validation


def test_cases_of_all_kinds(spark):
    cells = [(r, c, None if c == 30 else 1.0 + (r == 20) * -0.5, 100.0 + r, 3.0) for r in range(40) for c in range(60)]
    df = spark.createDataFrame(cells, "row int, col int, cost double, z double, slope double").withColumn("hard_mask", F.col("cost").isNotNull().cast("int"))
    grid = Grid(df, 40, 60)
    point = lambda r, c: (120 + (c + 0.5) * 0.001, 25.4 - (r + 0.5) * 0.001)
    lines = {1: [(5, c) for c in range(2, 26)], 2: [(5, 2), (5, 50)], 3: [(5, 2), (90, 2)], 4: [(20, 2), (20, 12), (20, 28)]}
    actual = spark.createDataFrame([(p, k, *point(r, c)) for p, line in lines.items() for k, (r, c) in enumerate(line)], "path_id long, seq int, lon double, lat double")
    cases = spark.createDataFrame([(p, f"case {p}") for p in (1, 2, 3, 4, 4, 9)], "path_id long, description string")
    found = validation.validate(grid, actual, cases, V2)
    by = {r.path_id: r for r in found.records.collect()}
    assert set(by) == {1, 2, 3, 4, 9} and by[1].description == "case 1"
    assert {p: by[p].fail_reason for p in (2, 3, 9)} == {2: "ASTAR_FAILED", 3: "ENDPOINT_INVALID", 9: "ENDPOINT_INVALID"}
    assert all(not by[p].quality_passed and by[p].hausdorff_m is None and by[p].n_predicted_vertices == 0 for p in (2, 3, 9))
    for p in (1, 4):
        assert by[p].fail_reason == "NONE" and by[p].quality_passed and by[p].n_passed == 7
    assert by[4].overlap_500m_pct == 100.0 and by[4].length_error_pct < 2 and by[4].hausdorff_m < 120
    one = found.summary.first()
    assert (one.n, one.n_passed) == (5, 2) and one.hausdorff_m_mean == pytest.approx((by[1].hausdorff_m + by[4].hausdorff_m) / 2)
    assert found.checks.filter("path_id = 4").count() == 7


def test_repeated_runs_and_their_test(spark):
    cells = [(r, c, 1.0 + (r % 7) * 0.1) for r in range(30) for c in range(30)]
    grid = Grid(spark.createDataFrame(cells, "row int, col int, cost double").withColumn("hard_mask", F.lit(1)), 30, 30, cell=90.0)
    actual = spark.createDataFrame([(p, k, 120.0005 + k * 0.001, 25.3995 - (5 + p) * 0.001) for p in (1, 2) for k in range(25)], "path_id long, seq int, lon double, lat double")
    runs = validation.compare(grid, actual, ["astar", "ipso_sa"], replace(V2, iterations=4, particles=4), runs=3).collect()
    assert sorted((r.path_id, r.algorithm, r.seed) for r in runs) == sorted([(p, "astar", 42) for p in (1, 2)] + [(p, "ipso_sa", s) for p in (1, 2) for s in (42, 43, 44)])
    assert all(r.hausdorff_m >= 0 and 0 <= r.overlap_500m_pct <= 100 for r in runs)
    (t,) = validation.tested(spark.createDataFrame(runs)).collect()
    assert t.algorithm == "ipso_sa" and t.n == 6
