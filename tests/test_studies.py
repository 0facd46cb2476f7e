"""Cells of three universes by three primaries."""

from tesserae.plans import studies


def test_nine_cells_count_tasks_as_rows(spark):
    """Cells against their definition; tasks are counted without their ids being told apart nine times."""
    rows = [(t, s, "ANR"[(t + s) % 3] if t else "N", (t * s) % 2, [(t + s) % 2]) for t in range(12) for s in range(1 + t % 10)]
    frame = spark.createDataFrame(rows, "task_id long, slot int, category string, prediction int, secondary array<int>")
    got = studies.nine_cells(frame)
    sizes = {t: sum(r[0] == t for r in rows) for t in range(12)}
    want = set()
    for d in range(9):
        kept = [r for r in rows if d < 3 or (d < 6 and 2 <= sizes[r[0]] <= 8) or (d >= 6 and r[2] != "N")]
        bit = [lambda r: r[3], lambda r: r[4][0], lambda r: max(r[3], r[4][0])][d % 3]
        want.add((d, ("all", "small", "binary")[d // 3], len(kept), len({r[0] for r in kept}), sum(map(bit, kept))))
    assert {tuple(r) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan and plan.count("Aggregate [") == 2
