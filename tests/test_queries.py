import numpy as np
import pytest
from oracle import same

from seqloom import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


def test_query_without_sql(spark):
    """Which matches local pruning keeps is tested by brute force in test_kernels.py; here: that the query keeps some."""
    assert registry.queries().keys() - registry.oracle_sql().keys() == {"matches_locally_pruned", "long_affine_align"}
    place = ["id", "start_i", "start_j", "end_i", "end_j"]
    kept = registry.queries()["matches_locally_pruned"](spark, SF).select(place)
    every = registry.queries()["matches_exact"](spark, SF).select(place)
    assert kept.exceptAll(every).count() == 0 < kept.count() < every.count()


def test_long_scripts_without_sql(spark):
    """Costs are those of grids that are filled row by row, and of the scripts' own parts."""

    def cost(a, b):
        b, steps = np.frombuffer(b, np.uint8), np.arange(len(b) + 1)
        gaps = np.full(len(b) + 1, 1 << 20)
        row = np.where(steps, 2 + steps, 0)
        for c in a:
            gaps = np.minimum(gaps, row + 2) + 1
            t = np.minimum(np.r_[1 << 20, row[:-1] + (b != c)], gaps)
            before = np.r_[1 << 20, np.minimum.accumulate(t - steps)[:-1]]
            row = np.minimum(t, before + steps + 2)
        return int(row[-1])

    pairs = {r.id: (r.a.encode(), r.b.encode()) for r in registry.very_long_pairs(spark, SF).collect()}
    rows = registry.queries()["long_affine_align"](spark, SF).collect()
    assert len(rows) == len(pairs) == 10
    for r in rows:
        a, b = pairs[r.id]
        assert (r.cost, r.script_cost, r.used_a, r.used_b) == (cost(a, b), r.cost, len(a), len(b)) and len(a) == 5000


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1500
    assert registry.queries().keys() <= __spark_entry__.queries().keys()
    assert registry.oracle_sql().keys() <= __spark_entry__.oracle_sql().keys()
