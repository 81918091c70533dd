"""The neighbour lists without an end at 8."""

from skein import catalog
from tests.test_whole_paths import lines


def test_a_hub_keeps_all_neighbours(spark, tmp_path):
    sf = lines(spark, tmp_path, [(1, k) for k in range(2, 14)] + [(1, 13), (1, 12), (1, 13)])
    got = {r.node: r.neighbours for r in catalog.QUERIES["neighbour_lists_all"](spark, sf).collect()}
    assert got == {1: ",".join(map(str, [13, 12, *range(2, 12)]))} | {k: "1" for k in range(2, 14)}
