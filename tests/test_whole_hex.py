"""The hexagonal queries over every part, against brute force."""

from skein import catalog


def near(a, b):
    (c, r), (d, s) = a, b
    if r == s:
        return abs(c - d) == 1
    return abs(r - s) == 1 and d - c in ((0, 1) if r % 2 else (-1, 0))


def test_every_part_is_a_tile(spark, tmp_path):
    size = {k: 1 + k * 7 % 50 if k < 200 else 4 + k % 2 for k in [*range(1, 60), *range(190, 290), 411, 412]}
    spark.createDataFrame(list(size.items()), "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    q, sf, at = catalog.QUERIES, str(tmp_path), {k: (k % 20, k // 20) for k in size}
    want = {(a, b) for a in size for b in size if near(at[a], at[b])}
    got = [(r.tile, r.other) for r in q["hex_neighbours_all"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want and max(want) == (412, 411)
    assert {(r.a, r.b) for r in q["border_pairs_all"](spark, sf).collect()} == {(size[a] % 6, size[b] % 6) for a, b in want if size[a] % 6 < size[b] % 6}

    def cube(c, r):
        q = c - (r - r % 2) // 2
        return q, r, -q - r

    steps = {k: max(abs(x - y) for x, y in zip(cube(*at[k]), cube(n % 20, n // 4), strict=True)) for k, n in size.items()}
    assert {r.id: r.distance for r in q["hex_distances_all"](spark, sf).collect()} == steps
