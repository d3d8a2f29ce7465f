"""Components, holes, growth and partitions as joins against the kernels of one image."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliometry.operators import components, connected, partition, raster
from foliometry.operators import spans as filling
from foliometry.plans.store import Scratch

KEYS = ["image", "piece"]


@pytest.fixture(scope="module")
def keep(spark):
    with Scratch(spark) as made:
        yield made


def masks():
    """Random noise of several densities, blobs, a spiral, rings in rings, one pixel, lines apart."""
    rng = np.random.default_rng(7)
    out = [rng.random((14, 17)) < d for d in (0.15, 0.35, 0.5, 0.62, 0.85)] + [np.repeat(np.repeat(rng.random((9, 9)) < 0.5, 3, 0), 3, 1) for _ in range(2)]
    spiral = np.zeros((21, 21), bool)
    y = x = 0
    dx, dy, left = 1, 0, 20
    spiral[0, 0] = True
    while left > 0:
        for _ in range(left):
            y, x = y + dy, x + dx
            spiral[y, x] = True
        dx, dy = -dy, dx
        if dx == 0 or left < 20:
            left -= 1 if dx else 2
        else:
            left -= 1
    rings = np.zeros((40, 40), bool)
    for r, v in ((19, True), (16, False), (11, True), (7, False), (2, True)):
        rings[20 - r : 20 + r, 20 - r : 20 + r] = v
    apart = np.zeros((9, 5), bool)
    apart[::4, 1:3] = True
    return [*out, spiral, rings, np.ones((1, 1), bool), apart]


@pytest.fixture(scope="module")
def spans(spark):
    rows = []
    for i, m in enumerate(masks()):
        y, x0, x1, _ = raster.spans_of(m)
        rows += [(f"m{i}", i % 2, int(a) - 3, int(b) - 5, int(c) - 5) for a, b, c in zip(y, x0, x1, strict=True)]  # places may be negative
    return spark.createDataFrame(rows, "image string, piece int, y int, x0 int, x1 int").repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_components_equal_the_kernel(spans, keep, diagonal=False):
    columns = [*KEYS, "y", "x0", "x1", "label"]
    got = connected.label_spans(spans, KEYS, keep, diagonal).select(*columns)
    assert rows(got) == rows(components.label_spans(spans, KEYS, diagonal).select(*columns))


def test_spans_of_a_line_that_overlap_are_one_node(spark, keep):
    df = spark.createDataFrame([("a", 0, 0, 0, 9), ("a", 0, 0, 2, 3), ("a", 0, 0, 5, 6), ("a", 0, 0, 9, 11), ("a", 0, 2, 0, 1)], "image string, piece int, y int, x0 int, x1 int")
    assert [r[-1] for r in rows(connected.label_spans(df, KEYS, keep).select(*KEYS, "y", "x0", "x1", "label"))] == [0, 0, 0, 0, 1]
    assert connected.label_spans(df.where("y > 5"), KEYS, keep).count() == 0


def test_the_bound_chooses_the_way(spans):
    columns = [*KEYS, "y", "x0", "x1", "label"]
    plain = rows(components.label_spans(spans, KEYS).select(*columns))
    assert rows(components.label_spans(spans, KEYS, most_spans=40).select(*columns)) == plain  # some images beyond it, some not
    assert rows(components.holes(spans, KEYS, most_spans=40).select(*KEYS, "enclosed")) == rows(components.holes(spans, KEYS).select(*KEYS, "enclosed"))


def test_long_chains_need_few_rounds(spark):
    edges = spark.range(4000).select(F.lit("a").alias("image"), F.lit(0).alias("piece"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with Scratch(spark) as made:
        out = connected.contracted(edges, KEYS, made)
        assert out.agg(F.max("_root"), F.count("*")).first()[:] == (0, 4001)
        assert made.n < 20


def test_outlines_fill_to_the_same_pixels(spark, spans, keep):
    rings = connected.outline_vertices(spans, KEYS, keep)
    v = rings.toPandas().sort_values([*KEYS, "ring", "idx"])
    assert (v.groupby([*KEYS, "ring"]).idx.agg(["min", "max", "size"]) == v.groupby([*KEYS, "ring"]).idx.agg([lambda i: 0, lambda i: len(i) - 1, "size"]).to_numpy()).all(axis=None)
    for _, r in v.groupby([*KEYS, "ring"]):
        xy = r[["x", "y"]].to_numpy()
        turn = np.roll(xy, -1, 0) - xy
        assert (turn[::2, 1] == 0).all() and (turn[1::2, 0] == 0).all() and (np.abs(turn).sum(1) > 0).all() and turn[0, 0] > 0
        assert tuple(xy[0][::-1]) == min(map(tuple, xy[:, ::-1]))
    assert not v.duplicated([*KEYS, "x", "y"]).any()
    shapes = connected.outlines(spans, KEYS, keep)
    pixels = lambda df: {(*r[:2], r.y, x) for r in df.select(*KEYS, "y", "x0", "x1").collect() for x in range(r.x0, r.x1)}
    assert pixels(filling.rasterize(shapes, KEYS)) == pixels(spans)
    # where no two pixels touch by a corner only, rings are those of the kernel, which has them in another order
    clean = F.col("image").isin("m7", "m8", "m9", "m10")
    known = lambda df: sorted((r.image, sorted(sorted((p.x, p.y) for p in ring) for ring in r.rings)) for r in df.where(clean).collect())
    assert known(shapes) == known(components.outlines(spans, KEYS)) != []
    assert pixels(filling.rasterize(components.outlines(spans, KEYS, most_spans=40), KEYS)) == pixels(spans)
    assert connected.outline_vertices(spans.where("y > 1000"), KEYS, keep).count() == 0


def test_outlines_of_images_within_the_bound_take_no_rounds(spark, spans, keep, monkeypatch):
    more = spark.createDataFrame([("a", 0, 0, 0, 9), ("a", 0, 0, 2, 3), ("a", 0, 0, 9, 11), ("a", 0, 1, 3, 5), ("a", 0, -4, 7, 8), ("a", 1, 2, 3, 3)], "image string, piece int, y int, x0 int, x1 int")
    every = spans.unionByName(more)
    plain = connected.outline_vertices(every, KEYS, keep)
    want = rows(plain)
    some = components.outline_vertices(every, KEYS, most_spans=40)
    assert some.dtypes == plain.dtypes and rows(some) == want  # some images beyond it, some not
    monkeypatch.setattr(components, "stored", None)  # no table is written
    got = components.outline_vertices(every, KEYS)
    assert rows(got) == want and rows(components.outline_vertices(every.where("y > 1000"), KEYS)) == []


def test_overlapping_spans_have_one_outline_and_long_rings_need_few_rounds(spark):
    rows_ = [("a", 0, 0, 0, 9), ("a", 0, 0, 2, 3), ("a", 0, 0, 9, 11), ("a", 0, 1, 3, 5)]
    stairs = [("b", 0, y, 0, 3 * y + 1) for y in range(3000)]
    df = spark.createDataFrame(rows_ + stairs, "image string, piece int, y int, x0 int, x1 int")
    with Scratch(spark) as made:
        v = connected.outline_vertices(df, KEYS, made)
        got = [(r.x, r.y) for r in v.where("image = 'a'").orderBy("ring", "idx").collect()]
        assert got == [(0, 0), (11, 0), (11, 1), (5, 1), (5, 2), (3, 2), (3, 1), (0, 1)]
        assert v.where("image = 'b'").count() == 2 * 3000 + 2 and made.n < 18


def test_completion_equals_the_kernel(spark, keep):
    rng = np.random.default_rng(1)
    parts, region, want, least = [], [], [], []
    for i in range(6):
        whole = np.kron(rng.random((6, 7)) < 0.8, np.ones((4, 4), bool)).astype(bool)
        some = whole & (rng.random(whole.shape) < 0.45)
        label = raster.components(some)
        n = int(rng.integers(2, 9))
        for rows_of, m in ((parts, label), (region, np.where(whole, 0, -1))):
            y, x0, x1, v = raster.spans_of(m)
            rows_of += [(f"i{i}", 0, int(a), int(b), int(c), int(d)) for a, b, c, d in zip(y, x0, x1, v, strict=True)]
        done = raster.complete(label, whole, n)
        y, x0, x1, v = raster.spans_of(done)
        want += [(f"i{i}", 0, int(a), int(b), int(c), int(d)) for a, b, c, d in zip(y, x0, x1, v, strict=True)]
        least.append((f"i{i}", 0, n))
    of = "image string, piece int, y int, x0 int, x1 int, label int"
    region = spark.createDataFrame(region, of).drop("label")
    got = connected.complete(spark.createDataFrame(parts, of), region, spark.createDataFrame(least, "image string, piece int, least long"), KEYS, keep)
    assert rows(got.select(*KEYS, "y", "x0", "x1", "label")) == sorted(want)


def test_partition_equals_the_kernel_and_takes_solved_regions_out(spark):
    shapes, cuts = [], []
    for i, (w, h, lines) in enumerate([(90, 30, [30, 60]), (90, 30, [30, 60]), (60, 40, [20]), (80, 20, [])]):
        hole = i == 1
        for y in range(h):
            edge = [(0, w)] if not hole or not 12 <= y < 18 else [(0, 10), (w - 10, w)]
            shapes += [(f"p{i}", 0, y, a, b) for a, b in edge]
        for c, x in enumerate(lines):
            reach = h + 2.0 if i != 2 else h - 3.0  # the third stops short: wider strips are tried, in vain
            cuts += [(f"p{i}", 0, c, k, x + 0.3 * k, y) for k, y in enumerate((-2.0, h / 3, reach))]
    grey = spark.createDataFrame(shapes, "image string, piece int, y int, x0 int, x1 int")
    lines = spark.createDataFrame(cuts, "image string, piece int, cut_id int, idx int, x double, y double")
    columns = [*KEYS, "y", "x0", "x1", "label", "ring", "expected", "kept", "clean", "half_width", "area", "assigned"]
    plain = partition.partition(grey, lines, KEYS).select(*columns)
    with Scratch(spark) as made:
        got = connected.partition(grey, lines, KEYS, made).select(*columns)
        assert rows(got) == rows(plain)
    chosen = partition.partition(grey, lines, KEYS, most_pixels=20_000).select(*columns)
    assert rows(chosen) == rows(plain)
    how = {r[0]: r[7:10] for r in rows(plain)}
    assert set(how) == {"p0", "p1", "p2"} and how["p2"] == (2, 1, False) and how["p0"] == (3, 3, True) and how["p1"][0] == 2
