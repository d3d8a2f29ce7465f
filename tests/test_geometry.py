"""Lines, spans, masks and cuts on small shapes."""

import math
import random
from collections import deque

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliometry.operators import clip, components, fissure, partition, polyline, raster, spans
from foliometry.queries import measures

LINE = "sec int, idx int, x double, y double"


def line(spark, points, k=1):
    return spark.createDataFrame([(k, i, float(x), float(y)) for i, (x, y) in enumerate(points)], LINE)


def shapes(spark, *rows):
    """(layer, rings as lists of points)"""
    return spark.createDataFrame([(1, layer, [[(float(x), float(y)) for x, y in r] for r in rings]) for layer, *rings in rows], "sec int, layer string, rings array<array<struct<x:double,y:double>>>")


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_length_is_scaled_by_axis(spark):
    got = polyline.total_length(line(spark, [(10, 10), (13, 14)]), ["sec"], 2.0, 1.0).first()
    assert got.length == pytest.approx(math.sqrt(52), abs=1e-9)


def test_places_along_a_line(spark):
    segs = polyline.segments(line(spark, [(0, 0), (10, 0), (10, 0), (10, 5)]), ["sec"])
    arcs = spark.createDataFrame([(1, float(a)) for a in (-1, 0, 4, 10, 12, 15, 99)], "sec int, arc double")
    got = {r.arc: (r.px, r.py) for r in polyline.points_at(segs, arcs, ["sec"]).collect()}
    assert got == {-1: (0, 0), 0: (0, 0), 4: (4, 0), 10: (10, 0), 12: (10, 2), 15: (10, 5), 99: (10, 5)}
    q = spark.createDataFrame([(1, 1, 4.0, 3.0), (1, 2, 20.0, 9.0), (1, 3, -5.0, 0.0)], "sec int, p int, qx double, qy double")
    near = {r.p: (r.arc, r.dist) for r in polyline.nearest(segs, q, ["sec"], ["p"]).collect()}
    assert near == {1: (4.0, 3.0), 2: (15.0, pytest.approx(math.hypot(10, 4))), 3: (0.0, 5.0)}


def test_nearest_places_equal_brute_force(spark):
    """Random walks, a line of many equal segments, a circle about a point, one vertex, lines without points and points without a line."""
    rng = np.random.default_rng(5)
    lines = {i: np.cumsum(rng.integers(-3, 4, (n, 2)), 0).astype(float) for i, n in enumerate((2, 3, 10, 61, 400))}
    lines[5] = np.array([(0.0, 0.0), (4.0, 0.0)] * 30)
    lines[6] = np.array([(math.cos(a), math.sin(a)) for a in np.linspace(0, 2 * math.pi, 100)])
    lines[7] = np.array([(3.0, 3.0), (3.0, 3.0)])
    lines[8] = np.array([(1.0, 1.0), (2.0, 1.0)])
    v = spark.createDataFrame([(k, i, float(x), float(y)) for k, p in lines.items() for i, (x, y) in enumerate(p)], "sec int, idx int, x double, y double")
    asked = [(k, p, float(x), float(y)) for k in [*range(8), 9] for p, (x, y) in enumerate([*rng.integers(-40, 40, (12, 2)), (0, 0), (2, 0), (2, 0)])]
    asked += [(0, 14, 2.0, 0.0), (0, 90, None, 1.0), (None, 91, 1.0, 1.0)]
    segs, points = polyline.segments(v, ["sec"]), spark.createDataFrame(asked, "sec int, p int, qx double, qy double")
    want = []
    for k, p, x, y in asked:
        if k not in lines or x is None:
            continue
        best, cum = None, 0.0
        for a, b in zip(lines[k][:-1], lines[k][1:], strict=True):
            d = b - a
            square = d[0] * d[0] + d[1] * d[1]
            t = 0.0 if square < 1e-12 else max(0.0, min(1.0, ((x - a[0]) * d[0] + (y - a[1]) * d[1]) / square))
            n = a + t * d
            dist = math.sqrt((x - n[0]) * (x - n[0]) + (y - n[1]) * (y - n[1]))
            if best is None or dist < best[0]:
                best = (dist, cum + t * math.sqrt(square), *n)
            cum += math.sqrt(square)
        want.append((k, p, best[1], best[0], *best[2:]))
    for most in (polyline.KERNEL_SIDES, 40, 0):  # in groups, some by blocks, all by blocks
        got = sorted(map(tuple, polyline.nearest(segs, points, ["sec"], ["p"], most).collect()))
        assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
        assert np.allclose([g[2:] for g in got], [w[2:] for w in sorted(want)], atol=1e-9)


def test_equally_near_outlines_keep_the_order_of_their_sides(spark):
    square = spark.createDataFrame([(1, "cb", [[(float(x), float(y)) for x, y in box(c, 0, 4, 4)] for c in (0, 10)])], "sec int, layer string, rings array<array<struct<x: double, y: double>>>")
    segs = fissure.outline_segments(square, ["sec"])
    q = spark.createDataFrame([(1, 1, 2.0, 2.0), (1, 2, 7.0, 2.0)], "sec int, p int, qx double, qy double")
    assert {r.p: (r.dist, r.nx, r.ny) for r in polyline.nearest(segs, q, ["sec"], ["p"]).collect()} == {1: (2.0, 2.0, 0.0), 2: (3.0, 4.0, 2.0)}
    assert segs.select("idx").distinct().count() == 8


def test_turn_and_strip(spark):
    ring = [(math.cos(math.radians(a)), math.sin(math.radians(a))) for a in range(0, 301, 10)]
    assert polyline.sweep_degrees(line(spark, ring), ["sec"], F.lit(0.0), F.lit(0.0)).first().degrees == pytest.approx(300)
    back = polyline.reverse(line(spark, ring), ["sec"])
    assert polyline.sweep_degrees(back, ["sec"], F.lit(0.0), F.lit(0.0)).first().degrees == pytest.approx(-300)
    bent = np.array([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (10.0, 10.0)])
    got = [(r.x, r.y) for r in polyline.strip(line(spark, bent), ["sec"], 2.0).orderBy("idx").collect()]
    assert np.allclose(got, raster.strip(bent, 2.0), atol=1e-5)


def test_spans_and_layers(spark):
    s = shapes(spark, ("cb", box(0, 0, 20, 10)), ("gl", box(5, 2, 20, 4)), ("wm", box(8, 3, 4, 2)), ("cb", box(30, 0, 2, 2)))
    cut = spans.cells(spans.rasterize(s, ["sec", "layer"]), ["sec"], ["cb", "gl", "wm"])
    got = spans.layer_pixels(cut, ["sec"]).first()
    assert (got.cb, got.grey, got.granular, got.molecular) == (204, 196, 80 - 8, 204 - 60)
    over = spans.outside(cut, ["sec"], "gl", "cb", 0.005).first()
    assert (over.inner_px, over.outside_px, over.percent) == (80, 20, 25.0)
    hole = shapes(spark, ("cb", box(0, 0, 10, 10), box(2, 2, 4, 4)))
    assert spans.rasterize(hole, ["sec"]).agg(F.sum(F.col("x1") - F.col("x0"))).first()[0] == 84
    clipped = spans.clip(spans.rasterize(shapes(spark, ("cb", box(-5, -5, 10, 10))), ["sec"]), F.lit(3), F.lit(4))
    assert clipped.agg(F.sum(F.col("x1") - F.col("x0"))).first()[0] == 12


def test_overlapping_spans_of_one_region(spark):
    """Region algebra against sets of pixels, with spans that overlap, nest, touch and are empty."""
    rng = random.Random(8)
    spans_of = lambda n: [(rng.randrange(3), 0, y, a, a + rng.randrange(9)) for _ in range(n) for y, a in ((rng.randrange(6), rng.randrange(-4, 20)),)]
    first, second = spans_of(120), spans_of(90)
    of = "sec int, piece int, y int, x0 int, x1 int"
    a, b = spark.createDataFrame(first, of), spark.createDataFrame(second, of)
    pixels = lambda rows: {(s, y, x) for s, _, y, x0, x1 in rows for x in range(x0, x1)}
    for got, want in ((spans.intersect(a, b, ["sec", "piece"]), pixels(first) & pixels(second)), (spans.subtract(a, b, ["sec", "piece"]), pixels(first) - pixels(second))):
        rows = [tuple(r) for r in got.select("sec", "piece", "y", "x0", "x1").collect()]
        assert pixels(rows) == want and len(pixels(rows)) == sum(r[4] - r[3] for r in rows)
        assert all((s, y, x0 - 1) not in want and (s, y, x1) not in want for s, _, y, x0, x1 in rows)
    both = spans.cells(a.withColumn("layer", F.lit("cb")).unionByName(b.withColumn("layer", F.lit("gl"))), ["sec"], ["cb", "gl", "wm"])
    assert both.where("wm").count() == 0 and both.agg(F.sum(F.when(F.col("cb") & F.col("gl"), F.col("x1") - F.col("x0")))).first()[0] == len(pixels(first) & pixels(second))


def flood(mask, diagonal=True):
    labels, n = np.full(mask.shape, -1), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if labels[start] < 0:
            labels[start], queue = n, deque([start])
            while queue:
                y, x = queue.popleft()
                for dx, dy in raster.AROUND:
                    p = y + dy, x + dx
                    if (diagonal or not dx or not dy) and 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and labels[p] < 0:
                        labels[p] = n
                        queue.append(p)
            n += 1
    return labels


@given(st.integers(0, 10**6))
@settings(deadline=None, max_examples=60)
def test_masks_against_flood_fill(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((8, 10)) < rng.uniform(0.2, 0.8)
    assert (raster.components(mask) == flood(mask)).all() and (raster.components(mask, False) == flood(mask, False)).all()
    outer = flood(np.pad(~mask, 1, constant_values=True), False)[1:-1, 1:-1]
    assert raster.enclosed(mask) == (outer > 0).sum()
    back = np.zeros_like(mask)
    for ring in raster.outline(mask):
        x, y = np.array(ring, float).T
        back ^= raster.polygon_mask(x, y, mask.shape)
    assert (back == mask).all()
    y, x0, x1, v = raster.spans_of(np.where(mask, 3, -1))
    assert (v == 3).all() and (raster.mask_of(y, x0, x1, mask.shape) == mask).all()


def mask_with(*boxes):
    m = np.zeros((60, 100), bool)
    for x, y, w, h in boxes:
        m[y : y + h, x : x + w] = True
    return m


def test_fixed_masks():
    assert mask_with((10, 10, 20, 5)).sum() == 100
    two = raster.components(mask_with((5, 5, 10, 10), (15, 15, 10, 10), (60, 5, 10, 10)))
    assert two.max() == 1 and (two >= 0).sum() == 300
    bar, cut = mask_with((10, 20, 80, 20)), mask_with((46, 0, 8, 60))
    raw = raster.components(bar & ~cut)
    assert raw.max() == 1 and (raw >= 0).sum() == 1440
    assert np.bincount(raster.complete(raw, bar, 10)[bar]).tolist() == [800, 800]
    tab = mask_with((10, 20, 80, 20), (48, 10, 4, 10))
    raw = raster.components(tab & ~mask_with((48, 18, 4, 3)))
    done = raster.complete(raw, tab, 100)
    assert raw.max() == 1 and done.max() == 0 and (done >= 0).sum() == tab.sum()


def test_holes_and_outlines_of_spans(spark):
    ring = shapes(spark, ("cb", box(0, 0, 20, 20), box(5, 5, 10, 10)), ("gl", box(0, 0, 20, 20)), ("wm", box(0, 0, 20, 20), box(5, 5, 5, 6)))
    filled = spans.rasterize(ring, ["layer"])
    got = {r.layer: (r.enclosed, r.ring) for r in components.holes(filled, ["layer"]).collect()}
    assert got == {"cb": (100, True), "gl": (0, False), "wm": (30, False)}
    traced = components.outlines(filled.where("layer = 'cb'"), ["layer"])
    again = spans.rasterize(traced, ["layer"])
    assert again.exceptAll(filled.where("layer = 'cb'").select("layer", "y", "x0", "x1")).count() == 0 and again.count() == filled.where("layer = 'cb'").count()


def test_interior_pixels(spark):
    labelled = components.label_spans(spans.rasterize(shapes(spark, ("cb", box(0, 0, 4, 3)), ("gl", box(10, 0, 5, 5))), ["layer"]), ["layer"])
    got = {r.layer: (r.x, r.y) for r in components.interior_pixels(labelled, ["layer"]).collect()}
    assert got == {"cb": (1, 1), "gl": (12, 2)}


def test_cuts_are_turned_and_extended(spark):
    s = shapes(spark, ("cb", box(0, 0, 100, 100)), ("gl", box(20, 20, 60, 60)), ("wm", box(40, 40, 20, 20)))
    filled = spans.rasterize(s, ["sec", "layer"])
    rows = [(1, 1, 0, 50.5, 30.0), (1, 1, 1, 50.5, 5.0), (1, 2, 0, 10.0, 50.5), (1, 2, 1, 14.0, 50.5), (1, 3, 0, -5.0, 50.5), (1, 3, 1, 45.0, 50.5)]
    lines = spark.createDataFrame(rows, "sec int, cut_id int, idx int, x double, y double")
    turned = fissure.outer_end_first(lines, filled, s, ["sec"], "cut_id")
    assert {r.cut_id: (r.depth_a, r.depth_b, r.reversed) for r in turned.collect()} == {1: (2, 1, True), 2: (1, 1, False), 3: (0, 3, False)}
    out = fissure.spanning_cuts(fissure.oriented(lines, turned, ["sec"], "cut_id"), filled, s, ["sec"], "cut_id")
    got = {}
    for r in out.orderBy("cut_id", "idx").collect():
        got.setdefault(r.cut_id, []).append((r.x, r.y))
    assert got[1] == [(50.5, -1.0), (50.5, 5.0), (50.5, 30.0), (50.5, 40.0)]
    assert got[2][0] == (-2.0, 50.5) and got[2][-1] == (40.0, 50.5) and len(got[3]) == 2


def test_partition_of_a_ribbon(spark):
    grey = spans.rasterize(shapes(spark, ("grey", box(10, 20, 80, 20))), ["sec"])
    cuts = spark.createDataFrame([(1, 1, 0, 50.0, 10.0), (1, 1, 1, 50.0, 50.0)], "sec int, cut_id int, idx int, x double, y double")
    got = partition.partition(grey, cuts, ["sec"]).groupBy("label", "ring", "expected", "clean", "assigned").agg(F.sum(F.col("x1") - F.col("x0")).alias("n")).orderBy("label").collect()
    assert [tuple(r) for r in got] == [(0, False, 2, True, 1600, 800), (1, False, 2, True, 1600, 800)]


@pytest.mark.parametrize(("points", "boxes", "length", "runs"), [([(10, 50.5), (190, 50.5)], [box(40, 0, 30, 100)], 30, 1), ([(10, 50.5), (190, 50.5)], [box(20, 0, 20, 100), box(150, 0, 20, 100)], 40, 2), ([(10, 10), (20, 10)], [box(100, 50, 10, 10)], None, 0)])
def test_line_in_region(spark, points, boxes, length, runs):
    region = spans.rasterize(shapes(spark, *(("r", b) for b in boxes)), ["sec"]).withColumn("label", F.lit(0))
    marked = clip.labelled_stretches(clip.stretches(line(spark, points), ["sec"]), region, ["sec"])
    got = clip.length_by_label(marked, ["sec"]).first()
    assert got is None if length is None else got.length == pytest.approx(length, abs=0.5)
    pieces = clip.runs(marked, ["sec"]).groupBy("run").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("run").collect()
    assert len(pieces) == runs and all(abs(r.b - r.a - length / runs) < 0.5 for r in pieces)


def test_stretches_hold_the_steps_that_are_walked(spark):
    """Every step of lines in all directions, on pixel borders too, walked one by one."""
    rng = random.Random(9)
    near = lambda: rng.choice([rng.uniform(-3, 9), float(rng.randrange(-3, 9)), rng.randrange(-12, 36) / 4])
    lines = {k: [(near(), near()) for _ in range(9)] for k in range(40)}
    lines[3] = [(2.0, 1.0), (2.0, 1.0), (2.0, 6.0), (7.0, 6.0), (7.0, 2.5), (0.0, 2.5)]
    region = [(k, y, a, a + 2, (a + 3) % 4) for k in lines for y in range(-3, 9) for a in (-3, -1, 2, 6)]
    walked, px, inside = {}, {}, {}
    spans_at = {(k, y, x): label for k, y, a, b, label in region for x in range(a, b)}
    for k, v in lines.items():
        for (x, y), (x2, y2) in zip(v, v[1:], strict=False):
            size = math.sqrt((x2 - x) ** 2 + (y2 - y) ** 2)
            n = max(1, math.ceil(size / 0.25))
            for s in range(n):
                m = (s / n + (s + 1) / n) / 2
                at = math.floor(y + m * (y2 - y)), math.floor(x + m * (x2 - x))
                px.setdefault(k, set()).add(at)
                walked[k] = walked.get(k, 0) + 1
                if (k, *at) in spans_at:
                    found = inside.setdefault((k, spans_at[k, *at]), [0, 0.0])
                    found[0] += 1
                    found[1] += size / n
    rows = [(k, i, x, y) for k, v in lines.items() for i, (x, y) in enumerate(v)]
    got = clip.stretches(spark.createDataFrame(rows, "sec int, idx int, x double, y double"), ["sec"]).cache()
    assert {r[0]: r[1] for r in got.groupBy("sec").agg(F.sum(clip.steps())).collect()} == walked
    assert {r.sec: r.px for r in clip.pixels_visited(got, ["sec"]).collect()} == {k: len(v) for k, v in px.items()}
    marked = clip.labelled_stretches(got, spark.createDataFrame(region, "sec int, y int, x0 int, x1 int, label int"), ["sec"]).cache()
    assert {(r[0], r[1]): r[2] for r in marked.groupBy("sec", "label").agg(F.sum(clip.steps())).collect()} == {k: v[0] for k, v in inside.items()}
    assert all(abs(r.length - inside[r.sec, r.label][1]) < 1e-9 for r in clip.length_by_label(marked, ["sec"]).collect())
    assert marked.count() < sum(v[0] for v in inside.values()) / 2


def test_outlines_are_dealt_out_and_their_spans_stay(spark, monkeypatch):
    """One file of few outlines makes its spans in many tasks; grouping by scanline shuffles no spans; nothing is broadcast."""
    rings = [[[(5.0, 5.0), (45.0, 5.0), (45.0, 65.0), (5.0, 65.0)], [(20.0, 20.0), (30.0, 20.0), (30.0, 30.0), (20.0, 30.0)]], [[(8.0, 80.0), (30.0, 80.0), (None, 81.0), (30.0, 99.0)]]]
    rows = [(i, layer, [[{"x": x, "y": y} for x, y in r] for r in shape]) for i in range(40) for layer in ("cb", "gl") for shape in rings]
    shapes_ = spark.createDataFrame(rows, "sec int, layer string, rings array<array<struct<x: double, y: double>>>").coalesce(1)
    filled = spans.rasterize(shapes_, ["sec", "layer"])
    want = sorted(tuple(r) for r in filled.collect())
    assert len({r[0] for r in filled.select(F.spark_partition_id()).distinct().collect()}) > 1
    cut = spans.cells(filled, ["sec"], ["cb", "gl"])
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    points = spark.createDataFrame([(1, 0, 6.0, 6.0)], "sec int, k int, qx double, qy double")
    assert "BroadcastHashJoin" not in spans.points_in(points, filled, ["sec"], ["k"])._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(spans, "CROSSINGS", 7)  # bands of few scanlines give the same
    assert sorted(tuple(r) for r in spans.rasterize(shapes_, ["sec", "layer"]).collect()) == want
    one = [r for r in want if r[:2] == (3, "cb")]
    assert [r for r in one if r[2] == 25] == [(3, "cb", 25, 5, 20), (3, "cb", 25, 30, 45)] and len([r for r in one if r[2] == 90]) == 1


def test_lines_are_dealt_out_by_their_number_before_they_grow(spark, monkeypatch):
    rows = [(s, i, 3.0 * i, 40.0 * (i % 2)) for s in range(60) for i in range(5)]
    lines = spark.createDataFrame(rows, "sec int, idx int, x double, y double").coalesce(1)
    monkeypatch.setattr(clip, "VERTICES", 10)
    walked = clip.stretches(lines, ["sec"])
    task = {(r.sec, r.task) for r in walked.select("sec", F.spark_partition_id().alias("task")).collect()}
    assert len(task) == 60 == len(dict(task)) and len(set(dict(task).values())) > 8  # 30 tasks, though few bytes; no shuffle after it
    monkeypatch.setattr(fissure, "VERTICES", 10)
    cuts = lines.withColumn("cut_id", F.lit(0))
    arcs = fissure.crossing_arcs(cuts, lines, ["sec"], "cut_id")
    assert "30), REPARTITION_BY_NUM" in arcs._jdf.queryExecution().toString()
    assert arcs.count() == 60


def test_a_line_is_clipped_where_it_meets_its_spans(spark, monkeypatch):
    """As the stretches within spans are, those that follow each other as one; also of lines on pixel borders, and in small pieces."""
    rng = random.Random(4)
    near = lambda: rng.choice([rng.uniform(-3, 9), float(rng.randrange(-3, 9)), rng.randrange(-12, 36) / 4])
    rows = [(k % 7, k, i, near(), near()) for k in range(40) for i in range(9)] + [(1, None, 0, 1.0, 1.0), (1, None, 1, 5.0, 5.0), (1, 50, 0, 1.0, 1.0), (1, 51, 0, None, 1.0), (1, 51, 1, 2.0, 2.0)]
    region = [(k % 7, k, y, a, a + 2, "abcd"[(a + 3) % 4]) for k in range(1, 60) for y in range(-3, 9, 1 + k % 2) for a in (-3, -1, 2, 6)] + [(1, None, 2, 0, 9, "a")]
    keys = ["sec", "no"]
    lines = spark.createDataFrame(rows, "sec int, no int, idx int, x double, y double")
    spans_ = spark.createDataFrame(region, "sec int, no int, y int, x0 int, x1 int, label string")
    want = clip.labelled_stretches(clip.stretches(lines, keys, 2.0, 0.5), spans_, keys).cache()
    steps_of = lambda df: sorted(tuple(r) for r in df.select(*keys, "seg", "x", "y", "x2", "y2", "n", "step_len", "label", F.explode(F.sequence("s0", "s1"))).collect())
    runs_of = lambda df: sorted(tuple(r) for r in clip.runs(df, keys).collect())
    got = clip.clipped(lines, spans_, keys, 2.0, 0.5).cache()
    assert steps_of(got) == steps_of(want) and runs_of(got) == runs_of(want)
    assert got.count() < want.count() * 0.8
    monkeypatch.setattr(clip, "PAIRS", 5)
    again = clip.clipped(lines, spans_, keys, 2.0, 0.5)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_runs_of_lines_move_no_stretches(spark):
    plan = measures.line_runs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(row#" not in plan and "explode(sequence(" not in plan  # a stretch for each scanline is neither made nor moved
