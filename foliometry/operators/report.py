"""Results as tables for people: grid, run information, named regions and draw items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fixed4, short_number

GRID = ("measurement", "cerebellum", "grey", "granular", "molecular", "purkinje")
#: Fills of sections in turn, as red, green and blue, and of layers.
SECTION_FILLS = ((255, 100, 80), (255, 180, 60), (180, 255, 80), (60, 210, 120), (60, 200, 240), (80, 120, 255), (180, 80, 255), (255, 80, 200), (255, 230, 90), (40, 170, 170), (200, 140, 90), (150, 150, 255))
LAYER_FILLS = (("Grey Matter", (0, 0, 255), "#0000FF"), ("Granular Layer", (0, 200, 0), "#00FF00"), ("Molecular Layer", (255, 230, 0), "#FFFF00"))
FILL_ALPHA, LINE_WIDTH, AREA_WIDTH = 60, 1.5, 1.0
#: Names of draw items that older runs made without a mark.
LEGACY_ITEM = r"^(\[\d+\] )?(Grey Matter|Granular Layer|Molecular Layer|Purkinje|Fissure\d+|\d+(/\d+)?Cb|Section \d+)$"


def headers(area_unit: str, length_unit: str) -> list[str]:
    """The columns' titles with their units."""
    return ["Measurement", *(f"{t} ({area_unit})" for t in ("Cerebellum", "Grey Matter", "Granular Layer", "Molecular Layer")), f"Purkinje ({length_unit})"]


def results_table(totals: DataFrame, parts: DataFrame) -> DataFrame:
    """section_id, row_idx, measurement and five numbers at full precision: areas, length, a row for each section."""
    none = F.lit(None).cast("double")
    row = lambda i, name, *cells: F.struct(F.lit(i).alias("row_idx"), F.lit(name).alias("measurement"), *(c.alias(n) for c, n in zip(cells, GRID[1:], strict=True)))
    areas = row(1, "Area", *(F.col(c) for c in ("cerebellum", "grey", "granular", "molecular", "purkinje_area")))
    lengths = row(2, "Length", none, none, none, none, F.col("purkinje_len"))
    top = totals.select("section_id", F.explode(F.array(areas, lengths)).alias("r")).select("section_id", "r.*")
    return top.unionByName(parts.select("section_id", (F.col("ord") + 2).cast("int").alias("row_idx"), F.col("name").alias("measurement"), none.alias("cerebellum"), none.alias("grey"), "granular", "molecular", "purkinje"))


def results_grid(totals: DataFrame, parts: DataFrame) -> DataFrame:
    """section_id, row_idx and six text columns: header, areas, length, then a row for each section."""
    none = F.lit(None).cast("string")
    of_area = lambda label: F.concat(F.lit(f"{label} ("), F.col("area_unit"), F.lit(")"))
    header = (F.lit("Measurement"), of_area("Cerebellum"), of_area("Grey Matter"), of_area("Granular Layer"), of_area("Molecular Layer"), F.concat(F.lit("Purkinje ("), F.col("length_unit"), F.lit(")")))
    areas = (F.lit("Area"), *(fixed4(F.col(c)) for c in ("cerebellum", "grey", "granular", "molecular", "purkinje_area")))
    lengths = (F.lit("Length"), none, none, none, none, fixed4(F.col("purkinje_len")))
    row = lambda i, cells: F.struct(F.lit(i).alias("row_idx"), *(c.alias(n) for c, n in zip(cells, GRID, strict=True)))
    top = totals.select("section_id", F.explode(F.array(*(row(i, c) for i, c in enumerate((header, areas, lengths))))).alias("r")).select("section_id", "r.*")
    rest = parts.select("section_id", (F.col("ord") + 2).cast("int").alias("row_idx"), F.col("name").alias("measurement"), none.alias("cerebellum"), none.alias("grey"), *(fixed4(F.col(c)).alias(c) for c in ("granular", "molecular", "purkinje")))
    return top.unionByName(rest)


def pixel_size(px_w: Column, px_h: Column, unit: Column) -> Column:
    scaled = unit.isNotNull() & (unit != "pixel") & (unit != "")
    text = F.concat(short_number(px_w), F.lit(" × "), short_number(px_h), F.lit(" "), unit)
    return F.when(scaled, text).otherwise(F.lit("not calibrated (areas in pixel², lengths in pixels)"))


def piece_description(sections: Column, has_wm: Column, fissures: Column, ring: Column, joined: Column) -> Column:
    # fixed values: the sentences of run information
    unsplit = F.when(~has_wm, "not split into sections (no White Matter)").otherwise("not split into sections (no fissures traced)")
    shape = F.when(ring, "grey matter is a closed ring").otherwise("grey matter pinched open at the peduncle")
    ends = F.when(joined, "; first and last sections joined").otherwise("")
    return F.when(sections == 0, unsplit).otherwise(F.concat(fissures.cast("string"), F.lit(" fissure(s), "), sections.cast("string"), F.lit(" section(s); "), shape, ends))


def run_info(sections: DataFrame, pieces: DataFrame, warnings: DataFrame) -> DataFrame:
    """section_id, seq, field, value in fixed order.

    ``sections``: title, file, width, height, px_w, px_h, unit. ``pieces``: instance and the
    columns of ``piece_description``. ``warnings``: section_id, n.
    """
    listed = pieces.groupBy("section_id").agg(F.sort_array(F.collect_list(F.struct("instance", piece_description(*(F.col(c) for c in ("sections", "has_wm", "fissures", "ring", "joined"))).alias("text")))).alias("p"))
    s = sections.join(listed, "section_id", "left").join(warnings, "section_id", "left")
    size = F.concat(F.col("width").cast("string"), F.lit(" × "), F.col("height").cast("string"), F.lit(" pixels"))
    pair = lambda f, v: F.struct(F.lit(f).alias("field") if isinstance(f, str) else f.alias("field"), v.alias("value"))
    no_pieces = F.array().cast("array<struct<field: string, value: string>>")
    each = F.transform("p", lambda p: pair(F.concat(F.lit("Piece "), p["instance"].cast("string")), p["text"]))
    fields = F.concat(
        F.array(pair("Image", F.col("title"))),
        F.when(F.col("file").isNotNull(), F.array(pair("Image file", F.col("file")))).otherwise(no_pieces),
        F.array(pair("Image size", size), pair("Pixel size", pixel_size(F.col("px_w"), F.col("px_h"), F.col("unit"))), pair("Traced pieces", F.coalesce(F.size("p"), F.lit(0)).cast("string"))),
        F.coalesce(each, no_pieces),
        F.array(pair("Warnings", F.coalesce("n", F.lit(0)).cast("string"))),
    )
    return s.select("section_id", F.posexplode(fields).alias("seq", "f")).select("section_id", "seq", "f.field", "f.value")


def piece_prefix(instance: Column, n_inst: Column) -> Column:
    return F.when(n_inst > 1, F.concat(F.lit("["), instance.cast("string"), F.lit("] "))).otherwise(F.lit(""))


def region_names(pieces: DataFrame, parts: DataFrame, runs: DataFrame) -> DataFrame:
    """section_id, seq, name of the regions and line stretches that a run adds, from ``named_regions``."""
    return named_regions(pieces, parts, runs).select("section_id", "seq", "name")


def named_regions(pieces: DataFrame, parts: DataFrame, runs: DataFrame) -> DataFrame:
    """section_id, instance, ord, k, seq, name: whole layers have ord 0; k tells layers from line stretches.

    ``pieces``: instance. ``parts``: instance, ord, name, granular, molecular (0 leaves a region out).
    ``runs``: instance, ord, run.
    """
    n_inst = F.count(F.lit(1)).over(Window.partitionBy("section_id"))
    named = pieces.select("section_id", "instance", piece_prefix(F.col("instance"), n_inst).alias("pre"))
    layer = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(n).alias("what")) for i, (n, _, _) in enumerate(LAYER_FILLS)))).alias("l")
    layers = named.select("section_id", "instance", F.lit(0).alias("ord"), layer, "pre").select("section_id", "instance", "ord", "l.k", F.concat("pre", "l.what").alias("name"))
    own = parts.join(named, ["section_id", "instance"])
    kinds = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.struct(F.lit(i).alias("k"), F.lit(f"_{t}").alias("what"))) for i, (c, t) in enumerate((("granular", "Granular"), ("molecular", "Molecular"))))))
    regions = own.select("section_id", "instance", "ord", F.explode(kinds).alias("l"), "pre", "name").select("section_id", "instance", "ord", "l.k", F.concat("pre", "name", "l.what").alias("name"))
    count = F.count(F.lit(1)).over(Window.partitionBy("section_id", "instance", "ord"))
    suffix = F.when(count == 1, F.lit("_Purkinje")).otherwise(F.concat(F.lit("_Purkinje_"), F.col("run").cast("string")))
    lines = runs.withColumn("suffix", suffix).join(own.select("section_id", "instance", "ord", "pre", "name"), ["section_id", "instance", "ord"])
    lines = lines.select("section_id", "instance", "ord", (F.col("run") + 1).alias("k"), F.concat("pre", "name", "suffix").alias("name"))
    every = layers.unionByName(regions).unionByName(lines)
    seq = F.row_number().over(Window.partitionBy("section_id").orderBy("instance", "ord", "k")) - 1
    return every.select("section_id", "instance", "ord", "k", seq.alias("seq"), "name")


def font_size(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(12), F.floor(F.least(width, height) / F.lit(40.0) + 0.5).cast("int"))


def rgba(rgb: tuple[int, int, int]) -> str:
    return "#{:02X}{:02X}{:02X}{:02X}".format(*rgb, FILL_ALPHA)


#: What an item of the overlay is: its order in the piece (g, k), and how it looks.
_ITEM = "struct<g: int, k: int, name: string, kind: string, fill: string, stroke: string, width: double, text: string>"


def _item(group: int, k: Column, name: Column, kind: str, fill: Column, stroke: str | None, width: float | None, text: Column | None = None) -> Column:
    looks = (fill.alias("fill"), F.lit(stroke).alias("stroke"), F.lit(width).alias("width"), (F.lit(None) if text is None else text).alias("text"))
    return F.struct(F.lit(group).alias("g"), k.alias("k"), name.alias("name"), F.lit(kind).alias("kind"), *looks).cast(_ITEM)


def overlay_items(pieces: DataFrame, cuts: DataFrame, parts: DataFrame, fills: bool = True, shapes: DataFrame | None = None) -> DataFrame:
    """section_id, z, name, kind, fill, stroke, width, text: what is drawn, bottom to top.

    ``pieces`` may have grey, granular and molecular: a layer of no area is not drawn. ``shapes`` (section_id, instance, g, k, rings, x, y, font,
    from ``drawn_shapes``) adds rings of areas and lines, and the middle and size of labels; items without a shape are left out.
    """
    n_inst = F.count(F.lit(1)).over(Window.partitionBy("section_id"))
    sizes = [c for c in ("grey", "granular", "molecular") if c in pieces.columns]
    named = pieces.select("section_id", "instance", *sizes, piece_prefix(F.col("instance"), n_inst).alias("pre"))
    drawn = lambda c, item: F.when(F.col(c) > 0, item) if c in sizes else item
    layers = zip(("grey", "granular", "molecular"), LAYER_FILLS, strict=True)
    fixed = [drawn(c, _item(0, F.lit(i), F.concat("pre", F.lit(n)), "area", F.lit(rgba(rgb)), stroke, AREA_WIDTH)) for i, (c, (n, rgb, stroke)) in enumerate(layers)]
    fixed.append(_item(1, F.lit(0), F.concat("pre", F.lit("Purkinje")), "line", F.lit(None), "#FF0000", LINE_WIDTH))
    out = named.select("section_id", "instance", F.explode(F.array_compact(F.array(*fixed))).alias("i"))
    lines = cuts.withColumn("number", cut_number()).join(named, ["section_id", "instance"])
    name = F.concat("pre", F.lit("Fissure"), F.col("number").cast("string"))
    out = out.unionByName(lines.select("section_id", "instance", _item(2, F.col("number"), name, "line", F.lit(None), "#FFFFFF", LINE_WIDTH).alias("i")))
    if fills:
        colour = F.get(F.array(*(F.lit(rgba(c)) for c in SECTION_FILLS)), ((F.col("ord") - 1) % len(SECTION_FILLS)).cast("int"))
        full = F.concat("pre", "name")
        label = _item(3, F.col("ord") * 2 + 1, F.concat(full, F.lit(" label")), "text", F.lit("#0000008C"), "#FFFFFF", None, F.col("name"))
        both = F.array(_item(3, F.col("ord") * 2, full, "area", colour, None, None), label)
        out = out.unionByName(parts.join(named, ["section_id", "instance"]).select("section_id", "instance", F.explode(both).alias("i")))
    out = out.select("section_id", "instance", "i.*")
    place = ["section_id", "instance", "g", "k"]
    more = ["rings", "x", "y", "font"] if shapes is not None else []
    if shapes is not None:
        out = out.join(shapes.select(*place, *more), place)
    z = F.row_number().over(Window.partitionBy("section_id").orderBy("instance", "g", "k")) - 1
    return out.select("section_id", z.alias("z"), "name", "kind", "fill", "stroke", "width", "text", *more)


def cut_number() -> Column:
    """Cuts are counted in each piece along the line that they cross."""
    return F.row_number().over(Window.partitionBy("section_id", "instance").orderBy("arc", "cut_id"))


def drawn_shapes(images: DataFrame, layers: DataFrame, line: DataFrame, cuts: DataFrame, sections: DataFrame, anchors: DataFrame) -> DataFrame:
    """section_id, instance, g, k, rings, x, y, font of what ``overlay_items`` draws.

    ``images``: section_id, width, height. ``layers``: instance, k (0 to 2), rings. ``line``: instance, rings.
    ``cuts``: instance, cut_id, arc, rings. ``sections``: instance, ord, rings. ``anchors``: instance, ord, x, y of a pixel inside each section.
    """
    item = lambda df, g, k, *more: df.select("section_id", "instance", F.lit(g).alias("g"), k.cast("int").alias("k"), *more)
    areas = [item(layers, 0, F.col("k"), "rings"), item(line, 1, F.lit(0), "rings"), item(cuts.withColumn("n", cut_number()), 2, F.col("n"), "rings"), item(sections, 3, F.col("ord") * 2, "rings")]
    out = areas[0]
    for more in areas[1:]:
        out = out.unionByName(more)
    size = images.select("section_id", font_size(F.col("width"), F.col("height")).alias("font"))
    middle = [(F.col(c) + 0.5).cast("double").alias(c) for c in "xy"]
    labels = item(anchors.join(size, "section_id"), 3, F.col("ord") * 2 + 1, *middle, "font")
    return out.unionByName(labels, allowMissingColumns=True)


def merged_overlay(existing: DataFrame, own: DataFrame) -> DataFrame:
    """What is drawn after a run: others' items as they are, in their order, then the new own ones.

    ``existing`` has section_id, z, name, marked and any columns of ``own``. Older own items (marked or by name) of the images in
    ``own`` go; images that were not measured keep all of theirs.
    """
    seen = own.select("section_id").distinct().withColumn("_seen", F.lit(True))
    old = F.coalesce(F.col("marked"), F.lit(False)) | F.coalesce(F.col("name").rlike(LEGACY_ITEM), F.lit(False))
    kept = existing.join(seen, "section_id", "left").where(F.col("_seen").isNull() | ~old).drop("_seen")
    kept = kept.withColumn("marked", F.coalesce("marked", F.lit(False))).withColumn("_new", F.lit(0))
    both = kept.unionByName(own.withColumn("marked", F.lit(True)).withColumn("_new", F.lit(1)), allowMissingColumns=True)
    z = F.row_number().over(Window.partitionBy("section_id").orderBy("_new", "z", "name")) - 1
    return both.withColumn("z", z).drop("_new")
