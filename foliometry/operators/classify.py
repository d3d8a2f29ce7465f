"""Roles and pieces from names, and the checks of each piece's regions and lines."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FISSURE, GRANULAR, OUTPUT_NAME, TOKEN_BEGINS, word
from ..sources.model import sections_without_rois

#: Property that marks what an earlier run has added. Regions of other programs may bear another one: give it as ``marker``.
OUTPUT_PROPERTY = "section-morphometry-output"
MOST_LISTED = 10
#: Roles that a piece has once.
SINGLE = {"CEREBELLUM": "cb", "GRANULAR_WM": "gl", "WHITE_MATTER": "wm", "PURKINJE": "pl"}
LONG_WORDS = ("fissure", "purkinje", "granular", "cerebellum", "white")
AREAS = ("POLYGON", "RECTANGLE", "OVAL", "COMPOSITE")
#: Share of a region outside its parent that is worth a note.
TOLERATED_OUTSIDE = 0.005


def bare_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"^\p{Nd}*", "")


def instance_of(name: Column) -> Column:
    """The leading number; 1 without one, null if it is 0 or has over four digits."""
    digits = F.regexp_extract(F.lower(name), r"^(\p{Nd}*)", 1)
    value = F.when(digits.rlike("^[0-9]{1,4}$"), digits.try_cast("int"))
    return F.when(digits == "", F.lit(1)).otherwise(F.when(value > 0, value))


def may_have_role(lower: Column) -> Column:
    """False for most names in small letters that have no role: each role's pattern needs a long word, a token's beginning, or gl and wm."""
    return reduce(or_, (lower.contains(w) for w in LONG_WORDS)) | lower.rlike(TOKEN_BEGINS) | (lower.contains("gl") & lower.contains("wm"))


def role_of(bare: Column) -> Column:
    """The first role whose pattern a bare name holds; null for none."""
    granular = bare.rlike(GRANULAR) | (bare.rlike(word("gl")) & bare.rlike(word("wm")))
    return (
        F.when(bare.rlike(FISSURE), "FISSURE")
        .when(bare.contains("purkinje") | bare.rlike(word("pl")), "PURKINJE")
        .when(granular, "GRANULAR_WM")
        .when(bare.contains("cerebellum") | bare.rlike(word("cb")), "CEREBELLUM")
        .when(bare.contains("white") | bare.rlike(word("wm")), "WHITE_MATTER")
    )


def category_of(name: Column) -> Column:
    """The role of a name whose leading number is one of a piece; null for none."""
    return F.when(instance_of(name).isNotNull(), role_of(bare_name(name)))


def is_output(name: Column, props: Column | None = None, marker: str = OUTPUT_PROPERTY) -> Column:
    marked = F.lit(False) if props is None else F.coalesce(props[marker] == "true", F.lit(False))
    return marked | F.coalesce(F.trim(name).rlike(OUTPUT_NAME), F.lit(False))


def classified(rois: DataFrame, marker: str = OUTPUT_PROPERTY) -> DataFrame:
    """Adds output, category and instance (both null for output and unknown names)."""
    name = F.coalesce(F.col("name"), F.lit(""))
    props = F.col("props") if "props" in rois.columns else None
    out = rois.withColumn("output", is_output(name, props, marker))
    category = F.when(~F.col("output"), category_of(name))
    return out.withColumn("category", category).withColumn("instance", F.when(F.col("category").isNotNull(), instance_of(name)))


def skipped_outputs(rois: DataFrame, marker: str = OUTPUT_PROPERTY) -> DataFrame:
    """section_id, n: regions and lines of earlier runs."""
    return classified(rois, marker).where("output").groupBy("section_id").agg(F.count(F.lit(1)).alias("n"))


def ignored_names(rois: DataFrame, marker: str = OUTPUT_PROPERTY) -> DataFrame:
    """section_id, n, shown: the first names without a role, in order."""
    rest = classified(rois, marker).where(~F.col("output") & F.col("category").isNull())
    shown = F.when(F.coalesce(F.col("name"), F.lit("")) == "", "(unnamed)").otherwise(F.col("name"))
    first = rest.withColumn("rn", F.row_number().over(Window.partitionBy("section_id").orderBy("roi_idx")))
    listed = F.sort_array(F.collect_list(F.when(F.col("rn") <= MOST_LISTED, F.struct("rn", shown.alias("name")))))
    out = first.groupBy("section_id").agg(F.count(F.lit(1)).alias("n"), listed.alias("l"))
    more = F.when(F.col("n") > MOST_LISTED, F.lit(", …")).otherwise(F.lit(""))
    return out.select("section_id", "n", F.concat(F.array_join(F.col("l.name"), ", "), more).alias("shown"))


def pieces(rois: DataFrame, marker: str = OUTPUT_PROPERTY) -> DataFrame:
    """One row for each (section_id, instance): name and kind of each role's last region, how many more, fissures."""
    return _pieces(classified(rois, marker))


def _pieces(named: DataFrame) -> DataFrame:
    known = named.where(F.col("category").isNotNull())
    is_area = F.col("kind").isin(*AREAS)
    of = lambda role, c: F.when(F.col("category") == role, c)
    own = []
    for role, short in SINGLE.items():
        last = F.struct("roi_idx", is_area.alias("area"), F.coalesce("name", F.lit("")).alias("name"))
        own += [F.max(of(role, last)).alias(short), F.greatest(F.count(of(role, F.lit(1))) - 1, F.lit(0)).alias(f"{short}_extra")]
    closed = F.sort_array(F.collect_list(F.when((F.col("category") == "FISSURE") & is_area, F.struct("roi_idx", "name"))))
    named = known.groupBy("section_id", "instance").agg(*own, F.count(of("FISSURE", F.lit(1))).alias("fissures"), closed.alias("closed"))
    flat = [c for s in SINGLE.values() for c in (F.col(f"{s}.area").alias(f"{s}_area"), F.col(f"{s}.name").alias(f"{s}_name"), f"{s}_extra")]
    named = named.select("section_id", "instance", *flat, "fissures", F.size("closed").alias("fissure_areas"), F.array_join("closed.name", '", "').alias("fissure_names"))
    return named.withColumn("n_inst", F.count(F.lit(1)).over(Window.partitionBy("section_id")))


def prefix(instance: Column, n_inst: Column) -> Column:
    return F.when(n_inst > 1, F.concat(F.lit("[Instance "), instance.cast("string"), F.lit("] "))).otherwise(F.lit(""))


#: code -> message without the piece's prefix; %s is what it is about.
MESSAGES = {
    "DUPLICATE_CB": "More than one region matches Cerebellum: %s.",
    "DUPLICATE_GL": "More than one region matches Granular+WM: %s.",
    "DUPLICATE_WM": "More than one region matches White Matter: %s.",
    "DUPLICATE_PL": "More than one line matches Purkinje: %s.",
    "MISSING_CB": "The Cerebellum region is missing%s.",
    "CB_NOT_AREA": 'The Cerebellum region "%s" is not a closed area.',
    "MISSING_GL": "The Granular+WM region is missing%s.",
    "GL_NOT_AREA": 'The Granular+WM region "%s" is not a closed area.',
    "WM_NOT_AREA": 'The White Matter region "%s" is not a closed area.',
    "MISSING_PL": "The Purkinje line is missing%s.",
    "PL_NOT_LINE": 'The Purkinje line "%s" is a closed area.',
    "PL_UNREADABLE": 'The Purkinje line "%s" has no points.',
    "FISSURE_UNREADABLE": 'The fissure line "%s" has no points.',
    "NO_FISSURES": "There are no fissure lines, but the section has White Matter.",
    "FISSURE_NOT_LINE": 'A fissure line is a closed area: "%s".',
    "NO_NAMES": "None of the names fits a layer or line.",
    "NO_REGIONS": "Nothing is traced in this image.",
    "SEVERAL_PIECES": "The names speak of %s pieces; if only one is meant, some name begins with a digit by accident.",
}
#: Added where a whole layer of an earlier run may be among duplicates, and where pieces have numbers.
LAYER_HINT, NUMBER_HINT = " (a whole layer that an earlier run has added may be among them)", " (for this piece, names begin with %s)"
WHOLE_LAYERS = ("grey matter", "granular layer", "molecular layer")


def _message(code: Column, about: Column) -> Column:
    text = F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv))
    return F.replace(text[code], F.lit("%s"), F.coalesce(about, F.lit("")))


def _single_faults(named: DataFrame) -> DataFrame:
    """section_id, instance, n_inst, code, about of regions and lines by themselves, in one pass.

    Each region or line of a role that has one already, with the names of both. Lines without a point: of Purkinje lines the
    last counts, fissures only beside white matter.
    """
    role, piece = Window.partitionBy("section_id", "instance", "category").orderBy("roi_idx"), Window.partitionBy("section_id", "instance")
    known = named.where(F.col("category").isNotNull()).withColumn("name", F.coalesce("name", F.lit("")))
    known = known.withColumns({"before": F.lag("name").over(role), "more": F.lead(F.lit(True), 1, False).over(role)})
    known = known.withColumn("wm", F.max(F.col("category") == "WHITE_MATTER").over(piece))
    layer = lambda c: F.lower(F.trim(c)).isin(*WHOLE_LAYERS)
    hint = F.when(layer(F.col("before")) | layer(F.col("name")), F.lit(LAYER_HINT)).otherwise(F.lit(""))
    twice = F.create_map(*(F.lit(x) for r, s in SINGLE.items() for x in (r, f"DUPLICATE_{s.upper()}")))[F.col("category")]
    both = F.when(F.col("before").isNotNull() & twice.isNotNull(), F.struct(twice.alias("code"), F.concat(F.lit('"'), "before", F.lit('" and "'), "name", F.lit('"'), hint).alias("about")))
    faults = [both]
    if "empty" in named.columns:
        counts = F.when(F.col("category") == "PURKINJE", ~F.col("more")).when(F.col("category") == "FISSURE", F.col("wm")).otherwise(F.lit(False))
        code = F.when(F.col("category") == "FISSURE", "FISSURE_UNREADABLE").otherwise("PL_UNREADABLE")
        line = ~F.coalesce(F.col("kind").isin(*AREAS), F.lit(False))
        faults.append(F.when(counts & F.col("empty") & line, F.struct(code.alias("code"), F.col("name").alias("about"))))
    found = known.withColumn("f", F.explode(F.array_compact(F.array(*faults))))
    n = named.where(F.col("category").isNotNull()).groupBy("section_id").agg(F.countDistinct("instance").alias("n_inst"))
    return found.join(n, "section_id").select("section_id", "instance", "n_inst", "f.code", "f.about")


def problems(rois: DataFrame, sections: DataFrame | None = None, marker: str = OUTPUT_PROPERTY) -> DataFrame:
    """section_id, instance, code, n, message: everything that keeps a section from being measured.

    All problems of all pieces come at once; other sections are not affected. Those of a whole image (no
    name is known; with ``sections``, nothing is traced) have no instance.
    """
    return problems_of(narrow(rois, marker), sections)


def narrow(rois: DataFrame, marker: str = OUTPUT_PROPERTY) -> DataFrame:
    """What the checks read of regions and lines: no points, but whether there are none (``empty``)."""
    empty = [(F.coalesce(F.size(F.get("rings", F.lit(0))), F.lit(0)) <= 0).alias("empty")] if "rings" in rois.columns else []
    return classified(rois, marker).select("section_id", "roi_idx", "name", "kind", "output", "category", "instance", *empty)


def problems_of(named: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """``problems`` of regions in the form of ``narrow``."""
    p = _pieces(named)
    wm, none = F.col("wm_area").isNotNull(), F.lit(None).cast("string")
    one = lambda test: F.when(test, 1).otherwise(0)
    number = F.when(F.col("n_inst") > 1, F.replace(F.lit(NUMBER_HINT), F.lit("%s"), F.col("instance").cast("string")))
    found: dict[str, tuple[Column, Column]] = {f"MISSING_{s.upper()}": (one(F.col(f"{s}_area").isNull()), number) for s in ("cb", "gl", "pl")}
    found |= {f"{s.upper()}_NOT_AREA": (one(~F.col(f"{s}_area")), F.col(f"{s}_name")) for s in ("cb", "gl", "wm")}
    found |= {"PL_NOT_LINE": (one(F.col("pl_area")), F.col("pl_name")), "NO_FISSURES": (one((F.col("instance") == 1) & wm & (F.col("fissures") == 0)), none)}
    found |= {"FISSURE_NOT_LINE": (F.when(wm, F.col("fissure_areas")).otherwise(0), F.col("fissure_names"))}
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("code"), n.cast("long").alias("n"), about.alias("about")) for c, (n, about) in found.items()))).alias("p")
    own = p.select("section_id", "instance", "n_inst", each).where("p.n > 0").select("section_id", "instance", "n_inst", "p.code", "p.n", "p.about")
    own = own.unionByName(_single_faults(named).withColumn("n", F.lit(1).cast("long")))
    whole = lambda df, code, n, about: df.select("section_id", F.lit(None).cast("int").alias("instance"), F.lit(1).cast("long").alias("n_inst"), F.lit(code).alias("code"), n.cast("long").alias("n"), about.alias("about"))
    many = own.where(F.col("n_inst") > 1).select("section_id", F.col("n_inst").alias("k")).distinct()
    nameless = named.groupBy("section_id").agg(F.count(F.lit(1)).alias("k"), F.count("category").alias("named")).where("named = 0")
    every = own.unionByName(whole(many, "SEVERAL_PIECES", F.col("k"), F.col("k").cast("string"))).unionByName(whole(nameless, "NO_NAMES", F.col("k"), none))
    if sections is not None:
        every = every.unionByName(whole(sections_without_rois(sections, named), "NO_REGIONS", F.lit(0), none))
    lead = F.when(F.col("instance").isNotNull(), prefix(F.col("instance"), F.col("n_inst"))).otherwise(F.lit(""))
    return every.select("section_id", "instance", "code", "n", F.concat(lead, _message(F.col("code"), F.col("about"))).alias("message"))


def fissure_requirement(rois: DataFrame, marker: str = OUTPUT_PROPERTY) -> DataFrame:
    """section_id, instance, fissures, used, required, note about a piece's fissures."""
    wm = F.col("wm_area").isNotNull()
    note = (
        F.when(~wm & (F.col("fissures") > 0), "fissures ignored: no White Matter")
        .when(~wm, "not split: no White Matter")
        .when((F.col("fissures") == 0) & (F.col("instance") != 1), "not split: no fissures")
    )
    used = F.when(wm, F.col("fissures")).otherwise(0).cast("long")
    return pieces(rois, marker).select("section_id", "instance", "fissures", used.alias("used"), ((F.col("instance") == 1) & wm).alias("required"), note.alias("note"))


def measurable(rois: DataFrame, marker: str = OUTPUT_PROPERTY) -> DataFrame:
    """The classified rows of sections without any problem."""
    return measured_rows(rois, problems(rois, marker=marker), marker)


def measured_rows(rois: DataFrame, found: DataFrame, marker: str = OUTPUT_PROPERTY) -> DataFrame:
    """The classified rows of sections that are not among the problems ``found``."""
    bad = found.select("section_id").distinct()
    return classified(rois, marker).where(F.col("category").isNotNull()).join(bad, "section_id", "left_anti")
