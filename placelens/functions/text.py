"""Identifiers, keys, prompts and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt templates for free text; band tuples; concepts, the feature type that marks their ground truth
# (none for the last four) and phrases that name them.
TEMPLATES = (
    "an aerial photo of {text}", "an aerial photo of a {text}", "an aerial view of {text}", "an aerial view of a {text}",
    "satellite imagery of {text}", "satellite imagery of a {text}", "an overhead photo of {text}", "{text}",
)
BANDS = {"rgb": (1, 2, 3), "cir": (4, 1, 2)}
CONCEPTS = {
    "waterfall": ("waterfall", ("falling water on a river", "cascade over ledges", "foam below a drop")),
    "pond": ("beaver_kettle_pond", ("still water ringed by trees", "beaver pond with dead trunks", "dark round pond")),
    "dam": ("dam", ("straight wall across a river", "concrete dam beside a reservoir", "spillway below a lake")),
    "road": ("road", ("paved road between trees", "two-lane highway through woods", "bright strip of asphalt")),
    "parking_lot": ("parking", ("paved lot with parked cars", "visitor parking near a trailhead", "marked bays in a clearing")),
    "boardwalk": ("boardwalk", ("wooden walkway beside water", "narrow planked path", "railed footpath over rocks")),
    "cemetery": ("cemetery", ("rows of graves in grass", "small burial ground in woods", "fenced plot with headstones")),
    "abandoned_cabin": ("cabin", ("lone roof among trees", "derelict hut in a clearing", "ruined cabin off the road")),
    "mine_pit": (None, ("hole dug into rock", "spoil heaps around a pit", "bare quarry floor")),
    "cliff_outcrop": (None, ("steep bare rock face", "ledge above treetops", "exposed bedrock on a slope")),
    "old_logging_road": (None, ("faint grassy track", "overgrown cut through forest", "disused skid trail")),
    "river_rapids": (None, ("white water among boulders", "fast shallow river reach", "broken water on a bend")),
}


def prompts(concept: str) -> list[str]:
    """Six prompts of a registered concept."""
    return [f"{view} {phrase}" for phrase in CONCEPTS[concept][1] for view in ("seen from above:", "aerial image of a")]


def concept_key(text: Column) -> Column:
    return F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit("_"))


def prompts_for(text: str) -> list[str]:
    """A registered concept's prompts, else the templates filled with the text."""
    bare = text.strip()
    key = bare.lower().replace(" ", "_")
    return prompts(key) if key in CONCEPTS else [t.format(text=bare) for t in TEMPLATES]


def location_id(row: Column, col: Column) -> Column:
    return F.format_string("r%03d_c%03d", row, col)


def chip_id(cycle: Column, row: Column, col: Column) -> Column:
    return F.format_string("naip_%s_r%03d_c%03d", cycle, row, col)


def location_of_chip(chip: Column, cycle: Column, strict: bool = True) -> Column:
    """What follows ``naip_{cycle}_``; another prefix is an error, or left alone if not ``strict``."""
    prefix = F.concat(F.lit("naip_"), cycle, F.lit("_"))
    rest = F.substring(chip, F.length(prefix) + 1, F.length(chip))
    wrong = F.raise_error(F.concat(F.lit("chip id without its cycle's prefix: "), chip)).cast("string") if strict else chip
    return F.when(F.startswith(chip, prefix), rest).otherwise(wrong)


def wkt_point(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def wkt_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    inner = F.concat_ws(", ", *[F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in corners])
    return F.concat(F.lit("POLYGON(("), inner, F.lit("))"))


def thumbnail_key(location: Column, cycle: Column, bands: Column) -> Column:
    return F.concat(F.concat_ws("__", location, cycle, bands), F.lit(".png"))


def thumbnail_status(key: Column) -> Column:
    """200, or 400 for a wrong extension, number of parts or bands."""
    parts = F.split(F.regexp_replace(key, r"\.png$", ""), "__")
    fine = F.endswith(key, F.lit(".png")) & (F.size(parts) == 3) & F.get(parts, F.lit(2)).isin(*BANDS)
    return F.when(F.coalesce(fine, F.lit(False)), 200).otherwise(400)


def is_flat_key(key: Column) -> Column:
    return ~(F.contains(key, F.lit("/")) | F.contains(key, F.lit("\\")) | key.isin("", ".", ".."))


def csv_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def percent(x: Column) -> Column:
    return F.format_string("%5.1f%%", 100 * x)


def three_digits(x: Column) -> Column:
    return F.format_string("%.3f", x)


def config_key(model: Column, bands: Column) -> Column:
    return F.concat_ws("__", model, bands)


def config_label(key: Column) -> Column:
    return F.replace(key, F.lit("__"), F.lit(" / "))


def winter_year(ts: Column) -> Column:
    """December belongs to the winter of the next year."""
    return F.year(ts) + (F.month(ts) == 12).cast("int")


def epsg_of(urn: Column) -> Column:
    return F.element_at(F.split(urn, "::"), -1).cast("int")
