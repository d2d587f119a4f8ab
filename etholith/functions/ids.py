"""Identifier and label parsing as Spark columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the study: suffixes, channel tokens, marker names, classes.
SESSION_SUFFIXES = ("_CD1", "_BL6")
RAW_MARK = "_LVCC"
RAW_FINAL = "LVCC_RAW_final"
CHANNEL_TOKENS = {"ch01": "cFOSseg", "ch00": "GFPseg"}
MARKER_NAMES = {
    "GFP": ("gfp", "gfp+", "type 1"),
    "cFOS": ("cfos", "cfos+", "type 2"),
    "both": ("both", "type 3"),
}
CLASSIFIER_MIN_AREA = {"cFOSseg": 15.0, "GFPseg": 40.0}
SUBJECT_OF_OBJECT = {"obj1": "stim", "obj2": "exp"}
FRAME_KEY = r"^frame(\d+)_obj(\d+)_mask_(packed|shape)$"


def _or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def strip_suffix(name: Column) -> Column:
    for suffix in SESSION_SUFFIXES:
        name = F.regexp_replace(name, f"{suffix}$", "")
    return name


def parse_behaviour(label: Column, session: Column, strict: bool = True) -> Column:
    """Struct (actor, target, behavior) from ``[actor_[target_]]behavior``.

    In CD1 sessions the strain names BL6 and CD1 stand for exp and stim. More
    than two leading tokens raise an error, or give NULLs when not ``strict``.
    """
    tokens = F.split(label, "_")
    n = F.size(tokens)

    def role(token: Column) -> Column:
        strain = session == "CD1"
        return (
            F.when(strain & (token == "BL6"), "exp")
            .when(strain & (token == "CD1"), "stim")
            .when(token.isin("exp", "stim"), token)
        )

    last = F.element_at(tokens, -1)
    if strict:
        bad = F.raise_error(F.concat(F.lit("unexpected behaviour label: "), label)).cast("string")
    else:
        bad = F.lit(None).cast("string")
    return F.struct(
        F.when(n.between(2, 3), role(F.get(tokens, F.lit(0)))).alias("actor"),
        F.when(n == 3, role(F.get(tokens, F.lit(1)))).alias("target"),
        F.when(n <= 3, last).otherwise(bad).alias("behavior"),
    )


def hms_to_sec(text: Column) -> Column:
    """Seconds of ``hh:mm:ss.ffffff``; NULL when a part is no number."""
    parts = F.split(text, ":")
    hours, minutes, seconds = (F.get(parts, F.lit(i)).try_cast("double") for i in range(3))
    return hours * 3600 + minutes * 60 + seconds


def image_id(name: Column) -> Column:
    return _or_null(F.lower(F.regexp_extract(name, r"(?i)count\d+_\d+", 0)))


def animal_id(image: Column) -> Column:
    return _or_null(F.regexp_extract(image, r"^count\d+", 0))


def section_num(image: Column) -> Column:
    return F.regexp_extract(image, r"_(\d+)$", 1).try_cast("int")


def animal_num(animal: Column) -> Column:
    return F.regexp_extract(animal, r"\d+", 0).try_cast("int")


def normalise_animal_id(animal: Column) -> Column:
    return F.regexp_replace(animal, r"^count(\d+)$", "count_$1")


def base_name(name: Column) -> Column:
    for pattern in (r"_GFPseg.*", r"_cFOSseg.*", r"_LVCC.*", r"\.tif.*"):
        name = F.regexp_replace(name, pattern, "")
    return name


def roi_prefix(name: Column) -> Column:
    for pattern in (r"_cFOSseg.*", r"_GFPseg.*", r"\.tif.*"):
        name = F.regexp_replace(name, pattern, "")
    return name


def roi_export_name(name: Column) -> Column:
    """Image name without extension and the raw suffix."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), f"_{RAW_FINAL}$", "")


def segmentation_name(name: Column) -> Column:
    """``<prefix>_<channel>seg.tif`` of a projected channel image."""
    stem = F.regexp_replace(name, r"\.tiff?", "")
    marked = F.instr(stem, RAW_MARK) > 0
    channel = F.lit("seg")
    for token, out in reversed(CHANNEL_TOKENS.items()):
        channel = F.when(F.instr(name, token) > 0, out).otherwise(channel)
    prefix = F.when(marked, F.substring_index(stem, RAW_MARK, 1)).otherwise(stem)
    return F.concat(prefix, F.lit("_"), F.when(marked, channel).otherwise("seg"), F.lit(".tif"))


def marker_class(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for cls, names in MARKER_NAMES.items():
        out = F.when(F.lower(name).isin(*names), cls).otherwise(out)
    return out


def classifier_params(name: Column) -> Column:
    """Minimum object area of the classifier an image name selects."""
    cfos = F.instr(name, "cFOSseg") > 0
    gfp = F.instr(name, "GFPseg") > 0
    return F.when(cfos, CLASSIFIER_MIN_AREA["cFOSseg"]).when(gfp, CLASSIFIER_MIN_AREA["GFPseg"])


def is_raw_image(name: Column) -> Column:
    return name.contains(RAW_FINAL)


def is_segmentation(name: Column) -> Column:
    return name.contains("cFOSseg") | name.contains("GFPseg")


def is_tiff(name: Column) -> Column:
    return name.endswith(".tif") | name.endswith(".tiff")


def is_first_channel(name: Column) -> Column:
    return name.endswith("ch00.tif")


def run_priority(run: Column) -> Column:
    """output=0, resume=1, resumeN=N, anything else NULL."""
    number = F.regexp_extract(run, r"^resume(\d+)$", 1).try_cast("int")
    return F.when(run == "output", 0).when(run == "resume", 1).otherwise(number)


def run_of_folder(name: Column, marker: str) -> Column:
    """Struct (prefix, run_name, start_frame) of a run folder or file; NULL without the marker."""
    at = F.instr(name, marker)
    left = F.substring_index(name, marker, 1)
    right = F.substring(name, at + len(marker), F.length(name))
    number = F.regexp_extract(left, r"_resume(\d*)$", 1)
    resumed = left.rlike(r"_resume\d*$")
    return F.when(
        at > 0,
        F.struct(
            F.regexp_replace(left, r"_resume\d*$", "").alias("prefix"),
            F.when(resumed, F.concat(F.lit("resume"), number)).otherwise("output").alias("run_name"),
            F.regexp_extract(right, r"_resume(\d+)", 1).try_cast("long").alias("start_frame"),
        ),
    )


def frame_key(key: Column) -> Column:
    return F.when(
        key.rlike(FRAME_KEY),
        F.struct(
            F.regexp_extract(key, FRAME_KEY, 1).try_cast("long").alias("frame_id"),
            F.regexp_extract(key, FRAME_KEY, 2).try_cast("int").alias("obj_id"),
            F.regexp_extract(key, FRAME_KEY, 3).alias("part"),
        ),
    )


def natural_sort_key(name: Column) -> Column:
    """A string whose plain order puts digit runs in numeric order, case ignored."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(
        F.transform(parts, lambda t: F.when(t.rlike(r"^\d"), F.lpad(t, 20, "0")).otherwise(F.lower(t))),
        "",
    )


def title_joint(joint: Column) -> Column:
    return F.array_join(F.transform(F.split(joint, "_"), F.initcap), "_")


def object_to_subject(assigned: Column, original: Column) -> Column:
    out = original
    for obj, subject in SUBJECT_OF_OBJECT.items():
        out = F.when(assigned == obj, subject).otherwise(out)
    return out


def cohort_of(animal: Column, cohorts: Mapping[str, Sequence[str]], unknown: str | None = None) -> Column:
    """Cohort whose list holds the animal; ``unknown`` (NULL by default) otherwise."""
    out = F.lit(unknown).cast("string")
    for cohort, animals in cohorts.items():
        out = F.when(animal.isin(*animals), cohort).otherwise(out)
    return out


def segment_ranges(spec: Column, total: Column) -> Column:
    """Array of half-open (start, end_exclusive) from ``"0-300,7100-8900"``; NULL means all frames."""

    def piece(text: Column) -> Column:
        ends = F.split(F.trim(text), "-")
        return F.struct(
            F.get(ends, F.lit(0)).try_cast("long").alias("start"),
            F.least(F.get(ends, F.lit(1)).try_cast("long"), total).alias("end_exclusive"),
        )

    whole = F.array(
        F.struct(F.lit(0).cast("long").alias("start"), total.cast("long").alias("end_exclusive"))
    )
    return F.when(spec.isNull(), whole).otherwise(F.transform(F.split(spec, ","), piece))
