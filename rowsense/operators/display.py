"""What is shown: values, specimens, notes with their chips, sensitive names held back, consent, sizes and covered parts of images.

Defined results: nulls are shown as a dash or left out; a version that isn't a whole number is no consent; an image whose covered
parts can't be filled is refused, never given back as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_name

# Names whose results a shared phone must not show.
SENSITIVE = ("Cocaine, Urine", "Methadone, Urine", "Benzodiazepine Screen, Urine", "Oxycodone", "Opiate Screen, Urine", "Amphetamine Screen, Urine", "Barbiturate Screen, Urine", "人类免疫缺陷 病毒抗体/抗原 (P24)", "髓系原始细胞群")
# Fixed value: what stands beside a segment that is shown as it was written.
ABSTAIN_NOTE = "Shown as written — we can't safely simplify this one."
#: Share of a side from which a drawn box is meant.
MEANT = 0.01


def sensitive(name: Column, names: tuple[str, ...] = SENSITIVE) -> Column:
    """Whether a name is one of them, both as names are looked up; parts of names don't count."""
    return F.coalesce(norm_name(name).isin(*(norm_name(F.lit(n)) for n in names)), F.lit(False))


def printed_specimen(specimen: Column) -> Column:
    """The specimen that a report prints for an entry: none for what is measured on the body."""
    return F.when(specimen == "measurement", "unknown").otherwise(specimen)


def value_text(value: Column, unit: Column) -> Column:
    return F.concat(F.coalesce(value, F.lit("—")), F.when(F.coalesce(unit, F.lit("")) != "", F.concat(F.lit(" "), unit)).otherwise(""))


def consented(version: Column, expected: int) -> Column:
    """Whether a header states the expected version, as a whole number in any notation."""
    return F.coalesce(F.trim(version).try_cast("double") == float(expected), F.lit(False))


def notes_view(segments: DataFrame) -> DataFrame:
    """segments (action, source, translation, preserved: array of type and raw) as rows to show: an abstained segment has no
    translation, no chips, and a note."""
    gone = F.col("action") == 2
    chips = F.transform(F.coalesce("preserved", F.array().cast("array<struct<type:string,raw:string>>")), lambda x: F.struct(x["type"].alias("type"), x["raw"].alias("label")))
    return segments.withColumns({"abstained": gone, "translation": F.when(gone, "").otherwise(F.col("translation")), "abstain_note": F.when(gone, ABSTAIN_NOTE), "chips": F.when(gone, F.slice(chips, 1, 0)).otherwise(chips)})


def target_size(width: Column, height: Column, most: int = 1600) -> Column:
    """struct<width, height> of an image whose longer edge is at most so long; halves round up."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    side = lambda x: F.floor(x * scale + 0.5).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def covered(pixels: Column, width: Column, height: Column, boxes: Column) -> Column:
    """struct<pixels, refused>: an image (rows of gray values) whose boxes (array of x, y, w, h as shares of its sides) are black.

    Boxes too small to be meant don't count; without others the image stays. Pixels that don't fill the image are refused."""
    meant = F.filter(F.coalesce(boxes, F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")), lambda b: (b["w"] > MEANT) & (b["h"] > MEANT))
    inside = lambda i, b: ((i % width) >= F.floor(b["x"] * width)) & ((i % width) < F.ceil((b["x"] + b["w"]) * width)) & (F.floor(i / width) >= F.floor(b["y"] * height)) & (F.floor(i / width) < F.ceil((b["y"] + b["h"]) * height))
    filled = F.transform(pixels, lambda p, i: F.when(F.exists(meant, lambda b: inside(i, b)), F.lit(0.0)).otherwise(p))
    broken = (F.size(meant) > 0) & F.coalesce(F.size(pixels) != width * height, F.lit(True))
    return F.struct(F.when(~broken, F.when(F.size(meant) == 0, pixels).otherwise(filled)).alias("pixels"), F.when(broken, "decode-failed").alias("refused"))
