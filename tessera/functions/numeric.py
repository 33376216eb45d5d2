"""Column functions on numbers: clamps, fits, scores, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(x, F.lit(high))))


def confidence(text: Column) -> Column:
    """A confidence within [0, 1]; null if it isn't a finite number."""
    x = text.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(clamp(x))


def not_negative(text: Column) -> Column:
    """A number of 0 or more, else null."""
    x = text.try_cast("double")
    return F.when((x >= 0) & ~F.isnan(x), x)


def duration_fit(seconds: Column, slot: Column) -> Column:
    """How well a clip's length fits a slot: 0.45 if it is unknown or not positive, else 0.25 to 1."""
    b = F.greatest(slot, F.lit(0.6))
    return F.when(~F.coalesce(seconds > 0, F.lit(False)), 0.45).otherwise(0.25 + 0.75 * clamp(1 - F.abs(seconds - b) / F.greatest(b * 2.2, F.lit(1.0))))


def provider_duration_score(seconds: Column, slot: Column) -> Column:
    b = F.greatest(slot, F.lit(0.8))
    return F.when(~F.coalesce(seconds > 0, F.lit(False)), 0.08).otherwise(0.06 + 0.14 * clamp(1 - F.abs(seconds - b) / F.greatest(b * 2.0, F.lit(1.0))))


def orientation_score(width: Column, height: Column) -> Column:
    """Portrait and square before landscape before unknown."""
    known = F.coalesce((width > 0) & (height > 0), F.lit(False))
    return F.when(~known, 0.03).when(height >= width, 0.09).otherwise(0.05)


def resolution_score(width: Column, height: Column) -> Column:
    """By pixels up to full HD; unknown sizes get the least."""
    known = F.coalesce((width > 0) & (height > 0), F.lit(False))
    return F.when(known, 0.03 + 0.07 * clamp(width * height / (1920.0 * 1080.0))).otherwise(0.03)


def rank_bonus(index: Column, total: Column) -> Column:
    """A bonus that falls with the place (from 0) among the results."""
    return F.when(total > 0, clamp((1 - index / F.greatest(total, F.lit(1))) * 0.12, 0.0, 0.12)).otherwise(0.0)


def normalised(weights: list[float]) -> list[float]:
    """Weights that sum to one: negative ones are 0, and all are even if none is positive."""
    positive = [max(w, 0.0) for w in weights]
    total = sum(positive)
    return [w / total for w in positive] if total > 0 else [1 / len(weights)] * len(weights)


def unit_cosine(a: Column, b: Column) -> Column:
    """Cosine of unit vectors on [0, 1]; 0 if their lengths differ or one is empty."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), clamp((dot + 1) / 2)).otherwise(0.0)


def output_size(width: Column, height: Column, short_side: int) -> Column:
    """Width and height scaled so that the short side is short_side, both even."""
    width, height = F.greatest(width, F.lit(2)), F.greatest(height, F.lit(2))
    scale = F.lit(float(short_side)) / F.least(width, height)
    even = lambda x: F.bround(x * scale).cast("int") + F.bround(x * scale).cast("int") % 2
    return F.struct(even(width).alias("width"), even(height).alias("height"))


def tempo_chain(speed: Column) -> Column:
    """Factors within [0.5, 2] whose product is speed: whole doublings or halvings, then the rest."""
    s = F.greatest(speed, F.lit(0.01))
    up = F.greatest(F.ceil(F.log2(s) - 1e-12) - 1, F.lit(0)).cast("int")
    down = F.greatest(F.ceil(-F.log2(s) - 1e-12) - 1, F.lit(0)).cast("int")
    rest = F.when(up > 0, s / F.pow(F.lit(2.0), up)).when(down > 0, s * F.pow(F.lit(2.0), down)).otherwise(s)
    return F.concat(F.array_repeat(F.lit(2.0), up), F.array_repeat(F.lit(0.5), down), F.array(F.round(rest, 6)))


#: fixed values: render quality to rate factor and preset
CRF = {"low": 30, "medium": 25, "high": 20, "max": 16}
PRESET = {"low": "ultrafast", "medium": "veryfast", "high": "medium", "max": "slow"}
TRANSITION = {"fade": "fade", "dissolve": "dissolve", "slide_left": "slideleft", "slide_right": "slideright", "slide_up": "slideup", "slide_down": "slidedown", "wipe": "wipeleft", "zoom": "zoomin"}
SHORT_SIDE = {"720p": 720, "1080p": 1080, "4k": 2160}
#: fixed values: looks to the renderer's filters
LOOKS = {
    "warm": ["colorbalance=rs=0.08:bs=-0.05"], "cool": ["colorbalance=rs=-0.06:bs=0.08"], "cinematic": ["eq=contrast=1.15:saturation=0.9", "vignette=angle=PI/4"],
    "vintage": ["curves=preset=vintage"], "mono": ["hue=s=0"], "blackwhite": ["hue=s=0"], "b&w": ["hue=s=0"],
}


def looked_up(key: Column, table: dict, default) -> Column:
    """The table's value for a key, else the default."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def preset_filters(preset: Column) -> Column:
    """The filters of a look, in their order; unknown looks have none."""
    out = F.array().cast("array<string>")
    for name, filters in LOOKS.items():
        out = F.when(F.lower(F.trim(preset)) == name, F.array(*map(F.lit, filters))).otherwise(out)
    return out
