"""Trace options, and the curves that turn a detail level into parameters."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes, palette sizes, tracer settings by class.
CLASSES = ("Logo", "Illustration", "Photo")
PHOTO_MODES = ("Posterize", "RasterEmbed")
PALETTE_SIZE = {"Logo": (2, 16), "Illustration": (8, 64), "Photo": (24, 256)}
SPECKLE = {"Logo": (1, 6), "Illustration": (2, 8), "Photo": (2, 12)}
CORNER = {"Logo": (40, 60), "Illustration": (40, 70), "Photo": (60, 100)}
MIN_AREA_SHARE, MIN_AREA = 0.02, 256
DENOISE_BELOW = 0.85
COLOR_COUNTS = ("auto", 8, 16, 32, 64, 128, 256)


@dataclass(frozen=True)
class Options:
    """Options of a trace; every field has a default and unknown values are refused."""

    class_override: str | None = None
    k: int | None = None
    lock_palette: tuple[tuple[int, int, int], ...] | None = None
    bw_mode: bool = False
    photo_mode: str = "Posterize"
    detail: float = 0.5
    gradients: bool = False

    def __post_init__(self) -> None:
        if self.class_override is not None and self.class_override not in CLASSES:
            raise ValueError(f"invalid options: class {self.class_override!r}")
        if self.photo_mode not in PHOTO_MODES:
            raise ValueError(f"invalid options: photo mode {self.photo_mode!r}")
        if self.k is not None and (isinstance(self.k, bool) or not isinstance(self.k, int) or self.k < 0):
            raise ValueError(f"invalid options: k {self.k!r}")
        if self.lock_palette is not None:
            object.__setattr__(self, "lock_palette", tuple(tuple(int(c) for c in rgb) for rgb in self.lock_palette))
            if any(len(rgb) != 3 or not all(0 <= c <= 255 for c in rgb) for rgb in self.lock_palette):
                raise ValueError("invalid options: palette")

    @classmethod
    def from_json(cls, text: str) -> Options:
        try:
            found = json.loads(text)
            known = {f.name for f in fields(cls)}
            return cls(**{k: v for k, v in found.items() if k in known})
        except (TypeError, AttributeError, json.JSONDecodeError) as e:
            raise ValueError(f"invalid options: {e}") from e

    @classmethod
    def from_ui(cls, ui: dict) -> Options:
        """From the names an editor uses: ``auto`` counts and lower-case classes."""
        kind = ui.get("class", "auto")
        return cls(class_override=None if kind == "auto" else str(kind).capitalize(), k=color_count(ui.get("colors", "auto")), bw_mode=bool(ui.get("bw", False)), detail=float(ui.get("detail", EDITOR.detail)), gradients=bool(ui.get("gradients", False)))


DEFAULT, EDITOR = Options(), Options(detail=0.6)


def color_count(text) -> int | None:
    """A menu entry as a palette size; null means automatic."""
    return None if text in (None, "auto") else int(text)


def unit(detail: Column) -> Column:
    return F.least(F.greatest(detail, F.lit(0.0)), F.lit(1.0))


def by_class(kind: Column, values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(kind == name, F.lit(float(value))).otherwise(out)
    return out


def falling(high, low, detail: Column) -> Column:
    """From ``high`` at detail 0 to ``low`` at detail 1, in whole steps."""
    return (high - F.round((high - low) * unit(detail))).cast("int")


def detail_k(kind: Column, detail: Column) -> Column:
    low, high = (by_class(kind, {c: v[j] for c, v in PALETTE_SIZE.items()}) for j in (0, 1))
    return (low + F.round((high - low) * unit(detail))).cast("int")


def effective_k(kind: Column, detail: Column, effective: Column, k: Column) -> Column:
    """Explicit k wins; photos take the curve, others no more than the colours that are there."""
    curve = detail_k(kind, detail)
    return F.coalesce(k, F.when(kind == "Photo", curve).otherwise(F.least(curve, F.greatest(effective, F.lit(2)))))


def significant_bits(detail: Column) -> Column:
    return (F.round(unit(detail) * 2.0) + 5).cast("int")


def sigma_color(detail: Column) -> Column:
    return F.lit(0.16) - unit(detail) * 0.12


def denoises(kind: Column, detail: Column) -> Column:
    return (kind != "Logo") & (unit(detail) < DENOISE_BELOW)


def min_region(detail: Column) -> Column:
    return falling(F.lit(8.0), F.lit(1.0), detail)


def min_area(n_opaque: Column) -> Column:
    return F.greatest(F.floor(n_opaque * MIN_AREA_SHARE), F.lit(MIN_AREA)).cast("int")


def tracer_settings(kind: Column, detail: Column) -> dict[str, Column]:
    """Speckle side, corner threshold, path precision and layer difference."""
    span = lambda table: falling(by_class(kind, {c: v[1] for c, v in table.items()}), by_class(kind, {c: v[0] for c, v in table.items()}), detail)
    return {"filter_speckle": span(SPECKLE), "corner_threshold": span(CORNER), "path_precision": F.round(unit(detail) * 4.0 + 4.0).cast("int"), "layer_difference": F.greatest(F.least(F.round(F.lit(64.0) - unit(detail) * 56.0), F.lit(64.0)), F.lit(4.0)).cast("int")}
