"""Encoder settings, presets and their builder."""

from __future__ import annotations

from dataclasses import dataclass, replace

from tesselq.functions.dims import PRESETS


@dataclass(frozen=True)
class Options:
    """How an image is encoded. strip_metadata has no effect: no metadata is ever written."""

    level: int = 6
    strategy: str = "adaptive"
    optimize_alpha: bool = True
    reduce_color: bool = True
    optimal: bool = False
    strip_metadata: bool = False
    max_colors: int = 0
    dithering: bool = False


def preset(name: str, max_colors: int = 0, dithering: bool = False) -> Options:
    for key, level, strategy, alpha, reduce, optimal in PRESETS:
        if key == name:
            return Options(level, strategy, alpha, reduce, optimal, max_colors=max_colors, dithering=dithering)
    raise ValueError(f"no preset {name!r}")


def preset_by_number(n: int, max_colors: int = 0, dithering: bool = False) -> Options:
    """0: max, 1: balanced, 2: fast; others: balanced."""
    return preset({0: "max", 2: "fast"}.get(n, "balanced"), max_colors, dithering)


class OptionsBuilder:
    """Settings one after the other; each call returns a new builder."""

    def __init__(self, options: Options | None = None):
        self._options = options or preset("balanced")

    def _with(self, **changes) -> OptionsBuilder:
        return OptionsBuilder(replace(self._options, **changes))

    def fast(self) -> OptionsBuilder:
        return OptionsBuilder(preset("builder_fast"))

    def balanced(self) -> OptionsBuilder:
        return OptionsBuilder(preset("balanced"))

    def max(self) -> OptionsBuilder:
        return OptionsBuilder(preset("max"))

    def compression_level(self, level: int) -> OptionsBuilder:
        return self._with(level=max(1, min(9, level)))

    def filter_strategy(self, strategy: str) -> OptionsBuilder:
        return self._with(strategy=strategy)

    def optimize_alpha(self, on: bool) -> OptionsBuilder:
        return self._with(optimize_alpha=on)

    def reduce_color_type(self, on: bool) -> OptionsBuilder:
        return self._with(reduce_color=on)

    def strip_metadata(self, on: bool) -> OptionsBuilder:
        return self._with(strip_metadata=on)

    def optimal_deflate(self, on: bool) -> OptionsBuilder:
        return self._with(optimal=on)

    def colors(self, most: int, dithering: bool = False) -> OptionsBuilder:
        return self._with(max_colors=most, dithering=dithering)

    def build(self) -> Options:
        return self._options
