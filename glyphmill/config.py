"""Options of a conversion: presets, a chainable builder and the choice of a preset from a document's figures."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ParserOptions:
    """Which child tables a source produces."""

    text: bool = True
    images: bool = True
    graphics: bool = True
    forms: bool = True
    annotations: bool = True

    def tables(self) -> list[str]:
        names = {"text_items": self.text, "images": self.images, "graphics": self.graphics, "forms": self.forms, "annotations": self.annotations}
        return [n for n, on in names.items() if on]


@dataclass(frozen=True)
class HtmlOptions:
    format: str = "html+inline-css"
    preserve_layout: bool = True
    responsive: bool = True
    dark_mode: bool = False
    layout_mode: str = "semantic"
    use_flexbox: bool = True
    text_layout_passes: int = 1
    line_height_factor: float = 1.15
    include_extracted_text: bool = False
    include_reset: bool = True
    include_fonts: bool = True
    include_print: bool = True
    custom_styles: str = ""


@dataclass(frozen=True)
class Config:
    enable_ocr: bool = False
    enable_font_mapping: bool = False
    parser: ParserOptions = field(default_factory=ParserOptions)
    html: HtmlOptions = field(default_factory=HtmlOptions)

    def with_ocr(self, on: bool = True) -> Config:
        return replace(self, enable_ocr=on)

    def with_font_mapping(self, on: bool = True) -> Config:
        return replace(self, enable_font_mapping=on)

    def with_html(self, **changes) -> Config:
        return replace(self, html=replace(self.html, **changes))

    def with_parser(self, **changes) -> Config:
        return replace(self, parser=replace(self.parser, **changes))

    def with_preset(self, name: str) -> Config:
        return PRESETS[name]


PRESETS = {
    "editing": Config(enable_ocr=True, enable_font_mapping=True, html=HtmlOptions(layout_mode="semantic", use_flexbox=True, include_extracted_text=True)),
    "fidelity": Config(html=HtmlOptions(layout_mode="absolute", use_flexbox=False, text_layout_passes=2)),
    "web": Config(enable_font_mapping=True, html=HtmlOptions(layout_mode="flow", preserve_layout=False, format="html+css")),
}


def for_editing() -> Config:
    return PRESETS["editing"]


def for_fidelity() -> Config:
    return PRESETS["fidelity"]


def for_web() -> Config:
    return PRESETS["web"]


def suggested_preset(pages: Column, images: Column, items: Column, complex_pages: Column, is_scanned: Column) -> Column:
    """struct<preset, reason>; the first that holds decides."""
    said = lambda p, r: F.struct(F.lit(p).alias("preset"), F.lit(r).alias("reason"))
    return (
        F.when(pages == 0, said("web", "empty"))
        .when(is_scanned, said("editing", "scanned"))
        .when((pages == 1) & (images > 5), said("fidelity", "single page with many images"))
        .when((complex_pages > 0) | (pages > 10), said("web", "complex layout"))
        .when(items > 1000, said("editing", "text-heavy"))
        .otherwise(said("web", "general"))
    )
