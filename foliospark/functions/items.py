"""Raw text layer to normalised items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.metadata import bound
from foliospark.functions.text import is_symbol_font, sanitize_wingdings, trim_text


def detect_symbol_fonts(fonts: DataFrame) -> DataFrame:
    """file_id, page, font_name, is_symbol: by font family; real font names only on pages where no family matched."""
    by_family = F.coalesce(is_symbol_font(F.col("font_family")), F.lit(False))
    page = Window.partitionBy("file_id", "page")
    any_family = F.max(by_family.cast("int")).over(page) == 1
    by_name = F.coalesce(is_symbol_font(F.col("real_name")), F.lit(False))
    return fonts.select("file_id", "page", "font_name", F.when(any_family, by_family).otherwise(by_name).alias("is_symbol"))


def normalize_text_items(raw: DataFrame, dims: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    """Items in thousandths of the page, origin top left; symbols replaced; without transform or with blank text left out."""
    rows = raw.filter(F.col("transform").isNotNull() & (trim_text(F.col("str")) != "")).join(dims.select("file_id", "page", F.col("width").alias("vw"), F.col("height").alias("vh")), ["file_id", "page"])
    if fonts is not None:
        rows = rows.join(detect_symbol_fonts(fonts), ["file_id", "page", "font_name"], "left")
        rows = rows.withColumn("str", F.when(F.col("is_symbol"), sanitize_wingdings(F.col("str"))).otherwise(F.col("str"))).filter(trim_text(F.col("str")) != "")
    t = {c: F.col(c) for c in ("transform", "width", "height")}
    return rows.select("file_id", "page", "item_idx", "str", *[c.alias(n) for n, c in _placed(t, F.col("vw"), F.col("vh")).items()])


def _placed(t, width: Column, height: Column) -> dict[str, Column]:
    tx, ty = F.get(t["transform"], 4), F.get(t["transform"], 5)
    y, h = (height - ty - t["height"]) / height * 1000, t["height"] / height * 1000
    return {"norm_x": tx / width * 1000, "norm_y": y, "norm_w": t["width"] / width * 1000, "norm_h": h, "norm_baseline": y + h}


def symbol_names(fonts: Column) -> Column:
    """detect_symbol_fonts of a page's fonts in one array (font_name, font_family, real_name): names of symbol fonts."""
    named = lambda field: F.filter(fonts, lambda f: F.coalesce(is_symbol_font(f[field]), F.lit(False)))
    return F.transform(bound(named("font_family"), lambda by: F.when(F.size(by) > 0, by).otherwise(named("real_name"))), lambda f: f["font_name"])


def normalize_pages(pages: DataFrame) -> DataFrame:
    """normalize_text_items of pages that are one row each: items (raw), width, height and, where there are any, fonts. Nothing is
    shuffled; other columns stay."""
    plain = lambda t: t["transform"].isNotNull() & (trim_text(t["str"]) != "")
    said = lambda t, names: F.when(F.array_contains(names, t["font_name"]), sanitize_wingdings(t["str"])).otherwise(t["str"])
    item = lambda t, text: F.struct(t["item_idx"].alias("item_idx"), text.alias("str"), *[c.alias(n) for n, c in _placed(t, F.col("width"), F.col("height")).items()])
    kept = F.filter("items", plain)
    if "fonts" in pages.columns:
        made = bound(symbol_names(F.col("fonts")), lambda names: F.transform(kept, lambda t: item(t, said(t, names))))
        items = F.filter(made, lambda t: trim_text(t["str"]) != "")
    else:
        items = F.transform(kept, lambda t: item(t, t["str"]))
    return pages.withColumn("items", items).drop("width", "height", "fonts")
