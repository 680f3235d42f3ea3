"""Column functions on text: trimming, symbol fonts, garbled text, fences, markdown."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: White space as scripts of the web trim it; Spark's trim strips blanks only unless it is told.
SPACE = " \t\n\v\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

#: Symbols of private-use characters; others become ●.
PUA_MAP = {
    "\uf06e": "■", "\uf0d8": "▷", "\uf0b7": "●", "\uf06c": "●", "\uf0a7": "■",
    "\uf0a8": "□", "\uf0b2": "◆", "\uf076": "✓", "\uf0fc": "✓", "\uf0e8": "➤",
}
#: Symbols of letters in symbol fonts; others become ■.
WINGDINGS_MAP = {"l": "●", "n": "■", "q": "◆", "r": "□", "u": "○", "v": "✓", "x": "✕", "t": "◇", "w": "✗", "à": "🖊"}
SYMBOL_FONTS = "(?i)wingdings|webdings|zapfdingbats"
CJK = "[\\u4E00-\\u9FFF\\u3400-\\u4DBF\\uF900-\\uFAFF]"
SEPARATOR = r"^\|?(\s*:?-+:?\s*\|)+\s*:?-+:?\s*\|?$"

SEGMENTS = ArrayType(StructType([
    StructField("type", StringType()), StructField("content", StringType()),
    StructField("headers", ArrayType(StringType())), StructField("rows", ArrayType(ArrayType(StringType()))),
]))


def trim_text(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def is_symbol_font(name: Column) -> Column:
    return name.rlike(SYMBOL_FONTS)


def sanitize_wingdings(text: Column) -> Column:
    """Each character of a symbol font by its symbol, ■ if it has none; line breaks stay."""
    symbols = F.create_map(*[F.lit(x) for pair in WINGDINGS_MAP.items() for x in pair])
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.when(c == "\n", c).otherwise(F.coalesce(symbols[c], F.lit("■")))), "")


def sanitize_pua(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "".join(PUA_MAP), "".join(PUA_MAP.values())), "[\\uE000-\\uF8FF]", "●")


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def is_cid_passthrough(text: Column) -> Column:
    """At least two characters, over 0.4 of them in U+0100 to U+1FFF: glyph numbers taken for letters. Text in
    Greek, Cyrillic or much Latin Extended counts too; the rule is meant for Chinese and English."""
    kept = F.length(F.regexp_replace(text, "[^\\u0100-\\u1FFF]", ""))
    return (F.length(text) >= 2) & (kept / F.length(text) > 0.4)


def is_garbled(text: Column) -> Column:
    t = trim_text(text)
    readable = F.length(F.regexp_replace(t, "[^\\u4E00-\\u9FFF\\x20-\\x7E\\u3000-\\u303F\\uFF00-\\uFFEF\\u2000-\\u206F]", ""))
    return F.when(F.length(t) < 4, False).otherwise(is_cid_passthrough(t) | (readable / F.length(t) < 0.35))


def strip_code_fence(text: Column) -> Column:
    """The first fenced block anywhere, trimmed; else the whole text, trimmed."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return trim_text(F.when(text.rlike(r"(?s)```.*?```"), fenced).otherwise(text))


def strip_markdown_fence(text: Column) -> Column:
    """The block only where the fence spans the whole text."""
    t = trim_text(text)
    return F.when(t.rlike(r"(?s)^```(?:markdown)?\s*.*```$"), trim_text(F.regexp_extract(t, r"(?s)^```(?:markdown)?\s*(.*?)```$", 1))).otherwise(t)


def clear_transient(text: Column) -> Column:
    """Texts that only tell of progress or failure are not saved."""
    return F.when(text.startswith("⏳") | text.startswith("❌"), "").otherwise(text)


def sanitize_file_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r'[/\\:*?"<>|]', "_")


def export_date(date: Column) -> Column:
    return F.replace(date, F.lit("/"), F.lit("-"))


def has_markdown_table(text: Column) -> Column:
    lines = F.split(text, "\n")
    return F.exists(lines, lambda x: x.contains("|")) & F.exists(lines, lambda x: trim_text(x).rlike(SEPARATOR))


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.removeprefix("|").removesuffix("|").split("|")]


_SEPARATOR = re.compile(SEPARATOR)


def markdown_segments(text: str) -> list[dict]:
    """Text and table segments in order. A table is a line with | before a separator line of two columns or more."""
    lines = text.split("\n")
    opens = [("|" in a) and bool(_SEPARATOR.match(b.strip())) for a, b in zip(lines, lines[1:], strict=False)] + [False]
    out, plain, at = [], [], 0

    def flush() -> None:
        if content := "\n".join(plain).strip():
            out.append({"type": "text", "content": content, "headers": None, "rows": None})
        plain.clear()

    while at < len(lines):
        if not opens[at]:
            plain.append(lines[at])
            at += 1
            continue
        flush()
        stop = next((k for k in range(at + 2, len(lines)) if "|" not in lines[k]), len(lines))
        out.append({"type": "table", "content": None, "headers": _cells(lines[at]), "rows": [_cells(x) for x in lines[at + 2 : stop]]})
        at = stop
    flush()
    return out


def parse_markdown(text: Column) -> Column:
    """Segments of a text, whole texts in Arrow batches; null gives null."""

    @F.pandas_udf(SEGMENTS)
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(markdown_segments, na_action="ignore")

    return parse(text)


def to_markdown(segments: Column) -> Column:
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = lambda cells: row(F.transform(cells, lambda _: F.lit("---")))
    table = lambda s: F.array_join(F.concat(F.array(row(s["headers"]), rule(s["headers"])), F.transform(s["rows"], row)), "\n")
    return F.array_join(F.transform(segments, lambda s: F.when(s["type"] == "text", s["content"]).otherwise(table(s))), "\n\n")


def markdown_cells(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, segment, row, cell, value: the cells of every table; row 0 holds the headers."""
    segments = rows.select(*keys, F.posexplode(parse_markdown(F.col(text))).alias("segment", "s")).filter("s.type = 'table'")
    lines = segments.select(*keys, "segment", F.posexplode(F.concat(F.array("s.headers"), "s.rows")).alias("row", "cells"))
    return lines.select(*keys, "segment", "row", F.posexplode("cells").alias("cell", "value"))
