"""Word layer of recognised pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import drawable, number, winansi_hex
from .raster import PAGE


def ocr_words(ocr: DataFrame, least: int = 25) -> DataFrame:
    """Flatten blocks > paragraphs > lines > words, keeping confident words with a box."""
    d = ocr.select(*PAGE, F.posexplode("blocks").alias("b", "_b"))
    d = d.select(*PAGE, "b", F.posexplode("_b.paragraphs").alias("p", "_p"))
    d = d.select(*PAGE, "b", "p", F.posexplode("_p.lines").alias("l", "_l"))
    d = d.select(*PAGE, "b", "p", "l", F.posexplode("_l.words").alias("w", "_w"))
    return d.where(f"coalesce(_w.confidence, 0) >= {least} AND _w.bbox IS NOT NULL").selectExpr(
        *PAGE, "b", "p", "l", "w", "_w.text AS text", "_w.confidence AS confidence",
        *[f"_w.bbox.{c} AS {c}" for c in ("x0", "y0", "x1", "y1")],
    )


def place_words(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Position and font size of each hidden word on its page (pages: dpi, h_pt)."""
    j = words.join(pages.select(*PAGE, "dpi", "h_pt"), PAGE).selectExpr(
        "*", "72D / dpi AS _s", "regexp_replace(text, '^\\\\s+|\\\\s+$', '') AS _t"
    ).where(f"_t <> '' AND (y1 - y0) * _s > 0.1D AND {drawable('_t')}")
    return j.selectExpr(
        *PAGE, "idx", "_t AS text", "x0 * _s AS x", "h_pt - y1 * _s AS y",
        "greatest(2D, least(72D, (y1 - y0) * _s)) AS size",
    )


def searchable_text(words: DataFrame, order: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Words of a page in reading order; a page's word list is bounded by the page."""
    return words.groupBy(*PAGE).agg(
        F.array_join(
            F.expr(f"transform(sort_array(array_agg(struct({', '.join(order)}, text))), e -> e.text)"), " "
        ).alias("page_text")
    )


def word_operators(placed: DataFrame, font: str = "F0") -> DataFrame:
    """Content stream text of every page's hidden words, in the order of idx.

    Rendering mode 3 draws nothing, but the words can be found and copied. Each word sets its own size
    and place. What is gathered is bounded by the page.
    """
    shown = f"concat('/{font} ', {number('size')}, ' Tf 1 0 0 1 ', {number('x')}, ' ', {number('y')}, ' Tm <', {winansi_hex('text')}, '> Tj')"
    return placed.selectExpr(*PAGE, "idx", f"{shown} AS _op").groupBy(*PAGE).agg(
        F.expr("concat('BT 3 Tr\\n', array_join(transform(sort_array(array_agg(struct(idx, _op))), e -> e._op), '\\n'), '\\nET')").alias("operators")
    )
