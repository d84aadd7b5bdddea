"""The three end-to-end chains, composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..keys import ordered_index
from ..operators import assemble, binarize, detect, intake, layout, options, palette, raster, resample, textlayer
from ..operators.raster import PAGE
from ..session import cut_lineage


def compress(
    pages: DataFrame, lines: DataFrame, overrides: DataFrame, settings: dict, streams: DataFrame | None = None,
    words: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(document parts, pages left out with a reason).

    Every page is encoded under its own options. Black-and-white and palette pages
    are made from their scanlines, brought to the page's target size first, with the page's bias
    and number of colours. Grey, colour and lossless pages take their already encoded picture from
    ``streams`` (doc_id, page_no, w_px, h_px, stream); there is no picture coder here. A page
    without scanlines or picture is reported. ``words``, recognised words as ``ocr_words`` gives them with
    their idx on the page, become the hidden word layer, at the resolution that recognition used.
    """
    presets = options.preset_table(pages.sparkSession)
    sized = cut_lineage(
        layout.ocr_render_dpi(layout.target_size(options.resolve_page_options(pages, overrides, presets, settings))), "sized")
    drawn = F.coalesce(F.col("color_mode").isin("bw", "indexed") & (F.col("mode") != "lossless"), F.lit(False))
    own = sized.where(drawn).select(*PAGE, "color_mode", "w_px", "h_px", F.coalesce("bias", F.lit(0)).alias("bias"),
                                    F.coalesce("colors", F.lit(16)).alias("colours"))

    def branch(mode: str) -> DataFrame:
        fitting = resample.sized_lines(lines, own.where(F.col("color_mode") == mode), ("bias",))
        # Scanlines that are coarser than the target stay as they are: enlarging them adds nothing.
        fitting = fitting.withColumns({"w_px": F.least("w_px", F.size("r")), "h_px": F.least("h_px", "h")})
        return resample.resample(fitting, ("r", "g", "b"), ("bias",))

    bits = binarize.binarize(
        raster.luminance(branch("bw"), ("bias",)), "bias", settings.get("contrast") or 0, settings.get("dark_areas") or "auto"
    )
    indexed, pal = palette.quantize_indexed(cut_lineage(branch("indexed"), "resampled"), own.select(*PAGE, "colours"), "bias")
    encoded = assemble.encode_bilevel(bits).unionByName(assemble.encode_indexed(indexed, pal))
    if streams is not None:
        given = streams.where("length(stream) > 0").join(sized.where(~drawn).select(*PAGE), PAGE, "left_semi")
        encoded = encoded.unionByName(given.select(
            *PAGE, "w_px", "h_px", F.lit("jpeg").alias("codec"), "stream", F.lit(None).cast("string").alias("palette")))
    encoded = cut_lineage(encoded, "encoded")
    boxes = sized.selectExpr(*PAGE, "out_w_pt AS w_pt", "out_h_pt AS h_pt")
    reason = F.when(drawn, "no scanlines").otherwise("no picture stream")
    left_out = sized.withColumn("reason", reason).join(encoded.select(*PAGE), PAGE, "left_anti").select(*PAGE, "reason")
    layer = None if words is None else textlayer.place_words(words, sized.selectExpr(*PAGE, "ocr_dpi AS dpi", "out_h_pt AS h_pt"))
    return assemble.assemble_documents(encoded.join(boxes, PAGE), layer), left_out


def take_over(files: DataFrame, selected: DataFrame, pages: DataFrame, merged_id: int) -> tuple[DataFrame, DataFrame]:
    """Selected intake files merged into one document: (pages, lineage rows).

    ``files`` carry doc_id and readable next to the catalogue columns.
    """
    chosen = intake.apply_selection(intake.raw_catalog_df(files), selected)
    ranked = ordered_index(
        chosen.withColumn("merged_id", F.lit(merged_id)), ["merged_id"], F.floor(F.col("modified_ms") / 86_400_000), ["modified_ms", "name"], "order_no"
    )
    merged, _ = intake.merge_documents(ranked.select("merged_id", "order_no", "doc_id", "kind", "readable"), pages)
    return merged, ranked.select("merged_id", "order_no", "name")


def straighten(scans: DataFrame, lines: DataFrame) -> DataFrame:
    """Straightened scanlines: sheet edge, else document corners, else inset rectangle.

    ``scans``: doc_id, page_no, px_w, px_h, scan_dpi, origin_x, origin_y.
    """
    sheet = layout.pick_sheet(layout.bed_a4(scans.join(detect.detect_sheet(lines), PAGE, "left")))
    corners = layout.corner_fallback(sheet.join(detect.detect_document(lines), PAGE, "left"))
    quads = layout.quad_output_size(
        layout.order_corners(corners).withColumns({"src_w": F.col("px_w"), "src_h": F.col("px_h")})
    )
    return detect.warp_perspective(lines, quads)
