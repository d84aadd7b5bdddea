"""Encoded pages and the parts of finished documents.

A document is never gathered: it is a set of parts with byte offsets. Offsets
are running sums of part sizes, so parts can be written in any order, by any
task, any number of times, with the same result.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType

from ..functions import fax
from ..keys import ordered_index, running_total
from ..session import cut_lineage
from .bilevel import _with_line_above, pack_bits, pack_nibbles
from .raster import PAGE
from .textlayer import word_operators

FAN_OUT = 512
HEADER = "%PDF-1.5\n"


def _line_codes(above: pd.Series, current: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([fax.line_code(a.tolist(), c.tolist(), w) for a, c, w in zip(above, current, width.tolist())])


def _page_bytes(lines: pd.Series) -> pd.Series:
    return lines.map(lambda codes: fax.page_stream(list(codes)))


def _deflate(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: zlib.compress(bytes(b)))


_codes_udf = pandas_udf(_line_codes, StringType())
_page_udf = pandas_udf(_page_bytes, BinaryType())
_deflate_udf = pandas_udf(_deflate, BinaryType())


def encode_bilevel(bits: DataFrame, requested: str = "auto") -> DataFrame:
    """One compressed stream per black-and-white page, the smaller codec unless one is named."""
    coded = pack_bits(_with_line_above(bits)).select(
        *PAGE, "y", F.size("bit").alias("w"), "packed", _codes_udf("above", "changes", F.size("bit")).alias("code")
    )
    both = coded.groupBy(*PAGE).agg(
        F.max("w").alias("w_px"), F.count(F.lit(1)).cast("int").alias("h_px"),
        F.expr("sort_array(array_agg(struct(y, code, hex(packed) AS h)))").alias("_lines"),
    ).select(
        *PAGE, "w_px", "h_px", _page_udf(F.expr("transform(_lines, e -> e.code)")).alias("_g4"),
        _deflate_udf(F.expr("unhex(array_join(transform(_lines, e -> e.h), ''))")).alias("_flate"),
    )
    pick = "length(_g4) <= length(_flate)" if requested == "auto" else f"'{requested}' = 'g4'"
    return both.selectExpr(
        *PAGE, "w_px", "h_px", f"CASE WHEN {pick} THEN 'g4' ELSE 'flate' END AS codec",
        f"CASE WHEN {pick} THEN _g4 ELSE _flate END AS stream", "CAST(NULL AS STRING) AS palette",
    )


def encode_indexed(indexed: DataFrame, palette: DataFrame) -> DataFrame:
    """One compressed stream per palette page, with the palette as hex."""
    packed = pack_nibbles(indexed).groupBy(*PAGE).agg(
        F.max(F.size("idx")).alias("w_px"), F.count(F.lit(1)).cast("int").alias("h_px"),
        F.expr("unhex(array_join(transform(sort_array(array_agg(struct(y, hex(packed) AS h))), e -> e.h), ''))").alias("raw"),
    )
    pal = palette.groupBy(*PAGE).agg(
        F.expr("""array_join(transform(sort_array(array_agg(struct(k, r, g, b))),
            c -> concat(lpad(hex(c.r), 2, '0'), lpad(hex(c.g), 2, '0'), lpad(hex(c.b), 2, '0'))), '')""").alias("palette")
    )
    return packed.join(pal, PAGE).select(
        *PAGE, "w_px", "h_px", F.lit("indexed").alias("codec"), _deflate_udf("raw").alias("stream"), "palette"
    )


def _bytes(text: str) -> str:
    return f"encode({text}, 'ISO-8859-1')"


def _xref(offset: str) -> str:
    return f"concat(lpad(CAST({offset} AS STRING), 10, '0'), ' 00000 n \\n')"


def assemble_documents(encoded: DataFrame, words: DataFrame | None = None, chunk: int = FAN_OUT) -> DataFrame:
    """Parts of one document of page images per doc_id: (doc_id, part, offset, content).

    ``encoded``: pages of each document with page_no, w_pt, h_pt, w_px, h_px, codec, stream,
    palette; they are numbered anew in order, so that gaps in page_no do no harm. Page i
    owns objects 3i..3i+2; a two-level page tree keeps every tree node small; index entries
    have a fixed size, so each page also knows where its own entries go.

    ``words``: hidden words by doc_id and page_no as ``place_words`` gives them. They go into
    the page's content stream and use one font object, which a document's pages share; it follows the
    tree nodes and the catalogue. Words of pages that are not there are left out.
    """
    # What follows reads pages many times over, and their places too: neither is worked out twice.
    encoded = cut_lineage(encoded, "pages")
    layered = encoded.withColumn("_words", F.lit(None).cast("string")) if words is None else encoded.join(
        word_operators(words).withColumnRenamed("operators", "_words"), PAGE, "left")
    encoded = ordered_index(layered, ["doc_id"], F.floor(F.col("page_no") / 1024), ["page_no"], "_place").drop("page_no").withColumn(
        "page_no", F.col("_place").cast("int")).drop("_place")
    kind = """CASE codec WHEN 'jpeg' THEN '/ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode'
        WHEN 'indexed' THEN concat('/ColorSpace [/Indexed /DeviceRGB ', length(palette) div 6 - 1, ' <', palette, '>] /BitsPerComponent 4 /Filter /FlateDecode')
        WHEN 'g4' THEN concat('/ColorSpace /DeviceGray /BitsPerComponent 1 /Filter /CCITTFaxDecode /DecodeParms << /K -1 /Columns ', w_px, ' /Rows ', h_px, ' /BlackIs1 false >>')
        ELSE '/ColorSpace /DeviceGray /BitsPerComponent 1 /Filter /FlateDecode' END"""
    draw = "concat('q ', w_pt, ' 0 0 ', h_pt, ' 0 0 cm /Im0 Do Q', coalesce(concat('\\n', _words), ''))"
    font_id = f"(3 + 3 * n + (n + {chunk - 1}) div {chunk})"
    font = "''" if words is None else f"""concat({font_id}, ' 0 obj\\n<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>\\nendobj\\n')"""
    sizes = encoded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    pages = encoded.join(sizes, "doc_id").selectExpr(
        "*", f"CAST((page_no - 1) div {chunk} AS BIGINT) AS node", "3L * page_no AS id"
    ).selectExpr(
        "doc_id", "page_no", "n", "node", "id",
        f"""concat(id, ' 0 obj\\n<< /Type /Page /Parent ', 3 + 3 * n + node, ' 0 R /MediaBox [0 0 ', w_pt, ' ', h_pt,
            '] /Resources << /XObject << /Im0 ', id + 2, ' 0 R >>', if(_words IS NULL, '', concat(' /Font << /F0 ', {font_id}, ' 0 R >>')),
            ' >> /Contents ', id + 1, ' 0 R >>\\nendobj\\n') AS _a""",
        f"concat(id + 1, ' 0 obj\\n<< /Length ', length({draw}), ' >>\\nstream\\n', {draw}, '\\nendstream\\nendobj\\n') AS _b",
        f"""concat(id + 2, ' 0 obj\\n<< /Type /XObject /Subtype /Image /Width ', w_px, ' /Height ', h_px, ' ', {kind},
            ' /Length ', length(stream), ' >>\\nstream\\n') AS _c""",
        "stream",
    ).withColumn("_size", F.expr("CAST(length(_a) + length(_b) + length(_c) + length(stream) + 18 AS BIGINT)"))
    placed = cut_lineage(running_total(pages, ["doc_id"], F.col("node"), ["page_no"], "_size", "_before").withColumn(
        "_at", F.expr(f"CAST(_before + {len(HEADER)} AS BIGINT)")
    ), "placed")
    body = placed.select("doc_id", "_at", F.expr(
        f"concat({_bytes('concat(_a, _b, _c)')}, stream, {_bytes(chr(39) + chr(92) + 'nendstream' + chr(92) + 'nendobj' + chr(92) + 'n' + chr(39))})"
    ).alias("content")).selectExpr("doc_id", "'page' AS part", "_at AS offset", "content")

    # Tree nodes: one per ``chunk`` pages, placed after the page bodies.
    nodes = placed.groupBy("doc_id", "node").agg(
        F.sum("_size").alias("_pages_size"), F.count(F.lit(1)).alias("_kids"), F.max("n").alias("n")
    ).withColumn("_text", F.expr(f"""concat(3 + 3 * n + node, ' 0 obj\\n<< /Type /Pages /Parent 2 0 R /Count ', _kids, ' /Kids [',
        array_join(transform(sequence(1, CAST(_kids AS INT)), k -> concat(3 * (node * {chunk} + k), ' 0 R')), ' '), '] >>\\nendobj\\n')"""))
    nodes = nodes.withColumn("_len", F.length("_text").cast("long"))
    docs = nodes.groupBy("doc_id").agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("n_nodes"), F.sum("_pages_size").alias("pages_size"), F.sum("_len").alias("nodes_size")
    ).selectExpr("*", f"{len(HEADER)} + pages_size AS nodes_at", f"{len(HEADER)} + pages_size + nodes_size AS root_at").withColumn(
        "_root", F.expr("""concat('2 0 obj\\n<< /Type /Pages /Count ', n, ' /Kids [',
            array_join(transform(sequence(0, CAST(n_nodes - 1 AS INT)), k -> concat(3 + 3 * n + k, ' 0 R')), ' '), '] >>\\nendobj\\n')""")
    ).withColumn("_cat", F.lit("1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n")).selectExpr(
        "*", "root_at + length(_root) AS cat_at", "root_at + length(_root) + length(_cat) AS font_at",
        f"3 + 3 * n + n_nodes + {int(words is not None)} AS n_objects", f"{font} AS _font"
    ).withColumn("xref_at", F.expr("font_at + length(_font)")).withColumn("_head", F.expr("concat('xref\\n0 ', n_objects, '\\n')")).withColumn("entries_at", F.expr("xref_at + length(_head)"))
    node_at = running_total(
        nodes, ["doc_id"], F.floor(F.col("node") / 4096), ["node"], "_len", "_before"
    ).join(docs.select("doc_id", "nodes_at", "entries_at"), "doc_id").withColumn("_at", F.expr("CAST(nodes_at + _before AS BIGINT)"))
    tree = node_at.selectExpr("doc_id", "'node' AS part", "_at AS offset", f"{_bytes('_text')} AS content")
    node_index = node_at.selectExpr(
        "doc_id", "'index' AS part", "CAST(entries_at + 20 * (3 + 3 * n + node) AS BIGINT) AS offset", f"{_bytes(_xref('_at'))} AS content"
    )
    page_index = placed.join(docs.select("doc_id", "entries_at"), "doc_id").selectExpr(
        "doc_id", "'index' AS part", "CAST(entries_at + 20 * id AS BIGINT) AS offset",
        f"""{_bytes(f"concat({_xref('_at')}, {_xref('_at + length(_a)')}, {_xref('_at + length(_a) + length(_b)')})")} AS content""",
    )
    frame = docs.selectExpr("doc_id", f"""explode(array(
        named_struct('part', 'header', 'offset', 0L, 'content', {_bytes(f"'{HEADER[:-1]}" + chr(92) + "n'")}),
        named_struct('part', 'root', 'offset', CAST(root_at AS BIGINT), 'content', {_bytes('concat(_root, _cat, _font, _head)')}),
        named_struct('part', 'index', 'offset', CAST(entries_at AS BIGINT), 'content',
            {_bytes(f"concat('0000000000 65535 f {chr(92)}n', {_xref('cat_at')}, {_xref('root_at')})")}),
        named_struct('part', 'trailer', 'offset', CAST(entries_at + 20 * n_objects AS BIGINT), 'content',
            {_bytes("concat('trailer{0}n<< /Size ', n_objects, ' /Root 1 0 R >>{0}nstartxref{0}n', CAST(xref_at AS STRING), '{0}n%%EOF{0}n')".format(chr(92)))})
        )) AS p""").selectExpr("doc_id", "p.*")
    whole = body.unionByName(tree).unionByName(node_index).unionByName(page_index).unionByName(frame)
    if words is None:
        return whole
    return whole.unionByName(docs.selectExpr(
        "doc_id", "'index' AS part", "CAST(entries_at + 20 * (n_objects - 1) AS BIGINT) AS offset", f"{_bytes(_xref('font_at'))} AS content"))
