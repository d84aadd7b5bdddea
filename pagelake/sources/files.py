"""Folder, image and profile readers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixed import IMPORT_ENDING, IMPORT_MAX_EDGE
from ..functions.text import valid_json
from ..operators.intake import raw_catalog_df
from ..stores import read_text
from .folders import folder_files

def raw_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted files of an intake folder, oldest first; names may begin with ``_``."""
    return raw_catalog_df(folder_files(spark, folder).select("name", "bytes", "modified_ms"))


def import_folder(spark: SparkSession, folder: str, max_depth: int = 2) -> DataFrame:
    """PDF files of a folder tree, at most ``max_depth`` directories down."""
    return folder_files(spark, folder, max_depth).where("lower(name) LIKE '%.pdf'")


def _to_lines(max_edge: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                img = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.channels)
                if row.channels == 1:
                    img = np.repeat(img, 3, axis=2)
                s = min(1.0, max_edge / max(row.height, row.width))
                h, w = max(1, int(row.height * s + 0.5)), max(1, int(row.width * s + 0.5))
                ys = ((2 * np.arange(h) + 1) * row.height) // (2 * h)
                xs = ((2 * np.arange(w) + 1) * row.width) // (2 * w)
                img = img[ys][:, xs].astype(np.int32)
                for lo in range(0, h, 256):
                    part = img[lo:lo + 256]
                    yield pd.DataFrame({
                        "name": row.name, "path": row.path, "src_w": row.width, "src_h": row.height,
                        "scan_dpi": pd.array([None if pd.isna(row.scan_dpi) else int(row.scan_dpi)] * len(part), "Int32"), "y": np.arange(lo, lo + len(part)),
                        "r": list(part[:, :, 2]), "g": list(part[:, :, 1]), "b": list(part[:, :, 0]),
                    })

    return run


def page_images(
    spark: SparkSession, folder: str, max_edge: int = IMPORT_MAX_EDGE, resolutions: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(RGB scanlines, rejected files) of the images in a folder tree; the path tells equal names apart.

    Lines keep the image's own size and, from ``resolutions`` (name, scan_dpi, each name once), the
    resolution it was scanned at, as ``bed_a4`` needs them; null where it is not known.

    Unreadable images and formats without a decoder are reported, not fatal.
    """
    src = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder)
    flat = src.selectExpr(
        "regexp_extract(image.origin, '([^/]*)$', 1) AS name", "image.origin AS path", "image.width AS width", "image.height AS height",
        "image.nChannels AS channels", "image.data AS data",
    ).where(F.col("name").rlike(IMPORT_ENDING))
    known = flat.withColumn("scan_dpi", F.lit(None).cast("int")) if resolutions is None else flat.join(
        resolutions.select("name", F.col("scan_dpi").cast("int").alias("scan_dpi")), "name", "left")
    lines = known.where("width > 0").mapInPandas(
        _to_lines(max_edge), "name string, path string, src_w int, src_h int, scan_dpi int, y int, r array<int>, g array<int>, b array<int>"
    )
    return lines, flat.where("width <= 0").selectExpr("name", "path", "'unreadable' AS reason")


def profile_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Stored profiles; a missing profile is empty, any other problem surfaces."""
    version = read_text(f"{folder}/CURRENT")
    if version is None:
        return spark.createDataFrame([], "owner long, document string")
    return spark.read.parquet(f"{folder}/{version.strip()}")


def profile_parse(documents: DataFrame, app: str) -> DataFrame:
    """Exported profiles split into their three keys; refused ones carry a reason.

    Missing stamps and settings become empty.
    """
    return documents.selectExpr(
        "*",
        f"""CASE WHEN NOT ({valid_json('document')}) THEN 'not json'
             WHEN NOT coalesce(get_json_object(document, '$.app') = '{app}', false) THEN 'wrong application'
             WHEN NOT coalesce(get_json_object(document, '$.signatures') LIKE '[%', false) THEN 'no signatures' END AS reason""",
    ).selectExpr(
        "*", "CASE WHEN reason IS NULL THEN get_json_object(document, '$.signatures') END AS signatures",
        "CASE WHEN reason IS NULL THEN coalesce(get_json_object(document, '$.stamps'), '[]') END AS stamps",
        "CASE WHEN reason IS NULL THEN coalesce(get_json_object(document, '$.settings'), '{}') END AS settings",
        "CASE WHEN reason IS NULL THEN json_array_length(get_json_object(document, '$.signatures')) END AS n_signatures",
    ).drop("document")


def profile_import(spark: SparkSession, path: str, app: str) -> DataFrame:
    """Read export files (one document per file) and split them."""
    docs = spark.read.option("wholetext", "true").text(path).withColumnRenamed("value", "document")
    return profile_parse(docs, app)
