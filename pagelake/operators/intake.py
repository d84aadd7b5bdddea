"""Catalogue, selection, naming, merging and clean-up of intake files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..fixed import NAME_SUFFIX_LAST, UPLOAD_LIMIT
from ..functions import names as n
from ..keys import ordered_index, running_total
from ..session import cut_lineage


def raw_catalog_df(files: DataFrame) -> DataFrame:
    """Visible files with an accepted ending, with their kind, oldest first."""
    kept = files.where(f"name NOT LIKE '.%' AND {n.accepted_ending('name')}")
    return oldest_first(kept.withColumn("kind", F.expr(n.file_kind("name"))))


def oldest_first(files: DataFrame) -> DataFrame:
    """Distributed range sort by modification time, name breaking ties."""
    return files.orderBy("modified_ms", "name")


def work_list(files: DataFrame) -> DataFrame:
    pdf = files.where("lower(name) LIKE '%.pdf' OR mime = 'application/pdf'")
    return pdf.withColumn("out_name", F.expr(r"concat(regexp_replace(name, '(?i)\\.pdf$', ''), '_komprimiert.pdf')"))


def safe_names(files: DataFrame) -> DataFrame:
    return files.withColumns(
        {
            "pdf_name": F.expr(n.safe_pdf_name("name", "now_ms")),
            "raw_name": F.expr(n.safe_raw_name("name", "now_ms")),
        }
    )


def inside_dir(files: DataFrame, folder: str) -> DataFrame:
    return files.withColumn("inside", F.expr(n.inside_dir("path", f"'{folder}'")))


def file_kind(files: DataFrame) -> DataFrame:
    return files.withColumns({"kind": F.expr(n.file_kind("name")), "image_ext": F.expr(n.image_ending("mime"))})


def fmt_size(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("size_text", F.expr(n.fmt_size(column)))


def classify_error(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("error_class", F.expr(n.classify_error(column)))


def validate_upload(files: DataFrame) -> DataFrame:
    """Reason a file is refused, null for accepted ones."""
    return files.withColumn(
        "reason",
        F.expr(f"""CASE WHEN coalesce(bytes, 0) = 0 THEN 'empty' WHEN bytes > {UPLOAD_LIMIT} THEN 'too large'
                     WHEN NOT ({n.accepted_ending('name')}) THEN 'unknown ending' END"""),
    )


def accepted(files: DataFrame) -> DataFrame:
    return validate_upload(files).where("reason IS NULL").drop("reason")


def rejected(files: DataFrame) -> DataFrame:
    return validate_upload(files).where("reason IS NOT NULL")


def output_names(df: DataFrame) -> DataFrame:
    """Result name by ``how``: single / collection / scan / page. All stamps are UTC."""
    stamp = "date_format(ts, 'yyyy-MM-dd-HH-mm{0}')"
    return df.withColumn(
        "out_name",
        F.expr(f"""CASE how
            WHEN 'single' THEN concat(regexp_replace(name, '\\\\.[^.]+$', ''), '.pdf')
            WHEN 'collection' THEN concat('Sammlung_', {stamp.format('')}, '.pdf')
            WHEN 'scan' THEN concat('Scan_', date_format(ts, 'yyyy-MM-dd_HH-mm'), '.pdf')
            ELSE concat('Scan_', {stamp.format('-ss')}, '_S',
                        CASE WHEN page < 10 THEN concat('0', page) ELSE CAST(page AS STRING) END, '.',
                        {n.image_ending('mime')}) END"""),
    )


def apply_selection(files: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected names that still exist, in catalogue order."""
    return oldest_first(files.join(selected.select("name"), "name", "left_semi"))


def live_selection(files: DataFrame, selected: DataFrame) -> DataFrame:
    return selected.select("name").intersect(files.select("name"))


def append_pages(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Page lists joined in order; ``part`` keeps the list a page came from."""
    out = first.withColumn("part", F.lit(0))
    for k, df in enumerate(more, 1):
        out = out.unionByName(df.withColumn("part", F.lit(k)))
    return out


def remaining_files(files: DataFrame, deleted: DataFrame) -> DataFrame:
    return files.join(deleted.select("name"), "name", "left_anti")


def lineage_join(results: DataFrame, files: DataFrame) -> DataFrame:
    """Raw sources of every merged document that are still in the folder."""
    return results.select("doc_id", F.explode("raw_sources").alias("name")).join(files, "name")


def raw_cleanup(files: DataFrame, items: DataFrame, decisions: DataFrame) -> DataFrame:
    """What becomes of each raw file after hand-off: ``delete`` or ``keep``.

    Only sources of items that were handed off, not cleaned before, and whose
    clean-up was accepted are deleted; everything else stays.
    """
    due = (
        items.where("handed_off AND NOT raw_cleaned")
        .join(decisions.where("accept").select("doc_id"), "doc_id", "left_semi")
        .select(F.explode("raw_sources").alias("name"))
        .distinct()
        .withColumn("_due", F.lit(True))
    )
    return files.join(due, "name", "left").withColumn(
        "action", F.when(F.col("_due"), "delete").otherwise("keep")
    ).drop("_due")


def merge_documents(selection: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concatenate the pages of the chosen members; (merged pages, aborted merges).

    ``selection``: merged_id, order_no, doc_id, kind, readable. Positions come
    from summed member sizes, so no row is ranked inside a merged document. An
    unreadable member aborts its whole merge; an image contributes one page.
    """
    failed = selection.where("NOT readable").select("merged_id").distinct()
    good = selection.join(failed, "merged_id", "left_anti")
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    members = good.join(counts, "doc_id", "left").withColumn(
        "_n", F.when(F.col("kind") == "image", 1).otherwise(F.coalesce("_n", F.lit(0)))
    )
    placed = running_total(
        members, ["merged_id"], F.floor(F.col("order_no") / 4096), ["order_no"], "_n", "_before"
    )
    from_docs = placed.where("kind <> 'image'").join(pages.select("doc_id", "page_no"), "doc_id")
    from_images = placed.where("kind = 'image'").withColumn("page_no", F.lit(1))
    merged = from_docs.unionByName(from_images).selectExpr(
        "merged_id", "CAST(_before + page_no AS BIGINT) AS pos", "doc_id", "page_no", "kind = 'image' AS a4_sheet"
    )
    return merged, failed.withColumn("reason", F.lit("member could not be read"))


def handoff_summary(items: DataFrame) -> DataFrame:
    """Delivered of ready items; ready = has a result and was not sent before."""
    ready = items.where("has_result AND NOT sent")
    return ready.groupBy("owner").agg(
        F.count(F.lit(1)).alias("n_ready"), F.count_if(F.col("delivered")).alias("n_delivered")
    ).withColumn("complete", F.col("n_ready") == F.col("n_delivered"))


def selection_summary(files: DataFrame, selected: DataFrame) -> DataFrame:
    hit = selected.select("name").distinct().withColumn("_sel", F.lit(True))
    return files.join(hit, "name", "left").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("_sel")).alias("n_selected")
    )


def override_summary(overrides: DataFrame, global_mode: str) -> DataFrame:
    return overrides.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages")).withColumn(
        "ignored", F.lit(global_mode == "lossless")
    )


# ------------------------------------------------------------------ free names

_TAKEN_ALWAYS = -1


def _claims(arrivals: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """Names one stem's first arrivals get, lowest free suffix first.

    A suffix blocked at time t is still free for arrivals before t.
    """
    arrivals = arrivals.sort_values("seq")
    until = blocks.groupby("suffix")["blocked_at"].min().to_dict()
    used: set[int] = set()
    out = []
    for seq in arrivals["seq"]:
        hit = next(
            (s for s in range(1, NAME_SUFFIX_LAST + 1) if s not in used and until.get(s, seq + 1) > seq), None
        )
        if hit is not None:
            used.add(hit)
        out.append(hit)
    return pd.DataFrame({"stem": arrivals["stem"], "ext": arrivals["ext"], "seq": arrivals["seq"], "suffix": out}).astype(
        {"suffix": "Int64"}
    )


def _full(stem: Column, suffix: Column, ext: Column) -> Column:
    return F.when(suffix == 1, F.concat(stem, ext)).otherwise(F.concat(stem, F.lit("_"), suffix.cast("string"), ext))


def _split_suffix(df: DataFrame) -> DataFrame:
    """Adds the stem/suffix pair under which another stem may generate this name."""
    pat = r"^(.+)_([1-9][0-9]{0,2})$"
    num = F.regexp_extract("stem", pat, 2).try_cast("int")
    ok = num.between(2, NAME_SUFFIX_LAST)
    return df.withColumns({
        "up_stem": F.when(ok, F.regexp_extract("stem", pat, 1)),
        "up_suffix": F.when(ok, num),
    })


def allocate_names(incoming: DataFrame, existing: DataFrame, chunk: int = 65536) -> DataFrame:
    """Give every arrival (seq, name, now_ms) a name nothing else has.

    The k-th arrival of a stem takes the k-th free suffix, decided by ranks and
    joins. A stem can only take 498 names, so what is ranked per stem is
    bounded; arrivals beyond get a time stamp and, where that repeats, a number. Stems whose generated names meet
    another stem's own name ("a" making "a_2" while "a_2" arrives too) are
    settled from the shorter stem to the longer, at most 498 rows a group.
    """
    safe = incoming.withColumn("safe", F.expr(n.safe_raw_name("name", "now_ms"))).withColumns(
        {"stem": F.expr(n.stem("safe")), "ext": F.expr(n.ending("safe"))}
    )
    key = ["stem", "ext"]
    ranked = cut_lineage(ordered_index(safe, key, F.floor(F.col("seq") / chunk), ["seq"], "rank"), "arrivals")
    first = ranked.where(F.col("rank") <= NAME_SUFFIX_LAST).select("seq", *key, "rank")
    stems = _split_suffix(first.where("rank = 1").selectExpr("stem", "ext", "seq AS first_seq"))

    have = existing.select(F.col("name").alias("safe")).distinct().withColumns(
        {"stem": F.expr(n.stem("safe")), "ext": F.expr(n.ending("safe"))}
    )
    have = _split_suffix(have)
    blocks = (
        have.selectExpr("stem", "ext", "1 AS suffix")
        .unionByName(have.where("up_stem IS NOT NULL").selectExpr("up_stem AS stem", "ext", "up_suffix AS suffix"))
        .join(stems.select(*key), key, "left_semi")
        .withColumn("blocked_at", F.lit(_TAKEN_ALWAYS).cast("long"))
    )

    links = stems.where("up_stem IS NOT NULL").selectExpr(
        "up_stem AS stem", "ext", "up_suffix AS suffix", "first_seq AS blocked_at", "stem AS child"
    ).join(stems.select(*key), key, "left_semi")
    links = cut_lineage(links, "links")
    contested = links.select(*key).union(links.select("child", "ext")).distinct()

    calm = first.join(contested, key, "left_anti")
    sizes = calm.groupBy(*key).agg(F.max("rank").alias("k"))
    blocked = blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("b"))
    free = (
        sizes.join(blocked, key, "left")
        .selectExpr("stem", "ext", f"explode(sequence(1, CAST(least({NAME_SUFFIX_LAST}, k + coalesce(b, 0)) AS INT))) AS suffix")
        .join(blocks.select(*key, "suffix"), [*key, "suffix"], "left_anti")
        .withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy("suffix")))
    )
    settled = calm.join(free, [*key, "rank"], "left").select(*key, "seq", "suffix")

    # Contested stems, level by level: a stem's own name may already be taken by
    # the next shorter stem, whose claims are known by then.
    if not links.isEmpty():
        roots = contested.join(links.select(F.col("child").alias("stem"), "ext"), key, "left_anti")
        level, taken = roots, None
        while not level.isEmpty():
            rows = first.join(level, key, "left_semi").select(*key, "seq")
            walls = blocks.join(level, key, "left_semi").unionByName(
                links.select(*key, "suffix", "blocked_at").join(level, key, "left_semi")
            )
            if taken is not None:
                walls = walls.unionByName(taken.join(level, key, "left_semi"))
            done = cut_lineage(
                rows.groupBy(*key).cogroup(walls.groupBy(*key)).applyInPandas(
                    _claims, "stem string, ext string, seq long, suffix int"
                ),
                "claims",
            )
            settled = settled.unionByName(done)
            below = links.join(level, key, "left_semi").withColumnRenamed("seq", "_s")
            taken = below.alias("l").join(done.alias("d"), [*key, "suffix"]).selectExpr(
                "l.child AS stem", "ext", "1 AS suffix", "d.seq AS blocked_at"
            )
            level = below.select(F.col("child").alias("stem"), "ext").distinct()

    placed = cut_lineage(settled.where("suffix IS NOT NULL").select("seq", *key, "suffix"), "settled")
    late = ranked.select("seq", "now_ms", *key).join(placed.select("seq"), "seq", "left_anti")
    stamped = _stamped_names(late, placed, existing, chunk)
    named = ranked.select("seq", "name", *key).join(placed.select("seq", "suffix"), "seq", "left").join(stamped, "seq", "left")
    return named.select("seq", "name", F.coalesce(_full(F.col("stem"), F.col("suffix"), F.col("ext")), "stamped").alias("free_name"))


def _stamped_names(late: DataFrame, settled: DataFrame, existing: DataFrame, chunk: int) -> DataFrame:
    """Names for arrivals beyond the suffixes: stem and stamp, then stem, stamp and a running number.

    Arrivals of one stem and stamp take the free ones among them in order; what
    exists or was given out before is not free.
    """
    key = ["stem", "ext", "now_ms"]
    ranked = ordered_index(late, key, F.floor(F.col("seq") / chunk), ["seq"], "rank")
    taken = existing.select("name").unionByName(
        settled.select(_full(F.col("stem"), F.col("suffix"), F.col("ext")).alias("name"))
    ).distinct()
    parts = taken.select(
        "name", F.regexp_extract("name", r"^(.*)_(\d+)(?:-\d+)?(\.[^.]*)?$", 1).alias("stem"),
        F.regexp_extract("name", r"_(\d+)(?:-\d+)?(\.[^.]*)?$", 1).try_cast("long").alias("now_ms"),
    )
    walls = parts.groupBy("stem", "now_ms").agg(F.count(F.lit(1)).alias("walls"))
    wanted = ranked.groupBy(*key).agg(F.max("rank").alias("n")).join(walls, ["stem", "now_ms"], "left")
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + F.coalesce("walls", F.lit(0))))
    tail = F.when(F.col("number") > 1, F.concat(F.lit("-"), F.col("number").cast("string"))).otherwise("")
    names = wanted.select(*key, number.alias("number")).withColumn(
        "stamped", F.concat("stem", F.lit("_"), F.col("now_ms").cast("string"), tail, "ext")
    )
    free = names.join(taken.select(F.col("name").alias("stamped")), "stamped", "left_anti")
    free = ordered_index(free, key, F.floor(F.col("number") / chunk), ["number"], "rank")
    return ranked.join(free, [*key, "rank"]).select("seq", "stamped")
