"""Signature/stamp library and the synchronised profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..fixed import PROFILE_LIMIT


def library_delete(lib: DataFrame, ids: DataFrame) -> DataFrame:
    return lib.join(ids.select("id"), "id", "left_anti")


def library_add(lib: DataFrame, new: DataFrame, now_ms: int, prefix: str = "sig", dated: bool = True) -> DataFrame:
    """Append entries; missing ids are made from the time and the entry, missing dates are now.

    An id is the whole hash of the entry and, for equal entries, their rank: a
    repeated task makes the same ids and no two entries share one.
    """
    own = [c for c in new.columns if c not in ("id", "created")]
    digest = F.sha2(F.to_json(F.struct(*own)), 256)
    rank = F.row_number().over(W.partitionBy("_digest").orderBy(*own))
    out = new.withColumn("_digest", F.when(F.col("id").isNull(), digest))
    made = out.where("id IS NULL").withColumn("id", F.concat_ws("-", F.lit(f"{prefix}{now_ms}"), F.substring("_digest", 1, 32), rank))
    out = out.where("id IS NOT NULL").unionByName(made).drop("_digest")
    if dated:
        out = out.withColumn("created", F.coalesce(F.nullif(F.col("created"), F.lit(0)), F.lit(now_ms).cast("long")))
    return lib.unionByName(out)


def profile_pull(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote values replace local ones unless the key changed here; keys only here stay.

    ``local``: owner, key, value, changed; ``remote``: owner, key, value.
    """
    l, r = local.alias("l"), remote.alias("r")
    j = l.join(r, (F.col("l.owner") == F.col("r.owner")) & (F.col("l.key") == F.col("r.key")), "full_outer")
    take = F.expr("r.key IS NOT NULL AND NOT coalesce(l.changed, false)")
    return j.select(
        F.coalesce("l.owner", "r.owner").alias("owner"), F.coalesce("l.key", "r.key").alias("key"),
        F.when(take, F.col("r.value")).otherwise(F.col("l.value")).alias("value"), take.alias("pulled"),
    )


def profile_too_large(signatures: DataFrame, stamps: DataFrame, settings: DataFrame) -> DataFrame:
    """owner and bytes of the owners whose entries exceed the size of a profile."""
    def sizes(table: DataFrame, *columns: str) -> DataFrame:
        return table.select("owner", sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0)).cast("long").alias("n"))

    own = sizes(signatures, "id", "name").unionByName(sizes(stamps, "id", "title")).unionByName(sizes(settings, "key", "value"))
    return own.groupBy("owner").agg(F.sum("n").alias("bytes")).where(f"bytes > {PROFILE_LIMIT}")


def profile_export(
    signatures: DataFrame, stamps: DataFrame, settings: DataFrame, app: str, exported: str
) -> DataFrame:
    """One JSON document per owner with signatures, stamps and settings.

    The three lists are gathered per owner. Owners whose entries alone exceed the
    size a profile may have are left out before anything is gathered; see
    ``profile_too_large``.
    """
    large = profile_too_large(signatures, stamps, settings).select("owner")
    signatures, stamps, settings = (t.join(large, "owner", "left_anti") for t in (signatures, stamps, settings))
    sig = signatures.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("id", "name"))).alias("signatures"))
    st = stamps.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("id", "title"))).alias("stamps"))
    se = settings.groupBy("owner").agg(F.expr("map_from_entries(sort_array(array_agg(struct(key, value))))").alias("settings"))
    none = "CAST(array() AS ARRAY<STRUCT<id: STRING, {0}: STRING>>)"
    j = sig.join(st, "owner", "full_outer").join(se, "owner", "full_outer").selectExpr(
        "owner", f"coalesce(signatures, {none.format('name')}) AS signatures",
        f"coalesce(stamps, {none.format('title')}) AS stamps",
        "coalesce(settings, CAST(map() AS MAP<STRING, STRING>)) AS settings",
    )
    return j.select(
        "owner",
        F.to_json(F.struct(
            F.lit(app).alias("app"), F.lit(1).alias("version"), F.lit(exported).alias("exported"),
            "signatures", "stamps", "settings")).alias("document"),
    )


def profile_replace(stored: DataFrame, imported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles after an import, signatures taken over by owner).

    ``stored``: owner, key, value as JSON text. ``imported``: parsed exports with their owner, one an owner, as
    ``profile_parse`` gives them. An accepted one replaces all three keys of its owner, whatever was
    stored; a refused one changes nothing, and neither do owners without one.
    """
    good = imported.where("reason IS NULL")
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("signatures", "stamps", "settings")])
    new = good.select("owner", F.explode(entries).alias("_e")).select("owner", "_e.key", "_e.value")
    kept = stored.join(good.select("owner"), "owner", "left_anti").select("owner", "key", "value")
    return kept.unionByName(new), good.select("owner", "n_signatures")
