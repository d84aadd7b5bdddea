"""Vector code compression: product codes by Lloyd's method with resident members.

Every vector is cut into PARTS equal parts. A part belongs to an owner, named by
(position, entry, salt), and stays with it: the members are a bucketed table of arrivals and
departures, and an owner's members are its arrivals without its departures, found bucket by bucket without an
exchange. A round sums the members where they lie, merges the sums of an entry's salts, and
lets every owner compare its members with the new entries. Only parts whose entry changes are
written: a departure for the old owner and an arrival, with the part, for the new one. They alone
pass through the next shuffle, and there are fewer of them each round. The salt spreads an entry over as
many owners as there are buckets, so that an entry that a third of all parts share is no hot key.

The codebook (positions x entries x width) is the only thing that reaches the driver; its size is
fixed by the parameters. Integer distances are exact: a matrix product in doubles where all sums stay
below 2^53, else 64-bit integers. Each round is a committed append to a table in the shared folder; a lost
executor costs the work of its running tasks.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are
dropped. A vector whose length is not that of the first one (of the least vec_id), or is no multiple of PARTS,
cannot be coded: it stays, with null code and error, and counts in no sum. Null vec_ids come last; rows that
repeat a vec_id are coded each, and as first entries in the order of their components. With fewer than ENTRIES
rows there are as many entries as rows. An empty table gives no rows. Components are held within what 64-bit
sums of squares can carry (for 16 components a part: 2^28, or 262144.0 before scaling). Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagelake.session import cut_lineage, scratch_path
from .words import bounded_batches

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts that a bucket holds, about.
BUCKET_ROWS = 1_000_000
_OWNER = ["position", "entry", "salt"]


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v, the floored components, of rows that are whole and finite."""
    sound = "embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
    most = 1 << 62
    v = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(float(-most)), F.least(F.lit(float(most)), x.cast("double") * scale))))
    return vectors.where(sound).select("vec_id", "label", v.alias("v"))


def bound_of(width: int) -> int:
    """Largest component so that ``width`` squared differences sum up below 2^63."""
    return 1 << ((62 - max(1, width - 1).bit_length()) // 2 - 1)


class Codebook:
    """Entries of every position: an array of (position, entry, component)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    def nearest(self, position: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least index among the nearest entries, and the squared distance, of each part."""
        entry, error = np.zeros(len(parts), np.int32), np.zeros(len(parts), np.int64)
        for p in np.unique(position):
            at = np.flatnonzero(position == p)
            for some in np.array_split(at, -(-len(at) // 4096)):
                x, c = parts[some], self.entries[p]
                most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
                if 4 * x.shape[1] * most * most < 1 << 52:  # every sum is a whole number that a double holds
                    y = c.astype(np.float64)
                    entry[some] = np.argmin((y * y).sum(axis=1) - 2.0 * (x.astype(np.float64) @ y.T), axis=1)
                else:
                    far = np.stack([((x - e) ** 2).sum(axis=1) for e in c], axis=1)
                    entry[some] = np.argmin(far, axis=1)
                error[some] = ((x - c[entry[some]]) ** 2).sum(axis=1)
        return entry, error

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _owned(entry: Column, buckets: int) -> list[Column]:
    return [entry.alias("entry"), F.pmod(F.xxhash64("row", "position"), F.lit(buckets)).cast("int").alias("salt")]


def _assigned(parts: DataFrame, book: Codebook, *keep: str) -> DataFrame:
    """``keep``, position and part, with ``new``, the nearest entry, and ``error``."""
    bounded_batches(parts.sparkSession)
    kinds, width = dict(parts.dtypes), book.entries.shape[2]
    columns = [*keep, "position", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("part").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, width)
            entry, error = book.nearest(batch.column("position").to_numpy(), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entry), pa.array(error)], names=[*columns, "new", "error"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    return parts.select(*columns).mapInArrow(run, f"{schema}, new int, error long")


class Residents:
    """The bucketed table of arrivals and departures, while the block lasts.

    Meanwhile joins may use a partitioning by some of their keys, as the owner is only a part of
    the key by which an arrival meets its departure. Afterwards the table's name is gone; its files stay in the shared folder.
    """

    _SETTING = "spark.sql.requireAllClusterKeysForCoPartition"

    def __init__(self, spark, width: int, buckets: int):
        self.spark, self.buckets, self.width = spark, buckets, width
        self.name, self.path = f"residents_{uuid.uuid4().hex[:12]}", scratch_path(spark, "residents")

    def __enter__(self) -> "Residents":
        self.before = self.spark.conf.get(self._SETTING)
        self.spark.conf.set(self._SETTING, "false")
        return self

    def __exit__(self, *error) -> None:
        self.spark.conf.set(self._SETTING, self.before)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, moves: DataFrame) -> None:
        """Append rows of row, position, entry, salt, round, arrives and part; the one shuffle of a round."""
        dealt = moves.select("row", *_OWNER, "round", "arrives", "part").repartition(self.buckets, *_OWNER)
        dealt.write.mode("append").bucketBy(self.buckets, *_OWNER).option("path", self.path).saveAsTable(self.name)

    def members(self) -> DataFrame:
        """Arrivals that have not departed; owners keep what they have, so there is no exchange."""
        moves = self.spark.table(self.name)
        key = [*_OWNER, "row", "round"]
        gone = moves.where("NOT arrives").select(*key).hint("shuffle_hash")
        return moves.where("arrives").join(gone, key, "left_anti").select(*key, "part")

    def updated(self, book: Codebook) -> Codebook:
        """Every entry as the floored mean of its members; entries without members stay."""
        of_salts = self.members().groupBy(*_OWNER).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("part")[i].cast("long")).alias(f"s{i}") for i in range(self.width)])
        sums = [f"sum(s{i})" for i in range(self.width)]
        mean = ", ".join(f"CAST(({s} - pmod({s}, sum(n))) div sum(n) AS BIGINT)" for s in sums)
        entries = book.entries.copy()
        for r in of_salts.groupBy("position", "entry").agg(F.expr(f"array({mean})").alias("mean")).collect():  # at most PARTS x ENTRIES rows
            entries[r.position, r.entry] = r.mean
        return Codebook(entries)


def first_book(whole: DataFrame, parts: int, entries: int) -> Codebook:
    """The parts of the ``entries`` least vec_ids."""
    seeds = whole.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    table = np.array([r.v for r in seeds], np.int64).reshape(len(seeds), parts, -1)
    return Codebook(np.ascontiguousarray(table.transpose(1, 0, 2)))


def _moves(changed: DataFrame, turn: int, buckets: int) -> DataFrame:
    """Two rows for every part that changes its entry: it departs from where it came to in ``round``, and arrives elsewhere."""
    gone = F.struct(F.col("entry").alias("e"), F.col("round").alias("r"), F.lit(False).alias("arrives"), F.lit(None).cast("array<int>").alias("p"))
    come = F.struct(F.col("new").alias("e"), F.lit(turn).alias("r"), F.lit(True).alias("arrives"), F.col("part").alias("p"))
    both = changed.select("row", "position", F.explode(F.array(gone, come)).alias("m"))
    return both.select("row", "position", *_owned(F.col("m.e"), buckets), F.col("m.r").alias("round"), "m.arrives", F.col("m.p").alias("part"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of vec_id, label and embedding.

    A code is an entry's index in each part, two hex digits each (more than 256 entries: more digits).
    """
    spark = vectors.sparkSession
    rows = cut_lineage(integers(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v").alias("n")).first()
    length = first.n if first and first.n % parts == 0 else 0
    width = length // parts
    whole = rows.where(F.size("v") == length) if width else rows.where("false")
    most = bound_of(width)
    whole = whole.withColumn("v", F.transform("v", lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), x)).cast("int")))
    n = whole.count()
    if not n:
        return rows.select("vec_id", "label", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    book = first_book(whole, parts, entries)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * parts // BUCKET_ROWS))
    with Residents(spark, width, buckets) as home:
        cut = F.posexplode(F.array(*[F.slice("v", p * width + 1, width) for p in range(parts)])).alias("position", "part")
        start = _assigned(whole.select("row", cut), book, "row")
        home.add(start.select("row", "position", *_owned(F.col("new"), buckets), F.lit(0).alias("round"), F.lit(True).alias("arrives"), "part"))
        for turn in range(1, rounds + 1):
            book = home.updated(book)
            home.add(_moves(_assigned(home.members(), book, "row", "entry", "round").where("new != entry"), turn, buckets))
        coded = _assigned(home.members(), book, "row", "entry").select("row", "position", "new", "error")
        digits = max(2, len(f"{entries - 1:x}"))
        code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "new"))), lambda s: F.lpad(F.lower(F.hex(s["new"])), digits, "0")), "")
        codes = coded.groupBy("row").agg(code.alias("code"), F.sum("error").alias("error"))
        result = cut_lineage(rows.select("row", "vec_id", "label").join(codes, "row", "left").drop("row"), "codes")
    totals = result.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return result.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "label", "code", "error", F.when(F.col("code").isNotNull(), F.col("label_error")).alias("label_error"),
        F.when(F.col("code").isNotNull(), F.lit(book.digest())).alias("codebooks_sha256"))
