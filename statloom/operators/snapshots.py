"""Changes between consecutive full deliveries of a table, by gaps and islands over key and row hash.

Defined cases
- Of several rows of one key in one delivery the one with the latest time counts (null times are the oldest; of equal
  times the larger hash, so that the result does not depend on the order of rows). Repeated rows count once.
- Deliveries of a source are the snapshot numbers it has rows for; its first yields nothing. Null sources and null keys
  are values like any other.
- Any difference of a stored character in a compared column is a change; null differs from the empty string.
- An empty table yields no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_hash(columns: list[str]):
    """128 bits over ``columns``; each value goes in with its length, so that no two rows read alike."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat(*parts)))


def validity_intervals(df: DataFrame, source: str, snapshot: str, key: str, time: str, compared: list[str]) -> DataFrame:
    """Islands of deliveries over which a key kept one row hash.

    Rows of one document in one delivery are aggregated before they are shuffled, so that one that is repeated very often
    does not gather; what is left is shuffled once more by (source, key) for both windows. Both carry hashes, not texts.
    """
    # the table's own names are left behind here, whatever they are
    rows = df.select(F.col(source).alias("source"), F.col(snapshot).alias("snapshot_no"), F.col(key).alias("key"), F.col(time).alias("at"), row_hash(compared).alias("hash"))
    by_source = Window.partitionBy("d_source").orderBy("d_no")
    deliveries = (
        df.select(F.col(source).alias("d_source"), F.col(snapshot).alias("d_no"))
        .distinct()
        .select("d_source", "d_no", F.row_number().over(by_source).alias("delivery"), F.lead("d_no").over(by_source).alias("next_no"))
    )
    current = (
        rows.groupBy("source", "key", "snapshot_no")
        .agg(F.max(F.struct("at", "hash"))["hash"].alias("hash"))
        .join(deliveries, F.col("source").eqNullSafe(F.col("d_source")) & F.col("snapshot_no").eqNullSafe(F.col("d_no")))
        .select("source", "key", "snapshot_no", "hash", "delivery", "next_no")
    )
    w = Window.partitionBy("source", "key").orderBy("delivery")
    kept = F.lag("delivery").over(w).eqNullSafe(F.col("delivery") - 1) & F.lag("hash").over(w).eqNullSafe(F.col("hash"))
    return (
        current.withColumn("starts", F.when(kept, 0).otherwise(1))
        .withColumn("island", F.sum("starts").over(w))
        .groupBy("source", "key", "island")
        .agg(
            F.min("delivery").alias("first_delivery"),
            F.max("delivery").alias("last_delivery"),
            F.min("snapshot_no").alias("valid_from"),
            F.max("snapshot_no").alias("valid_to"),
            F.max(F.struct("delivery", "next_no"))["next_no"].alias("next_no"),
        )
    )


def snapshot_changes(df: DataFrame, source: str, snapshot: str, key: str, time: str, compared: list[str]) -> DataFrame:
    """(source, snapshot_no, key, change_kind): starts, ends and adjacencies of the validity intervals.

    A start next to the end before it is ``changed``, any other start after the first delivery ``added``; an end before
    the source's last delivery with no interval next to it is ``removed`` in the delivery that follows.
    """
    w = Window.partitionBy("source", "key").orderBy("first_delivery")
    intervals = validity_intervals(df, source, snapshot, key, time, compared)
    events = intervals.select(
        "source",
        "key",
        F.array(
            F.when(
                F.col("first_delivery") > 1,
                F.struct(
                    F.col("valid_from").alias("snapshot_no"),
                    F.when(F.lag("last_delivery").over(w) == F.col("first_delivery") - 1, "changed").otherwise("added").alias("change_kind"),
                ),
            ),
            F.when(
                F.col("next_no").isNotNull() & ~F.coalesce(F.lead("first_delivery").over(w) == F.col("last_delivery") + 1, F.lit(False)),
                F.struct(F.col("next_no").alias("snapshot_no"), F.lit("removed").alias("change_kind")),
            ),
        ).alias("events"),
    )
    return events.select("source", "key", F.inline(F.filter("events", lambda x: x.isNotNull())))
