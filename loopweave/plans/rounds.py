"""What iterative jobs share: a table of edges laid out once, and stored tables of rounds.

Every round of a product over a graph needs the edges at the vector's keys. ``bucketed`` writes the
edges once, hashed and sorted by one end, so that from then on only vectors are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from loopweave.session import drop_path, drop_scratch, scratch_path, scratch_table

def bucketed(edges: DataFrame, *by: str, dealt: bool = False, buckets: int | None = None) -> DataFrame:
    """``edges`` as a stored table bucketed and sorted by ``by``; one shuffle, whatever is joined later.

    The buckets are as many as the session has shuffle partitions, if ``buckets`` does not say: joins on
    ``by`` then shuffle the other side only. ``dealt`` says that the rows lie in that layout already, as those of a bucketed
    table do after joins on ``by``; nothing is shuffled then.
    """
    spark = edges.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = scratch_table(spark, "edges")
    rows = edges if dealt else edges.repartition(buckets, *by)
    rows.write.bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.scratch = name, path
    return out


def drop_bucketed(table: DataFrame) -> None:
    """Remove a table of ``bucketed`` that is read no more."""
    drop_scratch(table.sparkSession, *table.scratch)


class Rounds:
    """Stores the table of every round in the shared folder and reads it back.

    Lineage ends there, so plans don't grow, lost executors cost one round, and the size of the stored
    table is known: a small vector is broadcast to the edges, a large one is shuffled to their buckets.
    """

    def keep(self, df: DataFrame) -> DataFrame:
        path = scratch_path(df.sparkSession, "round")
        df.write.parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        out.kept = path
        return out


def drop_kept(*tables: DataFrame) -> None:
    """Remove tables of ``Rounds`` that are read no more."""
    for table in tables:
        drop_path(table.sparkSession, table.kept)
