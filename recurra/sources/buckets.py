"""Tables that are saved in buckets by their keys, so that later joins and groupings by these shuffle nothing."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from recurra.settings import note_name


def _quoted(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Save a dataset as Parquet in ``buckets`` buckets by a hash of the keys, one sorted file per bucket.

    Tables that are to be joined need the same keys, of the same types, and the same number of buckets. Choose it for
    files of some hundred megabytes. All rows of a key are in one file: save a table in which few keys hold most rows
    with ``write_table`` and join it by ``join_per_key``. How the table is bucketed is saved beside it.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.format("parquet").option("path", f"{path}/rows").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    spark.createDataFrame([(list(keys), buckets)], "keys array<string>, buckets int").coalesce(1).write.json(f"{path}/spec")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_bucketed`` saved, as a table of this session whose buckets Spark knows (``remove_tables`` forgets it)."""
    spec = spark.read.schema("keys array<string>, buckets int").json(f"{path}/spec").first()
    name, keys = f"bucketed_{uuid4().hex}", _quoted(spec["keys"])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/rows").schema.fields)
    place = f"{path}/rows".replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
        f"INTO {spec['buckets']} BUCKETS LOCATION '{place}'"
    )
    note_name(spark, name)
    return spark.table(name)
