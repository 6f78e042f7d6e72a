"""Partitioned results in Parquet and in the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MAX_RECORDS_PER_FILE = 5_000_000


def write_partition(df: DataFrame, root: str, fixed: dict[str, str],
                    split_by: list[str] | None = None) -> str:
    """Replace one partition, ``root/a=1/b=2``, optionally split further by columns.

    Running it again leaves the same result.  Rows are rebalanced on the split columns first, which
    gathers small values and cuts a huge one, so neither many tiny files nor one huge task appear.
    """
    path = "/".join([root, *[f"{k}={v}" for k, v in fixed.items()]])
    rows = df.drop(*fixed)
    writer = rows.hint("rebalance", *(split_by or [])) if split_by else rows.hint("rebalance")
    sink = (writer.write.mode("overwrite").option("partitionOverwriteMode", "static")
            .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE))
    if split_by:
        sink = sink.partitionBy(*split_by)
    sink.parquet(path)
    return path


def write_partitions(df: DataFrame, root: str, split_by: list[str],
                     sort_by: list[str] | None = None) -> None:
    """Replace every partition that occurs in ``df`` and leave the others alone.

    ``sort_by`` is for many small partitions: each is one file, sorted so that a reader who wants some of
    its values skips the rest, and the partitions are dealt to all tasks, where rebalancing would join
    them into a few that create one file after the other.
    """
    rows = df.hint("rebalance", *split_by)
    if sort_by:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = df.repartition(tasks, *split_by).sortWithinPartitions(*split_by, *sort_by)
    (rows.write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
     .partitionBy(*split_by).parquet(root))


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int,
                   path: str | None = None) -> None:
    """Store a table hashed and sorted by its join key.

    Shipments and invoices stored with the same number of buckets by ``shipment_id`` meet without a
    shuffle in the match join.  Not for a key of which one value holds a large share of the rows:
    without a shuffle adaptive execution has nothing to cut.
    """
    sink = (df.repartition(buckets, key).write.mode("overwrite").format("parquet")
            .bucketBy(buckets, key).sortBy(key))
    if path is not None:
        sink = sink.option("path", path)
    sink.saveAsTable(table)


def written_partitions(spark: SparkSession, path: str, split_by: list[str]) -> list[dict[str, str]]:
    """The partitions found below ``path``: one listing per level, of that folder only."""
    if not split_by:
        return [{}]
    escaping = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = []
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{split_by[0]}="):
            value = escaping.unescapePathName(name.split("=", 1)[1])
            found += [{split_by[0]: value} | rest for rest in written_partitions(
                spark, f"{path}/{name}", split_by[1:])]
    return found


def register_table(spark: SparkSession, name: str, root: str, schema: str,
                   split_by: list[str], only: dict[str, str] | None = None) -> None:
    """Declare a partitioned Parquet folder in the catalog and make its partitions known.

    The partition columns are the last ones of ``schema``.  ``only`` names the values of the first of
    them that were just written: partitions below are added, those that a rerun no longer wrote are
    dropped, and no other partition is looked at.  Without it the whole folder is compared with the
    catalog.  Safe to repeat.
    """
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet "
              f"PARTITIONED BY ({', '.join(split_by)}) LOCATION '{root}'")
    if only is None:
        spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
        spark.catalog.refreshTable(name)
        return

    def spec(partition: dict[str, str]) -> str:
        return ", ".join(f"{c} = {_quoted(partition[c])}" for c in split_by if c in partition)

    path = "/".join([root, *(f"{c}={v}" for c, v in only.items())])
    written = [only | rest for rest in written_partitions(spark, path, split_by[len(only):])]
    for begin in range(0, len(written), 100):
        specs = " ".join(f"PARTITION ({spec(p)})" for p in written[begin:begin + 100])
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {specs}")
    if len(only) < len(split_by):
        escaping = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        listed = spark.sql(f"SHOW PARTITIONS {name} PARTITION ({spec(only)})").collect()
        for row in listed:
            known = {c: escaping.unescapePathName(v) for c, v in (
                part.split("=", 1) for part in row[0].split("/"))}
            if known not in written:
                spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({spec(known)})")
    spark.catalog.refreshTable(name)


def _quoted(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"
