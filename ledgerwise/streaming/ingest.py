"""Incremental statement load: only files not seen before, then the keyed upsert and the classification sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerwise.contracts import MOVEMENTS
from ledgerwise.plans.workflows import COUNTERS, load_closed
from ledgerwise.shared import exists, job_folder, staged
from ledgerwise.sources.files import accepted, file_name_of
from ledgerwise.sources.statements import raw_reader, readable, refused, typed_movements, with_files
from ledgerwise.sources.store import unique_rows, upsert_unique


REJECTS = T.StructType(
    [
        *MOVEMENTS.fields,
        *(T.StructField(c, T.StringType()) for c in ("reason", "raw", "kind")),
        T.StructField("batch_id", T.LongType()),
    ]
)


def report_of(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}-report"


def _of_batch(report: str, name: str, batch_id: int) -> str:
    return f"{report}/{name}/batch_id={batch_id}"


def stream_rejects(spark: SparkSession, report: str) -> DataFrame:
    """Lines that the stream could not load, with the reason, their text and the number of their batch."""
    path = f"{report}/rejects"
    return spark.read.schema(REJECTS).parquet(path) if exists(spark, path) else spark.createDataFrame([], REJECTS)


def stream_counters(spark: SparkSession, report: str) -> DataFrame:
    """Keys inserted, updated and left untouched, and lines rejected, for each batch and kind (in ``table``)."""
    schema, path = f"{COUNTERS}, batch_id long", f"{report}/counters"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def _files(batch: DataFrame) -> DataFrame:
    """Files of one micro-batch, as a listing would give them."""
    files = batch.select("file_path", "file_modification_time").distinct()
    return files.withColumns(
        {
            "raw_path": F.url_decode(F.replace(F.col("file_path"), F.lit("+"), F.lit("%2B"))),
            "file_name": file_name_of(F.col("file_path")),
        }
    )


def ingest_statements(
    spark: SparkSession,
    folder: str,
    accounts: DataFrame,
    tables: dict[str, str],
    checkpoint: str,
    run_ts,
    concepts: dict[str, str] | None = None,
    max_files: int | None = None,
    report: str | None = None,
) -> StreamingQuery:
    """Load every unseen closed statement below ``folder`` and stop.

    ``tables`` and ``concepts`` map kind to the path of its movement and classification table.  A batch that runs
    again after a failure writes the same keys with the same values, so the load is exactly-once in effect.

    Lines that cannot be loaded go to ``report`` (default: beside the checkpoint), under the number of their batch and
    before anything else is written: a batch that runs again replaces its own.  ``stream_rejects`` reads them,
    ``stream_counters`` what each batch brought.
    """
    report = report or report_of(checkpoint)

    def load(batch: DataFrame, batch_id: int) -> None:
        with job_folder(spark):
            load_staged(batch, batch_id)

    def load_staged(batch: DataFrame, batch_id: int) -> None:
        # the batch is read twice, for its files and for its rows; read back in the caller's session, the load plans
        # adaptively like any batch job
        rows = staged(batch, f"batch-{batch_id}", session=spark)
        manifest = staged(accepted(_files(rows), accounts), f"manifest-{batch_id}")
        tagged = with_files(rows.drop("file_modification_time"), manifest)
        movements = staged(typed_movements(tagged, "cerrado"), f"movements-{batch_id}", by="kind")
        rejects, counters = _of_batch(report, "rejects", batch_id), []
        refused(movements).write.mode("overwrite").parquet(rejects)
        away = dict(spark.read.parquet(rejects).groupBy("kind").count().collect())
        for kind, path in tables.items():
            of_kind = unique_rows(readable(movements.filter(F.col("kind") == kind)).drop("kind"))
            if concepts and kind in concepts:
                found = load_closed(of_kind, path, concepts[kind], accounts, kind, run_ts)
            else:
                found = upsert_unique(of_kind, path)
            counters.append((kind, found["inserted"], found["updated"], found["untouched"], away.get(kind, 0)))
        counted = spark.createDataFrame(counters, COUNTERS).coalesce(1)
        counted.write.mode("overwrite").parquet(_of_batch(report, "counters", batch_id))

    reader = raw_reader(spark.readStream.format("csv"))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    source = reader.load(folder).select(
        "*",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("file_modification_time"),
    )
    return (
        source.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
