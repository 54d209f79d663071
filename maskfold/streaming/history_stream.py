"""History ingest as a stream: landed JSON documents are validated and appended to the log."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.parsing import valid_uuid4
from ..sources.history import arrived
from ..sources.schemas import HISTORY


def stream_history(
    spark: SparkSession, landing: str, log: str, checkpoint: str, schema: str = HISTORY, files_per_batch: int = 1000
) -> StreamingQuery:
    """Append every landed prediction with a well-formed id to `log`, then stop when the landing is drained.

    The file sink commits each batch once, and the state is read with `history_current`, so a repeated
    document only adds a version. Rejected documents go to `<log>_rejected` with the raw text.
    """
    # times are read as text and cast: the cast keeps microseconds and takes every ISO-8601 form
    times = [c.split()[0] for c in schema.split(",") if c.strip().endswith(" timestamp")]
    raw = (
        spark.readStream.schema(f"{schema.replace(' timestamp', ' string')}, _corrupt_record string")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("maxFilesPerTrigger", files_per_batch)
        .json(landing)
    ).withColumns({c: F.col(c).try_cast("timestamp") for c in times})

    run: dict[str, str] = {}

    def query_id() -> str:
        # written by the engine before the first batch; a new checkpoint is a new query
        if "id" not in run:
            found = spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()
            run["id"] = found[0]
        return run["id"]

    def persist(batch: DataFrame, epoch: int) -> None:
        ok = batch.where(valid_uuid4(F.col("prediction_id")))
        good = ok.drop("_corrupt_record").withColumns(
            {"op": F.coalesce("op", F.lit("put")), "persisted_at_utc": F.coalesce("persisted_at_utc", F.current_timestamp())}
        )
        good = arrived(good)
        # one folder per query and batch: a batch that is run again after a failure replaces its own output,
        # and a new checkpoint on an old log adds to it
        place = f"query={query_id()}/batch={epoch}"
        good.write.mode("overwrite").parquet(f"{log}/{place}")
        batch.where(~valid_uuid4(F.col("prediction_id"))).write.mode("overwrite").json(f"{log}_rejected/{place}")

    return raw.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(persist).start()
