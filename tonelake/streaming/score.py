"""Scoring an unbounded table of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import predict_with_labels, score_request_arrays
from ..operators.training import SentimentModel
from ..operators.validation import accepted, rejected, validate_text


def score_stream(
    requests: DataFrame,
    model: SentimentModel,
    output_path: str,
    checkpoint: str,
    text_col: str = "text",
    once: bool = True,
    interval: str = "10 seconds",
    partitions: int | None = None,
    texts_col: str | None = None,
    batch_col: str = "batch_id",
) -> StreamingQuery:
    """Write scored rows and rejects of a request stream.

    Stateless. Each micro-batch overwrites its own folder, so a batch that is
    run again after a failure leaves the same output. ``once`` stops when the
    rows present at the start are done. ``partitions`` spreads the rows of a
    source that arrives in few files. With ``texts_col`` a row is a request of
    several texts, accepted or refused as a whole.
    """
    if partitions:
        requests = requests.repartition(partitions)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if texts_col:
                scored, refused, _ = score_request_arrays(
                    model, batch, batch_col, texts_col
                )
            else:
                checked = validate_text(batch, text_col)
                scored = predict_with_labels(model, accepted(checked), text_col)
                refused = rejected(checked)
            scored.write.mode("overwrite").parquet(
                f"{output_path}/scored/batch={batch_id}"
            )
            refused.write.mode("overwrite").parquet(
                f"{output_path}/rejects/batch={batch_id}"
            )
        finally:
            batch.unpersist()

    writer = requests.writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint
    )
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()
