"""Cleaning, labelling and scoring of text streams.

Cleaning and labels are stateless, so the batch operators apply to a stream as they are. Scoring
sums over a document's terms; done per micro-batch it needs no state, because a document arrives
whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators.cleaning import clean_rows
from lexmill.operators.linear import TfidfModel, score


def cleaned_stream(rows: DataFrame, **switches) -> DataFrame:
    return clean_rows(rows, **switches)


def score_stream(
    rows: DataFrame, model: TfidfModel, path: str, checkpoint: str, keep: tuple[str, ...] = (), key: str = "doc_id"
) -> StreamingQuery:
    """Score every row that is available now and write the results to ``path``.

    Each micro-batch replaces the folder named after it, so a batch that is repeated after a
    failure does not count twice.
    """
    model.require_fitted()

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = score(clean_rows(batch), model, keep, key=key, clean=False)
        scored.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
