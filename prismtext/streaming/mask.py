"""Masking a stream of texts: the same columns as on tables; pseudonyms by hash need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from prismtext.operators.mask import mask_text, pseudonym


def mask_stream(stream: DataFrame, text: str, out: str, checkpoint: str, salt: str = "", once: bool = False) -> StreamingQuery:
    """Writes the stream with masked and findings as Parquet; ``once`` stops after what is there now."""
    writer = mask_text(stream, text, name=pseudonym(salt)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
