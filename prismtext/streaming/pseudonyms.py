"""Pseudonyms in a stream: names that a store keeps, the same for a value in every batch and after every restart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from prismtext.operators.mapping import mask_stored
from prismtext.operators.rules import Rule
from prismtext.storage import committed, write_batch


def pseudonym_batch(df: DataFrame, number: int, text: str, store: str, out: str, rules: Sequence[Rule] | None = None, key: str = "doc_id") -> None:
    """One micro-batch: learn its new values, then write its masked rows. Either step is left out if it was ended before."""
    batch = f"{number:012d}"
    if batch not in committed(df.sparkSession, out):
        write_batch(mask_stored(df, text, store, batch, rules, key), out, batch)


def mask_with_store(stream: DataFrame, text: str, store: str, out: str, checkpoint: str, rules: Sequence[Rule] | None = None, key: str = "doc_id", once: bool = True) -> StreamingQuery:
    """Mask a stream under stored names into batches below ``out`` (see ``storage.read_batches``).

    Spark gives a micro-batch that was broken off its old number and rows again,
    and both tables take a number once, so what comes out is what the batches
    give one after the other, wherever the stream was stopped.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: pseudonym_batch(df, n, text, store, out, rules, key))
    return (writer.trigger(availableNow=True) if once else writer).start()
