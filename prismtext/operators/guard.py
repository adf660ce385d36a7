"""Guards: stages that each call a row safe or not, and remote services that judge or mask payloads."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismtext.operators.mask import free
from prismtext.operators.retrieval import chunks
from prismtext.storage import stored

Transport = Callable[[str, dict], dict]


def guard(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """``df`` with safe and blocked_by: the first stage that is not true for a row blocks it; a null verdict is unsafe."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in stages]
    blocked = F.coalesce(*failed) if failed else F.lit(None).cast("string")
    return df.withColumn("blocked_by", blocked).withColumn("safe", F.col("blocked_by").isNull())


def http_transport(timeout: float = 60.0) -> Transport:
    """POST of JSON by the standard library; any status but 2xx raises."""

    def post(url: str, payload: dict) -> dict:
        from urllib.request import Request, urlopen

        with urlopen(Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"}), timeout=timeout) as answer:
            return json.loads(answer.read())

    return post


def address(host: str, path: str) -> str:
    return f"{host.rstrip('/')}/{path.lstrip('/')}"


def ask(df: DataFrame, payload: str, url: str, make: Callable[[], Transport] = http_transport, tries: int = 1) -> DataFrame:
    """``df`` with answer (JSON text) and error: the payload column (JSON text) posted to a service; each task sets up one transport.

    A row whose call fails is tried again, ``tries`` times in all, and then fails alone.
    """
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        post = make()
        for batch in batches:
            answers, errors = [], []
            for text in batch[payload]:
                answer, error = None, "no payload"
                for _ in range(tries if text is not None else 0):
                    try:
                        answer, error = json.dumps(post(url, json.loads(text))), None
                        break
                    except Exception as problem:  # a service may fail in any way; the row says so
                        error = f"{type(problem).__name__}: {problem}"
                answers.append(answer)
                errors.append(error)
            yield batch[columns].assign(answer=pd.Series(answers, index=batch.index, dtype=object), error=pd.Series(errors, index=batch.index, dtype=object))

    fields = df.schema.simpleString()[len("struct<") : -1]
    return df.mapInPandas(run, f"{fields},answer:string,error:string")


def ask_once(df: DataFrame, payload: str, url: str, make: Callable[[], Transport] = http_transport, tries: int = 3) -> DataFrame:
    """``df`` with answer and error as ``ask`` gives them, but each distinct payload is asked once, whatever rows hold it.

    The answers are written before they are joined back under the payload's
    hash, so nothing asks again when a later step is repeated. A null payload is not asked.
    """
    if {"answer", "error"} & {c.lower() for c in df.columns}:
        raise ValueError("the table has a column called answer or error")
    mark, held = free([*df.columns, "answer", "error"], "mark", "payload")
    rows = df.withColumn(mark, F.sha2(payload, 256))
    distinct = rows.where(F.col(payload).isNotNull()).select(mark, F.col(payload).alias(held)).groupBy(mark).agg(F.min(held).alias(held))
    answers = stored(ask(distinct, held, url, make, tries).select(mark, "answer", "error"), "answers")
    error = F.when(F.col(payload).isNull(), "no payload").otherwise(F.col("error"))
    return rows.join(answers, mark, "left").select(*df.columns, "answer", error.alias("error"))


@dataclass(frozen=True)
class Stage:
    """A remote judge: its name, its address, and where in its answer the verdict and the message stand."""

    name: str
    url: str
    verdict: str = "$.results.safe"
    message: str = "$.message"


def remote_guards(df: DataFrame, payload: str, stages: Sequence[Stage], make: Callable[[], Transport] = http_transport, tries: int = 3) -> DataFrame:
    """``df`` with safe, blocked_by and message: judges one after the other, each asked only about payloads that all before it called safe.

    The first judge that does not call a payload safe blocks it, and its message
    is kept; a judge that fails blocks too, with the error as the message. Equal
    payloads are asked about once. A null payload is blocked by the first judge; without judges all is safe.
    """
    if {"safe", "blocked_by", "message"} & {c.lower() for c in df.columns}:
        raise ValueError("the table has a column called safe, blocked_by or message")
    mark, held = free(df.columns, "mark", "payload")
    rows = df.withColumn(mark, F.coalesce(F.sha2(payload, 256), F.lit("")))
    left = rows.where(F.col(payload).isNotNull()).groupBy(mark).agg(F.min(payload).alias(held))
    left = stored(left, "payloads") if len(stages) > 1 else left
    blocked: DataFrame | None = None
    for stage in stages:
        safe = F.coalesce(F.get_json_object("answer", stage.verdict) == "true", F.lit(False))
        asked = ask(left, held, stage.url, make, tries).select(mark, safe.alias("safe"), F.coalesce(F.get_json_object("answer", stage.message), F.col("error")).alias("message"))
        judged = stored(asked, "judged")
        own = judged.where("not safe").select(mark, F.lit(stage.name).alias("blocked_by"), "message")
        none = df.sparkSession.createDataFrame([("", stage.name, "no payload")], own.schema)
        blocked = own.unionByName(none) if blocked is None else blocked.unionByName(own)
        left = left.join(judged.where("safe").select(mark), mark, "left_semi")
    if blocked is None:
        return df.withColumns({"blocked_by": F.lit(None).cast("string"), "message": F.lit(None).cast("string"), "safe": F.lit(True)})
    return rows.join(blocked, mark, "left").select(*df.columns, "blocked_by", "message", F.col("blocked_by").isNull().alias("safe"))


def guard_chunks(df: DataFrame, text: str, stages: Sequence[Stage], make: Callable[[], Transport] = http_transport, size: int = 400, overlap: int = 100, tries: int = 3) -> DataFrame:
    """``df`` with safe, blocked_by, message and n_chunks: a text is safe if every chunk of it is; else what blocked its first unsafe chunk is told.

    Chunks are asked about as ``{"text": chunk}``, equal ones once. A null or blank text has no chunks and is safe.
    """
    if {"safe", "blocked_by", "message", "n_chunks"} & {c.lower() for c in df.columns}:
        raise ValueError("the table has a column called safe, blocked_by, message or n_chunks")
    mark, found = free(df.columns, "mark", "found")
    rows = df.withColumn(mark, F.sha2(text, 256))
    # Equal texts give equal rows here, which change neither verdicts nor the last chunk's number.
    texts = rows.where(F.col(text).isNotNull()).select(F.col(mark).alias("hash"), F.col(text).alias("whole"))
    cut = chunks(texts, "hash", "whole", size, overlap).select("hash", "chunk_no", F.to_json(F.struct(F.col("chunk").alias("text"))).alias("payload"))
    judged = remote_guards(cut, "payload", stages, make, tries)
    first = F.min(F.when(~F.col("safe"), F.struct("chunk_no", "blocked_by", "message"))).alias("first")
    rolled = judged.groupBy(F.col("hash").alias(mark)).agg(F.struct(F.bool_and("safe").alias("safe"), first, (F.max("chunk_no") + 1).alias("n")).alias(found))
    get = lambda c: F.col(f"{found}.{c}")
    out = rows.join(rolled, mark, "left")
    return out.select(*df.columns, F.coalesce(get("safe"), F.lit(True)).alias("safe"), get("first.blocked_by").alias("blocked_by"), get("first.message").alias("message"), F.coalesce(get("n"), F.lit(0)).cast("long").alias("n_chunks"))


def remote_guard(df: DataFrame, payload: str, url: str, make: Callable[[], Transport] = http_transport) -> DataFrame:
    """``df`` with safe: ``results.safe`` of the answer; false where it is missing or the service failed."""
    asked = ask(df, payload, url, make)
    return asked.withColumn("safe", F.coalesce(F.get_json_object("answer", "$.results.safe") == "true", F.lit(False)))


def remote_mask(df: DataFrame, payload: str, url: str, make: Callable[[], Transport] = http_transport, empty_on_error: bool = False) -> DataFrame:
    """``df`` with anonymized and mappings of the answer; the payload itself if the answer has none.

    Where the service failed anonymized is null (or the empty text, as clients of old expect), never the bare payload.
    """
    asked = ask(df, payload, url, make)
    kept = F.coalesce(F.get_json_object("answer", "$.anonymized"), F.col(payload))
    lost = F.lit("" if empty_on_error else None).cast("string")
    return asked.withColumn("anonymized", F.when(F.col("error").isNull(), kept).otherwise(lost)).withColumn("mappings", F.get_json_object("answer", "$.mappings"))
