"""Calling an outside model from a job: bounded concurrency, back-off, results kept."""

from __future__ import annotations

import hashlib
import io
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.session import materialise


class Answers:
    """Answers to requests in a folder that all executors reach, by a hash of the request."""

    def __init__(self, folder: str):
        self.system, self.path = (fs.FileSystem.from_uri(folder) if ":/" in folder
                                  else (fs.LocalFileSystem(), folder))

    def _at(self, request: pd.DataFrame) -> str:
        text = request.to_json(orient="split", index=False, date_format="iso")
        return f"{self.path}/{hashlib.sha256(text.encode()).hexdigest()}.pickle"

    def get(self, request: pd.DataFrame) -> pd.DataFrame | None:
        at = self._at(request)
        if self.system.get_file_info(at).type != fs.FileType.File:
            return None
        with self.system.open_input_file(at) as stream:
            return pd.read_pickle(io.BytesIO(stream.read()))

    def put(self, request: pd.DataFrame, answer: pd.DataFrame) -> None:
        """Written under another name first, so that no half answer is read."""
        at, raw = self._at(request), io.BytesIO()
        answer.to_pickle(raw)
        self.system.create_dir(self.path, recursive=True)
        draft = f"{at}.{uuid.uuid4().hex}"
        with self.system.open_output_stream(draft) as stream:
            stream.write(raw.getvalue())
        self.system.move(draft, at)


def call_model(df: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
               parallel: int = 4, attempts: int = 2, wait: float = 5.0,
               key: str = "query_id", rows: int = 64, window: int = 4,
               store: str | None = None) -> DataFrame:
    """Map batches through ``call``: ``parallel`` tasks with ``window`` calls at a time each.

    ``schema`` names the columns ``call`` returns and must include ``key``.  The
    rows of a batch that fails are tried one by one; a row that fails
    ``attempts`` times, the waits between them doubling, yields its key with the text
    of the failure in ``error``.  A ``call`` that answers only some rows, all in their
    order, names the others by a text in a column ``error``; those are asked again together,
    ``attempts`` times in all, so a batch costs no call a row.  Answers are kept below
    the folder ``store``, if given, so that a task that runs again, or a later job, does
    not ask for them anew.
    """
    out = T.StructType.fromDDL(schema).add("error", T.StringType())
    names = out.fieldNames()

    def tried(part: pd.DataFrame, times: int) -> tuple[pd.DataFrame | None, str]:
        reason = ""
        for attempt in range(times):
            if attempt:
                time.sleep(wait * 2 ** (attempt - 1))
            try:
                answer = call(part).reindex(columns=names)
                if answer["error"].isna().all():
                    return answer.assign(error=None), ""
                if answer[key].tolist() != part[key].tolist():
                    raise ValueError("rows are rejected, but not one answer for every request")
                return answer, ""
            except Exception as failure:  # noqa: BLE001 - reported in the row
                reason = str(failure) or "failed"
        return None, reason

    def unanswered(part: pd.DataFrame, reason) -> pd.DataFrame:
        nothing = part[[key]].assign(error=reason).reindex(columns=names)
        return nothing.astype(object).where(lambda d: d.notna(), None)

    def settled(part: pd.DataFrame, done: pd.DataFrame, times: int) -> list[pd.DataFrame]:
        """The answers ``done``, the rows they reject asked up to ``times`` times more."""
        rejected = done["error"].notna().to_numpy()
        out = [done[~rejected].assign(error=None)]
        for attempt in range(times):
            if not rejected.any():
                return out
            time.sleep(wait * 2 ** attempt)
            part, done = part[rejected], done[rejected]
            again, reason = tried(part, 1)
            done = done.assign(error=reason) if again is None else again
            rejected = done["error"].notna().to_numpy()
            out.append(done[~rejected].assign(error=None))
        if rejected.any():
            out.append(unanswered(part[rejected], done["error"][rejected].astype(str).tolist()))
        return [frame for frame in out if len(frame)]

    def answered(part: pd.DataFrame) -> list[pd.DataFrame]:
        kept = Answers(store) if store else None
        done = kept.get(part) if kept else None
        if done is not None:
            return settled(part, done, attempts)
        done, _ = tried(part, 1)
        if done is None and len(part) > 1:
            return [one for i in range(len(part)) for one in answered(part.iloc[i:i + 1])]
        if done is None:
            done, reason = tried(part, attempts)
        if done is None:
            return [unanswered(part, reason)]
        if kept:
            kept.put(part, done)
        return settled(part, done, attempts - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(window) as pool:
            waiting: deque = deque()
            for batch in batches:
                for at in range(0, len(batch), rows):
                    if len(waiting) == window:
                        yield from waiting.popleft().result()
                    waiting.append(pool.submit(answered, batch.iloc[at:at + rows]))
            while waiting:
                yield from waiting.popleft().result()

    # the same rows meet in the same order when a task runs again
    dealt = df.repartition(parallel, key).sortWithinPartitions(key)
    return dealt.mapInPandas(run, out)


def split_failures(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("error IS NULL").drop("error"), df.where("error IS NOT NULL")


def with_fallback(df: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                  fallback: Callable[[DataFrame], DataFrame], key: str = "query_id",
                  **options) -> DataFrame:
    """The answers of ``call_model``, those of ``fallback`` for the rows that failed, and
    which of them it was in ``answered_by``.  ``fallback`` returns the same columns."""
    names = T.StructType.fromDDL(schema).fieldNames()
    answers = materialise(call_model(df, call, schema, key=key, **options), "model-answers")
    good, bad = split_failures(answers)
    rest = fallback(df.join(bad.select(key), key, "left_semi"))
    return good.select(*names, F.lit("model").alias("answered_by")).unionByName(
        rest.select(*names, F.lit("rules").alias("answered_by")))
