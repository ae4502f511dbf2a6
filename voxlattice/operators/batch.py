"""A batch of samples as one job in which a failing sample is recorded while the others go on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import write


def run_batch(rows: DataFrame, work: Callable[[pd.DataFrame, int], pd.DataFrame], schema: str, key: str = "sample_id", attempts: int = 1) -> tuple[DataFrame, DataFrame]:
    """(results, jobs): work(a sample's rows, attempt) for every sample. A task takes its samples one after the other from rows sorted by the key,
    so that many small samples cost little more than their work; `work` may return a frame or a dict of columns.

    An exception doesn't end the job: it becomes the sample's reason, and only such samples are tried again, up to
    `attempts` times. results have the columns of schema, of samples that succeeded. jobs has a row a sample: key, state
    (done or failed), attempts, and the last reason. Rows with a null key are one sample. A sample's rows must fit a task.
    """
    kind = rows.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]

    def tried(frame: pd.DataFrame, attempt: int) -> tuple[list[list], bool, str | None]:
        """The columns of a sample's results, whether it succeeded, and why not."""
        try:
            out = work(frame, attempt)
            columns = [list(out[c]) for c in names]
        except Exception as e:  # whatever a sample's data does to it
            return [[None] for _ in names], False, f"{type(e).__name__}: {e}"
        if not columns[0]:  # a sample without result rows is done too
            return [[None] for _ in names], True, "empty"
        return columns, True, None

    def once(attempt: int):
        def samples(frames: Iterator[pd.DataFrame]) -> Iterator[list[pd.DataFrame]]:
            """Of a partition sorted by the key, batch by batch the samples that are complete."""
            held: list[pd.DataFrame] = []
            for frame in frames:
                k = frame[key].to_numpy()
                turns = np.flatnonzero((k[1:] != k[:-1]) & ~((k[1:] != k[1:]) & (k[:-1] != k[:-1]))) + 1
                parts = [frame.iloc[i:j].reset_index(drop=True) for i, j in zip([0, *turns], [*turns, len(k)]) if j > i]
                done = []
                for part in parts:
                    if held and not same(held[-1][key].iloc[-1], part[key].iloc[0]):
                        done.append(held[0] if len(held) == 1 else pd.concat(held, ignore_index=True))
                        held = []
                    held.append(part)
                yield done
            yield [pd.concat(held, ignore_index=True)] if held else []

        def same(a, b) -> bool:
            return bool(a == b or (a != a and b != b))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for done in samples(frames):
                made: list[list] = [[] for _ in range(len(names) + 3)]
                for frame in done:
                    sample = frame[key].iloc[0]
                    columns, ok, reason = tried(frame, attempt)
                    for into, values in zip(made, [*columns, *([v] * len(columns[0]) for v in (sample, ok, reason))]):
                        into.extend(values)
                yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip([*names, "_sample", "_ok", "_reason"], made)})

        return run

    def alone(attempt: int):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            columns, ok, reason = tried(frame, attempt)
            return pd.DataFrame(dict(zip(names, columns))).assign(_sample=None, _ok=ok, _reason=reason)

        return run

    def attempted(rows: DataFrame, attempt: int) -> DataFrame:
        out = f"{schema}, _sample {kind}, _ok boolean, _reason string"
        known = rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key).mapInPandas(once(attempt), out)
        # rows without a key are one sample; beside the others their nulls would turn a batch's whole numbers into floats
        return known.union(rows.where(F.col(key).isNull()).groupBy(key).applyInPandas(alone(attempt), out))

    rows, results, jobs = write(rows), None, None
    for attempt in range(1, attempts + 1):
        out = write(attempted(rows, attempt))
        good = out.where("_ok and _reason is null").select(*names)
        failed = out.where("not _ok").select(F.col("_sample").alias(key), "_reason")
        last = attempt == attempts
        ended = out.where("_ok" if not last else "true").select(F.col("_sample").alias(key), F.when(F.col("_ok"), "done").otherwise("failed").alias("state"), F.lit(attempt).alias("attempts"), F.when(~F.col("_ok"), F.col("_reason")).alias("reason")).distinct()
        results, jobs = (good, ended) if results is None else (results.union(good), jobs.union(ended))
        if last or not failed.limit(1).count():
            break
        again = failed.select(F.col(key).alias("_again"))
        rows = write(rows.join(again, F.col(key).eqNullSafe(F.col("_again")), "left_semi"))
    return results, jobs
