"""Continuous template window over arriving frame tiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skyquilt import session

OK, UNREADABLE, UNREGISTERED = "ok", "unreadable", "unregistered"
STATE = (
    "win_frame array<int>, win_px array<binary>, wait_frame array<int>, wait_px array<binary>, "
    "wait_status array<string>, last int"
)
#: Rows of a file that lands.
FILE_ROWS = 250_000


def frame_arrivals(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Stream of rows from Parquet files as they land in a folder."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def land(frames: DataFrame, path: str, order: str, per_file: int = FILE_ROWS) -> None:
    """Write ``frames`` as files of about ``per_file`` rows that land in ``order``.

    A stream takes its files by the time they were written. The rows are parted by
    ranges of ``order`` in one job; the parts are then appended one after another,
    so that no frame arrives behind a later one.
    """
    spark = frames.sparkSession
    n = max(1, -(-frames.count() // per_file))
    parts = session.cut(frames.repartitionByRange(n, order).sortWithinPartitions(order), "parts")
    for part in sorted(parts.inputFiles(), key=lambda f: f.rsplit("/", 1)[1]):
        spark.read.schema(frames.schema).parquet(part).coalesce(1).write.mode("append").parquet(path)


def template_stream(frames: DataFrame, n: int, keys: tuple[str, ...] = ("aoi", "ty", "tx"), delay: int = 0) -> DataFrame:
    """Emit each frame with its ``n`` predecessors once the window is full.

    ``frames``: keys, frame INT, px BINARY, status STRING. State per key is the
    last ``n`` frames plus at most ``delay`` waiting ones; keys should include
    the tile, so that a busy AOI is spread out.

    * ``unreadable`` frames are skipped; ``unregistered`` ones give no output
      but enter the window.
    * Up to ``delay`` frames wait and are put in order. A frame older than the
      last one handled is reported with ``late = true`` and changes nothing.
    """
    types = dict(frames.dtypes)
    key_fields = ", ".join(f"{k} {types[k]}" for k in keys)
    out = f"{key_fields}, frame int, late boolean, px binary, template_frames array<int>, template_px array<binary>"
    names = [*keys, "frame", "late", "px", "template_frames", "template_px"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wf, wp, qf, qp, qs, last = ([list(v) for v in state.get[:5]] + [state.get[5]]) if state.exists else ([], [], [], [], [], None)
        waiting = list(zip(qf, qp, qs))
        rows = []
        for pdf in batches:
            for f, px, status in zip(pdf.frame, pdf.px, pdf.status):
                if status == UNREADABLE:
                    continue
                if last is not None and f <= last:
                    rows.append((*key, int(f), True, None, None, None))
                else:
                    waiting.append((int(f), px, status))
        waiting.sort(key=lambda w: w[0])
        while len(waiting) > delay:
            f, px, status = waiting.pop(0)
            last = f
            if len(wf) == n and status == OK:
                rows.append((*key, f, False, px, list(wf), list(wp)))
            wf, wp = (wf + [f])[-n:], (wp + [px])[-n:]
        state.update((wf, wp, [w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting], last))
        yield pd.DataFrame(rows, columns=names)

    return frames.select(*keys, "frame", "px", "status").groupBy(*keys).applyInPandasWithState(
        step, out, STATE, "append", GroupStateTimeout.NoTimeout
    )


def running_metrics(counts: DataFrame) -> DataFrame:
    """Cumulative tp, fp, fn per AOI over a stream of per-frame counts."""
    return counts.groupBy("aoi").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.count(F.lit(1)).alias("frames"))


def run_to_table(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Drain a stream into a table of the shared folder and read it.

    A second call with the same ``folder`` goes on where the first one stopped,
    with its state. In update mode every trigger writes its changed rows under its
    ``batch_id``; a repeated trigger replaces them.
    """
    spark = stream.sparkSession
    folder = folder or session.scratch(spark, "stream")
    path, marks = f"{folder}/rows", f"{folder}/marks"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", marks)
    if mode == "append":
        q = writer.format("parquet").option("path", path).start()
    else:
        q = writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch_id={i}")).start()
    q.awaitTermination()
    fields = stream.schema
    if mode != "append":
        fields = fields.add("batch_id", "long")
    return spark.read.schema(fields).parquet(path)
