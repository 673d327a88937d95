"""Log files as a server leaves them while it writes: for the queries that follow logs."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.sources import growing


def write_logs(lines: DataFrame, folder: str, share: float) -> None:
    """One file ``<file>.log`` per value of ``file``, as it is when ``share`` of its bytes are written, in the middle of a line perhaps.

    A file is written aside and then put in place, so a task that runs again leaves the same bytes.
    """
    cloudpickle.register_pickle_by_value(growing)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def write(file: str, values: list[str]) -> None:
        system, base = growing.open_file_system(folder)
        system.create_dir(base)
        data = "".join(f"{v}\n" for v in values).encode()
        with system.open_output_stream(f"{base}/_{file}") as out:
            out.write(data[: int(len(data) * share)])
        system.move(f"{base}/_{file}", f"{base}/{file}.log")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, values = None, []
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != file:
                    if file is not None:
                        write(file, values)
                    file, values = name, []
                values.append(value)
        if file is not None:
            write(file, values)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["file"])

    placed = lines.repartition("file").sortWithinPartitions("file", "line").select("file", F.col("value"))
    placed.mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()
