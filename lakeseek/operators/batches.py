"""Memory of Python workers: how much they get at once, and that they give it back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch sent to a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, which long texts would swell, unless the session says otherwise."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("64MB", "67108864b"):
        spark.conf.set(name, str(BATCH_BYTES))


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after whose end its worker gives freed memory back to the system: workers are kept from task to task."""

    def tidy(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return tidy
