"""Columns of fixed-width numbers, packed by bucket: one row for each bucket of a batch instead of one for each number.

A bucket's rows meet in one group after `groupBy("bucket")`; there are as many buckets as the input needs, so a group
stays of bounded size.
"""

import numpy as np
import pyarrow as pa


def schema(*names: str) -> str:
    return "bucket int, " + ", ".join(f"{n} binary" for n in names)


def deal(bucket: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket that occurs, in the order in which its numbers stand."""
    order = np.argsort(bucket, kind="stable")
    keys = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    bounds = np.concatenate([first, [len(keys)]])
    out = [pa.array(keys[first].astype(np.int32))]
    for x in columns.values():
        data = np.ascontiguousarray(x[order])
        at = (bounds * data.itemsize).astype(np.int32)
        out.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(data)]))
    return pa.RecordBatch.from_arrays(out, names=["bucket", *columns])


def gathered(table: pa.Table, **kinds: type) -> list[np.ndarray]:
    """The packed columns of all rows, one after another."""
    out = []
    for name, kind in kinds.items():
        parts = [np.frombuffer(x.as_buffer(), kind) for x in table.column(name) if x.is_valid]
        out.append(np.concatenate(parts) if parts else np.zeros(0, kind))
    return out
