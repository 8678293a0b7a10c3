"""Turning time-major frames into channel-major arrays, a whole Arrow batch at a time."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def turn_frames():
    """UDF: frames of a block, ARRAY<ARRAY<FLOAT>> by time, to the same values by channel."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.FloatType())))
    def turned(blocks: pa.Array) -> pa.Array:
        rows = blocks.offsets.to_numpy()
        cells = blocks.values.offsets.to_numpy()
        values = blocks.values.values.to_numpy(zero_copy_only=False)
        parts, lengths, channels = [], [], []
        for lo, hi in zip(rows[:-1], rows[1:]):
            widths = np.diff(cells[lo : hi + 1])
            if len(widths) and (widths != widths[0]).any():
                raise ValueError("frames of a block must have the same number of channels")
            width = int(widths[0]) if len(widths) else 0
            parts.append(values[cells[lo] : cells[hi]].reshape(hi - lo, width).T.ravel())
            lengths.append(np.full(width, hi - lo, dtype=np.int64))
            channels.append(width)
        flat = pa.array(np.concatenate(parts) if parts else np.empty(0, np.float32), pa.float32())
        inner = np.concatenate([[0], np.cumsum(np.concatenate(lengths) if lengths else [])]).astype(np.int32)
        outer = np.concatenate([[0], np.cumsum(channels)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), flat))

    return turned
