"""Minima and maxima that grow with the planes read, over a stream of planes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenplane.operators import stats


def known_min_max(planes: DataFrame, keys: list[str], samples: int = 1):
    """A streaming aggregate (output mode complete or update) over planes as they arrive."""
    return stats.known_min_max(stats.plane_min_max(planes, samples), keys)


def completed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, global_minimum and global_maximum, once for each key as soon as all of its planes have been read in full.

    parts: keys, plane_index, image_count, full, minimum and maximum of what is read (see stats.plane_min_max),
    as a stream; output mode append. The state holds a bit for each plane.
    """
    own = [parts.schema[k] for k in keys]
    found = T.StructType([*own, T.StructField("global_minimum", T.DoubleType()), T.StructField("global_maximum", T.DoubleType())])

    def update(key, frames, state):
        import numpy as np
        import pandas as pd

        low, high, seen, done = state.get if state.exists else (float("inf"), -float("inf"), b"", False)
        bits = np.frombuffer(seen, np.uint8).copy()
        for frame in frames:
            low, high = min(low, frame["minimum"].min()), max(high, frame["maximum"].max())
            total = int(frame["image_count"].max())
            if len(bits) * 8 < total:
                bits = np.concatenate((bits, np.zeros(-(-total // 8) - len(bits), np.uint8)))
            read = frame.loc[frame["full"], "plane_index"].to_numpy(np.int64)
            np.bitwise_or.at(bits, read // 8, (1 << read % 8).astype(np.uint8))
            if not done and int(np.unpackbits(bits).sum()) == total:
                done = True
                yield pd.DataFrame([(*key, float(low), float(high))], columns=found.names)
        state.update((float(low), float(high), bits.tobytes(), done))

    rows = parts.select(*keys, "plane_index", "image_count", "full", "minimum", "maximum")
    return rows.groupBy(*keys).applyInPandasWithState(update, found, "low double, high double, seen binary, done boolean", "append", "NoTimeout")
