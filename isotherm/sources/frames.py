"""Packed radar frames -> pixels."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.operators.radar import check_bbox

PIXELS = "timestamp timestamp, zeile int, spalte int, raw int"


def read_frames(frames: DataFrame, bbox, window=None) -> DataFrame:
    """Frames (timestamp, precipitation_5 in base64) -> timestamp, zeile, spalte, raw.

    Each frame is zlib-packed little-endian uint16, row by row over ``bbox``. With ``window``
    only those rows and columns leave the decoder. Frames are independent, so the work spreads
    over them; drop frames by time before decoding.
    """
    top, left, bottom, right = check_bbox(bbox)
    rows, columns = bottom - top + 1, right - left + 1
    t, l, b, r = check_bbox(window) if window else (top, left, bottom, right)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for stamp, packed in zip(batch["timestamp"], batch["packed"]):
                grid = np.frombuffer(zlib.decompress(packed), dtype="<u2").reshape(rows, columns)
                ys = np.arange(max(t, top), min(b, bottom) + 1)
                xs = np.arange(max(l, left), min(r, right) + 1)
                if not len(ys) or not len(xs):
                    continue
                part = grid[np.ix_(ys - top, xs - left)]
                yield pd.DataFrame({
                    "timestamp": stamp, "zeile": np.repeat(ys, len(xs)).astype("int32"),
                    "spalte": np.tile(xs, len(ys)).astype("int32"),
                    "raw": part.ravel().astype("int32")})

    return frames.select("timestamp", F.unbase64("precipitation_5").alias("packed")).mapInPandas(
        decode, PIXELS)
