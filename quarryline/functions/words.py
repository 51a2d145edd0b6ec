"""Words of many texts at once, as ``text.tokens`` cuts them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import WORD

POINTS = 0x110000


@lru_cache(1)
def word_characters(spark: SparkSession) -> bytes:
    """A bit for each code point: whether Spark's regular expression takes it as part of a word. Asked of Spark itself, as releases of Unicode differ."""
    points = spark.range(POINTS).where(~F.col("id").between(0xD800, 0xDFFF))
    held = points.where(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").rlike(f"^{WORD}$"))
    bits = np.zeros(POINTS, bool)
    bits[held.toArrow().column("id").to_numpy()] = True
    return np.packbits(bits).tobytes()


class Words:
    """Cuts texts in lower case into words: ``characters`` as ``word_characters`` gives them."""

    def __init__(self, characters: bytes) -> None:
        self.points = np.unpackbits(np.frombuffer(characters, np.uint8)).astype(bool)
        self.ascii = np.concatenate([self.points[:128], np.zeros(128, bool)])

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All words one after another, and how many each text has; a null has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if not len(texts) or at[-1] == at[0]:
            return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
        at -= at[0]
        own = self._within(data)
        starts = own.copy()
        starts[1:] &= ~own[:-1]
        # a text's first byte begins a word whatever the text before ends with
        first = at[:-1][at[:-1] < at[1:]]
        starts[first] = own[first]
        size = np.diff(np.searchsorted(np.flatnonzero(starts), at))
        ends = np.append(np.flatnonzero(starts[own]), np.count_nonzero(own)).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data[own])]), size

    def _within(self, data: np.ndarray) -> np.ndarray:
        """Whether each byte is of a character that words have."""
        own = self.ascii[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            byte = data[lead].astype(np.int64)
            width = 2 + (byte >= 0xE0) + (byte >= 0xF0)
            point = byte & (0x7F >> width)
            for j in (1, 2, 3):
                more = width > j
                point[more] = point[more] << 6 | data[lead[more] + j] & 0x3F
            held = self.points[point]
            for j in range(4):
                own[lead[held & (width > j)] + j] = True
        return own
