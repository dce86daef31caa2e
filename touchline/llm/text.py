"""Words, hashes and row plumbing that several operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space, as UTF-8 bytes. ``bytes`` splits and lower-cases ASCII only, which is what is wanted."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def words_column(text: Column) -> Column:
    """The same words as an array column, without Python."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def mix(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    with np.errstate(over="ignore"):
        z = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_PRIME = 0x9E3779B97F4A7C15
_PIECE = 1_000_000
_CODES = {
    lower: mix(np.array([c + 32 if lower and 65 <= c <= 90 else c for c in range(256)], np.uint64), 5) for lower in (False, True)
}
_IN_WORD = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHashes:
    """64-bit hashes of the words of Arrow strings, straight from their bytes: a word is a difference of running sums of its bytes times
    powers of an odd number, brought back to power zero. No Python object is made for a word."""

    def __init__(self, lower: bool = True) -> None:
        self._codes = _CODES[lower]
        self._up, self._down = _powers(_PRIME, 1), _powers(pow(_PRIME, -1, 1 << 64), 1)

    def _piece(self, data: np.ndarray, row_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = _IN_WORD[data]
        first = inside & row_start
        first[1:] |= inside[1:] & ~inside[:-1]
        first[:1] = inside[:1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | row_start[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(self._up) < len(data) + 1:
            self._up, self._down = _powers(_PRIME, len(data) + 1), _powers(pow(_PRIME, -1, 1 << 64), len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self._codes[data] * self._up[: len(data)], out=sums[1:])
            return mix((sums[ends] - sums[starts]) * self._down[starts], 3), starts

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """One array of hashes for each string; a null has none."""
        column = column.fill_null("").cast(pa.large_string())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        row_start = np.zeros(len(data) + 1, bool)
        row_start[offsets[:-1]] = True
        row_start = row_start[:-1]
        hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        while at < len(data):
            end = at + _PIECE
            while end < len(data) and _IN_WORD[data[end]] and not row_start[end]:
                end += 1
            h, s = self._piece(data[at:end], row_start[at:end])
            hashes.append(h)
            starts.append(s + at)
            at = end
        return np.split(np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets[1:-1])) if len(column) else []


def packed(df: DataFrame, text: str = "text") -> DataFrame:
    """Every input row as one struct ``_row`` beside its text, so that no added column can clash with one of the input."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("_row").getField(c).alias(c) for c in columns])
