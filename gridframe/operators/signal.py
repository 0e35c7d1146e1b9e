"""Fourier transforms, windows and the polyphase filter bank over packed arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPLEX = T.ArrayType(T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]))
PARTS = T.StructType([T.StructField("re", T.ArrayType(T.DoubleType())), T.StructField("im", T.ArrayType(T.DoubleType()))])


def by_length(values: pd.Series, f: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray | None]:
    """f of the arrays, those of one length stacked and worked out together; null stays null."""
    out: list[np.ndarray | None] = [None] * len(values)
    known = np.flatnonzero(values.notna().to_numpy())
    lengths = np.array([len(values.iloc[i]) for i in known])
    for n in np.unique(lengths):
        own = known[lengths == n]
        for at, row in zip(own, f(np.stack([values.iloc[i] for i in own])), strict=True):
            out[at] = row
    return out


def parts(rows: list[np.ndarray | None]) -> pd.DataFrame:
    return pd.DataFrame({"re": [None if z is None else z.real for z in rows], "im": [None if z is None else z.imag for z in rows]})


def complex_series(re: pd.Series, im: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else x + 1j * y for x, y in zip(re, im, strict=True)], dtype=object)


def as_complex(z: Column) -> Column:
    """(re, im) arrays as one array of complex numbers."""
    return F.arrays_zip(z["re"], z["im"]).cast(COMPLEX)


@F.pandas_udf(PARTS)
def rfft_parts(values: pd.Series) -> pd.DataFrame:
    return parts(by_length(values, lambda x: np.fft.rfft(x, axis=1)))


@F.pandas_udf(PARTS)
def fft_parts(re: pd.Series, im: pd.Series) -> pd.DataFrame:
    return parts(by_length(complex_series(re, im), lambda z: np.fft.fft(z, axis=1)))


@F.pandas_udf(PARTS)
def ifft_parts(re: pd.Series, im: pd.Series) -> pd.DataFrame:
    return parts(by_length(complex_series(re, im), lambda z: np.fft.ifft(z, axis=1)))


def rfft(values: Column) -> Column:
    """Transform of a real array (non-negative frequencies)."""
    return as_complex(rfft_parts(values))


def fft(values: Column) -> Column:
    """Transform of an array of complex numbers; an array with a null in it gives null."""
    return as_complex(fft_parts(values["re"], values["im"]))


def ifft(values: Column) -> Column:
    return as_complex(ifft_parts(values["re"], values["im"]))


def fft_window(values: Column, window: Column) -> Column:
    """An array of complex numbers, its transform multiplied by a real array of the same length."""
    spectrum = fft(values)
    return ifft(F.zip_with(spectrum, window, lambda z, w: F.struct((z["re"] * w).alias("re"), (z["im"] * w).alias("im"))))


def convolve(df: DataFrame, position: str, value: str, kernel: list[float], length: int, by: tuple[str, ...] = (), block: int = 4096, circular: bool = True) -> DataFrame:
    """(by, position, value): the convolution of a long axis with a short kernel, by overlap-save.

    A sample goes to its block of positions and, near the block's end, to the next one too (at the
    axis' end to the first one, if ``circular``), so blocks are transformed on their own and no
    task holds the axis.  Many blocks are transformed in one Arrow batch.  A missing or null
    sample is 0, a block without any sample gives no rows."""
    if circular and len(kernel) > length:  # what is longer than the axis falls on it again
        kernel = [float(sum(kernel[k::length])) for k in range(length)]
    halo = len(kernel) - 1
    size = max(block, halo, 1)
    taps = np.asarray(kernel, float)
    i = F.col(position).cast("long")
    own = F.floor(i / size)
    targets = [F.struct(own.alias("b"), (i - own * size + halo).cast("int").alias("q"))]
    following = (i - (own + 1) * size + halo >= 0) & ((own + 1) * size < length)
    targets.append(F.when(following, F.struct((own + 1).alias("b"), (i - (own + 1) * size + halo).cast("int").alias("q"))))
    if circular:
        targets.append(F.when(i - length + halo >= 0, F.struct(F.lit(0).cast("long").alias("b"), (i - length + halo).cast("int").alias("q"))))
    held = df.where((i >= 0) & (i < length)).select(*by, F.explode(F.array_compact(F.array(*targets))).alias("_t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v"))
    blocks = held.groupBy(*by, F.col("_t.b").alias("_b")).agg(F.collect_list(F.struct(F.col("_t.q").alias("q"), F.col("_v").alias("v"))).alias("_s"))

    @F.pandas_udf("array<double>")
    def filtered(place: pd.Series, sample: pd.Series) -> pd.Series:
        n = size + halo
        rows = np.repeat(np.arange(len(place)), [len(p) for p in place])
        buffer = np.zeros((len(place), n))
        np.add.at(buffer, (rows, np.concatenate(place.to_list() or [[]]).astype(int)), np.concatenate(sample.to_list() or [[]]))
        return pd.Series(list(np.fft.irfft(np.fft.rfft(buffer, axis=1) * np.fft.rfft(taps, n), n, axis=1)[:, halo:]))

    out = blocks.select(*by, "_b", F.posexplode(filtered(F.col("_s.q"), F.col("_s.v"))).alias("_k", value))
    return out.withColumn(position, F.col("_b") * size + F.col("_k")).where(F.col(position) < length).select(*by, position, value)


def power(spectrum: Column) -> Column:
    return F.transform(spectrum, lambda z: z["re"] * z["re"] + z["im"] * z["im"])


def sinc_window(i: Column, taps: int, length: int, shape: str = "hamming") -> Column:
    """A sinc over taps * length samples, tapered by a Hann or Hamming window or by none."""
    n = taps * length
    x = (i / F.lit(float(n)) - 0.5) * taps
    sinc = F.when(x == 0, 1.0).otherwise(F.sin(F.lit(np.pi) * x) / (F.lit(np.pi) * F.when(x == 0, 1.0).otherwise(x)))
    a = {"hamming": 0.54, "hann": 0.5, "none": 1.0}[shape]
    return sinc * (F.lit(a) - F.lit(1 - a) * F.cos(2 * F.lit(np.pi) * i / F.lit(float(n - 1))))


TAPERS = {"hamming": np.hamming, "hann": np.hanning, "none": np.ones}


def window_of(taps: int, length: int, shape: str) -> np.ndarray:
    n = np.arange(taps * length)
    return np.sinc((n / (taps * length) - 0.5) * taps) * TAPERS[shape](taps * length)


def pfb(df: DataFrame, position: str, value: str, length: int, taps: int = 4, shape: str = "hamming") -> DataFrame:
    """(block, channel, re, im): each block is ``taps`` windows of ``length`` samples, one window on from the last.

    Samples go to the blocks that they lie in; an incomplete block is left out.  Spark gathers a block's
    samples in one row, and many blocks are transformed in one Arrow batch."""
    window = window_of(taps, length, shape)
    last = F.floor(F.col(position) / length)
    spread = df.select(F.explode(F.sequence(F.greatest(last - taps + 1, F.lit(0).cast("long")), last)).alias("block"), F.col(position).alias("i"), F.col(value).cast("double").alias("v"))
    blocks = spread.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("v")).where(F.size("v") == taps * length)

    @F.pandas_udf(PARTS)
    def channels(samples: pd.Series) -> pd.DataFrame:
        return parts(by_length(samples, lambda x: np.fft.rfft(x * window, axis=1)[:, : length // 2 * taps : taps]))

    z = blocks.select("block", channels("v").alias("z")).select("block", F.posexplode(F.arrays_zip("z.re", "z.im")).alias("channel", "z"))
    return z.select("block", F.col("channel").cast("long").alias("channel"), "z.re", "z.im")


def channel_profile(offset: Column, length: int, taps: int = 4, shape: str = "hamming", norm: bool = True) -> Column:
    """(re, im): a channel's response at an offset from its centre, in widths of a channel.

    The window's transform is summed at the offset itself, so nothing is tabulated or interpolated;
    offsets beyond half of all channels have none (null)."""
    window = window_of(taps, length, shape)
    n = np.arange(taps * length)

    @F.pandas_udf("re double, im double")
    def profile(x: pd.Series) -> pd.DataFrame:
        at = x.to_numpy(float)
        z = np.concatenate([np.exp(-2j * np.pi * at[k : k + 256, None] * n / length) @ window for k in range(0, len(at), 256)] or [np.zeros(0, complex)])
        return pd.DataFrame({"re": z.real, "im": z.imag}) / (window.sum() if norm else 1.0)

    return F.when(F.abs(offset) <= length / 2, profile(offset.cast("double")))


def decorrelation_ratio(delay: Column, length: int, taps: int = 4, shape: str = "hamming") -> Column:
    """What is left of a correlation after a delay (in samples, also between two): the window's
    band-limited autocorrelation over that without a delay; 0 beyond the window's length."""
    size = taps * length
    spectrum = np.abs(np.fft.rfft(window_of(taps, length, shape), 2 * size)) ** 2
    share = spectrum * np.where(np.arange(size + 1) % size == 0, 1, 2)
    k = np.arange(size + 1)

    @F.pandas_udf("double")
    def ratio(x: pd.Series) -> pd.Series:
        at = x.to_numpy(float)
        r = np.concatenate([np.cos(np.pi * at[i : i + 256, None] * k / size) @ share for i in range(0, len(at), 256)] or [np.zeros(0)])
        return pd.Series(r / share.sum())

    return F.when(F.abs(delay) <= size, ratio(delay.cast("double"))).when(delay.isNotNull(), 0.0)
