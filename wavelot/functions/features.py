"""Log-mel features in numpy, always frames x bins, and augmentation of such matrices.

Each extractor is a plain dataclass, so its repr shows all options and it can travel to the tasks. `Extractor` is the point to
extend: a class with sample_rate, bins, frame_shift and extract(audio) works wherever the built-in ones do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Extractor(Protocol):
    sample_rate: int
    bins: int

    @property
    def frame_shift(self) -> float: ...

    def extract(self, audio: np.ndarray) -> np.ndarray: ...


def as_mono(audio: np.ndarray, average: bool = True) -> np.ndarray:
    audio = np.asarray(audio, np.float64)
    return audio if audio.ndim == 1 else audio.mean(axis=0) if average else audio[0]


def hann(n: int) -> np.ndarray:
    """Periodic."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def stft(audio: np.ndarray, n_fft: int, hop: int, window: np.ndarray, center: bool = True) -> np.ndarray:
    """frames x (n_fft / 2 + 1), reflected at both ends."""
    x = np.pad(audio, n_fft // 2, mode="reflect") if center else audio
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    return np.fft.rfft(frames * window, axis=1)


def htk_mel(f):
    return 2595 * np.log10(1 + np.asarray(f, float) / 700)


def htk_hz(m):
    return 700 * (10 ** (np.asarray(m, float) / 2595) - 1)


# Fixed values of the Slaney scale: linear to 1000 Hz at 200/3 Hz a mel, then ln(6.4) / 27 a mel.
_SLANEY_HZ, _SLANEY_LINEAR, _SLANEY_STEP = 1000.0, 200 / 3, np.log(6.4) / 27


def slaney_mel(f):
    f = np.asarray(f, float)
    return np.where(f < _SLANEY_HZ, f / _SLANEY_LINEAR, _SLANEY_HZ / _SLANEY_LINEAR + np.log(np.maximum(f, 1e-9) / _SLANEY_HZ) / _SLANEY_STEP)


def slaney_hz(m):
    m = np.asarray(m, float)
    edge = _SLANEY_HZ / _SLANEY_LINEAR
    return np.where(m < edge, m * _SLANEY_LINEAR, _SLANEY_HZ * np.exp(_SLANEY_STEP * (m - edge)))


@lru_cache(maxsize=32)
def mel_filters(bins: int, n_fft: int, sample_rate: int, low: float = 0.0, high: float | None = None, scale: str = "htk", area: bool = False) -> np.ndarray:
    """(n_fft / 2 + 1) x bins triangles with corners evenly spaced in mel; area: each has unit area in Hz."""
    to, back = (htk_mel, htk_hz) if scale == "htk" else (slaney_mel, slaney_hz)
    corners = back(np.linspace(to(low), to(sample_rate / 2 if high is None else high), bins + 2))
    f = np.linspace(0, sample_rate / 2, n_fft // 2 + 1)[:, None]
    left, mid, right = corners[:-2], corners[1:-1], corners[2:]
    out = np.maximum(0, np.minimum((f - left) / (mid - left), (right - f) / (right - mid)))
    return out * (2 / (right - left)) if area else out


@dataclass(frozen=True)
class Fbank:
    """Log of mel-filtered magnitudes."""

    sample_rate: int = 16000
    bins: int = 80
    n_fft: int = 400
    hop: int = 160
    low: float = 0.0
    high: float | None = None
    power: float = 1.0
    center: bool = True
    scale: str = "htk"
    floor: float = 1e-7

    @property
    def frame_shift(self) -> float:
        return self.hop / self.sample_rate

    def extract(self, audio: np.ndarray) -> np.ndarray:
        spec = np.abs(stft(as_mono(audio), self.n_fft, self.hop, hann(self.n_fft), self.center)) ** self.power
        mel = spec @ mel_filters(self.bins, self.n_fft, self.sample_rate, self.low, self.high, self.scale)
        return np.log(np.maximum(mel, self.floor)).astype(np.float32)


@dataclass(frozen=True)
class WhisperFbank:
    """log10 of Slaney mel power, floored 8 below the utterance's maximum, then (x + 4) / 4."""

    sample_rate: int = 16000
    bins: int = 80
    n_fft: int = 400
    hop: int = 160

    @property
    def frame_shift(self) -> float:
        return self.hop / self.sample_rate

    def extract(self, audio: np.ndarray) -> np.ndarray:
        power = np.abs(stft(as_mono(audio), self.n_fft, self.hop, hann(self.n_fft))[:-1]) ** 2
        mel = power @ mel_filters(self.bins, self.n_fft, self.sample_rate, scale="slaney", area=True)
        x = np.log10(np.maximum(mel, 1e-10))
        return ((np.maximum(x, x.max() - 8.0) + 4.0) / 4.0).astype(np.float32)


@dataclass(frozen=True)
class KaldiFbank:
    """Log mel power by frames that are centred on multiples of the shift, with reflected ends."""

    sample_rate: int = 16000
    bins: int = 80
    frame_length: float = 0.025
    shift: float = 0.01
    preemphasis: float = 0.97
    remove_dc: bool = True
    window: str = "povey"
    snip_edges: bool = False
    energy_floor: float = 1e-10
    low: float = 20.0
    high: float = -400.0
    dither: float = 0.0
    seed: int = 0

    @property
    def frame_shift(self) -> float:
        return self.shift

    def extract(self, audio: np.ndarray) -> np.ndarray:
        x = as_mono(audio)
        size, hop = int(self.sample_rate * self.frame_length), int(self.sample_rate * self.shift)
        if self.snip_edges:
            if len(x) < size:
                return np.zeros((0, self.bins), np.float32)
            count, begin = 1 + (len(x) - size) // hop, 0
        else:
            count, begin = (len(x) + hop // 2) // hop, hop // 2 - size // 2
        at = begin + np.arange(count)[:, None] * hop + np.arange(size)[None, :]
        at = at % (2 * len(x))  # reflection that repeats the end values
        frames = x[np.where(at < len(x), at, 2 * len(x) - 1 - at)]
        if self.dither:
            frames = frames + self.dither * np.random.default_rng(self.seed).normal(size=frames.shape)
        if self.remove_dc:
            frames = frames - frames.mean(axis=1, keepdims=True)
        if self.preemphasis:
            frames = frames - self.preemphasis * np.concatenate([frames[:, :1], frames[:, :-1]], axis=1)
        n = np.arange(size) / (size - 1)
        shape = {"povey": (0.5 - 0.5 * np.cos(2 * np.pi * n)) ** 0.85, "hanning": 0.5 - 0.5 * np.cos(2 * np.pi * n), "hamming": 0.54 - 0.46 * np.cos(2 * np.pi * n), "rectangular": np.ones(size)}[self.window]
        n_fft = 1 << (size - 1).bit_length()
        power = np.abs(np.fft.rfft(frames * shape, n_fft, axis=1)) ** 2
        mel = power[:, : n_fft // 2] @ _kaldi_filters(self.bins, n_fft, self.sample_rate, self.low, self.high)
        return np.log(np.maximum(mel, max(self.energy_floor, float(np.finfo(np.float32).eps)))).astype(np.float32)


@lru_cache(maxsize=32)
def _kaldi_filters(bins: int, n_fft: int, rate: int, low: float, high: float) -> np.ndarray:
    """Triangles in mel 1127 ln(1 + f / 700); a `high` of 0 or less counts from the Nyquist rate."""
    mel = lambda f: 1127 * np.log(1 + np.asarray(f, float) / 700)
    corners = np.linspace(mel(low), mel(high if high > 0 else rate / 2 + high), bins + 2)
    f = mel(np.arange(n_fft // 2) * rate / n_fft)[:, None]
    left, mid, right = corners[:-2], corners[1:-1], corners[2:]
    return np.maximum(0, np.minimum((f - left) / (mid - left), (right - f) / (right - mid)))


#: The built-in extractors by name.
EXTRACTORS = {"Fbank": Fbank, "KaldiFbank": KaldiFbank, "WhisperFbank": WhisperFbank}


def extractor(kind: str | Extractor, sample_rate: int = 16000) -> Extractor:
    if not isinstance(kind, str):
        return kind
    if kind not in EXTRACTORS:
        raise ValueError(f"unknown features {kind}; known are {', '.join(EXTRACTORS)}")
    return EXTRACTORS[kind](sample_rate=sample_rate)


def features(audio: Column, ex: Extractor) -> Column:
    """audio: array<float> at the extractor's rate -> array<array<float>>, frames x bins. Null or empty audio gives null."""

    @F.pandas_udf("array<array<float>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([list(ex.extract(np.asarray(a))) if a is not None and len(a) else None for a in batch], dtype=object)

    return run(audio)


# -- augmentation of feature matrices


def _cubic(x: np.ndarray, n: int) -> np.ndarray:
    """Resize the rows of x to n by cubic convolution (a = -0.75), sample centres aligned."""
    t = (np.arange(n) + 0.5) * (len(x) / n) - 0.5
    base = np.floor(t).astype(int)
    out, a = np.zeros((n, x.shape[1])), -0.75
    for k in range(-1, 3):
        d = np.abs(t - (base + k))
        w = np.where(d <= 1, ((a + 2) * d - (a + 3)) * d * d + 1, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a)
        out += w[:, None] * x[np.clip(base + k, 0, len(x) - 1)]
    return out


def warp_time(x: np.ndarray, factor: int, rnd: np.random.Generator) -> np.ndarray:
    """Stretch the frames before a random centre and squeeze those after it, or the reverse (the time warping of the SpecAugment paper, Park et al. 2019, by cubic
    interpolation). Short matrices stay."""
    t = len(x)
    if t - factor <= factor + 1:
        return x
    centre = int(rnd.integers(factor + 1, t - factor))
    to = int(rnd.integers(centre - factor, centre + factor + 1))
    if to == centre or not 0 < to < t:
        return x
    return np.concatenate([_cubic(x[:centre], to), _cubic(x[centre:], t - to)]).astype(x.dtype)


def mask(x: np.ndarray, axis: int, count: int, size: int, value: float, rnd: np.random.Generator) -> np.ndarray:
    """Set `count` random bands of width 0 .. size - 1 to value."""
    x, n = x.copy(), x.shape[axis]
    for _ in range(count if size > 0 else 0):
        width = int(rnd.integers(0, size))
        start = int(rnd.random() * max(0, n - width))
        if axis == 0:
            x[start : start + width] = value
        else:
            x[:, start : start + width] = value
    return x


@dataclass(frozen=True)
class SpecAugment:
    time_warp_factor: int = 80
    num_feature_masks: int = 2
    features_mask_size: int = 27
    num_frame_masks: int = 10
    frames_mask_size: int = 100
    max_frames_mask_fraction: float = 0.15
    p: float = 0.9

    def apply(self, x: np.ndarray, rnd: np.random.Generator, length: int | None = None) -> np.ndarray:
        """One draw decides on all of it; length: frames that are not padding, which alone are warped and masked in time."""
        if rnd.random() > self.p or not len(x):
            return x
        n = len(x) if length is None else length
        own = warp_time(x[:n], self.time_warp_factor, rnd) if self.time_warp_factor else x[:n]
        value = float(own.mean()) if own.size else 0.0
        own = mask(own, 1, self.num_feature_masks, self.features_mask_size, value, rnd)
        if self.num_frame_masks:
            size = min(self.frames_mask_size, int(self.max_frames_mask_fraction * n / self.num_frame_masks))
            own = mask(own, 0, self.num_frame_masks, size, value, rnd)
        return np.concatenate([own, x[n:]])

    def state_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_state(cls, state: dict) -> SpecAugment:
        return cls(**state)


def _generator(seed: int) -> np.random.Generator:
    return np.random.default_rng(int(seed) & ((1 << 63) - 1))


def spec_augment(feature: Column, seed: Column, options: SpecAugment = SpecAugment(), length: Column | None = None) -> Column:  # noqa: B008
    """feature: frames x bins; seed: a long from a hash of the sample, so that reruns agree; length: frames that aren't padding (null or not given: all)."""

    @F.pandas_udf("array<array<float>>")
    def run(x: pd.Series, s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if m is None else list(options.apply(np.stack(m), _generator(k), None if pd.isna(own) else int(own))) if len(m) else m for m, k, own in zip(x, s, n, strict=True)], dtype=object)

    return run(feature, seed, F.lit(None).cast("int") if length is None else length)


def spec_augment_batch(features: Column, seed: Column, options: SpecAugment = SpecAugment(), lens: Column | None = None) -> Column:  # noqa: B008
    """A padded batch: features of its samples (samples x frames x bins), each with a draw of its own from the batch's seed and its place; lens: true lengths, as
    collate gives them. Padding stays as it is."""

    @F.pandas_udf("array<array<array<float>>>")
    def run(batches: pd.Series, seeds: pd.Series, lengths: pd.Series) -> pd.Series:
        out = []
        for batch, k, own in zip(batches, seeds, lengths, strict=True):
            rnd = None if batch is None else _generator(k).spawn(len(batch))
            n = [None] * len(batch) if batch is not None and own is None else own
            out.append(None if batch is None else [list(options.apply(np.stack(m), r, None if x is None else int(x))) if len(m) else m for m, r, x in zip(batch, rnd, n, strict=True)])
        return pd.Series(out, dtype=object)

    return run(features, seed, F.lit(None).cast("array<int>") if lens is None else lens)


def _only_warp(p: float, factor: int) -> SpecAugment:
    return SpecAugment(time_warp_factor=factor, num_feature_masks=0, num_frame_masks=0, p=p)


def time_warp(feature: Column, seed: Column, p: float = 0.9, factor: int = 80, length: Column | None = None) -> Column:
    """Warp with probability p, one draw for each matrix."""
    return spec_augment(feature, seed, _only_warp(p, factor), length)


def time_warp_batch(features: Column, seed: Column, p: float = 0.9, factor: int = 80, lens: Column | None = None) -> Column:
    """Warp each sample of a padded batch with probability p, within its true length."""
    return spec_augment_batch(features, seed, _only_warp(p, factor), lens)
