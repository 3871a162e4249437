"""Waveforms in numpy: WAV bytes, other codecs where soundfile is installed, and resampling."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Channels x frames as float32 in -1 .. 1, and the sample rate. 8, 16, 24 and 32 bit PCM."""
    with wave.open(io.BytesIO(data)) as w:
        channels, width, rate, frames = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()
        raw = w.readframes(frames)
    return pcm(raw, width, channels), rate


def pcm(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Channels x frames as float32 in -1 .. 1 of samples of `width` bytes."""
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 2] << 24) | (b[:, 1] << 16) | (b[:, 0] << 8)) / np.float32(2**31)).astype(np.float32)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / np.float32(2 ** (8 * width - 1))
    return x.reshape(-1, channels).T


def encode_wav(audio: np.ndarray, rate: int) -> bytes:
    """Mono float audio as 16-bit PCM; louder values are clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(np.asarray(audio, np.float64) * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def decode(data: bytes, ext: str) -> tuple[np.ndarray, int]:
    if ext.lower() == "wav":
        return decode_wav(data)
    try:
        import soundfile
    except ImportError as e:
        raise RuntimeError(f"decoding {ext} needs soundfile") from e
    x, rate = soundfile.read(io.BytesIO(data), dtype="float32", always_2d=True)
    return x.T, rate


def encode(audio: np.ndarray, rate: int, ext: str, compression_level: float = 0.65) -> bytes:
    if ext.lower() == "wav":
        return encode_wav(audio, rate)
    try:
        import soundfile
    except ImportError as e:
        raise RuntimeError(f"encoding {ext} needs soundfile") from e
    out = io.BytesIO()
    more = {"compression_level": compression_level, "bitrate_mode": "CONSTANT"} if ext.lower() == "mp3" else {}
    soundfile.write(out, np.asarray(audio, np.float32), rate, format=ext.upper(), **more)
    return out.getvalue()


@lru_cache(maxsize=64)
def _kernel(up: int, down: int, zeros: int, rolloff: float) -> tuple[np.ndarray, int]:
    """Windowed-sinc filters, one for each output phase."""
    scale = min(up, down) * rolloff
    width = math.ceil(zeros * down / scale)
    t = np.arange(-width, width + down)[None, :] / down - np.arange(up)[:, None] / up
    t = np.clip(t * scale, -zeros, zeros)
    window = np.cos(t * np.pi / zeros / 2) ** 2
    return np.sinc(t) * window * (scale / down), width


def resample(audio: np.ndarray, rate: int, to: int, zeros: int = 6, rolloff: float = 0.99) -> np.ndarray:
    """Band-limited resampling of a mono signal; ceil(frames * to / rate) frames come out."""
    if rate == to or not len(audio):
        return audio.astype(np.float32)
    g = math.gcd(rate, to)
    down, up = rate // g, to // g
    kernel, width = _kernel(up, down, zeros, rolloff)
    want = -(-len(audio) * up // down)
    steps = -(-want // up)
    need = (steps - 1) * down + kernel.shape[1]
    x = np.zeros(max(need, len(audio) + width))
    x[width : width + len(audio)] = audio
    frames = np.lib.stride_tricks.as_strided(x, (steps, kernel.shape[1]), (x.strides[0] * down, x.strides[0]))
    return (frames @ kernel.T).reshape(-1)[:want].astype(np.float32)


def load_mono(data: bytes, ext: str, sample_rate: int, average: bool = True) -> np.ndarray:
    channels, rate = decode(data, ext)
    x = channels.mean(axis=0) if average else channels[0]
    return resample(x, rate, sample_rate)


def change_speed(audio: np.ndarray, speed: float, sample_rate: int) -> np.ndarray:
    """Resample to int(rate * speed) and play at the old rate: the output is `speed` times as long."""
    return resample(audio, sample_rate, int(sample_rate * speed)) if speed != 1 else audio


@dataclass(frozen=True)
class WavLayout:
    rate: int
    channels: int
    width: int  # bytes of a sample
    begin: int  # where the frames begin
    frames: int


def wav_layout(head: bytes, size: int, rest: Callable[[], bytes] = lambda: b"") -> WavLayout:
    """The layout of a WAV file of `size` bytes, from its first bytes; rest gives those after them and is only asked where they don't tell. A file that was cut off
    counts as long as it is."""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate, channels, frame, more = 12, 0, 0, 0, False
    while True:
        if at + 8 > len(head) and not more and len(head) < size:
            head, more = head + rest(), True
        if at + 8 > len(head):
            raise ValueError("a WAV file without data")
        kind, length = head[at : at + 4], int.from_bytes(head[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            channels, rate, frame = (int.from_bytes(head[at + a : at + b], "little") for a, b in ((10, 12), (12, 16), (20, 22)))
        elif kind == b"data":
            if not rate or not frame or not channels:
                raise ValueError("a WAV file without a format")
            return WavLayout(rate, channels, frame // channels, at + 8, min(length, size - at - 8) // frame)
        at += 8 + length + length % 2


def header_frames(head: bytes, size: int, ext: str, rest: Callable[[], bytes] = lambda: b"") -> tuple[int, int]:
    """Frames and rate of a file of `size` bytes, from its first bytes. rest gives the bytes after these; it is only asked where they don't tell.

    A FLAC file without a total and other formats than these two need all bytes and soundfile."""
    if ext == "wav":
        known = wav_layout(head, size, rest)
        return known.frames, known.rate
    if ext == "flac" and head[:4] == b"fLaC" and len(head) >= 26:
        bits = int.from_bytes(head[18:26], "big")  # rate 20, channels 3, width 5, frames 36
        if bits & ((1 << 36) - 1):
            return bits & ((1 << 36) - 1), bits >> 44
    try:
        import soundfile
    except ImportError as e:
        raise RuntimeError(f"reading {ext} needs soundfile") from e
    info = soundfile.info(io.BytesIO(head + rest()))
    return info.frames, info.samplerate


def load_segment(file, ext: str, start: float, duration: float, head: int = 4096) -> tuple[np.ndarray, int]:
    """Channels x frames of a stretch of a file that is open for reading at any place, and the rate. Only the header and the stretch are read of a WAV file; of
    others what soundfile has to read to get there."""
    if ext.lower() == "wav":
        first = file.read(head)
        size = file.seek(0, 2)

        def rest() -> bytes:
            file.seek(len(first))
            return file.read()

        known = wav_layout(first, size, rest)
        at = min(int(start * known.rate), known.frames)
        n = min(int(duration * known.rate), known.frames - at)
        frame = known.width * known.channels
        file.seek(known.begin + at * frame)
        return pcm(file.read(n * frame), known.width, known.channels), known.rate
    try:
        import soundfile
    except ImportError as e:
        raise RuntimeError(f"decoding {ext} needs soundfile") from e
    with soundfile.SoundFile(file) as f:
        at = min(int(start * f.samplerate), f.frames)
        f.seek(at)
        return f.read(int(duration * f.samplerate), dtype="float32", always_2d=True).T, f.samplerate


def header_seconds(data: bytes, ext: str) -> float:
    """Duration from the header alone."""
    frames, rate = header_frames(data, len(data), ext.lower())
    return frames / rate
