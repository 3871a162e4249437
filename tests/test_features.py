import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelot.functions import features as X
from wavelot.functions.audio import change_speed, decode_wav, encode_wav, header_seconds, resample

AUDIO = np.random.RandomState(42).randn(16000).astype(np.float32)


@pytest.mark.parametrize(("name", "frames"), [("Fbank", 101), ("KaldiFbank", 100), ("WhisperFbank", 100)])
def test_shapes(name, frames):
    ex = X.extractor(name)
    out = ex.extract(AUDIO)
    assert out.shape == (frames, 80) and out.dtype == np.float32 and np.isfinite(out).all()
    assert ex.frame_shift == pytest.approx(0.01)
    assert (ex.extract(np.stack([AUDIO, AUDIO])) == out).all()


@pytest.mark.parametrize("name", list(X.EXTRACTORS))
def test_a_tone_lands_in_its_bin(name):
    ex, f = X.extractor(name), 1000.0
    out = ex.extract(np.sin(2 * np.pi * f * np.arange(16000) / 16000))
    if name == "Fbank":
        centres = X.htk_hz(np.linspace(0, X.htk_mel(8000), 82))[1:-1]
    elif name == "WhisperFbank":
        centres = X.slaney_hz(np.linspace(0, X.slaney_mel(8000), 82))[1:-1]
    else:
        mel = lambda h: 1127 * math.log(1 + h / 700)
        centres = 700 * (np.exp(np.linspace(mel(20), mel(7600), 82) / 1127) - 1)[1:-1]
    assert abs(int(out[50].argmax()) - int(np.abs(centres - f).argmin())) <= 1


def test_fbank_by_hand():
    """One frame, from the definition."""
    x = np.pad(AUDIO.astype(float), 200, mode="reflect")[160 * 7 : 160 * 7 + 400]
    window = np.array([0.5 - 0.5 * math.cos(2 * math.pi * i / 400) for i in range(400)])
    spec = np.array([abs(sum(x[t] * window[t] * np.exp(-2j * math.pi * k * t / 400) for t in range(400))) for k in range(0, 201, 50)])
    assert np.allclose(np.abs(X.stft(AUDIO.astype(float), 400, 160, X.hann(400)))[7][::50], spec, atol=1e-8)


def test_whisper_by_hand():
    """All values of a short signal, by plain sums over the public definition."""
    x = AUDIO[:640].astype(float)
    padded = np.concatenate([x[200:0:-1], x, x[-2:-202:-1]])
    top = 15 + 27 * math.log(8000 / 1000) / math.log(6.4)
    edges = [m * 200 / 3 if m < 15 else 1000 * 6.4 ** ((m - 15) / 27) for m in (top * j / 81 for j in range(82))]
    rows = []
    for frame in range(4):
        own = [padded[160 * frame + i] * (0.5 - 0.5 * math.cos(2 * math.pi * i / 400)) for i in range(400)]
        power = []
        for k in range(201):
            re = math.fsum(v * math.cos(2 * math.pi * k * i / 400) for i, v in enumerate(own))
            im = math.fsum(v * math.sin(2 * math.pi * k * i / 400) for i, v in enumerate(own))
            power.append(re * re + im * im)
        mel = []
        for left, mid, right in zip(edges, edges[1:], edges[2:], strict=False):
            mel.append(math.fsum(a * max(0.0, min((40 * k - left) / (mid - left), (right - 40 * k) / (right - mid))) * 2 / (right - left) for k, a in enumerate(power)))
        rows.append([math.log10(max(v, 1e-10)) for v in mel])
    most = max(map(max, rows))
    want = np.array([[(max(v, most - 8) + 4) / 4 for v in row] for row in rows])
    assert np.abs(X.WhisperFbank().extract(AUDIO[:640]) - want).max() < 1e-4


def test_whisper_range():
    out = X.WhisperFbank().extract(AUDIO)
    assert out.max() - out.min() <= 2.0 + 1e-6


def test_slaney_scale_and_area():
    for f in (0.0, 100.0, 999.0, 1000.0, 4000.0):
        assert float(X.slaney_hz(X.slaney_mel(f))) == pytest.approx(f)
    assert float(X.slaney_mel(1000)) == pytest.approx(15)
    wide = X.mel_filters(20, 8192, 16000, scale="slaney", area=True)
    assert np.allclose(wide.sum(axis=0) * 16000 / 8192, 1, atol=0.02)


def test_spec_augment():
    x = X.Fbank().extract(AUDIO)
    aug = X.SpecAugment(time_warp_factor=10, p=1.0)
    a, b = (aug.apply(x, np.random.default_rng(7)) for _ in range(2))
    assert a.shape == x.shape and (a == b).all() and (a != x).any()
    assert (X.SpecAugment(p=0.0).apply(x, np.random.default_rng(7)) == x).all()
    assert X.SpecAugment.from_state(aug.state_dict()) == aug
    for n in (0, 1, 5):
        assert X.SpecAugment(p=1.0, num_frame_masks=0).apply(x[:n], np.random.default_rng(1)).shape == (n, 80)
        assert aug.apply(x[:n], np.random.default_rng(1)).shape == (n, 80)
    padded = aug.apply(x, np.random.default_rng(3), length=60)
    assert (padded[60:] == x[60:]).all()
    assert X.warp_time(x[:20], 80, np.random.default_rng(1)) is not None


def test_wav_round_trip():
    x = (np.sin(np.arange(4000) * 0.1) * 0.5).astype(np.float32)
    data = encode_wav(x, 8000)
    back, rate = decode_wav(data)
    assert rate == 8000 and np.abs(back[0] - x).max() < 1e-4 and header_seconds(data, "wav") == 0.5


@pytest.mark.parametrize(("rate", "to"), [(16000, 8000), (8000, 16000), (44100, 16000), (16000, 14400)])
def test_resampling_keeps_a_tone(rate, to):
    x = np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
    y = resample(x, rate, to)
    assert len(y) == math.ceil(len(x) * to / rate)
    want = np.sin(2 * np.pi * 440 * np.arange(len(y)) / to)
    assert np.abs(y - want)[200:-200].max() < 0.01


def test_speed_is_the_ratio_of_lengths():
    assert len(change_speed(AUDIO, 0.9, 16000)) == 14400
    assert len(change_speed(AUDIO, 1.1, 16000)) == 17600


def test_unknown_features():
    with pytest.raises(ValueError, match="unknown"):
        X.extractor("x")


def test_padding_stays_when_batches_are_warped(spark):
    from wavelot.functions.features import SpecAugment, spec_augment, spec_augment_batch, time_warp, time_warp_batch

    rnd = np.random.default_rng(4)
    lens = [40, 25, 3, 0]
    batch = [np.where(np.arange(40)[:, None] < n, rnd.normal(size=(40, 5)), -23.0).astype(np.float32).tolist() for n in lens]
    df = spark.createDataFrame([(k, batch, lens) for k in range(6)] + [(6, batch, None), (7, None, lens), (8, [], [])], "k long, f array<array<array<float>>>, lens array<int>")
    warped = df.select("k", "f", time_warp_batch(F.col("f"), F.xxhash64("k"), 1.0, 4, F.col("lens")).alias("g"), spec_augment_batch(F.col("f"), F.xxhash64("k"), SpecAugment(time_warp_factor=4, p=1.0), F.col("lens")).alias("h")).collect()
    changed = 0
    for r in warped:
        if r["k"] >= 7:
            assert r["g"] == r["f"] == r["h"]
            continue
        f, g, h = (np.array(r[c]) for c in "fgh")
        assert f.shape == g.shape == h.shape
        if r["k"] < 6:
            for i, n in enumerate(lens):
                assert np.array_equal(g[i, n:], f[i, n:]) and np.array_equal(h[i, n:], f[i, n:])
            changed += not np.array_equal(g[0], f[0])
            assert np.array_equal(g[2], f[2])  # too short to warp
    assert changed >= 3
    again = df.where("k < 6").select(time_warp_batch(F.col("f"), F.xxhash64("k"), 1.0, 4, F.col("lens")).alias("g")).collect()
    assert [r["g"] for r in again] == [r["g"] for r in warped if r["k"] < 6]
    one = spark.createDataFrame([(k, batch[1], 25) for k in range(6)], "k long, f array<array<float>>, n int")
    for r in one.select("f", time_warp(F.col("f"), F.xxhash64("k"), 1.0, 4, F.col("n")).alias("g"), spec_augment(F.col("f"), F.xxhash64("k"), SpecAugment(p=1.0), F.col("n")).alias("h")).collect():
        assert r["g"][25:] == r["f"][25:] == r["h"][25:]
