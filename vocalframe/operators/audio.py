"""Arrow batch jobs for audio work Spark has no expression for (X1, X6-X9,
X11-X14): decoding, spectral features and augmentation.

Each job is ``mapInPandas`` over rows Spark has already partitioned; the numpy
helpers below are small per-row kernels (no library behind a wrapper). Random
draws come from numpy generators seeded per row (D8), so a retried task
reproduces its output exactly.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalframe.operators import numbering

SAMPLE_RATE = 16000
N_FFT, HOP, N_MELS = 400, 160, 80
CHUNK_SECONDS = 30


# ---- X1: WAV decoding -------------------------------------------------------
def decode_wav_bytes(data: bytes) -> tuple[np.ndarray, int]:
    """PCM WAV -> (channels x samples float32 in [-1, 1], rate)."""
    with wave.open(io.BytesIO(data), "rb") as w:
        ch, width, rate, n = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()
        raw = w.readframes(n)
    if width == 1:
        x = (np.frombuffer(raw, dtype=np.uint8).astype(np.float32) - 128.0) / 128.0
    elif width == 2:
        x = np.frombuffer(raw, dtype="<i2").astype(np.float32) / 32768.0
    elif width == 3:
        b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)
        v = np.where(v >= 1 << 23, v - (1 << 24), v)
        x = v.astype(np.float32) / float(1 << 23)
    elif width == 4:
        x = np.frombuffer(raw, dtype="<i4").astype(np.float32) / float(1 << 31)
    else:
        raise ValueError(f"unsupported sample width {width}")
    return x.reshape(-1, ch).T.copy(), rate


DECODED = T.StructType([T.StructField("path", T.StringType()),
                        T.StructField("channels", T.ArrayType(T.ArrayType(T.FloatType()))),
                        T.StructField("sampling_rate", T.IntegerType())])


def decode_wav(files: DataFrame) -> DataFrame:
    """``binaryFile`` rows (path, content) -> (path, channels, sampling_rate)."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [decode_wav_bytes(bytes(c)) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "channels": [[list(r) for r in x] for x, _ in out],
                                "sampling_rate": [r for _, r in out]})
    return files.select("path", "content").mapInPandas(run, DECODED)


def encode_wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """16-bit PCM WAV of a mono float signal (used to materialise test audio)."""
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(int(rate))
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return buf.getvalue()


# ---- X6: log-mel features ---------------------------------------------------
def _hz_to_mel(f):
    f = np.asarray(f, dtype=np.float64)
    lin = f / (200.0 / 3)
    log = 15.0 + np.log(np.maximum(f, 1e-10) / 1000.0) / (np.log(6.4) / 27.0)
    return np.where(f >= 1000.0, log, lin)


def _mel_to_hz(m):
    m = np.asarray(m, dtype=np.float64)
    lin = m * (200.0 / 3)
    log = 1000.0 * np.exp((np.log(6.4) / 27.0) * (m - 15.0))
    return np.where(m >= 15.0, log, lin)


def mel_filterbank(sr: int = SAMPLE_RATE, n_fft: int = N_FFT, n_mels: int = N_MELS) -> np.ndarray:
    """Slaney-scale triangular filters with area normalisation (n_mels x bins)."""
    bins = np.arange(1 + n_fft // 2) * (sr / n_fft)
    corners = _mel_to_hz(np.linspace(0.0, _hz_to_mel(sr / 2), n_mels + 2))
    out = np.empty((n_mels, len(bins)), np.float32)
    for k in range(n_mels):
        left, peak, right = corners[k:k + 3]
        # a triangle of area one over (left, peak, right)
        out[k] = np.interp(bins, [left, peak, right], [0.0, 2.0 / (right - left), 0.0], left=0.0, right=0.0)
    return out


def log_mel(samples: np.ndarray, pad_seconds: float | None = CHUNK_SECONDS,
            filters: np.ndarray | None = None) -> np.ndarray:
    """80 x frames log-mel: Hann-windowed centred STFT (400/160), power, mel,
    log10 with floor, dynamic range clamp to max - 8, then (x + 4) / 4."""
    x = np.asarray(samples, dtype=np.float32)
    if pad_seconds:
        n = int(pad_seconds * SAMPLE_RATE)
        x = np.pad(x[:n], (0, max(0, n - len(x))))
    xp = np.pad(x, (N_FFT // 2, N_FFT // 2), mode="reflect" if len(x) > N_FFT // 2 else "constant")
    frames = 1 + (len(xp) - N_FFT) // HOP
    idx = np.arange(N_FFT)[None, :] + HOP * np.arange(frames)[:, None]
    win = np.hanning(N_FFT + 1)[:-1].astype(np.float32)
    spec = np.abs(np.fft.rfft(xp[idx] * win, axis=1)) ** 2
    spec = spec[:-1] if frames > 1 else spec  # drop the last frame, as the reference extractor does
    fb = mel_filterbank() if filters is None else filters
    mel = fb @ spec.T
    lg = np.log10(np.maximum(mel, 1e-10))
    lg = np.maximum(lg, lg.max() - 8.0)
    return ((lg + 4.0) / 4.0).astype(np.float32)


FEATURES = T.StructType([T.StructField("key", T.LongType()),
                         T.StructField("features", T.ArrayType(T.ArrayType(T.FloatType())))])


def log_mel_job(df: DataFrame, key: str, samples: str, pad_seconds: float | None = CHUNK_SECONDS) -> DataFrame:
    """X6 over a table of 16 kHz waveforms: (key, features ARRAY<ARRAY<FLOAT>>)."""
    def run(it):
        fb = mel_filterbank()  # once per task, not per row
        for pdf in it:
            feats = [[list(r) for r in log_mel(np.asarray(s, np.float32), pad_seconds, fb)]
                     for s in pdf[samples]]
            yield pd.DataFrame({"key": pdf[key].astype("int64"), "features": feats})
    return df.select(key, samples).mapInPandas(run, FEATURES)


# ---- X7-X13: augmentation kernels ------------------------------------------
def stretched_to(x: np.ndarray, n_out: int) -> np.ndarray:
    """``x`` read at ``n_out`` even steps from its first to its last sample: output i lies
    i * (n - 1) / (n_out - 1) samples in, between its two neighbours."""
    if n_out <= 0 or not len(x):
        return np.zeros(max(n_out, 0), np.float32)
    at = np.arange(n_out) * ((len(x) - 1) / max(n_out - 1, 1))
    low = np.minimum(at.astype(np.int64), len(x) - 1)
    high = np.minimum(low + 1, len(x) - 1)
    return (x[low] + (x[high] - x[low]) * (at - low)).astype(np.float32)


def add_noise_snr(x: np.ndarray, rng: np.random.Generator, lo: float = 5.0, hi: float = 20.0) -> np.ndarray:
    """Gaussian noise at an SNR drawn uniformly in [lo, hi] dB."""
    snr = rng.uniform(lo, hi)
    rms = float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))) if len(x) else 0.0
    noise_rms = rms / (10 ** (snr / 20))
    return (x + rng.normal(0.0, noise_rms, size=len(x))).astype(np.float32)


def time_stretch(x: np.ndarray, rate: float, n_fft: int = 512, hop: int = 128) -> np.ndarray:
    """Phase-vocoder time stretch (output length ~ len / rate), by one method for every
    length: the clip is framed with silence of one window before and behind it."""
    if rate == 1.0 or not len(x):
        return x.astype(np.float32)
    n_out, lead = int(round(len(x) / rate)), n_fft
    x = np.concatenate((np.zeros(lead), x, np.zeros(2 * n_fft)))
    win = np.hanning(n_fft + 1)[:-1]
    frames = 1 + (len(x) - n_fft) // hop
    idx = np.arange(n_fft)[None, :] + hop * np.arange(frames)[:, None]
    stft = np.fft.rfft(x[idx] * win, axis=1)
    steps = np.arange(0, frames - 1, rate)
    omega = 2 * np.pi * hop * np.arange(stft.shape[1]) / n_fft
    phase = np.angle(stft[0])
    out = np.zeros((len(steps), stft.shape[1]), dtype=complex)
    for t, s in enumerate(steps):
        i = int(s)
        frac = s - i
        a, b = stft[i], stft[min(i + 1, frames - 1)]
        mag = (1 - frac) * np.abs(a) + frac * np.abs(b)
        out[t] = mag * np.exp(1j * phase)
        dphi = np.angle(b) - np.angle(a) - omega
        dphi -= 2 * np.pi * np.round(dphi / (2 * np.pi))
        phase = phase + omega + dphi
    y = np.zeros(n_fft + hop * (len(steps) - 1))
    norm = np.zeros_like(y)
    for t in range(len(steps)):
        y[t * hop:t * hop + n_fft] += np.fft.irfft(out[t], n=n_fft) * win
        norm[t * hop:t * hop + n_fft] += win ** 2
    y = y / np.where(norm > 1e-8, norm, 1.0)
    first = int(round(lead / rate))
    return np.pad(y, (0, max(0, first + n_out - len(y))))[first:first + n_out].astype(np.float32)


def pitch_shift(x: np.ndarray, semitones: float) -> np.ndarray:
    """Stretch by 2^(-s/12), then resample back to the original length."""
    if semitones == 0:
        return x.astype(np.float32)
    r = 2.0 ** (semitones / 12.0)
    return stretched_to(time_stretch(x, 1.0 / r), len(x))


def apply_impulse_response(x: np.ndarray, ir: np.ndarray) -> np.ndarray:
    """X11: FFT convolution with an impulse response, length unchanged."""
    if len(x) == 0 or len(ir) == 0:
        return x.astype(np.float32)
    n = len(x) + len(ir) - 1
    size = 1 << (n - 1).bit_length()
    y = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(ir, size), size)[:len(x)]
    return y.astype(np.float32)


def augment_one(x: np.ndarray, rate: int, seed: int, irs: Sequence[np.ndarray] = (),
                speed_factors: Sequence[float] = (0.9, 1.0, 1.1), noise_p: float = 0.5,
                pitch_p: float = 0.5, reverb_p: float = 0.5) -> np.ndarray:
    """Clip (X4), speed choice (X12), then the composition (X13): noise,
    pitch shift, reverb -- each firing with its own probability, in order."""
    rng = np.random.default_rng(seed)
    x = np.clip(np.asarray(x, np.float32), -1.0, 1.0)
    speed = float(rng.choice(np.asarray(speed_factors)))
    if speed != 1.0:
        x = time_stretch(x, speed)
    if rng.uniform() < noise_p:
        x = add_noise_snr(x, rng)
    if rng.uniform() < pitch_p:
        x = pitch_shift(x, rng.uniform(-2.0, 2.0))
    if irs and rng.uniform() < reverb_p:
        x = apply_impulse_response(x, irs[int(rng.integers(len(irs)))])
    return x.astype(np.float32)


AUGMENTED = T.StructType([T.StructField("key", T.LongType()), T.StructField("epoch", T.LongType()),
                          T.StructField("samples", T.ArrayType(T.FloatType()))])


def with_response(df: DataFrame, seed: str, responses: DataFrame, key: str, samples: str, name: str = "ir") -> DataFrame:
    """X11: ``df`` with an impulse response ``name`` for each row, drawn by the row's seed from all
    rows of ``responses``, which are numbered by ``key``. Without responses it is null."""
    n = responses.count()
    if not n:
        return df.withColumn(name, F.lit(None).cast("array<float>"))
    numbered = numbering.number_rows(responses.select(key, samples), [key], "_no").select("_no", F.col(samples).alias(name))
    return df.withColumn("_no", F.pmod(F.xxhash64(F.lit("ir"), F.col(seed)), F.lit(n))).join(numbered, "_no").drop("_no")


def augment_job(df: DataFrame, key: str, samples: str, rate: str, seed: str, epoch: str,
                ir: str | None = None) -> DataFrame:
    """One augmented waveform per (row, epoch). ``ir`` is the column of each row's impulse
    response (``with_response``); a null one means no reverberation."""
    names = [key, samples, rate, seed, epoch, *([ir] if ir else [])]

    def run(it):
        for pdf in it:
            irs = pdf[ir] if ir else [None] * len(pdf)
            outs = [list(augment_one(np.asarray(s, np.float32), int(r), int(sd), [] if i is None else [np.asarray(i, np.float32)]))
                    for s, r, sd, i in zip(pdf[samples], pdf[rate], pdf[seed], irs)]
            yield pd.DataFrame({"key": pdf[key].astype("int64"), "epoch": pdf[epoch].astype("int64"),
                                "samples": outs})
    return df.select(*names).mapInPandas(run, AUGMENTED)


def rms(c) -> F.Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v) / F.greatest(F.size(c), F.lit(1)))
