"""Signal kernels in numpy, used inside Arrow functions: spectra, mel bands, cepstra, pitch, resampling."""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np
from numpy.typing import NDArray

Floats = NDArray[np.float64]


def frames_of(x: Floats, size: int, hop: int) -> Floats:
    """Frames of ``size`` every ``hop`` samples; a shorter signal is padded to one frame."""
    x = np.pad(x, (0, max(0, size - len(x))))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def power_spectrum(x: Floats, n_fft: int = 1024, hop: int = 256) -> Floats:
    """Frames by frequencies: squared magnitudes under a Hann window."""
    return np.abs(np.fft.rfft(frames_of(x, n_fft, hop) * np.hanning(n_fft), axis=1)) ** 2


def spectral_shape(power: Floats, sr: int, n_fft: int = 1024) -> dict[str, Floats]:
    """For each frame: centroid, 85 % rolloff, peak frequency, and the band from 5 to 95 % of the power."""
    freqs = np.fft.rfftfreq(n_fft, 1 / sr)
    total = np.cumsum(power, axis=1)
    reach = lambda share: freqs[(total >= share * total[:, -1:]).argmax(axis=1)]
    return {"centroid": power @ freqs / (power.sum(axis=1) + 1e-12), "rolloff": reach(0.85), "peak": freqs[power.argmax(axis=1)], "band": reach(0.95) - reach(0.05)}


def mel(f: Floats | float) -> Floats:
    return 2595.0 * np.log10(1.0 + np.asarray(f) / 700.0)


def hertz(m: Floats | float) -> Floats:
    return 700.0 * (10.0 ** (np.asarray(m) / 2595.0) - 1.0)


@lru_cache(64)
def mel_bands(n_mels: int, n_fft: int, sr: int, low: float, high: float) -> Floats:
    """Triangular weights, bands by frequencies; a band's empty side weighs nothing."""
    edge = np.floor((n_fft + 1) * hertz(np.linspace(mel(low), mel(high), n_mels + 2)) / sr).astype(int)
    at = np.arange(n_fft // 2 + 1)
    a, b, c = edge[:-2, None], edge[1:-1, None], edge[2:, None]
    rising, falling = (at - a) / np.maximum(b - a, 1), (c - at) / np.maximum(c - b, 1)
    return np.where((at >= a) & (at < b), rising, np.where((at >= b) & (at < c), falling, 0.0))


@lru_cache(8)
def cosine_basis(n: int) -> Floats:
    """The orthonormal cosine transform of the second kind, as a matrix."""
    k, i = np.arange(n)[:, None], np.arange(n)
    return np.cos(np.pi * k * (2 * i + 1) / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


def cepstrum(power: Floats, sr: int, n: int = 13, n_mels: int = 26, n_fft: int = 1024) -> Floats:
    """The mean mel cepstral coefficients 1 to ``n``."""
    bands = mel_bands(n_mels, n_fft, sr, 50.0, min(7800.0, sr / 2))
    return (np.log(power @ bands.T + 1e-12) @ cosine_basis(n_mels).T)[:, 1 : n + 1].mean(axis=0)


def pitch(x: Floats, sr: int, low: float = 50.0, high: float = 2000.0, frame_ms: float = 40.0, hop_ms: float = 20.0, start: int = 0, own: int | None = None) -> Floats:
    """The pitch of voiced frames: the lag of the greatest normalised autocorrelation, if it is over 0.3.

    The shortest lag is allowed to win, so tones whose period is long against it come out as its frequency. Of a part of a
    signal that begins at place ``start``, the frames that begin among its first ``own`` samples.
    """
    size, hop = int(sr * frame_ms / 1000), int(sr * hop_ms / 1000)
    first, last = max(int(sr / high), 2), min(int(sr / low), size // 2)
    if len(x) < size or last <= first or hop < 1:
        return np.zeros(0)
    stop = max(len(x) - size, 0)  # a frame that the signal ends with is left out
    rows = np.lib.stride_tricks.sliding_window_view(x, size)[-start % hop : stop if own is None else min(stop, own) : hop]
    rows = rows[np.sqrt((rows**2).mean(axis=1)) >= 1e-4]
    rows = rows - rows.mean(axis=1, keepdims=True)
    n = 1 << (2 * size - 1).bit_length()
    auto = np.fft.irfft(np.abs(np.fft.rfft(rows, n, axis=1)) ** 2, n, axis=1)[:, :size]
    auto = auto[auto[:, 0] > 0]
    part = auto[:, first:last] / auto[:, :1]
    best = part.argmax(axis=1) if len(part) else np.zeros(0, int)
    return sr / (first + best[part[np.arange(len(part)), best] > 0.3]) if len(part) else np.zeros(0)


def resampled(x: Floats, sr_in: int, sr_out: int, zeros: int = 10, beta: float = 5.0, first: int = 0, start: int = 0, size: int | None = None) -> Floats:
    """A change of rate by a Kaiser-windowed sinc filter, ``zeros`` crossings on each side at the lower rate.

    Of a part of a signal, whose first sample's place is ``first``, the ``size`` results from place ``start`` on.
    """
    if not len(x):
        return x
    up, down = sr_out // gcd(sr_in, sr_out), sr_in // gcd(sr_in, sr_out)
    size = -(-len(x) * up // down) if size is None else size
    if up == down:
        return x[start - first : start - first + size]
    half = zeros * max(up, down)
    taps = np.sinc(np.arange(-half, half + 1) / max(up, down)) * np.kaiser(2 * half + 1, beta)
    taps *= up / taps.sum()
    at = (start + np.arange(size)) * down  # places among the samples of the common rate
    reach = half // up + 1
    near = at[:, None] // up + np.arange(-reach, reach + 1)
    tap = at[:, None] - near * up + half
    ok = (near >= first) & (near < first + len(x)) & (tap >= 0) & (tap < len(taps))
    return (np.where(ok, x[np.clip(near - first, 0, len(x) - 1)] * taps[np.clip(tap, 0, len(taps) - 1)], 0.0)).sum(axis=1)
