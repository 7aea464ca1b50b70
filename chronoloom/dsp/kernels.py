"""Kernels on one buffer of mono samples, from the published methods; no Spark here.

Harmonic-percussive separation: FitzGerald 2010. Pulse: Grosche and Mueller 2011. Beat tracking: Ellis 2007.
Mel cepstra: Davis and Mermelstein 1980. Segmentation: Ward 1963 over adjacent segments.
"""

from __future__ import annotations

import functools

import numpy as np

HOP, FRAME = 512, 2048


def frames_of(y: np.ndarray, size: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Centred frames, zeros beyond the ends; a view of a padded copy."""
    padded = np.pad(np.asarray(y, np.float32), size // 2)
    n = 1 + (len(padded) - size) // hop
    return np.lib.stride_tricks.sliding_window_view(padded, size)[:: hop][:n]


#: Frames transformed at once: they stay in the cache, and what a buffer takes besides its result doesn't grow with it.
BLOCK = 32


def spectrum(y: np.ndarray, size: int = FRAME, hop: int = HOP, *, absolute: bool = False) -> np.ndarray:
    """STFT with a Hann window, one row per frame; absolute: magnitudes only."""
    window = np.hanning(size + 1)[:-1].astype(np.float32)
    frames = frames_of(y, size, hop)
    out = np.empty((len(frames), size // 2 + 1), np.float32 if absolute else np.complex64)
    for at in range(0, len(frames), BLOCK):
        part = np.fft.rfft(frames[at : at + BLOCK] * window, axis=1)
        out[at : at + BLOCK] = np.abs(part) if absolute else part
    return out


def magnitudes(y: np.ndarray, size: int = FRAME, hop: int = HOP) -> np.ndarray:
    """|STFT| with a Hann window, one row per frame."""
    return spectrum(y, size, hop, absolute=True)


def frame_rms(y: np.ndarray, size: int = FRAME, hop: int = HOP) -> np.ndarray:
    f = frames_of(y, size, hop)
    return np.sqrt(np.einsum("ij,ij->i", f, f, dtype=np.float64) / size)


def _mel(hz):
    return 2595.0 * np.log10(1.0 + np.asarray(hz) / 700.0)


@functools.lru_cache(16)
def mel_matrix(sr: int, n_mels: int, fmax: float, size: int = FRAME) -> np.ndarray:
    """Triangles of equal area, evenly spaced in mel from 0 to fmax."""
    points = 700.0 * (10 ** (np.linspace(0, float(_mel(fmax)), n_mels + 2) / 2595.0) - 1.0)
    bins = np.linspace(0, sr / 2, size // 2 + 1)
    up = (bins - points[:-2, None]) / np.diff(points)[:-1, None]
    down = (points[2:, None] - bins) / np.diff(points)[1:, None]
    return (np.maximum(0, np.minimum(up, down)) * (2.0 / (points[2:] - points[:-2]))[:, None]).astype(np.float32)


#: Below this power nothing is told apart.
LEAST_POWER = 1e-10


def mel_level(y: np.ndarray, sr: int, n_mels: int = 64, fmax: float = 8000.0, hop: int = HOP) -> np.ndarray:
    """Mel power in dB, one row per frame."""
    power = magnitudes(y, hop=hop)
    power = np.square(power, out=power) @ mel_matrix(sr, n_mels, min(fmax, sr / 2)).T
    return 10.0 * np.log10(np.maximum(power, LEAST_POWER))


def mel_db(y: np.ndarray, sr: int, n_mels: int = 64, fmax: float = 8000.0, hop: int = HOP) -> np.ndarray:
    """Mel power in dB below the loudest cell, one row per frame."""
    level = mel_level(y, sr, n_mels, fmax, hop)
    return level - level.max(initial=10.0 * np.log10(LEAST_POWER))


def cells_of(level: np.ndarray, loudest: float, floor: float = -80.0, ceiling: float = 0.0) -> np.ndarray:
    """Levels in dB as unsigned bytes, time-major, below ``loudest``; all zero where that is silence."""
    if loudest <= 10.0 * np.log10(LEAST_POWER) + 1e-6:
        return np.zeros(level.shape, np.uint8)
    norm = (np.clip(level - loudest, floor, ceiling) - floor) / (ceiling - floor)
    return (norm * 255 + 0.5).astype(np.uint8)


def spectrogram_cells(y: np.ndarray, sr: int, n_mels: int = 64, fmax: float = 8000.0, floor: float = -80.0, ceiling: float = 0.0) -> np.ndarray:
    """``cells_of`` a whole buffer, below its own loudest cell."""
    if len(y) == 0:
        return np.zeros((1, n_mels), np.uint8)
    level = mel_level(y, sr, n_mels, fmax)
    return cells_of(level, float(level.max()), floor, ceiling)


def exact_hop(sr: int, hop: int = HOP) -> dict[str, int]:
    return {"hop_us": round(hop * 1e6 / sr), "hop_ms": round(hop * 1e3 / sr)}


def hop_rms(y: np.ndarray, sr: int, hop_ms: float = 10.0) -> np.ndarray:
    """Root mean square of hops with edges rint(i hop)."""
    hop = sr * hop_ms / 1000.0
    n = int(len(y) / hop)
    if n == 0:
        return np.zeros(0)
    edges = np.rint(np.arange(n + 1) * hop).astype(np.int64)
    y = np.asarray(y[: edges[-1]], np.float32)
    return np.sqrt(np.add.reduceat(y * y, edges[:-1]) / np.diff(edges))


def hop_peaks(y: np.ndarray, sr: int, hop_ms: float = 10.0) -> np.ndarray:
    """``hop_rms`` over the loudest; four decimals."""
    rms = hop_rms(y, sr, hop_ms)
    return np.round(rms / rms.max() if len(rms) and rms.max() > 0 else rms, 4)


def _merged(a: list, b: list) -> list:
    """Two sorted lists of arrays, cell by cell in one order (Batcher 1968)."""
    if not a or not b:
        return a or b
    if len(a) == len(b) == 1:
        return [np.minimum(a[0], b[0]), np.maximum(a[0], b[0])]
    v, w = _merged(a[::2], b[::2]), _merged(a[1::2], b[1::2])
    out = [v[0]]
    for x, z in zip(w, v[1:]):
        out += [np.minimum(x, z), np.maximum(x, z)]
    return out + w[len(v) - 1 :] + v[len(w) + 1 :]


def _ranked(a: list, b: list, rank: int) -> np.ndarray:
    """The rank-th smallest (from 1) of two sorted lists of arrays, cell by cell."""
    out = None
    for i in range(max(0, rank - len(b)), min(len(a), rank) + 1):
        most = b[rank - 1] if i == 0 else a[rank - 1] if i == rank else np.maximum(a[i - 1], b[rank - i - 1])
        out = most if out is None else np.minimum(out, most)
    return out


def _run(runs: dict[int, list], k: int) -> list:
    """The sorted lists of k blocks, from each block on; kept in ``runs``, which has those of one block."""
    if k not in runs:
        half = 1 << ((k - 1).bit_length() - 1)
        a, b = _run(runs, half), _run(runs, k - half)
        many = len(b[0]) - half
        runs[k] = _merged([z[:many] for z in a], [z[half : half + many] for z in b])
    return runs[k]


def _medians(x: np.ndarray, size: int) -> np.ndarray:
    """Medians of ``size`` rows (4 k + 3) around each row, the ends' rows repeated; by minima and maxima of whole arrays.

    Four neighbouring windows share all but three rows. The shared ones are sorted in blocks of four and merged; windows
    that overlap share those, too. Only the four middle ranks are taken of the last two lists.
    """
    n, blocks = len(x), (size - 3) // 4
    groups = -(-n // 4)
    padded = np.pad(x, ((size // 2, size // 2 + 4 * groups - n), (0, 0)), mode="edge")
    phase = [np.ascontiguousarray(padded[3 + r :: 4][: groups + blocks - 1]) for r in range(4)]
    runs = {1: _merged(_merged(phase[:1], phase[1:2]), _merged(phase[2:3], phase[3:4]))}
    half = 1 << max(0, (blocks - 1).bit_length() - 1)
    a, b = [z[:groups] for z in _run(runs, half)], [z[half : half + groups] for z in _run(runs, blocks - half)] if blocks > half else []
    middle = size // 2 + 1
    core = [_ranked(a, b, r) for r in range(middle - 3, middle + 1)]
    ends = [np.ascontiguousarray(padded[r::4][:groups]) for r in (0, 1, 2, size, size + 1, size + 2)]
    out = np.empty((groups, 4, x.shape[1]), x.dtype)
    for r in range(4):
        low, between, high = _merged(ends[r : r + 1], _merged(ends[r + 1 : r + 2], ends[r + 2 : r + 3]))
        out[:, r] = np.minimum(np.minimum(core[3], np.maximum(core[2], low)), np.minimum(np.maximum(core[1], between), np.maximum(core[0], high)))
    return out.reshape(-1, x.shape[1])[:n]


def _median_along(x: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Running medians, edges repeated. Blocks bound the copies that they make."""
    if size % 4 == 3 and size >= 7 and x.size and not np.isnan(least := x.min()):
        whole = x.view(np.int32) if least >= 0 and x.dtype == np.float32 else x  # in the same order, and faster to compare
        z = whole if axis == 0 else whole.T
        out, reach = np.empty(z.shape, z.dtype), size // 2
        high = min(len(z), 2048)
        wide = max(16, (1 << 16) // (z.itemsize * high))  # cells enough for one call, few enough for the cache
        for at in range(0, z.shape[1], wide):
            for top in range(0, len(z), high):
                low = max(0, top - reach)
                out[top : top + high, at : at + wide] = _medians(np.ascontiguousarray(z[low : top + high + reach, at : at + wide]), size)[top - low : top - low + high]
        return (out if axis == 0 else np.ascontiguousarray(out.T)).view(x.dtype)
    pad = [(0, 0), (0, 0)]
    pad[axis] = (size // 2, size - 1 - size // 2)
    view = np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, mode="edge"), size, axis=axis)
    out = np.empty_like(x)
    for at in range(0, len(x), 256):
        out[at : at + 256] = np.median(view[at : at + 256], axis=-1)
    return out


def _louder_across(mag: np.ndarray, size: int, margin: float) -> np.ndarray:
    """Cells whose median across frequency is over margin times that along time.

    For a margin of 2 the medians are taken of the numbers' upper 16 bits, half the bytes: cutting bits off keeps the order,
    and doubling adds one to the exponent. Where the two are equal, the windows themselves decide. Numbers too small for an
    exponent, infinite ones and none: the whole medians.
    """
    bits = mag.view(np.int32) if mag.dtype == np.float32 else None
    if margin != 2 or size % 2 == 0 or bits is None or not mag.size or bits.max() >= 0x7F800000 or bits.min() < 0 or ((bits > 0) & (bits < 0x800000)).any():
        return _median_along(mag, size, 1) > margin * _median_along(mag, size, 0)
    short = (bits >> 16).astype(np.uint16)
    across, along = _median_along(short, size, 1), _median_along(short, size, 0)
    twice = np.where(along > 0, along + np.uint16(0x80), along)
    keep = across > twice
    row, column = np.nonzero((across == twice) & (along > 0))
    reach, span = size // 2, np.arange(size)
    for at in range(0, len(row), 1 << 14):
        i, j = row[at : at + (1 << 14), None], column[at : at + (1 << 14), None]
        own = mag[i, np.clip(j + span - reach, 0, mag.shape[1] - 1)], mag[np.clip(i + span - reach, 0, len(mag) - 1), j]
        a, b = (np.partition(x, reach, axis=1)[:, reach] for x in own)
        keep[i[:, 0], j[:, 0]] = a > margin * b
    return keep


def percussive(y: np.ndarray, margin: float = 2.0, size: int = 31, found: np.ndarray | None = None) -> np.ndarray:
    """The percussive part: cells louder across frequency than margin times along time; overlap-added.

    found: ``spectrum(y)``, if it is there already.
    """
    if len(y) < FRAME:
        return np.zeros_like(y)
    window = np.hanning(FRAME + 1)[:-1].astype(np.float32)
    cells = spectrum(y) if found is None else found
    mag = np.abs(cells).astype(np.float32)
    keep = _louder_across(mag, size, margin)
    n, over = len(cells), FRAME // HOP
    out, weight = np.zeros((n + over - 1, HOP)), np.zeros((n + over - 1, HOP))
    square = (window**2).reshape(over, HOP)
    for k in range(over - 1, -1, -1):  # of a hop's frames the earliest is added first
        weight[k : k + n] += square[k]
    for at in range(0, n, BLOCK):
        parts = np.fft.irfft(np.where(keep[at : at + BLOCK], cells[at : at + BLOCK], 0), FRAME, axis=1) * window
        parts = parts.reshape(-1, over, HOP)
        for k in range(over - 1, -1, -1):
            out[at + k : at + k + len(parts)] += parts[:, k]
    own = slice(FRAME // 2, FRAME // 2 + len(y))
    return (out.ravel()[own] / np.maximum(weight.ravel()[own], 1e-8)).astype(np.float32)


def onset_envelope(y: np.ndarray, sr: int) -> np.ndarray:
    """Mean positive change of the log-mel spectrum, one value per frame."""
    db = mel_db(y, sr, 128, sr / 2)
    flux = np.maximum(0.0, np.diff(db, axis=0, prepend=db[:1])).mean(1)
    return flux


def autocorrelation_tempo(envelope: np.ndarray, sr: int, prior: float = 120.0) -> float:
    """Tempo of the strongest lag, weighted by a log-normal prior of one octave."""
    x = envelope - envelope.mean()
    if len(x) < 4 or not np.any(x):
        return 0.0
    n = 1 << (2 * len(x) - 1).bit_length()
    ac = np.fft.irfft(np.abs(np.fft.rfft(x, n)) ** 2)[: len(x)]
    lags = np.arange(1, len(ac))
    tempo = 60.0 * sr / HOP / lags
    weight = np.exp(-0.5 * np.log2(tempo / prior) ** 2)
    ok = (tempo >= 30) & (tempo <= 320)
    return float(tempo[ok][np.argmax((ac[1:] * weight)[ok])]) if ok.any() else 0.0


def pulse_beats(envelope: np.ndarray, sr: int, window: int = 384, low: float = 30.0, high: float = 300.0) -> np.ndarray:
    """Beat frames of the predominant local pulse: local maxima of the summed best local sinusoids."""
    n = len(envelope)
    if n < 3:
        return np.zeros(0, np.int64)
    size = min(window, max(16, n))
    win = np.hanning(size + 1)[:-1]
    tempi = np.arange(low, high + 1.0)
    t = np.arange(size)
    waves = np.exp(-2j * np.pi * np.outer(tempi / 60.0 * HOP / sr, t)) * win
    padded, total = np.pad(envelope - envelope.mean(), size // 2), np.zeros(n + size)
    for start in range(0, n, max(1, size // 8)):
        part = padded[start : start + size]
        if len(part) < size:
            break
        c = waves @ part
        k = int(np.argmax(np.abs(c)))
        total[start : start + size] += win * np.cos(2 * np.pi * tempi[k] / 60.0 * HOP / sr * t + np.angle(c[k]))
    pulse = np.maximum(0, total[size // 2 : size // 2 + n])
    return np.flatnonzero((pulse[1:-1] > pulse[:-2]) & (pulse[1:-1] >= pulse[2:]) & (pulse[1:-1] > 0.1 * pulse.max())) + 1


def dynamic_beats(envelope: np.ndarray, sr: int, bpm: float, tightness: float = 100.0) -> np.ndarray:
    """Beat frames that best agree with onsets and a steady tempo, by dynamic programming."""
    if bpm <= 0 or len(envelope) < 3 or not np.any(envelope):
        return np.zeros(0, np.int64)
    period = 60.0 * sr / HOP / bpm
    local = envelope / (envelope.std() or 1.0)
    kernel = np.exp(-0.5 * (np.arange(-round(period), round(period) + 1) * 32.0 / period) ** 2)
    local = np.convolve(local, kernel, "same")
    lags = np.arange(-2 * round(period), -round(period / 2) + 1)
    cost = -tightness * np.log(-lags / period) ** 2
    score, back = local.copy(), np.full(len(local), -1)
    for i in range(len(local)):
        low, high = i + lags[0], i + lags[-1] + 1
        if high > 0:
            s = cost[max(0, -low) :] + score[max(0, low) : high]
            k = int(np.argmax(s))
            if s[k] > 0:
                score[i], back[i] = local[i] + s[k], max(0, low) + k
    tail = max(1, round(period))
    i = len(score) - tail + int(np.argmax(score[-tail:])) if len(score) > tail else int(np.argmax(score))
    out = []
    while i >= 0:
        out.append(i)
        i = back[i]
    return np.array(out[::-1], np.int64)


def analyse(y: np.ndarray, sr: int, *, tracker: str = "auto", locked_bpm: float | None = None) -> dict:
    """Beats, energies, tempo, an independent reference tempo of one buffer."""
    if tracker not in ("auto", "plp", "beat"):
        raise ValueError(f"unknown tracker {tracker!r}")
    env = onset_envelope(y, sr)
    ref = autocorrelation_tempo(env, sr)
    if tracker == "auto":
        tracker = "plp" if len(y) / sr > 600 else "beat"
    beats = pulse_beats(env, sr) if tracker == "plp" else dynamic_beats(env, sr, locked_bpm or ref, 200.0 if locked_bpm else 100.0)
    ms = np.rint(beats * HOP * 1000.0 / sr).astype(np.int64)
    gaps = np.sort(np.diff(ms))
    rms = frame_rms(y)
    energy = rms[np.minimum(beats, len(rms) - 1)] if len(beats) else np.zeros(0)
    most = energy.max(initial=0.0)
    return {"beats": ms.tolist(), "energy": (energy / most if most > 0 else np.zeros_like(energy)).tolist(), "bpm": float(60000.0 / gaps[len(gaps) // 2]) if len(gaps) and gaps[len(gaps) // 2] else 0.0, "ref_bpm": ref}


def limit(y: np.ndarray, sr: int, *, threshold: float = 0.85, ratio: float = 8.0) -> tuple[np.ndarray, list[dict]]:
    """A peak limiter: sliding maximum (52 ms), static gain, sliding mean (50 ms); regions of 3 dB or more."""
    if len(y) == 0:
        return y, []
    x = np.asarray(y, np.float64)
    size = max(1, round(sr * 0.052))
    padded = np.pad(np.abs(x), (size // 2, size - size // 2 - 1), mode="edge")
    env = _sliding_max(padded, size)
    gain = np.where(env > threshold, (threshold / np.maximum(env, threshold)) ** (1 - 1 / ratio), 1.0)
    size = max(1, round(sr * 0.05))
    sums = np.cumsum(np.concatenate([[0.0], np.pad(gain, (size // 2, size - size // 2 - 1), mode="edge")]))
    gain = (sums[size:] - sums[:-size]) / size
    db = -20.0 * np.log10(np.maximum(gain, 1e-9))
    at = np.flatnonzero(db >= 3.0)
    regions = []
    for part in np.split(at, np.flatnonzero(np.diff(at) > 0.15 * sr) + 1) if len(at) else []:
        if (part[-1] - part[0]) / sr >= 0.02:
            regions.append({"start_s": part[0] / sr, "end_s": part[-1] / sr, "peak_amp": float(np.abs(x[part[0] : part[-1] + 1]).max()), "max_gr_db": float(db[part[0] : part[-1] + 1].max())})
    return (x * gain).astype(y.dtype), regions


def _sliding_max(x: np.ndarray, size: int) -> np.ndarray:
    """Maximum of each window, by running maxima within blocks (van Herk 1992)."""
    n = len(x) - size + 1
    padded = np.pad(x, (0, -len(x) % size), constant_values=-np.inf)
    blocks = padded.reshape(-1, size)
    left = np.maximum.accumulate(blocks, axis=1).ravel()
    right = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(right[:n], left[size - 1 : size - 1 + n])


def silences(y: np.ndarray, sr: int, ratio: float = 0.05, least_s: float = 1.5) -> list[float]:
    """Centres (seconds) of runs quieter than ratio times the 95th-percentile frame."""
    rms = frame_rms(y)
    ref = np.percentile(rms, 95) if len(rms) else 0.0
    if ref <= 0:
        return []
    quiet = np.concatenate([[False], rms < ratio * ref, [False]]).astype(int)
    start, end = np.flatnonzero(np.diff(quiet) == 1), np.flatnonzero(np.diff(quiet) == -1)
    long = end - start >= max(1, int(least_s * sr / HOP))
    return ((start[long] + end[long]) / 2 * HOP / sr).tolist()


def mfcc(y: np.ndarray, sr: int, n: int = 13) -> np.ndarray:
    db = mel_db(y, sr, 128, sr / 2)
    k = np.arange(db.shape[1])
    basis = np.cos(np.pi / db.shape[1] * np.outer(np.arange(n), k + 0.5)) * np.sqrt(2.0 / db.shape[1])
    return db @ basis.T


def segment(features: np.ndarray, k: int) -> list[int]:
    """First rows of k contiguous segments: adjacent segments merge by the least growth of squared error, on a heap."""
    import heapq

    n = len(features)
    k = max(1, min(k, n))
    size, total = np.ones(n), features.astype(np.float64).copy()
    nxt, prev, alive = list(range(1, n)) + [-1], [-1, *range(n - 1)], [True] * n
    stamp = [0] * n

    def cost(i: int, j: int) -> float:
        d = total[i] / size[i] - total[j] / size[j]
        return float(size[i] * size[j] / (size[i] + size[j]) * (d @ d))

    heap = [(cost(i, i + 1), i, i + 1, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    left = n
    while left > k and heap:
        _, i, j, a, b = heapq.heappop(heap)
        if not (alive[i] and alive[j] and nxt[i] == j and stamp[i] == a and stamp[j] == b):
            continue
        size[i] += size[j]
        total[i] += total[j]
        alive[j], nxt[i] = False, nxt[j]
        stamp[i] += 1
        left -= 1
        if nxt[i] >= 0:
            prev[nxt[i]] = i
            heapq.heappush(heap, (cost(i, nxt[i]), i, nxt[i], stamp[i], stamp[nxt[i]]))
        if prev[i] >= 0:
            heapq.heappush(heap, (cost(prev[i], i), prev[i], i, stamp[prev[i]], stamp[i]))
    return [i for i in range(n) if alive[i]]


def boundaries(y: np.ndarray, sr: int, target_s: float) -> list[float]:
    """Seconds at which about duration / target segments of alike sound begin, without 0."""
    rows = pooled(y, sr)
    return [rows[i][0] for i in segment(np.array([f for _, f in rows]), max(2, round(len(y) / sr / target_s))) if i]


def pooled(y: np.ndarray, sr: int) -> list[tuple[float, list[float]]]:
    """Mean cepstral features of about every second, with the second at which each begins."""
    frames = mfcc(y, sr)
    step = max(1, round(sr / HOP))
    starts = np.arange(0, len(frames), step)
    means = np.add.reduceat(frames, starts) / np.diff(np.append(starts, len(frames)))[:, None]
    return [(float(i * step * HOP / sr), f.tolist()) for i, f in enumerate(means)]


def texture(y: np.ndarray, sr: int) -> dict:
    """Variation of loudness, percussive share and flux of a chapter's sound; None under a second."""
    if len(y) < sr:
        return {"rms_cv": None, "percussive": None, "flux": None}
    rms, cells = frame_rms(y), spectrum(y)
    mag = np.abs(cells)
    flux = np.maximum(0, np.diff(mag, axis=0)).mean() / max(1e-9, float(mag.mean()))
    energy = float(np.sum(np.asarray(y, np.float64) ** 2))
    return {"rms_cv": float(rms.std() / rms.mean()) if rms.mean() > 0 else 0.0, "percussive": float(np.sum(percussive(y, found=cells).astype(np.float64) ** 2)) / energy if energy > 0 else 0.0, "flux": float(flux)}


def resample(y: np.ndarray, sr: int, to: int = 16_000) -> np.ndarray:
    """Samples at another rate, by straight lines; before a lower rate, what it can't hold is filtered off."""
    if sr == to or len(y) == 0:
        return y
    if sr > to:
        half = 16 * -(-sr // to)
        x = np.arange(-half, half + 1)
        taps = np.sinc(0.9 * to / sr * x) * np.hanning(2 * half + 3)[1:-1]
        y = np.convolve(y, (taps / taps.sum()).astype(np.float32), "same")[: len(y)] if len(y) > 2 * half else y
    n = int(len(y) * to / sr)
    return np.interp(np.arange(n) * sr / to, np.arange(len(y)), y).astype(np.float32)
