"""Grid measures in numpy, for comparison: (grids, h, w) in, a dict of arrays out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

EPS = 1e-8


def _mean(x: np.ndarray) -> np.ndarray:
    return x.mean(axis=(1, 2))


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(len(x), -1)


def _std(x: np.ndarray) -> np.ndarray:
    return _flat(x).std(axis=1, ddof=1)


def _shift(x: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """x at (y + dy, x + dx), zero outside."""
    out = np.zeros_like(x)
    h, w = x.shape[1:]
    out[:, max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = x[:, max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


# --- stencils


def gradients(x: np.ndarray) -> dict[str, np.ndarray]:
    """Periodic central differences and the five-point Laplacian."""
    gx = (np.roll(x, -1, 2) - np.roll(x, 1, 2)) / 2
    gy = (np.roll(x, -1, 1) - np.roll(x, 1, 1)) / 2
    lap = np.roll(x, -1, 1) + np.roll(x, 1, 1) + np.roll(x, -1, 2) + np.roll(x, 1, 2) - 4 * x
    m = np.hypot(gx, gy)
    top = m.max(axis=(1, 2), keepdims=True)
    z = (m - m.mean(axis=(1, 2), keepdims=True)) / np.maximum(_std(m), 1e-12)[:, None, None]
    return {
        "gradient_x": _mean(np.abs(gx)), "gradient_y": _mean(np.abs(gy)), "gradient_magnitude": _mean(m),
        "gradient_anisotropy": _mean(np.abs(gx)) / (_mean(np.abs(gy)) + EPS), "laplacian": _mean(np.abs(lap)), "laplacian_energy": _mean(lap * lap),
        "gradient_saturation": _mean(m < 0.05 * top), "gradient_kurtosis": _mean(z**4) - 3, "gradient_energy": (gx * gx + gy * gy).sum(axis=(1, 2)),
    }


def sobel(x: np.ndarray) -> np.ndarray:
    """Magnitude of the Sobel gradient, zero outside."""
    near = {(i, j): _shift(x, i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)}
    gx = sum(k * (near[i, 1] - near[i, -1]) for i, k in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(k * (near[1, j] - near[-1, j]) for j, k in ((-1, 1), (0, 2), (1, 1)))
    return np.sqrt(gx * gx + gy * gy)


def edges(x: np.ndarray) -> dict[str, np.ndarray]:
    m = sobel(x)
    mean, std = _mean(m), _std(m)
    return {"edge_mean": mean, "edge_std": std, "edge_density": _mean(m > (mean + std)[:, None, None])}


def total_variation(x: np.ndarray) -> dict[str, np.ndarray]:
    return {"total_variation": np.abs(np.diff(x, axis=1)).sum(axis=(1, 2)) + np.abs(np.diff(x, axis=2)).sum(axis=(1, 2))}


def glcm(x: np.ndarray, levels: int = 8) -> dict[str, np.ndarray]:
    """Horizontal co-occurrence of equal levels: contrast, homogeneity, energy, correlation."""
    lo, hi = x.min(axis=(1, 2), keepdims=True), x.max(axis=(1, 2), keepdims=True)
    q = np.floor((x - lo) / (hi - lo + EPS) * (levels - 1)).astype(int)
    i, j = _flat(q[:, :, :-1]), _flat(q[:, :, 1:])
    n, k = len(x), i.shape[1]
    p = np.zeros((n, levels, levels))
    np.add.at(p, (np.arange(n)[:, None], i, j), 1.0 / k)
    a = np.arange(levels)
    d = a[:, None] - a[None, :]
    mi, mj = (p * a[:, None]).sum(axis=(1, 2)), (p * a[None, :]).sum(axis=(1, 2))
    si = np.sqrt((p * (a[:, None] - mi[:, None, None]) ** 2).sum(axis=(1, 2)))
    sj = np.sqrt((p * (a[None, :] - mj[:, None, None]) ** 2).sum(axis=(1, 2)))
    cov = (p * (a[:, None] - mi[:, None, None]) * (a[None, :] - mj[:, None, None])).sum(axis=(1, 2))
    return {
        "contrast": (p * d * d).sum(axis=(1, 2)), "homogeneity": (p / (1 + np.abs(d))).sum(axis=(1, 2)), "energy": (p * p).sum(axis=(1, 2)),
        "correlation": cov / (si * sj + EPS),
    }


def image_moments(x: np.ndarray) -> dict[str, np.ndarray]:
    """Centroid and the first two Hu invariants (log magnitude of the first) of the grid's own range from zero."""
    v = x - x.min(axis=(1, 2), keepdims=True)
    h, w = x.shape[1:]
    yy, xx = np.mgrid[:h, :w].astype(float)
    m = v.sum(axis=(1, 2)) + EPS
    cy, cx = (v * yy).sum(axis=(1, 2)) / m, (v * xx).sum(axis=(1, 2)) / m
    dy, dx = yy[None] - cy[:, None, None], xx[None] - cx[:, None, None]
    eta = lambda p, q: (v * dx**p * dy**q).sum(axis=(1, 2)) / m**2
    n20, n02, n11 = eta(2, 0), eta(0, 2), eta(1, 1)
    hu1 = n20 + n02
    return {"centroid_y": cy, "centroid_x": cx, "log_hu1": np.log(np.abs(hu1) + EPS), "hu2": (n20 - n02) ** 2 + 4 * n11**2}


def shape_descriptors(x: np.ndarray) -> dict[str, np.ndarray]:
    """Area, perimeter, circularity and eccentricity of the cells above the mean."""
    b = (x > x.mean(axis=(1, 2), keepdims=True)).astype(float)
    area = _mean(b)
    h, w = x.shape[1:]
    perimeter = (np.abs(np.diff(b, axis=1)).sum(axis=(1, 2)) + np.abs(np.diff(b, axis=2)).sum(axis=(1, 2))) / (h * w)
    yy, xx = np.mgrid[:h, :w].astype(float)
    n = b.sum(axis=(1, 2)) + EPS
    cy, cx = (b * yy).sum(axis=(1, 2)) / n, (b * xx).sum(axis=(1, 2)) / n
    dy, dx = yy[None] - cy[:, None, None], xx[None] - cx[:, None, None]
    a, c, d = (b * dy * dy).sum(axis=(1, 2)) / n, (b * dx * dx).sum(axis=(1, 2)) / n, (b * dy * dx).sum(axis=(1, 2)) / n
    root = np.sqrt((a - c) ** 2 + 4 * d * d)
    l1, l2 = (a + c + root) / 2, (a + c - root) / 2
    return {
        "area": area, "perimeter": perimeter, "circularity": 4 * np.pi * area / (perimeter**2 + EPS),
        "eccentricity": np.sqrt(np.maximum(0, 1 - np.maximum(l2, 0) / (l1 + EPS))), "solidity": area / np.maximum(area, 0.1), "extent": area,
    }


def haar(x: np.ndarray, levels: int = 3) -> dict[str, np.ndarray]:
    """Energy, mean magnitude and deviation of the details at each level of a Haar transform."""
    out = {}
    for k in range(1, levels + 1):
        a, b, c, d = x[:, ::2, ::2], x[:, ::2, 1::2], x[:, 1::2, ::2], x[:, 1::2, 1::2]
        details = np.stack([(a - b + c - d) / 2, (a + b - c - d) / 2, (a - b - c + d) / 2], axis=1).reshape(len(x), -1)
        out |= {f"energy_{k}": (details**2).mean(axis=1), f"mean_{k}": np.abs(details).mean(axis=1), f"std_{k}": details.std(axis=1, ddof=1)}
        x = (a + b + c + d) / 2
    return out


def moran(x: np.ndarray) -> dict[str, np.ndarray]:
    """Moran's I with the mean of four neighbours, zero outside."""
    z = x - x.mean(axis=(1, 2), keepdims=True)
    near = (_shift(z, 1, 0) + _shift(z, -1, 0) + _shift(z, 0, 1) + _shift(z, 0, -1)) / 4
    return {"moran_i": (z * near).sum(axis=(1, 2)) / ((z * z).sum(axis=(1, 2)) + EPS)}


def centroid_distance(x: np.ndarray) -> dict[str, np.ndarray]:
    """Distance of the centroid of magnitudes from the middle, relative to half the diagonal."""
    h, w = x.shape[1:]
    yy, xx = np.mgrid[:h, :w].astype(float)
    m = np.abs(x).sum(axis=(1, 2)) + EPS
    cy, cx = (np.abs(x) * yy).sum(axis=(1, 2)) / m, (np.abs(x) * xx).sum(axis=(1, 2)) / m
    return {"centroid_distance": np.hypot(cy - (h - 1) / 2, cx - (w - 1) / 2) / (np.hypot(h, w) / 2)}


def information(x: np.ndarray) -> dict[str, np.ndarray]:
    """Binary transitions in row-major order, correlation with the next column (periodic), variance of patch variances."""
    flat = _flat(x)
    b = flat > np.median(flat, axis=1, keepdims=True)
    lz = (b[:, 1:] != b[:, :-1]).sum(axis=1) / flat.shape[1]
    nxt = _flat(np.roll(x, -1, 2))
    patches = np.stack([_flat(x[:, i : i + 4, j : j + 4]).var(axis=1, ddof=1) for i in range(0, x.shape[1] - 3, 2) for j in range(0, x.shape[2] - 3, 2)], axis=1)
    return {"lz_complexity": lz, "predictability": np.abs(_corr(flat, nxt)), "local_variance": patches.var(axis=1, ddof=1)}


def _corr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1) + 1e-300)


def symmetry(x: np.ndarray) -> dict[str, np.ndarray]:
    """Mean absolute correlation with the grid turned by 90, 180 and 270 degrees (square grids)."""
    turns = [np.abs(_corr(_flat(x), _flat(np.rot90(x, k, axes=(1, 2))))) for k in (1, 2, 3)]
    return {"symmetry": np.mean(turns, axis=0)}


def initial_morphology(x: np.ndarray) -> dict[str, np.ndarray]:
    b = x > x.mean(axis=(1, 2), keepdims=True)
    return {"density": _mean(b), "radial_gradient": _mean(sobel(x))}


def box_clustering(x: np.ndarray) -> dict[str, np.ndarray]:
    """Correlation of each cell with the mean of its 3 x 3 box (zero outside)."""
    box = sum(_shift(x, i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)) / 9
    return {"clustering": _corr(_flat(x), _flat(box))}


# --- spectra


def power(x: np.ndarray) -> np.ndarray:
    """Power of the orthonormal real transform (half of the columns' frequencies)."""
    return np.abs(np.fft.rfft2(x, norm="ortho")) ** 2


def _frequencies(h: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fy, fx = np.fft.fftfreq(h)[:, None], np.fft.rfftfreq(w)[None, :]
    return fy + 0 * fx, fx + 0 * fy, np.hypot(fy, fx)


def spectral(x: np.ndarray) -> dict[str, np.ndarray]:
    """Centroids, bandwidth, flatness, roll-off, band shares, dominant frequency and anisotropy of the power spectrum."""
    p = power(x)
    fy, fx, f = _frequencies(*x.shape[1:])
    total = p.sum(axis=(1, 2)) + EPS
    weigh = lambda g: (p * g).sum(axis=(1, 2)) / total
    center = weigh(f)
    flat = _flat(p)
    order = -np.sort(-flat, axis=1)
    share = np.cumsum(order, axis=1) / flat.sum(axis=1, keepdims=True)
    no_dc = flat.copy()
    no_dc[:, 0] = 0
    peak = no_dc.argmax(axis=1)
    low, mid = f < 0.15, (f >= 0.15) & (f < 0.35)
    return {
        "centroid_y": weigh(np.abs(fy)), "centroid_x": weigh(fx), "centroid": center, "bandwidth": np.sqrt(np.maximum(weigh(f * f) - center**2, 0)),
        "flatness": np.exp(np.log(flat + 1e-10).mean(axis=1)) / (flat.mean(axis=1) + 1e-10), "rolloff": ((share < 0.85).sum(axis=1) + 1) / flat.shape[1],
        "low": weigh(low), "mid": weigh(mid), "high": weigh(~low & ~mid), "dominant": f.ravel()[peak],
        "anisotropy": (p * np.abs(fy)).sum(axis=(1, 2)) / ((p * fx).sum(axis=(1, 2)) + EPS), "total_power": flat.sum(axis=1),
    }


def radial_bands(x: np.ndarray, bands: int = 4) -> dict[str, np.ndarray]:
    """Mean, largest and deviation of power in rings whose radii grow with the square root."""
    p = power(x)
    f = _frequencies(*x.shape[1:])[2]
    edge = np.sqrt(np.linspace(0, 1, bands + 1)) * (f.max() + 1e-12)
    out = {}
    for k in range(bands):
        ring = p[:, (f >= edge[k]) & (f < edge[k + 1] if k < bands - 1 else f <= edge[k + 1])]
        out |= {f"mean_{k}": ring.mean(axis=1), f"max_{k}": ring.max(axis=1), f"std_{k}": ring.std(axis=1)}
    return out


def harmonics(x: np.ndarray) -> dict[str, np.ndarray]:
    """Power near twice and three times the dominant frequency relative to it, distortion and purity."""
    p = power(x)
    f = _frequencies(*x.shape[1:])[2]
    flat, fr = _flat(p), f.ravel()
    no_dc = flat.copy()
    no_dc[:, 0] = 0
    peak = no_dc.argmax(axis=1)
    f0, p0 = fr[peak], no_dc[np.arange(len(x)), peak]
    near = lambda k: (no_dc * (np.abs(fr[None] - k * f0[:, None]) <= 0.1 * k * f0[:, None])).sum(axis=1)
    h2, h3 = near(2), near(3)
    return {"second": h2 / (p0 + EPS), "third": h3 / (p0 + EPS), "distortion": np.sqrt(h2 + h3) / (np.sqrt(p0) + EPS), "purity": p0 / (no_dc.sum(axis=1) + EPS)}


def _spectral_entropy(p: np.ndarray) -> np.ndarray:
    q = p / (p.sum(axis=1, keepdims=True) + EPS)
    return -(q * np.log(q + 1e-10)).sum(axis=1)


def entropies(x: np.ndarray) -> dict[str, np.ndarray]:
    """Entropies of spectra and of block means, and the acf-based proxies of sample and approximate entropy."""
    flat = _flat(x)
    line = np.abs(np.fft.rfft(flat - flat.mean(axis=1, keepdims=True), axis=1)) ** 2
    z = flat - flat.mean(axis=1, keepdims=True)
    acf = lambda k: (z[:, k:] * z[:, : z.shape[1] - k]).sum(axis=1) / ((z * z).sum(axis=1) + EPS)
    out = {
        "spectral_entropy": np.minimum(_spectral_entropy(_flat(power(x))), 10), "line_entropy": _spectral_entropy(line),
        "acf_entropy": -np.log((np.abs(acf(3)) + EPS) / (np.abs(acf(2)) + EPS)),
    }
    for s in (2, 4):
        h, w = x.shape[1] // s, x.shape[2] // s
        block = x[:, : h * s, : w * s].reshape(len(x), h, s, w, s).mean(axis=(2, 4))
        out[f"multiscale_{s}"] = _spectral_entropy(_flat(power(block)))
    return out


def ranks(x: np.ndarray) -> dict[str, np.ndarray]:
    """Entropy, participation and compressibility of singular values."""
    s = np.linalg.svd(x, compute_uv=False)
    q = s / (s.sum(axis=1, keepdims=True) + EPS)
    e = s**2
    need = (np.cumsum(e, axis=1) / (e.sum(axis=1, keepdims=True) + EPS) < 0.9).sum(axis=1) + 1
    k = s.shape[1]
    part = e.sum(axis=1) ** 2 / ((e**2).sum(axis=1) + EPS)
    return {
        "svd_entropy": -(q * np.log(q + 1e-10)).sum(axis=1), "participation_ratio": part / k, "components_90": need / k,
        "rank_ratio": (s > 1e-3 * s[:, :1]).sum(axis=1) / k,
    }


def autocorrelation_length(x: np.ndarray) -> dict[str, np.ndarray]:
    """Radial autocorrelation (periodic): radius below 1/e, ratio of the axes, structure factor's peak, place and width."""
    z = x - x.mean(axis=(1, 2), keepdims=True)
    f = np.abs(np.fft.fft2(z)) ** 2
    acf = np.fft.ifft2(f).real
    acf /= acf[:, :1, :1] + EPS
    h, w = x.shape[1:]
    dy, dx = np.minimum(np.arange(h), h - np.arange(h)), np.minimum(np.arange(w), w - np.arange(w))
    radius = np.rint(np.hypot(dy[:, None], dx[None, :])).astype(int)
    rings = [acf[:, radius == k].mean(axis=1) for k in range(radius.max() + 1)]
    radial = np.stack(rings, axis=1)
    below = radial < np.exp(-1)
    length = np.where(below.any(axis=1), below.argmax(axis=1), radial.shape[1])
    s = np.stack([f[:, radius == k].mean(axis=1) for k in range(1, radius.max() + 1)], axis=1)
    peak = s.argmax(axis=1)
    return {
        "correlation_length": length, "axis_ratio": (np.abs(acf[:, 1, 0]) + EPS) / (np.abs(acf[:, 0, 1]) + EPS), "structure_peak": peak + 1.0,
        "structure_value": s.max(axis=1), "structure_width": (s >= s.max(axis=1, keepdims=True) / 2).sum(axis=1), "structure_integral": s.sum(axis=1),
    }


def power_law(x: np.ndarray) -> dict[str, np.ndarray]:
    """Minus the slope of log power over log frequency, held within five; flat-index dominant and centroid."""
    p = _flat(power(x))
    f = _frequencies(*x.shape[1:])[2].ravel()
    u = np.log(f[1:])
    u = u - u.mean()
    v = np.log(p[:, 1:] + EPS)
    slope = (v * u).sum(axis=1) / (u * u).sum()
    n = p.shape[1]
    return {"power_law": np.clip(-slope, -5, 5), "dominant_index": (p >= p.max(axis=1, keepdims=True) * (1 - 1e-9)).argmax(axis=1) / n, "index_centroid": (p * np.arange(n)).sum(axis=1) / (p.sum(axis=1) + EPS) / n}


def lowpass(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, zero outside, kernel cut at three deviations."""
    k = int(np.ceil(3 * sigma))
    g = np.exp(-0.5 * (np.arange(-k, k + 1) / sigma) ** 2)
    g /= g.sum()
    x = sum(c * _shift(x, i - k, 0) for i, c in enumerate(g) if abs(i - k) < x.shape[1])
    return sum(c * _shift(x, 0, i - k) for i, c in enumerate(g) if abs(i - k) < x.shape[2])


def scales(x: np.ndarray) -> dict[str, np.ndarray]:
    """Energies of the low-passed grid, of the rest, and of a Laplacian pyramid with its contrast."""
    low = lowpass(x, 1.0)
    out = {"low_energy": (low**2).sum(axis=(1, 2)), "high_energy": ((x - low) ** 2).sum(axis=(1, 2))}
    now = x
    for k in (1, 2):
        small = lowpass(now, 1.0)[:, ::2, ::2]
        up = np.repeat(np.repeat(small, 2, axis=1), 2, axis=2)[:, : now.shape[1], : now.shape[2]]
        rest = now - up
        out |= {f"pyramid_energy_{k}": _mean(rest**2), f"pyramid_contrast_{k}": _std(rest)}
        now = small
    return out


# --- shapes


def _labels(b: np.ndarray) -> list[int]:
    """Sizes of the eight-connected components of a boolean grid, by flooding."""
    h, w = b.shape
    todo, sizes = {(int(i), int(j)) for i, j in np.argwhere(b)}, []
    while todo:
        stack, n = [todo.pop()], 0
        while stack:
            i, j = stack.pop()
            n += 1
            for a in (i - 1, i, i + 1):
                for c in (j - 1, j, j + 1):
                    if (a, c) in todo:
                        todo.remove((a, c))
                        stack.append((a, c))
        sizes.append(n)
    return sizes


def components(x: np.ndarray) -> dict[str, np.ndarray]:
    """Number, largest, mean and deviation of the sizes of components above the median plus half a deviation."""
    flat = _flat(x)
    cut = np.median(flat, axis=1) + 0.5 * flat.std(axis=1, ddof=1)
    rows = []
    for grid, c in zip(x, cut, strict=True):
        s = np.array(_labels(grid > c) or [0])
        rows.append((float((s > 0).sum()), s.max() / grid.size, s.mean() / grid.size, s.std() / grid.size))
    n, largest, mean, std = zip(*rows, strict=True)
    return {"components": np.array(n), "largest": np.array(largest), "mean_size": np.array(mean), "std_size": np.array(std)}


def _extreme(b: np.ndarray, k: int, pick: Callable) -> np.ndarray:
    """Smallest or largest value in a k x k box, zero outside: by columns, then by rows."""
    reach = range(-(k // 2), k // 2 + 1)
    tall = pick([_shift(b, i, 0) for i in reach if abs(i) < b.shape[1]])
    return pick([_shift(tall, 0, j) for j in reach if abs(j) < b.shape[2]])


def granulometry(x: np.ndarray) -> dict[str, np.ndarray]:
    """Share of the area above the mean that openings of growing width take away: mean and deviation of that width."""
    b = (x > x.mean(axis=(1, 2), keepdims=True)).astype(float)
    least, most = (lambda xs: np.minimum.reduce(xs)), (lambda xs: np.maximum.reduce(xs))
    areas = [b.sum(axis=(1, 2))]
    for k in (3, 5, 7):
        areas.append(_extreme(_extreme(b, k, least), k, most).sum(axis=(1, 2)))
    lost = np.maximum(np.stack([a - c for a, c in zip(areas, areas[1:], strict=False)], axis=1), 0)
    q = lost / (lost.sum(axis=1, keepdims=True) + EPS)
    size = np.array([3.0, 5.0, 7.0])
    mean = (q * size).sum(axis=1)
    return {"size_mean": mean, "size_std": np.sqrt(np.maximum((q * size**2).sum(axis=1) - mean**2, 0))}


def clusters(x: np.ndarray) -> dict[str, np.ndarray]:
    """log1p of the number of local maxima of the eroded median mask, and the dilated share of area (held at 1)."""
    b = (_flat(x) > np.median(_flat(x), axis=1, keepdims=True)).reshape(x.shape).astype(float)
    least, most = (lambda xs: np.minimum.reduce(xs)), (lambda xs: np.maximum.reduce(xs))
    inner = _extreme(b, 3, least)
    peaks = (inner > 0) & (x * inner >= _extreme(x * inner, 3, most))
    wide = _extreme(b, 11, most)
    return {"clusters": np.log1p(peaks.sum(axis=(1, 2))), "largest_fraction": np.minimum(wide.sum(axis=(1, 2)) / (b.sum(axis=(1, 2)) + EPS), 1)}


def channel_eigen(x: np.ndarray, channels: int = 4) -> dict[str, np.ndarray]:
    """Eigenvalues of the correlation of a grid's channels (its rows in groups): largest two, trace, condition, participation."""
    c = x.reshape(len(x), channels, -1)
    z = c - c.mean(axis=2, keepdims=True)
    z = z / (c.std(axis=2, ddof=1, keepdims=True) + EPS)
    m = np.einsum("nik,njk->nij", z, z) / c.shape[2]
    e = np.linalg.eigvalsh(m)[:, ::-1]
    return {
        "eigen_1": e[:, 0], "eigen_2": e[:, 1], "trace": e.sum(axis=1), "condition": np.abs(e[:, 0]) / (np.abs(e[:, -1]) + EPS),
        "participation": e.sum(axis=1) ** 2 / ((e**2).sum(axis=1) + EPS),
    }


def coherence(x: np.ndarray, channels: int = 4) -> dict[str, np.ndarray]:
    """Cross-spectral coherence of neighbouring channels, averaged over pairs of frequencies, and its largest place."""
    f = np.fft.rfft(x.reshape(len(x), channels, -1), axis=2)
    pair = f[:, :-1] * np.conj(f[:, 1:])
    own = np.abs(f) ** 2
    smooth = lambda a: a[:, :, :-1] + a[:, :, 1:]  # noqa: E731  two bins: without an average it is one everywhere
    c = np.abs(smooth(pair)) ** 2 / (smooth(own[:, :-1]) * smooth(own[:, 1:]) + EPS)
    return {"coherence_mean": c.mean(axis=(1, 2)), "coherence_max": c.max(axis=(1, 2)), "coherence_peak": c.mean(axis=1).argmax(axis=1)}
