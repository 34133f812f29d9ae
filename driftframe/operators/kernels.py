"""Dense per-frame numerics in NumPy: filters, morphology, distances, components, optical flow, flooding.

No Spark here: every function takes and returns arrays of one frame, a pair of frames or one cube, so a task's
memory is bounded by what it is given. Missing values are NaN inside kernels.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable

import numpy as np


def reflect(n: int, radius: int) -> np.ndarray:
    """Indices of a row of ``n`` with ``radius`` more on each side, mirrored about the edges of pixels."""
    i = np.arange(-radius, n + radius) % (2 * n)
    return np.where(i < n, i, 2 * n - 1 - i)


def correlate(a: np.ndarray, k: np.ndarray, axis: int) -> np.ndarray:
    r = len(k) // 2
    p = np.take(a, reflect(a.shape[axis], r), axis=axis)
    n = a.shape[axis]
    return sum(w * np.take(p, np.arange(i, i + n), axis=axis) for i, w in enumerate(k))


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    k = gaussian_kernel(sigma)
    return correlate(correlate(a, k, 0), k, 1)


def nan_gaussian(a: np.ndarray, sigma: float, propagate: bool = True, normalised: bool = True) -> np.ndarray:
    """Normalised convolution over what is not missing, or plain with 0 for that."""
    ok = np.isfinite(a)
    weight = gaussian(ok.astype(float), sigma)
    out = gaussian(np.where(ok, a, 0.0), sigma) / np.where(weight > 0, weight if normalised else 1.0, np.nan)
    return np.where(ok, out, np.nan) if propagate else out


def sliding(a: np.ndarray, size: int, f: np.ufunc = np.maximum) -> np.ndarray:
    """Extremes (``np.maximum`` or ``np.minimum``) over squares of ``size`` pixels, mirrored at the borders, which adds no
    pixel that isn't in what is left of the square. Along each axis blocks of ``size`` have a running extreme from either end;
    a window is the rest of one block and the beginning of the next, so the work doesn't depend on ``size``."""
    before, worst = size // 2, -np.inf if f is np.maximum else np.inf
    for axis in (0, 1):
        n = a.shape[axis]
        pad = [(0, 0), (0, 0)]
        pad[axis] = (before, -(n + before) % size + size)
        p = np.moveaxis(np.pad(a, pad, constant_values=worst), axis, -1)
        blocks = p.reshape(*p.shape[:-1], -1, size)
        head = f.accumulate(blocks, axis=-1).reshape(p.shape)
        tail = f.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(p.shape)
        a = np.moveaxis(f(tail[..., :n], head[..., size - 1 : size - 1 + n]), -1, axis)
    return a


def local_range(a: np.ndarray, size: int, mean: float | None = None) -> np.ndarray:
    """Scaled between the extremes around each pixel; what is missing counts as ``mean``, or the mean of the array."""
    if mean is None:
        mean = np.nanmean(a) if np.isfinite(a).any() else 0.0
    v = np.where(np.isfinite(a), a, mean)
    low, high = sliding(v, size, np.minimum), sliding(v, size, np.maximum)
    return np.where(high > low, (v - low) / np.where(high > low, high - low, 1.0), 0.0)


def components(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """4-connected (8 with ``diagonal``) regions numbered from 1 in raster order of their first pixel, by a union
    over horizontal runs."""
    m = np.asarray(mask, bool)
    h, w = m.shape
    edge = np.diff(np.pad(m, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    parent = list(range(len(row)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    reach = 1 if diagonal else 0
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] < end[j] + reach and start[j] < end[i] + reach:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    out, ids = np.zeros((h, w), np.int32), {}
    for k in range(len(row)):
        out[row[k], start[k] : end[k]] = ids.setdefault(find(k), len(ids) + 1)
    return out


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Background that doesn't reach the border is filled."""
    back = components(~np.asarray(mask, bool))
    outside = np.unique(np.r_[back[0], back[-1], back[:, 0], back[:, -1]])
    return ~(np.isin(back, outside[outside > 0]))


def shifted(a: np.ndarray, dy: int, dx: int, fill: object) -> np.ndarray:
    out = np.full_like(a, fill)
    h, w = a.shape
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


def erode(mask: np.ndarray, outside: bool = False) -> np.ndarray:
    return np.logical_and.reduce([shifted(mask, dy, dx, outside) for dy, dx in CROSS])


def dilate(mask: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce([shifted(mask, dy, dx, False) for dy, dx in CROSS])


def opened(mask: np.ndarray) -> np.ndarray:
    return dilate(erode(mask))


def distance(target: np.ndarray, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Euclidean distance to the nearest pixel of ``target`` (inf without any), and its ``ids`` if given; the first
    in raster order on ties of rows. Rows first, then columns out to the largest distance there is."""
    t = np.asarray(target, bool)
    h, w = t.shape
    x = np.broadcast_to(np.arange(w), (h, w))
    left = np.maximum.accumulate(np.where(t, x, -(10**9)), axis=1)
    right = np.minimum.accumulate(np.where(t, x, 10**9)[:, ::-1], axis=1)[:, ::-1]
    nearest = np.where(x - left <= right - x, left, right)
    g = np.where(np.abs(nearest) < 10**9, (nearest - x).astype(float) ** 2, np.inf)
    owner = None if ids is None else np.where(np.isfinite(g), np.take_along_axis(ids, np.clip(nearest, 0, w - 1), axis=1), 0)
    best, own = g.copy(), None if owner is None else owner.copy()
    for r in range(1, h):
        if np.isfinite(best).all() and r * r >= best.max():
            break
        for dy in (-r, r):
            other = shifted(g, dy, 0, np.inf) + r * r
            closer = other < best
            best = np.where(closer, other, best)
            if own is not None:
                own = np.where(closer, shifted(owner, dy, 0, 0), own)
    return np.sqrt(best), own


def carried(column: np.ndarray, t: np.ndarray, square: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """The least root of ``square`` + (``step`` * steps between)^2 over the rows of the same column, and its row, the
    first on ties; rows that are not finite are no sources, and -1 stands where a column has none. Rows are sorted by
    (column, t). The best source moves on with the step, so the best one of the middle row of a stretch bounds those of
    both halves: n log n for n rows, wherever the sources are."""
    best, at = np.full(len(t), np.inf), np.full(len(t), -1)
    sources = np.flatnonzero(np.isfinite(square))
    of, d, time = column[sources], square[sources], t[sources].astype(float)
    lo = np.flatnonzero(np.r_[True, column[1:] != column[:-1]][: len(t)])
    hi = np.r_[lo[1:], len(t)][: len(lo)]
    a, b = np.searchsorted(of, column[lo], "left"), np.searchsorted(of, column[lo], "right")
    while True:
        some = (lo < hi) & (a < b)
        lo, hi, a, b = lo[some], hi[some], a[some], b[some]
        if not len(lo):
            return np.sqrt(best), at
        mid, n = (lo + hi) // 2, b - a
        start = np.cumsum(n) - n
        each = np.arange(n.sum()) + np.repeat(a - start, n)
        far = d[each] + (step * (time[each] - np.repeat(t[mid].astype(float), n))) ** 2
        least = np.minimum.reduceat(far, start)
        first = np.minimum.reduceat(np.where(far == np.repeat(least, n), each, len(d)), start)
        best[mid], at[mid] = least, sources[first]
        lo, hi, a, b = np.r_[lo, mid + 1], np.r_[mid, hi], np.r_[a, first], np.r_[first + 1, b]


def peaks(a: np.ndarray, min_distance: int, threshold: float | None = None) -> np.ndarray:
    """Local maxima of squares of 2 * ``min_distance`` + 1 pixels, above the threshold (the minimum by default), not
    closer than ``min_distance`` to the border."""
    v = np.where(np.isfinite(a), a, -np.inf)
    low = v[np.isfinite(v)].min(initial=np.inf) if threshold is None else threshold
    out = (sliding(v, 2 * min_distance + 1) == v) & (v > low)
    out[:min_distance], out[len(out) - min_distance :] = False, False
    out[:, :min_distance], out[:, out.shape[1] - min_distance :] = False, False
    return out


def curvature(a: np.ndarray, sigma: float = 2.0, threshold: float = 0.0, negative: bool = True) -> np.ndarray:
    """Where the smoothed field bends down (or up) in x and in y, holes filled, opened."""
    s = nan_gaussian(a, sigma)
    dy, dx = np.zeros_like(s), np.zeros_like(s)
    dy[1:-1], dx[:, 1:-1] = np.diff(s, 2, axis=0), np.diff(s, 2, axis=1)
    bent = (dy < -threshold) & (dx < -threshold) if negative else (dy > threshold) & (dx > threshold)
    return opened(fill_holes(bent))


def peak_filter(a: np.ndarray, sigma: float = 2.0, min_distance: int = 10, negative: bool = True, radius: float = 5.0) -> np.ndarray:
    """Discs around the local maxima of the smoothed field, or of its negative."""
    s = nan_gaussian(a, sigma)
    return distance(peaks(s if negative else -s, min_distance))[0] < radius


def expansion(a: np.ndarray, n: int = 5, sigma: float = 1.1) -> tuple[np.ndarray, ...]:
    """Coefficients of the weighted quadratic fit a ~ p'Ap + b'p + c at each pixel: Axx, Ayy, Axy, bx, by."""
    i = np.arange(-n, n + 1)
    g = np.exp(-(i**2) / (2 * sigma**2))
    g /= g.sum()
    m2, m4 = (g * i**2).sum(), (g * i**4).sum()
    smooth = {k: correlate(a, g * i**k, 0) for k in (0, 1, 2)}
    s = {(0, 0): correlate(smooth[0], g, 1), (0, 1): correlate(smooth[0], g * i, 1), (0, 2): correlate(smooth[0], g * i**2, 1), (1, 0): correlate(smooth[1], g, 1), (1, 1): correlate(smooth[1], g * i, 1), (2, 0): correlate(smooth[2], g, 1)}
    gram = np.array([[1, m2, m2], [m2, m4, m2 * m2], [m2, m2 * m2, m4]])
    inv = np.linalg.inv(gram)
    axx = inv[1, 0] * s[0, 0] + inv[1, 1] * s[0, 2] + inv[1, 2] * s[2, 0]
    ayy = inv[2, 0] * s[0, 0] + inv[2, 1] * s[0, 2] + inv[2, 2] * s[2, 0]
    return axx, ayy, s[1, 1] / (m2 * m2) / 2, s[0, 1] / m2, s[1, 0] / m2


def sample(a: np.ndarray, y: np.ndarray, x: np.ndarray, fill: float = np.nan) -> np.ndarray:
    """Linear interpolation; ``fill`` outside."""
    h, w = a.shape
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    out, bad = np.zeros(y.shape), np.zeros(y.shape, bool)
    for i, wy in ((0, 1 - fy), (1, fy)):
        for j, wx in ((0, 1 - fx), (1, fx)):
            inside = (y0 + i >= 0) & (y0 + i < h) & (x0 + j >= 0) & (x0 + j < w)
            weight = wy * wx
            v = a[np.clip(y0 + i, 0, h - 1), np.clip(x0 + j, 0, w - 1)]
            out = out + np.where(weight > 0, weight * v, 0.0)
            bad |= (weight > 0) & ~inside
    return np.where(bad, fill, out)


def _resized(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    h, w = a.shape
    y, x = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((shape[0], h), (shape[1], w)))
    return sample(a, *np.meshgrid(y, x, indexing="ij"), fill=0.0)


def farneback(a: np.ndarray, b: np.ndarray, levels: int = 5, window: float = 3.0, iterations: int = 10, poly: int = 5, sigma: float = 1.1) -> tuple[np.ndarray, np.ndarray]:
    """Displacement (x, y) from frame a to frame b by polynomial expansion, coarse to fine. At each level the
    quadratic fits of both frames, the second taken at the displaced place, give linear equations for the
    displacement, which are averaged over a Gaussian window and solved, several times."""
    a, b = (np.where(np.isfinite(v), v, np.nanmean(v) if np.isfinite(v).any() else 0.0).astype(float) for v in (a, b))
    sizes = [a.shape]
    while len(sizes) < levels and min(sizes[-1]) >= 64:
        sizes.append(tuple(n // 2 for n in sizes[-1]))
    u = v = np.zeros(sizes[-1])
    for k, shape in reversed(list(enumerate(sizes))):
        blur = (lambda f: f) if k == 0 else (lambda f: gaussian(f, 0.5 * 2**k))
        fa, fb = (_resized(blur(f), shape) if k else f for f in (a, b))
        if u.shape != shape:
            sy, sx = shape[0] / u.shape[0], shape[1] / u.shape[1]
            u, v = _resized(u, shape) * sx, _resized(v, shape) * sy
        ea, eb = expansion(fa, poly, sigma), expansion(fb, poly, sigma)
        yy, xx = np.mgrid[: shape[0], : shape[1]].astype(float)
        kernel = gaussian_kernel(window)
        for _ in range(iterations):
            py, px = np.clip(yy + v, 0, shape[0] - 1), np.clip(xx + u, 0, shape[1] - 1)
            dx, dy = px - xx, py - yy
            moved = [sample(c, py, px, 0.0) for c in eb]
            axx, ayy, axy = ((p + q) / 2 for p, q in zip(ea[:3], moved[:3], strict=True))
            bx = (ea[3] - moved[3]) / 2 + axx * dx + axy * dy
            by = (ea[4] - moved[4]) / 2 + axy * dx + ayy * dy
            terms = (axx * axx + axy * axy, axy * (axx + ayy), ayy * ayy + axy * axy, axx * bx + axy * by, axy * bx + ayy * by)
            g11, g12, g22, h1, h2 = (correlate(correlate(t, kernel, 0), kernel, 1) for t in terms)
            det = g11 * g22 - g12 * g12 + 1e-12 * (g11 + g22 + 1e-12) ** 2 + 1e-30
            u, v = (g22 * h1 - g12 * h2) / det, (g11 * h2 - g12 * h1) / det
    return u, v


def block_match(a: np.ndarray, b: np.ndarray, reach: int = 3, window: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Whole-pixel displacement of least windowed squared difference, the shortest on ties."""
    best = np.full(a.shape, np.inf)
    u, v = np.zeros(a.shape), np.zeros(a.shape)
    moves = sorted(((dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)), key=lambda m: (m[0] ** 2 + m[1] ** 2, m))
    for dy, dx in moves:
        d = shifted(b, dy, dx, np.nan) - a
        cost = nan_gaussian(d * d, window, False)
        closer = cost < best - 1e-12
        best, u, v = np.where(closer, cost, best), np.where(closer, dx, u), np.where(closer, dy, v)
    return u, v


def clamped(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Linear interpolation; the border goes on outside."""
    h, w = a.shape
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    p, q, i2, j2 = y - i, x - j, np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
    return (1 - p) * ((1 - q) * a[i, j] + q * a[i, j2]) + p * ((1 - q) * a[i2, j] + q * a[i2, j2])


def gradients(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Along y and x; 0 along an axis of one pixel."""
    return tuple(np.gradient(a, axis=k) if a.shape[k] > 1 else np.zeros(a.shape) for k in (0, 1))


def patch_search(a: np.ndarray, b: np.ndarray, u: np.ndarray, v: np.ndarray, patch: int, stride: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Displacements of overlapping patches, from ``u, v`` on, by Gauss-Newton steps with the gradients of the first
    frame and without the patches' means; pixels average those of their patches, well-matched ones most."""
    (h, w), mean = a.shape, lambda p: p - p.mean(axis=(1, 2), keepdims=True)
    ph, pw = min(patch, h), min(patch, w)
    top, left = (g.ravel()[:, None, None] for g in np.meshgrid(*(np.unique(np.r_[np.arange(0, n - k + 1, stride), n - k]) for n, k in ((h, ph), (w, pw))), indexing="ij"))
    dy, dx = np.mgrid[:ph, :pw]
    y, x = top + dy, left + dx
    gy, gx = (mean(g[y, x]) for g in gradients(a))
    total = lambda p: p.sum(axis=(1, 2))
    hxx, hxy, hyy = total(gx * gx), total(gx * gy), total(gy * gy)
    det = hxx * hyy - hxy * hxy
    clear = det > 1e-6 * (hxx + hyy + 1e-9) ** 2
    det = np.where(clear, det, 1.0)
    pu, pv = u[y, x].mean(axis=(1, 2)), v[y, x].mean(axis=(1, 2))
    start, best, found = (pu, pv), np.full(len(pu), np.inf), (pu, pv)
    for _ in range(steps + 1):
        d = mean(clamped(b, y + pv[:, None, None], x + pu[:, None, None]) - a[y, x])
        error = total(d * d)
        closer = error < best
        best, found = np.where(closer, error, best), (np.where(closer, pu, found[0]), np.where(closer, pv, found[1]))
        rx, ry = total(gx * d), total(gy * d)
        pu, pv = pu - np.where(clear, (hyy * rx - hxy * ry) / det, 0.0), pv - np.where(clear, (hxx * ry - hxy * rx) / det, 0.0)
        lost = (np.abs(pu - start[0]) > patch) | (np.abs(pv - start[1]) > patch)
        pu, pv = np.where(lost, start[0], pu), np.where(lost, start[1], pv)
    pu, pv = (c[:, None, None] for c in found)
    weight = 1 / np.maximum(1.0, np.abs(clamped(b, y + pv, x + pu) - a[y, x]))
    sums = np.zeros((3, h, w))
    for k, c in enumerate((weight, weight * pu, weight * pv)):
        np.add.at(sums[k], (y, x), c)
    return sums[1] / sums[0], sums[2] / sums[0]


def refined(a: np.ndarray, b: np.ndarray, u: np.ndarray, v: np.ndarray, smooth: float = 5000.0, warps: int = 5, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Variational refinement: brightness that moves along and vectors that vary little, linearised at each warp."""
    yy, xx = np.mgrid[: a.shape[0], : a.shape[1]].astype(float)

    def around(c: np.ndarray) -> np.ndarray:
        p = np.pad(c, 1, mode="edge")
        return (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 6 + (p[:-2, :-2] + p[2:, 2:] + p[2:, :-2] + p[:-2, 2:]) / 12

    for _ in range(warps):
        y, x = yy + v, xx + u
        there = clamped(b, y, x)
        inside = (y >= 0) & (y <= a.shape[0] - 1) & (x >= 0) & (x <= a.shape[1] - 1)
        gy, gx = (np.where(inside, g, 0.0) for g in gradients((a + there) / 2))
        gt, u0, v0 = np.where(inside, there - a, 0.0), u, v
        for _ in range(steps):
            mu, mv = around(u), around(v)
            r = (gx * (mu - u0) + gy * (mv - v0) + gt) / (smooth + gx * gx + gy * gy)
            u, v = mu - gx * r, mv - gy * r
    return u, v


def inverse_search(a: np.ndarray, b: np.ndarray, patch: int = 8, stride: int = 4, steps: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Dense flow by inverse search of patches from coarse to fine, refined on each level."""
    sizes = [a.shape]
    while min(sizes[-1]) >= 4 * patch:
        sizes.append(tuple((n + 1) // 2 for n in sizes[-1]))
    u = v = np.zeros(sizes[-1])
    for shape in reversed(sizes):
        fa, fb = (nan_gaussian(f, 0.5 * a.shape[0] / shape[0], False) if shape != a.shape else f for f in (a, b))
        fa, fb = (_resized(f, shape) if shape != a.shape else f.astype(float) for f in (fa, fb))
        if u.shape != shape:
            u, v = _resized(u, shape) * (shape[1] / u.shape[1]), _resized(v, shape) * (shape[0] / u.shape[0])
        u, v = refined(fa, fb, *patch_search(fa, fb, u, v, patch, stride, steps))
    return u, v


MODELS = {"farneback": farneback, "dis": inverse_search, "block_match": block_match}


def model(name: str) -> Callable:
    """Optical-flow model by name; those that need training or other libraries are not implemented."""
    key = name.lower()
    if key in MODELS:
        return MODELS[key]
    if key in ("deepflow", "pca", "simpleflow", "sparsetodense", "dualtvl1", "denserlof"):
        raise NotImplementedError(f"{name}: supply flow columns from elsewhere")
    raise ValueError(f"{name} is none of {sorted(MODELS)}")


def to_8bit(a: np.ndarray, low: float, high: float, fill: int = 127) -> np.ndarray:
    factor = 255 / (high - low) if high != low else 0.0
    return np.where(np.isfinite(a), np.floor((a - low) * factor), fill).clip(0, 255)


def pair_8bit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two frames scaled together; a pixel that one lacks takes the other's value, so that gaps don't look like motion."""
    both = np.r_[a.ravel(), b.ravel()]
    ok = both[np.isfinite(both)]
    low, high = (ok.min(), ok.max()) if len(ok) else (0.0, 0.0)
    qa, qb = to_8bit(a, low, high), to_8bit(b, low, high)
    return np.where(np.isfinite(a), qa, qb), np.where(np.isfinite(b), qb, qa)


def smoothed(f: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[tuple, tuple]:
    """Each vector averaged with the reverse of the opposite one where it leads."""
    yy, xx = np.mgrid[: f[0].shape[0], : f[0].shape[1]]

    def side(own: tuple, other: tuple) -> tuple:
        there = [sample(c, yy + own[1], xx + own[0]) for c in other]
        return tuple(np.where(np.isfinite(t), (o - t) / 2, o) for o, t in zip(own, there, strict=True))

    return side(f, b), side(b, f)


def pair_flow(a: np.ndarray, b: np.ndarray, name: str = "farneback", smoothing: int = 0, limit: float = 20.0, vr_steps: int = 0) -> tuple[np.ndarray, ...]:
    """Forward and backward vectors (fx, fy, bx, by) of two frames scaled together to 8 bits, clamped to ±limit."""
    qa, qb = pair_8bit(a, b)
    f, g = model(name)(qa, qb), model(name)(qb, qa)
    if vr_steps:
        f, g = refined(qa, qb, *f, warps=5 * vr_steps), refined(qb, qa, *g, warps=5 * vr_steps)
    for _ in range(smoothing):
        f, g = smoothed(f, g)
    return tuple(np.clip(c, -limit, limit) for c in (*f, *g))


def sortable(v: np.ndarray) -> np.ndarray:
    """32-bit numbers in the order of single-precision values; missing ones come last, both zeros are equal."""
    bits = (np.where(np.isnan(v), np.float32(np.inf), v).astype(np.float32) + np.float32(0)).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def flooded(height: np.ndarray, out: np.ndarray, free: np.ndarray, before: np.ndarray, after: np.ndarray, width: int) -> np.ndarray:
    """Priority flood of flat arrays whose rows have ``width`` pixels and a frame of pixels that aren't free, so that none
    has to be looked for at a border; ``before`` and ``after`` are the pixels of the steps beside it that each leads to, 0 for none.
    ``out`` has the labels of seeds and gets the others; what was ``free`` and is reached is returned in that order.

    A pixel waits with others of its height's upper half and is sorted in when their turn comes: its height and its age in one
    number, so 8 bytes and no more, and the queue stays short."""
    seeds = np.flatnonzero(out)
    place = np.zeros(len(seeds) + int(np.count_nonzero(free)), before.dtype)
    place[: len(seeds)] = seeds
    if len(place) >> 32:
        raise ValueError("a region of over 4,294,967,295 pixels")
    key = (height[seeds].astype(np.uint64) << np.uint64(32)) | np.arange(len(seeds), dtype=np.uint64)
    key.sort()
    high = (key >> np.uint64(48)).astype(np.int64)
    waiting = {int(k): array("Q", part.tobytes()) for k, part in zip(*_runs(high, key), strict=True)}
    turns, heap, age, started = sorted(waiting), [], len(seeds), len(seeds)
    height, label, open_, back, ahead, at = map(memoryview, (height, out, free.view(np.uint8), before, after, place))
    pop, push = heapq.heappop, heapq.heappush
    while turns:
        turn = pop(turns)
        heap = waiting.pop(turn).tolist()
        heapq.heapify(heap)
        while heap:
            p = at[pop(heap) & 0xFFFFFFFF]
            for q in (back[p], p - width, p - 1, p + 1, p + width, ahead[p]):
                if open_[q]:
                    open_[q] = 0
                    label[q] = label[p]
                    at[age] = q
                    k = height[q]
                    if k >> 16 <= turn:
                        push(heap, k << 32 | age)
                    else:
                        if k >> 16 not in waiting:
                            waiting[k >> 16] = array("Q")
                            push(turns, k >> 16)
                        waiting[k >> 16].append(k << 32 | age)
                    age += 1
    return place[started:age]


def _runs(group: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The different numbers of a sorted ``group``, and the values of each."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    return group[first].tolist(), np.split(values, first[1:]) if len(first) else []


class Cube:
    """Flat arrays of a region for ``flooded``, filled part by part: 21 bytes for a pixel of its box and the frame of each step."""

    def __init__(self, low: tuple[int, int, int], shape: tuple[int, int, int]):
        self.low, self.shape, self.width = low, shape, shape[2] + 2
        self.step = (shape[1] + 2) * self.width
        n, kind = shape[0] * self.step, np.int32 if shape[0] * self.step < 1 << 31 else np.int64
        self.height, self.label, self.free = np.zeros(n, np.uint32), np.zeros(n, np.int32), np.zeros(n, bool)
        self.before, self.after = np.zeros(n, kind), np.zeros(n, kind)

    def _place(self, t: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Places of pixels, 0 for those outside the box."""
        t, y, x = (np.asarray(c, dtype=np.int64) - o for c, o in zip((t, y, x), self.low, strict=True))
        inside = np.logical_and.reduce([(c >= 0) & (c < n) for c, n in zip((t, y, x), self.shape, strict=True)])
        return np.where(inside, t * self.step + (y + 1) * self.width + x + 1, 0)

    def add(self, t: np.ndarray, y: np.ndarray, x: np.ndarray, v: np.ndarray, label: np.ndarray, allowed: np.ndarray, forward: np.ndarray, backward: np.ndarray) -> None:
        """Pixels with their rounded vectors (y, x in the last axis)."""
        p, y, x = self._place(t, y, x), np.asarray(y, dtype=np.int64), np.asarray(x, dtype=np.int64)
        self.height[p], self.label[p], self.free[p] = sortable(v), label, np.asarray(allowed, dtype=bool) & (np.asarray(label) == 0)
        self.before[p] = self._place(np.asarray(t, dtype=np.int64) - 1, y + backward[..., 0], x + backward[..., 1])
        self.after[p] = self._place(np.asarray(t, dtype=np.int64) + 1, y + forward[..., 0], x + forward[..., 1])

    def flood(self) -> np.ndarray:
        return flooded(self.height, self.label, self.free, self.before, self.after, self.width)

    def pixels(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, rest = np.divmod(place, self.step)
        y, x = np.divmod(rest, self.width)
        return t + self.low[0], y - 1 + self.low[1], x - 1 + self.low[2]


def flood(field: np.ndarray, markers: np.ndarray, allowed: np.ndarray, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Priority flood of a cube in the moving frame, in single precision. Seeds enter in raster order; the lowest (value, age,
    place) is taken next and gives its label to its free neighbours: four in the step, and one in the step before and after
    where its rounded vectors (y, x in the last axis) lead."""
    cube = Cube((0, 0, 0), field.shape)
    whole = lambda a: np.rint(a).astype(np.int64)
    for t in range(field.shape[0]):
        y, x = np.indices(field.shape[1:])
        cube.add(np.full(y.shape, t), y, x, field[t], markers[t], allowed[t], whole(forward[t]), whole(backward[t]))
    cube.flood()
    return cube.label.reshape(field.shape[0], -1, cube.width)[:, 1:-1, 1:-1]


def subsegments(mask: np.ndarray, shrink: float = 0.1, min_distance: int = 5) -> np.ndarray:
    """Regions split along the waists of their distance transform, scaled by the radius of a disc of their area."""
    regions = components(mask)
    d = distance(~np.asarray(mask, bool))[0]
    d = np.where(np.isfinite(d), d, max(mask.shape))
    size = np.bincount(regions.ravel())
    scaled = np.where(regions > 0, d / np.sqrt(size[regions] / np.pi), 0.0)
    seeds = components((scaled > shrink) | (peaks(d, min_distance, 0.0) & (regions > 0)))
    seeds = np.where(regions > 0, seeds, -1)
    still = np.zeros((1, *mask.shape, 2))
    split = flood(-scaled[None], seeds[None], np.ones((1, *mask.shape), bool), still, still)[0]
    split = np.where(regions > 0, split, 0)
    both = np.unique(split[split > 0])
    return np.searchsorted(both, split) * (split > 0) + (split > 0)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node of the links ``a``, ``b`` to the smallest one of its component; a node that is linked to
    itself only keeps that."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    parent = list(range(len(nodes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        i, j = find(i), find(j)
        parent[max(i, j)] = min(i, j)
    root = np.array([find(i) for i in range(len(nodes))], dtype=int)
    keep = (root != np.arange(len(nodes))) | (np.bincount(root, minlength=len(nodes))[root] == 1)
    return nodes[keep], nodes[root[keep]]


def ordered_groups(known: list[int], forward: dict[int, list[int]], backward: dict[int, list[int]]) -> dict[int, int]:
    """Step labels (ascending) -> the first label of their object: from the lowest label without an object, follow its
    list in the order of insertion, taking labels without an object, forward ones first, ascending."""
    got: dict[int, int] = {}
    for seed in known:
        if seed in got:
            continue
        queue, at = [seed], 0
        got[seed] = seed
        while at < len(queue):
            for edges in (forward, backward):
                for b in sorted(edges.get(queue[at], ())):
                    if b not in got:
                        got[b] = seed
                        queue.append(b)
            at += 1
    return got
