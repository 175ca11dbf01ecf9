"""Numeric kernels on one spectrum (numpy only): what data-dependent recursion keeps out of built-in expressions."""

from __future__ import annotations

import math

import numpy as np

MAD_SCALE = 1.4826


def mirrored(x: np.ndarray, half: int) -> np.ndarray:
    """``half`` elements mirrored at both ends, edges repeated."""
    return np.pad(x, half, mode="symmetric")


def savitzky_golay(x: np.ndarray, window: int = 21, order: int = 2) -> np.ndarray:
    """Local polynomial smoothing; the first and last half window take the polynomial of the outermost window."""
    if window % 2 == 0 or window <= order or window > len(x):
        raise ValueError("window must be odd, above the order and not above the length")
    h = window // 2
    design = np.vander(np.arange(-h, h + 1, dtype=float), order + 1, increasing=True)
    solve = np.linalg.pinv(design)
    out = np.convolve(x, solve[0][::-1], mode="same")
    out[:h] = design[:h] @ (solve @ x[:window])
    out[-h:] = design[-h:] @ (solve @ x[-window:])
    return out


def moving_average(x: np.ndarray, window: int = 5) -> np.ndarray:
    """Centred mean over an odd window; beyond the ends the spectrum is mirrored with its edge repeated."""
    h = window // 2
    if 0 < len(x) < h:
        raise ValueError("spectrum is shorter than half the window")
    return np.convolve(mirrored(x, h), np.ones(window), mode="valid") / window if len(x) else x.copy()


def rolling(x: np.ndarray, half: int, lower: bool) -> np.ndarray:
    """Minimum (or maximum) from ``half`` before to ``half`` behind each point, cut at the ends.

    The padded signal is cut into blocks of the window's width; a window is the end of one block and the start of the next, whose running
    minima are known, so the work doesn't depend on the width.
    """
    w, fill, accumulate, join = 2 * half + 1, np.inf if lower else -np.inf, *((np.minimum.accumulate, np.minimum) if lower else (np.maximum.accumulate, np.maximum))
    padded = np.full(-(-(len(x) + 2 * half) // w) * w, fill)
    padded[half : half + len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = accumulate(blocks, axis=1).ravel()
    back = accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return join(back[: len(x)], ahead[2 * half : 2 * half + len(x)])


def top_hat(x: np.ndarray, half: int = 100) -> np.ndarray:
    """Intensity above the grey opening of size 2*half+1."""
    if half < 1 or len(x) < 2 * half + 1:
        raise ValueError("half window must be at least 1 and the window not wider than the spectrum")
    return x - rolling(rolling(x, half, True), half, False)


def snip_baseline(x: np.ndarray, half: int = 40) -> np.ndarray:
    """Peak clipping with a shrinking window over a linearly continued spectrum."""
    n = len(x)
    half = min(half, max(1, (n - 1) // 2))
    if n < 3:
        return x.copy()
    k = np.arange(half, 0, -1)
    left = x[0] - (x[1] - x[0]) * k
    right = x[-1] + (x[-1] - x[-2]) * k[::-1]
    b = np.concatenate([left, x, right])
    for p in range(half, 0, -1):
        mid = 0.5 * (b[: -2 * p] + b[2 * p :])
        b[p:-p] = np.minimum(b[p:-p], mid)
    return b[half : half + n]


def hull_baseline(mz: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lower convex hull interpolated over the axis; the running minimum where there is no hull."""
    if len(x) < 3 or not (np.isfinite(x).all() and np.isfinite(mz).all()):
        return np.minimum.accumulate(x)
    chain: list[int] = []
    for i in range(len(x)):
        while len(chain) > 1:
            a, b = chain[-2], chain[-1]
            if (mz[b] - mz[a]) * (x[i] - x[a]) - (x[b] - x[a]) * (mz[i] - mz[a]) <= 0:
                chain.pop()
            else:
                break
        chain.append(i)
    return np.interp(mz, mz[chain], x[chain])


def median_baseline(x: np.ndarray, half: int = 100, iterations: int = 1) -> np.ndarray:
    b = x
    for _ in range(iterations):
        b = np.median(np.lib.stride_tricks.sliding_window_view(mirrored(b, half), 2 * half + 1), axis=1)
    return b


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height of each peak above the higher of its two surrounding minima, looking out to the next higher point."""
    out = np.empty(len(peaks))
    for j, p in enumerate(peaks):
        higher = np.nonzero(x[:p] > x[p])[0]
        lo = higher[-1] + 1 if len(higher) else 0
        higher = np.nonzero(x[p + 1 :] > x[p])[0]
        hi = p + 1 + higher[0] if len(higher) else len(x)
        out[j] = x[p] - max(x[lo : p + 1].min(), x[p:hi].min())
    return out


def widths(x: np.ndarray, peaks: np.ndarray, prominence: np.ndarray, share: float = 0.5) -> np.ndarray:
    """Width of each peak at ``share`` of its prominence below the top, in points, between linearly interpolated crossings."""
    out = np.empty(len(peaks))
    for j, (p, h) in enumerate(zip(peaks, prominence)):
        level, ends = x[p] - share * h, []
        for step in (-1, 1):
            i = p
            while 0 < i < len(x) - 1 and x[i] > level:
                i += step
            ends.append(i - step * (level - x[i]) / (x[i - step] - x[i]) if x[i] < level else float(i))
        out[j] = ends[1] - ends[0]
    return out


def local_peaks(x: np.ndarray, prominence: float | None = None, height: float | None = None, distance: int | None = None, width: float | None = None) -> np.ndarray:
    """Indices of local maxima, never at the ends; a plateau counts once at its middle, rounded down.

    Filters apply in the order height, distance (higher peaks win), prominence, width (at half prominence).
    """
    if len(x) < 3:
        return np.zeros(0, int)
    change = np.nonzero(np.diff(x) != 0)[0]
    starts = np.concatenate([[0], change + 1])
    stops = np.concatenate([change, [len(x) - 1]])
    v = x[starts]
    up = np.concatenate([[False], v[1:] > v[:-1]])
    down = np.concatenate([v[:-1] > v[1:], [False]])
    keep = up & down
    peaks = (starts[keep] + stops[keep]) // 2
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance is not None and len(peaks):
        alive = np.ones(len(peaks), bool)
        for j in np.argsort(x[peaks], kind="stable")[::-1]:
            if alive[j]:
                near = np.abs(peaks - peaks[j]) < distance
                near[j] = False
                alive[near] = False
        peaks = peaks[alive]
    if prominence is not None and len(peaks):
        peaks = peaks[prominences(x, peaks) >= prominence]
    if width is not None and len(peaks):
        peaks = peaks[widths(x, peaks, prominences(x, peaks)) >= width]
    return peaks


def persistence_peaks(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Maxima with their persistence: components of the superlevel sets, merged into the higher one as the level falls.

    The highest maximum persists over the whole height of the signal; a constant signal has no peak.
    """
    n = len(x)
    if n == 0 or x.max() == x.min():
        return np.zeros(0, int), np.zeros(0)
    order = np.lexsort((np.arange(n), -x))
    parent = np.full(n, -1)
    found: list[tuple[int, float]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in order:
        near = [root(j) for j in (i - 1, i + 1) if 0 <= j < n and parent[j] >= 0]
        parent[i] = i
        for r in near:
            a, b = root(i), r
            if a == b:
                continue
            low, high = (a, b) if (x[a], -a) < (x[b], -b) else (b, a)
            if low != i and x[low] - x[i] > 0:
                found.append((low, x[low] - x[i]))
            parent[low] = high
    found.append((root(int(order[0])), float(x.max())))
    kept = sorted((p, s) for p, s in found if s >= threshold)
    return np.array([p for p, _ in kept], int), np.array([s for _, s in kept])


def density_edges(mz: np.ndarray, x: np.ndarray, low: float, high: float, narrow: float, wide: float) -> np.ndarray:
    """Bin edges that are narrow where peaks crowd: width falls linearly from ``wide`` to ``narrow`` with the peaks' density."""
    noise = MAD_SCALE * float(np.median(np.abs(x - np.median(x)))) if len(x) else 0.0
    peaks = mz[local_peaks(x, prominence=max(3 * noise, 1e-300))] if len(x) else np.zeros(0)
    peaks = peaks[(peaks >= low) & (peaks <= high)]
    if not len(peaks):
        return low + wide * np.arange(math.ceil((high - low) / wide) + 1)
    iqr = float(np.subtract(*np.percentile(peaks, [75, 25])))
    spread = min(float(peaks.std()), iqr / 1.34)
    h = 0.9 * spread * len(peaks) ** -0.2 if spread > 0 else (high - low) / 50
    grid = np.linspace(low, high, 1000)
    density = np.exp(-0.5 * ((grid[:, None] - peaks[None, :]) / h) ** 2).sum(axis=1)
    density /= density.max()
    edges = [low]
    while edges[-1] < high:
        edges.append(edges[-1] + wide - float(np.interp(edges[-1], grid, density)) * (wide - narrow))
    return np.array(edges)


def resample(axis: np.ndarray, positions: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values at ``axis`` of a signal moved to ``positions``; a folded map is sorted and equal places averaged, outside is 0."""
    if (np.diff(positions) <= 0).any():
        places, index = np.unique(positions, return_inverse=True)
        x = np.bincount(index, weights=x) / np.bincount(index)
        positions = places
    return np.interp(axis, positions, x, left=0.0, right=0.0)


def nearest(values: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Index of the nearest reference value (ascending); halfway goes to the right."""
    right = np.clip(np.searchsorted(reference, values), 0, len(reference) - 1)
    left = np.maximum(right - 1, 0)
    return np.where(values - reference[left] < np.abs(reference[right] - values), left, right)


def shift_of(peaks: np.ndarray, reference: np.ndarray, most: float) -> float:
    if not len(peaks) or not len(reference):
        return 0.0
    return float(np.clip(np.median(reference[nearest(peaks, reference)] - peaks), -most, most))


def robust_line(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of b on a, refitted once without residuals beyond three scaled MADs."""
    design = np.stack([a, np.ones_like(a)], axis=1)
    fit = np.linalg.lstsq(design, b, rcond=None)[0]
    r = b - design @ fit
    inside = np.abs(r - np.median(r)) <= 3 * MAD_SCALE * np.median(np.abs(r - np.median(r)))
    if 2 <= inside.sum() < len(a):
        fit = np.linalg.lstsq(design[inside], b[inside], rcond=None)[0]
    return float(fit[0]), float(fit[1])


def lowess(a: np.ndarray, b: np.ndarray, share: float = 0.3, rounds: int = 3) -> np.ndarray:
    """Locally weighted lines with tricube weights and bisquare robustness rounds; values at ``a`` (ascending)."""
    n = len(a)
    k = int(np.clip(math.ceil(share * n), 2, n))
    robust, fit = np.ones(n), b.copy()
    for _ in range(rounds + 1):
        for i in range(n):
            d = np.abs(a - a[i])
            h = np.partition(d, k - 1)[k - 1]
            w = robust * np.clip(1 - (d / h) ** 3, 0, None) ** 3 if h > 0 else robust * (d == 0)
            s = w.sum()
            if s <= 0:
                continue
            ma, mb = (w * a).sum() / s, (w * b).sum() / s
            va = (w * (a - ma) ** 2).sum()
            fit[i] = mb + ((w * (a - ma) * (b - mb)).sum() / va * (a[i] - ma) if va > 1e-12 else 0.0)
        r = np.abs(b - fit)
        scale = 6 * np.median(r)
        if scale <= 0:
            break
        robust = np.clip(1 - (r / scale) ** 2, 0, None) ** 2
    return fit


def warp_path(a: np.ndarray, b: np.ndarray, radius: int | None = None) -> tuple[list[tuple[int, int]], float]:
    """Dynamic time warping path and distance (root of summed squares) inside a band around the diagonal."""
    n, m = len(a), len(b)
    band = max(n, m) if radius is None else max(radius, abs(n - m))
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(m, i + band) + 1):
            cost[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
    i, j, path = n, m, []
    while i > 0 and j > 0:
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: cost[p])
    return path[::-1], float(math.sqrt(cost[n, m]))


def piecewise_offsets(peaks: np.ndarray, target: np.ndarray, axis: np.ndarray, segments: int, sigma: float) -> np.ndarray:
    """Offsets at ``axis``: the median offset of each segment of peaks, interpolated between the segments' middles and smoothed."""
    cuts = np.quantile(peaks, np.linspace(0, 1, segments + 1))
    own = np.clip(np.searchsorted(cuts, peaks, side="right") - 1, 0, segments - 1)
    used = [s for s in range(segments) if (own == s).any()]
    mids = np.array([np.median(peaks[own == s]) for s in used])
    offs = np.array([np.median((target - peaks)[own == s]) for s in used])
    curve = np.interp(axis, mids, offs)
    h = max(1, int(4 * min(sigma, len(axis) / 4) + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-h, h + 1) / max(sigma, 1e-9)) ** 2)
    return np.convolve(mirrored(curve, h), kernel / kernel.sum(), mode="valid") if h <= len(curve) else curve


def align(method: str, axis: np.ndarray, x: np.ndarray, peaks: np.ndarray, reference: np.ndarray, ref_signal: np.ndarray | None = None, most: float = 50.0, segments: int = 5, sigma: float = 2.0, degree: int = 2, share: float = 0.3, rounds: int = 3, radius: int = 10) -> np.ndarray:
    """Signal ``x`` moved so that its peaks (positions on ``axis``) meet the reference peaks.

    Too few peaks for a method fall back to the shift; without peaks the signal is unchanged.
    """
    if method == "dtw":
        path, _ = warp_path(x, ref_signal, radius)
        sums, n = np.zeros(len(ref_signal)), np.zeros(len(ref_signal))
        for i, j in path:
            sums[j] += x[i]
            n[j] += 1
        return sums / np.maximum(n, 1)
    if not len(peaks) or not len(reference):
        return x.copy()
    target = reference[nearest(peaks, reference)]
    need = {"shift": 0, "linear": 2, "piecewise": 2, "quadratic": 3, "cubic": 4, "lowess": 3}
    if method not in need:
        raise ValueError(f"unknown method {method}")
    if method == "shift" or len(peaks) < need[method]:
        step = int(round(shift_of(peaks, reference, most)))
        out = np.zeros_like(x)
        if step >= 0:
            out[step:] = x[: len(x) - step]
        else:
            out[:step] = x[-step:]
        return out
    if method == "linear":
        slope, cut = robust_line(peaks, target)
        places = slope * axis + cut
    elif method in ("quadratic", "cubic"):
        places = np.polyval(np.polyfit(peaks, target, {"quadratic": 2, "cubic": 3}[method]), axis)
    elif method == "lowess":
        order = np.argsort(peaks, kind="stable")
        offset = lowess(peaks[order], (target - peaks)[order], share, rounds)
        places = axis + np.interp(axis, peaks[order], offset)
    else:
        places = axis + piecewise_offsets(peaks, target, axis, segments, sigma)
    return resample(axis, places, x)


def wasserstein(mz_a: np.ndarray, a: np.ndarray, mz_b: np.ndarray, b: np.ndarray) -> float:
    """Area between the cumulative intensity shares; negative intensities count as 0, an empty spectrum gives NaN."""
    a, b = np.clip(a, 0, None), np.clip(b, 0, None)
    if a.sum() <= 0 or b.sum() <= 0:
        return float("nan")
    grid = np.unique(np.concatenate([mz_a, mz_b]))
    share = []
    for mz, w in ((mz_a, a), (mz_b, b)):
        order = np.argsort(mz, kind="stable")
        c = np.concatenate([[0], np.cumsum(w[order])]) / w.sum()
        share.append(c[np.searchsorted(mz[order], grid, side="right")])
    return float((np.abs(share[0] - share[1])[:-1] * np.diff(grid)).sum())


def linkage(distance: np.ndarray, method: str = "average") -> np.ndarray:
    """Merge table (a, b, height, size) of a full distance matrix; new clusters are numbered from n on."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    label, size, rows = list(range(n)), np.ones(n), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        height = d[i, j]
        a, b = sorted((label[i], label[j]))
        rows.append((a, b, height, size[i] + size[j]))
        if method == "average":
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        elif method == "single":
            new = np.minimum(d[i], d[j])
        elif method == "complete":
            new = np.maximum(d[i], d[j])
        elif method == "ward":
            t = size + size[i] + size[j]
            new = np.sqrt(np.maximum(0, ((size + size[i]) * d[i] ** 2 + (size + size[j]) * d[j] ** 2 - size * height**2) / t))
        else:
            raise ValueError(f"unknown linkage {method}")
        new[i] = np.inf
        new[~alive] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += size[j]
        label[i] = n + step
    return np.array(rows).reshape(-1, 4)


def cut_tree(table: np.ndarray, n: int, clusters: int | None = None, height: float | None = None) -> np.ndarray:
    """Flat labels 1, 2, ... in the order of first members; exactly one of ``clusters`` and ``height`` is given."""
    if (clusters is None) == (height is None):
        raise ValueError("give either clusters or height")
    parent = list(range(2 * n - 1))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    use = len(table) if clusters is None else max(0, n - clusters)
    for k, (a, b, h, _) in enumerate(table):
        if (k < use) if clusters is not None else (h <= height):
            parent[root(int(a))] = n + k
            parent[root(int(b))] = n + k
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(root(i), len(seen) + 1) for i in range(n)], int)


def medoids(distance: np.ndarray, k: int = 3, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(medoids, labels) by greedy build and steepest-descent swaps; deterministic, ties to the smaller index."""
    n = len(distance)
    if not 1 <= k <= n:
        raise ValueError("k must lie between 1 and the number of rows")
    chosen = [int(np.argmin(distance.sum(axis=1)))]
    while len(chosen) < k:
        near = distance[:, chosen].min(axis=1)
        gain = np.clip(near[None, :] - distance, 0, None).sum(axis=1)
        gain[chosen] = -1
        chosen.append(int(np.argmax(gain)))
    best = distance[:, chosen].min(axis=1).sum()
    for _ in range(rounds):
        top = (best, None)
        for i in range(k):
            rest = distance[:, [c for j, c in enumerate(chosen) if j != i]].min(axis=1) if k > 1 else np.full(n, np.inf)
            costs = np.minimum(rest[None, :], distance).sum(axis=1)
            costs[chosen] = np.inf
            o = int(np.argmin(costs))
            if costs[o] < top[0] - 1e-12:
                top = (costs[o], (i, o))
        if top[1] is None:
            break
        best = top[0]
        chosen[top[1][0]] = top[1][1]
    order = np.array(sorted(chosen))
    return order, distance[:, order].argmin(axis=1)


def density_clusters(distance: np.ndarray, min_samples: int = 5, min_size: int = 5, epsilon: float = 0.0) -> np.ndarray:
    """Hierarchical density clusters on mutual reachability; -1 is noise.

    The spanning tree is cut from its longest edge down; parts of fewer than ``min_size`` rows fall off, and of every
    parent and its parts the more stable are kept. Splits below ``epsilon`` are not followed.
    """
    n = len(distance)
    if n < max(2, min_size):
        return np.full(n, -1)
    core = np.sort(distance, axis=1)[:, min(min_samples, n) - 1]
    reach = np.maximum(np.maximum(core[:, None], core[None, :]), distance)
    inside, near, source = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    edges, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        better = reach[at] < near
        near = np.where(better & ~inside, reach[at], near)
        source = np.where(better & ~inside, at, source)
        near[inside] = np.inf
        nxt = int(np.argmin(near))
        edges.append((near[nxt], int(source[nxt]), nxt))
        at = nxt
    edges.sort()
    tree = linkage_from_edges(n, edges)
    labels = np.full(n, -1)
    picked: list[list[int]] = []

    def members(node: int) -> list[int]:
        stack, out = [node], []
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack.extend(tree[v - n][:2])
        return out

    def walk(node: int, birth: float) -> tuple[float, list[list[int]]]:
        stable, whole = 0.0, members(node)
        while True:
            if node < n:
                return stable, [whole]
            a, b, h = tree[node - n]
            level = 1 / max(h, 1e-12)
            ma, mb = members(a), members(b)
            big = [c for c, m in ((a, ma), (b, mb)) if len(m) >= min_size]
            stable += (level - birth) * sum(len(m) for c, m in ((a, ma), (b, mb)) if c not in big)
            if len(big) == 2 and h > epsilon:
                stable += (level - birth) * (len(ma) + len(mb))
                parts = [walk(c, level) for c in big]
                if sum(s for s, _ in parts) > stable:
                    return sum(s for s, _ in parts), [g for _, gs in parts for g in gs]
                return stable, [whole]
            if not big:
                return stable, [whole]
            node = big[0]

    a, b, h = tree[-1]
    top = [c for c in (a, b) if len(members(c)) >= min_size]
    for c in top if len(top) == 2 else [2 * n - 2]:
        picked.extend(walk(c, 1 / max(h, 1e-12))[1])
    for k, group in enumerate(sorted(picked, key=min)):
        labels[group] = k
    return labels


def linkage_from_edges(n: int, edges: list[tuple[float, int, int]]) -> list[tuple[int, int, float]]:
    """Single-linkage tree of ascending spanning tree edges."""
    parent, node, tree = list(range(n)), list(range(n)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for h, a, b in edges:
        ra, rb = root(a), root(b)
        tree.append((node[ra], node[rb], float(h)))
        parent[rb] = ra
        node[ra] = n + len(tree) - 1
    return tree


def tof_to_mz(tof: np.ndarray, ml1: float, ml2: float, ml3: float) -> np.ndarray:
    """Calibrated m/z of flight times; a non-positive ML1 or a negative root is an error."""
    if ml1 <= 0:
        raise ValueError("ML1 must be positive")
    b, c = math.sqrt(1e12 / ml1), ml2 - tof
    if ml3 == 0:
        return (c / b) ** 2
    inner = b * b - 4 * ml3 * c
    if (inner < 0).any():
        raise ValueError("calibration has no real root")
    return ((-b + np.sqrt(inner)) / (2 * ml3)) ** 2
