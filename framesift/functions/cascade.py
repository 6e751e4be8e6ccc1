"""Object boxes by a cascade of stumps over sums of rectangles, told from integral images.

A cascade is plain data: stages of stumps. A stump adds up weighted sums of rectangles inside a window, divides by the
window's area and spread, and gives one of two values; a window stays while a stage's values reach its threshold.
Windows of one size slide over smaller and smaller copies of the image; boxes that nearly coincide make one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import pixels


@dataclass(frozen=True)
class Stump:
    """rects: (x, y, w, h, weight) inside the window; a value under the threshold gives `low`, any other `high`."""

    rects: tuple[tuple[int, int, int, int, float], ...]
    threshold: float
    low: float
    high: float


@dataclass(frozen=True)
class Cascade:
    """stages: (threshold, stumps) in order."""

    width: int
    height: int
    stages: tuple[tuple[float, tuple[Stump, ...]], ...]


def integral(plane: np.ndarray) -> np.ndarray:
    """Sums of all that lies above and to the left of each corner."""
    return np.pad(plane.astype(np.float64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)


def windows(plane: np.ndarray, cascade: Cascade, step: int = 1) -> np.ndarray:
    """(x, y) of the windows of a plane that pass all stages, in order of rows."""
    h, w = plane.shape
    if h < cascade.height or w < cascade.width:
        return np.zeros((0, 2), np.int64)
    y, x = (v.ravel() for v in np.meshgrid(np.arange(0, h - cascade.height + 1, step), np.arange(0, w - cascade.width + 1, step), indexing="ij"))
    sums, squares, area = integral(plane), integral(plane.astype(np.float64) ** 2), cascade.width * cascade.height

    def box(table: np.ndarray, dx: int, dy: int, bw: int, bh: int) -> np.ndarray:
        return table[y + dy + bh, x + dx + bw] - table[y + dy, x + dx + bw] - table[y + dy + bh, x + dx] + table[y + dy, x + dx]

    whole = (0, 0, cascade.width, cascade.height)
    spread = np.sqrt(np.maximum(box(squares, *whole) / area - (box(sums, *whole) / area) ** 2, 0))
    spread = np.where(spread > 1, spread, 1)
    for least, stumps in cascade.stages:
        votes = np.zeros(len(x))
        for s in stumps:
            value = sum(weight * box(sums, dx, dy, bw, bh) for dx, dy, bw, bh, weight in s.rects) / area
            votes += np.where(value < s.threshold * spread, s.low, s.high)
        stay = votes >= least
        x, y, spread = x[stay], y[stay], spread[stay]
    return np.stack([x, y], axis=1)


def grouped(boxes: list[tuple[int, int, int, int]], neighbours: int, near: float = 0.2) -> list[tuple[int, int, int, int]]:
    """Means of boxes that nearly coincide, of groups with more than `neighbours` of them, largest first; groups inside a
    larger and stronger one go."""
    if not boxes:
        return []
    b = np.array(boxes, float)
    group = np.arange(len(b))
    for i in range(len(b)):  # what is near to box i joins its group
        off = near * 0.5 * (np.minimum(b[i, 2], b[:, 2]) + np.minimum(b[i, 3], b[:, 3]))
        close = (np.abs(b[:, :2] - b[i, :2]) <= off[:, None]).all(1) & (np.abs(b[:, :2] + b[:, 2:] - b[i, :2] - b[i, 2:]) <= off[:, None]).all(1)
        met = np.unique(group[close])
        group[np.isin(group, met)] = met[0]
    made = [(np.rint(b[group == g].mean(axis=0)), int((group == g).sum())) for g in np.unique(group)]
    made = [(m, n) for m, n in made if n > neighbours]

    def within(a: np.ndarray, c: np.ndarray) -> bool:
        edge = near * c[2:]
        return bool((a[:2] >= c[:2] - edge).all() and (a[:2] + a[2:] <= c[:2] + c[2:] + edge).all())

    kept = [m for i, (m, n) in enumerate(made) if not any(i != j and within(m, c) and k > max(3, n) for j, (c, k) in enumerate(made))]
    return [tuple(int(v) for v in m) for m in sorted(kept, key=lambda m: (-m[2] * m[3], m[1], m[0]))]


def detected(gray: np.ndarray, cascade: Cascade, scale: float = 1.1, neighbours: int = 5, least: int = 40) -> list[tuple[int, int, int, int]]:
    """(x, y, w, h) of what the cascade finds from `least` on, largest first."""
    found, factor = [], 1.0
    while cascade.width * factor <= gray.shape[1] and cascade.height * factor <= gray.shape[0]:
        size = round(cascade.width * factor), round(cascade.height * factor)
        if min(size) >= least:
            small = np.rint(pixels.resized(gray.astype(float), round(gray.shape[0] / factor), round(gray.shape[1] / factor)))
            for x, y in windows(small, cascade, 1 if factor > 2 else 2).tolist():
                found.append((round(x * factor), round(y * factor), *size))
        factor *= scale
    return grouped(found, neighbours)


def cropped(rgb: np.ndarray, box: tuple[int, int, int, int], size: int = 512, margin: float = 1.5) -> np.ndarray | None:
    """A square around a box, `margin` times its longer side as far as the image reaches, at a size; None if nothing is left."""
    x, y, w, h = box
    side = max(w, h) * margin
    x0, y0 = max(0, round(x + w / 2 - side / 2)), max(0, round(y + h / 2 - side / 2))
    x1, y1 = min(rgb.shape[1], round(x + w / 2 + side / 2)), min(rgb.shape[0], round(y + h / 2 + side / 2))
    if x1 <= x0 or y1 <= y0:
        return None
    part = rgb[y0:y1, x0:x1].astype(float)
    return np.rint(np.einsum("yh,hwc,xw->yxc", pixels.by_area(y1 - y0, size), part, pixels.by_area(x1 - x0, size))).astype(np.uint8)
