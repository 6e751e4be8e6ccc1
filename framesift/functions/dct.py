"""What lossy coding by 8 x 8 cosine blocks does to an image: colour change, halved chroma, quantisation, and back.

Only these steps lose anything; the entropy coding between them does not, so it is left out.
"""

from __future__ import annotations

import numpy as np

# The standard's example quantisation steps for brightness and colour, by row of frequencies.
BRIGHTNESS = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99],
])
COLOUR = np.array([
    [17, 18, 24, 47, 99, 99, 99, 99], [18, 21, 26, 66, 99, 99, 99, 99], [24, 26, 56, 99, 99, 99, 99, 99], [47, 66, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99], [99, 99, 99, 99, 99, 99, 99, 99], [99, 99, 99, 99, 99, 99, 99, 99], [99, 99, 99, 99, 99, 99, 99, 99],
])
#: Cosine of each frequency (row) at each of eight places, orthonormal.
BASIS = np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(8) + 1) / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]
#: Added before rounding down, so that halves go up however a sum came about.
_HALF = 0.5 + 1e-9


def steps(table: np.ndarray, quality: int) -> np.ndarray:
    """Quantisation steps of a quality from 1 to 100."""
    if not 1 <= quality <= 100:
        raise ValueError("quality must lie in 1..100")
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((table * scale + 50) // 100, 1, 255)


def _whole(plane: np.ndarray, unit: int) -> np.ndarray:
    """The plane, its last row and column repeated up to whole units."""
    return np.pad(plane, [(0, -n % unit) for n in plane.shape], mode="edge")


def quantised(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A plane of 0..255 after its blocks' frequencies were rounded to whole steps."""
    h, w = plane.shape
    x = _whole(plane, 8)
    blocks = x.reshape(x.shape[0] // 8, 8, -1, 8).swapaxes(1, 2) - 128.0
    frequencies = np.floor(BASIS @ blocks @ BASIS.T / table + _HALF) * table
    back = (BASIS.T @ frequencies @ BASIS + 128).swapaxes(1, 2).reshape(x.shape)
    return np.clip(np.floor(back + _HALF), 0, 255)[:h, :w]


def _doubled(plane: np.ndarray) -> np.ndarray:
    """Twice the rows and columns: three parts of the nearer sample, one of the further."""
    for axis in (0, 1):
        x = np.moveaxis(plane, axis, 0)
        before, after = np.concatenate([x[:1], x[:-1]]), np.concatenate([x[1:], x[-1:]])
        x = np.stack([3 * x + before, 3 * x + after], axis=1).reshape(-1, *x.shape[1:]) / 4
        plane = np.moveaxis(x, 0, axis)
    return plane


def recoded(rgb: np.ndarray, quality: int, halved: bool = True) -> np.ndarray:
    """Red, green, blue after coding at a quality, with chroma of half the resolution unless told otherwise."""
    r, g, b = (rgb[..., k].astype(float) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    planes = [np.floor(p + _HALF).clip(0, 255) for p in planes]
    y, colours = quantised(planes[0], steps(BRIGHTNESS, quality)), []
    for p in planes[1:]:
        if halved:
            small = _whole(p, 2)
            small = np.floor(small.reshape(small.shape[0] // 2, 2, -1, 2).mean(axis=(1, 3)) + _HALF)
            p = _doubled(quantised(small, steps(COLOUR, quality)))[: y.shape[0], : y.shape[1]]
        else:
            p = quantised(p, steps(COLOUR, quality))
        colours.append(p - 128)
    blue, red = colours
    out = np.stack([y + 1.402 * red, y - 0.344136 * blue - 0.714136 * red, y + 1.772 * blue], axis=-1)
    return np.clip(np.floor(out + _HALF), 0, 255).astype(np.uint8)
