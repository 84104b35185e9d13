"""Measures of pixels in NumPy, for images in the portable graymap and pixmap formats. Other formats come
through an adapter that decodes them into arrays; no image library is needed here."""

from __future__ import annotations

import re

import numpy as np

_HEAD = re.compile(rb"(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")
#: Shares of red, green and blue in a gray tone; a block of at least so many pixels a side; sharpness
#: below which an image is blurry, or soft.
LUMA, BLOCK, BLURRY, SOFT = (0.299, 0.587, 0.114), 48, 300.0, 1200.0


def read(data: bytes | None) -> np.ndarray | None:
    """Rows, columns (and colours) of one byte each; None for what isn't such an image, or is cut off."""
    head = _HEAD.match(data or b"")
    if not head or int(head[4]) != 255:
        return None
    w, h, depth = int(head[2]), int(head[3]), 3 if head[1] == b"P6" else 1
    flat = np.frombuffer(data, dtype=np.uint8, offset=head.end())
    if not w * h or len(flat) < w * h * depth:
        return None
    image = flat[: w * h * depth].reshape(h, w, depth)
    return image if depth == 3 else image[:, :, 0]


def first_readable(*candidates: bytes | None) -> np.ndarray | None:
    """The first candidate that is an image: a thumbnail, then the original."""
    return next((image for image in map(read, candidates) if image is not None), None)


def gray(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) if image.ndim == 2 else image @ np.array(LUMA)


def _cover(size: int, parts: int) -> np.ndarray:
    """How much of each pixel lies in each of so many equal parts of a side, as shares of the part."""
    ends = np.arange(parts + 1) * size / parts
    at = np.arange(size)
    inside = np.minimum(ends[1:, None], at + 1) - np.maximum(ends[:-1, None], at)
    return np.clip(inside, 0, None) * parts / size


def resized(tones: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over the areas of a coarser grid."""
    return _cover(tones.shape[0], rows) @ tones @ _cover(tones.shape[1], columns).T


def shrunk(image: np.ndarray, edge: int) -> np.ndarray:
    """The gray image with its longer side at most `edge`."""
    tones = gray(image)
    factor = edge / max(tones.shape)
    return tones if factor >= 1 else resized(tones, max(1, round(tones.shape[0] * factor)), max(1, round(tones.shape[1] * factor)))


def difference_hash(image: np.ndarray) -> int:
    """64 bits, one per horizontal neighbour pair of an 8 x 9 grid that grows lighter; signed."""
    grid = np.round(resized(gray(image), 8, 9))
    return int.from_bytes(np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes(), "big", signed=True)


def _roughness(tones: np.ndarray) -> float:
    """Variance of the second differences in both directions, mirrored at the border."""
    p = np.pad(tones, 1, mode="reflect") if min(tones.shape) > 1 else np.pad(tones, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * tones).var())


def sharpness(image: np.ndarray, grid: int = 4) -> dict:
    """sharp_score (mean of the sharpest quarter of the blocks), med_score and label."""
    tones = np.round(gray(image))
    side = max(BLOCK, min(tones.shape) // grid)
    corners = [range(0, n - side + 1, side) for n in tones.shape]
    blocks = sorted(_roughness(tones[y : y + side, x : x + side]) for y in corners[0] for x in corners[1]) or [_roughness(tones)]
    best = float(np.mean(blocks[-max(1, len(blocks) // 4) :]))
    label = "blurry" if best < BLURRY else "soft" if best < SOFT else "sharp"
    return {"sharp_score": round(best, 1), "med_score": round(float(np.median(blocks)), 1), "label": label}


def tone_stats(image: np.ndarray) -> dict:
    """p1 and p99 of the gray tones, and mean saturation, all from 0 to 1."""
    light = gray(image) / 255
    if image.ndim == 2:
        saturation = 0.0
    else:
        high, low = image.max(axis=2) / 255, image.min(axis=2) / 255
        saturation = float(np.where(high > 0, (high - low) / np.maximum(high, 1e-6), 0.0).mean())
    return {"p1": float(np.percentile(light, 1)), "p99": float(np.percentile(light, 99)), "sat": saturation}


def edge_stats(image: np.ndarray) -> dict:
    """Spreads of the three pixels along each edge, and of the top 6 % of the rows (8 at least)."""
    g = gray(image)
    parts = (g[:3], g[-3:], g[:, :3], g[:, -3:])
    return {"height": g.shape[0], "width": g.shape[1], "edges": [float(x.std()) for x in parts], "top": float(g[: max(8, int(g.shape[0] * 0.06))].std())}
