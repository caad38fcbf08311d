"""Resampling kernels as weight matrices, for use inside tasks.

An output sample is a weighted sum of the input samples under the kernel, centred on its position
and widened by the scale when shrinking; weights are normalised to sum to one. Rows and columns are
handled one after the other, so a picture is resized by two matrix products.
"""

from __future__ import annotations

import numpy as np


def _cubic(x: np.ndarray) -> np.ndarray:
    """Catmull-Rom cubic."""
    x = np.abs(x)
    near = (1.5 * x - 2.5) * x * x + 1.0
    far = ((-0.5 * x + 2.5) * x - 4.0) * x + 2.0
    return np.where(x < 1.0, near, np.where(x < 2.0, far, 0.0))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3.0, np.sinc(x) * np.sinc(x / 3.0), 0.0)


def _linear(x: np.ndarray) -> np.ndarray:
    return np.maximum(1.0 - np.abs(x), 0.0)


# Kernel and support by name, and the names of the numbered filters.
KERNELS = {"bicubic": (_cubic, 2.0), "lanczos": (_lanczos, 3.0), "bilinear": (_linear, 1.0)}
FILTER_NUMBERS = {0: "nearest", 1: "bilinear", 2: "bilinear", 3: "bicubic"}


_WEIGHTS: dict[tuple, np.ndarray] = {}
_WEIGHTS_BYTES = 32 << 20
_ROOM: dict[str, np.ndarray] = {}


def weights(size: int, new_size: int, kernel: str, part: tuple[int, int] | None = None) -> np.ndarray:
    """(new_size, size) matrix that resamples one axis, or its rows ``part`` (first, count).

    The last matrices are kept per worker, 32 MB of them at most.
    """
    wanted = (size, new_size, kernel, part or (0, new_size))
    if wanted not in _WEIGHTS:
        found = _axis_weights(*wanted)
        if found.nbytes + sum(m.nbytes for m in _WEIGHTS.values()) > _WEIGHTS_BYTES:
            _WEIGHTS.clear()
        _WEIGHTS[wanted] = found
    return _WEIGHTS[wanted]


def _room(name: str, *shape: int) -> np.ndarray:
    """A buffer kept per worker: memory touched before is far cheaper than new pages for every picture."""
    needed = int(np.prod(shape))
    if name not in _ROOM or len(_ROOM[name]) < needed:
        _ROOM[name] = np.empty(needed)
    return _ROOM[name][:needed].reshape(shape)


def _axis_weights(size: int, new_size: int, kernel: str, part: tuple[int, int]) -> np.ndarray:
    ratio = size / new_size
    centre = (np.arange(part[0], part[0] + part[1]) + 0.5) * ratio
    if kernel == "nearest":
        chosen = np.minimum(np.floor(centre).astype(int), size - 1)
        return (np.arange(size)[None, :] == chosen[:, None]).astype("f8")
    function, support = KERNELS[kernel]
    scale = max(ratio, 1.0)
    distance = np.arange(size)[None, :] - (centre[:, None] - 0.5)
    low = np.clip(np.floor(centre - support * scale), 0, size - 1)
    high = np.clip(np.ceil(centre + support * scale), low + 1, size)
    inside = (np.arange(size)[None, :] >= low[:, None]) & (np.arange(size)[None, :] < high[:, None])
    out = np.where(inside, function(distance / scale), 0.0)
    return out / out.sum(axis=1, keepdims=True)


def resize_planes(
    planes: np.ndarray,
    new_w: int,
    new_h: int,
    kernel: str,
    box: tuple[int, int, int, int] | None = None,
    reuse: bool = False,
) -> np.ndarray:
    """(c, h, w) samples resized to (c, new_h, new_w), not rounded.

    With a box (left, top, width, height) only that part of the result is computed. With ``reuse`` the
    result may lie in a buffer that the next call overwrites.
    """
    c, h, w = planes.shape
    left, top, out_w, out_h = box or (0, 0, new_w, new_h)
    # Channels often lie side by side; matrix products want each plane in one piece.
    planes = planes.astype("f8", order="C")
    if (w, h) == (new_w, new_h):
        return planes[:, top : top + out_h, left : left + out_w]
    down = weights(h, new_h, kernel, (top, out_h))
    across = weights(w, new_w, kernel, (left, out_w))
    if not reuse:
        return np.matmul(np.matmul(down, planes), across.T)
    tall = np.matmul(down, planes, out=_room("tall", c, out_h, w))
    return np.matmul(tall, across.T, out=_room("done", c, out_h, out_w))


def resize(pixels: np.ndarray, new_w: int, new_h: int, kernel: str) -> np.ndarray:
    """(h, w, c) samples resized to (new_h, new_w, c), not rounded."""
    return resize_planes(pixels.transpose(2, 0, 1), new_w, new_h, kernel).transpose(1, 2, 0)


def to_levels(samples: np.ndarray) -> np.ndarray:
    """Samples rounded half up and clamped to 0..255, in place.

    Sums may differ in their last bits between machines; the small addition keeps exact halves
    (common in smooth pictures) on the upper side everywhere.
    """
    samples += 0.5 + 1e-9
    np.floor(samples, out=samples)
    return np.clip(samples, 0, 255, out=samples)


def to_bytes(samples: np.ndarray) -> np.ndarray:
    """``to_levels`` as bytes, of a copy."""
    return to_levels(samples.astype("f8")).astype(np.uint8)
