"""Grey images as arrays of bytes: what needs no image library."""

from __future__ import annotations

import unicodedata

import numpy as np


def crop(image: np.ndarray, polygon: list[tuple[float, float]]) -> np.ndarray:
    """The box around a polygon, as far as it is in the image."""
    x, y = (np.array(c, float) for c in zip(*polygon, strict=True))
    return image[max(0, int(y.min())) : max(0, int(y.max())), max(0, int(x.min())) : max(0, int(x.max()))]


def grey_range(image: np.ndarray, around: int = 16) -> tuple[int, int]:
    """The background's greys: the median of the light pixels less and plus some; of white where there are none."""
    light = image[image > 127]
    mid = int(np.median(light)) if light.size else 255
    return max(0, mid - around), min(255, mid + around)


def otsu(image: np.ndarray) -> int:
    """The threshold that parts dark from light with the largest variance between them."""
    n = np.bincount(image.reshape(-1), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = mass / below - (mass[-1] - mass) / above
    return int(np.nanargmax(np.where((below > 0) & (above > 0), below * above * gap**2, 0.0)))


def binarise(image: np.ndarray) -> np.ndarray:
    return np.where(image > otsu(image), 255, 0).astype(np.uint8)


def pad(image: np.ndarray, width: int) -> np.ndarray:
    """The image with a border in the grey of its background."""
    return np.pad(image, width, constant_values=sum(grey_range(image)) // 2)


def char_boxes(line: str, width: int, height: int) -> list[str]:
    """The lines of a box file for a text from left to right: one per character with its combining marks, then the end."""
    out: list[str] = []
    for c in unicodedata.normalize("NFC", line.strip()):
        if out and unicodedata.combining(c):
            out[-1] += c
        else:
            out.append(c)
    return [f"{c} 0 0 {width} {height} 0" for c in [*out, "\t"]] if out else []
