"""Image kernels on numpy rasters: focus, exposure, subject box, descriptors and detections.

Rasters are uint8, height by width (by 3). Sums are of 64-bit integers, so results don't depend on order.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

import numpy as np

COARSE_EDGE, FINE_EDGE, GLOBAL_SIDE, SUBJECT_SIDE = 512, 1024, 32, 64


@dataclass(frozen=True)
class Metrics:
    """Defaults are those of an image too small to score."""

    sharpness: float = 0.0
    tenengrad: float = 0.0
    subject_sharpness: float = 0.0
    subject_tenengrad: float = 0.0
    contrast: float = 0.0
    exposure_score: float = 0.0
    clipped_fraction: float = 1.0
    completeness: float = 0.5
    object_confidence: float = 0.0
    border_energy_fraction: float = 1.0
    bbox_x1: float = 0.0
    bbox_y1: float = 0.0
    bbox_x2: float = 1.0
    bbox_y2: float = 1.0
    dhash: str = ""

    @property
    def box(self) -> tuple[float, float, float, float]:
        return self.bbox_x1, self.bbox_y1, self.bbox_x2, self.bbox_y2

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Detection:
    confidence: float
    subject_count: int
    truncation_risk: float
    box: tuple[float, float, float, float]


@dataclass(frozen=True)
class Descriptor:
    global_luma: np.ndarray
    subject_luma: np.ndarray
    subject_edges: np.ndarray
    subject_mask: np.ndarray
    confidence: float
    area_fraction: float


def half_up(x: float) -> int:
    return int(np.floor(x + 0.5))


def grayscale(rgb: np.ndarray) -> np.ndarray:
    c = rgb.astype(np.int32)
    return ((54 * c[..., 0] + 183 * c[..., 1] + 19 * c[..., 2] + 128) >> 8).astype(np.uint8)


# -- resampling ----------------------------------------------------------------------------------------------------------


def taps(size: int, out: int, kind: str) -> np.ndarray:
    """The weights (out by size) of a separable filter whose support grows with the reduction."""
    reach = {"triangle": 1.0, "lanczos3": 3.0}[kind]
    ratio = size / out
    scale = max(ratio, 1.0)
    centers = (np.arange(out) + 0.5) * ratio
    x = (np.arange(size)[None, :] + 0.5 - centers[:, None]) / scale
    weights = np.clip(1 - np.abs(x), 0, None) if kind == "triangle" else np.where(np.abs(x) < reach, np.sinc(x) * np.sinc(x / 3), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def resize(gray: np.ndarray, width: int, height: int, kind: str) -> np.ndarray:
    h, w = gray.shape[:2]
    rows, cols = taps(h, height, kind), taps(w, width, kind)
    if gray.ndim == 2:
        out = rows @ gray.astype(float) @ cols.T
    else:
        out = np.stack([rows @ gray[..., i].astype(float) @ cols.T for i in range(gray.shape[2])], axis=-1)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def resize_long_edge(image: np.ndarray, edge: int, kind: str = "triangle") -> np.ndarray:
    """Reduced so that the longer edge is ``edge``; smaller images stay."""
    h, w = image.shape[:2]
    longest = max(h, w)
    if longest <= edge:
        return image
    scale = edge / longest
    return resize(image, max(1, half_up(w * scale)), max(1, half_up(h * scale)), kind)


# -- focus and exposure --------------------------------------------------------------------------------------------------


def focus_sums(gray: np.ndarray) -> tuple[int, int, int, int]:
    """Sums of the Laplacian over inner pixels, of its square, and of squared forward differences along x and y."""
    g = gray.astype(np.int64)
    lap = g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] - 4 * g[1:-1, 1:-1]
    dx, dy = np.diff(g, axis=1), np.diff(g, axis=0)
    return int(lap.sum()), int((lap * lap).sum()), int((dx * dx).sum()), int((dy * dy).sum())


def combine_focus(sums: tuple[int, int, int, int], width: int, height: int) -> tuple[float, float]:
    """(sharpness, tenengrad) from sums, which may come from parts of the image that were summed apart."""
    if min(sums[1:]) < 0:
        raise ValueError("sums of squares can't be negative")
    inner = (width - 2) * (height - 2)
    sharp = sums[1] / inner - (sums[0] / inner) ** 2 if width >= 3 and height >= 3 else 0.0
    return sharp, sums[2] / max((width - 1) * height, 1) + sums[3] / max(width * (height - 1), 1)


def focus(gray: np.ndarray) -> tuple[float, float]:
    h, w = gray.shape
    return combine_focus(focus_sums(gray), w, h) if h and w else (0.0, 0.0)


def histogram_percentile(counts: np.ndarray, n: int, percent: float) -> int:
    """The first bin at which more than the share of n - 1, rounded, has been seen; the last bin if none is."""
    if n <= 0:
        return 0
    seen = np.flatnonzero(np.cumsum(counts) > half_up((n - 1) * percent / 100))
    return int(seen[0]) if len(seen) else len(counts) - 1


def exposure(gray: np.ndarray) -> tuple[float, float, float]:
    """(contrast, exposure score, clipped fraction)."""
    counts = np.bincount(gray.ravel(), minlength=256)
    n = gray.size
    contrast = max(histogram_percentile(counts, n, 95) - histogram_percentile(counts, n, 5), 0) / 255
    clipped = float(counts[:3].sum() + counts[253:].sum()) / n
    mean = float((counts * np.arange(256)).sum()) / (n * 255.0)
    score = max(1 - min(6 * clipped + 0.35 * min(abs(mean - 0.52) / 0.52, 1.0), 1.0), 0.0)
    return contrast, score, clipped


def dhash(gray: np.ndarray) -> str:
    """64 comparisons of neighbours in a 9 by 8 reduction, the first the highest bit."""
    small = resize(gray, 9, 8, "lanczos3")
    bits = np.packbits((small[:, 1:] > small[:, :-1]).ravel())
    return bits.tobytes().hex()


def hash_distance(a: str, b: str) -> int:
    try:
        if not (0 < len(a) <= 16 and 0 < len(b) <= 16) or "_" in a + b or a[0] in "+-" or b[0] in "+-":
            return 64
        return (int(a, 16) ^ int(b, 16)).bit_count()
    except ValueError:
        return 64


# -- connected components ------------------------------------------------------------------------------------------------


def label(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, int]:
    """Numbers from 1 for the connected parts of a mask, in order of their first pixel; 0 outside.

    Every pixel takes the least number around it until nothing changes, with numbers followed to their own each round.
    """
    flat = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    h, w = mask.shape
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    while True:
        before = flat.copy()
        for dy, dx in steps:
            a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
            b = (slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
            both = mask[a] & mask[b]
            least = np.where(both, np.minimum(flat[a], flat[b]), 0)
            flat[a] = np.where(both, least, flat[a])
            flat[b] = np.where(both, np.minimum(least, flat[b]), flat[b])
        table = np.append(flat.ravel(), mask.size)
        flat = np.where(mask, table[table[flat]], mask.size)
        if (flat == before).all():
            break
    roots, numbers = np.unique(flat[mask], return_inverse=True)
    out = np.zeros(mask.shape, np.int64)
    out[mask] = numbers + 1
    return out, len(roots)


@dataclass(frozen=True)
class Parts:
    """One value for each connected part."""

    x1: np.ndarray
    y1: np.ndarray
    x2: np.ndarray
    y2: np.ndarray
    pixels: np.ndarray


def parts_of(labels: np.ndarray, n: int) -> Parts:
    ys, xs = np.nonzero(labels)
    at = labels[ys, xs] - 1
    low = lambda v, size: np.minimum.reduceat(v[order], starts) if n else np.zeros(0, int)
    high = lambda v: np.maximum.reduceat(v[order], starts) if n else np.zeros(0, int)
    order = np.argsort(at, kind="stable")
    counts = np.bincount(at, minlength=n)
    starts = np.cumsum(counts) - counts
    return Parts(low(xs, n), low(ys, n), high(xs), high(ys), counts)


# -- the subject's box ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Box:
    box: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)
    confidence: float = 0.0
    completeness: float = 0.5
    border: float = 0.0

    @property
    def area(self) -> float:
        x1, y1, x2, y2 = self.box
        return min(max(x2 - x1, 0.0) * max(y2 - y1, 0.0), 1.0)


def box_iou(a: tuple, b: tuple) -> float:
    both = max(min(a[2], b[2]) - max(a[0], b[0]), 0.0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0.0)
    either = Box(a).area + Box(b).area - both
    return both / either if either > 0 else 0.0


def local_means(gray: np.ndarray, radius: int) -> np.ndarray:
    """Whole-number means of the squares around each pixel, cut at the edges, by an integral image."""
    h, w = gray.shape
    sums = np.zeros((h + 1, w + 1), np.int64)
    sums[1:, 1:] = gray.astype(np.int64).cumsum(0).cumsum(1)
    y1, y2 = np.clip(np.arange(h) - radius, 0, h), np.clip(np.arange(h) + radius + 1, 0, h)
    x1, x2 = np.clip(np.arange(w) - radius, 0, w), np.clip(np.arange(w) + radius + 1, 0, w)
    inside = sums[np.ix_(y2, x2)] + sums[np.ix_(y1, x1)] - sums[np.ix_(y1, x2)] - sums[np.ix_(y2, x1)]
    return inside // ((y2 - y1)[:, None] * (x2 - x1)[None, :])


def saliency(gray: np.ndarray) -> tuple[np.ndarray, int]:
    """How much each inner pixel stands out, and from what value on it counts as strong."""
    h, w = gray.shape
    g = gray.astype(np.int64)
    radius = min(max(half_up(min(w, h) * 0.015), 3), 9)
    gradient = np.abs(g[1:-1, 2:] - g[1:-1, :-2]) + np.abs(g[2:, 1:-1] - g[:-2, 1:-1])
    off = g[1:-1, 1:-1] - local_means(gray, radius)[1:-1, 1:-1]
    scores = np.zeros((h, w), np.int64)
    scores[1:-1, 1:-1] = np.clip(2 * gradient + 3 * np.abs(off) + np.maximum(-off, 0), 0, 2047)
    counts = np.bincount(scores[1:-1, 1:-1].ravel(), minlength=2048)
    return scores, max(histogram_percentile(counts, (w - 2) * (h - 2), 98.7), 48)


def dilate(mask: np.ndarray) -> np.ndarray:
    padded = np.pad(mask, 1)
    h, w = mask.shape
    return np.logical_or.reduce([padded[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)])


def salient_box(gray: np.ndarray, edge: int) -> Box:
    small = resize_long_edge(gray, edge)
    h, w = small.shape
    if w < 8 or h < 8:
        return Box()
    scores, threshold = saliency(small)
    strong = scores >= threshold
    labels, n = label(dilate(strong), diagonal=True)
    if not n:
        return Box()
    p = parts_of(labels, n)
    at = labels[strong] - 1
    strong_pixels = np.bincount(at, minlength=n)
    energy = np.bincount(at, weights=scores[strong], minlength=n)
    rim = np.ones((h, w), bool)
    rim[1:-1, 1:-1] = False
    on_rim = labels[rim & (labels > 0)] - 1
    border = np.bincount(on_rim, minlength=n)
    area = (p.x2 - p.x1 + 1) * (p.y2 - p.y1 + 1)
    density = strong_pixels / np.maximum(area, 1)
    score = energy * (0.35 + 0.65 * np.sqrt(density)) * np.where(border > 0, 0.7, 1.0) / np.maximum(area**0.12, 1.0)
    fit = np.flatnonzero((strong_pixels >= 2) & (area <= w * h * 3 // 5) & (p.pixels >= 4))
    if not len(fit):
        return Box()
    ranked = fit[np.argsort(-score[fit], kind="stable")]
    best, second = ranked[0], score[ranked[1]] if len(ranked) > 1 else 0.0
    dominance = score[best] / max(score[best] + second, 1e-9)
    strength = np.clip((energy[best] / max(strong_pixels[best], 1) / threshold - 1) / 2, 0, 1)
    size = np.clip(np.sqrt(strong_pixels[best] / 20), 0.25, 1)
    confidence = 0.16 + 0.34 * dominance + 0.22 * np.sqrt(density[best]) + 0.16 * strength + 0.12 * size
    confidence = float(np.clip(confidence * (1.0 if area[best] / (w * h) <= 0.35 else 0.45), 0, 0.98))
    x1, y1 = max(p.x1[best] - 2, 0), max(p.y1[best] - 2, 0)
    x2, y2 = min(p.x2[best] + 3, w), min(p.y2[best] + 3, h)
    margin = np.clip(min(x1, y1, w - x2, h - y2) / max(min(w, h) * 0.035, 1.0), 0, 1)
    at_border = float(border[best] / max(p.pixels[best], 1))
    complete = 0.5 if confidence < 0.3 else float(np.clip(0.85 * margin + 0.15 * (1 - at_border), 0, 1))
    return Box((float(x1 / w), float(y1 / h), float(x2 / w), float(y2 / h)), confidence, complete, at_border)


def subject_box(gray: np.ndarray) -> Box:
    """At a small size; again at twice that where the first is small or unsure, which counts if it isn't worse and agrees."""
    coarse = salient_box(gray, COARSE_EDGE)
    if max(gray.shape) <= COARSE_EDGE or (coarse.area >= 0.025 and coarse.confidence >= 0.52):
        return coarse
    fine = salient_box(gray, FINE_EDGE)
    agrees = box_iou(coarse.box, fine.box) >= 0.20 or coarse.confidence < 0.28
    return fine if fine.confidence >= 0.82 * coarse.confidence and fine.area <= 0.45 and agrees else coarse


def pixel_box(box: tuple, width: int, height: int) -> tuple[int, int, int, int]:
    x1, y1, x2, y2 = np.clip(box, 0.0, 1.0)
    return int(np.floor(x1 * width)), int(np.floor(y1 * height)), int(np.ceil(x2 * width)), int(np.ceil(y2 * height))


def focus_in_box(gray: np.ndarray, box: tuple) -> tuple[float, float]:
    h, w = gray.shape
    x1, y1, x2, y2 = pixel_box(box, w, h)
    return focus(gray[y1 : min(y2, h), x1 : min(x2, w)]) if x2 > x1 + 2 and y2 > y1 + 2 else (0.0, 0.0)


def score_image(rgb: np.ndarray) -> tuple[Metrics, str]:
    """All measures of an image and the backend that made them."""
    h, w = rgb.shape[:2]
    if w < 8 or h < 8:
        return Metrics(), "cpu_small_image"
    gray = grayscale(rgb)
    sharp, ten = focus(gray)
    contrast, exposed, clipped = exposure(gray)
    box = subject_box(gray)
    inner = focus_in_box(gray, box.box)
    return Metrics(sharp, ten, *inner, contrast, exposed, clipped, box.completeness, box.confidence, box.border, *box.box, dhash(gray)), "cpu"


# -- descriptors ---------------------------------------------------------------------------------------------------------


def edge_descriptor(gray: np.ndarray) -> np.ndarray:
    g = gray.astype(np.int64)
    out = np.zeros(gray.shape, np.uint8)
    out[1:-1, 1:-1] = np.minimum(np.abs(g[1:-1, 2:] - g[1:-1, :-2]) + np.abs(g[2:, 1:-1] - g[:-2, 1:-1]), 255)
    return out


def foreground_mask(gray: np.ndarray) -> np.ndarray:
    """1 where a pixel is off the background, the median of the rim, by three times what the rim itself is off."""
    h, w = gray.shape
    b = min(6, min(w, h) // 4)
    rim = np.ones(gray.shape, bool)
    if b:
        rim[b : h - b, b : w - b] = False
    else:
        rim[:] = False
    n = int(rim.sum())
    background = histogram_percentile(np.bincount(gray[rim], minlength=256), n, 50)
    off = np.abs(gray.astype(np.int64) - background)
    usual = histogram_percentile(np.bincount(off[rim], minlength=256), n, 70)
    return (off >= min(max(3 * usual, 12), 72)).astype(np.uint8)


def describe(rgb: np.ndarray, metrics: Metrics) -> Descriptor:
    gray = grayscale(rgb)
    h, w = gray.shape
    x1, y1, x2, y2 = pixel_box(metrics.box, w, h)
    bw, bh = max(x2 - x1, 1), max(y2 - y1, 1)
    fraction = min(max(bw * bh / (w * h), 0.0), 1.0)
    side = min(max(max(bw, bh) * 1.65, 18.0), float(min(w, h)))
    cx, cy = (x1 + x2) * 0.5, (y1 + y2) * 0.5
    cut_x1, cut_y1 = min(max(half_up(cx - side / 2), 0), w - 1), min(max(half_up(cy - side / 2), 0), h - 1)
    cut_x2, cut_y2 = min(max(half_up(cx + side / 2), cut_x1 + 1), w), min(max(half_up(cy + side / 2), cut_y1 + 1), h)
    subject = resize(gray[cut_y1:cut_y2, cut_x1:cut_x2], SUBJECT_SIDE, SUBJECT_SIDE, "lanczos3")
    mask = foreground_mask(subject)
    trust = (1.0 if 0.002 <= mask.mean() <= 0.65 else 0.45) * (1.0 if fraction <= 0.45 else 0.4)
    whole = resize(gray, GLOBAL_SIDE, GLOBAL_SIDE, "triangle")
    return Descriptor(whole.ravel(), subject.ravel(), edge_descriptor(subject).ravel(), mask.ravel(), min(max(metrics.object_confidence * trust, 0.0), 1.0), fraction)


def correlation_distance(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) != len(b) or not len(a):
        return 1.0
    x, y, n = a.astype(np.int64), b.astype(np.int64), len(a)
    va, vb = n * (x @ x) - x.sum() ** 2, n * (y @ y) - y.sum() ** 2
    if not va or not vb:
        return float(np.abs(x - y).sum() / 255.0 / n)
    return float(np.clip((1 - np.clip((n * (x @ y) - x.sum() * y.sum()) / (np.sqrt(float(va)) * np.sqrt(float(vb))), -1, 1)) * 0.5, 0, 1))


def cosine_distance(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) != len(b) or not len(a):
        return 1.0
    x, y = a.astype(np.int64), b.astype(np.int64)
    size = np.sqrt(float(x @ x)) * np.sqrt(float(y @ y))
    return float(np.clip(1 - (x @ y) / size, 0, 1)) if size else 1.0


def mask_distance(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(1 - Jaccard, reliability)."""
    if len(a) != len(b) or not len(a):
        return 1.0, 0.0
    both, either = int(((a != 0) & (b != 0)).sum()), int(((a != 0) | (b != 0)).sum())
    return (1.0, 0.35) if either < 8 else (1 - both / either, float(np.clip(np.sqrt(either / 80), 0.35, 1)))


def compare(a: Descriptor, b: Descriptor) -> tuple[float, float, float, float]:
    """(distance, confidence, subject distance, global distance)."""
    overall = correlation_distance(a.global_luma, b.global_luma)
    if not len(a.subject_luma) or not len(b.subject_luma):
        return overall, 0.0, 1.0, overall
    mask, reliability = mask_distance(a.subject_mask, b.subject_mask)
    subject = 0.42 * mask + 0.38 * cosine_distance(a.subject_edges, b.subject_edges) + 0.20 * correlation_distance(a.subject_luma, b.subject_luma)
    confidence = min(max(min(a.confidence, b.confidence) * reliability, 0.0), 1.0)
    distance = 0.92 * subject + 0.08 * overall if confidence >= 0.25 else 0.70 * subject + 0.30 * overall
    return min(max(distance, 0.0), 1.0), confidence, subject, overall


# -- detections ----------------------------------------------------------------------------------------------------------


def detect_in_mask(probabilities: np.ndarray) -> Detection | None:
    """The subjects in a map of probabilities (height by width): parts from 0.5 on, the small ones of them left out."""
    h, w = probabilities.shape
    p = np.where(np.isfinite(probabilities), probabilities, 0.0).astype(np.float32)
    labels, n = label(p >= 0.5, diagonal=False)
    if not n:
        return None
    parts = parts_of(labels, n)
    inside = labels > 0
    at = labels[inside] - 1
    values = np.clip(p[inside].astype(float), 0, 1)
    sums, peaks = np.bincount(at, weights=values, minlength=n), np.zeros(n)
    np.maximum.at(peaks, at, values)
    ex, ey = max(w // 50, 1), max(h // 50, 1)
    rim = np.ones((h, w), bool)
    rim[ey : h - ey, ex : w - ex] = False
    edges = np.bincount(labels[inside & rim] - 1, minlength=n)
    kept = np.flatnonzero(parts.pixels >= max(w * h // 20_000, 4))
    if not len(kept):
        return None
    kept = kept[np.argsort(-parts.pixels[kept], kind="stable")]
    first = kept[0]
    used = kept[parts.pixels[kept] * 20 >= parts.pixels[first]]
    box = (parts.x1[used].min() / w, parts.y1[used].min() / h, (parts.x2[used].max() + 1) / w, (parts.y2[used].max() + 1) / h)
    confidence = min(max(0.75 * sums[first] / parts.pixels[first] + 0.25 * peaks[first], 0.0), 1.0)
    margin = max(min(box[0], box[1], 1 - box[2], 1 - box[3]), 0.0)
    near = 1 - min(margin / 0.04, 1.0)
    touching = min(edges[used].sum() / parts.pixels[used].sum() * 4, 1.0)
    return Detection(float(confidence), len(kept), float(min(max(0.70 * near + 0.30 * touching, 0.0), 1.0)), tuple(map(float, box)))


def heuristic_detection(m: Metrics) -> Detection:
    return Detection(m.object_confidence, int(m.object_confidence > 0.05), 1 - m.completeness, m.box)


def merge_detection(m: Metrics, d: Detection | None) -> Metrics:
    if d is None or d.confidence <= 0 or not d.subject_count:
        return m
    complete = 0.62 * m.completeness + 0.38 * min(max(1 - d.truncation_risk, 0.0), 1.0)
    x1, y1, x2, y2 = d.box
    return replace(m, object_confidence=max(m.object_confidence, d.confidence), completeness=min(max(complete, 0.0), 1.0), bbox_x1=x1, bbox_y1=y1, bbox_x2=x2, bbox_y2=y2)


def refocus(rgb: np.ndarray, m: Metrics) -> Metrics:
    """Subject focus again, in the box the metrics now have."""
    sharp, ten = focus_in_box(grayscale(rgb), m.box)
    return replace(m, subject_sharpness=sharp, subject_tenengrad=ten)
