import numpy as np
import pytest
from conftest import pose

from framesift.functions import kernels as K


def test_moved_subject_is_closer_than_turned():
    frames = [pose(90), pose(220), pose(90, vertical=True)]
    metrics = [K.score_image(f)[0] for f in frames]
    found = [K.describe(f, m) for f, m in zip(frames, metrics)]
    assert found[0].confidence > 0.25
    assert K.compare(found[0], found[1])[0] < K.compare(found[0], found[2])[0]
    assert K.compare(found[0], found[0])[0] < 1e-9


def test_probability_masks():
    p = np.zeros((20, 20))
    p[6:12, 4:14] = 0.9
    d = K.detect_in_mask(p)
    assert d.subject_count == 1 and d.box == (0.2, 0.3, 0.7, 0.6)
    merged = K.merge_detection(K.Metrics(), d)
    assert merged.object_confidence > 0.85 and merged.box == d.box
    edge = np.zeros((20, 20))
    edge[6:14, :5] = 0.95
    assert K.detect_in_mask(edge).truncation_risk > 0.65
    assert K.detect_in_mask(np.zeros((20, 20))) is None
    assert K.detect_in_mask(np.full((4, 4), np.nan)) is None


def test_focus_partials():
    assert K.combine_focus((0, 100, 80, 60), 3, 3) == (100.0, 80 / 6 + 60 / 6)
    with pytest.raises(ValueError):
        K.combine_focus((0, -1, 0, 0), 3, 3)


@pytest.mark.parametrize("shape", [(8, 8), (9, 17), (35, 67), (64, 1), (1, 64), (2, 2)])
@pytest.mark.parametrize("seed", range(4))
def test_focus_matches_loops(shape, seed):
    g = np.random.default_rng(seed).integers(0, 256, shape).astype(np.uint8)
    h, w = shape
    laps = [int(g[y, x - 1]) + int(g[y, x + 1]) + int(g[y - 1, x]) + int(g[y + 1, x]) - 4 * int(g[y, x]) for y in range(1, h - 1) for x in range(1, w - 1)]
    dx = [(int(g[y, x + 1]) - int(g[y, x])) ** 2 for y in range(h) for x in range(w - 1)]
    dy = [(int(g[y + 1, x]) - int(g[y, x])) ** 2 for y in range(h - 1) for x in range(w)]
    sharp, ten = K.focus(g)
    assert ten == pytest.approx(sum(dx) / max(len(dx), 1) + sum(dy) / max(len(dy), 1), rel=1e-10)
    want = sum(v * v for v in laps) / len(laps) - (sum(laps) / len(laps)) ** 2 if laps else 0.0
    assert sharp == pytest.approx(want, rel=1e-10, abs=1e-9)


def test_hash_distance():
    assert K.hash_distance("ffffffffffffffff", "0000000000000000") == 64
    assert K.hash_distance("0f", "00") == 4
    for bad in ("", "zz", "12zz", "1" * 17):
        assert K.hash_distance(bad, "00") == 64


def test_labels_match_flood_fill():
    rng = np.random.default_rng(5)
    for diagonal in (False, True):
        mask = rng.random((23, 31)) < 0.45
        labels, n = K.label(mask, diagonal)
        seen, count = np.zeros(mask.shape, int), 0
        for start in zip(*np.nonzero(mask)):
            if seen[start]:
                continue
            count += 1
            todo = [start]
            seen[start] = count
            while todo:
                y, x = todo.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if (dy and dx and not diagonal) or not (0 <= y + dy < 23 and 0 <= x + dx < 31):
                            continue
                        if mask[y + dy, x + dx] and not seen[y + dy, x + dx]:
                            seen[y + dy, x + dx] = count
                            todo.append((y + dy, x + dx))
        assert n == count and (labels == seen).all()


def test_small_image_has_default_metrics():
    metrics, backend = K.score_image(np.zeros((7, 40, 3), np.uint8))
    assert backend == "cpu_small_image" and metrics.dhash == "" and metrics.clipped_fraction == 1.0


def test_percentile_and_resize():
    counts = np.bincount([0, 1, 2, 3, 4, 5, 6, 7, 8, 9], minlength=256)
    assert K.histogram_percentile(counts, 10, 50) == 5
    assert (K.resize(np.full((30, 40), 77, np.uint8), 8, 9, "lanczos3") == 77).all()
    assert K.resize_long_edge(np.zeros((100, 200), np.uint8), 50).shape == (25, 50)
