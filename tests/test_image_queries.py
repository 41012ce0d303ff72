"""Queries without SQL: each picture's measures against the single kernels, its descriptor against plain resampling."""

import os

import numpy as np
import pytest

from framesift import image_queries
from framesift.functions import kernels
from framesift.queries import descriptors

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def pictures(spark):
    return {r.vec_id: np.array(r.u8, np.uint8).reshape(8, 8) for r in descriptors(spark, DATA).collect()}


def plain_resize(gray, width, height, kind):
    """Each output pixel by its own sums over the input, one axis after the other."""

    def weight(x):
        if kind == "triangle":
            return max(1 - abs(x), 0.0)
        return float(np.sinc(x) * np.sinc(x / 3)) if abs(x) < 3 else 0.0

    def line(values, out):
        ratio = len(values) / out
        scale = max(ratio, 1.0)
        result = []
        for i in range(out):
            weights = [weight((j + 0.5 - (i + 0.5) * ratio) / scale) for j in range(len(values))]
            result.append(sum(w * v for w, v in zip(weights, values)) / sum(weights))
        return result

    rows = [line(list(map(float, row)), width) for row in gray]
    columns = [line([row[x] for row in rows], height) for x in range(width)]
    return np.clip(np.floor(np.array(columns).T + 0.5), 0, 255).astype(np.uint8)


def test_scores_are_those_of_the_kernels(spark, pictures):
    got = {r.vec_id: r for r in image_queries.image_scores(spark, DATA).collect()}
    assert got.keys() == pictures.keys()
    for i, gray in pictures.items():
        r, box = got[i], kernels.subject_box(gray)
        assert (r.sharpness, r.tenengrad) == pytest.approx(kernels.focus(gray), abs=1e-5)
        assert (r.contrast, r.exposure_score, r.clipped_fraction) == pytest.approx(kernels.exposure(gray), abs=1e-5)
        assert (r.bbox_x1, r.bbox_y1, r.bbox_x2, r.bbox_y2) == pytest.approx(box.box, abs=1e-5) and r.object_confidence == pytest.approx(box.confidence, abs=1e-5)
        assert (r.subject_sharpness, r.subject_tenengrad) == pytest.approx(kernels.focus_in_box(gray, box.box), abs=1e-5)
        small = plain_resize(gray, 9, 8, "lanczos3")
        bits = "".join("1" if small[y, x + 1] > small[y, x] else "0" for y in range(8) for x in range(8))
        assert r.dhash == f"{int(bits, 2):016x}" and r.backend == "cpu"


def test_descriptors_are_plain_resamplings(spark, pictures):
    got = {r.vec_id: r for r in image_queries.image_descriptors(spark, DATA).collect()}
    assert got.keys() == pictures.keys()
    for i, gray in list(pictures.items())[:10]:
        whole = np.frombuffer(bytes.fromhex(got[i].global_luma), np.uint8).reshape(32, 32)
        assert (whole == plain_resize(gray, 32, 32, "triangle")).all()
        subject, edges, mask = (np.frombuffer(bytes.fromhex(got[i][c]), np.uint8).reshape(64, 64) for c in ("subject_luma", "subject_edges", "subject_mask"))
        # a crop is 18 pixels wide at least, so all of an 8 by 8 picture
        x1, y1, x2, y2 = kernels.pixel_box(kernels.subject_box(gray).box, 8, 8)
        assert got[i].area_fraction == pytest.approx((x2 - x1) * (y2 - y1) / 64)
        assert (edges == kernels.edge_descriptor(subject)).all() and (mask == kernels.foreground_mask(subject)).all()
        if (x1 + x2, y1 + y2) == (8, 8):
            assert (subject == plain_resize(gray, 64, 64, "lanczos3")).all()
