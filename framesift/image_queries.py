"""Queries that put the image kernels of a scan to work on the descriptors, each taken as a picture of 8 by 8 pixels.

The kernels run in Arrow batches, a picture at a time; the SQL works on a table of pixels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from framesift.functions import kernels
from framesift.queries import PIXELS_SQL, V_SQL, descriptors, query

SIDE = 8
KINDS = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def by_picture(spark: SparkSession, sf_dir: str, kernel: Callable[[np.ndarray], list[tuple]], fields: str, width: int = SIDE) -> DataFrame:
    """vec_id and ``fields`` of each row that ``kernel`` gives for a picture, ``width`` by 8 pixels, values repeating as needed."""
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = [KINDS[f.split()[1]] for f in fields.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for vec_id, values in zip(batch.column("vec_id").to_pylist(), batch.column("u8").to_pylist()):
                picture = np.resize(np.array(values, np.uint8), (SIDE, width))
                rows += [(vec_id, *found) for found in kernel(picture)]
            columns = list(zip(*rows)) if rows else [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), *kinds])], ["vec_id", *names])

    return descriptors(spark, sf_dir).select("vec_id", "u8").mapInArrow(run, f"vec_id bigint, {fields}")


def rounded(values) -> tuple:
    return tuple(round(float(v), 6) for v in values)


def every_pixel(**planes: np.ndarray) -> list[tuple]:
    """A row for each pixel: x, y, and its value in each plane."""
    y, x = np.mgrid[0 : next(iter(planes.values())).shape[0], 0 : next(iter(planes.values())).shape[1]]
    return list(zip(x.ravel().tolist(), y.ravel().tolist(), *[p.ravel().tolist() for p in planes.values()]))


@query(PIXELS_SQL + """, n AS (SELECT *, lag(v) OVER r AS l, lead(v) OVER r AS rt, lag(v) OVER c AS u, lead(v) OVER c AS dn FROM px WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y)),
k AS (SELECT vec_id, CASE WHEN l IS NOT NULL AND rt IS NOT NULL AND u IS NOT NULL AND dn IS NOT NULL THEN l + rt + u + dn - 4 * v END AS lap, rt - v AS dx, dn - v AS dy FROM n)
SELECT vec_id, sum(lap)::BIGINT AS lap_sum, sum(lap * lap)::BIGINT AS lap_squares, sum(dx * dx)::BIGINT AS dx_squares, sum(dy * dy)::BIGINT AS dy_squares,
       round(sum(lap * lap) / 36.0 - (sum(lap) / 36.0) * (sum(lap) / 36.0), 6) AS sharpness, round(sum(dx * dx) / 56.0 + sum(dy * dy) / 56.0, 6) AS tenengrad FROM k GROUP BY vec_id""")  # fmt: skip
def focus_partials(spark, sf_dir):
    """Each half of a picture is summed apart where the sums allow it; here a picture is one part."""

    def kernel(gray):
        sums = kernels.focus_sums(gray)
        return [(*sums, *rounded(kernels.combine_focus(sums, *gray.shape[::-1])))]

    return by_picture(spark, sf_dir, kernel, "lap_sum bigint, lap_squares bigint, dx_squares bigint, dy_squares bigint, sharpness double, tenengrad double")


@query(PIXELS_SQL + """, r AS (SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS k FROM px)
SELECT vec_id, max(CASE WHEN k = 4 THEN v END) AS p5, max(CASE WHEN k = 61 THEN v END) AS p95 FROM r GROUP BY vec_id""")
def histogram_percentile(spark, sf_dir):
    def kernel(gray):
        counts = np.bincount(gray.ravel(), minlength=256)
        return [tuple(kernels.histogram_percentile(counts, gray.size, p) for p in (5, 95))]

    return by_picture(spark, sf_dir, kernel, "p5 bigint, p95 bigint")


@query(PIXELS_SQL + """, r AS (SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS k FROM px),
s AS (SELECT vec_id, (max(v) FILTER (WHERE k = 61) - max(v) FILTER (WHERE k = 4)) / 255.0 AS contrast, count(*) FILTER (WHERE v < 3 OR v > 252) / 64.0 AS clipped, sum(v) / 64.0 / 255.0 AS mean FROM r GROUP BY vec_id)
SELECT vec_id, round(contrast, 6) AS contrast, round(clipped, 6) AS clipped, round(1 - least(1.0, 6 * clipped + 0.35 * least(1.0, abs(mean - 0.52) / 0.52)), 6) AS exposure FROM s""")  # fmt: skip
def exposure_contrast(spark, sf_dir):
    def kernel(gray):
        contrast, score, clipped = kernels.exposure(gray)
        return [rounded((contrast, clipped, score))]

    return by_picture(spark, sf_dir, kernel, "contrast double, clipped double, exposure double")


@query(PIXELS_SQL + """ SELECT vec_id, x::BIGINT AS x, y::BIGINT AS y, least(255, coalesce(abs(lead(v) OVER r - lag(v) OVER r) + abs(lead(v) OVER c - lag(v) OVER c), 0))::BIGINT AS edge
FROM px WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y)""")  # fmt: skip
def edge_descriptor(spark, sf_dir):
    return by_picture(spark, sf_dir, lambda gray: every_pixel(edge=kernels.edge_descriptor(gray)), "x bigint, y bigint, edge bigint")


@query(PIXELS_SQL + """, rim AS (SELECT * FROM px WHERE x IN (0, 1, 6, 7) OR y IN (0, 1, 6, 7)),
b AS (SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS k FROM rim), m AS (SELECT vec_id, max(v) FILTER (WHERE k = 25) AS bg FROM b GROUP BY vec_id),
d AS (SELECT rim.vec_id, abs(v - bg) AS off, row_number() OVER (PARTITION BY rim.vec_id ORDER BY abs(v - bg)) AS k FROM rim JOIN m USING (vec_id)),
t AS (SELECT vec_id, least(greatest(max(off) FILTER (WHERE k = 34) * 3, 12), 72) AS least_off FROM d GROUP BY vec_id)
SELECT vec_id, x::BIGINT AS x, y::BIGINT AS y, (abs(v - bg) >= least_off)::BIGINT AS foreground FROM px JOIN m USING (vec_id) JOIN t USING (vec_id)""")  # fmt: skip
def foreground_mask(spark, sf_dir):
    return by_picture(spark, sf_dir, lambda gray: every_pixel(foreground=kernels.foreground_mask(gray)), "x bigint, y bigint, foreground bigint")


@query(f"""WITH {V_SQL}, px AS (SELECT vec_id, (t.i % 9)::INT AS x, (t.i // 9)::INT AS y, u8[t.i % 64 + 1] AS v FROM v, range(0, 72) t(i)),
n AS (SELECT vec_id, x, y, coalesce(lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) > v, false)::INT AS up FROM px),
h AS (SELECT vec_id, y, x // 4 AS half, sum(up * (1 << (3 - x % 4)))::INT AS nibble FROM n WHERE x < 8 GROUP BY 1, 2, 3)
SELECT vec_id, string_agg(substr('0123456789abcdef', nibble + 1, 1), '' ORDER BY y, half) AS dhash FROM h GROUP BY vec_id""")  # fmt: skip
def difference_hash(spark, sf_dir):
    """Pictures of 9 by 8 pixels, which the reduction leaves as they are."""
    return by_picture(spark, sf_dir, lambda gray: [(kernels.dhash(gray),)], "dhash string", width=9)


#: Means around each pixel, how much it stands out, and from where on that is strong.
SALIENT_SQL = PIXELS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, near AS (SELECT p.vec_id, p.x, p.y, any_value(p.v) AS v, sum(q.v)::BIGINT // count(*) AS mean FROM px p JOIN px q ON p.vec_id = q.vec_id AND abs(p.x - q.x) <= 3 AND abs(p.y - q.y) <= 3 GROUP BY 1, 2, 3),
g AS (SELECT *, abs(lead(v) OVER r - lag(v) OVER r) + abs(lead(v) OVER c - lag(v) OVER c) AS gradient, v - mean AS off FROM near WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y)),
sal AS (SELECT vec_id, x, y, (CASE WHEN gradient IS NULL THEN 0 ELSE least(2 * gradient + 3 * abs(off) + greatest(-off, 0), 2047) END)::BIGINT AS score FROM g),
thr AS (SELECT vec_id, greatest(max(score) FILTER (WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6), 48) AS least FROM sal GROUP BY vec_id),
strong AS (SELECT s.vec_id, x, y, score FROM sal s JOIN thr t ON s.vec_id = t.vec_id AND score >= least),
wide AS (SELECT DISTINCT p.vec_id, p.x, p.y FROM px p JOIN strong s ON p.vec_id = s.vec_id AND abs(p.x - s.x) <= 1 AND abs(p.y - s.y) <= 1)
"""  # fmt: skip


@query(SALIENT_SQL + "SELECT vec_id, sal.x::BIGINT AS x, sal.y::BIGINT AS y, mean, score, wide.x IS NOT NULL AS wide FROM sal JOIN near USING (vec_id, x, y) LEFT JOIN wide USING (vec_id, x, y)")
def salient_pixels(spark, sf_dir):
    def kernel(gray):
        scores, least = kernels.saliency(gray)
        return every_pixel(mean=kernels.local_means(gray, 3), score=scores, wide=kernels.dilate(scores >= least))

    return by_picture(spark, sf_dir, kernel, "x bigint, y bigint, mean bigint, score bigint, wide boolean")


@query(SALIENT_SQL + """, reach AS (SELECT vec_id, x, y, y * 8 + x AS root FROM wide
  UNION SELECT w.vec_id, w.x, w.y, r.root FROM reach r JOIN wide w ON w.vec_id = r.vec_id AND abs(w.x - r.x) <= 1 AND abs(w.y - r.y) <= 1),
lab AS (SELECT vec_id, x, y, min(root) AS root FROM reach GROUP BY 1, 2, 3),
part AS (SELECT l.vec_id, root, count(*) AS pixels, count(s.score) AS strong_pixels, coalesce(sum(s.score), 0)::DOUBLE AS energy, count(*) FILTER (WHERE l.x IN (0, 7) OR l.y IN (0, 7)) AS border,
  min(l.x) AS x1, min(l.y) AS y1, max(l.x) AS x2, max(l.y) AS y2, (max(l.x) - min(l.x) + 1) * (max(l.y) - min(l.y) + 1) AS area FROM lab l LEFT JOIN strong s USING (vec_id, x, y) GROUP BY 1, 2),
scored AS (SELECT *, strong_pixels::DOUBLE / area AS density, energy * (0.35 + 0.65 * sqrt(strong_pixels::DOUBLE / area)) * CASE WHEN border > 0 THEN 0.7 ELSE 1.0 END / greatest(pow(area, 0.12), 1.0) AS score
  FROM part WHERE strong_pixels >= 2 AND area <= 38 AND pixels >= 4),
ranked AS (SELECT *, row_number() OVER w AS place, coalesce(lead(score) OVER w, 0.0) AS second FROM scored WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, root)),
conf AS (SELECT r.*, least(greatest((0.16 + 0.34 * (score / greatest(score + second, 1e-9)) + 0.22 * sqrt(density) + 0.16 * least(greatest((energy / strong_pixels / t.least - 1) / 2, 0.0), 1.0)
  + 0.12 * least(greatest(sqrt(strong_pixels / 20.0), 0.25), 1.0)) * CASE WHEN area / 64.0 <= 0.35 THEN 1.0 ELSE 0.45 END, 0.0), 0.98) AS confidence,
  greatest(x1 - 2, 0) AS l, greatest(y1 - 2, 0) AS u, least(x2 + 3, 8) AS rt, least(y2 + 3, 8) AS dn FROM ranked r JOIN thr t USING (vec_id) WHERE place = 1)
SELECT v.vec_id, round(coalesce(confidence, 0.0), 6) AS confidence, round(CASE WHEN confidence >= 0.3 THEN least(greatest(0.85 * least(least(l, u, 8 - rt, 8 - dn) / 1.0, 1.0) + 0.15 * (1 - border / pixels::DOUBLE), 0.0), 1.0) ELSE 0.5 END, 6) AS completeness,
  round(coalesce(border / pixels::DOUBLE, 0.0), 6) AS border, round(coalesce(l / 8.0, 0.0), 6) AS x1, round(coalesce(u / 8.0, 0.0), 6) AS y1, round(coalesce(rt / 8.0, 1.0), 6) AS x2, round(coalesce(dn / 8.0, 1.0), 6) AS y2 FROM v LEFT JOIN conf USING (vec_id)""")  # fmt: skip
def salient_box(spark, sf_dir):
    def kernel(gray):
        found = kernels.subject_box(gray)
        return [rounded((found.confidence, found.completeness, found.border, *found.box))]

    return by_picture(spark, sf_dir, kernel, "confidence double, completeness double, border double, x1 double, y1 double, x2 double, y2 double")


@query(PIXELS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, m AS (SELECT vec_id, x, y, (v / 255.0)::FLOAT::DOUBLE AS p FROM px WHERE (v / 255.0)::FLOAT >= 0.5),
reach AS (SELECT vec_id, x, y, y * 8 + x AS root FROM m UNION SELECT w.vec_id, w.x, w.y, r.root FROM reach r JOIN m w ON w.vec_id = r.vec_id AND abs(w.x - r.x) + abs(w.y - r.y) <= 1),
lab AS (SELECT vec_id, x, y, min(root) AS root FROM reach GROUP BY 1, 2, 3),
part AS (SELECT l.vec_id, root, count(*) AS pixels, avg(p) AS mean, max(p) AS peak, count(*) FILTER (WHERE l.x IN (0, 7) OR l.y IN (0, 7)) AS edges, min(l.x) AS x1, min(l.y) AS y1, max(l.x) + 1 AS x2, max(l.y) + 1 AS y2
  FROM lab l JOIN m USING (vec_id, x, y) GROUP BY 1, 2),
kept AS (SELECT *, row_number() OVER w AS place, first_value(pixels) OVER w AS largest, count(*) OVER (PARTITION BY vec_id) AS parts FROM part WHERE pixels >= 4 WINDOW w AS (PARTITION BY vec_id ORDER BY pixels DESC, root)),
used AS (SELECT vec_id, max(parts) AS subjects, max(0.75 * mean + 0.25 * peak) FILTER (WHERE place = 1) AS confidence, min(x1) / 8.0 AS x1, min(y1) / 8.0 AS y1, max(x2) / 8.0 AS x2, max(y2) / 8.0 AS y2, sum(edges) / sum(pixels) AS touching
  FROM kept WHERE pixels * 20 >= largest GROUP BY vec_id)
SELECT vec_id, subjects, round(confidence, 6) AS confidence, round(0.70 * (1 - least(greatest(least(x1, y1, 1 - x2, 1 - y2), 0.0) / 0.04, 1.0)) + 0.30 * least(touching * 4, 1.0), 6) AS truncation_risk, x1, y1, x2, y2 FROM used""")  # fmt: skip
def mask_detection(spark, sf_dir):
    def kernel(gray):
        found = kernels.detect_in_mask(gray / 255.0)
        return [(found.subject_count, *rounded((found.confidence, found.truncation_risk, *found.box)))] if found else []

    return by_picture(spark, sf_dir, kernel, "subjects bigint, confidence double, truncation_risk double, x1 double, y1 double, x2 double, y2 double")


@query(None)
def image_scores(spark, sf_dir):
    """All measures of each picture. Held against the single kernels in ``tests/test_image_queries.py``: SQL has them one by one."""
    names = list(kernels.Metrics().as_dict())

    def kernel(gray):
        metrics, backend = kernels.score_image(np.repeat(gray[..., None], 3, axis=2))
        values = metrics.as_dict()
        return [(*rounded(values[n] for n in names[:-1]), values["dhash"], backend)]

    return by_picture(spark, sf_dir, kernel, ", ".join(f"{n} double" for n in names[:-1]) + ", dhash string, backend string")


@query(None)
def image_descriptors(spark, sf_dir):
    """The descriptor of each picture as hexadecimal digits. SQL can't resample; held against plain resampling in the tests."""

    def kernel(gray):
        rgb = np.repeat(gray[..., None], 3, axis=2)
        found = kernels.describe(rgb, kernels.score_image(rgb)[0])
        parts = (found.global_luma, found.subject_luma, found.subject_edges, found.subject_mask)
        return [(*[p.astype(np.uint8).tobytes().hex() for p in parts], *rounded((found.confidence, found.area_fraction)))]

    return by_picture(spark, sf_dir, kernel, "global_luma string, subject_luma string, subject_edges string, subject_mask string, confidence double, area_fraction double")
