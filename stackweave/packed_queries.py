"""Queries on packed blocks, traced functions, resampling and shaped noise, each with its SQL."""

from __future__ import annotations

import numpy as np

from pyspark.sql import functions as F

from .operators import aggregate, masks, order, packed, scalar, shaped
from .plans import blocks
from .plans.blocks import BlockPipe, Layout
from .plans.trace import trace
from .plans.counting import FrameCounter
from .queries import E0, ORACLE, PIX, S0, U0, W25, emb, query, sales, table, unit
from .sinks.recording import scratch_folder
from .sources import images, zarr


def emb_blocks(spark, sf_dir, layout: Layout | None = None) -> BlockPipe:
    """Embeddings as frames of 8 x 8 values, a row for each frame as the table has them."""
    return blocks.from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 8, layout=layout)


def _to_unit(a: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(a + 0.5, 0.0, 1.0) * 255)


def unit_blocks(spark, sf_dir, layout: Layout | None = None) -> BlockPipe:
    """The same frames as bytes, mapped back to 0..1."""
    return emb_blocks(spark, sf_dir, layout) | packed.elementwise("bytes", _to_unit) | packed.bytes_to_float01


@query("block_temporal_contrast", ORACLE["temporal_contrast"])
def block_temporal_contrast(spark, sf_dir):
    return (unit_blocks(spark, sf_dir, Layout(128, 8, 8)) | packed.temporal_contrast(25)).all()


@query("block_mean_temporal_contrast", ORACLE["mean_temporal_contrast"])
def block_mean_temporal_contrast(spark, sf_dir):
    return blocks.mean_frame(unit_blocks(spark, sf_dir, Layout(128, 8, 8)) | packed.temporal_contrast(25))


@query("block_slice_pushdown", ORACLE["slice_pushdown"])
def block_slice_pushdown(spark, sf_dir):
    return (unit_blocks(spark, sf_dir, Layout(16, 4, 4)) | packed.temporal_contrast(7))[40:100, :, 2:5, 3:4]


@query("block_gaussian_blur", ORACLE["gaussian_blur"])
def block_gaussian_blur(spark, sf_dir):
    return (emb_blocks(spark, sf_dir) | packed.gaussian_blur(5, 1.5)).all()


@query("block_spatial_contrast", ORACLE["spatial_contrast"])
def block_spatial_contrast(spark, sf_dir):
    return (unit_blocks(spark, sf_dir) | packed.spatial_contrast(5)).all()


@query("block_median_filter", ORACLE["median_filter"])
def block_median_filter(spark, sf_dir):
    """Packed from pixels, in tiles with halos."""
    return (blocks.from_pixels(sales(spark, sf_dir), Layout(16, 4, 5)) | packed.median(3)).all()


@query("block_psd", ORACLE["psd"])
def block_psd(spark, sf_dir):
    return (emb_blocks(spark, sf_dir) | packed.psd("hann")).all()


_DFT = """f AS (SELECT p // 8 AS fy, p % 8 AS fx FROM (SELECT unnest(range(64)) AS p)),
d AS (SELECT n, fy, fx, sum(v * cos(2 * pi() * (fy * y + fx * x) / 8)) AS re, -sum(v * sin(2 * pi() * (fy * y + fx * x) / 8)) AS im FROM {source}, f GROUP BY ALL)"""

ORACLE["fft_log_magnitude"] = f"""WITH {E0}, w AS (SELECT n, y, x, v * CASE WHEN r <= 1 THEN 0.5 * (1 + cos(pi() * r)) ELSE 0 END AS v
  FROM (SELECT *, sqrt((2.0 * y / 7 - 1) ** 2 + (2.0 * x / 7 - 1) ** 2) AS r FROM e)), {_DFT.format(source="w")}
SELECT n, CAST(0 AS BIGINT) AS c, (fy + 4) % 8 AS y, (fx + 4) % 8 AS x, round(ln(1 + sqrt(re * re + im * im)), 6) AS v FROM d"""

ORACLE["lowpass"] = f"""WITH {E0}, {_DFT.format(source="e")},
r AS (SELECT *, sqrt((CASE WHEN fy < 4 THEN fy ELSE fy - 8 END / 8.0) ** 2 + (CASE WHEN fx < 4 THEN fx ELSE fx - 8 END / 8.0) ** 2) / sqrt(0.5) AS q FROM d),
k AS (SELECT *, CASE WHEN q <= 0.45 THEN 1 WHEN q >= 0.55 THEN 0 ELSE 0.5 * (1 + cos(pi() * (q - 0.45) / 0.1)) END AS g FROM r),
p AS (SELECT p // 8 AS y, p % 8 AS x FROM (SELECT unnest(range(64)) AS p))
SELECT n, CAST(0 AS BIGINT) AS c, y, x, round(sum(g * (re * cos(2 * pi() * (fy * y + fx * x) / 8) - im * sin(2 * pi() * (fy * y + fx * x) / 8))) / 64, 6) + 0.0 AS v FROM k, p GROUP BY n, y, x"""


@query("block_lowpass", ORACLE["lowpass"])
def block_lowpass(spark, sf_dir):
    return (emb_blocks(spark, sf_dir) | packed.lowpass()).all()


@query("block_fft_log_magnitude", ORACLE["fft_log_magnitude"])
def block_fft_log_magnitude(spark, sf_dir):
    return (emb_blocks(spark, sf_dir) | packed.magnitude("raised_cosine", True)).all()


@query(
    "traced_window",
    f"WITH {U0}, w AS (SELECT n, y, x, avg(v) {W25.format(k=4)} AS m, count(*) {W25.format(k=4)} AS k FROM u) {PIX} "
    "(SELECT w.n, 0 AS c, w.y, w.x, w.m - 2 * e.v AS v FROM w JOIN e ON e.n = w.n + 2 AND e.y = w.y AND e.x = w.x + 1 WHERE w.k = 5)",
)
def traced_window(spark, sf_dir):
    """Five frames of one stack, and the middle one of another stack, one column aside."""

    def f(R, a, b):
        ahead = a[R.n.start : R.n.stop + 4]
        return packed.running(ahead, 5) / 5 - 2 * b[R.n.start + 2 : R.n.stop + 2, R.y, R.x.start + 1 : R.x.stop + 1]

    return trace(f, Layout(64, 8, 8), a=unit_blocks(spark, sf_dir), b=emb_blocks(spark, sf_dir)).all()


def _resampled_sql(taps: str) -> str:
    return f"""WITH {E0}, t AS ({taps}) SELECT n, CAST(0 AS BIGINT) AS c, a.i AS y, b.i AS x, round(sum(v * a.w * b.w), 6) + 0.0 AS v
    FROM e JOIN t a ON a.k = e.y JOIN t b ON b.k = e.x GROUP BY n, a.i, b.i"""


@query(
    "resample_bilinear",
    _resampled_sql("SELECT i, least(floor(p), 7) AS k, 1 - (p - floor(p)) AS w FROM g UNION ALL SELECT i, least(floor(p) + 1, 7), p - floor(p) FROM g").replace(
        ", t AS", ", g AS (SELECT i, greatest((i + 0.5) / 1.5 - 0.5, 0) AS p FROM range(12) r(i)), t AS"
    ),
)
def resample_bilinear(spark, sf_dir):
    return (emb_blocks(spark, sf_dir, Layout(32, 5, 5)) | packed.resample(1.5, "bilinear")).all()


@query(
    "resample_bicubic",
    _resampled_sql(
        """SELECT i, least(greatest(floor(p) + j, 0), 7) AS k, CASE WHEN abs(d) <= 1 THEN 1.25 * abs(d) ** 3 - 2.25 * d * d + 1
        ELSE -0.75 * abs(d) ** 3 + 3.75 * d * d - 6 * abs(d) + 3 END AS w
        FROM (SELECT i, p, j, p - floor(p) - j AS d FROM (SELECT i, (i + 0.5) / 2 - 0.5 AS p FROM range(16) r(i)), range(-1, 3) s(j))"""
    ),
)
def resample_bicubic(spark, sf_dir):
    return (emb_blocks(spark, sf_dir, Layout(32, 5, 5)) | packed.resample(2)).all()


@query(
    "resample_area",
    _resampled_sql("SELECT i, k, 1.0 / (((i + 1) * 8 + 4) // 5 - i * 8 // 5) AS w FROM range(5) r(i), range(8) s(k) WHERE k >= i * 8 // 5 AND k < ((i + 1) * 8 + 4) // 5"),
)
def resample_area(spark, sf_dir):
    return (emb_blocks(spark, sf_dir) | packed.resample(0.625, "area")).all()


_NOISE = f"""{E0}, q AS (SELECT k, 0.25 * 16.0 ** (k / 24.0) AS s FROM range(25) r(k)),
b AS (SELECT y, x, v FROM e WHERE n = 0),
a AS (SELECT k, i, least(floor(p), 6) AS lo, p - least(floor(p), 6) AS f FROM (SELECT k, i, ((i / s) % 8) / 8 * 7 AS p FROM q, range(8) r(i))),
z AS (SELECT y.k AS n, y.i AS y, x.i AS x, b00.v * (1 - y.f) * (1 - x.f) + b10.v * y.f * (1 - x.f) + b01.v * (1 - y.f) * x.f + b11.v * y.f * x.f AS v
  FROM a y JOIN a x ON x.k = y.k JOIN b b00 ON b00.y = y.lo AND b00.x = x.lo JOIN b b10 ON b10.y = y.lo + 1 AND b10.x = x.lo
  JOIN b b01 ON b01.y = y.lo AND b01.x = x.lo + 1 JOIN b b11 ON b11.y = y.lo + 1 AND b11.x = x.lo + 1),
f AS (SELECT p // 8 AS fy, p % 8 AS fx FROM (SELECT unnest(range(64)) AS p)),
o AS (SELECT 0 AS of_tile, n, y, x, v FROM e UNION ALL SELECT 1, n, y, x, v FROM z),
d AS (SELECT of_tile, n, fy, fx, sum(v * cos(2 * pi() * (fy * y + fx * x) / 8)) AS re, sum(v * sin(2 * pi() * (fy * y + fx * x) / 8)) AS im FROM o, f GROUP BY ALL),
r AS (SELECT of_tile, n, CAST(floor(sqrt(((fy + 4) % 8 - 4) ** 2 + ((fx + 4) % 8 - 4) ** 2)) AS INT) AS r, avg(sqrt(re * re + im * im)) AS v FROM d GROUP BY ALL),
i AS (SELECT of_tile, n, r, CASE of_tile WHEN 0 THEN 1 / (v + 1e-6) ELSE v END AS v FROM r),
m AS (SELECT of_tile, n, r, v / (max(v) OVER (PARTITION BY of_tile, n) + 1e-6) AS v FROM i),
l AS (SELECT x.n, y.n AS k, avg((x.v - y.v) ** 2) AS loss FROM m x JOIN m y ON y.r = x.r WHERE x.of_tile = 0 AND y.of_tile = 1 GROUP BY x.n, y.n),
best AS (SELECT n, arg_min(k, loss) AS k, min(loss) AS loss FROM l GROUP BY n)"""


def first_tile(spark, sf_dir) -> np.ndarray:
    """The frame with number 0, 8 x 8 values, as a tile."""
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").head()
    return np.array(row[0], np.float64).reshape(8, 8)


@query("matching_noise_scale", f"WITH {_NOISE} SELECT best.n, round(s, 6) AS scale, round(loss, 6) AS loss FROM best JOIN q USING (k)")
def matching_noise_scale(spark, sf_dir):
    return shaped.matching_scale(emb_blocks(spark, sf_dir), first_tile(spark, sf_dir), period=8)


@query("matching_noise", f"WITH {_NOISE}, t AS (SELECT n AS k, y, x, (v - min(v) OVER (PARTITION BY n)) / (max(v) OVER (PARTITION BY n) - min(v) OVER (PARTITION BY n) + 1e-6) AS v FROM z) {PIX} (SELECT best.n, 0 AS c, y, x, v FROM best JOIN t USING (k))")
def matching_noise(spark, sf_dir):
    return shaped.matching_noise(emb_blocks(spark, sf_dir), first_tile(spark, sf_dir), period=8)


@query("block_frame_contrast", f"WITH {U0} SELECT n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS deviation FROM u GROUP BY n")
def block_frame_contrast(spark, sf_dir):
    return blocks.frame_means(unit_blocks(spark, sf_dir, Layout(64, 4, 8)))


@query("block_opening", f"WITH {S0}, k AS (SELECT * FROM (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx)), o AS (SELECT a.n, a.y, a.x, min(b.v) AS v FROM s a, k JOIN s b ON b.n = a.n AND b.y = least(greatest(a.y + dy, 0), 6) AND b.x = least(greatest(a.x + dx, 0), 9) GROUP BY ALL) SELECT a.n, CAST(0 AS BIGINT) AS c, a.y, a.x, round(max(b.v), 6) + 0.0 AS v FROM o a, k JOIN o b ON b.n = a.n AND b.y = least(greatest(a.y + dy, 0), 6) AND b.x = least(greatest(a.x + dx, 0), 9) GROUP BY a.n, a.y, a.x")
def block_opening(spark, sf_dir):
    return (blocks.from_pixels(sales(spark, sf_dir), Layout(16, 4, 5)) | packed.opening(3)).all()


_MASKS = f"""{U0}, p AS (SELECT n // 256 AS block, y, x, stddev_samp(v) AS s, avg(v) AS m FROM u GROUP BY ALL),
w AS (SELECT *, (s - min(s) OVER k) / (max(s) OVER k - min(s) OVER k + 1e-8) AS s1, sqrt((m - min(m) OVER k) / (max(m) OVER k - min(m) OVER k + 1e-8) + 1e-6) AS m1 FROM p WINDOW k AS (PARTITION BY block)),
d AS (SELECT block, 's' AS kind, y, x, s1 AS v FROM w UNION ALL SELECT block, 'm', y, x, m1 FROM w),
z AS (SELECT *, (v - min(v) OVER k) / (max(v) OVER k - min(v) OVER k + 1e-8) AS z, (max(v) OVER k - min(v) OVER k) / (max(v) OVER k - min(v) OVER k + 1e-8) AS top FROM d WINDOW k AS (PARTITION BY block, kind)),
hh AS (SELECT g.block, g.kind, g.bin, count(z.b) AS count FROM (SELECT DISTINCT block, kind, bin FROM d, range(256) r(bin)) g LEFT JOIN (SELECT block, kind, CAST(least(floor(z / top * 256), 255) AS BIGINT) AS b FROM z) z
      ON z.block = g.block AND z.kind = g.kind AND z.b = g.bin GROUP BY ALL),
k AS (SELECT block, kind, first(bin ORDER BY count DESC, bin) AS peak FROM hh GROUP BY ALL),
q AS (SELECT block, kind, ceil(quantile_cont(v, 0.9) * 256) AS upper FROM d GROUP BY ALL),
c AS (SELECT k.block, k.kind, coalesce(first(hh.bin ORDER BY hh.count, hh.bin) FILTER (WHERE hh.bin >= peak AND hh.bin < upper), any_value(peak)) / 256.0 AS cutoff FROM k JOIN q USING (block, kind) JOIN hh USING (block, kind) GROUP BY ALL),
o AS (SELECT block, y, x, max(CAST(v > cutoff AS INT)) AS m FROM d JOIN c USING (block, kind) GROUP BY ALL),
o1 AS (SELECT *, (m - min(m) OVER k) / (max(m) OVER k - min(m) OVER k + 1e-8) AS m1 FROM o WINDOW k AS (PARTITION BY block)),
f AS (SELECT a.block, a.y, a.x, any_value(a.m) AS m, sum(b.m1) / 9 AS blurred FROM o1 a, range(-1, 2) i(dy), range(-1, 2) j(dx), o1 b
      WHERE b.block = a.block AND b.y = least(greatest(a.y + dy, 0), 7) AND b.x = least(greatest(a.x + dx, 0), 7) GROUP BY a.block, a.y, a.x)
SELECT block, CAST(0 AS BIGINT) AS c, y, x, CAST(CASE WHEN blurred > 0.5 THEN m ELSE 0 END AS BIGINT) AS m FROM f"""


@query("foreground_mask", f"WITH {_MASKS}")
def foreground_mask(spark, sf_dir):
    """Before small parts are cleaned away: frames of 8 x 8 have no others."""
    return masks.foreground_mask(unit_blocks(spark, sf_dir, Layout(100, 4, 8)), 256, clean=False)


@query(
    "prepared_gradient",
    f"""WITH {U0}, k(y, x, m) AS (SELECT y, x, CAST(avg(v) > 0.5 AS INT) FROM u GROUP BY ALL), l AS (SELECT n, y, x, ln(v + 0.5) AS v FROM u),
z AS (SELECT n, y, x, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-8) AS v FROM l WINDOW w AS (PARTITION BY n)),
g AS (SELECT a.n, a.y, a.x, sum(coalesce(b.v, 0) * dx * (2 - abs(dy))) AS gx, sum(coalesce(b.v, 0) * dy * (2 - abs(dx))) AS gy
      FROM (SELECT a.*, dy, dx FROM z a, range(-1, 2) i(dy), range(-1, 2) j(dx)) a LEFT JOIN z b ON b.n = a.n AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.n, a.y, a.x)
SELECT n, CAST(0 AS BIGINT) AS c, y, x, round(-gx / (sqrt(gx * gx + gy * gy + 1) + 1e-6) * m, 6) + 0.0 AS v FROM g JOIN k USING (y, x)""",
)
def prepared_gradient(spark, sf_dir):
    pipe = unit(spark, sf_dir)
    mask = aggregate.mean_frame(pipe.all()).select("y", "x", (F.col("v") > 0.5).cast("int").alias("m"))
    return (pipe | (lambda v: v + 0.5) | masks.prepared_gradient("x", mask)).all()


@query("permuted_axes", f"WITH {S0} SELECT x AS n, CAST(c AS BIGINT) AS c, y, n AS x, round(v, 6) AS v FROM s WHERE x BETWEEN 2 AND 5 AND n < 40")
def permuted_axes(spark, sf_dir):
    return (sales(spark, sf_dir) | scalar.columns_first)[2:6, :, :, 0:40]


@query("stack_quantiles", f"WITH {E0} SELECT round(quantile_cont(v, 0.01), 6) AS q01, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.995), 6) AS q995 FROM e")
def stack_quantiles(spark, sf_dir):
    q = order.stack_quantiles(emb(spark, sf_dir).all(), [0.01, 0.5, 0.995])
    return q.select(*(F.get("q", F.lit(k)).alias(name) for k, name in enumerate(("q01", "q50", "q995"))))


@query("counted_frames", f"WITH {U0} SELECT CAST(max(n) + 1 AS DOUBLE) AS frames, round(sum(v), 6) AS total FROM u")
def counted_frames(spark, sf_dir):
    """The frames that passed while something else was summed: no job of its own counts them."""
    counter = FrameCounter()
    total = (unit(spark, sf_dir) | counter.op).all().agg(F.sum("v").alias("total")).head()[0]
    return spark.createDataFrame([(counter.count, total)], "frames double, total double")


@query("image_roundtrip", f"WITH {U0} SELECT n, CAST(c AS BIGINT) AS c, y, x, round(v * 255, 6) AS v FROM u")
def image_roundtrip(spark, sf_dir):
    """Frames as image files in a table, and decoded again."""
    bytes_ = emb_blocks(spark, sf_dir) | packed.elementwise("bytes", _to_unit)
    return images.from_files(images.encoded(bytes_), bytes_.shape).all()


@query("chunked_roundtrip", f"WITH {U0} SELECT n, CAST(c AS BIGINT) AS c, y, x, round(v * 255, 6) AS v FROM u WHERE n BETWEEN 20 AND 69 AND x BETWEEN 1 AND 5")
def chunked_roundtrip(spark, sf_dir):
    """Frames written as a folder of chunks, and a range read from it."""
    path = f"{scratch_folder(spark).removeprefix('file://')}/a.zarr"
    zarr.save(emb_blocks(spark, sf_dir, Layout(64, 4, 8)) | packed.elementwise("bytes", _to_unit), path)
    return zarr.blocks(spark, path)[20:70, :, :, 1:6]
