"""The queries over the given tables and the same in SQL. Floating results are rounded to six places on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import aggregate, fuse, geometry, noise, scalar, spatial, spectral, window
from .plans import ordered
from .plans.index import Shape
from .plans.pipe import FramePipe
from .sources import stacks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark, sf_dir) -> FramePipe:
    """Embeddings as frames of 8 x 8 values."""
    return stacks.from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 8)


def unit(spark, sf_dir) -> FramePipe:
    """The same frames as bytes, mapped back to 0..1."""
    to_bytes = lambda v: F.floor(F.least(F.greatest(v + 0.5, F.lit(0.0)), F.lit(1.0)) * 255).cast("double")
    return emb(spark, sf_dir) | to_bytes | scalar.bytes_to_float01


def sales(spark, sf_dir) -> FramePipe:
    """Quantities by month since 1995-01, line number and supplier."""
    d = F.col("l_shipdate")
    return stacks.summed_grid(table(spark, sf_dir, "lineitem"), (F.year(d) - 1995) * 12 + F.month(d) - 1, F.col("l_linenumber") - 1, F.col("l_suppkey") % 10, "l_quantity", Shape(84, 1, 7, 10))


def r6(name="v"):
    return (F.round(F.col(name), 6) + 0.0).alias(name)


def out(df):
    return df.select(*(r6(c) if kind == "double" else F.col(c).cast("long").alias(c) if kind == "int" else c for c, kind in df.dtypes))


E0 = """e AS (SELECT CAST(vec_id AS BIGINT) AS n, 0 AS c, CAST(p // 8 AS BIGINT) AS y, CAST(p % 8 AS BIGINT) AS x, CAST(embedding[p + 1] AS DOUBLE) AS v
      FROM embeddings, (SELECT unnest(range(64)) AS p))"""
U0 = E0 + ", u AS (SELECT n, c, y, x, floor(least(greatest(v + 0.5, 0.0), 1.0) * 255) / 255.0 AS v FROM e)"
S0 = """s AS (SELECT g.n, 0 AS c, g.y, g.x, coalesce(q.v, 0.0) AS v FROM
      (SELECT CAST(id // 70 AS BIGINT) AS n, CAST(id // 10 % 7 AS BIGINT) AS y, CAST(id % 10 AS BIGINT) AS x FROM (SELECT unnest(range(84 * 70)) AS id)) g
      LEFT JOIN (SELECT (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS n, l_linenumber - 1 AS y, l_suppkey % 10 AS x, CAST(sum(l_quantity) AS DOUBLE) AS v
                 FROM lineitem GROUP BY ALL) q USING (n, y, x))"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: out(f(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _kernel_sql(kernel) -> str:
    return "(VALUES " + ", ".join(f"({y}, {x}, CAST({w!r} AS DOUBLE))" for y, x, w in kernel) + ") k(dy, dx, w)"


def _valid_sql(source: str, base: str, kernels: dict, size: int, value: str, h: int, w: int) -> str:
    """Sums over neighbourhoods for each output place."""
    places = sorted({(y, x) for k in kernels.values() for y, x, _ in k})
    tab = {name: {(y, x): wt for y, x, wt in k} for name, k in kernels.items()}
    rows = ", ".join(f"({y}, {x}, " + ", ".join(f"CAST({t.get((y, x), 0.0)!r} AS DOUBLE)" for t in tab.values()) + ")" for y, x in places)
    sums = ", ".join(f"sum({n} * v) AS s_{n}, sum({n} * v * v) AS q_{n}" for n in tab)
    return f"""WITH {base}, k(dy, dx, {", ".join(tab)}) AS (VALUES {rows}),
    g AS (SELECT n, y - dy AS y, x - dx AS x, {sums} FROM {source}, k WHERE y - dy BETWEEN 0 AND {h - size} AND x - dx BETWEEN 0 AND {w - size} GROUP BY ALL)
    SELECT n, CAST(0 AS BIGINT) AS c, y, x, round({value}, 6) + 0.0 AS v FROM g"""


def _same_sql(source: str, base: str, kernels: dict, size: int, value: str, h: int, w: int, prefix: str = "") -> str:
    """The same with the edge repeated: each output place looks its neighbours up."""
    r = size // 2
    places = sorted({(y, x) for k in kernels.values() for y, x, _ in k})
    tab = {name: {(y, x): wt for y, x, wt in k} for name, k in kernels.items()}
    rows = ", ".join(f"({y - r}, {x - r}, " + ", ".join(f"CAST({t.get((y, x), 0.0)!r} AS DOUBLE)" for t in tab.values()) + ")" for y, x in places)
    sums = ", ".join(f"sum({n} * b.v) AS s_{n}, sum({n} * b.v * b.v) AS q_{n}" for n in tab)
    return f"""WITH {base}, k(dy, dx, {", ".join(tab)}) AS (VALUES {rows}){prefix},
    g AS (SELECT a.n, a.y, a.x, {sums} FROM {source} a, k JOIN {source} b ON b.n = a.n AND b.y = least(greatest(a.y + dy, 0), {h - 1}) AND b.x = least(greatest(a.x + dx, 0), {w - 1}) GROUP BY a.n, a.y, a.x)
    SELECT n, CAST(0 AS BIGINT) AS c, y, x, round({value}, 6) + 0.0 AS v FROM g"""


PIX = "SELECT n, CAST(c AS BIGINT) AS c, y, x, round(v, 6) + 0.0 AS v FROM"
W25 = "OVER (PARTITION BY y, x ORDER BY n ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING)"


def _contrast(source: str, k: int) -> str:
    w = W25.format(k=k - 1)
    return f"(SELECT n, c, y, x, sqrt(abs(avg(v * v) {w} - avg(v) {w} * avg(v) {w}) + 1e-6) / (avg(v) {w} + 1e-6) AS v, count(*) {w} AS full_k FROM {source})"


@query("quickstart", f"WITH {U0} SELECT CAST(c AS BIGINT) AS c, y, x, round(avg(v), 6) AS v FROM {_contrast('u', 25)} WHERE full_k = 25 AND n < 256 GROUP BY ALL")
def quickstart(spark, sf_dir):
    return aggregate.mean_frame((unit(spark, sf_dir) | window.temporal_contrast(25))[0:256])


@query("mean_temporal_contrast", f"WITH {U0} SELECT CAST(c AS BIGINT) AS c, y, x, round(avg(v), 6) AS v FROM {_contrast('u', 25)} WHERE full_k = 25 GROUP BY ALL")
def mean_temporal_contrast(spark, sf_dir):
    return aggregate.mean_frame((unit(spark, sf_dir) | window.temporal_contrast(25)).all())


@query("moving_mean", f"WITH {U0} {PIX} (SELECT n, c, y, x, avg(v) {W25.format(k=6)} AS v, count(*) {W25.format(k=6)} AS k FROM u) WHERE k = 7")
def moving_mean(spark, sf_dir):
    return (unit(spark, sf_dir) | window.moving_mean(7)).all()


@query("temporal_contrast", f"WITH {U0} {PIX} {_contrast('u', 25)} WHERE full_k = 25")
def temporal_contrast(spark, sf_dir):
    return (unit(spark, sf_dir) | window.temporal_contrast(25)).all()


@query("temporal_contrast_even_window", f"WITH {U0} {PIX} {_contrast('u', 8)} WHERE full_k = 8")
def temporal_contrast_even(spark, sf_dir):
    return (unit(spark, sf_dir) | window.temporal_contrast(8)).all()


@query("running_temporal_contrast", f"WITH {U0} SELECT n, CAST(c AS BIGINT) AS c, y, x, round(v, 4) AS v FROM {_contrast('u', 25)} WHERE full_k = 25")
def running_contrast(spark, sf_dir):
    return (unit(spark, sf_dir) | window.running_temporal_contrast(25)).all().withColumn("v", F.round("v", 4))


@query("slice_pushdown", f"WITH {U0} {PIX} {_contrast('u', 7)} WHERE full_k = 7 AND n BETWEEN 40 AND 99 AND y BETWEEN 2 AND 4 AND x = 3")
def slice_pushdown(spark, sf_dir):
    pipe = unit(spark, sf_dir) | window.temporal_contrast(7)
    return pipe[40:100, :, 2:5, 3:4]


@query("roi_crop", f"WITH {E0} SELECT n, CAST(c AS BIGINT) AS c, y - 1 AS y, x - 2 AS x, round(v, 6) AS v FROM e WHERE y BETWEEN 1 AND 4 AND x BETWEEN 2 AND 4")
def roi_crop(spark, sf_dir):
    return (emb(spark, sf_dir) | scalar.roi(2, 1, 3, 4)).all()


@query("center_crop", f"WITH {S0} SELECT n, CAST(c AS BIGINT) AS c, y, x - 1 AS x, round(v, 6) AS v FROM s WHERE x BETWEEN 1 AND 7")
def center_crop(spark, sf_dir):
    pipe = sales(spark, sf_dir)
    return (pipe | scalar.center_crop(pipe.shape)).all()


@query("transpose", f"WITH {S0} SELECT n, CAST(c AS BIGINT) AS c, x AS y, y AS x, round(v, 6) AS v FROM s WHERE x BETWEEN 2 AND 5")
def transpose(spark, sf_dir):
    return (sales(spark, sf_dir) | scalar.transpose)[:, :, 2:6]


@query("mean_frame", f"WITH {E0} SELECT CAST(c AS BIGINT) AS c, y, x, round(avg(v), 6) AS v FROM e GROUP BY ALL")
def mean_frame(spark, sf_dir):
    return aggregate.mean_frame(emb(spark, sf_dir).all())


@query("sum_frame", f"WITH {E0} SELECT CAST(c AS BIGINT) AS c, y, x, round(sum(v), 6) AS v FROM e WHERE n BETWEEN 10 AND 209 GROUP BY ALL")
def sum_frame(spark, sf_dir):
    return aggregate.sum_frame(emb(spark, sf_dir)[10:210])


@query("sum_frame_all", f"WITH {E0} SELECT CAST(c AS BIGINT) AS c, y, x, round(sum(v), 6) AS v FROM e GROUP BY ALL")
def sum_frame_all(spark, sf_dir):
    return aggregate.sum_frame(emb(spark, sf_dir).all())


@query("total_temporal_contrast", f"WITH {U0} SELECT CAST(c AS BIGINT) AS c, y, x, round(stddev_pop(v) / (avg(v) + 1e-6), 6) AS v FROM u GROUP BY ALL")
def total_contrast(spark, sf_dir):
    return aggregate.total_temporal_contrast(unit(spark, sf_dir).all())


@query("frame_contrast", f"WITH {U0} SELECT n, round(stddev_samp(v) / (avg(v) + 1e-6), 6) AS v FROM u GROUP BY ALL")
def frame_contrast(spark, sf_dir):
    return aggregate.frame_contrast(unit(spark, sf_dir).all())


@query("frame_contrast_by_channel", f"WITH {U0} SELECT n, CAST(c AS BIGINT) AS c, round(stddev_samp(v) / avg(v), 6) AS v FROM u GROUP BY ALL")
def frame_contrast_by_channel(spark, sf_dir):
    return aggregate.frame_contrast(unit(spark, sf_dir).all(), ("n", "c"), 0.0)


@query("frame_mean_series", f"WITH {E0} SELECT n, round(avg(v), 6) AS v FROM e GROUP BY ALL")
def frame_mean(spark, sf_dir):
    return aggregate.frame_mean(emb(spark, sf_dir).all())


@query("cum_contrast", f"WITH {U0}, m AS (SELECT n, avg(v) OVER (PARTITION BY y, x ORDER BY n) AS v FROM u) SELECT n, round(stddev_samp(v) / (avg(v) + 1e-6), 6) AS v FROM m GROUP BY n")
def cum_contrast(spark, sf_dir):
    return aggregate.cumulative_contrast(unit(spark, sf_dir).all())


@query("bfi", f"WITH {U0} SELECT n, CAST(c AS BIGINT) AS c, y, x, round(1 / (v * v), 4) AS v FROM {_contrast('u', 25)} WHERE full_k = 25")
def bfi(spark, sf_dir):
    return (unit(spark, sf_dir) | window.temporal_contrast(25) | scalar.bfi).all().withColumn("v", F.round("v", 4))


@query("map01_stack", f"WITH {E0} {PIX} (SELECT n, c, y, x, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER () + 1e-8) AS v FROM e)")
def map01_stack(spark, sf_dir):
    return (emb(spark, sf_dir) | scalar.map01("stack")).all()


@query("map01_frame", f"WITH {E0}, m AS (SELECT n, min(v) AS lo, max(v) AS hi FROM e GROUP BY n) {PIX} (SELECT n, c, y, x, (v - lo) / (hi - lo + 1e-8) AS v FROM e JOIN m USING (n))")
def map01_frame(spark, sf_dir):
    return (emb(spark, sf_dir) | scalar.map01("frame")).all()


@query("clip_space", f"WITH {E0}, m AS (SELECT n, min(v) AS lo, max(v) AS hi FROM e GROUP BY n) {PIX} (SELECT n, c, y, x, 2 * ((v - lo) / (hi - lo + 1e-8) - 0.5) AS v FROM e JOIN m USING (n))")
def clip_space(spark, sf_dir):
    return (emb(spark, sf_dir) | scalar.clip_space("frame")).all()


@query("qtile_clip", f"WITH {E0}, q AS (SELECT quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM e) {PIX} (SELECT n, c, y, x, least(greatest(v, a), b) AS v FROM e, q)")
def qtile_clip(spark, sf_dir):
    return (emb(spark, sf_dir) | scalar.qtile()).all()


@query("quantiles", f"WITH {E0} SELECT n, round(quantile_cont(v, 0.1), 6) AS q10, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.9), 6) AS q90 FROM e GROUP BY n")
def quantiles(spark, sf_dir):
    q = aggregate.quantiles(emb(spark, sf_dir).all(), [0.1, 0.5, 0.9], "n")
    return q.select("n", *(F.get("q", F.lit(k)).alias(c) for k, c in enumerate(("q10", "q50", "q90"))))


@query("bytes_roundtrip", f"WITH {E0} {PIX} (SELECT n, c, y, x, trunc(least(greatest((v + 0.5) * 255, 0), 255)) / 255.0 AS v FROM e)")
def bytes_roundtrip(spark, sf_dir):
    return (emb(spark, sf_dir) | (lambda v: v + 0.5) | scalar.float01_to_bytes | scalar.bytes_to_float01).all()


@query("log_sqrt", f"WITH {U0} SELECT n, CAST(c AS BIGINT) AS c, y, x, round(ln(v + 1e-6), 6) AS a, round(ln(1 + v), 6) AS b, round(sqrt(greatest(v, 0) + 1e-6), 6) AS d, round(1 / (1 + exp(-v)), 6) AS s FROM u")
def log_sqrt(spark, sf_dir):
    v = F.col("v")
    return unit(spark, sf_dir).all().select("n", "c", "y", "x", F.log(v + 1e-6).alias("a"), F.log1p(v).alias("b"), F.sqrt(F.greatest(v, F.lit(0.0)) + 1e-6).alias("d"), scalar.sigmoid(v).alias("s"))


HIST = """m AS (SELECT min(v) AS lo, max(v) AS hi FROM u), z AS (SELECT (v - lo) / (hi - lo + 1e-8) AS z, (hi - lo) / (hi - lo + 1e-8) AS top FROM u, m),
h AS (SELECT bin, count(z) AS count FROM (SELECT unnest(range(256)) AS bin) LEFT JOIN (SELECT z, CAST(least(floor(z / top * 256), 255) AS BIGINT) AS b FROM z) ON b = bin GROUP BY bin)"""


@query("histogram256", f"WITH {U0}, {HIST} SELECT bin, count, round((count + 1e-12) / (sum(count) OVER () + 1e-12), 6) AS p FROM h")
def histogram(spark, sf_dir):
    return aggregate.histogram(unit(spark, sf_dir).all())


@query(
    "valley_threshold",
    f"""WITH {U0}, {HIST}, p AS (SELECT arg_min(bin, bin) AS peak FROM h WHERE count = (SELECT max(count) FROM h)),
t AS (SELECT CAST(ceil((quantile_cont(v, 0.9) - min(v)) / (max(v) - min(v) + 1e-8) * 256) AS BIGINT) AS upper FROM u),
r AS (SELECT h.*, peak, upper FROM h, p, t WHERE bin >= peak AND bin < upper)
SELECT peak, upper, round(min(bin) / 256.0, 6) AS cutoff FROM r WHERE count = (SELECT min(count) FROM r) GROUP BY ALL""",
)
def valley(spark, sf_dir):
    return aggregate.valley_cutoff(unit(spark, sf_dir).all())


@query("radial_profile", f"WITH {E0} SELECT n, CAST(floor(sqrt((x - 4) * (x - 4) + (y - 4) * (y - 4))) AS BIGINT) AS r, round(avg(v), 6) AS v FROM e GROUP BY ALL")
def radial(spark, sf_dir):
    return aggregate.radial_profile(emb(spark, sf_dir).all(), 8, 8)


@query("laplacian", _valid_sql("e", E0, {"w": spatial.LAPLACIAN}, 3, "abs(s_w)", 8, 8))
def laplacian(spark, sf_dir):
    return (emb(spark, sf_dir) | spatial.laplacian_contrast()).all()


@query("spatial_contrast", _valid_sql("u", U0, {"w": spatial.disk(5)}, 5, "sqrt(abs(q_w - s_w * s_w) + 1e-6) / (s_w + 1e-6)", 8, 8))
def spatial_contrast(spark, sf_dir):
    return (unit(spark, sf_dir) | spatial.spatial_contrast(5)).all()


@query("disk_blur", _same_sql("s", S0, {"w": spatial.disk(5)}, 5, "s_w", 7, 10))
def disk_blur(spark, sf_dir):
    return (sales(spark, sf_dir) | spatial.disk_blur(5)).all()


@query("box_blur", _same_sql("e", E0, {"w": spatial.box(3)}, 3, "s_w", 8, 8))
def box_blur(spark, sf_dir):
    return (emb(spark, sf_dir) | spatial.disk_blur(3)).all()


@query("gaussian_blur", _same_sql("e", E0, {"w": spatial.gaussian(5, 1.5)}, 5, "s_w", 8, 8))
def gaussian_blur(spark, sf_dir):
    return (emb(spark, sf_dir) | spatial.gaussian_blur(5, 1.5)).all()


@query("dog", _same_sql("z", E0, {"a": spatial.gaussian(5, 3), "b": spatial.gaussian(5, 2)}, 5, "s_a - s_b", 8, 8, ", m AS (SELECT n, min(v) AS lo, max(v) AS hi FROM e GROUP BY n), z AS (SELECT n, c, y, x, (v - lo) / (hi - lo + 1e-8) AS v FROM e JOIN m USING (n))"))
def dog(spark, sf_dir):
    pipe = emb(spark, sf_dir)
    for op in spatial.difference_of_gaussians(5):
        pipe |= op
    return pipe.all()


@query("sobel_y", _valid_sql("e", E0, {"w": spatial.SOBEL_Y}, 3, "s_w", 8, 8))
def sobel_y(spark, sf_dir):
    return (emb(spark, sf_dir) | spatial.sobel("y")).all()


@query("sobel_x", _valid_sql("s", S0, {"w": spatial.SOBEL_X}, 3, "s_w", 7, 10))
def sobel_x(spark, sf_dir):
    return (sales(spark, sf_dir) | spatial.sobel("x")).all()


HESS = {"xx": spatial.HESSIAN_XX, "xy": spatial.HESSIAN_XY, "yy": spatial.HESSIAN_YY}
HIGH = "((s_xx + s_yy) / 2 + sqrt(((s_xx - s_yy) / 2) * ((s_xx - s_yy) / 2) + s_xy * s_xy))"


@query("hessian_xy", _valid_sql("e", E0, HESS, 3, "s_xy", 8, 8))
def hessian_xy(spark, sf_dir):
    return (emb(spark, sf_dir) | spatial.hessian("xy")).all()


@query("hessian_eig_low", _valid_sql("e", E0, HESS, 3, HIGH.replace("+ sqrt", "- sqrt"), 8, 8))
def hessian_low(spark, sf_dir):
    return (emb(spark, sf_dir) | spatial.hessian_eigenvalue("low")).all()


@query("hessian_eig_high", _valid_sql("e", E0, HESS, 3, HIGH, 8, 8))
def hessian_high(spark, sf_dir):
    return (emb(spark, sf_dir) | spatial.hessian_eigenvalue("high")).all()


@query("vesselness", "SELECT n, c, y, x, round(v / (max(v) OVER (PARTITION BY n) + 1e-8), 6) AS v FROM (" + _valid_sql("e", E0, HESS, 3, "0", 8, 8).replace("round(0, 6) + 0.0", f"greatest(-{HIGH}, 0.0)") + ")")
def vesselness(spark, sf_dir):
    pipe = emb(spark, sf_dir)
    for op in spatial.vesselness():
        pipe |= op
    return pipe.all()


def _patch_sql(value: str, k: int = 3) -> str:
    mask = {(y, x): 1.0 for y, x, _ in spatial.disk(k)}
    rows = ", ".join(f"({y - k // 2}, {x - k // 2}, {mask.get((y, x), 0.0)})" for y in range(k) for x in range(k))
    return f"""WITH {U0}, k(dy, dx, m) AS (VALUES {rows}), g AS (SELECT a.n, a.y, a.x, b.v * m AS p FROM u a, k JOIN u b ON b.n = a.n AND b.y = least(greatest(a.y + dy, 0), 7) AND b.x = least(greatest(a.x + dx, 0), 7))
    SELECT n, CAST(0 AS BIGINT) AS c, y, x, round({value}, 6) + 0.0 AS v FROM g GROUP BY n, y, x"""


@query("softmax_patch", _patch_sql("sum(p * exp(p)) / sum(exp(p))"))
def softmax_patch(spark, sf_dir):
    return (unit(spark, sf_dir) | spatial.local_softmax(3)).all()


@query("softmin_patch", _patch_sql("sum(p * exp(1 - p)) / sum(exp(1 - p))"))
def softmin_patch(spark, sf_dir):
    return (unit(spark, sf_dir) | spatial.local_softmin(3)).all()


@query("remove_background", "SELECT n, c, y, x, round(-sum(sqrt(p * exp(-10 * p) / t + 1e-5)), 6) AS v FROM (SELECT *, CAST(0 AS BIGINT) AS c, sum(exp(-10 * p)) OVER (PARTITION BY n, y, x) AS t FROM (" + _patch_sql("0").split("SELECT n, CAST(0")[0] + " SELECT * FROM g)) GROUP BY n, c, y, x")
def remove_background(spark, sf_dir):
    return (unit(spark, sf_dir) | spatial.remove_background(3)).all()


@query("normal_map_z", "WITH " + S0 + """, k(dy, dx, gx, gy) AS (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 0, 0, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)),
g AS (SELECT n, y - dy AS y, x - dx AS x, sum(gx * v) AS gx, sum(gy * v) AS gy FROM s, k WHERE y - dy BETWEEN 0 AND 6 AND x - dx BETWEEN 0 AND 9 GROUP BY ALL)
SELECT n, CAST(0 AS BIGINT) AS c, y, x, round(1 / (sqrt(gx * gx + gy * gy + 1) + 1e-6), 6) AS v FROM g""")
def normal_map(spark, sf_dir):
    return (sales(spark, sf_dir) | spatial.normals("z")).all()


def _rank_sql(agg: str, source: str = "s", k: int = 3) -> str:
    r = k // 2
    return f"""WITH {S0}, k AS (SELECT * FROM (SELECT unnest(range({-r}, {r + 1})) AS dy), (SELECT unnest(range({-r}, {r + 1})) AS dx))
    SELECT a.n, CAST(0 AS BIGINT) AS c, a.y, a.x, round({agg}(b.v), 6) + 0.0 AS v FROM s a, k JOIN s b ON b.n = a.n AND b.y = least(greatest(a.y + dy, 0), 6) AND b.x = least(greatest(a.x + dx, 0), 9) GROUP BY a.n, a.y, a.x"""


@query("dilate", _rank_sql("max"))
def dilate(spark, sf_dir):
    return (sales(spark, sf_dir) | spatial.dilate(3)).all()


@query("erode", _rank_sql("min"))
def erode(spark, sf_dir):
    return (sales(spark, sf_dir) | spatial.erode(3)).all()


@query("median_filter", _rank_sql("median"))
def median_filter(spark, sf_dir):
    return (sales(spark, sf_dir) | spatial.median(3)).all()


@query("downsample_area", f"WITH {S0} SELECT n, CAST(0 AS BIGINT) AS c, y // 2 AS y, x // 2 AS x, round(avg(v), 6) AS v FROM s WHERE y < 6 GROUP BY ALL")
def downsample(spark, sf_dir):
    return (sales(spark, sf_dir) | spatial.downsample(2)).all()


@query("mask_apply", f"WITH {U0}, m AS (SELECT y, x, CAST(avg(v) > 0.5 AS INTEGER) AS m FROM u GROUP BY ALL) {PIX} (SELECT n, c, y, x, v * m AS v FROM u JOIN m USING (y, x))")
def mask_apply(spark, sf_dir):
    pipe = unit(spark, sf_dir)
    mask = aggregate.mean_frame(pipe.all()).select("y", "x", (F.col("v") > 0.5).cast("int").alias("m"))
    return (pipe | scalar.apply_mask(mask)).all()


@query("threshold", f"WITH {U0} SELECT n, CAST(c AS BIGINT) AS c, y, x, CAST(v > 0.6 AS BIGINT) AS v FROM u")
def threshold(spark, sf_dir):
    return (unit(spark, sf_dir) | scalar.threshold(0.6)).all()


@query("flat_field", f"WITH {U0}, m AS (SELECT y, x, avg(v) AS m FROM u GROUP BY ALL) {PIX} (SELECT n, c, y, x, v / m AS v FROM u JOIN m USING (y, x))")
def flat_field(spark, sf_dir):
    pipe = unit(spark, sf_dir)
    return (pipe | scalar.flat_field(aggregate.mean_frame(pipe.all()).withColumnRenamed("v", "m"))).all()


@query("pad_to", f"WITH {S0}, f AS (SELECT n, min(v) AS lo FROM s GROUP BY n), g AS (SELECT f.n, f.lo, y, x FROM f, (SELECT unnest(range(9)) AS y), (SELECT unnest(range(12)) AS x)) SELECT g.n, CAST(0 AS BIGINT) AS c, g.y, g.x, round(coalesce(s.v, lo), 6) AS v FROM g LEFT JOIN s ON s.n = g.n AND s.y = g.y - 1 AND s.x = g.x - 1")
def pad_to(spark, sf_dir):
    return (sales(spark, sf_dir) | scalar.pad_to(9, 12)).all()


@query("colormap", f"WITH {U0} SELECT n, t.c AS c, y, x, round(CASE t.c WHEN 0 THEN i / 255.0 WHEN 1 THEN 1 - i / 255.0 ELSE 0.5 END, 6) AS v FROM (SELECT *, trunc(least(greatest(v, 0), 1) * 255) AS i FROM u) u, (SELECT unnest(range(3)) AS c) t")
def colormap(spark, sf_dir):
    return (unit(spark, sf_dir) | scalar.colormap([(k / 255, 1 - k / 255, 0.5) for k in range(256)])).all()


@query("fuse_shifted", f"WITH {E0} SELECT a.n, CAST(0 AS BIGINT) AS c, a.y, a.x - 1 AS x, round(b.v - a.v + d.v * 2, 6) AS v FROM e a JOIN e b ON b.n = a.n + 2 AND b.y = a.y AND b.x = a.x JOIN u2 d ON d.n = a.n AND d.y = a.y AND d.x = a.x - 1".replace(f"WITH {E0}", f"WITH {U0}, u2 AS (SELECT * FROM u)"))
def fuse_shifted(spark, sf_dir):
    return fuse.fuse(lambda a, b: a(n=2) - a() + b(x=-1) * 2, a=emb(spark, sf_dir), b=unit(spark, sf_dir)).all()


@query("noise_shaped_contrast", f"WITH {U0}, r AS (SELECT n, c, y, x, v / (v * v + 0.5 + 1e-6) AS v FROM u), m AS (SELECT (SELECT avg(v) FROM u) - (SELECT avg(v) FROM r) AS d) {PIX} (SELECT n, c, y, x, v + d AS v FROM r, m)")
def noise_shaped(spark, sf_dir):
    pipe = unit(spark, sf_dir)
    return noise.noise_shaped(pipe, pipe | (lambda v: v * v + 0.5)).all()


@query("noise_summary")
def noise_summary(spark, sf_dir):
    """Mean and deviation of each kind of noise with the shape of the stack."""
    parts = [(emb(spark, sf_dir) | noise.noise_like(k, 7)).all().groupBy(F.lit(k).alias("kind")).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("deviation")) for k in noise.KINDS]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both


SEGMENTS = [(1, 0.0, 0.0, 7.0, 7.0), (2, 0.0, 7.0, 3.0, 3.0), (3, 6.0, 1.0, 6.0, 1.0)]


@query(
    "nearest_segment",
    f"""WITH {U0}, g(id, ax, ay, bx, b2) AS (VALUES {", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for i, a, b, c, d in SEGMENTS)}),
p AS (SELECT n, y, x FROM u WHERE v > 0.6), t AS (SELECT p.*, g.*, least(greatest(((x - ax) * (bx - ax) + (y - ay) * (b2 - ay)) / ((bx - ax) * (bx - ax) + (b2 - ay) * (b2 - ay) + 1e-12), 0.0), 1.0) AS t FROM p, g),
d AS (SELECT n, y, x, id, sqrt((ax + t * (bx - ax) - x) * (ax + t * (bx - ax) - x) + (ay + t * (b2 - ay) - y) * (ay + t * (b2 - ay) - y)) AS d FROM t)
SELECT n, y, x, CAST(first(id ORDER BY d, id) AS BIGINT) AS label, round(min(d), 6) AS distance FROM d GROUP BY n, y, x""",
)
def nearest(spark, sf_dir):
    lines = spark.createDataFrame(SEGMENTS, "id int, ax double, ay double, bx double, by double")
    return geometry.nearest_segment(unit(spark, sf_dir).all().where("v > 0.6"), lines, "n")


@query("bbox", f"WITH {U0} SELECT n, greatest(min(y) - 1, 0) AS top, least(max(y) + 1, 7) AS bottom, greatest(min(x) - 1, 0) AS left, least(max(x) + 1, 7) AS right FROM u WHERE v > 0.7 GROUP BY n".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def bbox(spark, sf_dir):
    return aggregate.bounding_box(unit(spark, sf_dir).all().withColumn("m", (F.col("v") > 0.7).cast("int")), 8, 8, 1, "n")


@query("tiles", f"WITH {E0} SELECT n // 100 AS tile, count(*) AS pixels, round(sum(v), 6) AS v FROM e GROUP BY ALL")
def tiles(spark, sf_dir):
    return aggregate.tiled(emb(spark, sf_dir).all(), 100).groupBy("tile").agg(F.count("v").alias("pixels"), F.sum("v").alias("v"))


@query("tiles_overlap", f"WITH {E0}, t AS (SELECT unnest(range((SELECT max(n) FROM e) // 64 + 1)) AS tile) SELECT tile, count(*) AS pixels, round(sum(v), 6) AS v FROM e JOIN t ON n >= tile * 64 AND n < tile * 64 + 100 GROUP BY ALL")
def tiles_overlap(spark, sf_dir):
    pipe = emb(spark, sf_dir)
    return aggregate.tiled(pipe.all(), 100, 64, size=pipe.shape.n).groupBy("tile").agg(F.count("v").alias("pixels"), F.sum("v").alias("v"))


@query("mask_per_block", f"WITH {U0}, p AS (SELECT n // 256 AS block, y, x, avg(v) AS m FROM u GROUP BY ALL), b AS (SELECT n // 256 AS block, avg(v) AS a FROM u GROUP BY ALL) SELECT block, CAST(0 AS BIGINT) AS c, y, x, CAST(m > a AS BIGINT) AS m FROM p JOIN b USING (block)")
def mask_per_block(spark, sf_dir):
    return aggregate.block_mask(unit(spark, sf_dir).all(), 256)


@query("encoded_offsets", "SELECT doc_id AS n, CAST(strlen(text) AS BIGINT) AS length, CAST(coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM documents")
def encoded_offsets(spark, sf_dir):
    lengths = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), F.octet_length("text").cast("long").alias("length"))
    return window.exclusive_offsets(lengths, block=256)


@query("elapsed_ns", "SELECT event_type, event_id, CAST(epoch_us(ts) - first_value(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) * 1000 AS elapsed_ns FROM events")
def elapsed(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ticks", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("o", F.struct("ts", "event_id"))
    return window.elapsed(e, ["event_type"], "ticks", "o", 1_000_000).select("event_type", "event_id", "elapsed_ns")


@query("signals", "SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n, epoch_us(ts) AS ticks, round(value, 6) AS v FROM events")
def signals(spark, sf_dir):
    return stacks.signals(table(spark, sf_dir, "events"), "event_type", "ts", "event_id", "value")


@query("sales_stack", f"WITH {S0} SELECT n, CAST(c AS BIGINT) AS c, y, x, round(v, 6) AS v FROM s")
def sales_stack(spark, sf_dir):
    return sales(spark, sf_dir).all()


@query("size_accounting", f"WITH {E0} SELECT count(DISTINCT n) AS frames, count(v) AS values_, count(v) * 4 AS bytes FROM e")
def size_accounting(spark, sf_dir):
    return aggregate.size_of(emb(spark, sf_dir).all()).withColumnRenamed("values", "values_")


@query("argmin_argmax", f"WITH {E0} SELECT n, round(min(v), 6) AS lo, round(max(v), 6) AS hi, first(y * 8 + x ORDER BY v, y, x) AS at_lo, first(y * 8 + x ORDER BY v DESC, y, x) AS at_hi FROM e GROUP BY n")
def argmin(spark, sf_dir):
    place = lambda c: (F.col(f"{c}.y") * 8 + F.col(f"{c}.x")).cast("long").alias(c)
    return aggregate.minmax(emb(spark, sf_dir).all(), "n").select("n", "lo", "hi", place("at_lo"), place("at_hi"))


@query(
    "frame_digest",
    """WITH d AS (SELECT doc_id AS n, sha256(coalesce(text, '')) AS d FROM documents),
b AS (SELECT n // 4096 AS b, count(*) AS k, sha256(string_agg(d, '' ORDER BY n)) AS d FROM d GROUP BY ALL)
SELECT CAST(sum(k) AS BIGINT) AS frames, sha256(string_agg(d, '' ORDER BY b)) AS digest FROM b""",
)
def frame_digest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), F.lit(0).alias("c"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.coalesce("text", F.lit("")).alias("v"))
    return aggregate.digest(docs)


@query(
    "psd",
    f"""WITH {E0}, w AS (SELECT n, y, x, (v - avg(v) OVER (PARTITION BY n)) * (0.5 - 0.5 * cos(2 * pi() * y / 8)) * (0.5 - 0.5 * cos(2 * pi() * x / 8)) AS v FROM e WHERE n < 40),
f AS (SELECT p // 8 AS fy, p % 8 AS fx FROM (SELECT unnest(range(64)) AS p)),
d AS (SELECT n, fy, fx, sum(v * cos(2 * pi() * (fy * y + fx * x) / 8)) AS re, sum(v * sin(2 * pi() * (fy * y + fx * x) / 8)) AS im FROM w, f GROUP BY ALL)
SELECT n, CAST(0 AS BIGINT) AS c, (fy + 4) % 8 AS y, (fx + 4) % 8 AS x, round((re * re + im * im) / 64, 6) AS v FROM d""".replace(" WHERE n < 40", ""),
)
def psd(spark, sf_dir):
    return (emb(spark, sf_dir) | spectral.psd("hann")).all()


@query("lowpass")
def lowpass(spark, sf_dir):
    return (emb(spark, sf_dir) | spectral.lowpass()).all()


@query("fft_log_magnitude")
def fft_log_magnitude(spark, sf_dir):
    return (emb(spark, sf_dir) | spectral.magnitude("raised_cosine", True)).all()


@query(
    "ema_rate",
    """WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, sum(CASE WHEN value > 0 THEN value ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events),
r AS (SELECT *, total - lag(total) OVER (PARTITION BY user_id ORDER BY t) AS dv FROM o),
l AS (SELECT user_id, t, list(dv) FILTER (WHERE dv > 0) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS rs FROM r)
SELECT user_id, t, round(list_reduce(rs, lambda a, b: 0.2 * b + 0.8 * a), 6) AS ema FROM l""",
)
def ema_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("value") > 0, F.col("value")).alias("grown"))
    e = ordered.scanned(rows, ["user_id"], ["ts", "event_id"], ordered.Numbered("k", {"total": "grown"})).select("user_id", (F.col("k") + 1).alias("t"), "total")
    return window.ema_rate(e, ["user_id"], "t", "total").select("user_id", "t", "ema")


@query("page_manifest", "SELECT page_id, CAST(strlen(html) AS BIGINT) AS bytes, sha512_256 AS hash FROM (SELECT page_id, html, sha256(html) AS sha512_256 FROM pages)")
def page_manifest(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.octet_length("html").cast("long").alias("bytes"), F.sha2(F.col("html").cast("binary"), 256).alias("hash"))


@query("encoded_roundtrip", f"WITH {U0} SELECT n, CAST(c AS BIGINT) AS c, y, x, round(v * 255, 6) AS v FROM u")
def encoded_roundtrip(spark, sf_dir):
    """Frames saved, verified and loaded again."""
    from .sinks.recording import scratch_folder
    from .sources import encoded

    bytes_, path = unit(spark, sf_dir) | (lambda v: F.round(v * 255)), f"{scratch_folder(spark)}/a.frames.parquet"
    encoded.save(bytes_, path)
    if not encoded.verify(bytes_, path):
        raise ValueError(f"{path} does not hold what was saved")
    return encoded.load(spark, path).all().select("n", F.col("c").cast("long").alias("c"), "y", "x", "v")


@query("image_digest_per_frame", f"WITH {E0} SELECT n, round(sum(v * (y * 8 + x + 1)), 6) AS v, count(*) AS pixels FROM e GROUP BY n")
def per_frame_checksum(spark, sf_dir):
    packed = stacks.to_arrays(emb(spark, sf_dir))
    return packed.select("n", F.aggregate(F.transform("px", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, v: a + v).alias("v"), F.size("px").cast("long").alias("pixels"))


@query("batch_sums", f"WITH {E0} SELECT n // 128 AS batch, round(sum(v), 6) AS v FROM e GROUP BY ALL")
def batch_sums(spark, sf_dir):
    return emb(spark, sf_dir).all().groupBy(F.floor(F.col("n") / 128).alias("batch")).agg(F.sum("v").alias("v"))


def _sliced(name: str, base: str, where: str) -> None:
    """A slice of a whole-frame query is what the same slice of its whole result is."""
    ORACLE[name] = f"SELECT * FROM ({ORACLE[base]}) WHERE {where}"


_sliced("map01_sliced", "map01_stack", "n BETWEEN 5 AND 24 AND x BETWEEN 2 AND 4")


@query("map01_sliced")
def map01_sliced(spark, sf_dir):
    return (emb(spark, sf_dir) | scalar.map01("stack"))[5:25, :, :, 2:5]


_sliced("vesselness_sliced", "vesselness", "n BETWEEN 5 AND 24 AND x BETWEEN 1 AND 3")


@query("vesselness_sliced")
def vesselness_sliced(spark, sf_dir):
    return (emb(spark, sf_dir) | spatial.vesselness())[5:25, :, :, 1:4]


_sliced("pad_to_sliced", "pad_to", "n BETWEEN 5 AND 24 AND x BETWEEN 8 AND 11 AND y BETWEEN 0 AND 4")


@query("pad_to_sliced")
def pad_to_sliced(spark, sf_dir):
    return (sales(spark, sf_dir) | scalar.pad_to(9, 12))[5:25, :, 0:5, 8:12]


_sliced("colormap_sliced", "colormap", "n BETWEEN 5 AND 24 AND c = 1")


@query("colormap_sliced")
def colormap_sliced(spark, sf_dir):
    return (unit(spark, sf_dir) | scalar.colormap([(k / 255, 1 - k / 255, 0.5) for k in range(256)]))[5:25, 1:2]
