"""A slice of a pipe is that slice of the whole result, for every operator on pixels and for chains of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackweave.operators import aggregate, masks, noise, scalar, spatial, spectral, window
from stackweave.sources import stacks

TABLE = [(k / 255, 1 - k / 255, 0.5) for k in range(256)]

OPS = {
    "map01_stack": lambda p: scalar.map01("stack"), "map01_frame": lambda p: scalar.map01("frame"), "clip_space": lambda p: scalar.clip_space("frame"), "qtile": lambda p: scalar.qtile(), "qtile_frame": lambda p: scalar.qtile(per="frame"),
    "roi": lambda p: scalar.roi(1, 2, 6, 5), "center_crop": lambda p: scalar.center_crop(p.shape), "transpose": lambda p: scalar.transpose, "pad_to": lambda p: scalar.pad_to(11, 12), "colormap": lambda p: scalar.colormap(TABLE),
    "columns_first": lambda p: scalar.columns_first, "threshold": lambda p: scalar.threshold(0.4), "moving_mean": lambda p: window.moving_mean(3), "contrast": lambda p: window.temporal_contrast(4), "running": lambda p: window.running_temporal_contrast(4),
    "disk": lambda p: spatial.disk_blur(5), "gaussian": lambda p: spatial.gaussian_blur(3, 1.0), "dog": lambda p: spatial.difference_of_gaussians(3), "spatial_contrast": lambda p: spatial.spatial_contrast(3), "sobel": lambda p: spatial.sobel("y"),
    "eigenvalue": lambda p: spatial.hessian_eigenvalue("high"), "vesselness": lambda p: spatial.vesselness("stack"), "opening": lambda p: spatial.opening(3), "closing": lambda p: spatial.closing(3), "median": lambda p: spatial.median(3),
    "normals_x": lambda p: spatial.normals("x"), "normals_y": lambda p: spatial.normals("y"), "softmin": lambda p: spatial.local_softmin(3), "background": lambda p: spatial.remove_background(3), "downsample": lambda p: spatial.downsample(2),
    "psd": lambda p: spectral.psd(), "magnitude": lambda p: spectral.magnitude("hann", True), "lowpass": lambda p: spectral.lowpass(), "pink": lambda p: spectral.pink(3), "noise": lambda p: noise.noise_like("gaussian", 7),
    "blur_contrast": lambda p: _chain(spatial.gaussian_blur(3, 1.0), window.temporal_contrast(3)), "transpose_pad": lambda p: _chain(scalar.transpose, scalar.pad_to(10, 12)), "pad_blur": lambda p: _chain(scalar.pad_to(11, 12), spatial.disk_blur(3)),
    "contrast_mask": lambda p: _chain(scalar.apply_mask(aggregate.mean_frame(p.all()).select("y", "x", (F.col("v") > 0.5).cast("int").alias("m"))), window.moving_mean(2)), "gradient": lambda p: masks.prepared_gradient("x", aggregate.mean_frame(p.all()).select("y", "x", F.lit(1).alias("m"))),
}


def _chain(*ops):
    from stackweave.plans.pipe import Chain

    return Chain(*ops)


@pytest.fixture(scope="module")
def pipe(spark):
    a = 0.1 + 0.9 * np.random.default_rng(1).random((11, 8, 9))
    frames = spark.createDataFrame([(i, f.ravel().tolist()) for i, f in enumerate(a)], "n long, px array<double>").cache()
    return stacks.from_arrays(frames, "n", "px", 8, 9, 11)


@pytest.mark.parametrize("name", OPS)
def test_a_slice_is_a_slice_of_the_whole(pipe, name):
    made = pipe | OPS[name](pipe)
    whole = made.to_numpy()
    s = made.shape
    assert whole.shape == (s.n, s.c, s.y, s.x) and not np.isnan(whole).any()
    index = slice(1, s.n - 2), slice(0, 1), slice(1, s.y), slice(s.x // 3, s.x // 3 + 3)
    assert np.allclose(made.to_numpy(index), whole[index], atol=1e-9)
    assert np.allclose(made.to_numpy((2, 0, slice(0, 2))), whole[2, 0, 0:2], atol=1e-9)
