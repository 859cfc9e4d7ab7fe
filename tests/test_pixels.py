"""Pixel operators against numpy on whole images."""

import numpy as np
import pytest

from tracklake.operators import pixels
from tracklake.sources import frames


def table(spark, images):
    rows = [(k, int(x), int(y), *map(int, np.atleast_1d(im[y, x]))) for k, im in images.items() for y in range(im.shape[0]) for x in range(im.shape[1])]
    kinds = "value int" if len(rows[0]) == 4 else "r int, g int, b int"
    return spark.createDataFrame(rows, f"image string, px int, py int, {kinds}")


def image(df, key, shape):
    out = np.full(shape, np.nan)
    for r in df.filter(df.image == key).collect():
        assert np.isnan(out[r.py, r.px])
        out[r.py, r.px] = r.value
    return out


@pytest.mark.parametrize("size, sigma", [((5, 5), 0.0), ((3, 7), 0.0), ((9, 5), 1.3)])
def test_blur_equals_a_mirrored_convolution(spark, size, sigma):
    rng = np.random.default_rng(4)
    images = {"a": rng.integers(0, 256, (9, 13)), "b": rng.integers(0, 256, (9, 13))}
    df = pixels.blurred(table(spark, images), ["image"], 13, 9, size, sigma)
    for key, im in images.items():
        wide = np.pad(im.astype(float), ((size[1] // 2,) * 2, (size[0] // 2,) * 2), mode="reflect")
        kernel = np.outer(pixels.gaussian(size[1], sigma), pixels.gaussian(size[0], sigma))
        want = np.array([[(wide[y : y + size[1], x : x + size[0]] * kernel).sum() for x in range(13)] for y in range(9)])
        got = image(df, key, im.shape)
        assert np.abs(got - want).max() <= 0.5 + 1e-6 and not np.isnan(got).any()
    with pytest.raises(ValueError):
        pixels.blurred(table(spark, images), ["image"], 13, 2, size, sigma)


def test_kernels_sum_to_one():
    for size in (1, 3, 5, 7, 9, 31):
        for sigma in (0.0, 0.5, 3.0):
            k = pixels.gaussian(size, sigma)
            assert abs(sum(k) - 1) < 1e-12 and k == k[::-1] and len(k) == size
    with pytest.raises(ValueError):
        pixels.gaussian(4)


def test_gray_values(spark):
    im = np.array([[[255, 255, 255], [0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]]])
    gray = pixels.grayscale(table(spark, {"a": im}))
    assert gray.columns == ["image", "px", "py", "value"] and image(gray, "a", (1, 5)).tolist() == [[255, 0, 76, 150, 29]]


@pytest.mark.parametrize("factor", [1, 0.75, 0.5, 0.25, 0.01, 1.5, 3])
def test_resampling_takes_the_index_map(spark, factor):
    im = np.arange(11 * 7).reshape(7, 11)
    w, h = max(1, int(11 * factor)), max(1, int(7 * factor))
    want = im[np.arange(h) * 7 // h][:, np.arange(w) * 11 // w]
    assert image(pixels.resampled(table(spark, {"a": im}), 11, 7, factor), "a", (h, w)).tolist() == want.tolist()


def test_ellipse_of_a_bar(spark):
    bar = spark.createDataFrame([("i", 1, x, y) for x in range(10, 30) for y in (5, 6, 7, 8)], "image string, id int, px int, py int")
    r = pixels.ellipse_corners(frames.mask_moments(bar)).first()
    xs, ys = sorted(p.x for p in r.corners), sorted(p.y for p in r.corners)
    assert abs(r.cx - 19.5) < 1e-9 and abs(r.cy - 6.5) < 1e-9
    assert np.allclose(xs, [19.5 - r.major / 2] * 2 + [19.5 + r.major / 2] * 2) and np.allclose(ys, [6.5 - r.minor / 2] * 2 + [6.5 + r.minor / 2] * 2)
    assert abs(r.major_axis[1].x - r.major_axis[0].x - r.major) < 1e-9 and abs(r.minor_axis[1].y - r.minor_axis[0].y - r.minor) < 1e-9
