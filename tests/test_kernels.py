"""Image kernels against plain loops, and colour normalisation by its properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import kernels as K, stain as T
from sieveline.operators import quality as Q, routing as R

RNG = np.random.default_rng(5)
BATCH = RNG.random((7, 8, 8, 3))


def slow_otsu(gray, top=1.0):
    counts, _ = np.histogram(gray.ravel(), bins=256, range=(0, top))
    centre = (np.arange(256) + 0.5) * top / 256
    best, at = -1.0, 0.5 * top
    for t in range(1, 255):
        a, b = counts[:t].sum(), counts[t:].sum()
        if a and b:
            score = a * b * ((counts[:t] * centre[:t]).sum() / a - (counts[t:] * centre[t:]).sum() / b) ** 2
            if score > best + 1e-9:
                best, at = score, centre[t]
    return at


def slow_variance(gray, size=11):
    out, pad = np.empty_like(gray), size // 2
    wide = np.pad(gray, pad, mode="edge")
    for i in range(gray.shape[0]):
        for j in range(gray.shape[1]):
            out[i, j] = wide[i : i + size, j : j + size].var()
    return out


def test_batch_kernels_are_those_of_single_images():
    gray = BATCH.mean(axis=-1)
    assert np.allclose(K.box_variance(gray), [slow_variance(g) for g in gray], atol=1e-12)
    assert np.allclose(K.otsu(gray), [slow_otsu(g) for g in gray]) and np.allclose([K.otsu(g) for g in gray], K.otsu(gray))
    assert np.allclose(K.tissue_share(BATCH), [K.tissue_share(x[None])[0] for x in BATCH])
    found = K.features(BATCH)
    for i, x in enumerate(BATCH):
        assert all(np.isclose(v[i], K.features(x[None])[n][0]) for n, v in found.items())


def test_otsu_without_two_classes():
    assert K.otsu(np.zeros((4, 4))) == 0.5 and K.otsu(np.full((4, 4), 300.0), 256.0) == 128.0


def test_middling_tissue_takes_the_darker_share():
    x = np.full((8, 8, 3), 0.9)
    x[:3] = [0.5, 0.45, 0.5]  # little saturation, no texture beyond the edge
    share = float(((K.saturation(x) > 0.12) | (K.box_variance(x.mean(axis=-1)) > 0.003)).mean())
    assert K.tissue_share(x[None])[0] >= share


def test_ranges_and_bytes():
    x = np.array([[[0.0, 0.5, 1.0]]])
    assert K.to_u8(x).ravel().tolist() == [0, 127, 255] and K.to_u8_half_even(x).ravel().tolist() == [0, 128, 255]
    assert K.to_u8(np.array([[[0.0, 127.9, 300.0]]])).ravel().tolist() == [0, 127, 255]
    assert K.unit(np.array([[[0.0, 255.0, 51.0]]])).ravel().tolist() == [0.0, 1.0, 0.2] and K.unit(np.array([[[1.4, 0, 0]]]), 1.5).max() == 1.0
    assert K.to_u8_clip(np.array([[[0.7, 1.0, 2.0, 9.0]]])).ravel().tolist() == [0, 1, 2]
    flat = np.full((1, 2, 2, 3), 7.0)
    assert (K.stretch(flat) == 7).all() and K.stretch(BATCH).max() == 255


def test_regions_and_resolution():
    mask = np.zeros((10, 10), bool)
    mask[:2, :3] = mask[5:8, 5:8] = mask[0, 9] = True
    assert K.components(mask) == [6, 9] and K.components(mask, 1) == [1, 6, 9] and K.components(mask & False) == []
    image = np.ones((30, 30, 3))
    for k, (r, c) in enumerate([(2, 2), (2, 15), (15, 2), (15, 15), (25, 25)]):
        image[r : r + 3, c : c + 2 + k % 2, 1] = 0.0
    d = K.nucleus_diameters(image)
    assert len(d) >= 3 and np.isclose(K.resolution(d), 7.0 / np.median(d))
    assert len(K.nucleus_diameters(np.ones((8, 8, 3)))) == 0 and np.isnan(K.resolution(np.zeros(0)))


def test_nucleus_query_on_images_without_regions(spark, tmp_path):
    from sieveline.plans.catalog import QUERIES

    green = np.ones((2, 4, 4))
    green[1, 0::2, 0] = green[1, 0::2, 2:] = 0  # regions of 1, 1, 2 and 2 pixels; the first image has none
    px = np.ones((2, 4, 4, 3))
    px[..., 1] = green
    rows = [(vec, [1.0 if x else -1.0 for x in image.ravel()], 4) for vec, image in zip((9, 19), px, strict=True)]  # the view clips them to 0 and 1
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r.idx: (r.n, r.scale) for r in QUERIES["fn_nucleus_diameters"](spark, str(tmp_path)).collect()}
    assert found == {9: (0, None), 19: (4, round(K.resolution(K.nucleus_diameters(px[1], least=1)), 6))}
    assert found[19][1] == round(7 / (1 / np.sqrt(np.pi) + np.sqrt(2 / np.pi)), 6)


def test_polygons_become_masks():
    square = np.array([[110.0, 110], [150, 110], [150, 150], [110, 150]])
    mask = K.rasterize([square, square + 1000], 100, 100, 96, 96, 96, 96)
    assert mask[30, 30] == 1 and mask[5, 5] == 0 and 1600 <= mask.sum() <= 1700
    assert K.rasterize([square], 300, 300, 96, 96, 96, 96).sum() == 0
    assert K.rasterize([square], 100, 100, 96, 96, 48, 48)[15, 15] == 1
    assert K.center_label(mask, 32) == (1, mask[32:64, 32:64].mean()) and K.center_label(mask * 0) == (0, 0.0)


def test_resize_keeps_constants_and_sides():
    assert np.allclose(K.resize(np.full((5, 5, 3), 0.3), 11, 7), 0.3) and K.resize(BATCH, 16, 16).shape == (7, 16, 16, 3)
    row = RNG.random(8) * 0.4 + 0.3
    wide = K.resize(np.repeat(row[None, :, None], 8, axis=0).repeat(3, axis=2), 16, 16)[5, :, 0]
    weights = np.array([-0.03515625, 0.26171875, 0.87890625, -0.10546875])  # of the cubic with a = -3/4, three quarters on from the second
    assert np.isclose(wide[4], weights @ row[0:4]) and np.isclose(wide[5], weights[::-1] @ row[1:5])
    assert np.allclose(K.encoder_input(np.ones((4, 4, 3)) * K.ENCODER_MEAN, 4), 0)


def stained(stains, seed, scale=1.0):
    draw = np.random.default_rng(seed)
    amount = draw.gamma(2.0, 0.35, (40 * 40, 2)) * scale
    pure = draw.random(1600) < 0.3
    amount[pure, draw.integers(0, 2, 1600)[pure]] = 0.02
    return np.clip(np.exp(-amount @ stains), 0, 1).reshape(40, 40, 3)


PURPLE, PINK = np.array([0.65, 0.70, 0.29]), np.array([0.07, 0.99, 0.11])
STAINS = np.stack([PURPLE / np.linalg.norm(PURPLE), PINK / np.linalg.norm(PINK)])


def test_lab_round_trip_and_luminosity():
    assert np.allclose(T.from_lab(T.to_lab(BATCH)), BATCH, atol=1e-6)
    light = T.to_lab(T.luminosity(BATCH[..., :1].repeat(3, axis=-1) * 0.5))[..., 0]  # grays stay in gamut
    assert np.allclose(np.percentile(light, 95, axis=(-2, -1)), 100, atol=2) and (T.luminosity(np.zeros((1, 4, 4, 3))) == 0).all()


def test_stains_are_separated():
    image = stained(STAINS, 1)
    for rows in (T.macenko_stains(image), T.vahadane_stains(image)):
        assert np.all(np.abs((rows * STAINS).sum(axis=1)) > 0.97)
    assert T.macenko_stains(np.ones((8, 8, 3))) is None and T.vahadane_stains(np.ones((8, 8, 3))) is None
    with pytest.raises(ValueError):
        T.Stain.fit(np.ones((8, 8, 3)))


def test_amounts_are_least():
    dense = np.random.default_rng(2).random((30, 3))
    found = T.amounts(dense, STAINS, 0.05)
    loss = lambda c: 0.5 * ((dense - c @ STAINS) ** 2).sum(axis=1) + 0.05 * c.sum(axis=1)
    grid = np.stack(np.meshgrid(np.linspace(0, 2, 81), np.linspace(0, 2, 81)), axis=-1).reshape(-1, 2)
    best = np.min([loss(np.tile(g, (30, 1))) for g in grid], axis=0)
    assert (found >= 0).all() and (loss(found) <= best + 1e-9).all()


def test_normalisers_move_to_the_reference():
    target, other = stained(STAINS, 3), stained(STAINS[:, [1, 0, 2]] * 0.5 + STAINS * 0.5, 4, 0.7)
    pack = T.Pack.fit(target, vahadane=True)
    gap = lambda x: np.abs(x.mean(axis=(0, 1)) - target.mean(axis=(0, 1))).sum()
    for tool in (pack.macenko, pack.reinhard, pack.vahadane):
        assert gap(tool.transform(other)) < gap(other)
    assert pack.reinhard.transform(np.full((4, 4, 3), 0.5)) is None and pack.macenko.transform(np.ones((4, 4, 3))) is None


def test_routing_and_fallbacks():
    target = stained(STAINS, 3)
    pack = T.Pack.fit(target)
    other = stained(STAINS, 9)
    share = float((other[..., 2] > other[..., 0]).mean())
    assert T.adaptive(other, pack, share + 0.01)[1] == T.REINHARD and T.adaptive(other, pack, share)[1] == T.MACENKO

    class Fails:
        def transform(self, rgb):
            return None

    one = T.Pack(Fails(), pack.reinhard, pack.mean_rgb)
    assert T.adaptive(other, one, 0.0)[1] == T.REINHARD_FALLBACK
    two = T.Pack(pack.macenko, Fails(), pack.mean_rgb)
    assert T.adaptive(other, two, 1.1)[1] == T.MACENKO_FALLBACK
    none = T.Pack(Fails(), Fails(), pack.mean_rgb)
    out, code = T.adaptive(other, none, 0.0)
    assert code == T.LUMINOSITY and np.allclose(out, np.floor(T.luminosity(other) * 255) / 255)

    class Dark:
        def transform(self, rgb):
            return rgb * 0.01

    assert T.adaptive(other, T.Pack(Dark(), Dark(), pack.mean_rgb), 0.0)[1] == T.LUMINOSITY  # the result is judged, not the input
    assert T.classical(other, Dark())[1] == T.MACENKO and T.classical(other, Fails())[1] == T.LUMINOSITY
    assert np.allclose(T.transform_of(pack.macenko, standardize=lambda x: x)(other), T.classical(other, pack.macenko, standardize=lambda x: x)[0])


def test_router_is_fitted_and_assigned():
    draw = np.random.default_rng(0)
    middles = draw.random((4, 7)) * 10
    rows = np.concatenate([m + draw.normal(0, 0.05, (50, 7)) for m in middles])
    router = R.Router.fit(rows, middles[2], middles[[3, 0, 1]])
    found = sorted(np.round(router.centres * router.std + router.mean, 1).tolist())
    assert np.allclose(found, sorted(np.round(middles, 1).tolist()), atol=0.11)
    near = lambda m: int((((m - router.mean) / router.std - router.centres) ** 2).sum(axis=1).argmin())
    assert router.merge == near(middles[2]) and router.packs == {near(middles[3]): 0, near(middles[0]): 1, near(middles[1]): 2}
    assert np.array_equal(R.kmeans((rows - router.mean) / router.std), router.centres)
    assert R.assignment(np.array([[4.0, 1, 3], [2, 0, 5], [3, 2, 2]])) == (1, 0, 2)
    with pytest.raises(ValueError):
        R.Router.fit(rows[:3], rows[0], rows[:3])


def test_flags_by_hand(spark):
    white, black, flat, good = np.ones(48), np.zeros(48), np.full(48, 0.5), RNG.random(48) * 0.7
    mostly = np.where(np.arange(48) < 46, 0.0, 0.9)
    nearly = np.where(np.arange(48) < 46, 1.0, 0.1)
    rows = [(i, x.tolist()) for i, x in enumerate((white, black, flat, good, mostly, nearly))]
    df = spark.createDataFrame(rows, "idx int, px array<double>")
    found = {r.idx: set(r.a) for r in Q.features(df).select("idx", Q.anomalies().alias("a"), "*").drop("a").select("idx", Q.anomalies().alias("a")).collect()}
    assert found[0] == {"zero_std", "all_white", "low_blur_score", "low_contrast", "low_tissue"}
    assert found[1] == {"zero_std", "all_black", "low_blur_score", "low_contrast"}
    assert found[2] == {"zero_std", "low_blur_score", "low_contrast"} and found[3] == set()
    assert "high_black_ratio" in found[4] and "all_black" not in found[4] and "high_white_ratio" in found[5]


def test_gate_order_and_edges(spark):
    df = spark.createDataFrame([(1, 0.01, 0.9, 0.1), (2, 0.04, 0.5, 0.9), (3, 0.04, 0.4, 0.35), (4, 0.5, 0.1, 0.349)], "idx int, std_gray double, black double, tissue double")
    assert {r.idx: r.reason for r in df.select("idx", Q.gate().alias("reason")).collect()} == {1: "solid_color", 2: "high_black", 3: None, 4: "low_tissue"}


def test_image_column_leaves_null(spark):
    df = spark.createDataFrame([(1, None), (2, [0.5] * 12), (3, None)], "idx int, px array<double>")
    out = {r.idx: r.v for r in df.select("idx", K.image_column(lambda x: x * 2, 2)("px").alias("v")).collect()}
    assert out[1] is None and out[3] is None and out[2] == [1.0] * 12
    assert df.where("idx < 0").select(F.size(K.image_column(lambda x: x, 2)("px"))).count() == 0
