import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.operators import pixels, spectra, stats, surface, wcs
from lumenfield.sources import fits, fits_source
from lumenfield.streaming import ingest


def frame(spark, image, name="i"):
    rows = [(name, y, x, None if np.isnan(v) else float(v), 0.1, 0) for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "image_id string, y long, x long, sci double, err double, dq int")


def plane(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[column] is not None:
            out[r["y"], r["x"]] = r[column]
    return out


def blurred(image, rx, ry, sigma):
    def pass_(a, r, axis):
        k = np.array(pixels.gaussian_kernel(r, sigma))
        pad = np.pad(a, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="reflect")
        return np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, pad)

    ok = ~np.isnan(image)
    num = pass_(pass_(np.where(ok, image, 0), rx, 1), ry, 0)
    den = pass_(pass_(ok.astype(float), rx, 1), ry, 0)
    return np.where(den > 1e-12, num / np.maximum(den, 1e-300), np.nanmedian(image))


@pytest.fixture(scope="module")
def image():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(24, 30))
    a[rng.random(a.shape) < 0.1] = np.nan
    a[10:14, 12:17] += 30
    a[0, :] = np.nan
    return a


def test_smoothing(spark, image):
    got = plane(pixels.smooth(frame(spark, image), 3, 1, 1.5), "smooth", image.shape)
    assert np.allclose(got[1:], blurred(image[1:], 3, 1, 1.5), atol=1e-9) and np.isnan(got[0]).all()
    got = plane(pixels.smooth(frame(spark, image), 3, 1, 1.5, fill="median"), "smooth", image.shape)
    assert np.allclose(got[0], np.nanmedian(image))
    with pytest.raises(Exception, match="mask covers"):
        pixels.smooth(frame(spark, image), 1, 1, invalid=F.col("x") == 3).collect()


def test_clipped_statistics(spark, image):
    v = image[~np.isnan(image)]
    for sigma in (1.5, 3.0):
        m = np.median(v)
        k = v[np.abs(v - m) <= sigma * np.median(np.abs(v - m)) * stats.MAD_EXACT]
        want = (k.mean(), k.std(), np.median(k), np.median(np.abs(k - np.median(k))) * stats.MAD_EXACT)
        r = stats.clipped_stats(frame(spark, image), sigma=sigma).first()
        assert (r["mean"], r["std"], r["median"], r["mad"]) == pytest.approx(want)


def test_segments_are_8_connected(spark):
    a = np.zeros((8, 12))
    a[1, 1:4] = a[2, 4:6] = 1  # joined at a corner: five pixels
    a[5, 1:5] = 1  # four pixels
    a[6:8, 8:11] = 1
    on = frame(spark, a).where("sci > 0")
    got = {(r["y"], r["x"]) for r in pixels.segments(on, 5).collect()}
    a[5] = 0
    assert got == set(zip(*map(lambda v: v.tolist(), np.nonzero(a))))


def test_segmentation_finds_the_source(spark, image):
    seg = plane(pixels.segmentation(frame(spark, image), 4.0).withColumn("s", F.col("segment").cast("int")), "s", image.shape)
    assert seg[10:14, 12:17].all() and seg[1:5, :5].sum() == 0


def test_background_follows_a_smooth_surface(spark):
    y, x = np.mgrid[:64, :64]
    a = 1 + 0.01 * x + 0.02 * y + 0.0003 * x * y
    df = frame(spark, a)
    got = plane(pixels.background(df, F.lit(False), 8, origin_x=3.5, origin_y=3.5, bounds=(0, 64, 0, 64)), "background", a.shape)
    assert np.abs(got - a).max() < 0.01
    got = plane(pixels.background(df, F.lit(False), 8, origin_x=3.5, origin_y=3.5), "background", a.shape)
    assert np.abs(got - a)[4:60, 4:60].max() < 0.01 and (got[:, :4] == got[:, [3]]).all() and (got[60:] == got[63]).all()  # beyond the tiles' places their value
    few = pixels.background(frame(spark, a[:16, :16]), F.lit(False), 8)
    assert few.where("background is not null").isEmpty()


def test_smoothing_does_not_depend_on_tiles(spark, image):
    thin = image[3:6]  # an image narrower than the radius
    df = frame(spark, image).unionByName(frame(spark, thin, "thin")).unionByName(frame(spark, np.full((2, 3), np.nan), "none")).withColumns({"y": F.col("y") + 5, "x": F.col("x") + 3})
    df = df.where("not (image_id = 'i' and y % 5 = 2 and x % 7 = 1)")  # absent pixels have no weight either
    full = image.copy()
    for y, x in np.ndindex(image.shape):
        if (y + 5) % 5 == 2 and (x + 3) % 7 == 1:
            full[y, x] = np.nan
    far = np.pad(thin, [(15, 15), (0, 0)], mode="reflect")  # many reflections
    for side in (5, 8, 64):
        out = pixels.smooth(df, 4, 2, 2.0, side=side)
        assert out.count() == df.count()
        for name, want in (("i", blurred(full[1:], 4, 2, 2.0)), ("thin", blurred(thin, 4, 2, 2.0) if thin.shape[0] > 2 else far)):
            got = plane(out.where(F.col("image_id") == name).withColumns({"y": F.col("y") - 5, "x": F.col("x") - 3}), "smooth", image.shape)
            got = got[1:] if name == "i" else got[:3]
            assert np.allclose(got[~np.isnan(got)], want[~np.isnan(got)], atol=1e-9) and (~np.isnan(got)).sum() > 80
        assert out.where("image_id = 'none' and smooth is not null").isEmpty()


def test_segments_across_tiles_against_a_flood(spark):
    rng = np.random.default_rng(12)
    images = {f"r{i}": rng.random((23, 31)) < p for i, p in enumerate((0.2, 0.35, 0.5, 0.6))}
    corner = np.zeros((16, 16), bool)  # one diagonal line through tile corners, and one against it
    corner[np.arange(16), np.arange(16)] = True
    images["down"], images["up"] = corner, corner[::-1]
    snake = np.zeros((12, 12), bool)
    snake[::2], snake[1::4, -1], snake[3::4, 0] = True, True, True
    images["snake"] = snake
    rows = [(k, int(y) + 6, int(x) + 2) for k, a in images.items() for y, x in np.argwhere(a)]
    df = spark.createDataFrame(rows, "image_id string, y long, x long").repartition(5)
    want = {5: set(), 16: set()}
    for k, a in images.items():
        left = {tuple(p) for p in np.argwhere(a)}
        while left:
            todo = [left.pop()]
            seen = set(todo)
            while todo:
                y, x = todo.pop()
                for p in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if p in left:
                        left.remove(p), seen.add(p), todo.append(p)
            for n, kept in want.items():
                kept |= {(k, int(y) + 6, int(x) + 2) for y, x in seen} if len(seen) >= n else set()
    for side, n in ((4, 5), (4, 16), (8, 16), (128, 5)):
        got = [tuple(r) for r in pixels.segments(df, n, side).collect()]
        assert len(got) == len(set(got)) and set(got) == want[n]
    assert pixels.segments(df.limit(0)).collect() == []


def test_quantiles_of_groups_beyond_what_is_held(spark):
    """Groups of one value, of ties, of far exponents and of nulls, with and without ranges, against numpy."""
    rng = np.random.default_rng(4)
    groups = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 3, 2000).astype(float), "same": np.full(900, 7.0), "far": 10.0 ** rng.uniform(-300, 300, 1500) * rng.choice([-1, 1], 1500), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "gap": np.r_[np.zeros(500), np.ones(500)]}
    rows = [(g, i % 2, float(v)) for g, x in groups.items() for i, v in enumerate(x)] + [("none", 0, None), ("normal", 0, None)]
    df = spark.createDataFrame(rows, "g string, half int, v double").repartition(7)
    at = {"low": 0.0, "p01": 0.01, "median": 0.5, "p99": 0.99, "high": 1.0}
    for held in (10**6, 400):
        got = {r["g"]: [r[c] for c in at] for r in stats.quantiles(df, ("g",), "v", at, held).collect()}
        assert set(got) == set(groups)
        for g, x in groups.items():
            assert got[g] == pytest.approx(np.quantile(x, list(at.values())), rel=1e-12)
    both = stats.quantiles(df, ("g", "half"), "v", {"m": 0.5}, 400)
    assert {(r["g"], r["half"]): r["m"] for r in both.collect()} == pytest.approx({(g, k): np.median(x[k::2]) for g, x in groups.items() for k in (0, 1) if len(x[k::2])})
    image = df.withColumnsRenamed({"g": "image_id", "v": "sci"}).where("image_id != 'far'")
    for work in (stats.clipped_stats, stats.percentiles):
        a, b = (sorted(map(tuple, work(image, held=held).collect())) for held in (10**6, 400))
        assert len(a) == len(b) and all(p[0] == q[0] and p[1:] == pytest.approx(q[1:], abs=1e-12) for p, q in zip(a, b))
    flux = df.select(F.lit(0).alias("y"), F.hash("g").alias("bin"), F.col("v").alias("flux"))
    a, b = (sorted(map(tuple, spectra.combine_median(flux, held=held).collect()), key=str) for held in (10**6, 400))
    assert len(a) == 8 and all(p == pytest.approx(q, rel=1e-12) for p, q in zip(a, b) if p[2] is not None)


def scattered(seed=3, n=240):
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(-5, 40, n), rng.uniform(100, 130, n)
    return x, y, 3 * np.sin(x / 4) + np.cos(y / 3) * x / 20 + rng.normal(size=n) * 0.2


def test_spline_is_a_polynomial_where_that_is_smooth_enough():
    x, y, z = scattered()
    u, v = (x - 17) / 22, (y - 115) / 15
    a = np.stack([u**i * v**j for i in range(4) for j in range(4)], 1)
    want = a @ np.linalg.lstsq(a, z, rcond=None)[0]
    left = ((z - want) ** 2).sum()
    got = surface.fitted(x, y, z, s=left * 1.01)
    assert np.abs(got.at(x, y) - want).max() < 1e-6 and len(got.kx) == len(got.ky) == 8
    assert surface.fitted(x[:15], y[:15], z[:15]) is None and surface.fitted(x * 0, y, z) is None


def test_spline_is_the_smoothest_of_its_knots_that_leaves_the_sum():
    x, y, z = scattered()
    before = np.inf
    for s in (60.0, 25.0, 12.0):
        got = surface.fitted(x, y, z, s, bounds=(-6, 41, 99, 131))
        assert abs(((z - got.at(x, y)) ** 2).sum() - s) <= 1.01e-3 * s and s < before
        before = s
        assert len(got.kx) + len(got.ky) > 16 and (got.kx[0], got.kx[-1], got.ky[0], got.ky[-1]) == (-6, 41, 99, 131)
        # gradients of the sum of squares and of the roughness are parallel (up to solving), in terms of the tensor of functions
        bx, by = surface.basis(x, got.kx), surface.basis(y, got.ky)
        pull = np.einsum("n,nj,ni->ji", z - got.at(x, y), by, bx)
        jx, jy = surface.jumps(got.kx), surface.jumps(got.ky)
        rough = got.coef @ jx.T @ jx + jy.T @ jy @ got.coef
        weight = (pull * rough).sum() / (rough**2).sum()
        assert weight > 0 and np.abs(pull - weight * rough).max() < 1e-6 * max(1, np.abs(pull).max())


def test_spline_basis_and_jumps_against_their_definitions():
    k = surface.knots_of(np.array([2.0, 3.5, 7.0]), 0.0, 10.0)

    def function(i, d, t):
        if d == 0:
            return float(k[i] <= t < k[i + 1] or (t == k[-1] and k[i] < k[i + 1] == k[-1]))
        one = (t - k[i]) / (k[i + d] - k[i]) * function(i, d - 1, t) if k[i + d] > k[i] else 0
        return one + ((k[i + d + 1] - t) / (k[i + d + 1] - k[i + 1]) * function(i + 1, d - 1, t) if k[i + d + 1] > k[i + 1] else 0)

    t = np.array([0, 0.3, 2, 3.1, 3.5, 6.9, 7, 9.99, 10])
    assert np.allclose(surface.basis(t, k), [[function(i, 3, x) for i in range(7)] for x in t]) and np.allclose(surface.basis(np.array([-4.0, 14.0]), k), surface.basis(np.array([0.0, 10.0]), k))
    for row, at in zip(surface.jumps(k), (2.0, 3.5, 7.0)):
        third = lambda side: np.diff(surface.basis(at + side * np.array([0.1, 0.2, 0.3, 0.4]), k)[:: int(side)], 3, axis=0)[0] / 1e-3  # noqa: B023, E731
        assert np.allclose(row, (third(1) - third(-1)) * (10 / 4) ** 3, atol=1e-6)
    x, y = (v.ravel() for v in np.meshgrid(np.linspace(0, 10, 21), np.linspace(0, 10, 21)))
    made = surface.Surface(k, k, np.random.default_rng(2).normal(size=(7, 7)))
    close = surface.fitted(x, y, made.at(x, y), s=1e-3)
    assert ((close.at(x, y) - made.at(x, y)) ** 2).sum() <= 1.01e-3
    same = surface.fitted(x, y, made.at(x, y), knots=1, bounds=(0, 10, 0, 10))
    assert len(same.kx) == 8


def test_background_follows_a_bent_surface_as_smoothing_asks(spark):
    y, x = np.mgrid[0:64, 0:64]
    a = np.abs(x - 32.0) + 0.1 * y
    left = []
    for s in (None, 50.0, 5.0):
        got = plane(pixels.background(frame(spark, a), F.lit(False), 4, origin_x=1.5, origin_y=1.5, smoothing=s), "background", a.shape)
        tiles = a.reshape(16, 4, 16, 4).mean(axis=(1, 3))
        at = np.stack([got[1::4, 1::4], got[1::4, 2::4], got[2::4, 1::4], got[2::4, 2::4]]).mean(0)
        left.append(((at - tiles) ** 2).sum())
    assert left[0] > 200 > left[1] > left[2] or left[0] <= 256 * 1.01
    assert left[1] < 60 and left[2] < 8


def test_stripes_are_recovered(spark):
    rng = np.random.default_rng(0)
    cols, rows = rng.normal(size=40), rng.normal(size=30)
    a = 5 + cols - np.median(cols) + (rows - np.median(rows))[:, None]
    got = plane(pixels.stripe_noise(frame(spark, a), F.lit(False)), "noise", a.shape)
    assert np.ptp((a - got).round(9)) < 1e-6
    with pytest.raises(ValueError):
        pixels.stripe_noise(frame(spark, a), F.lit(False), "OTHER")


def spectrum(spark, fluxes, waves, err=0.1):
    rows = [(s, 0, i, float(w), float(f), err) for s, (fl, ws) in enumerate(zip(fluxes, waves)) for i, (f, w) in enumerate(zip(fl, ws))]
    return spark.createDataFrame(rows, "spec_id long, y int, x long, wavelength double, flux double, err double")


def test_resampling_conserves_flux(spark):
    rng = np.random.default_rng(2)
    waves = np.arange(20) * 0.1 + 1
    df = spectrum(spark, [rng.normal(size=20)], [waves])
    params = spark.createDataFrame([(0.5, 0.07, 50)], "g0 double, step double, n long")
    r = spectra.resample(df, params).agg(F.sum(F.col("flux") * 0.07)).first()[0]
    assert r == pytest.approx(df.agg(F.sum(F.col("flux") * 0.1)).first()[0])
    centers = spark.createDataFrame([(i, 0.5 + 0.07 * i) for i in range(50)], "bin long, wavelength double")
    other = {x["bin"]: x["flux"] for x in spectra.resample_to(df, centers, 0.3).collect()}
    assert other == pytest.approx({x["bin"]: x["flux"] for x in spectra.resample(df, params).collect()})


def test_combination_of_one_and_of_clipped(spark):
    waves = np.arange(6) * 0.125 + 1
    one = spectra.resample_and_combine(spectrum(spark, [np.ones(6)], [waves])).orderBy("bin").collect()
    assert [r["flux"] for r in one][1:-1] == pytest.approx([1.0] * 4) and one[0]["n"] == 1
    fluxes = [np.ones(6)] * 20 + [np.full(6, 50.0)]
    mean = spectra.resample_and_combine(spectrum(spark, fluxes, [waves] * 21)).where("bin = 2").first()
    assert mean["flux"] == pytest.approx(1.0) and mean["n"] == 20
    few = spectra.resample_and_combine(spectrum(spark, fluxes[-9:], [waves] * 9)).where("bin = 2").first()
    assert few["n"] == 9
    med = spectra.resample_and_combine(spectrum(spark, fluxes, [waves] * 21), "median").where("bin = 2").first()
    assert med["flux"] == pytest.approx(1.0) and med["err"] == 0
    with pytest.raises(ValueError):
        spectra.resample_and_combine(spectrum(spark, fluxes, [waves] * 21), "sum")
    with pytest.raises(Exception, match="two centers"):
        spectra.edges(spectrum(spark, [[1.0]], [[1.0]])).collect()


def test_sky_and_pixels_are_inverse(spark):
    w = spark.createDataFrame([("i", 16.0, 12.0, 150.0, 60.0, -2e-4, 1e-5, 1e-5, 2e-4, 30, 24)], "image_id string, crpix1 double, crpix2 double, crval1 double, crval2 double, cd11 double, cd12 double, cd21 double, cd22 double, width long, height long")
    v = wcs.footprints(w).withColumn("p", F.transform("vertices", lambda s: wcs.sky_to_pixel(s["x"], s["y"]))).first()
    assert [(p["pix_x"], p["pix_y"]) for p in v["p"]] == [pytest.approx(c, abs=1e-7) for c in ((0, 0), (29, 0), (29, 23), (0, 23))]
    assert v["vertex_marker"] == [[0, 0], [29, 0], [29, 23], [0, 23]]


def write_fits(path, image, **cards):
    def unit(head, data=b""):
        text = "".join(f"{k:<8}= {v:>20}".ljust(80) if not isinstance(v, str) else f"{k:<8}= '{v}'".ljust(80) for k, v in head) + "END".ljust(80)
        return text.ljust(-(-len(text) // 2880) * 2880).encode() + data + b"\0" * (-len(data) % 2880)

    h, w = image.shape
    out = unit([("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0), *cards.items()])
    for name, kind, bits in (("SCI", ">f4", -32), ("ERR", ">f4", -32), ("DQ", ">i4", 32)):
        data = {"SCI": image, "ERR": image * 0 + 0.5, "DQ": np.isnan(image)}[name].astype(kind)
        out += unit([("XTENSION", "IMAGE"), ("BITPIX", bits), ("NAXIS", 2), ("NAXIS1", w), ("NAXIS2", h), ("PCOUNT", 0), ("GCOUNT", 1), ("EXTNAME", name)], data.tobytes())
    path.write_bytes(out)


def test_files_and_stream(spark, tmp_path, image):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in (1, 2):
        write_fits(folder / f"jw01895002001_02010_0000{i}_nrca1_cal.fits", image, FILTER="F115W", DETECTOR="NRCA1", PUPIL="CLEAR")
    (folder / "other.txt").write_text("no")
    files = fits.files(spark, str(folder))
    rows = fits.headers(files, "2b").orderBy("basename").collect()
    assert [(r["basename"], r["filter"], r["pupil"], r["width"], r["height"], r["expects_wcs"]) for r in rows] == [(f"jw01895002001_02010_0000{i}_nrca1", "F115W", "CLEAR", 30, 24, True) for i in (1, 2)]
    p = fits.pixels(fits.planes(files.limit(1), 16))
    assert np.allclose(plane(p, "sci", image.shape), image.astype("f4"), equal_nan=True)
    assert p.where("dq = 1").count() == np.isnan(image).sum() and p.where("err = 0.5").count() == (~np.isnan(image)).sum()

    def sync():
        ingest.watch(spark, str(folder), str(tmp_path / "table"), str(tmp_path / "check"), "2b").awaitTermination()

    sync()
    write_fits(folder / "jw01895002001_02010_00003_nrca1_cal.fits", image)
    sync()
    sync()
    table = str(tmp_path / "table")
    assert ingest.current(spark, table).count() == 3 and spark.read.parquet(f"{table}/v=1").count() == 1  # a batch writes its own rows


def test_stream_state_over_restarts_gives_the_box_of_all_files(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    seen = {}

    def arrive(*names):
        for name in names:
            path = tmp_path / "in" / name
            path.write_bytes(b"x" * (len(name) + len(seen)))
            os.utime(path, (1e9 + len(seen), 1e9 + len(seen)))
            seen[path.name.rsplit("_", 1)[0]] = path.name

    def sync():
        ingest.watch(spark, str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "check"), "2b").awaitTermination()
        box = ingest.current(spark, str(tmp_path / "log")).collect()
        assert {r["basename"]: r["filepath"].rsplit("/", 1)[1] for r in box} == seen

    exposure = "jw01895002001_02010_0000{}_nrca1".format
    arrive(*(f"{exposure(i)}_cal.fits" for i in range(4)), f"{exposure(3)}_crf.fits")
    sync()
    arrive(f"{exposure(1)}_crf.fits", f"{exposure(5)}_cal.fits")
    sync()
    sync()
    log = spark.read.parquet(str(tmp_path / "log")).where("v = 1")
    assert sorted((r["basename"], r["change"], (r["replaced"] or "/").rsplit("/", 1)[1], r["n_stages"]) for r in log.collect()) == [(exposure(1), 2, f"{exposure(1)}_cal.fits", 1), (exposure(5), 1, "", 1)]
    arrive(f"{exposure(1)}_i2d.fits")
    sync()


def test_fits_source_reads_headers_and_planes_apart(spark, tmp_path, image):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    for i in (1, 2, 3):
        write_fits(folder / ("deep" if i == 3 else "") / f"jw01895002001_02010_0000{i}_nrca1_cal.fits", image * i, FILTER="F115W", DETECTOR="NRCA1", PUPIL="CLEAR")
    (folder / "broken.fits").write_bytes(b"SIMPLE  =                    T")
    (folder / "other.txt").write_text("no")
    old = fits.headers(fits.files(spark, str(folder)), "2b").drop("filepath").where("filter is not null")
    for path in (str(folder), f"file://{folder}"):
        got = fits_source.exposures(spark, path, "2b")
        assert sorted(map(tuple, got.drop("filepath").select(old.columns).collect()), key=str) == sorted(map(tuple, old.collect()), key=str)
    units = spark.read.format("fits").load(str(folder))
    assert [(r["unit"], r["extname"], r["width"], r["bitpix"]) for r in units.where("filepath like '%00001%'").orderBy("unit").collect()] == [(0, None, None, 8), (1, "SCI", 30, -32), (2, "ERR", 30, -32), (3, "DQ", 30, 32)]
    assert spark.read.format("fits").schema("unit int, extname string").option("wildcard", "*00002*").load(str(folder)).collect()[1][1] == "SCI"
    made = fits_source.tiles(spark, str(folder), "jw*.fits", tile=16)
    assert made.rdd.getNumPartitions() == 9 and made.where("plane = 'SCI'").count() == 12  # a task for each file and plane
    assert fits_source.tiles(spark, str(folder), "jw*.fits", ("SCI",), 16).rdd.getNumPartitions() == 3
    key = ["filepath", "plane", "y0", "x0"]
    want = fits.planes(fits.files(spark, str(folder), "jw*.fits"), 16).withColumn("filepath", F.regexp_replace("filepath", "^file:/+", "file:///"))
    rows = lambda df: [tuple(r) for r in df.withColumn("values", F.to_json("values")).orderBy(key).collect()]
    assert rows(made) == rows(want) and len(rows(made)) == 3 * 3 * 4
    assert spark.read.format("fits").load(str(tmp_path / "in" / "deep")).count() == 4
    (tmp_path / "empty").mkdir()
    assert spark.read.format("fits").load(str(tmp_path / "empty")).count() == 0 and fits_source.tiles(spark, str(tmp_path / "empty")).count() == 0


def test_header_scan_leaves_the_data_unread(tmp_path, image):
    path = tmp_path / "a.fits"
    write_fits(path, np.zeros((700, 900)), FILTER="F115W")
    asked = []

    def read(at, n):
        asked.append(n)
        return path.read_bytes()[at : at + n]

    assert [h.get("EXTNAME") for h, _, _ in fits.walk(read)] == [None, "SCI", "ERR", "DQ"]
    assert sum(asked) <= 5 * fits.BLOCK < path.stat().st_size / 100


def test_flags_of_all_32_bits(spark, tmp_path):
    flags = np.array([[0, 1, 1 << 30], [1 << 31, (1 << 32) - 1, 2**31 - 1]], np.uint32)
    data = (flags.astype(np.int64) - (1 << 31)).astype(">i4").tobytes()
    head = [("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0)]
    unit = [("XTENSION", "'IMAGE'"), ("BITPIX", 32), ("NAXIS", 2), ("NAXIS1", 3), ("NAXIS2", 2), ("PCOUNT", 0), ("GCOUNT", 1), ("BZERO", 2147483648), ("BSCALE", 1), ("EXTNAME", "'DQ'")]
    text = lambda cards: ("".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in cards) + "END".ljust(80)).ljust(2880).encode()
    (tmp_path / "a.fits").write_bytes(text(head) + text(unit) + data.ljust(2880, b"\0"))
    for made in (fits.planes(fits.files(spark, str(tmp_path))), fits_source.tiles(spark, str(tmp_path))):
        got = {(r["y"], r["x"]): r["dq"] for r in fits.pixels(made).collect()}
        assert got == {(y, x): int(v) for (y, x), v in np.ndenumerate(flags)}


def test_stripe_noise_of_the_whole_image_masks_sources_and_bad_pixels(spark):
    """The mask is bad pixels or segments of the smoothed image; medians are numpy's."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(32, 32)) * 0.1 + rng.normal(size=32) + rng.normal(size=32)[:, None]
    a[8:14, 8:14] += 40
    bad = rng.random(a.shape) < 0.05
    df = frame(spark, np.where(bad, a + 300, a)).withColumn("dq", F.when(F.col("sci") > 150, 1).otherwise(0))
    seg = pixels.segmentation(pixels.smooth(df, 1, 1).withColumnRenamed("smooth", "sci"))
    off = bad | (plane(seg.withColumn("s", F.col("segment").cast("double")), "s", a.shape) == 1)
    assert off[8:14, 8:14].all() and off.mean() < 0.9
    left = np.where(off, np.nan, a)
    left = left - np.nanmedian(left)
    cols = np.nanmedian(left, axis=0)
    rows = np.nanmedian(left - cols, axis=1)
    want = np.nan_to_num(cols)[None, :] + np.nan_to_num(rows)[:, None]
    got = plane(pixels.stripe_noise_full(df), "noise", a.shape)
    assert np.allclose(got, want)


def test_tiles_that_do_not_fit_are_an_error_on_demand(spark, image):
    df = frame(spark, image)  # 24 x 30
    assert stats.tile_medians(df, F.lit(False), 6, partial=False).count() == 20
    assert stats.tile_medians(df, F.lit(False), 8).count() == 12
    for work in (stats.tile_medians, pixels.background):
        with pytest.raises(Exception, match="multiples"):
            work(df, F.lit(False), 8, partial=False).collect()


def test_background_with_more_knots_follows_a_bent_surface(spark):
    y, x = np.mgrid[0:64, 0:64]
    a = np.abs(x - 32.0) + 0.1 * y
    df = frame(spark, a)
    off = [np.abs(plane(pixels.background(df, F.lit(False), 4, origin_x=1.5, origin_y=1.5, knots=k), "background", a.shape) - a).mean() for k in (1, 4)]
    assert off[1] < off[0] / 2


def test_extraction_for_targets_against_brute_force(spark):
    """Exposures in a row; the spectrum of a target in its nearest exposure ends in the next one too."""
    square = lambda c: [(c - 0.5, -0.5), (c + 0.5, -0.5), (c + 0.5, 0.5), (c - 0.5, 0.5)]
    exposures = spark.createDataFrame([(i, i, "GRISMR", square(0.8 * i)) for i in range(5)] + [(9, 9, "CLEAR", square(0.0))], "ord long, image_id long, pupil string, vertices array<struct<x:double,y:double>>")
    px = spark.createDataFrame([(i, y, x, float(100 * i + 10 * y + x), 0.5) for i in range(5) for y in range(6) for x in range(4)], "image_id long, y long, x long, sci double, err double")
    traces = spark.createDataFrame([(i, 7, x, 2.5, 5.0 - 0.1 * x, 0.8 * i + 0.3 * (x - 1.5), 0.0) for i in range(5) for x in range(4)], "image_id long, source_id long, x long, y_trace double, wavelength double, sx double, sy double")
    targets = spark.createDataFrame([(1, 0.1, 0.1), (2, 1.7, 0.0), (3, 3.3, -0.2)], "id long, ra double, dec double")
    got = {(r["id"], r["image_id"], r["x"], r["row"]): (r["wave_no"], r["wavelength"], r["flux"]) for r in spectra.extract(exposures, px, traces, targets, 3).collect()}
    want = {}
    for t, ra in ((1, 0.1), (2, 1.7), (3, 3.3)):
        near = min(range(5), key=lambda i: ((0.8 * i - ra) ** 2, i))
        ends = [0.8 * near + 0.3 * (x - 1.5) for x in (0, 3)]
        for i in range(5):
            if any(abs(e - 0.8 * i) < 0.5 for e in ends):
                for x in range(4):
                    for row in range(3):
                        want[t, i, x, row] = (3 - x, pytest.approx(5.0 - 0.1 * x), 100.0 * i + 10 * (1 + row) + x)
    assert got == want and len({k[:2] for k in want}) > 3
    with pytest.raises(ValueError, match="GRISMR"):
        spectra.extract(exposures.where("pupil = 'CLEAR'"), px, traces, targets, 3)


def test_associations_list_their_members(spark):
    import json

    from lumenfield.operators import pointing

    rows = [("g1", f"jw01895002001_0201{i}_00001", "F115W", "NRCALONG", f"b{2 - i}.fits") for i in range(3)] + [("g2", "jw01895002001_02010_00002", "F200W", "NRCB1", "x.fits")]
    m = spark.createDataFrame(rows, "grp string, fileset string, filter string, detector string, filename string")
    got = {r["grp"]: json.loads(r["json"]) for r in pointing.associations(m.join(pointing.product_name(m, "grp"), "grp"), "grp").collect()}
    member = lambda n: {"expname": n, "exptype": "science"}
    assert got == {
        "g1": {"products": [{"name": "jw01895002001_02010+02011+02012_F115W_nrca", "members": [member(f"b{i}.fits") for i in range(3)]}]},
        "g2": {"products": [{"name": "jw01895002001_02010_F200W_nrcb", "members": [member("x.fits")]}]},
    }


def test_values_that_one_task_may_hold_count_over_all_groups(spark):
    """Ten groups of 100 meet in one task, so what is held is 1000 values, however small each group is."""
    df = spark.range(1000).select((F.col("id") % 10).alias("g"), F.col("id").cast("double").alias("v"))
    assert stats.held_at_once(df, ("g",)) == 1000
    got = stats.quantiles(df, ("g",), "v", {"m": 0.5}, held=999)
    assert "percentile(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["g"]: r["m"] for r in got.collect()} == {g: 495.0 + g for g in range(10)}


def test_sources_are_cut_out_once_whatever_the_number_of_targets(spark, sf, monkeypatch):
    from lumenfield.plans import queries as plans

    seen, cutout = [], spectra.cutout
    monkeypatch.setattr(spectra, "cutout", lambda pixels, trace, *a: seen.append(trace.count()) or cutout(pixels, trace, *a))
    out = plans.queries()["extract_spectra"](spark, sf)
    ids, images = out.select("id").distinct().count(), out.select("image_id").distinct().count()
    assert ids > images and seen == [60 * images]
