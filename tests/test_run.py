"""A run that is stopped, taken up again and done over."""

import os

import pytest
from conftest import SF_DIR

from spectralake.operators import bands
from spectralake.plans import products, run
from spectralake.sources import bucketed
from spectralake.storage import save
from workload import queries as q
from workload import views as v


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rows = bucketed.write_store(v.frame_rows(spark, SF_DIR), str(tmp_path_factory.mktemp("images") / "store"), order=("y",))
    return rows, save(v.stacks(spark, SF_DIR)), q._calibration(spark, SF_DIR, True, True), v.bands(spark).select("band", "lo", "hi")


def process(world, folder, **more):
    rows, stacks, cal, table = world
    return sorted(r.shot for r in run.process(rows, stacks, cal, table, folder, "today", q.QUIET_K, 1.0, **more).collect())


def values(spark, folder):
    return {(r.shot, r.frame, r.band): r.intensity for r in run.intensities(spark, folder).collect()}


def times(folder):
    return {os.path.join(a, f): os.path.getmtime(os.path.join(a, f)) for a, _, files in os.walk(folder) for f in files}


def test_lost_run_is_done_again_and_finished_ones_are_left(spark, world, tmp_path, monkeypatch):
    folder = str(tmp_path / "run")
    everything = sorted(r.shot for r in world[1].collect())
    write = run.text.write_shot_files

    def lost(*_):
        raise OSError("lost")

    monkeypatch.setattr(run.text, "write_shot_files", lost)
    with pytest.raises(OSError):
        process(world, folder)
    assert run.finished(spark, folder).collect() == [] and values(spark, folder) == {}
    monkeypatch.setattr(run.text, "write_shot_files", write)
    assert process(world, folder) == everything
    rows, stacks, cal, table = world
    spectra, _ = products.calibrated_spectra(rows, cal, stacks, q.QUIET_K)
    whole = products.intensities(spectra, cal, table, stacks, pad=1.0)
    assert values(spark, folder) == {(r.shot, r.frame, r.band): pytest.approx(r.intensity) for r in whole.collect()}
    there = {k: t for k, t in times(folder).items() if "/spectra/" in k or "/text/" in k}
    assert there and process(world, folder) == []
    assert {k: t for k, t in times(folder).items() if "/spectra/" in k or "/text/" in k} == there
    before = values(spark, folder)
    assert process(world, folder, redo=True) == everything
    assert values(spark, folder) == {k: pytest.approx(x) for k, x in before.items()}
    assert run.table(spark, folder, stacks, q.FULL_BANDS).count() == len({k[:2] for k in before if k[1] > 0})


def test_fitted_bands_replace_integrals(spark, world, tmp_path):
    rows, stacks, cal, table = world
    lines, names = v.band_lines_small(spark), ["b668", "b650", "b630"]
    folder = str(tmp_path / "fitted")
    process(world, folder, lines=lines, fitted=names)
    got = values(spark, folder)
    spectra, _ = products.calibrated_spectra(rows, cal, stacks, q.QUIET_K)
    points = save(products.packed.points_of(products.band_points(spectra, cal, table, 1.0)))
    whole = {(r.shot, r.frame, r.band): r.intensity for r in bands.integrate(points).collect()}
    strong = bands.detect(points).where("signal and frame >= 1").where(points["band"].isin(*names)).select(*bands.SLICE)
    ratios = bands.line_ratios(lines)
    clear = save(points.join(strong, list(bands.SLICE), "left_semi"))
    fitted = bands.integrate_fit(bands.fit_samples(bands.fit_bands(clear, ratios), ratios, clear))
    fitted = {(r.shot, r.frame, r.band): r.intensity for r in fitted.collect()}
    want = {k: fitted[k] if fitted.get(k) is not None else x for k, x in whole.items() if k[2] not in names or k[1] >= 1}
    assert set(got) == set(want)
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or got[k] == pytest.approx(want[k], rel=1e-6)) for k in want)
