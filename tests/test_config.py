from dataclasses import dataclass

import pytest

from gridstat.operators import extractors as E
from gridstat.operators import ladder as L
from gridstat.sources.config import SettingsError, candidate_ratios, merged, read_settings, setting, subsample_size, substitute


def test_parameters_before_environment(monkeypatch):
    monkeypatch.setenv("GRID_SIDE", "64")
    value = {"a": "${n}", "b": ["x${n}y", "${GRID_SIDE}"], "c": 3}
    assert substitute(value, {"n": 5}) == {"a": 5, "b": ["x5y", "64"], "c": 3}
    assert substitute("${GRID_SIDE}", {"GRID_SIDE": 8}) == 8
    with pytest.raises(KeyError):
        substitute("${surely_not_set}", {})


def test_merging_is_deep_and_leaves_its_arguments():
    base = {"a": {"x": 1, "y": 2}, "b": 1}
    assert merged(base, {"a": {"y": 3}, "c": 4}) == {"a": {"x": 1, "y": 3}, "b": 1, "c": 4}
    assert base == {"a": {"x": 1, "y": 2}, "b": 1}


def test_sizes_and_candidates():
    assert [subsample_size(n) for n in (5_000, 10_000, 100_000)] == [5_000, 10_000, 19_000]
    assert candidate_ratios([1.0, 2.0]) == [[1.0, 2.0], [1.5, 3.0], [0.7, 1.4]]


@dataclass(frozen=True)
class Noise:
    scale: float = setting(least=0.0, most=1.0)
    kind: str = setting("white", among=("white", "pink"))


@dataclass(frozen=True)
class Job:
    samples: int = setting(least=1)
    noise: Noise = setting()
    sizes: list[int] = setting([64], least=8, most=4096, items=(1, 3))
    seed: int | None = setting(None)
    dry: bool = setting(False)


def test_settings_are_typed(tmp_path):
    job = read_settings(Job, {"samples": "${n}", "noise": {"scale": 1}}, {"n": 5})
    assert job == Job(5, Noise(1.0), [64], None, False) and isinstance(job.noise.scale, float)
    path = tmp_path / "job.json"
    path.write_text('{"samples": 2, "noise": {"scale": 0.5, "kind": "pink"}, "sizes": [8, 16], "seed": 7, "dry": true}')
    assert read_settings(Job, path) == Job(2, Noise(0.5, "pink"), [8, 16], 7, True)


def test_all_faults_are_told_at_once():
    with pytest.raises(SettingsError) as e:
        read_settings(Job, {"samples": 0, "noise": {"scale": 2.0, "kind": "blue", "hue": 1}, "sizes": [4, "x"], "sede": 1, "dry": 1})
    faults = e.value.faults
    for place in ("samples", "noise.scale", "noise.kind", "noise.hue", "sizes[0]", "sizes[1]", "sede", "dry"):
        assert any(f.startswith(place + ":") for f in faults), place
    assert len(faults) == 8
    for bad in ({"noise": {"scale": 0.1}}, {"samples": 1, "noise": 3}, {"samples": True, "noise": {"scale": 0.1}}, {"samples": 1, "noise": {"scale": 0.1}, "sizes": []}, []):
        with pytest.raises(SettingsError):
            read_settings(Job, bad)


def test_names_follow_from_the_declaration(spark):
    config = read_settings(E.SummaryConfig, {"families": ["gradients", "structural"], "methods": ["mean", "std"]})
    rows = [(s, r, 4, 4, [float((7 * i + s + r) % 5) for i in range(16)]) for s in range(2) for r in range(2)]
    out = E.summary_of(spark.createDataFrame(rows, "sample_id int, realization int, h int, w int, data array<double>"), "sample_id", "realization", config)
    names = [r["feature"] for r in out.where("sample_id = 0").select("feature").collect()]
    assert sorted(names) == sorted(E.feature_names(config)) and len(names) * 2 == E.feature_count(config) and out.columns == ["sample_id", "feature", "mean", "std"]
    with pytest.raises(SettingsError):
        read_settings(E.SummaryConfig, {"methods": ["mode"]})


def test_plans_depend_on_level_and_shape():
    wide, lone = {"channels": 5, "steps": 9}, {"channels": 1, "steps": 9}
    assert [len(L.plan(L.CAUSALITY, v, wide).runs) for v in L.LEVELS] == [1, 2, 3]
    assert L.plan(L.CAUSALITY, "full", lone).columns == L.plan(L.CAUSALITY, "full", wide).columns == ["source", "target", "asymmetry", "improvement", "transfer_entropy"]
    assert not L.plan(L.CAUSALITY, "full", lone).runs and len(L.plan(L.CAUSALITY, "medium", lone).empty) == 2
    with pytest.raises(ValueError):
        L.plan(L.CAUSALITY, "slow", wide)


def test_estimate_is_what_the_whole_summary_has(spark, data):
    """The default declaration names the features of the query summary_features."""
    from gridstat.plans import catalogue

    config = E.SummaryConfig()
    out = catalogue.queries()["summary_features"](spark, data)
    names = {r["feature"] for r in out.select("feature").distinct().collect()}
    assert names == set(E.feature_names(config)) and len(out.columns) - 2 == len(config.methods)
