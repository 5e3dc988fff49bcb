"""Overlay files in splits of any size give what reading them whole gives."""

import json
import random

import pytest

from landsift.sources import overlay_files as O


def layer(features, name="synthetic", **more):
    said = {"id": name, "name": "N {x}", "category": "c", "source_url": "u", "attribution": "a \"b\" }", "caveat": "", "geom_type": "point"}
    return said | more | {"features": {"type": "FeatureCollection", "crs": {"features": {"no": {"features": [{"id": "none"}]}}}, "features": features}}


def some_features(seed, n):
    r = random.Random(seed)
    odd = ['quote " brace }', "{[}]", "back\\slash", "\\", 'ends with \\"', "é\n\t", "", '"features":[{']
    return [{"type": "Feature", "id": k, "properties": {"a": r.choice(odd), r.choice(odd): {"features": [{"x": r.choice(odd)}]}}, "geometry": {"type": "LineString", "coordinates": [[r.random(), r.random()] for _ in range(r.randrange(1, 40))]}} for k in range(n)]


@pytest.fixture
def split(spark):
    """Sets how many bytes a split has."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    yield lambda n: [spark.conf.set(k, str(v)) for k, v in zip(keys, (n, 1), strict=True)]
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [300, 5000, 10**8])
@pytest.mark.parametrize("indent", [None, 1])
def test_splits_give_what_the_whole_gives(spark, tmp_path, split, size, indent):
    n, m = (12, 8) if size < 1000 else (40, 30)
    whole = [layer(some_features(1, n), "one"), layer([], "none"), layer(some_features(2, m), "two")]
    whole[2] = {"features": whole[2].pop("features"), **whole[2]}  # metadata after the features
    (tmp_path / "o.json").write_text(json.dumps(whole, indent=indent))
    split(size)
    found = O.inspect(spark, str(tmp_path / "o.json"))
    layers = found.layers().orderBy("layer").collect()
    assert [(x.id, x.features, x.attribution) for x in layers] == [("one", n, 'a "b" }'), ("none", 0, 'a "b" }'), ("two", m, 'a "b" }')]
    rows = found.features().orderBy("layer", "start", "pos").collect()
    assert all(r.error is None for r in rows)
    for n, x in enumerate(whole):
        assert [json.loads(r.feature) for r in rows if r.layer == n] == x["features"]["features"]
    if size < 1000:
        assert found.parts.where("kind = 'head'").count() > 5


def test_several_files_and_odd_elements(spark, tmp_path, split, monkeypatch):
    features = [{"id": 1, "properties": {"t": "x" * 900}}, 3, None, "text } {", {"id": 2, "properties": {}}, [4, 5]]
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps([layer(features, f"l{k}")]))
    split(300)
    monkeypatch.setattr(O, "MOST_BYTES", 500)
    found = O.inspect(spark, str(tmp_path))
    rows = found.features().collect()
    large = [r for r in rows if r.error == "feature_too_large"]
    assert len(large) == 3 and all(r.feature is None for r in large)
    assert [json.loads(r.feature)["id"] for r in rows if r.error is None] == [2, 2, 2]
    assert sum(r.error == "feature_not_object" for r in rows) >= 9


@pytest.mark.parametrize(
    ("text", "problem"),
    [
        (json.dumps([layer([{"id": 1}])])[:-40], "invalid_overlay_json"),
        (json.dumps([layer([{"id": "open"}])])[:-8] + '"never closed', "invalid_overlay_json"),
        (json.dumps([layer([]), layer([])]), "Ambiguous duplicate overlay ID"),
        (json.dumps([layer([], geom_type="cube")]), "invalid_overlay_metadata"),
        (json.dumps([{k: v for k, v in layer([]).items() if k != "caveat"}]), "Overlay metadata or feature array is missing"),
        (json.dumps([{k: v for k, v in layer([]).items() if k != "features"}]), "Overlay metadata or feature array is missing"),
        (json.dumps([layer([], f"l{k}") for k in range(101)]), "Too many layers in the input"),
    ],
)
def test_files_that_are_refused(spark, tmp_path, split, text, problem):
    (tmp_path / "o.json").write_text(text)
    for size in (10**8, 150):
        split(size)
        with pytest.raises(ValueError, match=problem):
            O.inspect(spark, str(tmp_path / "o.json"))


def test_a_file_that_changes_between_passes_is_refused(spark, tmp_path):
    path = tmp_path / "o.json"
    path.write_text(json.dumps([layer([{"id": "before"}])]))
    found = O.inspect(spark, str(path))
    first = found.checksum
    path.write_text(json.dumps([layer([{"id": "behind"}])]))
    with pytest.raises(Exception, match="changed between two passes"):
        found.features().collect()
    assert O.inspect(spark, str(path)).checksum != first
