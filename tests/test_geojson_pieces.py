"""GeoJSON files in pieces of bytes: every feature once, wherever a piece ends."""

import io
import json
import random

import pytest

from wayfare.functions import geo
from wayfare.sources import geojson, readers


def collection(seed, indent=None, ends=""):
    r = random.Random(seed)
    out = []
    for k in range(60):
        x, y = r.uniform(-10, 10), r.uniform(-10, 10)
        ring = [[x, y], [x + 1, y], [x + 1, y + 1], [x, y]]
        notes = r.choice(['plain', 'é ü 漢字', '{"type": "Feature", "a": [', 'a\\b "quoted" }, {', "x" * r.randint(0, 400)])
        feature = {"type": "Feature", "properties": {"k": k, "notes": notes, "deep": {"a": [{"b": 1}, {"type": "x"}]}}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
        if k % 7 == 0:
            feature = {"id": k, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}, "properties": feature["properties"], "type": "Feature"}
        out.append(feature)
    whole = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:4326"}}, "features": out, "note": {"type": "end"}}
    return out, json.dumps(whole, indent=indent, ensure_ascii=seed % 2 == 0).encode() + ends.encode()


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize(("split", "block"), [(1, 200), (97, 64), (1000, 300), (10**9, 1 << 20)])
def test_every_feature_is_in_one_piece(monkeypatch, indent, split, block):
    monkeypatch.setattr(geojson, "BLOCK", block)
    for seed in (1, 2):
        expected, data = collection(seed, indent)
        step = split if split > 90 or indent is None else 50
        pieces = [(a, min(a + step, len(data))) for a in range(0, len(data), step)]
        if split == 1:
            pieces = [p for p in pieces if p[0] < 6000] + [(6000, len(data))]
        found = [(json.loads(raw), value) for a, b in pieces for raw, value in geojson.features(io.BytesIO(data), len(data), a, b)]
        assert [f for f, _ in found] == expected


def test_broken_and_empty_files():
    expected, data = collection(3)
    cut = data[: len(data) // 2]
    found = [json.loads(raw) for raw, _ in geojson.features(io.BytesIO(cut), len(cut), 0, len(cut))]
    assert 10 < len(found) < 60 and found == expected[: len(found)]
    for text in (b"", b"{", b"no json", b"[]", b'{"type": "FeatureCollection", "features": []}'):
        assert list(geojson.features(io.BytesIO(text), len(text), 0, len(text))) == []


@pytest.mark.parametrize("split", [300, 5000])
def test_pieces_give_the_rows_of_the_whole_file(spark, tmp_path, split):
    (tmp_path / "a.geojson").write_bytes(collection(4)[1])
    (tmp_path / "b.geojson").write_bytes(collection(5, indent=1)[1])
    (tmp_path / "notes.txt").write_text("not read")
    whole = readers.read_geojson(spark, str(tmp_path / "*.geojson"), ["k", "notes"])
    pieces = readers.read_geojson(spark, str(tmp_path), ["k", "notes"], split=split)
    key = lambda df: sorted((r.k, r.notes, str(r.geometry)) for r in df.collect())
    assert key(pieces) == key(whole) and pieces.rdd.getNumPartitions() > 4
    x1, y1, x2, y2 = geo.bounds(whole.geometry)
    near = whole.where((x1 <= 2) & (x2 >= 0) & (y1 <= 3) & (y2 >= -3))
    boxed = geojson.read_features(spark, str(tmp_path), split, (0.0, -3.0, 2.0, 3.0))
    assert boxed.count() == near.count() > 0
    plan = boxed._jdf.queryExecution().executedPlan().toString()
    assert "<=" not in plan.split("BatchScan")[0], plan  # the box is applied where features are read


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_whole_files_are_cut_at_features_or_refused(monkeypatch, block):
    monkeypatch.setattr(geojson, "BLOCK", block)
    for seed, indent in ((1, None), (2, 2)):
        expected, data = collection(seed, indent)
        for split in (1, 700, 10**9):
            crs, pieces = geojson.cut(io.BytesIO(data), len(data), split)
            assert crs == "EPSG:4326" and [json.loads(v) for a, b in pieces for v in geojson.values(data[a:b])] == expected
        for bad in (data[: len(data) // 2], data[:-1], data.replace(b'"Feature"', b'"Feature', 1), data.replace(b'"geometry"', b'NaN, "geometry"'), b"", b"[]", b"{not json"):
            with pytest.raises(ValueError):
                geojson.cut(io.BytesIO(bad), len(bad))
    text = b'{"x": {"features": [1]}, "y": "\\"features\\": [", "features" : [ ] }'
    assert geojson.cut(io.BytesIO(text), len(text)) == (None, [])


def test_no_feature_parses_the_whole_file_again(spark, tmp_path):
    (tmp_path / "a.geojson").write_bytes(collection(6)[1])
    plan = readers.read_geojson(spark, str(tmp_path / "*.geojson"), ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "$.crs" not in plan and "$.features" not in plan
