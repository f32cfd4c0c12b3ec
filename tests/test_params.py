"""Nested settings: every reason, unknown keys at any depth, documents that are none."""

from citygrid.operators import params


def test_reasons(spark):
    bodies = {
        1: "{}", 2: None, 3: "", 4: "[]", 5: '"x"', 6: '{"plate_mm": 180', 7: '{"plate_mm": 99}', 8: '{"plate_mm": "180"}', 9: '{"road_mode": "sunk"}', 10: '{"frame_style": {"shadow_gap": {"glow": {"x": 1}}}}', 11: '{"glitter": 1, "plate_mm": 1}', 12: '{"place": {"author": "%s"}}' % ("é" * 65), 13: '{"labels": [{"text": "a"}, {"txt": "b"}]}',
        14: '{"labels": %s}' % ("[" + ", ".join(["{}"] * 13) + "]"), 15: '{"frame_style": 3}', 16: '{"plate_mm": {"a": 1}}', 17: '{"colour": {"gradient": {"slots": [1, "a"]}, "tint": {"enabled": null}}}', 18: '{"place": {"author": "%s"}, "terrain": {"smoothing": 5}, "nozzle_mm": 1.2}' % ("é" * 64), 19: '{"labels": [{"u": 1.5}]}', 20: '{"labels": {"u": 1}}', 21: '{"schema_version": 5}',
    }
    got = {}
    for r in params.validate_params(spark.createDataFrame(list(bodies.items()), "design_id long, body string")).collect():
        got.setdefault(r["design_id"], []).append(r)
    wrong = {k: (v[0]["reason"], v[0]["path"]) for k, v in got.items() if not v[0]["accepted"]}
    none = ("no object", None)
    assert wrong == {
        2: none, 3: none, 4: none, 5: none, 6: none, 7: ("out of range", "plate_mm"), 8: ("wrong kind", "plate_mm"), 9: ("not a choice", "road_mode"), 10: ("unknown key", "frame_style.shadow_gap.glow"), 11: ("unknown key", "glitter"), 12: ("too long", "place.author"), 13: ("unknown key", "labels[].txt"), 14: ("too long", "labels"), 15: ("unknown key", "frame_style"),
        16: ("wrong kind", "plate_mm"), 17: ("wrong kind", "colour.tint.enabled"), 19: ("out of range", "labels[].u"), 20: ("wrong kind", "labels"), 21: ("not a choice", "schema_version"),
    }
    flat = [p for _, p, k, *_, s in params.SPEC if s is not None and k != "list"]
    assert {r["path"] for r in got[1]} == set(flat) and len(got[1]) == len(flat)
    merged = {r["path"]: r["value"] for r in got[18]}
    assert merged["terrain.smoothing"] == "5" and merged["nozzle_mm"] == "1.2" and merged["plate_mm"] == "180" and merged["city_label"] == ""
    assert got[2][0]["n_reason"] == 5


def test_differences(spark):
    rows = [(1, '{"plate_mm": 180.0, "base_thickness_mm": 3, "schema_version": 2, "regions": {"roads": {"depth_mm": 0.7}}, "labels": [{"text": "A"}, {"text": "B"}], "frame": true}'), (2, "{}"), (3, None)]
    got = sorted((r["path"], r["value"], r["grp"], r["changed_in_group"]) for r in params.params_diff(spark.createDataFrame(rows, "design_id long, body string")).collect())
    assert got == [("labels[].text", "A", "labels", 2), ("labels[].text", "B", "labels", 2), ("regions.roads.depth_mm", "0.7", "regions", 1)]


def test_the_specification_is_whole():
    assert len([1 for _, _, kind, *_ in params.SPEC if kind != "list"]) == 157
