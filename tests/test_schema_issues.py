"""Schema findings and the boxes of a pyramid, against plain Python."""

import random
from collections import defaultdict

import pytest

from tesselon.operators import general, reports

LAYERS = [("roads", 3, "line"), ("places", 0, "point"), ("water", 0, None)]
RULES = [
    ("roads", "kind", "String", True, ["path", "street"], None),
    ("roads", "lanes", "Number", False, None, None),
    ("places", "kind", "String", True, ["city"], "hint"),
    ("places", "open", "Boolean", False, None, None),
]
FEATURES = "z bigint, x bigint, y bigint, layer string, props map<string,string>, geometry string"


def tables(spark):
    layers = spark.createDataFrame(LAYERS, "layer string, minzoom int, geometry string")
    rules = spark.createDataFrame(RULES, "layer string, attribute string, type string, required boolean, enum array<string>, enum_severity string")
    return layers, rules


def expected(rows):
    """{(severity, rule, layer, attribute): (occurrences, first tile)} by a walk over the features."""
    layers, rules = {a: (b, c) for a, b, c in LAYERS}, {(a, b): c for a, b, *c in RULES}
    found, tiles = defaultdict(list), defaultdict(set)
    for *tile, layer, props, geometry in rows:
        tile = tuple(tile)
        if layer not in layers:
            tiles["warn", "unknown_layer", layer, None].add(tile)
            continue
        minzoom, wanted = layers[layer]
        if tile[0] < minzoom:
            tiles["warn", "below_minzoom", layer, None].add(tile)
        if geometry and wanted and geometry != wanted:
            found["error", "wrong_geometry", layer, None].append(tile)
        props = {k: v for k, v in (props or {}).items() if v not in (None, "null")}
        for (of, name), (_, required, _, _) in rules.items():
            if of == layer and required and name not in props:
                found["error", "missing_required", layer, name].append(tile)
        for k, v in props.items():
            if (layer, k) not in rules:
                if k != "name" and not k.startswith(("name_", "name:")):
                    found["warn", "unknown_attribute", layer, k].append(tile)
                continue
            kind, _, enum, severity = rules[layer, k]
            got = "String" if v.startswith('"') else "Boolean" if v in ("true", "false") else "Number"
            if got != kind:
                found["error", "wrong_type", layer, k].append(tile)
            elif enum is not None and v.strip('"') not in enum:
                found[severity or "warn", "bad_enum_value", layer, k].append(tile)
    return {k: (len(v), min(v)) for k, v in [*found.items(), *tiles.items()]}


def listed(issues):
    return {(r.severity, r.rule, r.layer, r.attribute): (r.occurrences, (r.first_z, r.first_x, r.first_y)) for r in issues.collect()}


def test_findings_against_a_walk(spark):
    rng = random.Random(4)
    values = ['"path"', '"city"', '"lake"', "3", "2.5", "true", "null", None]
    rows = []
    for _ in range(400):
        props = {k: rng.choice(values) for k in rng.sample(["kind", "lanes", "open", "name", "name_de", "name:fr", "names", "other"], rng.randint(0, 6))}
        rows.append((rng.randint(2, 4), rng.randint(0, 3), rng.randint(0, 3), rng.choice(["roads", "places", "water", "else"]), props or rng.choice([{}, None]), rng.choice(["line", "point", None])))
    layers, rules = tables(spark)
    features = spark.createDataFrame(rows, FEATURES)
    want = expected(rows)
    assert listed(reports.schema_issues(features, layers, rules)) == want
    assert listed(reports.schema_issues(features, layers, rules, "warn")) == {k: v for k, v in want.items() if k[0] != "hint"}
    issues = reports.schema_issues(features, layers, rules)
    assert reports.failing(issues) == sum(n for k, (n, _) in want.items() if k[0] == "error") > 0
    assert reports.failing(issues, "hint") == sum(n for n, _ in want.values())
    with pytest.raises(ValueError):
        reports.schema_issues(features, layers, rules, "fatal")


def test_findings_of_odd_tables(spark):
    layers, rules = tables(spark)
    none = spark.createDataFrame([], FEATURES)
    assert listed(reports.schema_issues(none, layers, rules)) == {} and reports.failing(reports.schema_issues(none, layers, rules)) == 0
    plain = spark.createDataFrame([(5, 1, 1, "water", {"depth": "3"}, "mine"), (5, 1, 1, None, None, "mine")], FEATURES.replace("geometry", "_rules"))
    got = listed(reports.schema_issues(plain, layers.drop("geometry"), rules.drop("enum", "enum_severity")))
    assert got == {("warn", "unknown_attribute", "water", "depth"): (1, (5, 1, 1)), ("warn", "unknown_layer", None, None): (1, (5, 1, 1))}


def test_center_and_touching_box(spark):
    tiles = lambda *keys: general.center_and_touching_bbox(spark.createDataFrame(list(keys), "z bigint, x bigint, y bigint")).collect()
    (one,) = tiles((2, 2, 1))  # one tile at every level: its own bounds
    assert (one.west, one.east, one.center_lon, one.center_zoom) == (0, 90, 45, 2) and one.south == pytest.approx(0) and one.north == pytest.approx(66.51326)
    (wide,) = tiles(*[(z, x, 0) for z, w in ((1, 2), (2, 4), (5, 8)) for x in range(w)], (5, 0, 9))
    assert (wide.center_zoom, wide.center_lon) == (3, -135)
    # West: the inner edge 1/32 less 1/64; east: the inner edge of level 2, 3/4, and 1/64.
    assert (wide.west, wide.east) == (360 / 64 - 180, 0.75 * 360 - 180 + 360 / 64)
    assert tiles() == []
