"""YAML and JSON trees, and the asset manifests of a small module."""

import json

from textloom.functions import trees as T
from textloom.operators import manifests as M

YAML = """# head
id: hero   # the id
"quoted key": 'it: is'
scene:
  id: demo-scene
  files:
    - ../raw/a.json
    - {source: ../raw/b.png, "more": [c.png, 'd e.png', {font: "http://x/f.ttf"}]}
  - odd: 1
fonts: [a.ttf, b.ttf]
list:
- name: one
  font: two.ttf
- - nested
  - key: deep
    other: deeper
note: |
  font: no key here
    # text
after: ~
image: last.png
"""


def scalars(text):
    return [("/".join(k), v) for k, v, entry in T.rows_of(text) if not entry]


def test_yaml_rows():
    assert scalars(YAML) == [
        ("id", "hero"), ("quoted key", "it: is"), ("scene/id", "demo-scene"), ("scene/files", "../raw/a.json"), ("scene/files/source", "../raw/b.png"), ("scene/files/more", "c.png"),
        ("scene/files/more", "d e.png"), ("scene/files/more/font", "http://x/f.ttf"), ("scene/files/odd", "1"), ("fonts", "a.ttf"), ("fonts", "b.ttf"), ("list/name", "one"), ("list/font", "two.ttf"),
        ("list", "nested"), ("list/key", "deep"), ("list/other", "deeper"), ("note", "font: no key here\n# text"), ("image", "last.png"),
    ]


def test_json_and_broken_texts():
    tree = {"a": [{"b": 1, "c": None}, [True, "x"]], "d": {"e": {"f": 2.5}}}
    assert sorted(scalars(json.dumps(tree))) == [("a", "true"), ("a", "x"), ("a/b", "1"), ("d/e/f", "2.5")]
    assert scalars("") == [] and scalars("---\n...\n") == [] and scalars("just words") == [("", "just words")]
    assert scalars('{"a": 1, "b": "two"') == [("a", "1"), ("b", "two")]
    deep = "[" * 3000 + "1" + "]" * 3000
    assert scalars("x: " + deep) == [("x", "1")]
    assert scalars("a:\n" + "".join(f"{'  ' * k}k{k}:\n" for k in range(1, 50)) + "  " * 50 + "v")[0][0].endswith("k48/k49")


def test_fields_of_texts(spark):
    files = spark.createDataFrame([("m", YAML), ("n", None), ("e", "")], "path string, text string")
    found = T.nodes(files)
    assert sorted((r.field, r.value) for r in T.field_values(found, ("scene", "font")).collect()) == sorted(
        [("scene", v) for v in ("demo-scene", "../raw/a.json", "../raw/b.png", "c.png", "d e.png", "http://x/f.ttf", "1")] + [("font", "http://x/f.ttf"), ("font", "two.ttf")]
    )
    assert {(r.path, r.field): r.n for r in T.field_counts(found, ("font", "id")).collect()} == {("m", "font"): 2, ("m", "id"): 2}


def test_assets_of_a_module(spark):
    module = "mods/test-mod"
    manifests = spark.createDataFrame([
        (f"{module}/defs/assets.yml", "id: hero\nspritesheet: ../raw/images/hero.png\nscene:\n  id: demo-scene\n  files:\n    - ../raw/scenes/start.scene.json\n"),
        (f"{module}/defs/duplicate.yml", "id: hero\nfont: ../raw/fonts/main.ttf\nimage: ../raw/images/missing.png\n"),
    ], "path string, text string")
    raw = spark.createDataFrame([(f"{module}/raw/{x}",) for x in ("images/hero.png", "fonts/main.ttf", "images/unused.png")], "path string")
    assert {r.field: r.n for r in M.asset_counts(manifests).collect()} == {"spritesheet": 1, "font": 1, "scene": 1}
    assert {(r.finding, r.value) for r in M.asset_check(manifests, raw).collect()} == {
        ("missing source", f"{module}/raw/images/missing.png"), ("missing source", f"{module}/raw/scenes/start.scene.json"), ("duplicate id", "hero"), ("unused raw", f"{module}/raw/images/unused.png"),
    }
