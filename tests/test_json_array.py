"""JSON arrays cut into objects at any block size."""

import json
import random

import pytest

from catloom.sources import files
from catloom.sources.json_array import read_json_array, scan
from catloom.sources.schemas import ITEM

SCHEMA = "id int, text string, deep struct<a:array<struct<b:string>>, m:string>"
NASTY = ["", "}", "{", '"', "\\", '\\"', "}{", "a } b { c", '\\\\"}', "[{]}", "é\n漢", "x" * 300, '","id":9}']


def objects(n, seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(NASTY) for _ in range(rng.randrange(4)))
    return [{"id": i, "text": text(), "deep": {"a": [{"b": text()} for _ in range(rng.randrange(3))], "m": text()}} for i in range(n)]


def read(spark, path):
    rows = read_json_array(spark, path, SCHEMA).orderBy("_path", "_block", "_at").collect()
    return [{"id": r["id"], "text": r["text"], "deep": r["deep"].asDict(recursive=True)} for r in rows]


def test_scan():
    assert scan('[ {"a": "x{', False, 0) == (True, 1, 2)
    assert scan('y" ', True, 1) == (False, 1, None)
    assert scan('{"a\\"{": {', False, 0) == (False, 2, 0)


@pytest.mark.parametrize("block", [97, 1000, 1 << 20])
@pytest.mark.parametrize("shape", ["compact", "indented", "lines"])
def test_blocks_of_any_size(spark, tmp_path, block, shape):
    rows = objects(40, block)
    path = tmp_path / "feed.json"
    whole = {"compact": json.dumps(rows), "indented": json.dumps(rows, indent=2, ensure_ascii=False), "lines": "\n".join(map(json.dumps, rows))}[shape]
    path.write_text(whole, encoding="utf-8")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key in old:
            spark.conf.set(key, block)
        assert read(spark, str(path)) == rows
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_odd_files(spark, tmp_path):
    for name, content in (("empty", ""), ("none", "[]"), ("blank", " [ ] \n"), ("one", '{"id": 1, "text": "t", "deep": {"a": [], "m": ""}}'), ("mixed", '[null, 3, {"id": 2, "deep": {}}, "}"]')):
        (tmp_path / f"{name}.json").write_text(content)
    got = {r["_path"].rsplit("/", 1)[1]: r["id"] for r in read_json_array(spark, str(tmp_path), SCHEMA).collect()}
    assert got == {"one.json": 1, "mixed.json": 2}


def test_same_rows_and_order_as_one_task(spark, tmp_path):
    (tmp_path / "wiki").mkdir()
    rows = [{"name": f"Model {i} }}", "year_introduced": 1900 + i, "images": [{"url": f"u{i}{{"}]} for i in range(60)]
    (tmp_path / "wiki" / "cameras.json").write_text(json.dumps(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
    try:
        got = files.read_source_records(spark, str(tmp_path), ["none", "wiki"], "cameras").orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    one = spark.read.schema(ITEM).option("multiLine", True).json(str(tmp_path / "wiki" / "cameras.json")).collect()
    assert [r.name for r in got] == [r.name for r in one] == [r["name"] for r in rows]
    assert [r.seq for r in got] == [(1 << 56) + i for i in range(60)] and [r.images for r in got] == [r.images for r in one]
