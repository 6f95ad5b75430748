import json

import pytest
from pyspark.sql import functions as F

from contrasta.sources import jsonl as J


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    for name, n in (("a.jsonl", 5000), ("b.jsonl", 37)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(1, n + 1)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = sorted((r.file.rsplit("/", 1)[1], r.line, r.text) for r in J.numbered_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == sorted((name, i, f"{name} {i}") for name, n in (("a.jsonl", 5000), ("b.jsonl", 37)) for i in range(1, n + 1))


def test_faults_have_places(spark, tmp_path):
    file = tmp_path / "rows.jsonl"
    file.write_text('{"id": 1, "name": "x"}\n\n{"id": 2, "name": " "}\nnot json\n{"name": "y"}\n[1]\n{"id": "text", "name": "z"}\n{"id": 5, "name": "w", "more": 1}\n')
    lines = J.read_jsonl(spark, str(file), "id long, name string", ("id", "name"))
    assert [(r.line, r.id, r.name) for r in lines.rows.orderBy("line").collect()] == [(1, 1, "x"), (8, 5, "w")]
    assert {(r.line, r.reason, r.field) for r in lines.faults.collect()} == {(3, J.MISSING, "name"), (4, J.BAD_JSON, None), (5, J.MISSING, "id"), (6, J.BAD_JSON, None), (7, J.BAD_JSON, None)}
    with pytest.raises(ValueError, match="rows.jsonl:3 MISSING_FIELD name"):
        lines.strict()
    assert J.read_jsonl(spark, str(file), "name string").rows.count() >= 4
    with pytest.raises(ValueError):
        J.read_jsonl(spark, str(file), "id long", ("name",))


def test_round_trip_and_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä\n\"", [1.5, None], None), (2, None, [], "x"), (2, None, [], "x")], "b int, a string, c array<double>, d string")
    path = str(tmp_path / "table")
    manifest = J.write_jsonl(df, path, 1)
    assert manifest["rows"] == 3 and list(manifest["fields"]) == ["a", "b", "c", "d"]
    back = J.load_jsonl(spark, path)
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert J.write_jsonl(df.orderBy(F.desc("b")), str(tmp_path / "again"))["digest"] == manifest["digest"]
    first = next((tmp_path / "table" / "data").glob("part-*"))
    row = json.loads(first.read_text())
    (first.parent / f".{first.name}.crc").unlink(missing_ok=True)
    first.write_text(json.dumps(row | {"b": 9}) + "\n")
    with pytest.raises(ValueError, match="digest"):
        J.load_jsonl(spark, path)
