"""Records from JSON of any shape."""
import json

from tessera.sources import variant_io as V

LINES = [
    '{"product_id":"a","material_name":"Tile","price_cents":1250,"quality":3,"tags":["x",null]}', '{"product_id":"b","price_cents":"1250","quality":"7"}',
    '{"product_id":"c","price_cents":"12,5","quality":true,"tags":"x"}', '{"product_id":"d","price_cents":null,"tags":[],"Zeta":1,"alpha":{"k":[1,2]},"b c":null}',
    '{"product_id":"e","price_cents":12.5,"quality":99999999999}', '{"product_id":7,"material_name":{"a":1}}',
    '{"product_id":""}', '{"material_name":"x"}', '{"product_id":null}', '{"product_id":"x"', "[1]", '"text"', "12", "null", "", "  \t", None, '{"product_id":"a"} trailing',
]


def test_records_keep_unknown_fields_and_name_ill_typed_ones(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    got = {r["product_id"]: r for r in V.records(df).collect()}
    assert set(got) == {"a", "b", "c", "d", "e", "7"}
    assert (got["a"]["price_cents"], got["a"]["quality"], got["a"]["tags"], got["a"]["extra"], got["a"]["bad_fields"]) == (1250, 3, ["x", None], None, [])
    assert (got["b"]["price_cents"], got["b"]["quality"], got["b"]["tags"], got["b"]["bad_fields"]) == (1250, 7, None, [])
    assert got["c"]["price_cents"] is None and "price_cents" in got["c"]["bad_fields"] and "tags" in got["c"]["bad_fields"]
    assert got["d"]["bad_fields"] == [] and got["d"]["extra_fields"] == ["Zeta", "alpha", "b c"]
    assert json.loads(got["d"]["extra"])["alpha"] == {"k": [1, 2]}
    assert got["e"]["quality"] is None and got["e"]["bad_fields"] == ["quality"]


def test_rejects_have_a_reason_and_no_line_is_lost(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    reasons = {}
    for r in V.rejects(df).collect():
        reasons.setdefault(r["reason"], []).append(r["value"])
    assert {k: len(v) for k, v in reasons.items()} == {"missing_key": 3, "malformed": 2, "not_an_object": 4, "empty": 3}
    assert sum(map(len, reasons.values())) + V.records(df).count() == len(LINES)


def test_drift_counts_what_each_field_holds(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    got = {(r["path"], r["found"]): r["n"] for r in V.drift(df).collect()}
    assert got["price_cents", "number"] == 2 and got["price_cents", "text"] == 2 and got["price_cents", "null"] == 1 and got["tags", "array"] == 2
    assert got["product_id", "missing"] == 1 and got["quality", "boolean"] == 1
    assert sum(n for (p, _), n in got.items() if p == "tags") == 9
    assert V.records(df.where("false")).count() == 0
