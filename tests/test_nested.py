import json

from tessella.operators.nested import ARRAY_FIELDS, Node, flatten, laid_out, merged, observed, outer_object, shapes, snake

SCHEMA = "tmpid string, payload string, created_at timestamp"


def test_outer_object():
    x = {"a": {"b": [1]}}
    s = json.dumps(x)
    assert outer_object(s) == x == outer_object(f"Here:\n```json\n{s}\n```") == outer_object(json.dumps(s)) == outer_object(f"use {{this}} form: {s} done")
    assert outer_object(s[:-2]) is None and outer_object(None) is None and outer_object("") is None and outer_object("no json") is None
    assert outer_object('{"a": {"parties": [{"x": 1}]}, "b": "cut of') is None


def test_names():
    assert [snake(k) for k in ("rightsGrants", "rights_grants", "RightsGrants", "pageStart", "ID")] == ["rights_grants", "rights_grants", "rights_grants", "page_start", "id"]


def test_layout():
    root = Node()
    value = observed({"parties": {"role": "A"}, "evidence": [1, {"targets": None}, None], "pageStart": None, "page_start": 2}, root)
    assert laid_out(value, merged(set(shapes(root)), ARRAY_FIELDS)) == {"parties": [{"role": "A"}], "evidence": [None, {}, None], "evidence_value": '{"0": 1}', "page_start": "2"}


def flat(spark, *docs):
    df = spark.createDataFrame([(str(i), d if isinstance(d, str) else json.dumps(d), None) for i, d in enumerate(docs)], SCHEMA)
    return flatten(df, "tmpid", "payload", "created_at")


def test_two_places_with_one_path_have_keys_of_their_own(spark):
    f = flat(spark, {"raw": {"evidence": [{"q": 1, "targets": [{"t": 1}]}]}, "normalized": {"evidence": [{"q": 2, "targets": [{"t": 2}]}]}})
    assert sorted(r.child_path for r in f.links().collect()) == ["evidence[0]", "evidence[0]/targets[0]"]
    evidence, targets = {r.row_key: r.q for r in f.table("evidence").collect()}, f.table("targets").collect()
    assert sorted(evidence.values()) == ["1", "2"] and {r.t: evidence[r.parent_key] for r in targets} == {"1": "1", "2": "2"}


def test_arrays_are_inferred_from_the_records(spark):
    f = flat(spark, {"licences": {"n": 1}}, {"licences": [{"n": 2}, "odd", {"n": 3, "이름": {"값": 4}}]}, {"licences": 7})
    rows = {(r.record_id, r.ordinal): (r.n, r["이름_값"]) for r in f.table("licences").collect()}
    assert rows == {("0", 0): ("1", None), ("1", 0): ("2", None), ("1", 2): ("3", "4")}
    assert {r.record_id: r.rec.licences_value for r in f.typed.collect()} == {"0": None, "1": '{"1": "odd"}', "2": '{"0": 7}'}


def test_one_odd_record_hides_nothing_of_the_others(spark):
    good = {"raw": {"contract": {"parties": [{"name": "x"}]}}}
    f = flat(spark, good, {"raw": "text"}, {"raw": [1, 2]}, {"raw": {"contract": 5}})
    assert [(r.record_id, r.name) for r in f.table("parties").collect()] == [("0", "x")]
    assert {r.record_id: r.rec.raw_value for r in f.typed.collect()} == {"0": None, "1": "text", "2": "[1, 2]", "3": None}


def test_json_wrapped_in_strings_six_deep(spark):
    s = json.dumps({"parties": [{"a": "b"}]})
    for _ in range(6):
        s = json.dumps(s)
    assert flat(spark, s, "[" * 5000 + "{", '{"a":' * 3000 + "1" + "}" * 3000).links().count() == 1


def test_every_parent_key_meets_one_row(spark):
    at = "/root/testdata/sf0.001/extract_result.parquet"
    f = flatten(spark.read.parquet(at), "tmpid", "payload", "created_at")
    rows = f.tables().collect()
    keys = [r.row_key for r in rows]
    roots = {r.k for r in f.typed.selectExpr("md5(concat_ws('\u0001', record_id, '$')) AS k").collect()}
    assert rows and len(keys) == len(set(keys)) and all(r.parent_key in roots or r.parent_key in set(keys) for r in rows)


def test_tables(spark):
    doc = {"raw": {"contract": {"rightsGrants": [{"content": {"subjects": {"title": "x", "rowKey": "clash"}}, "ordinal": 7}, "odd", {"scope_modifiers": [{"exceptions": [{"windows": [{"days": 1}, {"days": 2}]}]}]}]}}, "chunks": []}
    rows = [("a", json.dumps(doc), "2024-01-02 00:00:00"), ("a", '{"parties":[{"role":"old"}]}', "2024-01-01 00:00:00"), ("b", None, "2024-01-01 00:00:00"), ("c", '{"parties": [{"ro', "2024-01-01 00:00:00"), (None, "{}", None)]
    df = spark.createDataFrame(rows, "tmpid string, payload string, created string").selectExpr("tmpid", "payload", "cast(created AS timestamp) AS created_at", "1 AS rec", "2 AS record_id")
    flat = flatten(df, "tmpid", "payload", "created_at")
    links = sorted((r.record_id, r.parent_path, r.child_path) for r in flat.links().collect())
    g, m = "rights_grants[0]", "rights_grants[2]/scope_modifiers[0]"
    assert links == sorted([("a", "$", g), ("a", "$", "rights_grants[2]"), ("a", g, f"{g}/subjects[0]"), ("a", "rights_grants[2]", m), ("a", m, f"{m}/exceptions[0]"), ("a", f"{m}/exceptions[0]", f"{m}/exceptions[0]/windows[0]"), ("a", f"{m}/exceptions[0]", f"{m}/exceptions[0]/windows[1]")])
    grants = {r.child_path: r for r in flat.table("rights_grants").collect()}
    subjects = flat.table("subjects").collect()
    assert subjects[0].title == "x" and subjects[0].parent_key == grants[g].row_key and grants[g].f_ordinal == "7"


def test_odd_shapes(spark):
    docs = ['{"parties": [{}], "x": {}, "order by": 1, "1st": {"a-b": 2}, "chunks": [[{"y": 1}]]}', '{"parties": [{"refs": [{"a": 1}, null]}], "x": [], "void": null}', "[]", "{}", '"{}"', '{"notes": [{"k": {"issues": {"z": []}}}]}']
    df = spark.createDataFrame([(str(i), d, None) for i, d in enumerate(docs)], SCHEMA)
    flat = flatten(df, "tmpid", "payload", "created_at")
    got = {(r.record_id, r.child_path) for r in flat.links().collect()}
    assert got == {("0", "parties[0]"), ("1", "parties[0]"), ("1", "parties[0]/refs[0]"), ("5", "notes[0]/issues[0]")}


def test_empty(spark):
    assert flatten(spark.createDataFrame([], SCHEMA), "tmpid", "payload", "created_at").links().count() == 0


def walk(record_id, value, path, out):
    """Every object in a named array, by plain recursion."""
    from tessella.operators.nested import ARRAY_FIELDS

    if not isinstance(value, dict):
        return
    for k, v in value.items():
        k = snake(k)
        if k in ARRAY_FIELDS:
            for i, x in enumerate(v if isinstance(v, list) else [v]):
                if isinstance(x, dict):
                    child = f"{k}[{i}]" if path == "$" else f"{path}/{k}[{i}]"
                    out.add((record_id, path, child))
                    walk(record_id, x, child, out)
        else:
            walk(record_id, v, path, out)


def test_against_a_recursive_walk(spark):
    import duckdb

    at = "/root/testdata/sf0.01/extract_result.parquet"
    want: set = set()
    for i, p in duckdb.sql(f"SELECT tmpid, max_by(coalesce(payload, ''), created_at) FROM '{at}' GROUP BY 1").fetchall():
        walk(i, outer_object(p), "$", want)
    got = [tuple(r) for r in flatten(spark.read.parquet(at), "tmpid", "payload", "created_at").links().collect()]
    assert len(got) == len(set(got)) and set(got) == want
