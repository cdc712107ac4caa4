import json
import random

from tessella.operators import changes

SCHEMA = "id long, table_name string, row_id long, op string, row_image string"


def brute(rows):
    seen, state = set(), {}
    for i, t, r, op, image in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[4] is not None, x[4] or "")):
        op = (op or "").strip().upper()
        t = (t or "").lower().replace('"', "").strip().split(".")[-1]
        if r is None or op not in ("I", "U", "D") or i in seen:
            continue
        seen.add(i)
        k = (t, r)
        if op == "I":
            state[k] = (i, json.loads(image or "{}"))
        elif op == "D":
            state.pop(k, None)
        elif k in state:
            state[k] = (i, state[k][1] | json.loads(image or "{}"))
    return {k: v for k, v in state.items()}


def test_against_a_replay_in_order(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(1500):
        op = rnd.choice(["I", "I", "U", "U", "u ", "D", "?", None])
        image = None if op in ("D", None) else json.dumps({rnd.choice("abc"): rnd.choice([1, None, "x", [1], {"k/~": 2}]), "n": i})
        row = (i, rnd.choice(["t", "T", "public.t", '"t"', " u"]), rnd.choice([*range(40), None]), op, image)
        rows += [row] * rnd.choice([1, 1, 2])
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 AS slot", "2 AS seq", "3 AS val")
    got = {(r.table_name, r.row_id): (r.id, json.loads(r.row_image)) for r in changes.final_state(df).collect()}
    assert got == brute(rows)


def test_publish_replaces_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    one = spark.createDataFrame([(1, "t", 1, "I", '{"a":1}')], SCHEMA)
    two = spark.createDataFrame([(1, "t", 1, "I", '{"a":1}'), (2, "t", 1, "D", None), (3, "t", 2, "I", None)], SCHEMA)
    assert [r.row_id for r in changes.publish(one, path).collect()] == [1]
    assert [r.row_id for r in changes.publish(two, path).collect()] == [2]


def test_empty_and_void(spark):
    assert changes.final_state(spark.createDataFrame([], SCHEMA)).count() == 0
    void = [(1, "t", 1, "U", None), (2, None, 1, "I", None), (3, "t", None, "I", None), (None, "t", 1, "I", None), (4, "t", 9, "I", "not json")]
    assert [(r.row_id, r.row_image) for r in changes.final_state(spark.createDataFrame(void, SCHEMA)).collect()] == [(9, "{}")]


def test_readers_during_publications(spark, tmp_path):
    """A reader that looks all the time always sees one whole version."""
    import threading

    path, stop, seen, failed = f"file://{tmp_path}/live", threading.Event(), set(), []
    feed = lambda n: spark.createDataFrame([(i, "t", i % 50, "I", json.dumps({"n": n})) for i in range(n * 100, n * 100 + 50)], SCHEMA)
    changes.publish(feed(0), path, 2)

    def read():
        while not stop.is_set():
            try:
                rows = changes.published(spark, path).collect()
                seen.add((len(rows), len({r.row_image for r in rows})))
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    t = threading.Thread(target=read)
    t.start()
    for n in range(1, 6):
        changes.publish(feed(n), path, 2)
    stop.set()
    t.join()
    assert not failed and seen == {(50, 1)}
    assert {r.row_image for r in changes.published(spark, path).collect()} == {'{"n":5}'} and len(changes._pointers(spark, path)) == changes.VERSIONS_KEPT


def test_buckets_follow_the_slots(spark, monkeypatch):
    monkeypatch.setattr(changes, "BUCKET_SLOTS", 10)
    df = spark.createDataFrame([(i, "t", i, "I", '{"a":1,"b":2}') for i in range(100)] + [(200 + i, "t", i, "D", None) for i in range(10)], SCHEMA)
    assert changes.buckets_for(changes.valid_changes(df)) == 31 and changes.final_state(df).count() == 90


def test_a_task_of_many_batches(monkeypatch):
    """A task hands its slots on whenever it holds too many; together they are the slots of all its rows."""
    import pyarrow as pa

    rows = [("t", i % 300, i, "I" if i % 3 else "U", json.dumps({"a": i})) for i in range(2000)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("table_name", "row_id", "seq", "op", "image"), r, strict=True)) for r in rows[a : a + 100]]) for a in range(0, 2000, 100)]
    best = lambda parts: {k: max(v) for k, v in _by_slot(parts).items()}
    whole = best(changes._fold(iter(batches)))
    monkeypatch.setattr(changes, "FLUSH_SLOTS", 250)
    parts = list(changes._fold(iter(batches)))
    assert best(parts) == whole and sum(b.num_rows for b in parts) > len(whole)


def _by_slot(parts):
    out = {}
    for b in parts:
        for r in b.to_pylist():
            out.setdefault((r["table_name"], r["row_id"], r["slot"]), []).append((r["seq"], r["op"], r["val"]))
    return out
