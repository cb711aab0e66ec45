"""Readers, sinks, the strict scan and review forms on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from mosaiq.operators import review, scan
from mosaiq.sources import manifest, schemas, sinks


def put(path, text):
    path.write_text(text)
    return f"file://{path}"


MANIFEST = {
    "records": [{"id": "r1", "sourceId": "s1", "labels": {"head": "uid_digit", "confidence": 0.5}, "dimensions": {"width": 3, "height": 4}}, 7, None, {"id": "r2", "labels": "odd"}],
    "sources": [{"sourceId": "s1", "sourceTags": ["a}", "b{"]}, "junk"],
    "splits": {"train": ["r1", "r2"], "val": ["r2"]},
}


@pytest.mark.parametrize("garbage", ["", '\n}]} trailing {"x": 1}'])
def test_manifest(spark, tmp_path, garbage):
    t = manifest.read_manifest(spark, put(tmp_path / "m.json", json.dumps(MANIFEST) + garbage))
    assert t["meta"].first().splitSeed == 42 and tuple(t["meta"].first().splitRatio) == (0.8, 0.1, 0.1)
    records = {r.id: r for r in t["records"].collect()}
    assert set(records) == {"r1", "r2"} and records["r1"].dimensions.width == 3
    assert [r.sourceTags for r in t["sources"].collect()] == [["a}", "b{"]]
    assert {r.record_id: r.split for r in t["splits"].collect()} == {"r1": "train", "r2": "val"}


def test_broken_manifest_gives_no_rows(spark, tmp_path):
    t = manifest.read_manifest(spark, put(tmp_path / "b.json", "no object"))
    assert all(df.count() == 0 for df in t.values())


def test_small_readers(spark, tmp_path):
    ids = manifest.read_ids(spark, put(tmp_path / "ids.txt", " a \n\n b\n"))
    assert [r.id for r in ids.collect()] == ["a", "b"]
    ocr = [{"id": "r1::left", "text": "UID 1234567890"}, {"id": "r1::left", "text": "0987654321"}, {"id": "r2", "text": None}, {"id": " "}]
    rows = manifest.read_recognition(spark, put(tmp_path / "o.json", json.dumps(ocr))).collect()
    assert sorted(tuple(r) for r in rows) == [("r1", "left", "0987654321", "0987654321"), ("r2", "", "", "")]
    values = manifest.read_cluster_values(spark, put(tmp_path / "v.json", json.dumps({"clusterUidValues": {"1": "12 34 56", "x": "7"}}))).collect()
    assert sorted((r.clusterId or 0, r.uid, r.errors) for r in values) == [(0, "7", "invalid_cluster_id;invalid_uid"), (1, "123456", "")]
    clusters = manifest.read_clusters(spark, put(tmp_path / "c.json", json.dumps({"clusters": [{"clusterId": 1, "memberIds": ["a", "b"]}, {"x": 1}]}))).collect()
    assert [(r.clusterId, r.memberIds) for r in clusters] == [(1, ["a", "b"])]
    sheet = manifest.read_sheet(spark, put(tmp_path / "s.csv", chr(0xFEFF) + 'record_id,notes\nr1,"a ""b"", c"\n'))
    assert sheet.columns[0] == "record_id" and sheet.first().notes == 'a "b", c'
    source = manifest.read_source_list(spark, put(tmp_path / "src.json", json.dumps({"sourceId": "s", "sourceTags": ["x"]})))
    assert source.first().sourceTags == ["x"]


def test_numbers_of_recognition_results_grow_with_the_key(spark, tmp_path):
    """A UID has ten digits; the query's numbers pass that from event 1,136,508 on, and its SQL keeps them whole."""
    from mosaiq.plans.catalogue import QUERIES

    keys = [0, 1136507, 1136508, 5999999, 10**12]
    spark.createDataFrame([(k,) for k in keys], "event_id long").write.parquet(f"file://{tmp_path}/events.parquet")
    found = {r.record_id: r.uid for r in QUERIES["recognition_results"](spark, f"file://{tmp_path}").collect()}
    assert found == {f"e{k}": str(10**9 + k * 7919) for k in keys}
    ocr = put(tmp_path / "long.json", json.dumps([{"id": "a", "text": "UID 12345678901"}, {"id": "b", "text": "1234567890 9"}]))
    assert {r.record_id: r.uid for r in manifest.read_recognition(spark, ocr).collect()} == {"a": "", "b": "1234567890"}


def test_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for k, name in enumerate(("a (2).PNG", "sub/b (1).jpg", "sub/c.txt", "d (9).png")):
        (tmp_path / "in" / name).write_bytes(bytes([k]))
    files = manifest.list_images(spark, f"file://{tmp_path}/in")
    assert files.count() == 3
    assert [r["index"] for r in manifest.ordered_files(files, 1, 5).collect()] == [1, 2]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "<a&'\">", None)], "id int, s string, n int")
    assert sinks.html_rows(df, ["id", "s"], link="s").first().value == "<tr><td>1</td><td><a href=\"&lt;a&amp;&#x27;&quot;&gt;\">&lt;a&amp;&#x27;&quot;&gt;</a></td></tr>"
    assert json.loads(sinks.report_json(df).first().value) == {"id": 1, "s": "<a&'\">"}
    sinks.save_sheet(sinks.sheet(df, {"id": F.col("id"), "n": F.col("n")}), f"file://{tmp_path}/sheet", bom=True)
    back = manifest.read_sheet(spark, f"file://{tmp_path}/sheet")
    assert back.columns == ["id", "n"] and back.first().id == "1"
    assert sinks.markdown({"n": 1, "todo": [], "by": {"a": 2}}) == "- n: 1\n## todo\n- none\n## by\n- a: 2\n"
    sinks.save_table(df, f"file://{tmp_path}/t")
    sinks.save_report(df, f"file://{tmp_path}/r")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 1


def session(spark, **more):
    base = {"sessionId": "s1", "inputLockActive": True, "anchors": dict.fromkeys(scan.ANCHORS, True)} | more
    return spark.createDataFrame([(json.dumps(base),)], "j string").select(F.from_json("j", schemas.SESSION).alias("x")).select("x.*")


SHOWN = {
    "details": "level double, levelCap double, levelConfidence double, mindscape double, mindscapeCap double, mindscapeConfidence double",
    "weapons": "weapon struct<weaponId:string,displayName:string,level:double>, confidence double",
    "discs": f"disc {scan.discs_type()[6:-1]}, confidence double",
}


def captures(spark, kind, rows):
    """rows: (agentId, pageIndex, agentSlotIndex, modelId, modelConfidence, *shown)"""
    return spark.createDataFrame([("s1", k, *r) for k, r in enumerate(rows)], f"{scan.CAPTURE}, {SHOWN[kind]}")


def empties(spark):
    return {
        "uid": spark.createDataFrame([("s1", "1234567890", 0.99)], "sessionId string, uid string, confidence double"),
        "icons": spark.createDataFrame([], "sessionId string, pos int, label string, confidence double, pageIndex int, agentSlotIndex int"),
        "details": captures(spark, "details", []),
        "weapons": captures(spark, "weapons", []),
        "discs": captures(spark, "discs", []),
    }


FULL = {"agentId": "a", "level": 60, "levelCap": 60, "mindscape": 6, "mindscapeCap": 6, "weapon": {"weaponId": "w"}, "discs": [{"slot": 1, "setId": "x"}]}


def test_scan_of_a_full_payload_is_ok(spark):
    r = scan.scan(session(spark, agents=[FULL], region="eu"), **empties(spark)).first()
    assert (r.status, r.code, r.lowConfReasons, r.region_confidence) == ("ok", None, [], 0.97)
    agent = json.loads(r.agents[0])
    assert agent["confidenceByField"] == {"agentId": 0.99, "level": 1.0, "mindscape": 0.98, "weapon": 0.9, "discs": 0.9, "occupancy": 0.76}
    assert agent["discSlotOccupancy"] == {str(k): k == 1 for k in range(1, 7)} and agent["weaponPresent"]


def test_scan_gates_and_partial_results(spark):
    parts = empties(spark)
    assert scan.scan(session(spark, inputLockActive=False), **parts).first().code == "INPUT_LOCK_NOT_ACTIVE"
    assert scan.scan(session(spark, anchors={"profile": True}), **parts).first().code == "ANCHOR_MISMATCH"
    r = scan.scan(session(spark), **parts).first()
    assert r.status == "degraded" and {"agents_missing", "agents_empty_after_parse"} <= set(r.lowConfReasons)


def test_scan_fills_what_the_payload_lacks(spark):
    parts = empties(spark)
    parts["details"] = captures(spark, "details", [("a", None, None, None, None, 50.0, 60.0, 0.9, 1.0, 6.0, 0.9), ("new", None, None, None, None, 1.0, 10.0, 0.5, 0.0, 6.0, 0.4)])
    parts["weapons"] = captures(spark, "weapons", [("a", None, None, None, None, ("w2", "W", 60.0), 0.96)])
    parts["discs"] = captures(spark, "discs", [("b", None, None, None, None, (1, "x", "X", 15.0, 15.0), 0.9)])
    r = scan.scan(session(spark, agents=[{"agentId": "a"}, {"agentId": "a"}, {"agentId": ""}]), **parts).first()
    agents = {x["agentId"]: x for x in map(json.loads, r.agents)}
    assert set(agents) == {"a", "b"} and agents["a"]["weapon"]["weaponId"] == "w2" and agents["a"]["level"] == 50.0
    assert agents["a"]["fieldSources"]["weapon"] == "pixel_weapon" and agents["b"]["discs"][0]["setId"] == "x"
    # Slots of which nothing is known count as empty, which settles missing discs.
    assert not {"a.weapon_missing", "a.level_missing", "a.discs_missing"} & set(r.lowConfReasons)
    assert {"duplicate_agent_id_from_session_payload:a", "agent[2].agentId_missing"} <= set(r.lowConfReasons)


def test_scan_names_captures_by_slot_and_model(spark):
    parts = empties(spark)
    parts["icons"] = spark.createDataFrame([("s1", 0, "a", 0.95, 0, 1), ("s1", 1, "b", 0.95, 0, 2), ("s1", 2, "c", 0.95, None, 3)], "sessionId string, pos int, label string, confidence double, pageIndex int, agentSlotIndex int")
    level = lambda v, c: (v, 60.0, c, None, None, None)
    mind = lambda v, c: (None, None, None, v, 6.0, c)
    parts["details"] = captures(spark, "details", [
        (None, 0, 1, None, None, *level(31.0, 0.80)), (None, 0, 1, None, None, *level(32.0, 0.85)), ("a", None, None, None, None, *level(33.0, 0.99)),
        (None, 0, 2, "a", 0.5, *level(40.0, 0.9)), (None, 0, 2, "b", 0.7, *mind(2.0, 0.55)), (None, 9, 3, None, None, *level(50.0, 0.7)), ("c", None, None, None, None, *level(51.0, 0.8)), (None, 5, 5, None, None, *level(1.0, 0.9)),
    ])
    parts["weapons"] = captures(spark, "weapons", [(None, 0, 1, "b", 0.95, ("w1", None, 1.0), 0.9), (None, 0, 2, None, None, ("w2", None, 1.0), 0.97), ("b", None, None, None, None, ("w3", None, 1.0), 0.5)])
    disc = lambda k, s, c: (None, 0, 1, None, None, (k, s, None, None, None), c)
    parts["discs"] = captures(spark, "discs", [disc(1, "y", 0.3), *(disc(k, "x", 0.8) for k in range(1, 7)), ("c", None, None, None, None, (2, "z", None, None, None), 0.6)])
    payload = [{"agentId": "c", "discs": [{"slot": 1, "setId": "q"}]}]
    r = scan.scan(session(spark, agents=payload).withColumn("lowConfReasons", F.array(F.lit("uid_low_confidence"), F.lit("kept"))), **parts).first()
    agents = {x["agentId"]: x for x in map(json.loads, r.agents)}
    # The slot's surest reading is taken before one that names the agent; that fills in where the slot's isn't sure enough.
    assert agents["a"]["level"] == 32.0 and agents["c"]["level"] == 51.0 and agents["a"]["confidenceByField"]["level"] == 0.85
    # A model that contradicts the slot overrules it only if it is sure.
    assert "level" not in agents["b"] and agents["b"]["mindscape"] == 2.0 and agents["b"]["weapon"]["weaponId"] == "w2" and "weapon" not in agents["a"]
    assert {"detail_agent_unresolved:3", "detail_agent_unresolved:7", "kept"} <= set(r.lowConfReasons) and "uid_low_confidence" not in r.lowConfReasons
    # Six slots of one set are surer than their readings.
    assert [d["setId"] for d in agents["a"]["discs"]] == ["x"] * 6 and agents["a"]["confidenceByField"]["discs"] == 0.92
    assert [(d["slot"], d["setId"]) for d in agents["c"]["discs"]] == [(1, "q"), (2, "z")] and agents["c"]["fieldSources"]["discs"] == "merged_session_payload_and_pixel_discs"
    assert agents["c"]["confidenceByField"]["discs"] == 0.9 and agents["a"]["fieldSources"]["discSlotOccupancy"] == "derived_from_pixel_discs" and all(agents["a"]["discSlotOccupancy"].values())


def test_review_forms(spark):
    df = spark.createDataFrame([('{"hp_pct": "12,5%", "impact": 3}', '[{"slot": 2, "setName": "Blues", "level": 15, "levelCap": 15}, {"slot": 1, "setId": "set_m"}]', '[{"key": "hp_pct", "value": "+3"}]'), ('{"luck": 1}', '[{"slot": 9, "setId": "set_m"}]', "[1]"), ("[]", "x", None), (None, "", "")], "m string, d string, s string")
    names = {"blues": "set_b", "set_m": "set_m"}
    m, d, s = review.stat_map(F.col("m")), review.disc_summary(F.col("d"), names), review.substats(F.col("s"))
    rows = df.select(m.value.alias("m"), d.value.alias("d"), s.value.alias("s"), F.concat_ws(";", *m.errors, *d.errors, *s.errors).alias("e")).collect()
    assert rows[0].m == {"hp_pct": 12.5, "impact": 3.0} and [(x.slot, x.setId) for x in rows[0].d] == [(1, "set_m"), (2, "set_b")] and rows[0].s[0].value == 3.0 and rows[0].e == ""
    assert rows[1].e.split(";")[:2] == ["agent_stats_json_invalid", "equipment_disc_summary_json_invalid"] and "disc_substats_json" in rows[1].e
    assert "agent_stats_json" in rows[2].e and "equipment_disc_summary_json" in rows[2].e
    assert (rows[3].m, rows[3].d, rows[3].s, rows[3].e) == (None, None, None, "")
    records = spark.createDataFrame([("r1",), ("r2",)], "id string")
    reviews = spark.createDataFrame([("r1", ""), ("r2", "bad"), ("r9", ""), (" ", ""), (None, "")], "id string, errors string")
    assert {r.id: r.outcome for r in review.applied(records, reviews, "id").collect()} == {"r1": "applied", "r2": "invalid", "r9": "missing"}


def test_capture_specs(spark):
    rows = spark.createDataFrame([("roster|p.png",), ("a| b |c|1|2|d|3",), ("a",), (None,), ("a|b||x",)], "s string").select(manifest.parse_capture_spec(F.col("s")).alias("c")).collect()
    assert [tuple(r.c) for r in rows] == [("roster", "p.png", None, None, None, None, None, ""), ("a", "b", "c", 1, 2, "d", 3, ""), ("a", None, None, None, None, None, None, "role_and_path_required"), (None, None, None, None, None, None, None, "role_and_path_required"), ("a", "b", None, None, None, None, None, "slotIndex_not_integer")]


def test_scratch_is_cleared(spark, tmp_path, monkeypatch):
    from mosaiq.sources import scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"file://{tmp_path}")
    df = scratch.written(spark.range(3), "x")
    assert df.count() == 3 and scratch.clear(spark) == 1 and scratch.clear(spark) == 0


def test_a_folder_is_made_only_where_none_is_set(spark):
    from mosaiq.sources import scratch

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    assert scratch.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    own = scratch.shared_dir(Session())
    assert own.startswith("file://") and scratch.shared_dir(Session()) == own

    class Cluster:
        conf = Conf()

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Cluster())


def test_discarded_tables_are_gone(spark):
    from mosaiq.sources import scratch

    table = scratch.written(spark.range(3), "gone")
    assert table.count() == 3
    scratch.discard(table)
    path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_sessions_are_prepared_once_and_operators_leave_them_alone(spark):
    from mosaiq.sources import shipping

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        shipping.prepare(spark)
        assert int(spark.conf.get(name).rstrip("b")) == shipping.BATCH_BYTES
        spark.conf.set(name, "1000")
        shipping.prepare(spark)
        assert spark.conf.get(name).rstrip("b") == "1000"
    finally:
        spark.conf.set(name, before)
