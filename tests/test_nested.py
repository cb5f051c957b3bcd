import json

import pytest

from statloom.operators import nested
from statloom.operators.nested import TablePlan, _decode_deep, _decoder, decode_payload, inline_shared, plan_tables, schema_graph, shred, table_of
from statloom.operators.statute_nodes import statute_nodes

SCHEMA = "id string, payload string, table_name string"  # a column that clashes with one of the operator's


def nodes(spark, *payloads):
    rows = [(f"r{i}", p if isinstance(p, str | None) else json.dumps(p, ensure_ascii=False), "x") for i, p in enumerate(payloads)]
    return {tuple(r) for r in statute_nodes(spark.createDataFrame(rows, SCHEMA), "id", "payload").collect()}


def test_payloads_that_hold_nothing(spark):
    assert nodes(spark, None, "", "   ", "<xml/>", '{"LawSearch": {"law": [{"법령ID": "1"', "12", '"text"', "[1, 2]", "NaN", "{}") == set()
    assert nodes(spark) == set()


def test_search_items_and_their_keys(spark):
    law = [{"법령ID": "070"}, {"법령ID": 71}, {"법령ID": {"content": "072"}}, None, "없음", {"법령ID": "", "법령일련번호": 9}, {"법령ID": None}]
    got = nodes(spark, {"LawSearch": {"law": law}}, {"LawSearch": {"law": {"법령일련번호": "8"}}}, {"law": {"법령ID": "1"}})
    assert got == {
        ("r0", "law", "0", "", "070"), ("r0", "law", "1", "", "71"), ("r0", "law", "2", "", "072"), ("r0", "law", "3", "", "9"), ("r0", "law", "4", "", ""), ("r1", "law", "0", "", "8"),
    }


def test_articles_in_every_shape(spark):
    item = {"항": [{"호": {"목": [{"목내용": "a"}, "-", {"목내용": "b"}]}}, 0, {"호": ""}]}
    unit = {"조문번호": "007", "조문가지번호": "02", **item}
    in_list = {"법령": {"조문": {"조문단위": [None, unit, {"조문번호": {"content": 8}, "조문가지번호": "0"}]}}}
    assert nodes(spark, in_list) == {
        ("r0", "article", "0", "", "7-2"), ("r0", "article", "1", "", "8"),
        ("r0", "paragraph", "0.0", "0", ""), ("r0", "paragraph", "0.1", "0", ""),
        ("r0", "item", "0.0.0", "0.0", ""), ("r0", "subitem", "0.0.0.0", "0.0.0", ""), ("r0", "subitem", "0.0.0.1", "0.0.0", ""),
    }
    for shape in ({"조문": unit}, {"조문": [unit]}, {"조문": {"조문단위": unit}}, {"법령": {"조문": unit}}):
        assert ("r0", "article", "0", "", "7-2") in nodes(spark, shape) and len(nodes(spark, shape)) == 6
    assert nodes(spark, {"조문": {"조문단위": None}}) == set()


@pytest.mark.parametrize("times", [1, 2, 5])
def test_a_payload_counts_however_often_it_is_encoded(spark, times):
    text = {"조문": {"조문번호": "0"}}
    for _ in range(times):
        text = json.dumps(text)
    assert nodes(spark, text, text) == {("r0", "article", "0", "", "0"), ("r1", "article", "0", "", "0")}
    assert decode_payload("﻿" + json.dumps({"a": 1})) == {"a": "1"}
    assert decode_payload("[" * 100_000) is None


def test_tables_follow_from_the_graph(spark):
    payloads = [
        {"a": {"x": 1, "b": [{"y": 1}, {"y": 2, "inner": {"z": 3}}]}, "c": {"shared": {"s": 1}}, "d": {"shared": {"s": 2}}},
        {"tree": {"n": 1, "tree": {"n": 2, "wrapped": {"content": "w"}}}},
    ]
    df = spark.createDataFrame([(str(i), json.dumps(p)) for i, p in enumerate(payloads)], "id string, payload string")
    plan = plan_tables(schema_graph(df, "payload"))
    assert plan.reasons == {"$": "root", "b": "repeated", "shared": "shared", "tree": "recursive"}
    rows = shred(df, "id", "payload", plan)
    b = {tuple(r) for r in table_of(rows, "b", ["y", "inner.z"]).collect()}
    assert b == {("0", "$:0/a:0/b:0", "$", "$:0", "1", None), ("0", "$:0/a:0/b:1", "$", "$:0", "2", "3")}
    tree = {tuple(r) for r in table_of(rows, "tree", ["n", "wrapped"]).collect()}
    assert tree == {("1", "$:0/tree:0", "$", "$:0", "1", None), ("1", "$:0/tree:0/tree:0", "tree", "$:0/tree:0", "2", "w")}
    keys = [r.k for r in rows.selectExpr("node_id as k", "record_id").collect()]
    assert len(keys) == 2 + 2 + 2 + 2
    assert {r.x for r in table_of(rows, "$", ["a.x"]).selectExpr("a_x as x").collect()} == {"1", None}


def rows_of(spark, *payloads, declared=frozenset()):
    df = spark.createDataFrame([(f"r{i}", p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "id string, payload string")
    plan, rows = inline_shared(df, "id", "payload", declared=declared)
    return plan, rows


def test_scalars_in_lists_have_rows(spark):
    plan, rows = rows_of(spark, {"referencedStatuteIds": ["stat_1", None, "-", 7, {"content": "w"}, ["x"]], "keep": [{"k": 1}, "s"]})
    assert plan.reasons == {"$": "root", "keep": "repeated", "keep[]": "repeated", "referencedStatuteIds[]": "repeated"}
    ids = {tuple(r) for r in table_of(rows, "referencedStatuteIds[]", ["content"]).collect()}
    assert ids == {("r0", f"$:0/referencedStatuteIds[]:{i}", "$", "$:0", v) for i, v in ((0, "stat_1"), (2, "-"), (3, "7"), (4, "w"), (5, "x"))}
    assert {r.content for r in table_of(rows, "keep[]", ["content"]).collect()} == {"s"}


def test_dots_in_names_and_elements_the_plan_inlines(spark):
    _, rows = rows_of(spark, {"a.b": 1, "a": {"b": 2}})
    assert dict(rows.collect()[0].attrs) == {r"a\.b": "1", "a.b": "2"}
    # a plan that was made for other payloads loses nothing: what repeats against it gets rows
    df = spark.createDataFrame([("x", '{"a": [{"n": 1}, {"n": 2}]}')], "id string, payload string")
    rows = shred(df, "id", "payload", TablePlan({"$": "root"}))
    assert sorted((r.table_name, dict(r.attrs).get("a.n") or dict(r.attrs).get("n")) for r in rows.collect()) == [("$", "1"), ("a", "2")]


def test_any_depth(spark):
    levels = 50_000
    chain = '{"n": 1, "t": ' * levels + "{}" + "}" * levels
    plan, rows = rows_of(spark, chain, "[" * 30_000 + '{"n": 1}' + "]" * 30_000)
    assert plan.reasons["t"] == "recursive"
    t = table_of(rows, "t", ["n"]).filter("record_id = 'r0'").collect()
    assert len(t) == levels and len({r.node_id for r in t}) == levels
    assert {r.parent_id for r in t} <= {r.node_id for r in t} | {"$:0"}
    assert rows.filter("record_id = 'r1'").count() == 1


@pytest.mark.parametrize("text", ["{}", "[1, -2.5e3, true, null]", '{"a": "b\\n\\u00e9", "c": [[], {}]}', " [ ] ", '"s"', "1"])
def test_the_deep_reader_reads_as_the_other(text):
    assert _decode_deep(text) == _decoder.decode(text)


@pytest.mark.parametrize("text", ["", "[", "]", "[1,]", "{,}", '{"a"}', '{"a":}', "[1 2]", '{"a":1,}', "{]", "[}", "1 2", "[1]]", "{1:2}", "[,1]", "nul", '["a]', '{"a" "b"}'])
def test_the_deep_reader_refuses_what_the_other_does(text):
    for read in (_decode_deep, _decoder.decode):
        with pytest.raises(ValueError):
            read(text)


def test_keys_that_are_data(spark, monkeypatch):
    monkeypatch.setattr(nested, "MAX_EDGES", 3)
    plan, rows = rows_of(spark, {"a": {"x": 1, "b": {"y": 2}}, "c": {"d": {"z": 3}}, "e": [4]})
    assert plan.all_elements
    assert {(r.table_name, r.parent_id) for r in rows.collect()} == {("$", None), ("a", "$:0"), ("b", "$:0/a:0"), ("c", "$:0"), ("d", "$:0/c:0"), ("e[]", "$:0")}


def test_wrapped_nodes_and_wrappers_between_levels(spark):
    got = nodes(spark, {"조문": {"조문번호": 1, "항": [{"content": "only"}, ["no"], {"싸개": {"호": [{"호내용": "a"}]}}]}})
    assert got == {("r0", "article", "0", "", "1"), ("r0", "paragraph", "0.0", "0", ""), ("r0", "paragraph", "0.1", "0", ""), ("r0", "item", "0.1.0.0", "0.1", "")}
