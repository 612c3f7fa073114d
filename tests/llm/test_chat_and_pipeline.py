"""Tool-call linking, the pipeline, the registered queries."""

from __future__ import annotations

import json
import random

import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from tests.compare import differences, duck
from tests.llm.test_text_operators import contaminated, near_groups, repeats
from tradewinds.llm.chat_format import SAY, Parameter, _levels, calls_of_conversations, link_tool_calls, with_messages
from tradewinds.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
CALL = "conv_id string, turn long, call_id string, name string, arguments string, after array<string>, json string"
RESULT = "conv_id string, turn long, call_id string, content string, place int"
ADD = {"add": {"x": Parameter("integer", True, 0, 9), "note": Parameter("string", False, 1, 5)}}


def linked(make, calls, results, schemas=ADD):
    got = link_tool_calls(make([(*c, "?") for c in calls], CALL), make([(*r, 1) for r in results], RESULT), schemas)
    return {(r.conv_id, r.call_id): r for r in got.collect()}


def test_links_and_statuses(make):
    calls = [
        ("c", 1, "a", "add", '{"x": 1}', []),
        ("c", 1, "b", "add", '{"x": 2}', ["a"]),
        ("c", 3, "d", "add", '{"x": 3}', None),
        ("c", 3, "d", "add", '{"x": 3}', None),
        ("c", 3, "e", "add", '{"x": 4}', None),
        ("c", 3, "e", "add", '{"x": 5}', None),
        (None, 3, "f", "add", "{}", None),
        ("c", None, "g", "add", '{"x": 6}', ["zz"]),
    ]
    results = [("c", 2, "a", "one"), ("c", 2, "z", None), ("c", 4, "d", "1"), ("c", 4, "d", "2"), ("k", 4, None, "2")]
    got = linked(make, calls, results)
    assert {k[1]: (r.kind, r.turn, r.status, r.valid) for k, r in got.items()} == {
        "a": ("call", 1, "answered", True),
        "b": ("call", 1, "unanswered", True),
        "d": ("call", 3, "answered twice", True),
        "e": ("call", 3, "unanswered twice", True),
        "g": ("call", -1, "unanswered", False),
        "z": ("result", 2, "orphan", False),
    }
    assert json.loads(got["c", "d"].json)["content"] == "1" and '"x":4' in got["c", "e"].json


def test_topological_order(make):
    chain = [("c", 1, f"n{k:02}", "add", '{"x": 1}', [f"n{k + 1:02}"] if k < 7 else []) for k in range(8)]
    circle = [("c", 1, "u", "add", '{"x": 1}', ["v"]), ("c", 1, "v", "add", '{"x": 1}', ["u"]), ("c", 1, "w", "add", '{"x": 1}', ["q", "n00"])]
    later = [("c", 2, "q", "add", '{"x": 1}', ["n00", "n07", "n07"])]
    got = linked(make, chain + circle + later, [])
    assert [got["c", f"n{k:02}"].place for k in range(8)] == [8, 7, 6, 5, 4, 3, 2, 1]
    assert {k for k in "uvw" if not got["c", k].valid} == set("uvw") and got["c", "q"].valid
    assert sorted(got["c", k].place for k in "uvw") == [9, 10, 11]


def levels_by_hand(calls):
    """Levels of the calls of one turn: above all they wait for; none in or behind a circle or a missing call."""
    waits, level = {c[2]: set(c[5]) for c in calls}, {}
    while new := {c: 1 + max((level[d] for d in w), default=-1) for c, w in waits.items() if c not in level and all(d in level for d in w)}:
        level |= new
    return level


def test_levels_of_random_graphs(make):
    draw = random.Random(5)
    calls = []
    for conv in range(12):
        ids = [f"k{conv}-{i}" for i in range(25)]
        for i, call in enumerate(ids):
            reach = ids if draw.random() < 0.02 else ids[:i]
            calls.append((f"c{conv}", 1, call, "add", '{"x": 1}', draw.sample([*reach, *(["gone"] if draw.random() < 0.03 else [])], k=min(len(reach), draw.randint(0, 3)))))
    want = {}
    for conv in range(12):
        want |= levels_by_hand([c for c in calls if c[0] == f"c{conv}"])
    got = {r.call_id: r._level for r in _levels(make([(*c, "?") for c in calls], CALL)).collect()}
    assert got == want and 100 < len(got) < 300 and max(got.values()) > 5


def test_calls_meet_results_in_hash_joins(spark, make):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = link_tool_calls(make([("c", 1, "a", "add", '{"x": 1}', [], "?")], CALL), make([("c", 2, "a", "one", 1)], RESULT), ADD)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plan.count("ShuffledHashJoin") >= 2 and "SortMergeJoin" not in plan and "Python" not in plan


@pytest.mark.parametrize(
    ("name", "arguments", "errors"),
    [
        ("add", '{"x": 3, "note": "abc"}', []),
        ("add", '{"note": "abcdefg"}', ["note: above 5", "x: missing"]),
        ("add", '{"x": "3", "y": null}', ["x: not integer", "y: unknown"]),
        ("add", '{"x": 12}', ["x: above 9"]),
        ("add", '{"x": -1, "note": ""}', ["note: below 1", "x: below 0"]),
        ("add", "[1]", ["arguments: no JSON object"]),
        ("add", "{x", ["arguments: no JSON object"]),
        ("add", None, ["arguments: no JSON object"]),
        ("sub", "{}", ["tool: unknown"]),
        (None, "{}", ["tool: unknown"]),
    ],
)
def test_argument_errors(make, name, arguments, errors):
    got = linked(make, [("c", 1, "a", name, arguments, [])], [])
    assert got["c", "a"].errors == errors and got["c", "a"].valid == (not errors)


def test_canonical_json(make):
    got = linked(make, [("c", 1, "a", "add", '{ "z": [1, {"b": "é\\n", "a": null}],  "x" : 1 }', [])], [("c", 2, "a", 'say "hi"')])
    text = got["c", "a"].json
    assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert link_tool_calls(make([], CALL), make([], RESULT), ADD).count() == 0


def test_every_turn_has_its_row(make):
    rows = [
        (1, 0, "system", "Be brief"), (1, 1, "user", "a\nb"), (1, 1, "user", "other"), (1, 1, "user", "other"), (1, 2, "assistant", "x"),
        (1, 2, "tool", "t"), (1, 3, "User", "c"), (1, 4, None, "d"), (1, None, "user", "e"), (1, 5, "user", None), (None, 6, "user", "f"),
    ]
    turns = make(rows, "conv_id long, turn long, role string, text string")
    got = with_messages(turns, link_tool_calls(*calls_of_conversations(turns), SAY)).collect()
    said = sorted((r.conv_id or "", r.turn, json.loads(r.json).get("role") or "", json.loads(r.json).get("content") or "") for r in got if r.kind == "message")
    assert said == sorted((str(c or ""), -1 if t is None else t, r or "", x or "") for c, t, r, x in rows)
    assert sorted(json.loads(r.json)["arguments"]["text"] for r in got if r.kind == "call") == ["a", "b", "other"]
    assert [(r.kind, r.place) for r in sorted(got, key=lambda r: (r.conv_id or "", r.turn, r.place)) if (r.conv_id, r.turn) == ("1", 1)] == [
        *(("message", p) for p in (1, 2, 3)), *(("call", p) for p in (4, 5, 6)),
    ]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    _, found = differences(QUERIES[name](spark, FOLDER), duck(FOLDER), ORACLES[name])
    assert not found


def test_pipeline_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())

    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == [g[0] for g in near_groups(rows, 5, 80) if g[3]]

    cut = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeated_passages(spark, docs, FOLDER).collect()}
    for (k, _, removed, text), (_, whole) in zip(repeats(rows, 13), rows, strict=True):
        assert cut[k] == ((text, len(text)) if removed else (whole, len(whole)))

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, FOLDER).collect()}
    assert clean == {k for k, n, hit, _ in contaminated(rows, items, 13) if not (hit and 20 * hit >= n)}


def test_texts_without_words_stay_as_they_are(spark, make):
    rows = [(1, " \t\n ", "en", "s", 4), (2, "", "en", "s", 0), (3, None, "en", "s", None), (4, " one  two ", "en", "s", 10)]
    docs = make(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.repeated_passages(spark, docs, FOLDER)
    assert sorted(map(tuple, got.collect())) == rows
    assert all(r.round_trip and (r.n_tokens > 0) == (r.doc_id in (1, 4)) for r in corpus_pipeline.tokens(spark, got, FOLDER).collect())


def test_pipeline_runs_whole(spark):
    done = corpus_pipeline.run(spark, FOLDER)
    assert done.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]
    assert 0 < done.count() < 200 and done.filter(~F.col("round_trip")).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_odd_documents(spark, odd_documents, stage):
    docs = odd_documents.withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    got = stage(spark, docs, FOLDER)
    assert got.count() <= 9 and stage(spark, docs.limit(0), FOLDER).count() == 0
    if stage is not corpus_pipeline.tokens:
        assert got.columns == list(corpus_pipeline.COLUMNS)
