"""Large JSON objects read in byte ranges."""

import json
import random

import pytest

from garimpo.sources import history_json, json_members

KEYS = {"spark.sql.files.maxPartitionBytes": "250", "spark.sql.files.openCostInBytes": "1"}


@pytest.fixture(params=["ranges", "whole"])
def cut(request, spark):
    """With byte ranges far shorter than an entry, and with none."""
    for key, value in KEYS.items() if request.param == "ranges" else ():
        spark.conf.set(key, value)
    yield request.param
    for key in KEYS:
        spark.conf.unset(key)


def texts(rng):
    pieces = ['"', "\\", "{", "}", "[", "]", ",", ":", "é", "a", " ", "\n", '\\"', "}}", '"}']
    return "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))


def document(rng):
    entries = {}
    for i in range(rng.randint(0, 8)):
        kind = rng.randint(0, 6)
        value = {"job_title": texts(rng), "notes": texts(rng), "more": {"x": [{"y": texts(rng)}, 1], "z": {}}}
        if kind == 0:
            value = rng.choice([7, None, "text }", [], [{"a": 1}, {"b": "}"}], True])
        elif kind == 1:
            value = {}
        entries[f"https://job/{i}/{texts(rng)}"] = value
    return entries


def wanted(text):
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        return []
    if not isinstance(found, dict):
        return []
    return [(k, v.get("job_title"), v.get("notes")) for k, v in found.items() if isinstance(v, dict)]


def test_entries_are_those_of_a_whole_parse(spark, cut, tmp_path):
    rng = random.Random(5)
    expected = []
    for i in range(12):
        text = json.dumps(document(rng), indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
        text = rng.choice(["", " ", "\n\n"]) + text + rng.choice(["", "\n", " \n" * 200])
        (tmp_path / f"{i}.json").write_text(text, encoding="utf-8")
        expected += wanted(text)
    found = history_json.scan_history(spark, str(tmp_path)).select("job_link", "job_title", "notes")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert len(expected) > 25


ENTRY = '"%s": {"job_title": "' + "x" * 300 + '"}'
BROKEN = {
    "cut in a string": '{"a": {"job_ti', "cut after an entry": "{" + ENTRY % "a", "cut after a comma": "{" + ENTRY % "a" + ', "b"',
    "cut in a number": "{" + ENTRY % "a" + ', "y": 3', "twice": "{" + ENTRY % "a" + "} {" + ENTRY % "b" + "}",
    "words after": "{" + ENTRY % "a" + "} and", "list": "[{" + ENTRY % "a" + "}]", "no comma": "{" + ENTRY % "a" + ENTRY % "b" + "}",
    "comma at the end": "{" + ENTRY % "a" + ", }", "brace too many": "{" + ENTRY % "a" + "}}", "bracket": "{" + ENTRY % "a" + ', "c": [}}',
    "blank": " \n", "empty": "", "string": '"}"',
}


def test_a_broken_document_gives_no_rows(spark, cut, tmp_path):
    for i, (name, text) in enumerate(BROKEN.items()):
        assert wanted(text) == [], name
        (tmp_path / f"{i}.json").write_text(text)
    (tmp_path / "good.json").write_text("{" + ENTRY % "good" + "}")
    assert [r.job_link for r in history_json.scan_history(spark, str(tmp_path)).collect()] == ["good"]


def test_one_file_is_read_by_many_tasks(spark, cut, tmp_path):
    (tmp_path / "one.json").write_text("{" + ", ".join(ENTRY % i for i in range(30)) + "}")
    read = spark.read.option("lineSep", "}").text(str(tmp_path))
    assert (read.rdd.getNumPartitions() > 30) == (cut == "ranges")
    assert history_json.scan_history(spark, str(tmp_path)).count() == 30


def test_small_members_are_read_together(spark, tmp_path):
    """Each member was a text of its own, which a document of thousands of them paid for."""
    (tmp_path / "one.json").write_text("{" + ", ".join(ENTRY % i for i in range(30)) + "}")
    runs = json_members.members(spark, str(tmp_path)).collect()
    assert [r.sound for r in runs] == [True]
    assert sorted(runs[0].members, key=int) == [str(i) for i in range(30)]


def test_walk():
    assert json_members.walk(b'{"a": [', False) == (False, 2)
    assert json_members.walk(b'x" : {', True) == (False, 1)
    assert json_members.walk(b'{"a\\" ["', False) == (False, 1)
    assert json_members.walk(b'{"a {', False) == (True, 1)
    assert json_members.walk(b'a { \\" {', True) == (True, 0)
