"""The chain of models: who is asked about what, and chains that were ended."""

import json
import os
import sys
import uuid

import pytest
from pyspark import cloudpickle

from garimpo.functions.answers import parse_match
from garimpo.operators.chain import Model, answer_chain, chain_answers
from garimpo.operators.resolve import response_resolve

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have this module
GOOD = '{"match_score": 7, "verdict": "%s"}'


def logged(folder, name, act):
    """A hook that leaves a file for each row it is asked about."""
    def answer(row):
        with open(os.path.join(folder, f"{name}-{uuid.uuid4().hex}"), "w") as f:
            json.dump([name, row["cycle"], row["n"]], f)
        return act(row)

    return Model(answer)


def calls(folder):
    found = []
    for name in os.listdir(folder):
        with open(os.path.join(folder, name)) as f:
            found.append(tuple(json.load(f)))
    return sorted(found)


def busy(row):
    raise RuntimeError("HTTP 503 overloaded")


def refused(row):
    raise ValueError("bad key")


@pytest.fixture
def asked(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return str(folder)


def rows_of(spark, n):
    return spark.createDataFrame([(f"l{i}", i, "x") for i in range(n)], "job_link string, n int, answer string")


def test_who_is_asked(spark, tmp_path, asked):
    """Per row the way through the chain, as a plain loop takes it."""
    def first(row):
        return {0: busy, 1: lambda r: "no json", 2: lambda r: GOOD % "a"}[row["n"] % 3](row)

    def second(row):
        return refused(row) if row["n"] % 2 else GOOD % "b"

    def third(row):
        return None if row["n"] % 5 == 0 and row["cycle"] < 2 or row["n"] == 25 else f"text {GOOD % 'c'} text"

    acts = [[("first", first), ("second", second)], [("third", third)]]
    wanted, best = [], {}
    for n in range(40):
        for cycle in (1, 2, 3):
            for p, models in enumerate(acts):
                for m, (name, act) in enumerate(models):
                    if n in best:
                        break
                    wanted.append((name, cycle, n))
                    try:
                        text = act({"n": n, "cycle": cycle})
                    except Exception:
                        continue
                    if text and "{" in text:
                        best[n] = (cycle, p, m)
                    break
    waits = []
    tries = answer_chain(
        rows_of(spark, 40), [[logged(asked, n, a) for n, a in models] for models in acts], parse_match, ["n"], "match", str(tmp_path / "chain"),
        retry_wait=1.5, tasks=3, sleep=waits.append,
    )
    assert calls(asked) == sorted(wanted)
    found = chain_answers(tries).collect()
    assert {int(r.job_link[1:]): (r.cycle, r.provider_rank, r.model_rank) for r in found} == best and len(found) == len(best) == 39
    assert tries.filter("error_text LIKE '%503%'").select("transient").distinct().collect()[0][0]
    assert not tries.filter("error_text LIKE '%bad key%' AND transient").count()
    assert waits == [1.5, 1.5]
    whole = response_resolve(rows_of(spark, 40).select("job_link"), chain_answers(tries))
    assert whole.count() == 40 and whole.filter("match_score = 50").count() == 1


def test_a_chain_that_was_ended_goes_on(spark, tmp_path, asked):
    first = logged(asked, "first", lambda row: busy(row) if row["n"] < 4 else GOOD % "a")

    class Ended(BaseException):
        pass

    def broken(row):
        return GOOD % "b"

    folder, posts = str(tmp_path / "chain"), rows_of(spark, 10)
    real = answer_chain.__globals__["hook_answers"]

    def dies(df, answer, *rest, **more):
        if more.get("cycle") == 1 and answer is broken:
            raise Ended
        return real(df, answer, *rest, **more)

    answer_chain.__globals__["hook_answers"] = dies
    try:
        with pytest.raises(Ended):
            answer_chain(posts, [[first], [Model(broken)]], parse_match, ["n"], "match", folder)
    finally:
        answer_chain.__globals__["hook_answers"] = real
    before = calls(asked)
    os.makedirs(f"{folder}/cycle=1/provider_rank=1/model_rank=0")  # half written: no mark of its end
    (tmp_path / "chain/cycle=1/provider_rank=1/model_rank=0/part-0.parquet").write_text("cut")
    tries = answer_chain(posts, [[first], [Model(broken)]], parse_match, ["n"], "match", folder)
    assert calls(asked) == before and len(before) == 10
    assert sorted((r.job_link, r.provider_rank) for r in chain_answers(tries).collect()) == [(f"l{i}", int(i < 4)) for i in range(10)]
    again = answer_chain(posts, [[first], [Model(busy)]], parse_match, ["n"], "match", folder)
    assert again.count() == tries.count() == 14


def test_only_passing_failures_come_again(spark, tmp_path, asked):
    model = logged(asked, "m", lambda row: (busy, refused, lambda r: "none")[row["n"] % 3](row))
    tries = answer_chain(rows_of(spark, 6), [[model]], parse_match, ["n"], "match", str(tmp_path / "chain"), max_cycles=2, only_transient=True)
    assert calls(asked) == sorted([("m", 1, n) for n in range(6)] + [("m", 2, n) for n in (0, 3)])
    assert chain_answers(tries).count() == 0


def test_rows_without_link_and_repeated_ones(spark, tmp_path, asked):
    df = spark.createDataFrame([(None, 1), ("a", 5), ("a", 3), ("b", None)], "job_link string, n int")
    tries = answer_chain(df, [[logged(asked, "m", lambda row: GOOD % row["n"])]], parse_match, ["n"], "match", str(tmp_path / "chain"))
    assert float({r.job_link: r.answer.verdict for r in chain_answers(tries).collect()}["a"]) == 3 and len(calls(asked)) == 2
    none = answer_chain(df.limit(0), [[Model(busy)]], parse_match, ["n"], "match", str(tmp_path / "empty"))
    assert none.count() == 0
