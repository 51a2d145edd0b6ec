"""Confirming chunks and selecting entries by completions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.operators import verify
from quarryline.sources import scratch


def answers(table):
    def make():
        def ask(prompt):
            if prompt not in table:
                raise ValueError("none")
            return table[prompt]

        return ask

    return make


def test_verify_chunks(spark):
    rows = spark.createDataFrame(
        [("q", "a", 0, 0.9, False, "a"), ("q", "b", 1, 0.8, False, "b"), ("q", "c", 2, 0.7, False, "c"), ("q", "t", 5, 1.0, True, "t"), ("r", "a", 0, 0.2, False, "a"), ("r", "d", 1, 0.3, False, "a")],
        "query_id string, chunk_id string, pos int, score double, from_toc boolean, prompt string",
    )
    # a: no, b: yes, c: the call fails and its row stays
    got = {(r.query_id, r.position): r.chunk_id for r in verify.verify_chunks(rows, answers({"a": "否", "b": "是"}), 1).collect()}
    assert got == {("q", 1): "t", ("q", 2): "b", ("q", 3): "c", ("r", 1): "a", ("r", 2): "d"}


def test_select_entries(spark):
    """Path, number, keywords among what was shown, keywords among all: each stage takes what those before left."""
    paths = ["A", "A>Oil", "B>Tyres", "C>Old tyres of all kinds"]
    entries = spark.createDataFrame([(m, p, p.split(">")[-1], i, 1 + p.count(">"), i, i + 1) for m in ("m", "n") for i, p in enumerate(paths)], "vehicle_model string, path string, title string, ord int, level int, page int, end_page int")
    questions = {"p": "which oil", "n": "tyres now", "k": "tyres", "x": "zzz", "f": "tyres fail", "e": ""}
    asked = spark.createDataFrame([(q, "m", text.split(), text) for q, text in questions.items()], "query_id string, vehicle_model string, words array<string>, question string")
    catalogue = {"which oil": "1. A>Oil\n2. C>Old tyres of all kinds", "tyres now": "1. C>Old tyres of all kinds\n2. B>Tyres", "tyres": "1. C>Old tyres of all kinds\n2. B>Tyres", "zzz": "1. A>Oil\n2. B>Tyres"}
    table = {f"which oil\n{catalogue['which oil']}": "it is A>Oil", f"tyres now\n{catalogue['tyres now']}": "2, 1, 9", f"tyres\n{catalogue['tyres']}": "无", f"zzz\n{catalogue['zzz']}": "?"}
    got: dict = {}
    for r in verify.select_entries(asked, entries, answers(table), 2, listed=2).collect():  # "c" lies in "which"
        got.setdefault(r.query_id, []).append((r.position, r.path, r.picked_by))
        assert r.vehicle_model == "m" and r.end_page == r.page + 1
    got = {q: sorted(v) for q, v in got.items()}
    assert got["p"] == [(1, "A>Oil", "path")]
    assert got["n"] == [(1, "B>Tyres", "number"), (2, "C>Old tyres of all kinds", "number")]
    assert got["k"] == [(1, "C>Old tyres of all kinds", "keyword"), (2, "B>Tyres", "keyword")]
    assert [x[1:] for x in got["x"]] == [("B>Tyres", "keyword"), ("A>Oil", "keyword")]  # only lengths count
    assert got["f"] == [(1, "C>Old tyres of all kinds", "whole catalogue"), (2, "B>Tyres", "whole catalogue")]  # the call failed
    assert "e" not in got
    assert verify.select_entries(asked.where(F.lit(False)), entries, answers(table)).count() == 0


def test_scratch(spark):
    scratch.drop_written(spark)
    rows = scratch.written(spark.range(5), "five")
    assert rows.count() == 5 and scratch.drop_written(spark) == 1 and scratch.drop_written(spark) == 0
