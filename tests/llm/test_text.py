import os
import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagefold.llm import encode as e
from pagefold.llm.mix import default_schedules, integrate, mix_documents, mix_report, plan_mix
from pagefold.llm.repeat import RUN, THRESHOLDS, repetition

needs_files = pytest.mark.skipif(not os.path.exists(e.rank_file("byte_bpe_50k")), reason="no vocabulary files here")

TEXTS = ["", " ", "\n\n \t x", "It's 12 o'clock—isn't it?", "页面 layout 图2A", "Füßë ​﻿", "a" * 5000, "<|endoftext|>", "\x00\x01 \x7f", "🙂🙂 é", "   lead and trail   ", "\r\n\r\n", "x" * 70 + " " + "x" * 70]


@pytest.fixture(scope="module")
def both():
    import tiktoken

    path = e.rank_file("byte_bpe_50k")
    own = tiktoken.Encoding("own", pat_str=e.PRE_TOKEN, mergeable_ranks={t: i for i, t in enumerate(e.read_ranks(path))}, special_tokens={})
    return e.encoder(path), own


@needs_files
def test_ids_equal_those_of_the_vocabulary_library(both):
    mine, own = both
    for t in TEXTS:
        assert mine.encode(t) == own.encode_ordinary(t)
        assert mine.decode(mine.encode(t)) == t


@needs_files
@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60))
def test_any_text_comes_back(both, t):
    mine, own = both
    assert mine.encode(t) == own.encode_ordinary(t) and mine.decode(mine.encode(t)) == t


@needs_files
def test_encoding_a_table_keeps_every_row(spark):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None])] + [(0, "again", "x"), (None, "no key", "x")]
    out = e.encode_column(spark.createDataFrame(rows, "id int, t string, ids string"), "id", "t").collect()
    assert len(out) == len(rows)
    assert [r["ids"] for r in out if r["id"] == len(TEXTS)] == [[]] and sorted(len(r["ids"]) for r in out if r["id"] == 0) == [0, 1]
    counted = e.count_tokens(spark.createDataFrame(rows, "id int, t string, ids string"), "t")
    assert counted.agg(F.sum("n_tokens")).first()[0] == sum(len(r["ids"]) for r in out) and counted.columns == ["id", "ids", "n_tokens"]
    assert e.encode_column(spark.createDataFrame([], "id int, t string"), "id", "t").count() == 0


@needs_files
def test_forgetting_changes_nothing(both, monkeypatch):
    mine, own = both
    monkeypatch.setattr(e, "REMEMBERED", 3)
    for t in TEXTS:
        assert mine.encode(t) == own.encode_ordinary(t)


def test_schedules_add_up_at_every_time():
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    s = default_schedules(weights)
    for at in (0, 1):
        assert abs(sum(weights[k] * s[k][at][1] for k in weights) - 1) < 1e-12
    for knots in s.values():
        assert abs(integrate(knots)[-1][5] - 1) < 1e-12
    for bad in ([(0.0, 1.0)], [(0.0, 1.0), (0.9, 1.0)], [(0.0, -1.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 0.0)]):
        with pytest.raises(ValueError):
            integrate(bad)


TARGETS = [("Big", "big", 0.5, 1), ("Small", "small", 0.2, 4), ("Short", "short", 0.3, 2), ("Gone", "gone", 0.1, 9), ("None", None, 0.1, 1)]


def mixture(spark, rows=None):
    rng = random.Random(7)
    rows = rows if rows is not None else [(i, "big" if i % 2 else "small" if i % 8 == 0 else "short" if i % 100 == 2 else "other", rng.choice([0, 50, 100, 151])) for i in range(4000)] + [(9001, None, 500)]
    sizes = spark.createDataFrame(rows, "doc int, key string, n_tokens bigint")
    targets = spark.createDataFrame(TARGETS, "source string, key string, target_weight double, max_repeats int")
    return sizes, plan_mix(sizes, targets, 0.5)


def test_sources_reach_their_weight_or_are_reported(spark):
    sizes, plan = mixture(spark)
    by = {p["source"]: p for p in plan}
    mixed = mix_documents(sizes, "doc", plan)
    report = {r["source"]: r for r in mix_report(mixed, plan, 0.5).collect()}
    assert {s for s, r in report.items() if r["short"]} == {"Short", "Gone", "None"} == {s for s, p in by.items() if p["repeats"] * p["tokens"] < p["demand"]}
    asked = sizes.agg(F.sum("n_tokens")).first()[0] * 0.5
    assert all(abs(r["share_of_target"] - r["drawn_tokens"] / asked) < 1e-9 for r in report.values()) and abs(report["Big"]["share_of_target"] - 0.5) < 0.01
    for s in ("Big", "Small"):
        assert abs(report[s]["drawn_tokens"] - by[s]["demand"]) <= 151
    assert report["Short"]["drawn_tokens"] == 2 * by["Short"]["tokens"] and report["Gone"]["drawn"] == 0
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    most = mixed.groupBy("doc").agg(F.count("*").alias("n"), F.max("copy").alias("c"), F.first("source").alias("s")).groupBy("s").agg(F.max("n").alias("n"), F.max("c").alias("c"))
    limits = {t[0]: t[3] for t in TARGETS}
    assert all(r["n"] == r["c"] <= limits[r["s"]] for r in most.collect())


def test_positions_follow_the_schedule(spark):
    sizes, plan = mixture(spark)
    late = {"big": [(0.0, 0.0), (0.5, 0.0), (1.0, 1.0)]}
    rows = mix_documents(sizes, "doc", plan, late).collect()
    at = [r["position"] for r in rows]
    assert at == sorted(at) and 0 <= at[0] and at[-1] < 1
    assert min(r["position"] for r in rows if r["source"] == "Big") >= 0.5
    half = sum(r["n_tokens"] for r in rows if r["source"] == "Big" and r["position"] < 0.75) / sum(r["n_tokens"] for r in rows if r["source"] == "Big")
    assert abs(half - 0.25) < 0.01


def test_mixing_nothing(spark):
    sizes, plan = mixture(spark, [])
    mixed = mix_documents(sizes, "doc", plan)
    assert mixed.count() == 0
    assert not any(r["short"] for r in mix_report(mixed, plan, 0.5).collect())


def test_found_sources_are_read_from_the_mixed_table(spark, small):
    from pagefold.llm.queries import p7_found, p7_report

    files = [f for f in p7_report(spark, small).select("drawn_tokens").inputFiles() if "/mixed-" in f]
    assert files and p7_found(spark, small).columns == ["source"]


def words(text):
    text = re.sub("([一-鿿])", r" \1 ", text.lower())
    out, run = [], ""
    for c in text + " ":
        if unicodedata.category(c)[0] in "LN":
            run += c
        else:
            out += [run] if run else []
            run = ""
    return out


def brute(text):
    w = words(text)
    seen, covered = set(), set()
    for i in range(len(w) - RUN + 1):
        g = tuple(w[i : i + RUN])
        if g in seen:
            covered |= set(range(i, i + RUN))
        seen.add(g)
    return len(w), len(covered)


def test_repeated_words_equal_plain_loops(spark):
    rng = random.Random(11)
    texts = ["", "   ", "one two three four five six", "a b c d e f a b c d e f", "x " * 300, "the cat, sat. " * 4, "图表显示结果如下" * 3, "Ab-CD ab cd AB/cd " * 9, "é è ü Ü É È " * 2, "1 2 3 4 5 6 7 1 2 3 4 5 6 8 2 3 4 5 6 7"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)] + ["lorem ipsum " * 20000]
    out = {r["i"]: r for r in repetition(spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string"), "t").collect()}
    for i, t in enumerate(texts):
        n, c = brute(t)
        assert (out[i]["n_words"], out[i]["repeated_words"]) == (n, c)
        assert ("repeated_words" in out[i]["flags"]) == (n > 0 and 2 * c >= n)
    assert out[-1]["n_words"] is None and out[-1]["flags"] == [] and out[0]["repeated_word_share"] == 0 and out[0]["symbol_share"] == 0


def test_lines_paragraphs_sentences_and_clashing_columns(spark):
    text = "Same line.\nSame line.\nOther.\n\nSame line.\nSame line.\nOther."
    r = repetition(spark.createDataFrame([("k", text, 5)], "flags string, t string, n_words int"), "t").first()
    assert r["repeated_paragraph_share"] == 0.5 and round(r["repeated_line_share"], 2) == round(1 - 16 / 52, 2) and r["n_words"] == 10 and "repeated_paragraphs" in r["flags"] and "repeated_lines" in r["flags"]
    few = repetition(spark.createDataFrame([("a b c",)], "t string"), "t", rules=(THRESHOLDS[4],), only_needed=True)
    assert few.columns == ["t", "n_words", "flags"] and few.first()["flags"] == ["few_words"]
    assert repetition(spark.createDataFrame([], "t string"), "t").count() == 0


def test_texts_stay_in_one_projection(spark):
    plan = repetition(spark.createDataFrame([("a",)], "t string"), "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
