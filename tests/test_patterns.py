import random
import re

import pytest
from pyspark.sql import functions as F

from daybrook.operators import attribution, patterns, rulejoin
from daybrook.sources import registry
from tests.test_timeline_attribution import ROWS, P, cases


@pytest.mark.parametrize("part_chars", [7, 60, 10_000])
def test_contains_join_equals_every_pair(spark, part_chars):
    pick = random.Random(part_chars)
    texts = ["".join(pick.choice("abé ") for _ in range(pick.randint(0, 30))) for _ in range(60)] + ["", None, "x" * 20_000 + "ab"]
    found = ["".join(pick.choice("abé ") for _ in range(pick.randint(1, 5))) for _ in range(50)] + ["", "ab", "ab", None, "zzz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id LONG, text STRING")
    table = spark.createDataFrame([(p,) for p in found], "pattern STRING")
    got = sorted(map(tuple, patterns.contains_join(df, table, key="id", part_chars=part_chars).collect()))
    assert got == sorted((i, p) for i, t in enumerate(texts) if t is not None for p in {p for p in found if p is not None} if p in t)


def test_tables_without_rows(spark):
    texts, none = spark.createDataFrame([(1, "a")], "id LONG, text STRING"), spark.createDataFrame([], "pattern STRING")
    assert patterns.contains_join(texts, none, key="id").collect() == []
    assert patterns.contains_join(texts.limit(0), spark.createDataFrame([("a",)], "pattern STRING"), key="id").collect() == []


@pytest.mark.parametrize("pattern, want", [
    (".*Board.*", ["board"]), ("(?P<n>zed)", ["zed"]), ("ab|cde", ["ab", "cde"]), ("a|b?", [""]), ("x+yz", ["yz"]), (r"\bab(?:cd){2,}e", ["ab"]),
    ("(bad", None), ("[abc]+", [""]), ("(?=abc)d", ["d"]), ("a(?:bc|xde)f", ["bc", "xde"]), ("(ab)?c", ["c"])])
def test_required_texts(pattern, want):
    assert patterns.required_texts(pattern) == want


def test_regex_join_equals_every_pair(spark):
    pick = random.Random(8)
    texts = ["".join(pick.choice("aAbBc1-") for _ in range(pick.randint(0, 12))) for _ in range(120)] + [None, ""]
    parts = ["a", "b", "B", "c", "[ab]", "1", "-", ".", "(?:a|bc)", "b?", "c+", "(?P<g>ab)", "a{2}", "^", "$", r"\b", r"\d"]
    rules = ["".join(pick.choice(parts) for _ in range(pick.randint(1, 4))) for _ in range(150)] + ["(", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id LONG, text STRING")
    table = spark.createDataFrame([(str(k), r) for k, r in enumerate(rules)], "rule STRING, pattern STRING")
    got = sorted(map(tuple, patterns.regex_join(df, table, key="id").collect()))

    def fits(rule, text):
        try:
            return bool(rule) and text is not None and re.search(rule, text, re.I | re.A) is not None
        except re.error:
            return False
    assert got == sorted((i, str(k)) for i, t in enumerate(texts) for k, r in enumerate(rules) if fits(r, t))


def test_thousands_of_expressions_stay_out_of_the_plan(spark, capsys):
    rules = spark.range(5000).select(F.col("id").cast("string").alias("rule"), F.concat(F.lit("item "), "id", F.lit("[a-z]?$")).alias("pattern"))
    texts = spark.range(300).select("id", F.concat(F.lit("an Item "), F.col("id") * 7, F.lit("x")).alias("text"))
    found = patterns.regex_join(texts, rules, key="id")
    assert sorted((r["id"], r["rule"]) for r in found.collect()) == [(i, str(7 * i)) for i in range(300)]
    found.explain("formatted")
    assert capsys.readouterr().out.lower().count("rlike") <= 4


def test_registry_table_gives_the_inline_verdicts(spark):
    odd = [*P, {"id": "a/b", "signals": {"keywords": ["", "BOARD"], "jira_prefixes": ["Q.R", "z z"], "window_patterns": ["we+k|month", "[0-9]{4}", "("], "domains": [""]}},
           {"id": "path", "signals": {"paths": ["/", "", "D:\\work\\"], "git_remotes": ["github.com/acme/APP"]}}]
    odd.sort(key=lambda p: p["id"])     # the joined form names ties in order of their ids
    rows = [*ROWS, ("FOCUS_SESSION", {"anchor": "q.r-7 and Q+R-8"}), ("FOCUS_SESSION", {"anchor": "weeek 2024"}), ("FILE_CHANGE", {"path": "D:/work/x"}), ("NARRATION", {"note": "the Board"})]
    cols = [F.col("event_id").cast("int").alias("i"), "match.*"]
    want = attribution.with_match(cases(spark, rows), odd).select(*cols).orderBy("i").collect()
    assert rulejoin.with_match_joined(cases(spark, rows), odd).select(*cols).orderBy("i").collect() == want
    assert rulejoin.with_match_joined(cases(spark, rows), registry.from_dicts(spark, odd)).select(*cols).orderBy("i").collect() == want


def test_a_text_that_all_rules_share_pairs_nothing(spark):
    """Every text holds what all rules have in common; only the number tells them apart."""
    rules = spark.createDataFrame([(str(k), f"page=2.*x{k}z|BLOG\\.(?:ou|an)\\.example/{k}y") for k in range(300)], "rule STRING, pattern STRING")
    found = sorted(row["pattern"] for row in patterns.looked_up(rules).where("rule = '17'").collect())
    assert found == ["/17y", "x17z"] or found == [".example/17y", "x17z"]
    texts = spark.createDataFrame([(k, f"page=2 blog.ou.example/{k}y") for k in range(300)], "id LONG, text STRING")
    assert sorted(map(tuple, patterns.regex_join(texts, rules, key="id").collect())) == [(k, str(k)) for k in range(300)]


@pytest.mark.parametrize("most", [50_000, 0])
def test_only_patterns_that_occur_reach_the_automata(spark, monkeypatch, most):
    monkeypatch.setattr(patterns, "MOST_STARTS", most)
    known = ["a", "é", "bc", "bcd", "abcdefgh", "abcdefghi", "abcdefghX", "zz", "q", "cd ef"]
    texts = spark.createDataFrame([(1, "xabcdefghi é"), (2, None), (3, ""), (4, "cd ef")], "id LONG, text STRING")
    table = spark.createDataFrame([(p,) for p in known], "pattern STRING")
    assert sorted(r["pattern"] for r in patterns.occurring(texts, table).collect()) == sorted(set(known) - {"zz", "q"})
    got = sorted(map(tuple, patterns.contains_join(texts, table, key="id", part_chars=3).collect()))
    assert got == sorted((i, p) for i, t in ((1, "xabcdefghi é"), (4, "cd ef")) for p in known if p in t)


def test_what_grows_with_the_texts_is_not_broadcast(spark):
    rules = spark.createDataFrame([("r", "a+b")], "rule STRING, pattern STRING")
    texts = spark.createDataFrame([(1, "xaab"), (2, "b")], "id LONG, text STRING")
    found = patterns.regex_join(texts, rules, key="id")
    assert [tuple(r) for r in found.collect()] == [(1, "r")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
