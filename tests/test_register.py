from pyspark.sql import functions as F

from daybrook.functions import dates, paths, secrets, text
from daybrook.functions.register import register_functions


def test_sql_functions_equal_column_functions(spark):
    assert len(register_functions(spark)) == 11
    key = "Zk3" + "abcdEFGH1234"
    values = ["plain", "token=abc in /home/al/x", f"sk-ant-{key * 2} and 'q' \"z\"", f"x {key}{key}", "see https://h.example/p now", "a = {1}", "C:\\Users\\bob\\f.py",
              "postgres://u:pw@h/x", "hunter2-Xy9Zq81", "git@github.com:a/b.git", "2026-06-21T10:00:00Z", "20260621T1000", "20260621", ""]
    df = spark.createDataFrame([(v,) for v in values], "t STRING")
    df.createOrReplaceTempView("texts")
    got = spark.sql("SELECT t, db_scrub(t) a, db_redaction_codes(t) b, db_entropy(t) c, db_basename(t) d, db_date_key(t) e, db_period_key(t, 'week') f, "
                    "db_period_key(t, 'month') g, db_clipboard_kind(t) h, db_remote(t) i FROM texts").collect()
    s = secrets.scrub("t")
    want = df.select("t", s["text"].alias("a"), s["names"].alias("b"), text.entropy("t").alias("c"), paths.basename("t").alias("d"), dates.date_key("t").alias("e"),
                     dates.period_key("t", "week").alias("f"), dates.period_key("t", "month").alias("g"), secrets.clipboard_summary("t")["kind"].alias("h"),
                     paths.remote_address("t").alias("i")).collect()
    assert got == want


def test_sql_table_functions(spark):
    register_functions(spark)
    df = spark.createDataFrame([("---\n## 2026-06-21\n\nx\n---\n---\n## 2026-06-22\ny\n", "diff --git a/x b/x\n+1\ndiff --git a/y b/y\n+2\n", "pre\n# A\nbody\n ## B\n")],
                               "s STRING, d STRING, m STRING")
    df.createOrReplaceTempView("docs")
    assert [r[0] for r in spark.sql("SELECT x.label FROM docs, LATERAL db_split_sections(s) x").collect()] == ["2026-06-21", "2026-06-22"]
    assert [r[0] for r in spark.sql("SELECT x.path FROM docs, LATERAL db_split_diff(d) x").collect()] == ["x", "y"]
    assert [tuple(r) for r in spark.sql("SELECT x.heading, x.body FROM docs, LATERAL db_split_markdown(m) x").collect()] == [("", "pre"), ("A", "body"), ("B", "")]
    assert df.select(F.lit(1)).count() == 1
