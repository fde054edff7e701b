"""Registered queries: redaction, scalar functions and retrieval over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, paths, secrets, text
from ..functions.core import once
from ..operators import attribution, audit, diffs, gate, retrieval
from ..model import make_events, payload_of, source_of
from ..session import materialize, prepare, spread, work_dir
from ..sinks import store
from ..sources import notes
from .activity import RUN_TS, table
from .queries_core import stored


def seeded_documents(spark, sf_dir):
    """Documents with one secret of a known shape at the end of each text."""
    prepare(spark)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    d, h = F.col("doc_id"), F.md5(F.col("doc_id").cast("string"))
    shapes = [
        F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16))), F.concat(F.lit("ghp_"), h), F.concat(F.lit("sk-ant-"), h),
        F.concat(F.lit("sk-"), h), F.concat(F.lit("xoxb-"), h), F.concat(F.lit("eyJ"), h, F.lit("."), h, F.lit("."), h),
        F.concat(F.lit("Authorization: Bearer "), h), F.lit("-----BEGIN RSA PRIVATE KEY-----"),
        F.concat(F.lit('client_secret = "'), h, F.lit('"')), F.concat(F.lit("https://bob:"), h, F.lit("@host/x")),
        F.concat(F.lit("C:\\Users\\bob\\x /home/al/y AIza"), h)]
    seed = F.coalesce(*[F.when(d % len(shapes) == i, s) for i, s in enumerate(shapes)])
    return docs.select("doc_id", F.concat("text", F.lit(" "), seed).alias("text"))


def redact_documents(spark, sf_dir):
    done = once(seeded_documents(spark, sf_dir), s=secrets.scrub("text"))
    return done.select("doc_id", F.md5("s.text").alias("clean_md5"), F.length("s.text").cast("bigint").alias("n_chars"),
                       F.array_join("s.names", ",").alias("codes"))


def redaction_histogram(spark, sf_dir):
    done = seeded_documents(spark, sf_dir).select(F.explode(secrets.scrub("text")["names"]).alias("code"))
    return done.groupBy("code").agg(F.count("*").alias("n_docs"))


def leak_audit(spark, sf_dir):
    return audit.residual(seeded_documents(spark, sf_dir), "doc_id", "text") \
        .select("doc_id", F.array_join("codes", ",").alias("codes"))


def store_audit(spark, sf_dir):
    return audit.leak_report(stored(spark, sf_dir))


def date_period_keys(spark, sf_dir):
    prepare(spark)
    o = table(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    ts = F.when(k % 5 == 0, F.concat(day, F.lit("T23:30:00-05:00"))).when(k % 5 == 1, F.concat(day, F.lit(" 09:05:00"))) \
        .when(k % 5 == 2, day).when(k % 5 == 3, F.concat(F.replace(day, F.lit("-"), F.lit("")), F.lit("T140000"))).otherwise(F.lit("soon"))
    keyed = o.select("o_orderkey", ts.alias("ts"))
    keyed = keyed.withColumn("date_key", dates.date_key("ts"))
    return keyed.select(
        "o_orderkey", "date_key", dates.date_label("date_key").alias("date_label"), dates.hhmm("ts").alias("hhmm"),
        dates.period_key("date_key", "month").alias("month"), dates.period_key("date_key", "week").alias("week"),
        dates.span_days(F.lit("19950101"), "date_key").cast("bigint").alias("span"),
        dates.instant("ts").cast("timestamp_ntz").alias("instant"))


def normalize_paths(spark, sf_dir):
    prepare(spark)
    c = table(spark, sf_dir, "customer")
    n, seg = F.col("c_custkey"), F.col("c_mktsegment")
    raw = F.when(n % 4 == 0, F.concat(F.lit("C:\\Users\\"), "c_name", F.lit("\\proj\\"), seg, F.lit("\\Main.PY"))) \
        .when(n % 4 == 1, F.concat(F.lit("/home/u"), n.cast("string"), F.lit("/work/"), seg, F.lit("/"))) \
        .when(n % 4 == 2, F.concat(F.lit("/Users/"), "c_name", F.lit("/x.md"))).otherwise(F.concat(F.lit("/data/"), seg))
    rows = c.select("c_custkey", raw.alias("p"), F.concat(F.lit("../"), "c_name", F.lit("!")).alias("account"))
    return rows.select("c_custkey", paths.home_to_tilde("p").alias("tilde"), paths.canonical("p").alias("canonical"),
                       paths.basename("p").alias("base"), paths.safe_segment("account").alias("segment"))


def allowlist_join(spark, sf_dir):
    """Prefix join of every shipment path against a root table, as an equi join on ancestors."""
    prepare(spark)
    li = table(spark, sf_dir, "lineitem")
    path = F.concat(F.lit("/data/s"), F.col("l_suppkey").cast("string"), F.lit("/o"), F.col("l_orderkey").cast("string"),
                    F.lit("/n"), F.col("l_linenumber").cast("string"))
    roots = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(
        F.concat(F.lit("/data/s"), F.col("s_suppkey").cast("string"), F.lit("/")).alias("root"))
    return gate.allowed_paths(li.select(path.alias("path")), roots)


def file_rules(spark, sf_dir):
    """Noise, secret-file and ignore-glob tests on names made from the part table."""
    prepare(spark)
    p = table(spark, sf_dir, "part")
    k, stem = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit("_"))
    endings = [".py", ".PYC", ".bak3", ".2.bak", "~7", ".sql", ".env", ".tar.gz", ".pem", ".lock", ".TMP", ".md"]
    ending = F.element_at(F.array(*[F.lit(e) for e in endings]), (k % len(endings) + 1).cast("int"))
    folders = ["src/", "node_modules/lib/", "build/out/", "src/.Git/", "mysecrets/", "secrets/", "deep/a/secrets/"]
    folder = F.element_at(F.array(*[F.lit(e) for e in folders]), (k % len(folders) + 1).cast("int"))
    name = F.when(k % 13 == 0, F.concat(F.lit("~$"), stem)).when(k % 13 == 1, F.lit("deadBEEF01")).when(
        k % 13 == 2, F.lit("id_rsa")).otherwise(F.concat(stem, ending))
    rows = p.select("p_partkey", F.concat(folder, name).alias("path"))
    return rows.select("p_partkey", "path", paths.is_noise_path("path").alias("noise"), paths.is_secret_file("path").alias("secret"),
                       paths.is_ignored("path", ["*.sql", "secrets/*", "build/", "**/*.md", "# note", ""]).alias("ignored"))


def clipboard_types(spark, sf_dir):
    prepare(spark)
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") + F.col("turn")
    t = F.when(k % 6 == 0, F.concat(F.lit("see https://host"), k.cast("string"), F.lit(".example.com/a "), "text")) \
        .when(k % 6 == 1, F.concat(F.lit("pwd: "), "text")).when(k % 6 == 2, F.concat(F.lit("Tok3n"), F.substring(F.md5("text"), 1, 10))) \
        .when(k % 6 == 3, F.lit("just a few words")).otherwise(F.col("text"))
    done = once(c.select("conv_id", "turn", t.alias("clip")), s=secrets.clipboard_summary("clip"))
    return done.select("conv_id", "turn", "s.kind", F.col("s.length").cast("bigint").alias("length"), "s.host")


def meaningful_notes(spark, sf_dir):
    prepare(spark)
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") * 31 + F.col("turn")
    t = F.when(k % 4 == 0, F.lit("ok stuff")).when(k % 4 == 1, F.lit("fix")).when(k % 4 == 2, F.lit("wip to it")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", text.is_meaningful_note(t).alias("meaningful"))


def retro_notes(spark, sf_dir):
    prepare(spark)
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") * 7 + F.col("turn")
    said = ["since 2pm", "Since 14:30", "since 11:45 am", "since 25", "since 9", "since 12am", "since  7PM", "later on"]
    phrase = F.element_at(F.array(*[F.lit(s) for s in said]), (k % len(said) + 1).cast("int"))
    ref = F.when(k % 3 == 0, F.lit("2026-06-21T13:00:00+03:00")).when(k % 3 == 1, F.lit("2026-06-21T13:00:00")).otherwise(F.lit("2026-06-21 08:15:30"))
    rows = c.select("conv_id", "turn", F.concat(F.lit("parser work "), phrase, F.lit(", turn "), F.col("turn").cast("string")).alias("text"),
                    ref.alias("ts_wall"))
    ev = notes.note_events(rows, keep=("conv_id", "turn"))
    return ev.select("conv_id", "turn", F.col("payload.note").alias("note"), F.col("payload.meaningful").alias("meaningful"),
                     F.col("payload.retroactive_since").alias("since"))


def intent_ladder(spark, sf_dir):
    prepare(spark)
    p = table(spark, sf_dir, "part")
    k, name = F.col("p_partkey"), F.col("p_name")
    file = F.concat(F.replace(name, F.lit(" "), F.lit("_")), F.lit(".py"))
    title = F.when(k % 8 == 0, F.concat(file, F.lit(" - proj - Editor"))).when(k % 8 == 1, F.concat(name, F.lit(" — Notes"))) \
        .when(k % 8 == 2, F.concat(F.lit("C:\\code\\"), F.replace(name, F.lit(" "), F.lit("_")), F.lit("\\main.cs - IDE"))) \
        .when(k % 8 == 3, F.lit("New Tab - Browser")).otherwise(F.lit("tool"))
    none = F.lit("")
    rows = p.select("p_partkey", title.alias("title"), F.when(k % 16 == 15, F.lit("  Design doc / v2 ")).otherwise(none).alias("uia"),
                    F.when(k % 8 == 4, F.concat(F.lit("D:\\work\\"), "p_brand")).otherwise(none).alias("cwd"),
                    F.when(k % 8 == 5, F.concat(F.lit('run "C:/jobs/'), "p_type", F.lit('/go.exe" -x'))).otherwise(none).alias("cmd"),
                    F.when(k % 8 == 6, F.concat(F.lit("out/"), file)).otherwise(none).alias("saved"),
                    F.when(k % 16 == 7, F.concat(F.lit("fix the "), name)).otherwise(none).alias("note"),
                    F.col("p_size").alias("keys"), F.lit(60.0).alias("secs"))
    done = once(rows, i=text.intent("uia", "title", "cwd", "cmd", "saved", "note", "keys", "secs"))
    return done.select("p_partkey", F.col("i.label").alias("label"), F.col("i.method").alias("method"),
                       F.col("i.confidence").alias("confidence"), F.col("i.artifact").alias("artifact"))


def page_attribution(spark, sf_dir):
    """Domain signal: every page visit scored against the projects' hosts."""
    prepare(spark)
    hosts = [{"id": "com", "signals": {"domains": ["example.com", "m.example.net"]}},
             {"id": "org", "signals": {"domains": ["EXAMPLE.ORG"], "keywords": ["spam"]}},
             {"id": "blog", "signals": {"domains": ["//blog."]}}]
    pages = table(spark, sf_dir, "pages")
    ev = make_events(pages, type=F.lit("FOCUS_SESSION"), source=source_of("os", "os_focus"), ts_wall=F.lit(RUN_TS),
                     payload=payload_of(anchor=F.col("url"), process=F.lit("browser")),
                     event_id=F.col("page_id").cast("string"), keep=("page_id",))
    m = attribution.with_match(ev, hosts)
    return m.select("page_id", F.col("match.project_id").alias("project_id"), F.col("match.method").alias("method"),
                    F.round("match.score", 4).alias("score"))


def marked_documents(spark, sf_dir):
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("project_d"), F.col("doc_id").cast("string"), F.lit("/notes.md")).alias("path"),
                       F.replace("text", F.lit(".\n"), F.lit(".\n ## part\n")).alias("text"))


def split_passages(spark, sf_dir):
    p = retrieval.passages(marked_documents(spark, sf_dir))
    return p.select("path", F.col("passage_no").cast("bigint").alias("passage_no"), "source", F.md5("text").alias("text_md5"))


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _corpus(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("pid"), F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("source"), "text")


def _ranked(spark, sf_dir):
    prepare(spark)
    corpus, questions = _corpus(spark, sf_dir), _questions(spark, sf_dir)
    return retrieval.top_passages(retrieval.score(corpus, questions), corpus)


def ask_topk(spark, sf_dir):
    return _ranked(spark, sf_dir).select("qid", F.col("rank").cast("bigint").alias("rank"), "source", "score")


def ask_budget(spark, sf_dir):
    return retrieval.within_budget(_ranked(spark, sf_dir)).select("qid", F.col("rank").cast("bigint").alias("rank"), "source", "chars_used")


def ask_answers(spark, sf_dir):
    rows = retrieval.answers(retrieval.within_budget(_ranked(spark, sf_dir)), _questions(spark, sf_dir))
    return rows.select("qid", F.array_join("sources", ",").alias("sources"), F.md5("answer").alias("answer_md5"))


def seeded_diffs(spark, sf_dir):
    """Two-file diffs whose lines are the documents' lines, with secrets in some."""
    prepare(spark)
    d = F.col("doc_id").cast("string")
    docs = seeded_documents(spark, sf_dir)
    body = F.concat(F.lit("+"), F.replace("text", F.lit("\n"), F.lit("\n+")))
    second = F.when(F.col("doc_id") % 3 == 0, F.lit(".env")).otherwise(F.concat(F.lit("src/m"), d, F.lit(".py")))
    diff = F.concat(F.lit("diff --git a/docs/d"), d, F.lit(".md b/docs/d"), d, F.lit(".md\n@@ -0,0 +1 @@\n"), body,
                    F.lit("\ndiff --git a/"), second, F.lit(" b/"), second, F.lit("\n@@ -1 +1 @@\n+x = "), d, F.lit("\n"))
    return docs.select("doc_id", diff.alias("diff"))


def diff_split(spark, sf_dir):
    return diffs.diff_files(seeded_diffs(spark, sf_dir)).select(
        "doc_id", F.col("file_no").cast("bigint").alias("file_no"), "path", F.md5("body").alias("body_md5"))


def diff_scrub(spark, sf_dir):
    policy = diffs.CapturePolicy(True)
    done = once(seeded_diffs(spark, sf_dir), c=diffs.capture_diff("diff", policy))
    return done.select("doc_id", F.col("c.lines").cast("bigint").alias("n_lines"), F.col("c.truncated").alias("truncated"),
                       F.array_join(F.array_sort("c.codes"), ",").alias("codes"), F.sha2("c.clean", 256).alias("diff_ref"))


def diff_sidecars(spark, sf_dir):
    policy = diffs.CapturePolicy(True)
    done = once(seeded_diffs(spark, sf_dir), c=diffs.capture_diff("diff", policy)).select(F.col("c.clean").alias("diff_clean"))
    return diffs.verified(diffs.sidecars(done)).select("diff_ref", F.length("body").cast("bigint").alias("n_chars"))


def diff_store(spark, sf_dir):
    """Bodies stored by two batches with common diffs, one of them run twice, and a writer beside them: each body once."""
    policy, path = diffs.CapturePolicy(True), work_dir(spark, "diffs")
    done = once(seeded_diffs(spark, sf_dir), c=diffs.capture_diff("diff", policy)).select("doc_id", F.col("c.clean").alias("diff_clean"))
    done = materialize(done, "captured")
    for batch, rows in (("a", done.where("doc_id % 3 < 2")), ("b", done.where("doc_id % 3 > 0")), ("b", done.where("doc_id % 3 > 0"))):
        store.append_diffs(rows, path, batch)
    return diffs.verified(store.read_diffs(spark, path)).select("diff_ref", F.length("body").cast("bigint").alias("n_chars"))


def leak_samples(spark, sf_dir):
    """Five documents of each leak code, the same on every run."""
    found = audit.residual(seeded_documents(spark, sf_dir), "doc_id", "text")
    return audit.leak_samples(found, 5, "doc_id").select("code", "doc_id")


QUERIES = {f.__name__: f for f in (
    redact_documents, redaction_histogram, leak_audit, leak_samples, store_audit, date_period_keys, normalize_paths, allowlist_join,
    file_rules, clipboard_types, meaningful_notes, retro_notes, intent_ladder, page_attribution, split_passages,
    ask_topk, ask_budget, ask_answers, diff_split, diff_scrub, diff_sidecars, diff_store)}
