"""Hosted-repository payloads (commits, pull requests, CI runs) to report events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AGENT_MARKERS
from ..functions.actors import hosted_identity
from ..functions.core import blank_to_null, has_text, splitlines
from ..functions.paths import plain_remote
from ..model import make_events, payload_of, source_of

COMMIT = ("sha STRING, commit STRUCT<message: STRING, author: STRUCT<name: STRING, date: STRING>>, "
          "author STRUCT<login: STRING, name: STRING, type: STRING>, files ARRAY<STRUCT<filename: STRING>>")
PULL = ("number STRING, title STRING, state STRING, draft BOOLEAN, merged_at STRING, updated_at STRING, created_at STRING, "
        "html_url STRING, user STRUCT<login: STRING, name: STRING, type: STRING>")
RUN = "name STRING, conclusion STRING, status STRING, updated_at STRING, created_at STRING, html_url STRING"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _report(df: DataFrame, who: Column, ts: Column, payload: Column, keep: tuple[str, ...]) -> DataFrame:
    return make_events(df.withColumn("_w", who), type=F.lit("AGENT_REPORT"), ts_wall=ts, payload=payload, keep=keep,
                       source=source_of(F.col("_w.kind"), F.lit("github_pull"), F.col("_w.identity")))


def commit_events(commits: DataFrame, *, now: str, humans=(), agents=AGENT_MARKERS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``remote`` plus the fields of ``COMMIT`` to events."""
    has_user = F.col("author").isNotNull()
    login = F.when(has_user, F.col("author.login")).otherwise(F.col("commit.author.name"))
    who = hosted_identity(F.col("author.type"), login, F.col("author.name"), humans, agents)
    first = F.coalesce(F.get(splitlines(_text("commit.message")), F.lit(0)), F.lit(""))
    sha = _text("sha")
    names = F.filter(F.transform(F.coalesce("files", F.array().cast("array<struct<filename:string>>")),
                                 lambda f: f["filename"]), lambda n: has_text(n))
    payload = payload_of(
        summary=F.trim(F.concat(F.lit("commit "), F.substring(sha, 1, 7), F.lit(": "), first)), repo=F.col("remote"),
        tool=F.lit("github"), actor=F.col("_w.actor"), sha=sha, message=first, files=names, kind_detail=F.lit("commit"))
    return _report(commits, who, F.coalesce(blank_to_null("commit.author.date"), F.lit(now)), payload, keep)


def pull_events(pulls: DataFrame, *, now: str, humans=(), agents=AGENT_MARKERS, keep: tuple[str, ...] = ()) -> DataFrame:
    who = hosted_identity(F.col("user.type"), F.col("user.login"), F.col("user.name"), humans, agents)
    verb = F.when(has_text("merged_at"), F.lit("merged")).when(F.col("state") == "closed", F.lit("closed")) \
        .when(F.coalesce("draft", F.lit(False)), F.lit("drafted")).otherwise(F.lit("opened"))
    payload = payload_of(
        summary=F.trim(F.concat(verb, F.lit(" PR #"), _text("number"), F.lit(": "), _text("title"))), repo=F.col("remote"),
        tool=F.lit("github"), actor=F.col("_w.actor"), pr_number=F.col("number"), state=_text("state"),
        url=_text("html_url"), kind_detail=F.lit("pull_request"))
    ts = F.coalesce(blank_to_null("merged_at"), blank_to_null("updated_at"), blank_to_null("created_at"), F.lit(now))
    return _report(pulls, who, ts, payload, keep)


def run_events(runs: DataFrame, *, now: str, keep: tuple[str, ...] = ()) -> DataFrame:
    name = F.coalesce(blank_to_null("name"), F.lit("workflow"))
    result = F.coalesce(blank_to_null("conclusion"), blank_to_null("status"), F.lit(""))
    who = F.struct(F.lit("remote").alias("kind"), F.concat(F.lit("ci:"), name).alias("identity"))
    payload = payload_of(
        summary=F.trim(F.concat(F.lit("CI "), name, F.lit(": "), result)), repo=F.col("remote"), tool=F.lit("github-actions"),
        conclusion=result, url=_text("html_url"), kind_detail=F.lit("workflow_run"))
    ts = F.coalesce(blank_to_null("updated_at"), blank_to_null("created_at"), F.lit(now))
    return _report(runs, who, ts, payload, keep)


def only_tracked(payloads: DataFrame, remotes: DataFrame) -> DataFrame:
    """Payloads of registered remotes on the supported host."""
    known = remotes.where(F.col("owner_repo").isNotNull()).select(F.col("remote").alias("_r"))
    return payloads.join(known, plain_remote("remote") == F.col("_r"), "left_semi")


def new_commits(commits: DataFrame, seen: DataFrame) -> DataFrame:
    """Commits with a sha not seen yet for the remote, each once."""
    fresh = commits.where(has_text("sha")).join(seen.select("remote", "sha").distinct(), ["remote", "sha"], "left_anti")
    return fresh.dropDuplicates(["remote", "sha"])


def new_pulls(pulls: DataFrame, seen: DataFrame) -> DataFrame:
    """Pull requests whose ``updated_at`` differs from the last one seen."""
    last = seen.select("remote", "number", F.col("updated_at").alias("_u"), F.lit(True).alias("_known"))
    joined = pulls.where(F.col("number").isNotNull()).join(last, ["remote", "number"], "left")
    return joined.where(F.col("_known").isNull() | ~F.col("_u").eqNullSafe(F.col("updated_at"))).drop("_u", "_known")


def seen_after(seen: DataFrame, fresh: DataFrame, keys: list[str], value: str | None = None) -> DataFrame:
    """State after a pull: new rows replace old ones with the same key."""
    cols = [*keys, *([value] if value else [])]
    stay = seen.select(*cols).join(fresh.select(*keys).distinct(), keys, "left_anti")
    return stay.unionByName(fresh.select(*cols)).dropDuplicates(keys)


