"""Who did it: human, agent or unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import AGENT_MARKERS, BURST_THRESHOLD
from .core import ColumnLike, bind, blank_to_null, col, strings


def author_class(author: ColumnLike, humans=(), agents=AGENT_MARKERS) -> Column:
    """``agent`` or ``human`` by a marker in the name, agents first; null when neither."""
    a = F.lower(F.coalesce(col(author), F.lit("")))
    agent = F.exists(strings(m.lower() for m in agents), lambda m: F.contains(a, m))
    human = F.exists(strings(m.lower() for m in humans), lambda m: F.contains(a, m))
    return F.when(a == "", F.lit(None)).when(agent, F.lit("agent")).when(human, F.lit("human"))


def _actor(actor: Column, method: str, confidence: float) -> Column:
    return F.struct(actor.alias("actor"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))


def file_actor(author: ColumnLike, human_active: ColumnLike, burst: ColumnLike, *,
               humans=(), agents=AGENT_MARKERS, threshold: int = BURST_THRESHOLD) -> Column:
    """``struct<actor, method, confidence>`` of a file change."""
    return bind(author_class(author, humans, agents), lambda c: F.when(
        c.isNotNull(), _actor(c, "git_author", 0.95)).when(
        F.coalesce(col(human_active), F.lit(False)), _actor(F.lit("human"), "input", 0.7)).when(
        col(burst) >= threshold, _actor(F.lit("agent"), "burst", 0.8)).otherwise(
        _actor(F.lit("agent"), "no_human", 0.5)))


def commit_actor(author: ColumnLike, humans=(), agents=AGENT_MARKERS) -> Column:
    """Commits of an unknown author count as human, with less confidence."""
    return bind(author_class(author, humans, agents), lambda c: F.when(
        c.isNotNull(), _actor(c, "git_author", 0.95)).otherwise(_actor(F.lit("human"), "git_author", 0.5)))


def is_bot(user_type: ColumnLike, login: ColumnLike) -> Column:
    return (F.lower(F.coalesce(col(user_type), F.lit(""))) == "bot") \
        | F.lower(F.coalesce(col(login), F.lit(""))).contains("[bot]")


def hosted_identity(user_type: ColumnLike, login: ColumnLike, name: ColumnLike,
                    humans=(), agents=AGENT_MARKERS) -> Column:
    """``struct<actor, kind, identity>`` of a hosted-repository user."""
    who = F.coalesce(blank_to_null(login), blank_to_null(name), F.lit("unknown"))
    agent = is_bot(user_type, login) | F.coalesce(author_class(who, humans, agents) == "agent", F.lit(False))
    return F.when(agent, F.struct(
        F.lit("agent").alias("actor"), F.lit("agent").alias("kind"),
        F.concat(F.lit("agent:"), who).alias("identity"))).otherwise(F.struct(
            F.lit("human").alias("actor"), F.lit("remote").alias("kind"),
            F.concat(F.lit("github:"), who).alias("identity")))
