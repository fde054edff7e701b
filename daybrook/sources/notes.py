"""Notes, clips and commits: raw rows to events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import AGENT_MARKERS
from ..functions.actors import commit_actor
from ..functions.core import py_trim
from ..functions.dates import since_ts, without_since
from ..functions.text import is_meaningful_note
from ..model import make_events, payload_of, source_of


def note_events(notes: DataFrame, text: str = "text", ts: str = "ts_wall", keep: tuple[str, ...] = ()) -> DataFrame:
    """Notes with the "since" phrase taken out and the flag whether they say anything."""
    raw = py_trim(text)
    clean = without_since(raw)
    return make_events(notes, type=F.lit("NARRATION"), source=source_of("intent", "intent_bridge"), ts_wall=F.col(ts), keep=keep,
                       payload=payload_of(note=clean, meaningful=is_meaningful_note(clean).cast("string"),
                                          retroactive_since=since_ts(raw, ts)))


def clip_events(clips: DataFrame, text: str = "text", ts: str = "ts_wall") -> DataFrame:
    """Clips carry their raw content up to the gate, which types it and drops it."""
    return make_events(clips, type=F.lit("CLIPBOARD"), source=source_of("intent", "intent_bridge"), ts_wall=F.col(ts),
                       payload=payload_of(content=F.col(text)))


def commit_events(commits: DataFrame, humans=(), agents=AGENT_MARKERS) -> DataFrame:
    """``repo, author, message, ts_wall, files`` to commit events with their actor."""
    who = commits.withColumn("_a", commit_actor("author", humans, agents))
    return make_events(who, type=F.lit("GIT_COMMIT"), source=source_of("git", "fs_git"), ts_wall=F.col("ts_wall"),
                       payload=payload_of(repo=F.col("repo"), author=F.col("author"), message=F.col("message"),
                                          actor=F.col("_a.actor"), files=F.col("files")),
                       method=F.col("_a.method"), confidence=F.col("_a.confidence"))
