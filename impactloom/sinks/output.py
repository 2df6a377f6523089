"""Files, JSON, comment upserts and the exit code of a gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Hidden first line by which a comment is known again.
MARKER = "<!-- impactloom:verdict -->"
BLOCKED, SOURCE_DOWN = 1, 2


def write_markdown(rendered: DataFrame, folder: str) -> None:
    """A text file per event under ``<folder>/event_id=...``, replacing what was there."""
    rendered.select("event_id", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("event_id").text(folder)


def as_json(rows: DataFrame) -> DataFrame:
    """(value): each row as one JSON object."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def comment_upserts(rendered: DataFrame, notes: DataFrame) -> DataFrame:
    """(target, note_id, method, body): what to send so that each target has one verdict comment.

    ``rendered``: (target, markdown), one row per target; ``notes``: (target, note_id, body) comments that
    are there.  The oldest marked comment is replaced (PUT), else one is added (POST); a repeat changes
    nothing but that comment.  Sending is the caller's part.
    """
    own = notes.where(F.contains("body", F.lit(MARKER))).groupBy("target").agg(F.min("note_id").alias("note_id"))
    return rendered.join(own, "target", "left").select("target", "note_id", F.when(F.col("note_id").isNull(), "POST").otherwise("PUT").alias("method"), F.concat(F.lit(MARKER + "\n"), "markdown").alias("body"))


def exit_code(verdicts: DataFrame, enforce: bool) -> int:
    """1 where a verdict blocks and the gate is enforced, else 0."""
    return BLOCKED if enforce and not verdicts.where("action = 'BLOCK'").isEmpty() else 0
