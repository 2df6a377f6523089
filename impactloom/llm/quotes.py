"""Operator 3 - chat formatting by quotation linking.

A line's quote level is its number of leading ``>`` marks (blanks between them allowed).  Maximal
runs of lines with one level above 0 are *quoted passages*; the lines of level 0 are the message's
own text, but for a line like "On Monday X wrote:" right before a quote.  Passages are normalised (marks off, case folded, runs of blanks as one) and hashed.  What
a passage quotes is looked up by (conversation, hash) among the own texts of messages: the whole own
text, its paragraphs, its lines and its pairs of neighbouring lines; the earliest message that has it is
the original.  A passage that is none of these but at least ``RUN_LEAST`` words (a sentence, a part of a line,
lines wrapped anew) is looked up as a run of words: of its anchors - all its runs of ``ANCHOR`` words, or the whole
of a shorter one - the one that fewest messages of the conversation have names the candidates, which are then
searched for the whole passage; the earliest that has it is the original.  A passage that no earlier message
has as one (a trimmed quote) is looked up by its own paragraphs, lines and pairs: of the earliest owners of
those, the message that has most of them is the original, the earliest where several do.  The passages
of a quote of level 1 are what a message replies to, the first of them that is found deciding;
deeper levels are links as well.

A reply comes after its original, so threads - connected messages - ordered by their first turn, and
messages by turn within them, give the conversations in reply order, without quotes.

Defined cases: texts of any length are read whole; null and empty texts are messages without own text; a message with no link is a
thread of its own; a passage found only in the message itself or in later ones links with nothing;
rows that share conversation and turn are one message for linking and get a row each; null
conversation ids form one conversation and null turns come first; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .cases import NULL_ID, known, shown
from .components import connected_components
from .scratch import Scratch

_MARKS = re.compile(r"\A[ \t]*((?:>[ \t]?)+)")
_BLANKS = re.compile(r"\s+")
#: Fewer words are no run to look for; words of an anchor.
RUN_LEAST, ANCHOR = 3, 8
#: A line that says whom the following quote is from.
_ANNOUNCED = re.compile(r"[^>:]{0,120}(?::\d\d[^>:]{0,120}){0,2}\b(?:wrote|writes|schrieb|a écrit|escribió|escribe)[ \t]*:[ \t]*\Z", re.IGNORECASE)


def normalise(text: str) -> str:
    return _BLANKS.sub(" ", text).strip().casefold()


def split_quotes(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(own text, [(level, quoted passage)]) of a message; lines that announce a quote are in neither."""
    own, quoted, level = [], [], 0
    for line in text.split("\n"):
        m = _MARKS.match(line)
        depth, rest = (m[1].count(">"), line[m.end() :]) if m else (0, line)
        if not depth:
            own.append(rest)
        elif depth == level:
            quoted[-1][1].append(rest)
        else:
            if not level:
                last = next((i for i in range(len(own) - 1, max(len(own) - 3, -1), -1) if own[i].strip()), None)
                if last is not None and _ANNOUNCED.match(own[last][:400]):
                    del own[last:]
            quoted.append((depth, [rest]))
        level = depth
    return "\n".join(own).strip("\n"), [(d, "\n".join(lines)) for d, lines in quoted]


def _hash(text: str) -> int | None:
    plain = normalise(text)
    return int.from_bytes(hashlib.blake2b(plain.encode(), digest_size=8).digest(), "big", signed=True) if plain else None


def _parts(text: str) -> list[str]:
    lines = [line for line in text.split("\n") if line.strip()]
    return [*re.split(r"\n\s*\n", text), *lines, *map("\n".join, zip(lines, lines[1:]))] if text else []


def _hashes(parts: list[str]) -> list[int]:
    return sorted({h for h in map(_hash, parts) if h is not None})


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own_text, own_keys, quotes = [], [], []
        for text in batch.column(3).to_pylist():
            own, passages = split_quotes(text or "")
            own_text.append(own)
            own_keys.append(_hashes([own, *_parts(own)]))
            quotes.append([{"level": d, "nth": i, "hash": h, "parts": _hashes(_parts(p)), "plain": normalise(p)} for i, (d, p) in enumerate(passages) if (h := _hash(p)) is not None])
        quote = pa.struct([("level", pa.int32()), ("nth", pa.int32()), ("hash", pa.int64()), ("parts", pa.list_(pa.int64())), ("plain", pa.string())])
        yield pa.record_batch([*batch.columns[:3], pa.array(own_text, type=pa.string()), pa.array(own_keys, type=pa.list_(pa.int64())),
                               pa.array(quotes, type=pa.list_(quote))], names=["conv_id", "turn", "role", "own_text", "own_keys", "quotes"])


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([*batch.columns[:2], pa.array([normalise(t or "") for t in batch.column(2).to_pylist()], type=pa.string())], names=["conv_id", "origin", "text"])


def _runs(text: str, size: str) -> str:
    """All runs of so many words of a normalised text, as SQL."""
    words = f"split({text}, ' ')"
    return f"array_distinct(transform(sequence(1, size({words}) - {size} + 1), i -> xxhash64(array_join(slice({words}, i, {size}), ' '))))"


def _linked_runs(parsed: DataFrame, asked: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links`` and those of the passages (.., plain) that are a run of words of an earlier message."""
    size = F.least(F.size(F.split("plain", " ")), F.lit(ANCHOR)).alias("size")
    open_ = scratch.save(asked.select("*", size).where(F.col("size") >= RUN_LEAST), "open-runs")
    sizes = [r["size"] for r in open_.select("size").distinct().collect()]  # ANCHOR at most
    if not sizes:
        return links
    texts = parsed.join(open_.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", "own_text").mapInArrow(_plain, "conv_id long, origin long, text string")
    texts = scratch.save(texts.where("text <> ''"), "plain-texts")
    runs = None
    for k in sizes:
        some = texts.where(F.size(F.split("text", " ")) >= k).select("conv_id", "origin", F.lit(k).alias("size"), F.explode(F.expr(_runs("text", str(k)))).alias("run"))
        runs = some if runs is None else runs.unionByName(some)
    passage, key = ["conv_id", "turn", "level", "nth", "hash"], ["conv_id", "size", "run"]
    wanted = scratch.save(open_.select(*passage, "size", "plain", F.explode(F.expr(_runs("plain", "size"))).alias("run")), "wanted-runs")
    runs = scratch.save(runs.join(wanted.select(*key).distinct(), key, "left_semi"), "met-runs")
    counts = runs.groupBy(*key).agg(F.count("*").alias("owners"))
    # A passage is in no message that lacks one of its anchors, so the rarest one is enough to find all that have it.
    rare = wanted.join(counts, key).groupBy(*passage, "size", "plain").agg(F.min_by("run", F.struct("owners", "run")).alias("run"))
    near = rare.join(runs, key).where("origin < turn").join(texts, ["conv_id", "origin"])
    whole = F.contains(F.concat(F.lit(" "), "text", F.lit(" ")), F.concat(F.lit(" "), "plain", F.lit(" ")))
    return scratch.save(links.unionByName(near.where(whole).groupBy(*passage).agg(F.min("origin").alias("origin"))), "run-links")


def link_quotes(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """(conv_id, thread_turn, turn, role, parent_turn, n_quotes, n_links, own_text), in reply order."""
    scratch = Scratch(spark, "quotes")
    parsed = scratch.save(conversations.select(known("conv_id").alias("conv_id"), known("turn").alias("turn"), F.col("role").cast("string").alias("role"), "text")
                          .mapInArrow(_parse, "conv_id long, turn long, role string, own_text string, own_keys array<bigint>, "
                                              "quotes array<struct<level:int,nth:int,hash:bigint,parts:array<bigint>,plain:string>>"), "parsed")
    asked = parsed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.nth", "q.hash", "q.parts", "q.plain")
    # Only hashes that someone quotes matter; the earliest owner of each is one row.
    owned = parsed.select("conv_id", "turn", F.explode("own_keys").alias("hash"))
    origin = owned.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    passage = ["conv_id", "turn", "level", "nth", "hash"]
    links = scratch.save(asked.drop("parts", "plain").join(origin, ["conv_id", "hash"]).where("origin < turn"), "links")
    links = _linked_runs(parsed, asked.join(links, passage, "left_anti").drop("parts"), links, scratch)
    rest = scratch.save(asked.join(links, passage, "left_anti").select(*passage, F.explode("parts").alias("part")).distinct(), "rest")
    if not rest.isEmpty():
        # A part has one earliest owner, so a passage has no more candidates than parts.
        first = rest.join(origin.withColumnRenamed("hash", "part"), ["conv_id", "part"]).where("origin < turn").select(*passage, "origin").distinct()
        has = owned.select("conv_id", F.col("turn").alias("origin"), F.col("hash").alias("part")).distinct()
        support = first.join(rest, passage).join(has, ["conv_id", "origin", "part"], "left_semi").groupBy(*passage, "origin").agg(F.count("*").alias("n"))
        best = support.groupBy(*passage).agg(F.min_by("origin", F.struct(-F.col("n"), F.col("origin"))).alias("origin"))
        links = scratch.save(links.unionByName(best), "all-links")
    parents = (links.groupBy("conv_id", "turn").agg(F.min_by("origin", F.struct(F.when(F.col("level") == 1, 0).otherwise(1), "nth")).alias("parent_turn"),
                                                    F.count("*").alias("n_links")))
    edges = links.select(F.xxhash64("conv_id", "turn").alias("a"), F.xxhash64("conv_id", "origin").alias("b"))
    thread = connected_components(edges, scratch)
    messages = parsed.select("conv_id", "turn", "role", "own_text", F.size("quotes").cast("long").alias("n_quotes"), F.xxhash64("conv_id", "turn").alias("node"))
    placed = messages.join(thread, "node", "left")
    first = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("turn").alias("thread_turn"))
    out = (placed.join(first, "component", "left").join(parents, ["conv_id", "turn"], "left")
           .withColumn("thread_turn", F.coalesce("thread_turn", "turn")).orderBy("conv_id", "thread_turn", "turn"))
    return out.select(shown("conv_id"), shown("thread_turn"), shown("turn"), "role", F.nullif(F.col("parent_turn"), F.lit(NULL_ID)).alias("parent_turn"),
                      "n_quotes", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "own_text")
