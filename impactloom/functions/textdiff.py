"""Edit semantics: comment stripping, signatures, edit classes, changed symbols and spans."""

from __future__ import annotations

import re
from bisect import bisect_left
from hashlib import md5

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import spans

# Extensions by comment style, the forms of definitions, and how dangerous an edit is.
C_LIKE = ("rs", "c", "cc", "cpp", "h", "hpp", "java", "js", "jsx", "ts", "tsx", "go", "kt", "swift", "scala")
HASH_LIKE = ("py", "rb", "sh", "pl")
DEFINITION_LINE = (r"^\+\s*(?:pub\s+|async\s+|export\s+|public\s+|private\s+)*(?:fn|def|function|class|struct|impl|interface|trait)\s+([A-Za-z_][A-Za-z0-9_]*)")
_HEADER, TAIL = r"\b(?:fn|def|function)\s+%s\s*[(<]", 199
DANGER = {"unknown": 1.0, "contract-break": 1.0, "cosmetic": 0.0, "body-edit": 0.5}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def strip_comments(text: Column, ext: Column) -> Column:
    """The text without comments (by extension) and white space; string literals are not protected."""
    c_like = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    plain = F.when(ext.isin(*C_LIKE), c_like).when(ext.isin(*HASH_LIKE), F.regexp_replace(text, r"#[^\n]*", "")).otherwise(text)
    return F.regexp_replace(plain, r"\s+", "")


def is_cosmetic(old: Column, new: Column, ext: Column) -> Column:
    both_empty = (F.coalesce(F.length(old), F.lit(0)) == 0) & (F.coalesce(F.length(new), F.lit(0)) == 0)
    return ~both_empty & (strip_comments(F.coalesce(old, F.lit("")), ext) == strip_comments(F.coalesce(new, F.lit("")), ext))


def _closers(text: str, opening: str, closing: str) -> tuple[list[int], dict[int, int]]:
    """Where brackets open, and where each of those closes: one scan; what never closes has no entry."""
    opens, waiting, ends = [], [], {}
    for m in re.finditer(f"[{re.escape(opening + closing)}]", text):
        if m[0] == opening:
            opens.append(m.start())
            waiting.append(m.start())
        elif waiting:
            ends[waiting.pop()] = m.start()
    return opens, ends


def _signature(text: str | None, name: str | None) -> str | None:
    """The header of a function: its parameters and what follows them up to the first of ``{``, ``:`` and ``;``.

    Parameters that never close go on to the end of the text.
    """
    if not text or not name:
        return None
    m = re.search(_HEADER % re.escape(name), text)
    at = text.find("(", m.start()) if m else -1
    if at < 0:
        return None
    end = _closers(text[at:], "(", ")")[1].get(0)
    if end is None:
        return text[m.start() :]
    after = at + end + 1
    return text[m.start() : after] + re.split("[{:;]", text[after : after + TAIL], maxsplit=1)[0]


def _contracts(text: str | None) -> list[dict]:
    """Of each function's first header in a text the name and a digest of its signature without white space."""
    text, seen, out = text or "", set(), []
    ends = _closers(text, "(", ")")[1]
    for m in re.finditer(_HEADER % r"([A-Za-z_]\w*)", text):
        at = text.find("(", m.start())
        if at < 0 or m[1] in seen:
            continue
        seen.add(m[1])
        after = ends.get(at, len(text)) + 1
        sig = text[m.start() : after] + re.split("[{:;]", text[after : after + TAIL], maxsplit=1)[0]
        out.append({"name": m[1], "digest": md5(re.sub(r"(?a)\s+", "", sig).encode()).hexdigest()})
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("digest", T.StringType())])))
def contracts(text: pd.Series) -> pd.Series:
    return pd.Series([_contracts(t) for t in text])


@F.pandas_udf(T.StringType())
def signature(text: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([_signature(t, n) for t, n in zip(text, name)], dtype=object)


def normalised(sig: Column) -> Column:
    return F.regexp_replace(sig, r"\s+", "")


def readable(sig: Column) -> Column:
    return F.trim(F.regexp_replace(sig, r"\s+", " "))


def contract_breaks(files: DataFrame, names: DataFrame) -> DataFrame:
    """(event_id, path, name, before, after) of signatures that are gone or differ; additions are not breaks."""
    both = files.join(names, "event_id").withColumn("before", signature("old_text", "name")).withColumn("after", signature("new_text", "name"))
    broken = F.col("before").isNotNull() & (F.col("after").isNull() | (normalised(F.col("before")) != normalised(F.col("after"))))
    return both.where(broken).select("event_id", "path", "name", readable(F.col("before")).alias("before"), readable(F.col("after")).alias("after"))


def broken_names(files: DataFrame, names: DataFrame) -> DataFrame:
    """(event_id, name) of changed names whose signature in some file is gone or differs; additions are not breaks.

    As ``contract_breaks`` for names that are identifiers, but each text is scanned once for all names and texts
    never meet names: an event of many files and names costs the sum of both.  Files are one row per event and path.
    """
    return broken_among(files.select("event_id", "path", contracts("old_text").alias("old"), contracts("new_text").alias("new")), names)


def broken_among(files: DataFrame, names: DataFrame) -> DataFrame:
    """``broken_names`` of files (event_id, path, old, new), which have the ``contracts`` of both texts."""
    of = lambda c: files.select("event_id", "path", F.explode(c).alias("c")).select("event_id", "path", "c.name", F.col("c.digest").alias(c))
    both = of("old").join(names, ["event_id", "name"], "left_semi").join(of("new"), ["event_id", "path", "name"], "left")
    return both.where("new IS NULL OR old <> new").select("event_id", "name").distinct()


def edit_class(n_files: Column, any_break: Column, all_cosmetic: Column) -> Column:
    return F.when(n_files == 0, "unknown").when(any_break, "contract-break").when(all_cosmetic, "cosmetic").otherwise("body-edit")


def edit_danger(edit: Column) -> Column:
    return F.when(edit == "cosmetic", 0.0).when(edit == "body-edit", 0.5).otherwise(1.0)


def hunk_lines(diff: DataFrame) -> DataFrame:
    """(path, line) changed on the new side, from rows (path, header) of ``@@ -a,b +c,d @@`` headers.

    A pure deletion (count 0) still marks its line.
    """
    start = F.regexp_extract("header", r"\+(\d+)", 1).cast("long")
    count = F.regexp_extract("header", r"\+\d+,(\d+)", 1)
    n = F.greatest(F.when(count == "", F.lit(1)).otherwise(count.cast("long")), F.lit(1))
    return diff.where(F.regexp_extract("header", r"\+(\d+)", 1) != "").select("path", F.explode(F.sequence(start, start + n - 1)).alias("line")).distinct()


def plain_path(path: Column) -> Column:
    """A path with forward slashes and without leading dots and slashes."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^[./]+", "")


def changed_symbols(lines: DataFrame, definitions: DataFrame) -> DataFrame:
    """Definitions whose span overlaps the range of changed lines of their file."""
    span = lines.groupBy(plain_path(F.col("path")).alias("base")).agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
    return spans.meeting(definitions, span).select("name", "file_path").distinct()


def changed_functions(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """(event_id, name): functions of the new texts that hold a changed line.

    ``files``: (event_id, path, new_text); ``hunks``: (event_id, path, lo, hi), ranges of changed lines.
    What lies between two ranges is not changed.
    """
    return functions_meeting(files.select("event_id", "path", function_spans("new_text").alias("spans")), hunks)


def functions_meeting(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """``changed_functions`` of files (event_id, path, spans), which have the ``function_spans`` of the new text."""
    found = files.select("event_id", "path", F.explode("spans").alias("s")).select("event_id", "path", "s.name", "s.start", "s.end")
    ours, theirs = spans.binned(found, "start", "end", "bin"), spans.binned(hunks.where("lo IS NOT NULL AND hi IS NOT NULL"), "lo", "hi", "bin")
    same = [ours[c] == theirs[c] for c in ("event_id", "path", "bin")]
    return ours.join(theirs, [*same, (ours["start"] <= theirs["hi"]) & (ours["end"] >= theirs["lo"])], "left_semi").select("event_id", "name").distinct()


def classify_changes(files: DataFrame, names: DataFrame, breaks: DataFrame | None = None) -> DataFrame:
    """(event_id, files, edit_class, broken) of events with files (event_id, path, old_text, new_text).

    ``broken``: how many signatures of changed names are gone or differ, or how many rows (event_id, ..) of ``breaks``.
    """
    return classes_of(files.select("event_id", is_cosmetic(F.col("old_text"), F.col("new_text"), extension(F.col("path"))).alias("cosmetic")), breaks if breaks is not None else contract_breaks(files, names))


def classes_of(files: DataFrame, breaks: DataFrame) -> DataFrame:
    """``classify_changes`` of files (event_id, cosmetic)."""
    per = files.groupBy("event_id").agg(F.count("*").alias("files"), F.bool_and("cosmetic").alias("cosmetic"))
    broken = breaks.groupBy("event_id").agg(F.count("*").alias("broken"))
    rows = per.join(broken, "event_id", "left").fillna({"broken": 0})
    return rows.select("event_id", "files", edit_class(F.col("files"), F.col("broken") > 0, F.col("cosmetic")).alias("edit_class"), "broken")


def header_symbols(diff_lines: Column) -> Column:
    """The name a ``+`` line defines, or an empty string."""
    return F.regexp_extract(diff_lines, DEFINITION_LINE, 1)


def _spans(text: str | None) -> list[dict]:
    """Functions with bodies in braces: name, first and last line; a body that never closes goes on to the end."""
    text = text or ""
    opens, ends = _closers(text, "{", "}")
    lines = [m.start() for m in re.finditer("\n", text)]
    out = []
    for m in re.finditer(_HEADER % r"([A-Za-z_]\w*)", text):
        k = bisect_left(opens, m.end())
        if k < len(opens):
            out.append({"name": m[1], "start": bisect_left(lines, m.start()) + 1, "end": bisect_left(lines, ends.get(opens[k], len(text))) + 1})
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def function_spans(text: pd.Series) -> pd.Series:
    return pd.Series([_spans(t) for t in text])
