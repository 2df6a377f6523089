"""What events reach, from what their names reach, without a row for each event and dependent.

Definitions are numbered by (file, id), so a file is a range of places and a *chunk* a range of whole
files.  What a name reaches is one row for each chunk: its places as one sorted array, with the first
places of their files and the projects.  An event's names meet as such rows; their union is one sort
of packed numbers for thousands of events at a time, and its counts per file are lengths of runs, as
places of a file lie together.  Only counts are written.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..durable import Scratch
from .ranking import ordered_starts

#: Places of a chunk; a file is never cut.
CHUNK = 65_536
#: Places held before those of one event and chunk are united.
HELD = 4_000_000
#: Distinct numbers are found by a flag for each, up to so many bytes, else by a sort.
FLAGS = 1 << 27
#: Changed names that are counted at a time, and those of events that list all their files; bytes of a chunk's table of bits, and of what is united at a time; rows that are sent to all executors.
SLICE, LISTED, TABLE, TOGETHER, SENT = 400_000, 131_072, 1 << 27, 1 << 21, 200_000
#: Changed names of a slice, each of which is sent all that names reach; bytes of these that a task holds.
DEALT, KEPT = 6_000_000, 1 << 26


def numbered(definitions: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, place, file, chunk, project_id): ``file`` is the place of the first definition of the same file."""
    rows = definitions.select("id", "file_path", "project_id").withColumn("one", F.lit(1).cast("long"))
    placed = ordered_starts(rows, scratch, [F.asc_nulls_first("file_path"), F.asc("id"), F.asc_nulls_first("project_id")], "one", "place")
    first = placed.groupBy("file_path").agg(F.min("place").alias("file"))
    both = placed.join(first.withColumnRenamed("file_path", "_path"), F.col("file_path").eqNullSafe(F.col("_path")))
    return scratch.save(both.select("id", "place", "file", F.expr(f"file div {CHUNK}").alias("chunk"), "project_id", "file_path"), "numbered", release=False)


def packed(reach: DataFrame, places: DataFrame) -> DataFrame:
    """(name, chunk, depth, places, projects) from (event_id, id, depth) of names; places are counted from the chunk's start."""
    rows = reach.join(places, "id").select(F.col("event_id").alias("name"), "chunk", "depth", (F.col("place") - F.col("chunk") * CHUNK).cast("int").alias("place"), "project_id")
    return rows.groupBy("name", "chunk").agg(F.max("depth").alias("depth"), F.collect_set("place").alias("places"), F.collect_set("project_id").alias("projects"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def _unique(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, int]:
    """Distinct group * span + value in order, and the span, which is above all values."""
    span = int(value.max(initial=0)) + 1
    key = group * span + value
    size = (int(group.max(initial=0)) + 1) * span
    if size > FLAGS:
        return np.unique(key), span
    flags = np.zeros(size, dtype=bool)
    flags[key] = True
    return np.flatnonzero(flags), span


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (event, chunk, depth, places, files, projects), those of one event and chunk together, to one row each."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(batch: pa.RecordBatch) -> pa.RecordBatch:
        event, chunk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.flatnonzero(np.r_[True, (event[1:] != event[:-1]) | (chunk[1:] != chunk[:-1])])
        group = np.repeat(np.arange(len(cut)), np.diff(np.r_[cut, len(event)]))
        n, places = _lists(batch.column(3))
        key, span = _unique(np.repeat(group, n), places)
        n, files = _lists(batch.column(4))
        start, width = _unique(np.repeat(group, n), files)
        starts_of, starts = np.divmod(start, width)
        # A place belongs to the last file that starts before it, of those its group reaches.
        counts = np.diff(np.searchsorted(key, np.r_[starts_of * span + starts, len(cut) * span]))
        held_by = np.diff(np.searchsorted(key, np.arange(len(cut) + 1) * span))
        n, projects = _lists(batch.column(5))
        names, at = np.unique(projects, return_inverse=True)
        of, project = np.divmod(*_unique(np.repeat(group, n), at.astype(np.int64)))
        ends = lambda x: pa.array(np.searchsorted(x, np.arange(len(cut) + 1)).astype(np.int32))
        base = chunk[cut][starts_of] * CHUNK
        return pa.RecordBatch.from_arrays([
            pa.array(event[cut]), pa.array(held_by.astype(np.int64)), pa.array(np.maximum.reduceat(batch.column(2).to_numpy(), cut)),
            pa.ListArray.from_arrays(ends(of), pa.array(names[project] if len(names) else np.zeros(0, np.int64), type=pa.int64())),
            pa.ListArray.from_arrays(ends(starts_of), pa.array((starts + base).astype(np.int64))), pa.ListArray.from_arrays(ends(starts_of), pa.array(counts.astype(np.int32)))],
            names=["event_id", "n", "depth", "projects", "files", "counts"])

    def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        event, chunk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        # The last group of a batch may go on in the next one.
        tail = int(np.flatnonzero((event != event[-1]) | (chunk != chunk[-1]))[-1]) + 1 if (event[0], chunk[0]) != (event[-1], chunk[-1]) else 0
        if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (event[0], chunk[0]):
            yield flush(one(held))
            held, size = [], 0
        if tail:
            yield flush(one([*held, batch.slice(0, tail)]))
            held, size = [], 0
        held.append(batch.slice(tail))
        size += len(held[-1].column(3).flatten())
        if size > HELD:
            whole = one(held)
            union = lambda k, kind: pa.array([np.unique(whole.column(k).flatten().to_numpy(zero_copy_only=False))], type=pa.list_(kind))  # noqa: E731, B023
            held = [pa.RecordBatch.from_arrays([whole.column(0).slice(0, 1), whole.column(1).slice(0, 1), pa.array([max(whole.column(2).to_pylist())], type=pa.int32()),
                                                union(3, pa.int32()), union(4, pa.int32()), union(5, pa.int64())], names=whole.schema.names)]
            size = len(held[-1].column(3).flatten())
    if held:
        yield flush(one(held))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one chunk each, in the order in which chunks come."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        chunk = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if held and hi > lo and held[0].column(0)[0].as_py() != chunk[lo]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _bits(n: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A row of ``width`` bytes for each list: the bits ``at``."""
    table, ends = np.zeros((len(n), width), dtype=np.uint8), np.r_[0, np.cumsum(n)]
    step = max(1, FLAGS // 4 // (8 * width))
    for lo in range(0, len(n), step):
        hi = min(lo + step, len(n))
        flags = np.zeros((hi - lo, 8 * width), dtype=bool)
        flags[np.repeat(np.arange(hi - lo), n[lo:hi]), at[ends[lo] : ends[hi]]] = True
        table[lo:hi] = np.packbits(flags, axis=1, bitorder="little")
    return table


def _by_bits(first: np.ndarray, slot: np.ndarray, n: np.ndarray, places: np.ndarray, starts: np.ndarray, room: int) -> Iterator[tuple[np.ndarray, np.ndarray]] | None:
    """Events and their counts, a column for each file; None where the table of bits would not fit ``room``.

    Event i has the lists ``slot[first[i]:first[i + 1]]``.  Each file begins with a word of its own.
    """
    size = np.diff(np.r_[starts, max(int(places.max()), int(starts[-1])) + 1])
    word = np.dtype(np.uint64 if size.sum() >= 32 * len(size) else np.uint8)
    words = -(-size // (8 * word.itemsize))
    base = np.cumsum(words) - words
    width = int(words.sum()) * word.itemsize
    if len(n) * width > room:
        return None
    of = np.searchsorted(starts, places, side="right") - 1
    table = _bits(n, base[of] * 8 * word.itemsize + places - starts[of], width).view(word)

    def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(16, TOGETHER // width)
        for lo in range(0, len(first) - 1, step):
            many = np.diff(first[lo : lo + step + 1])
            event = np.argsort(-many, kind="stable")
            many, at = many[event], first[lo + event]
            union = table[slot[at]]
            for k in range(1, int(many[0])):
                more = int(np.searchsorted(-many, -k))
                np.bitwise_or(union[:more], table[slot[at[:more] + k]], out=union[:more])
            yield lo + event, np.add.reduceat(np.bitwise_count(union), base, axis=1, dtype=np.int32)

    return each()


def _by_lists(first: np.ndarray, slot: np.ndarray, n: np.ndarray, places: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same from the lists alone, some events at a time."""
    lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), pa.array(places.astype(np.int32)))
    of = np.searchsorted(starts, places, side="right") - 1
    heads = pa.ListArray.from_arrays(lists.offsets, pa.array(starts[of].astype(np.int32)))
    step = max(1, min(1024, TOGETHER // (8 * len(starts))))
    for lo in range(0, len(first) - 1, step):
        hi = min(lo + step, len(first) - 1)
        mine = pa.array(slot[first[lo] : first[hi]])
        event = np.repeat(np.arange(lo, hi), np.diff(first[lo : hi + 1]))
        none = pa.ListArray.from_arrays(np.zeros(len(event) + 1, dtype=np.int32), pa.array(np.zeros(0, np.int64)))
        rows = pa.RecordBatch.from_arrays([pa.array(event), pa.array(np.zeros(len(event), np.int64)), pa.array(np.zeros(len(event), np.int32)), lists.take(mine), heads.take(mine), none],
                                          names=["event", "chunk", "depth", "places", "files", "projects"])
        counts = np.zeros((hi - lo, len(starts)), dtype=np.int32)
        for united in _unite(iter([rows])):
            many, files = _lists(united.column(4))
            counts[np.repeat(united.column(0).to_numpy() - lo, many), np.searchsorted(starts, files)] = united.column(5).flatten().to_numpy()
        yield np.arange(lo, hi), counts


class _Chunks:
    """What names reach, by chunks: held in memory up to ``KEPT`` bytes, the rest in a file of the task's own."""

    def __init__(self, spilled) -> None:
        self.spilled, self.parts, self.size, self.end = spilled, [], 0, 0

    def add(self, chunk: int, starts: np.ndarray, label: np.ndarray, name: np.ndarray, n: np.ndarray, places: np.ndarray) -> None:
        kind = np.uint16 if places.max(initial=0) < 1 << 16 else np.int32
        places, at = places.astype(kind), None
        if self.size + places.nbytes > KEPT:
            at, size = self.end, len(places)
            self.spilled.seek(at)
            self.spilled.write(places.tobytes())
            self.end += places.nbytes
            places = (at, size, kind)
        else:
            self.size += places.nbytes
        self.parts.append((chunk, starts, label, name.astype(np.int32), n.astype(np.int32), places))

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for *rest, places in self.parts:
            if isinstance(places, tuple):
                at, size, kind = places
                self.spilled.seek(at)
                places = np.frombuffer(self.spilled.read(size * np.dtype(kind).itemsize), dtype=kind)
            yield *rest, places.astype(np.int32)


def _counted(events: np.ndarray, event: np.ndarray, which: np.ndarray, n_known: int, depths: np.ndarray, of_name: pa.Array, chunks: _Chunks, top: int | None, room: int) -> Iterator[pa.RecordBatch]:
    """The digests of events that change the names ``which``, pair by pair in the order of ``event``."""
    files: list[tuple] = []
    labels: list[tuple] = []
    projects: list[tuple] = []
    total, depth = np.zeros(len(events), np.int64), np.zeros(len(events), np.int32)
    np.maximum.at(depth, event, depths[which])
    for lo in range(0, len(events), 8192):
        a, b = np.searchsorted(event, [lo, min(lo + 8192, len(events))])
        n, held = _lists(of_name.take(pa.array(which[a:b])))
        ids, number = np.unique(held, return_inverse=True)
        of, project = np.divmod(*_unique(np.repeat(event[a:b], n), number.astype(np.int64)))
        projects.append((of, ids[project] if len(ids) else ids))
    for chunk, starts, label, name, n, places in chunks:
        slot = np.full(n_known, -1)
        slot[name] = np.arange(len(name))
        mine = slot[which] >= 0
        met, first = np.unique(event[mine], return_index=True)
        if not len(met):
            continue
        shape = np.r_[first, mine.sum()], slot[which[mine]], n, places, starts
        by_label = np.argsort(label, kind="stable")
        names, label_at = np.unique(label[by_label], return_index=True)
        for at, counts in _by_bits(*shape, room) or _by_lists(*shape):
            who = met[at]
            total[who] += counts.sum(axis=1)
            if len(names) > 1 or names[0] >= 0:
                sums = np.add.reduceat(counts[:, by_label], label_at, axis=1)
                held = np.add.reduceat((counts > 0)[:, by_label], label_at, axis=1, dtype=np.int32)
                i, k = np.nonzero((sums > 0) & (names >= 0))
                labels.append((who[i].astype(np.int32), names[k], sums[i, k], held[i, k]))
            if top != 0:
                width = counts.shape[1]
                key = counts.astype(np.int64) * width + np.arange(width)[::-1]
                if top is not None and top < width:
                    key = np.partition(key, width - top, axis=1)[:, width - top :]
                key = np.sort(key, axis=1)[:, ::-1]
                i, k = np.nonzero(key >= width)
                count, place = np.divmod(key[i, k], width)
                files.append((who[i].astype(np.int32), count.astype(np.int32), starts[width - 1 - place] + chunk * CHUNK))
    none = np.zeros(0, np.int64)
    who, count, file = (np.concatenate(x) for x in zip(*files)) if files else (none, none, none)
    # Chunks come in the order of places, so equal counts stay in that order.
    order = np.argsort(who * (int(count.max(initial=0)) + 1) - count.astype(np.int64), kind="stable") if len(who) else none
    who, count, file = who[order], count[order], file[order]
    if top is not None:
        few = np.arange(len(who)) - np.searchsorted(who, who) < top
        who, count, file = who[few], count[few], file[few]
    owner, area, sums, held = (np.concatenate(x) for x in zip(*labels)) if labels else (none, none, none, none)
    order = np.lexsort((area, owner))
    owner, area, sums, held = owner[order], area[order], sums[order], held[order]
    if len(owner):
        new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (area[1:] != area[:-1])])
        owner, area, sums, held = owner[new], area[new], np.add.reduceat(sums, new), np.add.reduceat(held, new)
    of, project = (np.concatenate(x) for x in zip(*projects))
    for lo in range(0, len(events), 2048):
        hi = min(lo + 2048, len(events))

        def listed(owners: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
            ends = np.searchsorted(owners, np.arange(lo, hi + 1))  # noqa: B023
            return [pa.ListArray.from_arrays((ends - ends[0]).astype(np.int32), pa.array(v[ends[0] : ends[-1]].astype(np.int64))) for v in values]

        yield pa.RecordBatch.from_arrays([pa.array(events[lo:hi]), pa.array(total[lo:hi]), pa.array(depth[lo:hi]), *listed(of, project), *listed(who, file, count), *listed(owner, area, sums, held)],
                                         names=["event_id", "n", "depth", "projects", "files", "counts", "labels", "label_counts", "label_files"])


def _digest(top: int | None, room: int, together: int = SLICE):
    """Rows (chunk, kind, a, b, v, p) of one slice by chunk and kind, to one row for each of its events.

    Chunk -1: changed names (0, event, name), then names (1, name, depth, , projects); other chunks: files
    (0, first place, label or -1), then names (1, name, , places).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = known = np.zeros(0, np.int64)
        with tempfile.TemporaryFile() as spilled:
            chunks = _Chunks(spilled)
            for rows in _chunks(batches):
                chunk, kind = rows.column(0)[0].as_py(), rows.column(1).to_numpy()
                cut = int(np.searchsorted(kind, 1))
                head, tail = rows.slice(0, cut), rows.slice(cut)
                if not head.num_rows or not tail.num_rows:
                    continue
                if chunk < 0:
                    known, order = np.unique(tail.column(2).to_numpy(), return_index=True)
                    tail = tail.take(pa.array(order))
                    pair = np.stack((head.column(2).to_numpy(), head.column(3).to_numpy()), axis=1)
                    at = np.minimum(np.searchsorted(known, pair[:, 1]), len(known) - 1)
                    there = known[at] == pair[:, 1]
                    events, event = np.unique(pair[there, 0], return_inverse=True)
                    event, which = np.divmod(np.unique(event * len(known) + at[there]), len(known))
                    depths, of_name = tail.column(3).to_numpy().astype(np.int32), tail.column(5)
                    del pair, at, there
                elif len(events):
                    n, places = _lists(tail.column(4))
                    chunks.add(chunk, head.column(2).to_numpy() - chunk * CHUNK, head.column(3).to_numpy(), np.searchsorted(known, tail.column(2).to_numpy()), n, places)
            if not len(events):
                return
            # Events are taken by whole groups of up to ``together`` changed names, each over all chunks.
            first = np.searchsorted(event, np.arange(len(events) + 1))
            lo = 0
            while lo < len(events):
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + together, side="right")) - 1)
                mine = slice(first[lo], first[hi])
                yield from _counted(events[lo:hi], event[mine] - lo, which[mine], len(known), depths, of_name, chunks, top, room)
                lo = hi

    return run


def labels_of(places: DataFrame, label: Column) -> DataFrame:
    """(label_id, label): what ``label`` makes of file paths, known by the first place of its files; null is none."""
    return places.where("file = place").select("file", label.alias("label")).where("label IS NOT NULL").groupBy("label").agg(F.min("file").alias("label_id"))


def digests(changed: DataFrame, names: DataFrame, places: DataFrame, top: int | None, label: Column | None = None, slice_rows: int = SLICE, room: int = TABLE) -> DataFrame:
    """One row for each event (event_id, name) that reaches something, from ``packed`` rows of names.

    (event_id, n, depth, projects, files, counts, labels, label_counts, label_files): definitions reached, the first
    ``top`` files (None: all) by definitions, ties by path, and definitions and files for each label of paths.
    """
    # Without lists an event is a few numbers, so more of them may be counted at a time.
    together = slice_rows if top != 0 or label is not None else 4 * slice_rows
    slices = max(changed.sparkSession.sparkContext.defaultParallelism, -(-changed.count() // max(DEALT, together)))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    long, no_v, no_p = (lambda x: F.lit(x).cast("long")), F.lit(None).cast("array<int>").alias("v"), F.lit(None).cast("array<bigint>").alias("p")
    kind = lambda k: F.lit(k).alias("kind")
    starts = changed.select(F.pmod(F.xxhash64("event_id"), F.lit(slices)).cast("int").alias("slice"), long(-1).alias("chunk"), kind(0), F.col("event_id").alias("a"), F.col("name").alias("b"), no_v, no_p)
    known = names.groupBy("name").agg(F.max("depth").cast("long").alias("b"), F.array_distinct(F.flatten(F.collect_list("projects"))).alias("p"))
    known = known.select(every, long(-1).alias("chunk"), kind(1), F.col("name").alias("a"), "b", no_v, "p")
    heads = places.where("file = place").select("file", "chunk", (label if label is not None else F.lit(None).cast("string")).alias("label"))
    if label is not None:
        heads = heads.join(labels_of(places, label), "label", "left").withColumnRenamed("label_id", "b")
    else:
        heads = heads.withColumn("b", F.lit(None).cast("long"))
    heads = heads.select(every, "chunk", kind(0), F.col("file").alias("a"), F.coalesce("b", long(-1)).alias("b"), no_v, no_p)
    held = names.select(every, "chunk", kind(1), F.col("name").alias("a"), long(0).alias("b"), F.col("places").alias("v"), no_p)
    rows = starts.unionByName(known).unionByName(heads).unionByName(held)
    dealt = rows.repartitionById(slices, F.col("slice")).drop("slice").sortWithinPartitions("chunk", "kind", "a")
    return dealt.mapInArrow(_digest(top, room, together), "event_id long, n long, depth int, projects array<bigint>, files array<bigint>, counts array<bigint>, labels array<bigint>, label_counts array<bigint>, label_files array<bigint>")


def few(rows: DataFrame, most: int = SENT) -> DataFrame:
    """``rows`` to be sent to all executors if there are at most ``most`` of them."""
    return F.broadcast(rows) if rows.count() <= most else rows


def file_counts(digest: DataFrame, places: DataFrame) -> DataFrame:
    """(event_id, file_path, affected, rank): largest first, ties by path; no event is shuffled for its files where these are few."""
    each = digest.select("event_id", F.posexplode(F.arrays_zip("files", "counts")).alias("pos", "f"))
    each = each.select("event_id", F.col("f.files").alias("file"), F.col("f.counts").alias("affected"), (F.col("pos") + 1).alias("rank"))
    return each.join(few(places.where("file = place").select("file", "file_path")), "file").select("event_id", "file_path", "affected", "rank")


def label_counts(digest: DataFrame, labels: DataFrame) -> DataFrame:
    """(event_id, label, definitions, files) from ``labels_of`` the digest's label."""
    each = digest.select("event_id", F.explode(F.arrays_zip("labels", "label_counts", "label_files")).alias("f"))
    each = each.select("event_id", F.col("f.labels").alias("label_id"), F.col("f.label_counts").alias("definitions"), F.col("f.label_files").alias("files"))
    return each.join(few(labels), "label_id").select("event_id", "label", "definitions", "files")


def totals(digest: DataFrame) -> DataFrame:
    """(event_id, total_dependents, affected_services, max_depth)."""
    return digest.select("event_id", F.col("n").alias("total_dependents"), F.size("projects").cast("long").alias("affected_services"), F.col("depth").alias("max_depth"))


def services(digest: DataFrame) -> DataFrame:
    """(event_id, project_id): the projects of what each event reaches."""
    return digest.select("event_id", F.explode("projects").alias("project_id"))
