"""Content-addressed transport: priorities, pages, chunks, index, archives of bounded size and their restoration."""

from __future__ import annotations

import hashlib
import io
import lzma
import tarfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.canonical_json import canonical_json
from tallyspark.operators.folds import next_fit
from tallyspark.operators.snapshot import MOST_PART_BYTES
from tallyspark.sources.store import settled

#: The place of an object in the transport by the role of its references; other roles have OTHER, objects without references UNREFERENCED.
PRIORITY = {"model": 0, "plan": 0, "science.comparison": 0, "performance.summary": 0, "control.state": 0, "science.history": 1, "performance.window": 3, "performance.full": 3}
OTHER, UNREFERENCED, OVERHEAD = 5, 10, 1024


def object_priority(references: DataFrame) -> DataFrame:
    """sha256, priority: the least over all references (sha256, role) of what the role has."""
    table = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    value = F.coalesce(F.try_element_at(table, F.col("role")), F.lit(OTHER))
    return references.groupBy("sha256").agg(F.min(value).alias("priority"))


def page_budget(most_bytes: int) -> int:
    return max(1024, int(0.9 * most_bytes) - 2048)


def check_part_limit(most_bytes: int) -> None:
    """Refuses a limit of a part that is no whole number from 1 to MOST_PART_BYTES."""
    if isinstance(most_bytes, bool) or not isinstance(most_bytes, int) or not 0 < most_bytes <= MOST_PART_BYTES:
        raise ValueError(f"a part of {most_bytes} bytes is out of bounds")


def object_order(objects: DataFrame, priorities: DataFrame, by: str) -> DataFrame:
    """by, name, priority, place of objects (by, name, sha256) in a snapshot's transport: by priority and name; objects without references come last."""
    rows = objects.join(priorities, "sha256", "left").withColumn("priority", F.coalesce("priority", F.lit(UNREFERENCED)))
    return rows.select(by, "name", "priority", (F.row_number().over(W.partitionBy(by).orderBy("priority", "name")) - 1).cast("long").alias("place"))


def packed_size(rows: list[tuple[str, int, bytes]]) -> int:
    return len(_packed(rows))


def transport_units(objects: DataFrame, key: str, budget: int) -> DataFrame:
    """key, offset, bytes, weight, kind of the units that carry objects (key, content): an object whose bytes and OVERHEAD fit the budget is whole; a larger one is compressed, and whole if that fits, with what it takes as weight;
    else it goes in chunks of the budget less OVERHEAD. Only objects above the budget are compressed."""
    step = max(1, budget - OVERHEAD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(key).to_pylist(), batch.column("content").to_pylist()):
                size = len(data)
                weight = size + OVERHEAD
                if weight > budget:
                    taken = packed_size([(str(name), 0, data)])
                    if taken > budget:
                        rows += [(name, at, min(step, size - at), min(step, size - at) + OVERHEAD, "chunk") for at in range(0, size, step)]
                        continue
                    weight = taken + OVERHEAD
                rows.append((name, 0, size, weight, "whole"))
            cells = list(zip(*rows)) or [()] * 5
            yield pa.record_batch([pa.array(cells[0], batch.schema.field(key).type), *(pa.array(c, pa.int64()) for c in cells[1:4]), pa.array(cells[4], pa.string())], names=[key, "offset", "bytes", "weight", "kind"])

    return objects.select(key, "content").mapInArrow(run, f"{key} {dict(objects.dtypes)[key]}, offset long, bytes long, weight long, kind string")


def refined_layout(units: DataFrame, overflowed: DataFrame, by: str) -> DataFrame:
    """by, page, place, name, offset, bytes after the pages named by overflowed (by, page) have turned out too large: one of several units is halved; the first page gives up its only unit to a page of its own, and
    stays for the metadata; any other page of one unit becomes two of half its bytes. Pages are numbered anew, in order. Pages that cannot be made smaller are named by layout_faults.

    units: by, page, place (in its page), name, offset, bytes.
    """
    marked = units.join(overflowed.select(by, "page", F.lit(True).alias("over")), [by, "page"], "left").withColumn("over", F.coalesce("over", F.lit(False)))
    rows = marked.withColumn("n", F.count("*").over(W.partitionBy(by, "page")))
    half = F.greatest(F.lit(1), F.expr("n div 2"))
    middle = F.greatest(F.lit(1), F.expr("bytes div 2")).cast("long")
    alone = F.col("over") & (F.col("n") == 1)
    whole = F.array(F.struct(F.when(F.col("over") & (F.col("n") > 1) & (F.col("place") >= half), 1).when(alone & (F.col("page") == 0), 1).otherwise(0).alias("part"), F.col("offset").cast("long").alias("offset"), F.col("bytes").cast("long").alias("bytes")))
    chunks = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)).cast("long"), middle), lambda at: F.struct((at / middle).cast("int").alias("part"), (F.col("offset") + at).alias("offset"), F.least(middle, F.col("bytes") - at).alias("bytes")))
    cut = rows.select(by, "page", "place", "name", F.explode(F.when(alone & (F.col("page") > 0), chunks).otherwise(whole)).alias("u"))
    cut = cut.select(by, "page", "place", "name", "u.part", "u.offset", "u.bytes")
    # The first page keeps its number even where it has given up its unit.
    kept = cut.select(by, "page", "part").union(units.select(by, F.lit(0).cast("long").alias("page"), F.lit(0).alias("part"))).distinct()
    numbered = kept.withColumn("new", (F.row_number().over(W.partitionBy(by).orderBy("page", "part")) - 1).cast("long"))
    placed = cut.join(numbered, [by, "page", "part"])
    order = W.partitionBy(by, "new").orderBy("place", "offset")
    return placed.select(by, F.col("new").alias("page"), (F.row_number().over(order) - 1).cast("long").alias("place"), "name", "offset", "bytes")


def layout_faults(units: DataFrame, overflowed: DataFrame, by: str) -> DataFrame:
    """by, page, fault of pages of overflowed (by, page) that cannot be made smaller: the first one where it holds metadata alone, and any other whose only unit is of one byte or none."""
    sizes = units.groupBy(by, "page").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    rows = overflowed.select(by, "page").join(sizes, [by, "page"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    fault = F.when(F.col("n") == 0, "metadata").when((F.col("page") > 0) & (F.col("n") == 1) & (F.col("bytes") <= 1), "headers")
    return rows.select(by, "page", fault.alias("fault")).where("fault is not null")


def fitted_layout(units: DataFrame, by: str, too_large: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """units (see refined_layout) on pages of which too_large(units) names none (by, page) any more. Each round refines the pages that overflow, all of them at once; one that cannot be made smaller ends it with an error."""
    while True:
        over = settled(too_large(units).select(by, "page").distinct(), "overflowed")
        if not over.head(1):
            return units
        fault = layout_faults(units, over, by).first()
        if fault:
            raise ValueError(f"page {fault.page} of {fault[by]!r} cannot be made smaller: {fault.fault}")
        units = settled(refined_layout(units, over, by), "layout")


def part_headers(parts: DataFrame, snapshots: DataFrame, by: str) -> DataFrame:
    """by, index, header of each part (by, index) of a snapshot (by, snapshot_identity, index_sha256, maximum_part_bytes): compact JSON that names the snapshot, the index and the part's place."""
    counts = parts.groupBy(by).agg(F.count("*").alias("count"))
    fields = ["count", "index", "index_sha256", "maximum_part_bytes", "snapshot_identity"]
    return parts.join(counts, by).join(snapshots, by).select(by, "index", canonical_json(F.struct(*fields)).alias("header"))


def header_violations(headers: DataFrame, snapshots: DataFrame, by: str) -> DataFrame:
    """by, index, rule of parts' headers (by, index, count, bytes, maximum_part_bytes, snapshot_identity, index_sha256) that are out of bounds, above their own limit, or of another snapshot, index, count or limit than the set's (snapshots)."""
    own = snapshots.select(by, F.col("count").alias("s_count"), F.col("maximum_part_bytes").alias("s_most"), F.col("snapshot_identity").alias("s_identity"), F.col("index_sha256").alias("s_index"))
    rows = headers.join(own, by)
    other = (F.col("count") != F.col("s_count")) | (F.col("maximum_part_bytes") != F.col("s_most")) | (F.col("snapshot_identity") != F.col("s_identity")) | (F.col("index_sha256") != F.col("s_index"))
    rules = {"place": ~F.col("index").between(F.lit(1), F.col("count")), "limit": ~F.col("maximum_part_bytes").between(1, MOST_PART_BYTES), "size": F.col("bytes") > F.col("maximum_part_bytes"), "other_set": other}
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return rows.select(by, "index", F.explode(found).alias("rule"))


def metadata_fits(metadata: DataFrame, by: str, most_bytes: int) -> DataFrame:
    """by, bytes, fits: whether a snapshot's metadata (by, name, content: a few small files) alone, as an archive, is within most_bytes."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("name").to_pylist(), table.column("content").to_pylist()))
        taken = packed_size([(name, 0, data) for name, data in rows])
        return pa.table([[key[0].as_py()], [taken], [taken <= most_bytes]], names=[by, "bytes", "fits"])

    return metadata.select(by, "name", "content").groupBy(by).applyInArrow(run, f"{by} {dict(metadata.dtypes)[by]}, bytes long, fits boolean")


def compaction_groups(items: DataFrame, dependencies: DataFrame) -> DataFrame:
    """record, table_name, segments, bytes of tables of which a record (record, table_name, object, bytes) has at least two segments that nothing depends on (object): those that are written anew as one."""
    free = items.join(dependencies.select("object").distinct(), "object", "left_anti")
    return free.groupBy("record", "table_name").agg(F.count("*").alias("segments"), F.sum("bytes").alias("bytes")).where("segments >= 2")


def archive_members(parts: DataFrame, key: str) -> DataFrame:
    """key, member, bytes, sha256 of all members of parts (key, archive), each archive read to its end, so that its footer is checked too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(key), batch.column("archive").to_pylist()):
                plain = lzma.decompress(data)
                with tarfile.open(fileobj=io.BytesIO(plain)) as archive:
                    rows = [(m.name, m.size, hashlib.sha256(archive.extractfile(m).read()).hexdigest()) for m in archive.getmembers()]
                cells = list(zip(*rows)) or [()] * 3
                yield pa.record_batch([pa.array([name.as_py()] * len(rows), name.type), pa.array(cells[0], pa.string()), pa.array(cells[1], pa.int64()), pa.array(cells[2], pa.string())], names=[key, "member", "bytes", "sha256"])

    return parts.select(key, "archive").mapInArrow(run, f"{key} {dict(parts.dtypes)[key]}, member string, bytes long, sha256 string")


def page_layout(units: DataFrame, by: str, order: list[str], budget: int, first_weight: int) -> DataFrame:
    """units (by, order, weight) with `page`, next-fit in order within each snapshot: a unit that no longer fits opens a page.

    The first page already holds first_weight of metadata and may stay without units; any other empty page takes one unit, however large. Order is that of (order), which must not repeat in a snapshot. A snapshot is
    split over many tasks (folds.next_fit); no task sees it whole.
    """
    return next_fit(units.select(by, *order, "weight"), by, order, "weight", budget, first_weight)


def chunk_plan(objects: DataFrame, key: str, step: int) -> DataFrame:
    """key, offset, bytes, sha256 of each object's chunks of `step` bytes; an empty object has one empty chunk."""
    size = F.length("content")
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(step))
    rows = objects.select(key, "content", F.explode(starts).alias("offset"))
    piece = F.substring("content", F.col("offset") + 1, F.lit(step))
    return rows.select(key, F.col("offset").cast("long").alias("offset"), F.length(piece).cast("long").alias("bytes"), F.sha2(piece, 256).alias("sha256"), piece.alias("piece"))


def contiguity_violations(segments: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """key, rule of objects whose segments (key, offset, bytes) do not follow one another from 0, are empty, or do not add up to the object's bytes."""
    w = W.partitionBy(key).orderBy("offset").rowsBetween(W.unboundedPreceding, -1)
    placed = segments.withColumn("expected", F.coalesce(F.sum("bytes").over(w), F.lit(0)))
    gaps = placed.where("offset <> expected").select(key, F.lit("gap").alias("rule")).distinct()
    empty = segments.where("bytes = 0").select(key, F.lit("empty").alias("rule")).distinct()
    totals = segments.groupBy(key).agg(F.sum("bytes").alias("total"))
    wrong = objects.join(totals, key, "left").where("coalesce(total, 0) <> bytes").select(key, F.lit("total").alias("rule"))
    return gaps.union(empty).union(wrong)


def transport_index(segments: DataFrame, key: str) -> DataFrame:
    """key, kind (whole or chunks), segments as part:offset:bytes in order; a list has no more entries than its object has chunks."""
    entry = F.struct("offset", F.concat_ws(":", "part", "offset", "bytes").alias("text"))
    rows = segments.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(entry)).alias("all"))
    return rows.select(key, F.when(F.col("n") == 1, "whole").otherwise("chunks").alias("kind"), F.array_join("all.text", ",").alias("segments"))


def part_set_violations(parts: DataFrame, by: str) -> DataFrame:
    """by, part, rule: numbers of 1..count that are missing, or are there twice. parts: by, part, count."""
    wanted = parts.groupBy(by).agg(F.max("count").alias("count")).select(by, F.explode(F.expr("sequence(1, cast(count as int))")).alias("part"))
    missing = wanted.join(parts.select(by, F.col("part").cast("int").alias("part")), [by, "part"], "left_anti").select(by, F.col("part").cast("long").alias("part"), F.lit("missing").alias("rule"))
    twice = parts.groupBy(by, "part").agg(F.count("*").alias("n")).where("n > 1").select(by, F.col("part").cast("long").alias("part"), F.lit("twice").alias("rule"))
    return missing.union(twice)


def deal_pages(pieces: DataFrame, by: str, most_bytes: int) -> DataFrame:
    """pieces (by, path, offset, piece) with `page`: in order of by, path and offset, a page takes pieces until most_bytes, and each piece counts with OVERHEAD.

    So a page holds at most most_bytes and one piece, and the number of pages grows with the data. Sums go in two steps: within the parts of a
    range sort, which are written once, then over the parts' totals, one row for each task.
    """
    kinds = dict(pieces.dtypes)
    columns = [by, "path", "offset", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            starts = []
            for n in pc.binary_length(batch.column("piece")).to_pylist():
                starts.append(at)
                at += n + OVERHEAD
            yield pa.record_batch([*batch.columns, pa.array([part] * len(starts), pa.int64()), pa.array(starts, pa.int64())], names=[*columns, "part", "start"])

    order = [by, "path", "offset"]
    sorted_ = pieces.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settled(sorted_.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", part long, start long"), "pages")
    totals = rows.groupBy("part").agg(F.sum(F.length("piece") + F.lit(OVERHEAD)).alias("total"))
    bases = totals.select("part", (F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    return rows.join(F.broadcast(bases), "part").select(*columns, F.floor((F.col("base") + F.col("start")) / F.lit(most_bytes)).cast("long").alias("page"))


def _packed(rows: list[tuple[str, int, bytes]]) -> bytes:
    target = io.BytesIO()
    with lzma.LZMAFile(target, "wb", preset=1) as packer, tarfile.open(fileobj=packer, mode="w") as archive:
        for path, offset, piece in rows:
            member = tarfile.TarInfo(f"{path}@{offset}")
            member.size = len(piece)
            archive.addfile(member, io.BytesIO(piece))
    return target.getvalue()


def _archives(rows: list[tuple[str, int, bytes]], most_bytes: int) -> Iterator[bytes]:
    """rows in archives of at most most_bytes: what takes more is halved, a single piece by its bytes."""
    data = _packed(rows)
    if len(data) <= most_bytes:
        yield data
        return
    half = len(rows) // 2
    halves = rows[:half], rows[half:]
    if not half:
        path, offset, piece = rows[0]
        half = len(piece) // 2
        if not half:
            raise ValueError(f"a piece of {len(piece)} bytes at {offset} of {path} takes {len(data)} bytes, more than {most_bytes}")
        halves = [(path, offset, piece[:half])], [(path, offset + half, piece[half:])]
    del data
    for part in halves:
        yield from _archives(part, most_bytes)


def build_parts(pieces: DataFrame, by: str, page: str, most_bytes: int) -> DataFrame:
    """by, page, split, archive, sha256: tar.xz files of each page of pieces (by, page, path, offset, piece), members in order.

    A page is one archive; one that takes more than most_bytes is split, pieces too, until all are within. Only a piece of one byte that takes more fails.
    A page is held whole by its task: deal_pages bounds its bytes.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("path", "ascending"), ("offset", "ascending")])
        rows = list(zip(*(table.column(c).to_pylist() for c in ("path", "offset", "piece"))))
        made = list(_archives(rows, most_bytes))
        n = len(made)
        cells = [pa.array([key[0].as_py()] * n), pa.array([key[1].as_py()] * n), pa.array(range(n), pa.int64()), pa.array(made, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in made])]
        return pa.table(cells, names=[by, page, "split", "archive", "sha256"])

    kinds = dict(pieces.dtypes)
    return pieces.groupBy(by, page).applyInArrow(run, f"{by} {kinds[by]}, {page} {kinds[page]}, split long, archive binary, sha256 string")


def restore(parts: DataFrame) -> DataFrame:
    """path, content, sha256 of all objects in parts (archive, sha256); a changed archive fails. Order and dealing of parts do not matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, digest in zip(batch.column("archive").to_pylist(), batch.column("sha256").to_pylist()):
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError("an archive does not match its digest")
                with tarfile.open(fileobj=io.BytesIO(lzma.decompress(data))) as archive:
                    rows = [(*m.name.rsplit("@", 1), archive.extractfile(m).read()) for m in archive.getmembers()]
                names, offsets, pieces = zip(*rows)
                yield pa.record_batch([pa.array(names), pa.array([int(x) for x in offsets], pa.int64()), pa.array(pieces, pa.binary())], names=["path", "offset", "piece"])

    rows = parts.select("archive", "sha256").mapInArrow(run, "path string, offset long, piece binary")
    whole = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("offset", "piece"))).alias("all"))
    content = F.unhex(F.array_join(F.transform("all.piece", F.hex), ""))
    return whole.select("path", content.alias("content")).withColumn("sha256", F.sha2("content", 256))
