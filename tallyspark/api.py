"""What a user of snapshots calls: preview, export and receive, over tables of artifacts, objects and parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import capture as files
from tallyspark.operators import lineage, snapshot, transport
from tallyspark.sources.store import settled

Report = Callable[[dict], None]
#: Bytes of a chunk of an object, and of a page of archives before compression.
CHUNK_BYTES, PAGE_BYTES = 1 << 20, 8 << 20


class ContractError(ValueError):
    """Something is not as its contract says; nothing has been published."""


def _refuse(violations: DataFrame, what: str) -> None:
    """Raises with the first few violations, if there are any."""
    found = violations.limit(5).collect()
    if found:
        raise ContractError(f"{what}: " + "; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in found))


def preview(artifacts: DataFrame, profile: str = "science") -> DataFrame:
    """Files, objects, bytes and roles that an export of the profile would hold; nothing but the catalog is read."""
    return lineage.preview_totals(lineage.selection(artifacts, profile))


def export(artifacts: DataFrame, contents: DataFrame, profile: str = "science", most_bytes: int = snapshot.MOST_PART_BYTES, progress: Report | None = None) -> tuple[DataFrame, DataFrame]:
    """(parts, receipt) of the artifacts of a profile: archives (index, archive, sha256, bytes), and what they should be (index, sha256, bytes).

    contents: sha256, content. Each digest is taken once. A selection that is not closed, a digest that stands for two sizes, or a content that is missing or another one than
    its digest is refused before an archive is made. progress, if given, gets a dict for each phase.
    """
    transport.check_part_limit(most_bytes)
    report = progress or (lambda _: None)
    report({"phase": "collecting"})
    chosen = settled(lineage.selection(artifacts, profile), "selected")
    _refuse(lineage.dangling_dependencies(chosen, chosen), "a selected artifact depends on one that is not")
    _refuse(lineage.digest_conflicts(chosen), "a digest stands for several sizes or media types")
    objects = chosen.groupBy("sha256").agg(F.min("bytes").alias("bytes"), F.min("media_type").alias("media_type"))
    report({"phase": "capturing", "total_files": objects.count()})
    own = contents.select("sha256", "content").dropDuplicates(["sha256"])
    held = objects.join(own, "sha256", "left").select("sha256", "bytes", snapshot.object_name(F.col("sha256"), F.col("media_type")).alias("path"), "content")
    rules = {"missing": F.col("content").isNull(), "size": F.length("content") != F.col("bytes"), "digest": F.sha2("content", 256) != F.col("sha256"), "media_type": F.col("path").isNull()}
    _refuse(snapshot.broken(held, ["sha256"], rules), "an object is not what its commit says")
    report({"phase": "compressing"})
    pieces = transport.chunk_plan(held.select("path", "content"), "path", CHUNK_BYTES).withColumn("snapshot", F.lit("s"))
    made = transport.build_parts(transport.deal_pages(pieces, "snapshot", min(PAGE_BYTES, most_bytes)), "snapshot", "page", most_bytes)
    # A part's number tells its page and its place there; numbers grow, but need not be neighbours.
    parts = settled(made.select((F.col("page") * 1_000_000 + F.col("split") + 1).alias("index"), "archive", "sha256", F.length("archive").cast("long").alias("bytes")), "parts")
    receipt = parts.select("index", "sha256", "bytes")
    report({"phase": "completed", "total_parts": receipt.count()})
    return parts, receipt


def receive(parts: DataFrame, receipt: DataFrame) -> DataFrame:
    """path, content, sha256 of all objects in parts; missing, repeated, changed or foreign parts are refused before anything is restored. Their order does not matter."""
    seen = parts.select("index", F.sha2("archive", 256).alias("sha256"), F.length("archive").cast("long").alias("bytes"))
    _refuse(seen.groupBy("index").agg(F.count("*").alias("n")).where("n > 1"), "a part is there twice")
    _refuse(snapshot.receipt_violations(receipt, seen), "parts are not those of the receipt")
    restored = transport.restore(parts.select("archive", "sha256"))
    _refuse(restored.where(~F.contains(F.col("path"), F.col("sha256"))).select("path"), "an object is not what its name says")
    return restored


def capture(spark: SparkSession, root: str, most_bytes: int, glob: str = "*", progress: Report | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, pieces) of the files below root: source_path, object, bytes, sha256 of each, and the contents of each object once (object, piece, data).

    Files are listed without their contents, and if they are more than most_bytes together, or have names that may not be, nothing is read. A file that has grown, ended or gone since is refused too.
    A live folder is no atomic snapshot: each file is what it was when it was read. A folder without files gives no rows. progress, if given, gets a dict for each phase.
    """
    report = progress or (lambda _: None)
    report({"phase": "listing"})
    listed = settled(files.listing(spark, root, glob), "listing")
    _refuse(files.listing_violations(listed), "a file may not be captured")
    _refuse(files.admission(listed, most_bytes).where("not admitted").select("path", "bytes", "before"), f"the files are more than {most_bytes} bytes")
    total, n = listed.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    report({"phase": "capturing", "total_files": n, "total_bytes": total})
    read = settled(files.read_pieces(listed.repartition("path"), root), "captured")
    ends = read.where("piece is null")
    _refuse(ends.where("fault is not null").select("path", "fault"), "a file changed while it was read")
    entries = ends.select(F.col("path").alias("source_path"), F.concat(F.lit("objects/"), "sha256", F.lit(".bin")).alias("object"), "bytes", "sha256")
    own = entries.groupBy("object").agg(F.min("source_path").alias("path"))
    pieces = read.where("piece is not null").select("path", "piece", "data").join(own, "path").select("object", "piece", "data")
    report({"phase": "completed", "total_files": n, "total_bytes": total})
    return entries, pieces
