"""Checks of native records as tables: columns and their kinds, diagnostics beside the history, packed witnesses, cumulative histories.

The native array files need a reader that is not installed here; their datasets come as rows. Each check gives its violations as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.bits import double_bits
from tallyspark.operators.proofs import prefix_violations
from tallyspark.operators.snapshot import broken

#: Columns of physical markers and their kinds (f: double, i: long, s: text), and those of their child tables.
MARKER_KINDS = {
    "seed_mu_eV": "f", "seed_number_ratio": "f", "fdt_raw_seed_mu": "f", "fdt_normalized_seed_mu": "f", "measured_iteration": "i", "raw_hole_charge": "f", "represented_capacity": "f",
    "occupied_fraction_a": "f", "empty_fraction_c": "f", "relative_correction_Gn": "f", "relative_correction_Gp": "f", "equilibrium_applicable": "i", "equilibrium_status": "s", "equilibrium_mu_eV": "f",
    "fdt_raw": "f", "fdt_normalized": "f", "equilibrium_abs_current_A_m2": "f", "delta_energy_eV": "f", "sampled_gamma_over_dE_q10": "f", "sampled_gamma_over_dE_q50": "f", "sampled_gamma_over_dE_q90": "f",
    "sampled_spectral_weight_underresolved": "f", "linewidth_sampled_blocks": "i", "linewidth_status": "s", "linewidth_sampling_method": "s", "marker_cadence": "i", "linewidth_max_blocks": "i",
    "relative_mode_weight_floor": "f", "fresh_map_status": "s", "lo_shift_over_dE": "f", "field_shift_over_dE": "f", "lo_boundary_occupied_fraction": "f", "lo_boundary_spectral_fraction": "f",
    "field_boundary_occupied_fraction": "f", "field_boundary_spectral_fraction": "f",
}
CHILD_KINDS = {
    "channels": {"sequence": "i", "channel": "s", "component": "s", "residual_absolute": "f", "residual_scale": "f", "residual_relative": "f"},
    "collisions": {"sequence": "i", "channel": "s", "state_kind": "s", "particle_signed": "f", "particle_absolute": "f", "particle_imaginary": "f", "energy_signed": "f", "energy_absolute": "f", "energy_imaginary": "f"},
}
CHILD_STATES = {"channels": ("component", ("retarded", "lesser", "greater")), "collisions": ("state_kind", ("fresh", "mixed"))}
#: Columns of one byte, and of a checkpoint's history.
NARROW, CHECKPOINT_COLUMNS = ("available", "equilibrium_applicable"), 18


def _contract(kinds: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])


def column_violations(columns: DataFrame, artifacts: DataFrame, kinds: dict[str, str], exact: bool) -> DataFrame:
    """artifact, name, rule of the columns of a table (artifact, name, kind, width, n) of artifacts (artifact, n): missing, of another length than the table, of another kind or width, or (exact) unknown.

    Unknown columns that are allowed are longs.
    """
    names = F.explode(F.array(*[F.lit(k) for k in kinds])).alias("name")
    missing = artifacts.select("artifact", names).join(columns.select("artifact", "name"), ["artifact", "name"], "left_anti").select("artifact", "name", F.lit("missing").alias("rule"))
    rows = columns.join(artifacts.select("artifact", F.col("n").alias("n_rows")), "artifact")
    known = F.try_element_at(_contract(kinds), F.col("name"))
    kind = F.coalesce(known, F.lit("i"))
    width = F.when(F.col("name").isin(*NARROW), 1).otherwise(8)
    fits = (F.col("kind") == kind) & ((kind == "s") | (F.col("width") == width))
    rules = {"length": F.col("n") != F.col("n_rows"), "kind": (~fits & known.isNotNull()) if exact else ~fits}
    if exact:
        rules["unknown"] = known.isNull()
    return missing.union(broken(rows, ["artifact", "name"], rules))


def marker_column_violations(columns: DataFrame, artifacts: DataFrame) -> DataFrame:
    """column_violations of physical markers: sequence, available and all of MARKER_KINDS."""
    return column_violations(columns, artifacts, {"sequence": "i", "available": "i", **MARKER_KINDS}, exact=False)


def child_column_violations(columns: DataFrame, artifacts: DataFrame, table: str) -> DataFrame:
    """column_violations of a child table of markers, which has its columns and no others."""
    return column_violations(columns, artifacts, CHILD_KINDS[table], exact=True)


def measured_child_violations(children: DataFrame, markers: DataFrame, table: str) -> DataFrame:
    """sequence, channel, state, rule of child rows outside a measured marker (available, its map too), with another state than allowed, without a channel, or that share an identity."""
    field, allowed = CHILD_STATES[table]
    measured = markers.where("available = 1 and fresh_map_status = 'available'").select("sequence").distinct().withColumn("measured", F.lit(True))
    rows = children.select("sequence", "channel", F.col(field).alias("state")).groupBy("sequence", "channel", "state").agg(F.count("*").alias("n")).join(measured, "sequence", "left")
    rules = {"unmeasured": F.col("measured").isNull(), "state": ~F.coalesce(F.col("state").isin(*allowed), F.lit(False)), "channel": F.coalesce("channel", F.lit("")) == "", "repeated": F.col("n") > 1}
    return broken(rows, ["sequence", "channel", "state"], rules)


def diagnostic_violations(history: DataFrame, markers: DataFrame, witnesses: DataFrame, by: str) -> DataFrame:
    """by, ordinal, rule where markers (by, ordinal, sequence, available, equilibrium_applicable) and witness scalars (by, ordinal, sequence, available) do not stand beside the history's rows (by, ordinal, sequence), or a flag is neither 0 nor 1.

    An unmeasured marker's applicability means nothing.
    """
    keys = [by, "ordinal"]
    m = markers.select(*keys, F.col("sequence").alias("m_sequence"), F.col("available").alias("m_available"), "equilibrium_applicable")
    w = witnesses.select(*keys, F.col("sequence").alias("w_sequence"), F.col("available").alias("w_available"))
    rows = history.select(*keys, "sequence").join(m, keys, "full").join(w, keys, "full")
    flag = lambda c: F.coalesce(F.col(c).isin(0, 1), F.lit(False))
    both = F.col("m_sequence").isNotNull() & F.col("w_sequence").isNotNull() & F.col("sequence").isNotNull()
    rules = {
        "sequence": ~(F.col("sequence").eqNullSafe(F.col("m_sequence")) & F.col("sequence").eqNullSafe(F.col("w_sequence"))),
        "available": both & ~(flag("m_available") & flag("w_available")),
        "applicable": both & (F.col("m_available") == 1) & ~flag("equilibrium_applicable"),
    }
    return broken(rows, keys, rules)


def history_rows(tables: DataFrame) -> DataFrame:
    """artifact, n, fault: the rows of a native history, from a checkpoint's matrix (rows, columns), the length of its sequence, or its row count, whichever there is first."""
    matrix = F.col("matrix_columns") == CHECKPOINT_COLUMNS
    n = F.when(F.col("matrix_columns").isNotNull(), F.when(matrix, F.col("matrix_rows"))).otherwise(F.coalesce("sequence_rows", "row_count"))
    fault = F.when(F.col("matrix_columns").isNotNull() & ~matrix, "columns").when(n.isNull(), "no_count")
    return tables.select("artifact", n.alias("n"), fault.alias("fault"))


def envelope_violations(artifacts: DataFrame, schemas: dict[str, tuple], version: str, groups: tuple) -> DataFrame:
    """artifact, rule of native artifacts (artifact, role, schema, contract_set, version, groups: array) of another contract set or version, whose schema their role does not have, or that lack a required group."""
    pairs = F.array(*[F.lit(f"{r}/{s}") for r, all_ in schemas.items() for s in all_])
    rules = {"contract_set": F.coalesce("contract_set", F.lit("")) == "", "version": ~F.col("version").eqNullSafe(F.lit(version)), "schema": ~F.array_contains(pairs, F.concat_ws("/", "role", "schema")), "group": F.size(F.array_except(F.array(*map(F.lit, groups)), F.coalesce("groups", F.array().cast("array<string>")))) > 0}
    return broken(artifacts, ["artifact"], rules)


def source_violations(sources: DataFrame, artifacts: DataFrame) -> DataFrame:
    """artifact, sha256, rule of the source segments (artifact, sha256, point, attempt, n) of cumulative histories (artifact, point, attempt: the cutoff, n): of another point, outside 1 to the cutoff, there twice, or with a negative number of rows; and (sha256 null) histories whose rows are not the sum of their sources'."""
    own = artifacts.select("artifact", F.col("point").alias("own_point"), F.col("attempt").alias("cutoff"), F.col("n").alias("own_n"))
    times = W.partitionBy("artifact", "sha256")
    rows = sources.withColumn("times", F.count("*").over(times)).join(own, "artifact")
    rules = {"point": ~F.col("point").eqNullSafe(F.col("own_point")), "attempt": ~F.coalesce(F.col("attempt").between(F.lit(1), F.col("cutoff")), F.lit(False)), "repeated": F.col("times") > 1, "rows": F.col("n") < 0}
    sums = own.join(sources.groupBy("artifact").agg(F.sum("n").alias("total")), "artifact", "left").where("coalesce(total, 0) <> own_n")
    return broken(rows, ["artifact", "sha256"], rules).distinct().union(sums.select("artifact", F.lit(None).cast("string"), F.lit("sum")))


def identity_violations(segments: DataFrame, expected: DataFrame, cumulative: bool) -> DataFrame:
    """segment, rule of history segments (segment, series, point, attempt) of another point than expected (series, point, attempt), or of another attempt: a cumulative history's segments may be of earlier ones."""
    want = expected.select("series", F.col("point").alias("own_point"), F.col("attempt").alias("cutoff"))
    rows = segments.join(want, "series")
    fits = F.col("attempt").between(F.lit(1), F.col("cutoff")) if cumulative else (F.col("attempt") == F.col("cutoff")) & (F.col("attempt") >= 1)
    return broken(rows, ["segment"], {"point": ~F.col("point").eqNullSafe(F.col("own_point")), "attempt": ~F.coalesce(fits, F.lit(False))})


def annotation_violations(old: DataFrame, new: DataFrame, growing: tuple = ("logical_shape", "nonfinite_count")) -> DataFrame:
    """path, key of annotations (path, key, value) of old that new lacks or has with another value; those of `growing` may change."""
    kept = old.where(~F.col("key").isin(*growing))
    return kept.join(new.select("path", "key", "value", F.lit(True).alias("same")), ["path", "key", "value"], "left_anti").select("path", "key")


def row_count_violations(intervals: DataFrame, rows: DataFrame, by: str) -> DataFrame:
    """by, first, last, n, found of intervals (by, first, last, n) that do not hold as many sequences of rows (by, sequence) as they say.

    Rows before an interval's ends are counted by one running count over rows and ends in order, instead of a join by range.
    """
    ends = intervals.select(by, F.posexplode(F.array(F.col("first") - 1, "last")).alias("side", "sequence"), F.struct("first", "last", "n").alias("of")).withColumn("kind", F.lit(1))
    marks = rows.select(by, F.lit(None).cast("int").alias("side"), "sequence", F.lit(None).cast(ends.schema["of"].dataType).alias("of"), F.lit(0).alias("kind"))
    count = F.sum(1 - F.col("kind")).over(W.partitionBy(by).orderBy("sequence", "kind"))
    both = ends.select(by, "side", "sequence", "of", "kind").union(marks).withColumn("until", count).where("kind = 1")
    found = both.groupBy(by, "of").agg((F.max(F.when(F.col("side") == 1, F.col("until"))) - F.max(F.when(F.col("side") == 0, F.col("until")))).alias("found"))
    return found.where("found <> of.n").select(by, "of.first", "of.last", "of.n", "found")


def lost_witnesses(witnesses: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The witnesses without a row of the scalar history at their keys."""
    return witnesses.join(rows.select(*keys), keys, "left_anti").select(*keys)


def decoded_payloads(payloads: DataFrame, records: DataFrame, descriptors: DataFrame) -> DataFrame:
    """record_ix, sequence, path, shape, offset, size of packed arrays (ix, record_ix, descriptor_ix, offset, size) by their dictionaries: records (record_ix, sequence) and descriptors (descriptor_ix, path, shape)."""
    return payloads.join(records, "record_ix").join(descriptors, "descriptor_ix").select("record_ix", "sequence", "path", "shape", "offset", "size")


def payload_violations(payloads: DataFrame, records: DataFrame, descriptors: DataFrame) -> DataFrame:
    """ix, rule of packed arrays whose index lies outside a dictionary, whose path is not safe, whose shape has another product than their size, or that share record and path."""
    rows = payloads.join(records.select("record_ix", F.lit(True).alias("has_record")), "record_ix", "left").join(descriptors, "descriptor_ix", "left")
    there = F.col("path").isNotNull()
    parts = F.split("path", "/")
    unsafe = F.startswith(F.col("path"), F.lit("/")) | F.arrays_overlap(parts, F.array(F.lit(""), F.lit("."), F.lit("..")))
    product = F.aggregate("shape", F.lit(1).cast("long"), lambda a, n: a * n)
    rules = {"record": F.col("has_record").isNull(), "descriptor": ~there, "path": there & unsafe, "shape": there & (product != F.col("size"))}
    # what is counted is narrow, and a task has a fixed share of the places
    narrow = rows.select("ix", "record_ix", "path", *[c.alias(f"is_{name}") for name, c in rules.items()]).repartition(int(payloads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "record_ix", "path")
    times = F.count("*").over(W.partitionBy("record_ix", "path"))
    return broken(narrow.withColumn("times", times), ["ix"], {name: F.col(f"is_{name}") for name in rules} | {"repeated": there & (F.col("times") > 1)})


def witness_violations(old: DataFrame, new: DataFrame) -> DataFrame:
    """sequence, path, rule where packed witnesses (sequence, path, shape, attributes: map, values: array of doubles) of old are not the same in new: missing, of another shape, with a lost annotation, or with other bits."""
    bits = lambda c: F.transform(c, double_bits)
    b = new.select("sequence", "path", F.lit(True).alias("there"), F.col("shape").alias("b_shape"), F.col("attributes").alias("b_attributes"), F.col("values").alias("b_values"))
    rows = old.join(b, ["sequence", "path"], "left")
    there = F.col("there").isNotNull()
    lost = F.exists(F.map_entries("attributes"), lambda e: ~e.value.eqNullSafe(F.try_element_at(F.col("b_attributes"), e.key)))
    rules = {"missing": ~there, "shape": there & ~F.col("shape").eqNullSafe(F.col("b_shape")), "annotation": there & lost, "values": there & ~bits(F.col("values")).eqNullSafe(bits(F.col("b_values")))}
    return broken(rows, ["sequence", "path"], rules)


def added_arrays(old: DataFrame, new: DataFrame) -> DataFrame:
    """sequence, path of arrays that new has in a witness of old but old has not: a kept witness may not grow."""
    return new.join(old.select("sequence").distinct(), "sequence", "left_semi").select("sequence", "path").join(old.select("sequence", "path"), ["sequence", "path"], "left_anti")


def history_counts(rows: DataFrame, inventory: DataFrame, by: list[str]) -> DataFrame:
    """by, declared, found where an inventory's rows of a phase (by, n) are not those that its table has."""
    found = rows.groupBy(*by).agg(F.count("*").alias("found"))
    both = inventory.select(*by, F.col("n").alias("declared")).join(found, by, "full")
    return both.where("not coalesce(declared, 0) <=> coalesce(found, 0)").select(*by, F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("found", F.lit(0)).alias("found"))


def history_proof(old: DataFrame, new: DataFrame, old_sources: DataFrame, new_sources: DataFrame, by: str, key: str) -> DataFrame:
    """by, previous_rows, replacement_rows, previous_source_segments, replacement_source_segments, faults: whether a cumulative history (new) holds an earlier one (old), with the number of what speaks against it.

    Rows are compared by their place in the order of `key`, every old column bit by bit; a source segment (by, sha256, payload) of old is in new unchanged.
    """
    place = F.row_number().over(W.partitionBy(by).orderBy(key))
    a, b = old.withColumn("place", place), new.withColumn("place", place)
    cells = prefix_violations(a, b, [by, "place"]).groupBy(by).agg(F.count("*").alias("cells"))
    lost = old_sources.join(new_sources, [by, "sha256", "payload"], "left_anti").groupBy(by).agg(F.count("*").alias("lost"))
    counted = lambda df, name: df.groupBy(by).agg(F.count("*").alias(name))
    out = counted(old, "previous_rows")
    for part in (counted(new, "replacement_rows"), counted(old_sources, "previous_source_segments"), counted(new_sources, "replacement_source_segments"), cells, lost):
        out = out.join(part, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    names = ["replacement_rows", "previous_source_segments", "replacement_source_segments"]
    return out.select(by, "previous_rows", *[zero(c).alias(c) for c in names], (zero("cells") + zero("lost")).alias("faults"))


def worth_selecting(witnesses: DataFrame, selected: DataFrame, by: str, least: int = 4) -> DataFrame:
    """by, source_witnesses, selected_witnesses of histories from which witnesses are left out: those of no more than `least`, or of which all are selected, stay as they are."""
    total = witnesses.groupBy(by).agg(F.count("*").alias("source_witnesses"))
    kept = selected.groupBy(by).agg(F.count("*").alias("selected_witnesses"))
    return total.join(kept, by).where((F.col("source_witnesses") > least) & (F.col("selected_witnesses") < F.col("source_witnesses")))


def array_blocks(arrays: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """dataset, block, starts, sizes: blocks of at most most_bytes that cover each array (dataset, shape, item_bytes) exactly once; the last axis is the longest in a block."""
    room = F.greatest(F.lit(1).cast("long"), F.lit(most_bytes).cast("long") / F.col("item_bytes")).cast("long")
    first = F.struct(room.alias("left"), F.array().cast("array<bigint>").alias("steps"))

    def axis(a: Column, n: Column) -> Column:
        step = F.least(n.cast("long"), a.left)
        return F.struct(F.greatest(F.lit(1).cast("long"), F.floor(a.left / step).cast("long")).alias("left"), F.concat(F.array(step), a.steps).alias("steps"))

    rows = arrays.withColumn("steps", F.aggregate(F.reverse("shape"), first, axis).steps)
    rows = rows.withColumn("counts", F.zip_with("shape", "steps", lambda n, s: F.ceil(n / s).cast("long")))
    # The last axis runs fastest: an axis repeats its block as often as the axes behind it have blocks.
    behind = F.transform("counts", lambda c, i: F.aggregate(F.slice("counts", i + 2, F.size("counts")), F.lit(1).cast("long"), lambda a, n: a * n))
    rows = rows.withColumn("behind", behind).withColumn("total", F.aggregate("counts", F.lit(1).cast("long"), lambda a, n: a * n))
    rows = rows.select("dataset", "shape", "steps", "counts", "behind", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias("block"))
    place = F.transform("counts", lambda c, i: F.floor(F.col("block") / F.element_at("behind", i + 1)).cast("long") % c)
    starts = F.zip_with(place, "steps", lambda p, s: p * s)
    rows = rows.withColumn("starts", starts)
    sizes = F.transform("starts", lambda s, i: F.least(F.element_at("steps", i + 1), F.element_at("shape", i + 1) - s).cast("long"))
    return rows.select("dataset", "block", "starts", sizes.alias("sizes"))
