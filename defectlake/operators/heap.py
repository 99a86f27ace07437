"""Heap analytics: allocation blocks, running heap, flame stacks and call-site rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defectlake import dims, scale, schemas
from defectlake.functions import findings as ff
from defectlake.functions.text import basename, nonempty
from defectlake.operators.stats import share_of_total


def _first_user(stack: Column) -> Column:
    return F.get(F.filter(stack, lambda f: ff.is_user_function(f["function"])), F.lit(0))


def alloc_blocks(findings: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """One block per finding: allocation site, free site, leak flag and ownership chain.

    ``alloc_id`` is the 0-based place of the finding in its scan (``order``, by default ``ord``).
    """
    order = order or [F.col("ord").asc()]
    placed = scale.ordered_position(findings, ["scan_id"], order, "__place")
    none = F.array().cast(schemas.STACK)
    stack = F.coalesce(F.col("stack"), none)
    made = F.coalesce(F.col("allocation_info.stack"), none)
    freed = F.coalesce(F.col("free_info.stack"), none)
    loc = F.col("primary_location")

    def named(f):
        return F.coalesce(f["function"].isin(*dims.BLOCK_ALLOCATORS), F.lit(False))

    def user(f):
        return ff.is_user_function(f["function"]) & ~named(f)

    # allocator frames count up to the first user frame, which is the allocation site
    user_at = F.coalesce(F.array_position(F.transform(made, lambda f: F.coalesce(user(f), F.lit(False))), True), F.lit(0))
    head = F.when(user_at > 0, F.slice(made, F.lit(1), user_at.cast("int"))).otherwise(made)
    via = F.coalesce(
        F.try_element_at(F.filter(F.transform(head, lambda f: F.when(named(f), f["function"])), F.isnotnull), F.lit(-1)),
        F.lit("malloc"),
    )
    site = F.get(F.filter(made, user), F.lit(0))
    fallback = loc.isNotNull()
    alloc_func = F.coalesce(
        site["function"], F.when(fallback, _first_user(stack)["function"]), F.lit("??")
    )
    file_of = F.when(site.isNotNull(), site["file"]).when(fallback, loc["file"])
    line_of = F.when(site.isNotNull(), site["line"]).when(fallback, loc["line"])
    free_at = _first_user(freed)
    uaf = F.col("bug_type") == "use_after_free"
    base = placed.select(
        "scan_id",
        "ord",
        (F.col("__place") - 1).alias("alloc_id"),
        F.get(stack, F.lit(0))["address"].alias("__address"),
        F.coalesce("bytes_leaked", F.lit(0)).cast("bigint").alias("size"),
        alloc_func.alias("alloc_func"),
        basename(F.coalesce(file_of, F.lit("??"))).alias("alloc_file"),
        F.coalesce(line_of, F.lit(0)).alias("alloc_line"),
        via.alias("alloc_via"),
        free_at["function"].alias("__free_func"),
        F.when(free_at.isNotNull(), basename(F.coalesce(free_at["file"], F.lit("??")))).alias("__free_file"),
        F.when(free_at.isNotNull(), F.coalesce(free_at["line"], F.lit(0))).alias("free_line"),
        uaf.alias("__uaf"),
        (F.col("bug_type") == "memory_leak").alias("leaked"),
        "bug_type",
        "severity",
        F.size(stack).alias("stack_depth"),
        F.slice(
            F.filter(
                F.transform(stack, lambda f: f["function"]),
                lambda fn: nonempty(fn) & ~F.coalesce(fn.isin(*dims.CHAIN_SKIP), F.lit(True)),
            ),
            1,
            6,
        ).alias("ownership_chain"),
    )
    inherit = F.col("__uaf") & F.col("__free_func").isNull()
    return base.select(
        "scan_id",
        "ord",
        "alloc_id",
        F.when(nonempty(F.col("__address")), F.col("__address"))
        .otherwise(F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("alloc_id")), 4, "0")))
        .alias("address"),
        "size",
        "alloc_func",
        "alloc_file",
        "alloc_line",
        "alloc_via",
        F.when(inherit, F.col("alloc_func")).otherwise(F.col("__free_func")).alias("free_func"),
        F.when(inherit, F.col("alloc_file")).otherwise(F.col("__free_file")).alias("free_file"),
        "free_line",
        "leaked",
        "bug_type",
        "severity",
        "stack_depth",
        "ownership_chain",
    )


def function_rollup(blocks: DataFrame) -> DataFrame:
    """Bytes and counts per allocating function."""
    return blocks.groupBy("scan_id", "alloc_func").agg(
        F.sum("size").alias("total"),
        F.count(F.lit(1)).alias("count"),
        F.count_if("leaked").alias("leaked"),
        F.sum(F.when(F.col("leaked"), F.col("size")).otherwise(0)).alias("leaked_bytes"),
    )


def treemap(rollup: DataFrame) -> DataFrame:
    """Functions with at least 2 % of their scan's bytes, with the band of their leak ratio."""
    shares = share_of_total(rollup, "total", ["scan_id"])
    ratio = F.col("leaked_bytes") / F.greatest(F.col("total"), F.lit(1))
    band = (
        F.when(ratio > 0.5, F.lit("mostly_leaked"))
        .when(ratio > 0, F.lit("partly_leaked"))
        .otherwise(F.lit("freed"))
    )
    return shares.where(F.col("share") >= 2).withColumn("leak_band", band)


def leak_totals(blocks: DataFrame) -> DataFrame:
    """Per scan: allocated and leaked bytes, leak and freed counts, leak percentage."""
    sums = blocks.groupBy("scan_id").agg(
        F.sum("size").alias("total_alloc"),
        F.sum(F.when(F.col("leaked"), F.col("size")).otherwise(0)).alias("total_leaked"),
        F.count_if("leaked").alias("leak_count"),
        F.count_if(~F.col("leaked")).alias("freed_count"),
    )
    pct = F.when(
        F.col("total_alloc") != 0, F.round(F.col("total_leaked") / F.col("total_alloc") * 100, 1)
    ).otherwise(0.0)
    return sums.withColumn("leak_pct", pct)


def heap_profile(blocks: DataFrame) -> DataFrame:
    """Allocation and free events in block order with the running heap ``y``."""
    released = ~F.col("leaked") & nonempty(F.col("free_func"))
    kept = F.when(released, F.lit(0)).otherwise(F.col("size")).cast("bigint")
    # A freed block ends where it began, so the heap before a block is what earlier blocks kept.
    folded = scale.ordered_fold(
        blocks.withColumn("__released", released),
        ["scan_id"],
        [F.col("alloc_id").asc()],
        {"__kept": kept},
        label="heap",
    )
    own = F.when(F.col("__released"), F.lit(0)).otherwise(F.col("size"))
    before = F.col("__kept") - own

    def event(x, y, kind, func):
        return F.struct(
            x.cast("double").alias("x"),
            y.cast("bigint").alias("y"),
            F.lit(kind).alias("type"),
            func.alias("func"),
            F.col("size"),
        )

    made = event(F.col("alloc_id"), before + F.col("size"), "alloc", F.col("alloc_func"))
    gone = event(F.col("alloc_id") + F.lit(0.5), before, "free", F.col("free_func"))
    events = F.when(F.col("__released"), F.array(made, gone)).otherwise(F.array(made))
    return folded.select("scan_id", F.inline(events))


_EVENT_ORDER = ("ts", "event_id")


def heap_running(events: DataFrame) -> DataFrame:
    """Every memory event with the heap bytes and the allocations so far."""
    return scale.ordered_fold(
        events,
        ["scan_id"],
        [F.col(c).asc() for c in _EVENT_ORDER],
        {
            "heap_bytes": F.col("delta_bytes"),
            "allocations": F.when(F.col("op") == "malloc", 1).otherwise(0).cast("bigint"),
        },
        label="heap",
    )


def heap_timeline(events: DataFrame, every: str = "1 day") -> DataFrame:
    """Heap bytes and allocations at the end of every time bucket that has events.

    Deltas are summed per bucket before anything is ordered, so only buckets are ever windowed.
    """
    buckets = events.groupBy("scan_id", F.window("ts", every).alias("w")).agg(
        F.sum("delta_bytes").alias("delta"), F.count_if(F.col("op") == "malloc").alias("made")
    )
    so_far = (
        Window.partitionBy("scan_id")
        .orderBy("t")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return buckets.select("scan_id", F.col("w.end").alias("t"), "delta", "made").select(
        "scan_id",
        "t",
        F.sum("delta").over(so_far).alias("heap_bytes"),
        F.sum("made").over(so_far).alias("allocations"),
    )


def heap_peak(events: DataFrame) -> DataFrame:
    """Per scan: the first moment of the highest heap, and the heap at the end (what leaked)."""
    running = heap_running(events)
    place = F.struct(F.col("ts"), F.col("event_id"))
    # of equal heights the earliest: negate the position
    high = F.struct(F.col("heap_bytes"), -F.unix_micros("ts"), -F.col("event_id"))
    return running.groupBy("scan_id").agg(
        F.max("heap_bytes").alias("peak_bytes"),
        F.max_by("ts", high).alias("peak_at"),
        F.max_by("event_id", high).alias("peak_event"),
        F.max_by("heap_bytes", place).alias("leaked_bytes"),
        F.max("allocations").alias("total_allocations"),
    )


def live_objects(events: DataFrame) -> DataFrame:
    """State of every (process, address) after all events: live size, double and unmatched frees.

    The event before each event is met by position, an equi-join on (process, address, position),
    so an address with very many events is spread like any other rows.
    """
    keys = ["process_id", "address"]
    placed = scale.ordered_fold(
        events.select(*keys, "op", "size", "ts", "seq"),
        keys,
        [F.col("ts").asc(), F.col("seq").asc()],
        {
            "pos": F.lit(1).cast("bigint"),
            "made": F.when(F.col("op") == "malloc", 1).otherwise(0).cast("bigint"),
        },
        label="live",
    )
    placed = scale.materialise(placed, "live")
    before = placed.select(*keys, (F.col("pos") + 1).alias("pos"), F.col("op").alias("before"))
    dead = (F.col("op") == "free") & (F.coalesce("before", F.lit("free")) == "free")
    last = F.struct(F.col("op"), F.col("size"))
    return (
        placed.join(before, [*keys, "pos"], "left")
        .groupBy(*keys)
        .agg(
            F.max_by(last, F.col("pos")).alias("last"),
            F.count_if(F.col("op") == "malloc").alias("mallocs"),
            F.count_if(F.col("op") == "free").alias("frees"),
            F.count_if(dead & (F.col("made") > 0)).alias("double_frees"),
            F.count_if(dead & (F.col("made") == 0)).alias("unmatched_frees"),
        )
        .select(
            *keys,
            (F.col("last.op") != "free").alias("live"),
            F.when(F.col("last.op") != "free", F.col("last.size")).otherwise(0).cast("bigint").alias("size"),
            "mallocs",
            "frees",
            "double_frees",
            "unmatched_frees",
        )
    )


def flame_totals(stacks: DataFrame) -> DataFrame:
    """Bytes per distinct stack."""
    return stacks.groupBy("scan_id", "stack").agg(F.sum("bytes").alias("bytes"))


def top_flames(stacks: DataFrame, n: int = 200) -> DataFrame:
    """Largest stacks per scan."""
    order = [F.desc("bytes"), F.asc("stack")]
    return scale.top_n(flame_totals(stacks), ["scan_id"], order, n, salt=["stack"])


def flame_layers(stacks: DataFrame, min_share: float = 1.0) -> DataFrame:
    """Bytes per depth and function with the share of the depth; slivers are hidden."""
    each = stacks.select(
        "scan_id", "bytes", F.posexplode(F.split("stack", ";")).alias("depth", "function")
    )
    cells = each.groupBy("scan_id", "depth", "function").agg(F.sum("bytes").alias("bytes"))
    return share_of_total(cells, "bytes", ["scan_id", "depth"]).where(F.col("share") >= min_share)


def function_bytes_from_flame(stacks: DataFrame, n: int = 15) -> DataFrame:
    """Bytes per function over all frames, allocator internals left out; the largest ``n``."""
    each = stacks.select("scan_id", "bytes", F.explode(F.split("stack", ";")).alias("function"))
    name = F.trim("function")
    sums = (
        each.select("scan_id", "bytes", name.alias("function"))
        .where((F.col("function") != "") & ~F.col("function").isin(*dims.FLAME_SKIP))
        .groupBy("scan_id", "function")
        .agg(F.sum("bytes").alias("peak_bytes"))
    )
    order = [F.desc("peak_bytes"), F.asc("function")]
    return scale.top_n(sums, ["scan_id"], order, n, salt=["function"])


def top_sites(sites: DataFrame, n: int = 20) -> DataFrame:
    """Call sites with the highest peak per scan."""
    order = [F.desc("peak_bytes"), F.asc("site_no")]
    return scale.top_n(sites, ["scan_id"], order, n, salt=["site_no"])


def ownership_nodes(blocks: DataFrame) -> DataFrame:
    """Functions of the ownership chains; counts and bytes belong to the first of each chain."""
    each = blocks.select(
        "scan_id", "size", "leaked", F.posexplode("ownership_chain").alias("pos", "function")
    )
    first = F.col("pos") == 0
    return each.groupBy("scan_id", "function").agg(
        F.count_if(first).alias("allocs"),
        F.sum(F.when(first, F.col("size")).otherwise(0)).alias("bytes"),
        F.count_if(first & F.col("leaked")).alias("leaked"),
        F.count_if(first & ~F.col("leaked")).alias("freed"),
    )


def ownership_edges(blocks: DataFrame) -> DataFrame:
    """Distinct consecutive pairs of the ownership chains."""
    chain = F.col("ownership_chain")
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(chain) - 1),
        lambda i: F.struct(
            F.element_at(chain, i).alias("source"), F.element_at(chain, i + 1).alias("target")
        ),
    )
    return (
        blocks.where(F.size(chain) >= 2)
        .select("scan_id", F.inline(pairs))
        .distinct()
    )


def allocation_by_line(events: DataFrame, n: int = 100) -> DataFrame:
    """Size and count per (file, line), largest ``n`` per scan, with the earliest trace."""
    extra = [F.min_by("traceback", "ord").alias("traceback")] if "traceback" in events.columns else []
    sums = events.groupBy("scan_id", "file", "line").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("count"), *extra
    )
    order = [F.desc("size"), F.desc("count"), F.asc("file"), F.asc("line")]
    return scale.top_n(sums, ["scan_id"], order, n, salt=["file", "line"])


def block_fill(
    lines: DataFrame, keys: list[str], order: list[Column], is_header: Column, name: str = "block"
) -> DataFrame:
    """Number every line with the header it belongs to (0 before the first header)."""
    return scale.ordered_fold(
        lines, keys, order, {name: F.when(is_header, 1).otherwise(0).cast("bigint")}, label="blocks"
    )
