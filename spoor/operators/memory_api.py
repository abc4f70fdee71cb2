"""Memory-management routines: names, arguments, and matching of entries and exits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions import bytes as B
from spoor.operators import ordered

# Routine names in kind order (0..18) and the action of each.
ROUTINES = [
    ("VirtualAlloc", "allocate"), ("VirtualFree", "free"), ("VirtualProtect", "protect"),
    ("HeapAlloc", "allocate"), ("HeapReAlloc", "reallocate"), ("HeapFree", "free"),
    ("RtlAllocateHeap", "allocate"), ("RtlReAllocateHeap", "reallocate"), ("RtlFreeHeap", "free"),
    ("NtAllocateVirtualMemory", "allocate"), ("NtFreeVirtualMemory", "free"),
    ("NtProtectVirtualMemory", "protect"), ("MapViewOfFile", "map"), ("MapViewOfFileEx", "map"),
    ("UnmapViewOfFile", "unmap"), ("MapViewOfFile3", "map"), ("UnmapViewOfFile2", "unmap"),
    ("NtMapViewOfSection", "map"), ("NtUnmapViewOfSection", "unmap"),
]
_KIND = {name: i for i, (name, _) in enumerate(ROUTINES)}
_STATUS = [k for n, k in _KIND.items() if n.startswith("Nt")]            # success: signed status >= 0
_INDIRECT = [_KIND[n] for n in ("NtAllocateVirtualMemory", "NtFreeVirtualMemory", "NtProtectVirtualMemory",
                                "NtMapViewOfSection")]                    # values behind pointers

# Which argument holds what, per routine. "result": the call's result at exit and the given argument
# (None = 0) at entry.
_BASE = {"VirtualAlloc": ("result", 0), "VirtualFree": 0, "VirtualProtect": 0,
         "HeapAlloc": ("result", None), "RtlAllocateHeap": ("result", None),
         "HeapReAlloc": ("result", 2), "RtlReAllocateHeap": ("result", 2),
         "HeapFree": 2, "RtlFreeHeap": 2, "MapViewOfFile": ("result", None), "MapViewOfFileEx": ("result", 5),
         "UnmapViewOfFile": 0, "MapViewOfFile3": ("result", 2), "UnmapViewOfFile2": 1, "NtUnmapViewOfSection": 1}
_PREVIOUS = {"VirtualFree": 0, "HeapReAlloc": 2, "RtlReAllocateHeap": 2, "HeapFree": 2, "RtlFreeHeap": 2,
             "MapViewOfFileEx": 5, "UnmapViewOfFile": 0, "MapViewOfFile3": 2, "UnmapViewOfFile2": 1,
             "NtUnmapViewOfSection": 1}
_SIZE = {"VirtualAlloc": 1, "VirtualFree": 1, "VirtualProtect": 1, "HeapAlloc": 2, "RtlAllocateHeap": 2,
         "HeapReAlloc": 3, "RtlReAllocateHeap": 3, "MapViewOfFile": 4, "MapViewOfFileEx": 4, "MapViewOfFile3": 4}
_PROTECTION = {"VirtualAlloc": 3, "VirtualProtect": 2, "MapViewOfFile": 1, "MapViewOfFileEx": 1,
               "MapViewOfFile3": 6, "UnmapViewOfFile2": 2}


def classify(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds routine kind and action; names that are not exactly known get nulls."""
    kinds = F.create_map(*[F.lit(v) for n, k in _KIND.items() for v in (n, k)])
    actions = F.create_map(*[F.lit(v) for n, a in ROUTINES for v in (n, a)])
    return df.withColumns({"api_kind": F.try_element_at(kinds, F.col(name)),
                           "action": F.try_element_at(actions, F.col(name))})


def _pick(roles: dict) -> Column:
    zero = F.lit(0).cast(B.U64)
    value = F.lit(None).cast(B.U64)
    for name, role in roles.items():
        if isinstance(role, tuple):
            at_entry = zero if role[1] is None else F.col(f"arg{role[1]}")
            picked = F.when(F.col("entering"), at_entry).otherwise(F.col("result"))
        else:
            picked = F.col(f"arg{role}")
        value = F.when(F.col("api_kind") == _KIND[name], picked).otherwise(value)
    return F.coalesce(value, zero).cast(B.U64)


def interpret(df: DataFrame) -> DataFrame:
    """Adds base, previous, bytes, api_protection and api_succeeded derived from the raw arguments.

    Needs api_kind, arg0..arg11, result, entering. Routines that pass these through pointers keep the
    recorded columns (base_address, previous_address, size, protection) when present.
    """
    indirect = F.col("api_kind").isin(*_INDIRECT)
    sign_ok = F.col("result") < F.lit(str(1 << 63)).cast(B.U64)
    ok = ~F.col("entering") & F.when(F.col("api_kind").isin(*_STATUS), sign_ok).otherwise(F.col("result") != 0)

    def derived(roles, recorded):
        value = _pick(roles)
        return F.when(indirect, F.col(recorded)).otherwise(value) if recorded in df.columns else value

    return df.withColumns({
        "base": derived(_BASE, "base_address"), "previous": derived(_PREVIOUS, "previous_address"),
        "bytes": derived(_SIZE, "size"), "api_protection": derived(_PROTECTION, "protection"),
        "api_succeeded": F.when(F.col("api_kind").isNotNull(), ok)})


def correlate(rows: DataFrame, value=None, segment: int | None = None) -> DataFrame:
    """Pair each exit with the most recent open entry of the same routine on its thread.

    Rows: (run_id, tid, definition, seq, entering, ...); ``value`` is the struct of entry columns to hand
    to the exit as ``enter`` (default: the entry's seq). Exits with nothing open are orphans and get null.
    """
    return ordered.match_levels(rows, ["run_id", "tid", "definition"], F.col("entering"), value, "enter",
                                segment=segment)


def memory_operations(lifecycle: DataFrame, definitions: DataFrame) -> DataFrame:
    """Entry rows with their exit by operation id and the routine name, plus orphan exits (id 0).

    For the pointer-passing free, protect and map routines the previous base is the one seen at entry.
    """
    names = definitions.select("run_id", "definition_id", F.col("name").alias("routine"), F.col("kind").alias("_kind"))
    enters = lifecycle.filter("entering").select(
        "run_id", "operation_id", F.col("thread_id").alias("tid"), "definition_id", "action",
        F.col("sequence").alias("enter_seq"), F.col("base_address").alias("_entry_base"))
    exits = lifecycle.filter("NOT entering").select(
        "run_id", "operation_id", F.col("sequence").alias("exit_seq"), "result",
        F.col("base_address").alias("base"), F.col("previous_address").alias("previous"),
        F.col("size").alias("bytes"), "succeeded", F.col("thread_id").alias("_tid"),
        F.col("definition_id").alias("_definition"), F.col("action").alias("_action"))
    known = exits.filter("operation_id <> 0").drop("_tid", "_definition", "_action")
    paired = enters.join(known, ["run_id", "operation_id"], "left")
    orphans = exits.filter("operation_id = 0").select(
        "run_id", "operation_id", F.col("_tid").alias("tid"), F.col("_definition").alias("definition_id"),
        F.col("_action").alias("action"), F.lit(None).cast("bigint").alias("enter_seq"),
        F.lit(None).cast(B.U64).alias("_entry_base"), "exit_seq", "result", "base", "previous", "bytes", "succeeded")
    seen_at_entry = F.col("_kind").isin(*[k for k in _INDIRECT if ROUTINES[k][1] != "allocate"])
    rows = paired.unionByName(orphans).join(names, ["run_id", "definition_id"], "left")
    previous = F.when(seen_at_entry & F.col("exit_seq").isNotNull() & (F.col("_entry_base") != 0),
                      F.col("_entry_base")).otherwise(F.col("previous"))
    return rows.withColumn("previous", previous).withColumn(
        "matched", F.col("enter_seq").isNotNull() & F.col("exit_seq").isNotNull()).drop("_kind", "_entry_base")
