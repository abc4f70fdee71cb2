"""Calls, returns, active frames and the correlation of enter and exit events."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.functions import bytes as B
from spoor.operators import ordered
from spoor.session import reliable_checkpoint

FRAME_PIECE = 1 << 17   # sequence numbers per piece of the call-stack replay
STACK_PIECE = 1 << 16   # sequence numbers per piece of a thread with a snapshot of its open calls


def call_lifetimes(evidence: DataFrame) -> DataFrame:
    """Every call with the first return of its id on its thread."""
    calls = evidence.filter(F.col("kind") == 7).select("run_id", "seq", "tid", "cid", "target")
    return calls.join(_first_returns(evidence), ["run_id", "cid", "tid"], "left")


def _first_returns(evidence: DataFrame) -> DataFrame:
    return (evidence.filter(F.col("kind") == 8).groupBy("run_id", "cid", "tid")
            .agg(F.min("seq").alias("returned")))


def _newest_return(evidence: DataFrame, cursor: int | None, columns: list[str]) -> DataFrame:
    rows = evidence.filter(F.col("kind") == 8)
    if cursor is not None:
        rows = rows.filter(F.col("seq") <= cursor)
    return (rows.groupBy("run_id", "cid", "tid")
            .agg(F.max_by(F.struct(*columns), "seq").alias("_r")))


def returned(evidence: DataFrame, cursor: int) -> DataFrame:
    """For every call up to the cursor: the newest return of its id and thread up to the cursor."""
    calls = evidence.filter((F.col("kind") == 7) & (F.col("seq") <= cursor)).select("run_id", "cid", "tid", "seq")
    found = _newest_return(evidence, cursor, ["seq"])
    return (calls.join(found, ["run_id", "cid", "tid"], "left")
            .select("run_id", "cid", "tid", "seq", F.col("_r.seq").alias("return_seq")))


def match_call(evidence: DataFrame, limit: int | None = None) -> DataFrame:
    """The call/return rows of every call id, numbered in sequence order (the first ``limit``); id 0 matches nothing."""
    rows = evidence.filter(F.col("kind").isin(7, 8) & (F.col("cid") != 0))
    order = Window.partitionBy("run_id", "cid").orderBy("seq")
    rows = rows.withColumn("position", F.row_number().over(order))
    return rows if limit is None else rows.filter(F.col("position") <= limit)


def call_latency(calls: DataFrame, returns: DataFrame, cursor: int | None = None) -> DataFrame:
    """Call rows with the newest matching return: its value and the nanoseconds in between.

    Inputs are the typed call and return tables.
    """
    rows = returns if cursor is None else returns.filter(F.col("sequence") <= cursor)
    seen = calls if cursor is None else calls.filter(F.col("sequence") <= cursor)
    found = (rows.groupBy("run_id", "call_id", "thread_id")
             .agg(F.max_by(F.struct("sequence", "monotonic_ns", "integer_return_low"), "sequence").alias("_r")))
    return (seen.join(found, ["run_id", "call_id", "thread_id"], "left")
            .select("run_id", "call_id", F.col("thread_id").alias("tid"), F.col("sequence").alias("seq"),
                    F.col("target_address").alias("target"), "rcx", "rdx", "r8", "r9",
                    F.col("_r.sequence").alias("return_seq"), F.col("_r.integer_return_low").alias("rax"),
                    (F.col("_r.monotonic_ns") - F.col("monotonic_ns")).alias("latency_ns")))


def _active_spans(evidence: DataFrame) -> DataFrame:
    """Each call with the last cursor at which it is still active (``until``).

    A call ends at its first return, or when its thread changes context.
    """
    change = F.col("kind") == 13
    # The next change is the previous one on the mirrored axis.
    rows = (evidence.filter(F.col("kind").isin(7, 13)).select("run_id", "kind", "seq", "tid", "cid", "target")
            .withColumn("_mirror", F.lit(ordered.LAST) - F.col("seq")))
    rows = ordered.carry_last(rows, ["run_id", "tid"], change, None, "_change", order="_mirror").filter(~change)
    spans = rows.join(_first_returns(evidence), ["run_id", "cid", "tid"], "left")
    until = F.least(F.col("returned"), F.lit(ordered.LAST) - F.col("_change")) - 1
    return spans.select("run_id", "tid", "seq", "cid", "target", "returned",
                        F.coalesce(until, F.lit(ordered.LAST)).alias("until"))


def active_calls(evidence: DataFrame, cursors: DataFrame, limit: int | None = None, piece: int = STACK_PIECE) -> DataFrame:
    """Active calls, all or the newest ``limit``, per cursor (cursor_id, run_id, tid, cursor).

    A call is active at a cursor strictly after it, if it has not returned by then and its thread has
    not changed context since.
    """
    return _active(evidence, cursors, [], limit, piece)


def stack_snapshots(spans: DataFrame, cursors: DataFrame, piece: int = STACK_PIECE, same: tuple = (),
                    limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """For each thread piece that holds a cursor: the calls active at some moment of it, and the cursors.

    That is the snapshot of the calls open at the piece's beginning and the calls made in it. Wanted pieces are numbered
    within their thread (``part``); two ordered look-ups find the numbers of a call, so nothing is stored for moments that
    nobody asks about. With a limit a piece gets only calls that can be among the newest ``limit`` of its cursors with equal
    columns ``same``: those that begin or end inside, and the newest ones of those that are active all through it.
    """
    thread = ["run_id", "tid"]
    cursors = cursors.withColumn("_piece", F.expr(f"cursor div {piece}"))
    pieces = cursors.select(*thread, "_piece").distinct()
    pieces = ordered.ordinals(pieces, thread, "part", order="_piece")
    last = pieces.groupBy(*thread).agg(F.max("_piece").alias("_last"), F.count(F.lit(1)).alias("_parts"))
    spans = (spans.join(last, thread).withColumn("_from", F.expr(f"(seq + 1) div {piece}"))
             .withColumn("_to", F.expr(f"until div {piece}")).filter("_from <= _last"))
    # the wanted numbers a call takes: from its first piece to its last, or with a limit only those in between
    inner = 0 if limit is None else 1
    begin = _pieces_up_to(spans, pieces, thread, F.col("_from") - 1 + inner, "_begin")
    # what outlasts all wanted pieces needs no look-up
    outlasts = F.col("_to") >= F.col("_last") + inner
    lasting = begin.filter(outlasts).withColumn("_end", F.col("_parts"))
    ending = _pieces_up_to(begin.filter(~outlasts), pieces, thread, F.col("_to") - inner, "_end")
    found = lasting.unionByName(ending).filter("_begin < _end")
    wanted = cursors.join(pieces, [*thread, "_piece"])
    if limit is None:
        found = found.withColumn("part", F.explode(F.expr("sequence(_begin, _end - 1)")))
    else:
        marks = pieces.withColumnRenamed("_piece", "_at")
        starting = spans.withColumn("_at", F.col("_from")).join(marks, [*thread, "_at"])
        # calls that end at one moment, by a change of context: an older one is never shown without the newer ones
        stopping = _newest(spans.withColumn("_at", F.col("_to")).filter("_to > _from").join(marks, [*thread, "_at"]),
                           [*thread, *same, "until"], limit)
        found = (starting.unionByName(stopping).drop("_at")
                 .unionByName(_newest_through(found, wanted, [*thread, *same], limit), allowMissingColumns=True))
    return found.drop("_last", "_parts", "_from", "_to", "_begin", "_end"), wanted.drop("_piece")


def _newest(rows: DataFrame, group: list[str], limit: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("seq"))
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit).drop("_rank")


_PARTS = 32     # wanted pieces of a thread are numbered below 2^32


def _newest_through(found: DataFrame, wanted: DataFrame, group: list[str], limit: int) -> DataFrame:
    """The newest calls that take the numbers _begin to _end - 1, for each wanted group and number.

    A range of numbers is tiled by dyadic nodes, and a number is below one node a level: rows grow with the logarithm of
    the pieces, and only ``limit`` of them are kept for a range, a node and a number.
    """
    nodes = (_newest(found, [*group, "_begin", "_end"], limit)
             .withColumn("_node", F.explode(ordered.cover_nodes("_begin", "_end - 1", _PARTS))))
    nodes = _newest(nodes, [*group, "_node"], limit)
    asked = wanted.select(*group, "part").distinct().withColumn("_node", F.explode(ordered.point_nodes("part", _PARTS)))
    return _newest(nodes.join(asked, [*group, "_node"]), [*group, "part"], limit).drop("_node")


def _pieces_up_to(spans: DataFrame, pieces: DataFrame, thread: list[str], at, out: str) -> DataFrame:
    """Adds how many wanted pieces of the thread have a number up to ``at``."""
    rows = spans.withColumn("_at", at).withColumn("_wanted", F.lit(0))
    marks = pieces.select(*thread, F.col("_piece").alias("_at"), F.lit(1).alias("_wanted"))
    return (ordered.running_sum(rows.unionByName(marks, allowMissingColumns=True), thread, F.col("_wanted"), out, order="_at",
                                tie=(F.desc("_wanted"),), segment=1).filter("_wanted = 0").drop("_at", "_wanted"))


def _stacks(same: list[str], limit: int | None, columns: list[str]):
    """One thread piece: pairs of a cursor and a call active at it, the newest ``limit`` ones of each cursor or all."""
    import numpy as np
    import pyarrow as pa

    def pairs(seq, until, key, at, wanted):
        calls, moments = np.argsort(seq, kind="stable"), np.argsort(at, kind="stable")
        upto = np.searchsorted(seq[calls], at[moments])          # a call counts strictly after it
        done, heaps, open_ = 0, {}, np.zeros(0, np.int64)
        for cursor, n in zip(moments.tolist(), upto.tolist()):
            if limit is None:
                open_ = np.concatenate([open_, calls[done:n]])
                open_ = open_[until[open_] >= at[cursor]]
                yield cursor, open_
            else:
                for call in calls[done:n].tolist():
                    heapq.heappush(heaps.setdefault(key[call], []), (-seq[call], until[call], call))
                heap, newest_ = heaps.get(wanted[cursor], []), []
                while heap and len(newest_) < limit:
                    top = heapq.heappop(heap)
                    if top[1] >= at[cursor]:                      # what is over by now is over for later cursors too
                        newest_.append(top)
                for top in newest_:
                    heapq.heappush(heap, top)
                yield cursor, [top[2] for top in newest_]
            done = n

    def replay(calls: pa.Table, cursors: pa.Table) -> pa.Table:
        key = list(zip(*(calls.column(c).to_pylist() for c in same))) if same else [()] * calls.num_rows
        wanted = list(zip(*(cursors.column(c).to_pylist() for c in same))) if same else [()] * cursors.num_rows
        found = list(pairs(calls.column("seq").to_numpy(), calls.column("until").to_numpy(), key, cursors.column("cursor").to_numpy(), wanted))
        left = np.repeat(np.array([c for c, _ in found], np.int64), [len(x) for _, x in found])
        right = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for _, x in found)])
        taken = calls.take(pa.array(right))
        return pa.table({c: cursors.column(c).take(pa.array(left)) if c in ("cursor_id", "cursor") else taken.column(c) for c in columns})
    return replay


def _active(evidence: DataFrame, cursors: DataFrame, same: list[str], limit: int | None, piece: int = STACK_PIECE) -> DataFrame:
    """Active calls that agree with their cursor in the columns ``same`` too, the newest ``limit`` of them.

    A thread's calls are cut into pieces; a cursor reads the snapshot of the calls open at the beginning of its piece and
    the calls of the piece itself, in one task. With a limit its rows are bounded by the piece.
    """
    thread = ["run_id", "tid"]
    wanted = cursors.filter(F.col("tid") >= 0).select("cursor_id", *thread, "cursor", *same)
    spans = _active_spans(evidence).filter(F.col("until") > F.col("seq"))
    if same:
        spans = spans.join(wanted.select(*thread, *same).distinct(), [*thread, *same], "left_semi")
    spans, wanted = stack_snapshots(spans, wanted, piece, tuple(same), limit)
    kinds = dict(spans.dtypes) | dict(wanted.dtypes)
    columns = ["cursor_id", *thread, "cursor", "seq", "cid", "target", "returned", "until"]
    group = [*thread, "part"]
    wanted = wanted.toDF(*wanted.columns)          # cursors may be rows of the same evidence
    return spans.groupBy(*group).cogroup(wanted.groupBy(*group)).applyInArrow(
        _stacks(same, limit, columns), ", ".join(f"{c} {kinds[c]}" for c in columns))


def resolve_stack(evidence: DataFrame, calls: DataFrame, watches: DataFrame) -> DataFrame:
    """Addresses of stack storage (watch_id, run_id, tid, cursor, target, offset, size).

    The newest active call to the function, however deep in the stack, gives entry stack pointer - 8 + offset.
    """
    cursors = watches.select(F.col("watch_id").alias("cursor_id"), "run_id", "tid", "cursor",
                             F.col("target").cast(B.U64).alias("target"))
    frame = _active(evidence, cursors, ["target"], 1).select(
        F.col("cursor_id").alias("watch_id"), "run_id", F.col("seq").alias("sequence"))
    pointers = calls.select("run_id", "sequence", "stack_pointer")
    located = frame.join(pointers, ["run_id", "sequence"]).select("watch_id", "sequence", "stack_pointer")
    address = B.wrap_unsigned(F.col("stack_pointer").cast("decimal(22,0)") - 8 + F.col("offset"))
    return (watches.join(located, "watch_id", "left")
            .withColumn("address", address)
            .withColumnRenamed("sequence", "call_seq").drop("stack_pointer"))


def correlate_syscalls(syscalls: DataFrame, changes: DataFrame, segment: int | None = None) -> DataFrame:
    """Pair each system-call exit with the newest open enter of its thread.

    Input rows: (run_id, tid, seq, entering) and context changes (run_id, tid, seq). A change drops
    everything open, so pairing is last-in-first-out within one (thread, epoch).
    """
    rows = syscalls.select("run_id", "tid", "seq", "entering").withColumn("_change", F.lit(0))
    marks = changes.select("run_id", "tid", "seq", F.lit(False).alias("entering"), F.lit(1).alias("_change"))
    rows = ordered.running_sum(rows.unionByName(marks), ["run_id", "tid"], F.col("_change"), "epoch",
                               segment=segment).filter("_change = 0").drop("_change")
    return ordered.match_levels(rows, ["run_id", "tid", "epoch"], F.col("entering"), None, "enter_seq",
                                segment=segment).select("run_id", "tid", "seq", "entering", "epoch", "enter_seq")


def interrupted_syscalls(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """Context changes that cut off open system calls, with how many were open."""
    closed = pairs.filter(F.col("enter_seq").isNotNull()).select("run_id", F.col("enter_seq").alias("seq"))
    still_open = (pairs.filter("entering").join(closed, ["run_id", "seq"], "left_anti")
                  .groupBy("run_id", "tid", "epoch").agg(F.count(F.lit(1)).alias("requested")))
    marks = ordered.ordinals(changes.select("run_id", "tid", "seq"), ["run_id", "tid"], "epoch")
    return marks.join(still_open, ["run_id", "tid", "epoch"]).select(
        "run_id", "tid", "seq", "requested", F.lit("syscalls_interrupted_by_context_change").alias("reason"))


def syscall_spans(syscalls: DataFrame) -> DataFrame:
    """Enter rows with their exit by system-call id, plus orphan exits (id 0)."""
    enters = syscalls.filter("entering").select(
        "run_id", "syscall_id", F.col("thread_id").alias("tid"), F.col("sequence").alias("enter_seq"),
        F.col("monotonic_ns").alias("_in"), "number")
    exits = syscalls.filter("NOT entering").select(
        "run_id", "syscall_id", F.col("sequence").alias("exit_seq"), F.col("monotonic_ns").alias("_out"),
        "return_value", F.col("thread_id").alias("_tid"), F.col("number").alias("_number"))
    known = exits.filter("syscall_id <> 0").select("run_id", "syscall_id", "exit_seq", "_out", "return_value")
    paired = enters.join(known, ["run_id", "syscall_id"], "left").select(
        "run_id", "syscall_id", "tid", "number", "enter_seq", "exit_seq",
        (F.col("_out") - F.col("_in")).alias("duration_ns"), "return_value")
    orphans = exits.filter("syscall_id = 0").select(
        "run_id", "syscall_id", F.col("_tid").alias("tid"), F.col("_number").alias("number"),
        F.lit(None).cast("bigint").alias("enter_seq"), "exit_seq", F.lit(None).cast("bigint").alias("duration_ns"),
        "return_value")
    return paired.unionByName(orphans)


def thread_lifetimes(threads: DataFrame) -> DataFrame:
    started, finished = F.col("started"), ~F.col("started")
    return (threads.groupBy("run_id", F.col("thread_id").alias("tid"))
            .agg(F.max("os_thread_id").alias("os_tid"),
                 F.min(F.when(started, F.col("sequence"))).alias("start_seq"),
                 F.max(F.when(finished, F.col("sequence"))).alias("finish_seq"),
                 (F.max(F.when(finished, F.col("monotonic_ns")))
                  - F.min(F.when(started, F.col("monotonic_ns")))).alias("lifetime_ns")))


# --- call stack replay -------------------------------------------------------------------------

# Row kinds inside the replay: 7 call, 8 return, 0 settled orphan return, 1 start of a piece.
_LOCAL = ("run_id bigint, tid bigint, piece bigint, seq bigint, kind int, call_id bigint, address bigint, "
          "match bigint, anchor bigint, over bigint, residue boolean")


def _replay_piece(rows):
    """Replay one bounded piece of a thread without knowing the stack below it.

    A return that finds its frame above every unresolved return is settled here, with all frames it
    drops. The residue is what depends on the stack below: unresolved returns, and calls that are
    still open or lie under one. A settled span never contains residue, so the depth of a settled row
    is the stack height after the last residue row (its anchor, -1 = start of piece) plus ``over``.
    """
    import numpy as np
    rows = rows.sort_values("seq", kind="stable").reset_index(drop=True)
    kinds, addresses, seqs = (rows[c].to_numpy() for c in ("kind", "address", "seq"))
    n = len(rows)
    settled, closes = kinds == 0, np.full(n, -1, dtype=np.int64)
    frames, floor = [], 0          # open calls; those below ``floor`` lie under an unresolved return
    heights = {}                   # for each address the heights at which it was pushed; those that are no more are popped when met
    for i in range(n):
        if kinds[i] == 7:
            heights.setdefault(addresses[i], []).append(len(frames))
            frames.append(i)
        elif kinds[i] == 8:
            at = _top(heights.get(addresses[i]), frames, addresses, addresses[i])
            if at >= floor:
                closes[i] = frames[at]
                settled[i] = True
                settled[frames[at:]] = True
                del frames[at:]
            else:
                floor = len(frames)
    anchor, over = np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    last, inside = -1, []
    for i in range(n):
        if closes[i] >= 0:
            while inside.pop() != closes[i]:
                pass
        anchor[i], over[i] = last, len(inside)
        if not settled[i]:
            last = seqs[i]
        elif kinds[i] == 7:
            inside.append(i)
    ids = rows["call_id"].to_numpy()
    return rows[["run_id", "tid", "piece", "seq", "kind", "call_id", "address"]].assign(
        match=np.where(closes >= 0, ids[np.maximum(closes, 0)], 0), anchor=anchor, over=over, residue=~settled)


def _top(heights, frames, addresses, address):
    """The greatest height at which an open frame expects the address, -1 if there is none."""
    while heights:
        if heights[-1] < len(frames) and addresses[frames[heights[-1]]] == address:
            return heights[-1]
        heights.pop()
    return -1


_REPLAYED = "run_id bigint, tid bigint, piece bigint, seq bigint, match bigint, depth bigint, height bigint"


def _replay_residue(batches):
    """Stream residue rows in (run, thread, sequence) order, keeping only the open frames."""
    import pandas as pd
    columns = ["run_id", "tid", "piece", "seq", "kind", "call_id", "address"]
    owner, frames, expected, heights = None, [], [], {}
    for batch in batches:
        out = []
        for run, tid, piece, seq, kind, cid, address in batch[columns].itertuples(index=False, name=None):
            if owner != (run, tid):
                owner, frames, expected, heights = (run, tid), [], [], {}
            match, depth = 0, len(frames)
            if kind == 7:
                heights.setdefault(address, []).append(len(frames))
                frames.append(cid)
                expected.append(address)
            elif kind == 8:
                at = _top(heights.get(address), range(len(frames)), expected, address)
                if at >= 0:
                    match, depth = frames[at], at
                    del frames[at:], expected[at:]
            out.append((run, tid, piece, seq, match, depth, len(frames)))
        yield pd.DataFrame(out, columns=["run_id", "tid", "piece", "seq", "match", "depth", "height"])


def correlate_calls(rows: DataFrame, piece: int = FRAME_PIECE) -> DataFrame:
    """Match returns to calls by expected return address and give both their stack depth.

    Rows: (run_id, tid, seq, kind 7 or 8, call_id, address); address is the expected return address
    of a call and the actual target of a return. The nearest open frame with that address matches and
    is dropped with everything above it; a return without such a frame changes nothing (id 0).

    Pieces of a thread are replayed in parallel and settle what they can. Only the residue (about the
    change of stack depth per piece) is replayed in thread order, and streamed, not collected. A return
    to an address that no earlier call of its thread expected is an orphan and settled beforehand.
    """
    rows = rows.select("run_id", "tid", "seq", F.col("kind").cast("int").alias("kind"),
                       F.col("call_id").cast("bigint").alias("call_id"),
                       B.to_signed("address").cast("bigint").alias("address"))
    first = rows.filter("kind = 7").groupBy("run_id", "tid", "address").agg(F.min("seq").alias("_first"))
    orphan = (F.col("kind") == 8) & ~F.coalesce(F.col("_first") < F.col("seq"), F.lit(False))
    marked = (rows.join(first, ["run_id", "tid", "address"], "left")
              .withColumn("kind", F.when(orphan, F.lit(0)).otherwise(F.col("kind")))
              .withColumn("piece", F.expr(f"CAST(seq div {piece} AS BIGINT)")).drop("_first"))
    # Read twice below; written once, so that the replay runs once and survives lost executors.
    local = reliable_checkpoint(marked.groupBy("run_id", "tid", "piece").applyInPandas(_replay_piece, _LOCAL))
    zero = F.lit(0).cast("bigint")
    starts = local.select("run_id", "tid", "piece").distinct().select(
        "run_id", "tid", "piece", F.lit(-1).cast("bigint").alias("seq"), F.lit(1).alias("kind"),
        zero.alias("call_id"), zero.alias("address"))
    residue = local.filter("residue").select(*starts.columns).unionByName(starts)
    replayed = (residue.repartition("run_id", "tid").sortWithinPartitions("run_id", "tid", "piece", "seq")
                .mapInPandas(_replay_residue, _REPLAYED))
    below = replayed.select("run_id", "tid", "piece", F.col("seq").alias("anchor"), "height")
    own = replayed.filter("seq >= 0").select("run_id", "tid", "piece", "seq", F.col("match").alias("_match"), "depth")
    joined = (local.join(below, ["run_id", "tid", "piece", "anchor"], "left")
              .join(own, ["run_id", "tid", "piece", "seq"], "left"))
    closes = F.when(F.col("residue"), F.col("_match")).otherwise(F.col("match"))
    return joined.select(
        "run_id", "tid", "seq", F.when(F.col("kind") == 7, F.lit(7)).otherwise(F.lit(8)).alias("kind"),
        F.when(F.col("kind") == 7, F.col("call_id")).otherwise(closes).alias("call_id"),
        F.when(F.col("residue"), F.col("depth")).otherwise(F.col("height") + F.col("over")).alias("depth"),
        ((F.col("kind") == 7) | (closes != 0)).alias("matched"))
