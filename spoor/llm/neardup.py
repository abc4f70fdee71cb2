"""MinHash near-dedup by a multi-index Hamming join.

A text's set holds its distinct shingles of five words (A-Z lower-cased; with fewer words the whole sequence is the one
shingle; without words the set is empty and linked with nothing). Texts are linked when 100 * |intersection| >= 75 * |union|.

1. Equal sets form one class; only its smallest doc_id goes on.
2. A class has a signature of 80 MinHash values of 16 bits. They are split into 16 chunks of five. Two signatures that
   differ in at most 31 places have a chunk with at most one error (pigeonhole: 32 errors are needed to put two into
   each chunk), so each chunk is entered five times, with each value left out in turn: equal entries meet. Pairs further
   apart meet too, unless every chunk holds two errors: at a similarity of 0.75 that leaves out 1 pair in 10 million.
3. Under every entry the members are compared with the smallest one only. Candidates whose sizes exclude a link, or whose
   signatures, lengthened by 688 MinHash values of 8 bits, agree in fewer than 516 of 768 places (at 0.75 the mean is 576,
   the deviation 12) are dropped, the others are confirmed on their full sets, and links become components.
4. In entries that still hold two components all pairs across components are compared, block by block, each pair under the
   first entry it shares, and those that pass the same test are confirmed. Pairs inside one component need no comparison.

Sets are identified by 128 bits, two sums over hashes of different construction; links count equal 64-bit shingle hashes.

Defined results: rows with equal texts are copies and all returned; each row that shares a doc_id with others is judged by
its own text; a row without doc_id is never `kept` and has the component of its class (null, if no row of the class has a
doc_id; such classes are linked with nothing); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.llm import graph, shared, text

WORDS, PERCENT = 5, 75
CHUNKS, CHUNK = 16, 5
VALUES = CHUNKS * CHUNK
MORE = 688               # further values of 8 bits that only tell candidates apart
AGREE = 516              # places, of all 256, in which the signatures of a candidate pair agree at least
IDENTITY = ["one", "two", "n_shingles"]
BLOCK = 512              # members of an entry compared in one task at a time, with as many others
_U = np.uint64


def _sets(data, offsets, hasher) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every row of a piece, and two numbers that identify the set: one adds up the
    hashes, the other adds up hashes of another construction over the same shingles."""
    starts, ends, bounds = text.words(data, offsets)
    h, g = hasher.both(data, starts, ends)
    five, again = text.windows(h, WORDS), text.windows(g, WORDS, seed=12)
    out, one, two = [], np.zeros(len(bounds) - 1, _U), np.zeros(len(bounds) - 1, _U)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b - a >= WORDS:
            x, first = np.unique(five[a:b - WORDS + 1], return_index=True)
            y = again[a:b - WORDS + 1][first]
        else:
            x, y = (text.windows(w[a:b], b - a, seed=1000 + k + b - a) if b > a else w[:0] for k, w in ((0, h), (500, g)))
        out.append(x)
        one[i], two[i] = text.mix(x + _U(1)).sum(dtype=_U), text.mix(y + _U(2)).sum(dtype=_U)
    return out, one.view(np.int64), two.view(np.int64)


def _sketch(batches):
    hasher, factors = text.SpanHasher(2, lower=True), text.constants(77, VALUES + MORE)
    for batch in batches:
        for a, b, data, offsets in text.pieces(batch.column(1)):
            with np.errstate(over="ignore"):
                sets, one, two = _sets(data, offsets, hasher)
                size = np.array([len(s) for s in sets], np.int64)
                some = size > 0
                low = np.zeros((b - a, VALUES + MORE), np.uint16)
                if some.any():
                    x = np.concatenate(sets)
                    at = np.concatenate([[0], np.cumsum(size[some])[:-1]])
                    for k, f in enumerate(factors):
                        low[some, k] = text.mix(np.minimum.reduceat(x * f, at)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(size), pa.array(one), pa.array(two),
                 pa.array([r[:VALUES].tobytes() + r[VALUES:].astype(np.uint8).tobytes() for r in low], pa.binary())],
                ["doc_id", "n_shingles", "one", "two", "sig"])


def _keys(sig: np.ndarray) -> np.ndarray:
    """The entries of signatures (n, VALUES): every chunk with each of its values left out, as (n, VALUES) keys."""
    salt = text.constants(91, CHUNKS * CHUNK).reshape(CHUNKS, CHUNK)
    sig = sig.reshape(-1, CHUNKS, CHUNK).astype(_U)
    keys = np.empty(sig.shape, _U)
    for left_out in range(CHUNK):
        key = np.zeros(sig.shape[:2], _U)
        for i in range(CHUNK):
            if i != left_out:
                key = (key << _U(16)) | sig[:, :, i]
        keys[:, :, left_out] = text.mix(key ^ salt[:, left_out])
    return keys.reshape(-1, VALUES).view(np.int64)


def _entries(batches):
    """(k, cid) of every entry of a signature."""
    for batch in batches:
        sig = np.frombuffer(b"".join([x[:2 * VALUES] for x in batch.column(1).to_pylist()]), np.uint16)
        with np.errstate(over="ignore"):
            keys = _keys(sig)
        cid = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), VALUES)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(cid)], ["k", "cid"])


def _first_entry(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of the first entry two signatures share."""
    same = (x == y).reshape(-1, CHUNKS, CHUNK)
    count = same.sum(axis=2)
    chunk = (count >= CHUNK - 1).argmax(axis=1)
    at = np.arange(len(chunk))
    left_out = np.where(count[at, chunk] == CHUNK, 0, same[at, chunk].argmin(axis=1))
    return chunk * CHUNK + left_out


def _signatures(column) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * VALUES + MORE)
    return np.ascontiguousarray(raw[:, :2 * VALUES]).view(np.uint16), raw[:, 2 * VALUES:]


def _agreement(x: tuple, i, y: tuple, j) -> np.ndarray:
    return (x[0][i] == y[0][j]).sum(1) + (x[1][i] == y[1][j]).sum(1)


def _alike(batches):
    """Candidate pairs (a, b, a_size, a_sig, b_size, b_sig) whose signatures and sizes allow a link."""
    for batch in batches:
        x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
        ok = 100 * np.minimum(x, y) >= PERCENT * np.maximum(x, y)
        ok &= _agreement(_signatures(batch.column(3)), slice(None), _signatures(batch.column(5)), slice(None)) >= AGREE
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1)], ["a", "b"])


def _blockwise(batches) -> Iterator[pa.RecordBatch]:
    """Rows (k, p, q, cid, own, label, size, sig) sorted by (k, p, q): pairs of each group with different labels."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        new = _group_starts(table)
        last = int(np.flatnonzero(new)[-1]) if len(new) else 0
        held = table.slice(last)                        # the last group may go on in the next batch
        yield _pairs(table.slice(0, last))
    if held is not None:
        yield _pairs(held)


def _group_starts(table: pa.Table) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    if table.num_rows:
        k, p, q = (table.column(i).to_numpy() for i in range(3))
        new[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    return new


def _pairs(table: pa.Table) -> pa.RecordBatch:
    k, p, q, cid, own, label, size = (table.column(i).to_numpy() for i in range(7))
    sig = _signatures(table.column(7))
    n, found = table.num_rows, [np.zeros((2, 0), np.int64)]
    new = _group_starts(table)
    with np.errstate(over="ignore"):                   # a pair is looked at under the first entry it shares only
        entry = (_keys(sig[0][new]) == k[new][:, None]).argmax(axis=1)[np.cumsum(new) - 1] if n else k
    end = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1] if n else np.zeros(0, np.int64)
    i, step = np.arange(n), 1
    while len(i := i[i + step < end[i]]):
        for part in np.array_split(i, len(i) // 50_000 + 1):
            j = part + step
            ok = (label[part] != label[j]) & ((p[part] == q[part]) | (own[part] != own[j]))
            ok &= 100 * np.minimum(size[part], size[j]) >= PERCENT * np.maximum(size[part], size[j])
            x, y = part[ok], j[ok]
            near = _agreement(sig, x, sig, y) >= AGREE
            near[near] = _first_entry(sig[0][x[near]], sig[0][y[near]]) == entry[x[near]]
            found.append(np.stack([x[near], y[near]]))
        step += 1
    x, y = np.concatenate(found, axis=1)
    both = np.unique(np.stack([np.minimum(cid[x], cid[y]), np.maximum(cid[x], cid[y])]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


def _full_sets(batches):
    hasher = text.SpanHasher(2, lower=True)
    for batch in batches:
        for a, b, data, offsets in text.pieces(batch.column(1)):
            with np.errstate(over="ignore"):
                sets, one, two = _sets(data, offsets, hasher)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(one), pa.array(two),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], ["low", "one", "two", "items"])


def _identified(batches):
    """The rows without their last column, the text, and the identity of its set in three columns more."""
    hasher = text.SpanHasher(2, lower=True)
    for batch in batches:
        for a, b, data, offsets in text.pieces(batch.column(batch.num_columns - 1)):
            with np.errstate(over="ignore"):
                sets, one, two = _sets(data, offsets, hasher)
            own = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
            size = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*own, pa.array(one), pa.array(two), size], [*batch.schema.names[:-1], *(f"__{c}" for c in IDENTITY)])


def _confirm(batches):
    """Rows (a, salt, role, id, items), the set of a first, then those of its candidates: the links."""
    head, items = None, None
    for batch in batches:
        out = [[], []]
        for a, salt, role, id_, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
            other = np.frombuffer(raw, _U)
            if role == 0:
                head, items = (a, salt), other
            elif head == (a, salt) and len(items):
                at = np.minimum(np.searchsorted(items, other), len(items) - 1)
                same = int((items[at] == other).sum())
                if 100 * same >= PERCENT * (len(items) + len(other) - same):
                    out[0].append(a)
                    out[1].append(id_)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])


def confirmed(docs: DataFrame, classes: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) that are linked on their full sets. A set is sent once per 64 of its candidates. The text
    of a class is that of its smallest doc_id whose set is the class's own, for rows may share a doc_id."""
    ids = candidates.select(F.col("a").alias("cid")).unionAll(candidates.select(F.col("b").alias("cid"))).distinct()
    asked = shared.written(classes.select("cid", "low", "one", "two").join(ids, "cid"), "asked-classes")
    rows = shared.only(docs, asked.select(F.col("low").alias("doc_id")).distinct(), "doc_id").select("doc_id", "text")
    sets = shared.written(rows.mapInArrow(_full_sets, "low long, one long, two long, items binary"), "shingle-sets")
    sets = sets.join(asked, ["low", "one", "two"]).dropDuplicates(["cid"]).select(F.col("cid").alias("id"), "items")
    parts = candidates.groupBy("a").agg(F.ceil(F.count("*") / 64).alias("parts"))
    dealt = shared.written(candidates.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt")), "dealt")
    heads = dealt.select("a", "salt").distinct().join(sets, F.col("a") == F.col("id")).select("a", "salt", F.lit(0).alias("role"), "id", "items")
    others = dealt.join(sets, F.col("b") == F.col("id")).select("a", "salt", F.lit(1).alias("role"), "id", "items")
    stream = heads.unionAll(others).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return shared.written(stream.mapInArrow(_confirm, "a long, b long"), "near-links")


def linked(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of the classes (cid, n_shingles, sig) that are linked with any."""
    entries = classes.select("cid", "sig").mapInArrow(_entries, "k long, cid long")
    hubs = entries.groupBy("k").agg(F.min("cid").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    crowd = shared.written(entries.join(hubs, "k"), "entries")
    one = lambda name: classes.select(F.col("cid").alias(name), F.col("n_shingles").alias(f"{name}_size"), F.col("sig").alias(f"{name}_sig"))
    first = crowd.filter("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    first = shared.written(first.join(one("b"), "b").join(one("a"), "a").select("a", "b", "a_size", "a_sig", "b_size", "b_sig")
                           .mapInArrow(_alike, "a long, b long"), "candidates")
    labels = graph.components(confirmed(docs, classes, first))
    second = shared.written(_across(crowd, labels, classes).join(first, ["a", "b"], "left_anti"), "candidates")
    found = confirmed(docs, classes, second)
    return shared.written(graph.extended(labels, found), "labels") if found.limit(1).count() else labels


def _across(crowd: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidate pairs of classes that share an entry but no label yet."""
    tagged = crowd.select("k", "cid").join(labels, F.col("cid") == F.col("node"), "left").select(
        "k", "cid", F.coalesce("component", "cid").alias("label"))
    mixed = tagged.groupBy("k").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).filter("x <> y").select(
        "k", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    rest = tagged.join(mixed, "k").join(classes.select("cid", "n_shingles", "sig"), "cid")
    rest = rest.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rest = rest.select("k", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "cid", "own", "label", "n_shingles", "sig")
    return rest.repartition("k", "p", "q").sortWithinPartitions("k", "p", "q").mapInArrow(_blockwise, "a long, b long")


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a sketch per row, for every class with a doc_id its identity and component_id)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = shared.written(docs.mapInArrow(_sketch, "doc_id long, n_shingles long, one long, two long, sig binary"), "sketches")
    classes = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*IDENTITY).agg(
        F.min("doc_id").alias("low"), F.max("sig").alias("sig"))
    # A class is numbered by its smallest doc_id; where rows of one doc_id make several classes, by its place in that order.
    classes = shared.written(classes.withColumn("cid", F.col("low")), "classes")
    if not classes.groupBy("low").count().filter("count > 1").isEmpty():
        ordered = classes.drop("cid").repartitionByRange("low").sortWithinPartitions("low", *IDENTITY)
        classes = shared.written(ordered.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = linked(docs, classes).join(classes.select("low", F.col("cid").alias("node")), "node")
    smallest = found.groupBy("component").agg(F.min("low").alias("component_id"))
    found = found.join(smallest, "component").select(F.col("node").alias("cid"), "component_id")
    return sketches.drop("sig"), classes.join(found, "cid", "left").select(*IDENTITY, F.coalesce("component_id", "low").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept (it is that one)."""
    sketches, placed = _placed(docs)
    rows = sketches.join(placed, IDENTITY, "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, all columns, of which one of each group stays: its smallest doc_id (an exact copy of a row, id
    included, stays with it). A row without doc_id stays if nothing with a doc_id has its set, once for each such set; one
    without words always does."""
    spark = docs.sparkSession

    def judged():
        sketches, placed = _placed(docs)
        rows = sketches.join(placed, IDENTITY, "left")
        kept = F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(False))
        none = F.lit(None).cast("long")
        ids = rows.filter("doc_id IS NOT NULL").withColumn("kept", kept).groupBy("doc_id").agg(
            F.bool_or("kept").alias("some"), F.bool_and("kept").alias("every")).filter("NOT every")
        gone = rows.filter("doc_id IS NULL AND component_id IS NOT NULL").select(none.alias("__id"), F.lit(False).alias("__mixed"), *IDENTITY)
        ids = ids.select(F.col("doc_id").alias("__id"), F.col("some").alias("__mixed"))
        mixed = rows.withColumn("kept", kept).filter("NOT kept").join(ids.filter("__mixed"), F.col("doc_id") == F.col("__id"))
        return ids.select("*", *(none.alias(c) for c in IDENTITY)).unionByName(gone.distinct()).unionByName(
            mixed.select("__id", "__mixed", *IDENTITY).distinct())

    gone = shared.settled(spark, judged, "near-copies")
    whole = gone.filter("NOT __mixed AND __id IS NOT NULL").select("__id")
    odd = gone.filter("__mixed AND one IS NULL").select("__id")            # ids of which some rows go and some stay
    few = F.broadcast(whole) if whole.limit(shared.BROADCAST_IDS + 1).count() <= shared.BROADCAST_IDS else whole
    left = docs.join(few, F.col("doc_id") == F.col("__id"), "left_anti")
    nameless = docs.filter("doc_id IS NULL")
    if odd.isEmpty() and nameless.isEmpty():
        return left
    # rows whose id does not tell whether they go are told by the identity of their sets
    plain = left.filter("doc_id IS NOT NULL").join(odd, F.col("doc_id") == F.col("__id"), "left_anti")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(f"__{c}", T.LongType()) for c in IDENTITY)])
    told = lambda rows: rows.withColumn("__text", F.col("text").cast("string")).mapInArrow(_identified, schema)
    gone = gone.filter("one IS NOT NULL").select("__id", *(F.col(c).alias(f"__g_{c}") for c in IDENTITY))
    by = [F.col(f"__g_{c}") == F.col(f"__{c}") for c in IDENTITY]
    some = told(docs.join(odd, F.col("doc_id") == F.col("__id"), "left_semi")).join(gone, [F.col("doc_id") == F.col("__id"), *by], "left_anti")
    rest = told(nameless).join(gone.filter("__id IS NULL"), by, "left_anti")
    empty = rest.filter("__n_shingles = 0")
    rest = rest.filter("__n_shingles > 0").dropDuplicates([f"__{c}" for c in IDENTITY])
    return plain.unionByName(some.unionByName(empty).unionByName(rest).select(docs.columns))
