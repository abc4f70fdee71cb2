"""Personal data: candidate spans, scored by boosted trees over their format and context. DataFrame operations only.

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers, leftmost and without overlap for each
kind; matches that fail their check are dropped. Beside them wide generators propose more spans of each kind (other
separators, bracketed "at" and "dot", phone numbers without the plus sign, longer dotted numbers); spans of different
generators overlap freely. A candidate is described by a few small numbers (digits, separators, checks, what stands before
and after, whether a telling word stands in front). Candidates that meet a base span of their kind are the positive ones.
They never see the sign that makes a base match (the plus of a phone number is not part of what is described), so the trees
learn what such data looks like otherwise.

Learning is counting: all candidates of all documents are counted by description, at most CELLS different ones, and trees
are boosted on these counts. A fifth of the documents (by a hash of doc_id) is left out of the trees; on it the lowest
score is chosen for each kind at which PRECISION of the candidates meet base spans. Candidates at or above it that touch no
base span are added, overlapping ones as one span of the kind with the best score. Base spans always stay.

Regular expressions are written so that each starts once per run of its characters and never steps back over it: time is
linear in the text. Positions are sums of the lengths between matches, in code points.

Defined results: a null or empty text has no spans; each row is answered by its own text, whatever its doc_id; rows without
doc_id learn like all others; with too few held-out candidates of a kind nothing is added to it; an empty table gives an
empty table; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm import shared

KINDS = ["email", "ip", "card", "phone"]
PRECISION, HELD = 0.95, 20
TREES, DEPTH, RATE = 24, 3, 0.3

_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
_NUMBER = r"(?:\G|(?<![0-9]))[0-9]"
BASE = [
    _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    _NUMBER + r"++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
WIDE = [
    r"(?i)" + _LOCAL + r"(?:@|\x20?[(\[{]\x20?at\x20?[)\]}]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?)[A-Za-z0-9-]++)*+",
    _NUMBER + r"++(?:(?:\x20?\.\x20?|[(\[]\.[)\]])[0-9]++){3,}+",
    _NUMBER + r"(?:[\x20._/-]{0,2}+[0-9]){11,}+",
    r"\(?" + _NUMBER + r"(?:[\x20()./-]{0,3}+[0-9]){6,}+",
]
#: Words that announce the kind of what follows.
TELLING = [r"mail|contact|kontakt|correo|courriel", r"\bip\b|host|server|addr|address|adresse|dirección",
           r"card|visa|credit|karte|carte|tarjeta|konto|cuenta", r"tel|phone|fon|call|mobil|fax|llam|appel"]
#: Every number that describes a candidate and how many values it has.
FEATURES = {"kind": 4, "digits": 10, "separators": 5, "valid": 2, "lead": 2, "before": 4, "after": 4, "told": 2, "unusual": 2}
CELLS = math.prod(FEATURES.values())


# ---- candidates ----------------------------------------------------------------------------------------------------

_FOUND = "array<struct<generator:int,i:int,gap:int,m:string,head:string,tail:string>>"


def _matches(text: Column, found: Column, pattern: str, generator: int) -> Column:
    """The matches of a pattern with the length of the gap before each, the gap's end and the beginning of the next one."""
    gaps = F.split(text, pattern, -1)
    n = F.size(found)
    zipped = F.arrays_zip(found, F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n)).cast("array<struct<m:string,b:string,a:string>>")
    part = F.transform(zipped, lambda x, i: F.struct(
        F.lit(generator).alias("generator"), i.alias("i"), F.length(x["b"]).alias("gap"), x["m"].alias("m"),
        F.substring(x["b"], -30, 30).alias("head"), F.substring(x["a"], 1, 1).alias("tail")))
    return F.when(n > 0, part).otherwise(F.array().cast(_FOUND))


def found_spans(docs: DataFrame) -> DataFrame:
    """One row a document: row number, doc_id, and what base patterns (0-3) and wide generators (4-7) match. Written once."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    patterns = [*BASE, *WIDE]
    rows = rows.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m{g}") for g, p in enumerate(patterns)))
    every = F.concat(*(_matches(F.col("text"), F.col(f"m{g}"), p, g) for g, p in enumerate(patterns)))
    return shared.written(rows.select("rid", "doc_id", every.alias("found")), "found-spans")


def _bin(value: Column, edges: list[int]) -> Column:
    """How many of the (ascending) edges the value reaches."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))


def _around(c: Column) -> Column:
    """Nothing or white space (or the sign of a number): 0, letter: 1, digit: 2, other: 3."""
    return F.when((c == "") | c.rlike(r"^[\s+]"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).otherwise(3)


def _by_kind(*values: Column) -> Column:
    return F.when(F.col("kind") == 0, values[0]).when(F.col("kind") == 1, values[1]).when(F.col("kind") == 2, values[2]).otherwise(values[3])


_IP = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"


def described(found: DataFrame) -> DataFrame:
    """A row for every span: rid, doc_id, base (it is a base span), kind, start, stop, and its description. Base matches
    that fail their check are gone."""
    rows = found.select("rid", "doc_id", F.explode("found").alias("s")).select("rid", "doc_id", "s.*")
    rows = rows.repartition("rid")
    upto = F.sum(F.col("gap") + F.length("m")).over(
        Window.partitionBy("rid", "generator").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("stop", upto.cast("long")).withColumn("start", F.col("stop") - F.length("m"))
    m = F.col("m")
    rows = rows.withColumn("base", F.col("generator") < len(KINDS)).withColumn("kind", F.col("generator") % len(KINDS))
    rows = rows.withColumn("number", F.regexp_replace(m, "[^0-9]", "")).withColumn("n", F.length("number"))
    luhn = F.col("n").between(13, 19) & F.call_function("luhn_check", F.substring("number", 1, 19))
    dotted = F.regexp_replace(F.regexp_replace(m, r"[\x20()\[\]]", ""), r"\.+", ".")
    valid = _by_kind(F.when(F.col("base"), F.lit(True)).otherwise(m.rlike(r"(?i)[.)\]}]\x20?[a-z]{2,24}$")),
                     F.when(F.col("base"), m.rlike(_IP)).otherwise(dotted.rlike(_IP)), luhn, F.col("n").between(9, 15))
    rows = rows.withColumn("valid", valid.cast("int")).filter("NOT base OR valid = 1")
    marks = F.length(m) - F.length(F.regexp_replace(m, r"[^A-Za-z0-9]", ""))
    return rows.select(
        "rid", "doc_id", "base", "kind", "start", "stop", "valid",
        F.when(F.col("kind") == 0, 0).otherwise(_bin(F.col("n"), [7, 9, 10, 11, 12, 13, 16, 17, 20])).alias("digits"),
        F.least(marks, F.lit(FEATURES["separators"] - 1)).alias("separators"),
        m.startswith("(").cast("int").alias("lead"), _around(F.substring("head", -1, 1)).alias("before"), _around(F.col("tail")).alias("after"),
        _by_kind(*(F.lower("head").rlike(t) for t in TELLING)).cast("int").alias("told"),
        _by_kind(~m.contains("@"), m.rlike(r"[^0-9.]"), m.rlike(r"[^0-9\x20-]"), m.rlike("[/]|[^0-9]{4}")).cast("int").alias("unusual"))


def _meets(rows: DataFrame, name: str, *group: str) -> DataFrame:
    """Whether a span meets a base span of its group: one that begins before ends behind its start, or the next one begins
    before its end."""
    base_stop, base_start = F.when(F.col("base"), F.col("stop")), F.when(F.col("base"), F.col("start"))
    ahead = Window.partitionBy(*group).orderBy("start", F.desc("base")).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*group).orderBy(F.desc("start"), F.desc("base")).rowsBetween(Window.unboundedPreceding, 0)
    meets = (F.max(base_stop).over(ahead) > F.col("start")) | (F.min(base_start).over(behind) < F.col("stop"))
    return rows.withColumn(name, F.coalesce(meets, F.lit(False)))


# ---- learning on counts --------------------------------------------------------------------------------------------

Tree = tuple | float        # (feature, highest value on the left, left, right) or a leaf's value


def boosted(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[Tree]:
    """Trees over described cells with their numbers of positive and negative candidates; logistic loss."""
    margin, trees = np.zeros(len(x)), []

    def grow(rows: np.ndarray, depth: int) -> Tree:
        total_g, total_w = g[rows].sum(), w[rows].sum()
        best = (1e-6, None)
        if depth < DEPTH:
            for k in range(x.shape[1]):
                size = int(x[rows, k].max()) + 1
                left_g, left_w = (np.cumsum(np.bincount(x[rows, k], v[rows], size))[:-1] for v in (g, w))
                gain = left_g**2 / (left_w + 1) + (total_g - left_g) ** 2 / (total_w - left_w + 1) - total_g**2 / (total_w + 1)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (k, int(gain.argmax())))
        if best[1] is None:
            value = float(RATE * total_g / (total_w + 1))
            margin[rows] += value
            return value
        k, at = best[1]
        left = x[rows, k] <= at
        return k, at, grow(rows[left], depth + 1), grow(rows[~left], depth + 1)

    for _ in range(TREES if len(x) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, w = good - (good + bad) * p, (good + bad) * p * (1 - p)
        trees.append(grow(np.arange(len(x)), 0))
    return trees


def _value(tree: Tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    k, at, left, right = tree
    return np.where(x[:, k] <= at, _value(left, x), _value(right, x))


def _column(tree: Tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    k, at, left, right = tree
    return F.when(F.col(list(FEATURES)[k]) <= at, _column(left)).otherwise(_column(right))


def margins(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return np.round(sum((_value(t, x) for t in trees), np.zeros(len(x))), 9)


def thresholds(x: np.ndarray, margin: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[float]:
    """For each kind the lowest margin such that PRECISION of the held-out candidates from it on are positive; infinite, if
    fewer than HELD of them are above any."""
    out = []
    for kind in range(len(KINDS)):
        mine = np.flatnonzero((x[:, 0] == kind) & (good + bad > 0))
        levels, at = np.unique(-margin[mine], return_inverse=True)
        hits, all_ = (np.cumsum(np.bincount(at, v[mine], len(levels))) for v in (good, good + bad))
        fine = np.flatnonzero((all_ >= HELD) & (hits >= PRECISION * all_))
        out.append(float(-levels[fine[-1]]) if len(fine) else math.inf)
    return out


def learned(candidates: DataFrame) -> tuple[list[Tree], list[float]]:
    """Trees and thresholds from the counts of all candidates (columns of FEATURES, meets, held)."""
    counts = candidates.groupBy(*FEATURES).agg(*(
        F.count_if((F.col("meets") == bool(m)) & (F.col("held") == bool(h))).alias(f"n{m}{h}") for m in (0, 1) for h in (0, 1)))
    cells = counts.orderBy(*FEATURES).collect()                        # at most CELLS rows of 13 numbers
    x = np.array([[r[f] for f in FEATURES] for r in cells], np.int64).reshape(-1, len(FEATURES))
    n = {c: np.array([r[c] for r in cells], float) for c in ("n00", "n01", "n10", "n11")}
    trees = boosted(x, n["n10"], n["n00"])
    return trees, thresholds(x, margins(trees, x), n["n11"], n["n01"])


# ---- operator ------------------------------------------------------------------------------------------------------

def private_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid and doc_id of every document, its spans: rid, kind, start, stop, base)."""
    found = found_spans(docs)
    rows = _meets(_meets(described(found), "meets", "rid", "kind"), "touches", "rid")
    rows = rows.withColumn("held", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0)
    rows = shared.written(rows, "private-candidates")
    trees, bars = learned(rows.filter("NOT base"))
    margin = F.round(sum((_column(t) for t in trees), F.lit(0.0)), 9)
    bar = _by_kind(*(F.lit(b) for b in bars))
    added = rows.filter("NOT base AND NOT touches").withColumn("margin", margin).filter(F.col("margin") >= bar)
    # overlapping ones become one span, of the kind with the best score
    before = Window.partitionBy("rid").orderBy("start", "stop", "kind").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("rid").orderBy("start", "stop", "kind").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.max("stop").over(before) <= F.col("start"), F.lit(True))
    added = added.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(upto)).groupBy("rid", "island").agg(
        F.max_by("kind", F.struct("margin", -F.col("kind"))).alias("kind"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = rows.filter("base").select("rid", "kind", "start", "stop", "base").unionByName(
        added.select("rid", "kind", "start", "stop", F.lit(False).alias("base")))
    return found.select("rid", "doc_id"), spans


def _listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined, by kind as listed and start."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def private_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the numbers of base spans of each kind, base_sha256, spans (base and added), n_added."""
    rows, spans = private_spans(docs)
    span = F.struct("kind", "start", "stop")
    of_row = spans.groupBy("rid").agg(
        *(F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.count(F.when(~F.col("base"), 1)).alias("n_added"),
        F.collect_list(F.when(F.col("base"), span)).alias("base_spans"), F.collect_list(span).alias("all_spans"))
    none = F.lit(0).cast("long")
    return rows.join(of_row, "rid", "left").select(
        "doc_id", *(F.coalesce(f"n_{name}", none).alias(f"n_{name}") for name in KINDS),
        F.sha2(F.coalesce(_listed(F.col("base_spans")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_listed(F.col("all_spans")), F.lit("")).alias("spans"), F.coalesce("n_added", none).alias("n_added"))
