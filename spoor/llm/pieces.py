"""SentencePiece encoding and decoding with the N best segmentations.

The piece lattice of a text has an edge for every piece of the vocabulary that matches at a place, and for a character
without a piece of its own the chain of its byte pieces; a path's score is the sum of its pieces' scores. A forward Viterbi
pass finds the best score from the start to every place. It is the exact heuristic of an A* search backward from the end,
which therefore yields the segmentations in order of their scores.

Where two neighbouring characters occur side by side in no piece, every path passes between them. Texts are cut there
into short stretches. The forward pass over each distinct one, made once while it is remembered, keeps the two best scores, so it
tells what a stretch loses by its second segmentation. A text's N best segmentations differ from the best one in stretches
with the smallest losses only, and only these are searched by A*. The ids of
all N are given back, and each is decoded on its own.

As in the model, a space is written as the mark U+2581, a text starts with one more, and nothing else is normalized. The
mark itself, where a text holds it, is coded by its bytes, so decoding gives back every text exactly.

Defined results: a null or empty text has no pieces (one segmentation, score 0); a text with fewer than N segmentations
has fewer ways; of equal scores the one found first counts, the same wherever the stretch occurs; rows may repeat; an
empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm import text

BEST = 4
KNOWN = 300_000
_MARK = "▁"


class Vocabulary:
    """Pieces as text with plain spaces, their ids and scores, and the byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte = [0] * 256
        size = model.get_piece_size()
        self.bytes_of = [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = piece.replace(_MARK, " ")
                self.pieces[piece] = (i, model.get_score(i))
                self.bytes_of[i] = piece.encode()
        # every piece, and None for what a piece can begin with
        self.table = dict.fromkeys(p[:k] for p in self.pieces for k in range(1, len(p))) | {
            p: (score, (i,)) for p, (i, score) in self.pieces.items()}
        self.byte_score = min(s for _, s in self.pieces.values()) - 10.0                # worse than any piece
        self.beside = np.zeros((256, 256), bool)                                        # neighbouring bytes of a piece
        for piece in self.pieces:
            raw = np.frombuffer(piece.encode(), np.uint8)
            self.beside[raw[:-1], raw[1:]] = True

    def edges(self, s: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """For every place the edges that end there (start, score, ids), and the best score from the start to it."""
        table, n = self.table, len(s)
        ending: list[list] = [[] for _ in range(n + 1)]
        ahead = [0.0] + [-np.inf] * n
        for i in range(n):
            here, single = ahead[i], False
            for j in range(i + 1, n + 1):
                edge = table.get(s[i:j], 0)
                if edge == 0:
                    break
                if edge is not None:
                    score, ids = edge
                    ending[j].append((i, score, ids))
                    if here + score > ahead[j]:
                        ahead[j] = here + score
                    if j == i + 1:
                        single = True
            if not single:
                ids = tuple([self.byte[b] for b in s[i].encode()])
                score = self.byte_score * len(ids)
                ending[i + 1].append((i, score, ids))
                ahead[i + 1] = max(ahead[i + 1], here + score)
        return ending, ahead

    def leading(self, s: str) -> tuple[float, float, list[int]]:
        """The best segmentation's score and ids, and what the second best one loses (infinite, if there is none): a forward
        pass alone that keeps the two best scores to every place."""
        table, n, none = self.table, len(s), -np.inf
        one, two, back = [0.0] + [none] * n, [none] * (n + 1), [(0, ())] * (n + 1)
        for i in range(n):
            here, here_two, single = one[i], two[i], False
            for j in range(i + 1, n + 1):
                edge = table.get(s[i:j], 0)
                if edge == 0:
                    break
                if edge is not None:
                    total = here + edge[0]
                    if total > one[j]:
                        other = here_two + edge[0]
                        two[j] = one[j] if one[j] > other else other
                        one[j], back[j] = total, (i, edge[1])
                    elif total > two[j]:
                        two[j] = total
                    if j == i + 1:
                        single = True
            if not single:
                raw = s[i].encode()
                loss, j = self.byte_score * len(raw), i + 1
                total, other = here + loss, here_two + loss
                if total > one[j]:
                    two[j] = max(one[j], other)
                    one[j], back[j] = total, (i, tuple([self.byte[b] for b in raw]))
                else:
                    two[j] = max(two[j], total)
        ids, j = [], n
        while j:
            i, piece = back[j]
            ids[:0] = piece
            j = i
        return one[n], one[n] - two[n], ids

    def best(self, s: str, n: int = BEST) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of s: (score, ids), best first."""
        ending, ahead = self.edges(s)
        found: list[tuple[float, tuple[int, ...]]] = []
        order, seen = 0, [0] * (len(s) + 1)
        queue: list[tuple] = [(-ahead[-1], 0, len(s), 0.0, None)]      # (-whole score, order, place, score behind it, pieces)
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            _, _, j, behind, pieces = pop(queue)
            if seen[j] == n:                                           # n better ways lead on from here
                continue
            seen[j] += 1
            if j == 0:
                ids: list[int] = []
                while pieces:
                    ids += pieces[0]
                    pieces = pieces[1]
                found.append((behind, tuple(ids)))
                if len(found) == n:
                    break
                continue
            for i, score, ids in ending[j]:
                order += 1
                total = behind + score
                push(queue, (-(ahead[i] + total), order, i, total, (ids, pieces)))
        return found


def combined(least: np.ndarray, options, n: int = BEST) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The n best segmentations of a text as (loss, the stretches that deviate from the best one with the number of the
    choice they take). `least` is each stretch's loss by its second segmentation (infinite, if it has one only),
    `options(row)` a stretch's choices, its n best, as tuples that begin with the loss. Only the n - 1 stretches that lose
    least can deviate (of equal ones the first)."""
    if len(least) >= n > 1:
        bar = np.partition(least, n - 2)[n - 2]
        few = np.flatnonzero(least <= bar)
    else:
        few = np.arange(len(least))
    rows = few[np.argsort(least[few], kind="stable")][:n - 1]
    out: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
    for row in rows[np.isfinite(least[rows])].tolist():
        out = sorted(((total + choice[0], picked + ((row, k),) if k else picked)
                      for total, picked in out for k, choice in enumerate(options(row))), key=lambda w: w[0])[:n]
    return out


class Segmenter:
    """Segments pieces of a column; every distinct stretch is searched once while it is remembered."""

    def __init__(self, path: str, n: int = BEST):
        self.vocabulary, self.n = Vocabulary(path), n
        self.hash = text.SpanHasher(31)
        self.spell = np.frombuffer(b"".join(self.vocabulary.bytes_of), np.uint8)
        self.spelled = np.array([len(b) for b in self.vocabulary.bytes_of], np.int64)
        self.spell_at = np.cumsum(self.spelled) - self.spelled
        self._forget()

    def _forget(self):
        self.known: dict[bytes, int] = {}
        self.scores, self.second = np.zeros(0), np.zeros(0)
        self.at, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.full: dict[int, list[tuple[float, np.ndarray]]] = {}

    def _remember(self, stretches: list[bytes]):
        found = [self.vocabulary.leading(s.decode("utf-8", "replace")) for s in stretches]
        self.known.update(zip(stretches, range(len(self.scores), len(self.scores) + len(stretches))))
        self.scores = np.concatenate([self.scores, [f[0] for f in found]])
        self.second = np.concatenate([self.second, [f[1] for f in found]])
        first = [f[2] for f in found]
        size = np.array([len(i) for i in first], np.int64)
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
        self.sizes = np.concatenate([self.sizes, size])
        self.ids = np.concatenate([self.ids, np.fromiter((x for i in first for x in i), np.int32, int(size.sum()))])

    def options(self, row: int) -> list[tuple[float, np.ndarray]]:
        """(loss, ids) of the n best segmentations of a remembered stretch; few stretches are ever asked for it."""
        if row not in self.full:
            ids = self.ids[self.at[row]:self.at[row] + self.sizes[row]]
            best = tuple(ids.tolist())
            found = self.vocabulary.best(b"".join(self.vocabulary.bytes_of[i] for i in best).decode("utf-8", "replace"), self.n)
            others = [(found[0][0] - score, np.array(i, np.int32)) for score, i in found if i != best]
            self.full[row] = [(0.0, ids), *others[:self.n - 1]]
        return self.full[row]

    def way(self, ids: np.ndarray, cuts: np.ndarray, rows: np.ndarray, picked: tuple[tuple[int, int], ...]) -> np.ndarray:
        """The ids of a text whose picked stretches take another choice; `ids` are those of all best segmentations, `cuts`
        the bounds of the text's stretches in them, `rows` its stretches in memory."""
        parts, done = [], cuts[0]
        for r, k in sorted(picked):
            parts += [ids[done:cuts[r]], self.options(int(rows[r]))[k][1]]
            done = cuts[r + 1]
        return np.concatenate([*parts, ids[done:cuts[-1]]])

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """For a piece of a column: ids of the best segmentations, their bounds by stretch, the rows of stretches in memory,
        their bounds by row, and the texts with the space in front and their bounds."""
        some = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][some], 32)                 # the space in front
        offsets = offsets + np.concatenate([[0], np.cumsum(some)])
        begins = np.zeros(len(data), bool)
        if len(data):
            begins[1:] = ~self.vocabulary.beside[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
            begins[offsets[:-1][some]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))[:len(starts)]
        bounds = np.searchsorted(starts, offsets)
        first, which = text.grouped(data, starts, ends, self.hash)
        raw = data.tobytes()
        stretches = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
        if len(self.known) + len(stretches) > KNOWN:
            self._forget()
        self._remember([s for s in stretches if s not in self.known])
        rows = np.fromiter(map(self.known.__getitem__, stretches), np.int64, len(stretches))[which]
        size = self.sizes[rows]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[rows] - total[:-1], size) + np.arange(total[-1])]
        return ids, total, rows, bounds, data, offsets

    def spells(self, ids: np.ndarray, edge: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which rows' ids decode to their texts."""
        back, back_at = self.decode(ids, edge)
        same = np.diff(back_at) == np.diff(offsets)
        if len(back) == len(data):
            wrong = np.concatenate([[0], np.cumsum(back != data)])
            return same & (wrong[offsets[1:]] == wrong[offsets[:-1]])
        return np.array([(back[a:b].tobytes() == data[c:d].tobytes()) for a, b, c, d in zip(back_at[:-1], back_at[1:], offsets[:-1], offsets[1:])], bool)

    def decode(self, ids: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes the ids spell, the space in front included, and the bounds of each row in them."""
        size = self.spelled[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.spell[np.repeat(self.spell_at[ids] - total[:-1], size) + np.arange(total[-1])], total[edge]


_ENCODED = ("doc_id long, ids array<int>, best_score double, scores array<double>, sizes array<int>, decodes boolean, "
            "ways array<array<int>>, ways_decode array<boolean>")


def encoded(docs: DataFrame, path: str, n: int = BEST, keep_ids: bool = True) -> DataFrame:
    """Per text: doc_id, the ids of the best segmentation, of the n best ones the scores and numbers of pieces, whether
    decoding the best gives the text back; then the ids of each of the n best (`ways`, the best first) and whether decoding
    it gives the text back. Without keep_ids all ids give way to their CRC-32 (little-endian, 32 bits each)."""
    schema = _ENCODED if keep_ids else _ENCODED.replace("ids array<int>", "ids_crc32 long").replace("ways array<array<int>>", "ways_crc32 array<long>")
    names = [c.split()[0] for c in schema.split(", ")]

    def encode(batches):
        segment = Segmenter(path, n)
        for batch in batches:
            for a, b, data, offsets in text.pieces(batch.column(1)):
                with np.errstate(over="ignore"):
                    ids, total, rows, bounds, data, offsets = segment(data, offsets)
                edge = total[bounds]
                best, scores, ways = [], [], []
                for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    mine, cuts = rows[i:j], total[i:j + 1]
                    found = combined(segment.second[mine], lambda r: segment.options(int(mine[r])), n)  # noqa: B023
                    best.append(float(segment.scores[mine].sum()))
                    scores.append([best[-1] - loss for loss, _ in found])
                    ways.append([segment.way(ids, cuts, mine, picked) for _, picked in found])
                same = np.zeros((n, b - a), bool)
                for k in range(max(map(len, ways))):                    # the ways of one rank at a time
                    ranked = [w[k] if k < len(w) else ids[:0] for w in ways]
                    same[k] = segment.spells(np.concatenate(ranked), np.cumsum([0] + [len(w) for w in ranked]), data, offsets)
                if keep_ids:
                    every = [w for of_text in ways for w in of_text]
                    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(w) for w in every]), pa.int32()),
                                                     pa.array(np.concatenate(every), pa.int32()))
                    first = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32()))
                    all_ways = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(w) for w in ways]), pa.int32()), inner)
                else:
                    sums = [[zlib.crc32(w.astype("<u4").tobytes()) for w in of_text] for of_text in ways]
                    first, all_ways = pa.array([x[0] for x in sums], pa.int64()), pa.array(sums, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), first, pa.array(best, pa.float64()), pa.array(scores, pa.list_(pa.float64())),
                     pa.array([[len(w) for w in of_text] for of_text in ways], pa.list_(pa.int32())), pa.array(same[0]), all_ways,
                     pa.array([same[:len(w), i].tolist() for i, w in enumerate(ways)], pa.list_(pa.bool_()))], names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, schema)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, text."""
    def decode(batches):
        segment = Segmenter(path)
        for batch in batches:
            out = []
            for ids in batch.column(1).to_pylist():
                ids = np.array(ids or [], np.int64)
                out.append(segment.decode(ids, np.array([0, len(ids)]))[0].tobytes()[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "raw"])
    return rows.select("doc_id", "ids").mapInArrow(decode, "doc_id long, raw binary").select("doc_id", F.decode("raw", "UTF-8").alias("text"))
