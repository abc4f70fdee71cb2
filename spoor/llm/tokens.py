"""Token ids of whole texts, and token files coded by an adaptive context-mixing range coder.

Encoding: the tokenizers library sees every distinct word of a stretch of text once. Words are cut at white space and
between an ASCII letter and a mark (but <, | and >), where the vocabulary's own pre-tokenization always cuts, so the ids are those
of the whole text.

A token file is a Parquet table of segments, each a run of whole documents in ascending order of doc_id:

    b"SPTK" | version u8 = 2 | bits u8 | block ids u32 | documents u32 | of them without doc_id u32 | ids u64 | distinct ids u32
    doc_id i64 each (0 for the first ones, without doc_id) | ids of the document u64 each | distinct ids u32 each, ascending | their shares u32 each
    for each block: bytes of code u32, CRC-32 of its ids as u32 | the codes of the blocks

(little endian). A block holds `block ids` ids (the last one fewer) and starts from scratch. The distribution of the next
id mixes three predictions: the id that last followed the last two ids, the one that last followed the last id, and the
shares of the segment's ids (order 2, 1, 0). Their weights are counts of which was right, kept by how often the two
contexts have been right lately. A range coder with 64 bits codes the id under this mix. All blocks of a segment advance
together, one id at a time, as numpy vectors. A block whose checksum does not match raises an error.

Defined results: a null or empty text has the end id alone; rows that share a doc_id follow each other in the order of
their texts; rows without doc_id come first; an empty table gives no segment; other columns are not looked at.
"""

from __future__ import annotations

import codecs
import functools
import itertools
import json
import os
import struct
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoor.llm import shared, text

BLOCK = 1024              # ids of a block
LANES = 12_288             # blocks of a segment that has no very long document
KNOWN = 600_000           # words an encoder remembers
ROWS, RANGES = 4500, 2000
_U = np.uint64


# ---- encoding ------------------------------------------------------------------------------------------------------

# The characters that stand for bytes in a vocabulary of bytes; the space between words stays.
_SAME = [*range(32, 127), *range(161, 173), *range(174, 256)]
_SPELLING = "".join(chr(b) if b in _SAME else chr(256 + sum(c not in _SAME for c in range(b)) + (b > 32)) for b in range(256))


def _spelled(line: str) -> str:
    return codecs.charmap_decode(line.lower().encode(), "strict", _SPELLING)[0]


class WordEncoder:
    """Ids of texts. Where the vocabulary lower-cases, drops white space and cuts words before marks, every distinct word is
    encoded once while it is remembered, by its bytes; for any other vocabulary the library is given whole texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.hasher = text.SpanHasher(21)
        self.letter, self.mark = np.zeros(256, bool), np.zeros(256, bool)
        self.letter[65:91] = self.letter[97:123] = True
        self.mark[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "<|>"]] = True    # those spell special tokens
        # A vocabulary that marks the ends of words tells where a word's ids end among those of many words.
        kind = json.loads(self.tokenizer.to_str())
        suffix = kind["model"].get("end_of_word_suffix")
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(self.tokenizer.get_vocab_size())],
                               bool) if suffix else None
        self.by_words = self._cuts_words(kind)
        self.quick = self._quick() if self.by_words else None
        self._forget()

    def _cuts_words(self, kind: dict) -> bool:
        """Whether words can be encoded one by one: the vocabulary lower-cases, and its pre-tokenization of a line of probes
        drops all white space and cuts wherever words are cut here."""
        steps = json.dumps(kind.get("normalizer")) + json.dumps(kind.get("pre_tokenizer"))
        if self.closes is None or "Lowercase" not in steps or "Split" not in steps:
            return False
        whole = ["Ab a.b! (c) d,e;f:g? It's 12 x3\tÉté\r\nan-d\x0b\x0c  end", "B.C (DE) a's ..x !y", " \t\n", "ß(ü) Ä:ö 1.5 a1.b",
                 "a$b&c%d*e#f~g^h@i\"j'k-l_m+n=o/p\\q[r]s{t}u`v$$$w&&&'s x''re"]
        for line in whole:
            data = np.frombuffer(line.encode(), np.uint8)
            starts, ends = self._words(data, np.array([0, len(data)]))[:2]
            alone = [i for s, e in zip(starts, ends) for i in self.tokenizer.encode(data[s:e].tobytes().decode(), add_special_tokens=False).ids]
            lower = self.tokenizer.encode("".join(c.lower() if c.isascii() else c for c in line), add_special_tokens=False).ids
            if not self.tokenizer.encode(line, add_special_tokens=False).ids == alone == lower:
                return False
        return True

    def _quick(self):
        """The library's model for lower-cased words of Latin letters whose bytes are already written as the vocabulary's
        characters: no normalization, no patterns, and no memory of words, as none comes twice. None where any letter's ids differ."""
        from tokenizers import Tokenizer, pre_tokenizers
        quick = Tokenizer(self.tokenizer.model)
        quick.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = [c for c in map(chr, range(256)) if c.isalpha()]
        probes = [*letters, *map("".join, zip(letters, letters[1:], letters[7:], letters[40:])), "".join(letters)]
        for probe in probes:
            if quick.encode(_spelled(probe), add_special_tokens=False).ids != self.tokenizer.encode(probe, add_special_tokens=False).ids:
                return None
        quick.model._resize_cache(0)
        return quick

    def _words(self, data: np.ndarray, offsets: np.ndarray):
        cut = np.zeros(len(data), bool)
        if len(data):
            cut[1:] = self.mark[data[1:]] & self.letter[data[:-1]]
        return text.words(data, offsets, cut)

    def _forget(self):
        self.known: dict[bytes, int] = {}
        self.at, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words and the number of each word's ids. Words of letters alone, which are one token of the
        pre-tokenization each, go many at a time."""
        plain = [w.isalpha() and (w.isascii() or unicodedata.normalize("NFC", w.lower()).isalpha()) for w in words]
        letters = [w for w, p in zip(words, plain) if p]
        lines = [" ".join(letters[i:i + 100]) for i in range(0, len(letters), 100)]
        latin = [self.quick is not None and (x.isascii() or max(x) < "\u0100") for x in lines]
        fast = iter(self.quick.encode_batch_fast([_spelled(x) for x, q in zip(lines, latin) if q], add_special_tokens=False) if any(latin) else ())
        slow = iter(self.tokenizer.encode_batch_fast([x for x, q in zip(lines, latin) if not q], add_special_tokens=False))
        many = [next(fast if q else slow) for q in latin]
        each = self.tokenizer.encode_batch_fast([w for w, p in zip(words, plain) if not p], add_special_tokens=False)
        together = np.concatenate([np.zeros(0, np.uint32), *[np.array(x.ids, np.uint32) for x in many]])
        ends = np.flatnonzero(self.closes[together]) + 1 if letters else np.zeros(0, np.int64)
        plain = np.array(plain, bool)
        size = np.zeros(len(words), np.int64)
        size[plain] = np.diff(ends, prepend=0)
        size[~plain] = [len(x.ids) for x in each]
        out, mine = np.empty(int(size.sum()), np.uint32), np.repeat(plain, size)
        out[mine] = together
        out[~mine] = np.fromiter((i for x in each for i in x.ids), np.uint32, int(size[~plain].sum()))
        return out, size

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        found = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows and the number of ids before each row (plus one)."""
        if not self.by_words:
            return self._whole(data, offsets)
        starts, ends, bounds = self._words(data, offsets)
        low = text.LOWER[data]                             # the vocabulary lower-cases, but for its special tokens
        for i in np.unique(np.searchsorted(starts, np.flatnonzero(data == 60), "right") - 1).tolist():
            low[starts[i]:ends[i]] = data[starts[i]:ends[i]]
        first, which = text.grouped(low, starts, ends, self.hasher)
        raw = low.tobytes()
        words = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
        if len(self.known) + len(words) > KNOWN:
            self._forget()
        place = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            new = [words[i] for i in fresh.tolist()]
            place[fresh] = np.arange(len(self.at), len(self.at) + len(new))
            ids, size = self._library([w.decode("utf-8", "replace") for w in new])
            self.known.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
            self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        at, size = self.at[place][which], self.size[place][which]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return ids, total[bounds]


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """The encoder of a Python worker, kept for the next task."""
    return WordEncoder(path)


# ---- range coder ---------------------------------------------------------------------------------------------------

_TOP, _BOTTOM, _WORD = _U(1 << 48), _U(1 << 32), _U(16)
_SLOTS1, _SLOTS2 = 1 << 10, 1 << 11
_STEP, _LIMIT = 24, 3000


_EMPTY = np.uint32(0xFFFFFFFC)     # a slot without a rank: a rank that no id has, not to be trusted


class _Model:
    """The predictions of all blocks of a segment; block b sees its own ids only. Ids are ranks among the segment's
    distinct ids; a slot holds a rank and, in its lowest two bits, how far it is to be trusted (0: empty). Where a context
    is empty the weight of its prediction is 0."""

    def __init__(self, blocks: int):
        base = np.arange(blocks)
        self.base = [base * n for n in (_SLOTS2, _SLOTS1, 16)]
        self.tables = [np.full(blocks * n, _EMPTY, np.uint32) for n in (_SLOTS2, _SLOTS1)]
        trust2, trust1 = np.divmod(np.arange(16), 4)
        start = (np.where(trust2 > 0, 60, 0), np.where(trust1 > 0, 30, 0), np.full(16, 30))
        self.weights = np.concatenate([np.tile(w.astype(_U), blocks) for w in start])
        self.weight = self.weights.reshape(3, -1)                            # of orders 2, 1 and 0
        self.last = np.zeros((2, blocks), np.int64)

    def predict(self, n: int):
        """For the first n blocks: the ranks that orders 2 and 1 predict and the weights of orders 2, 1 and 0."""
        one, two = self.last[0, :n], self.last[1, :n]
        self.at = ((one * 2654435761 + two * (40503 * 77) >> 7 & _SLOTS2 - 1) + self.base[0][:n],
                   (one * 40503 >> 3 & _SLOTS1 - 1) + self.base[1][:n])
        self.seen = [table.take(at) for table, at in zip(self.tables, self.at)]
        self.trust = [seen & 3 for seen in self.seen]
        self.rank = [seen >> 2 for seen in self.seen]
        p2, p1 = self.rank
        self.mix = self.base[2][:n] + (self.trust[0] << 2 | self.trust[1])
        w2, w1, w0 = (w.take(self.mix) for w in self.weight)
        w1 *= p1 != p2
        return p2, p1, w2, w1, w0

    def learn(self, now: np.ndarray, order: np.ndarray):
        """order: which prediction the rank was coded by, as 0 (order 2), 1 or 2 (order 0)."""
        n = len(now)
        w = self.mix + order * self.weight.shape[1]
        grown = self.weights.take(w) + _U(_STEP)
        self.weights[w] = grown
        if len(full := self.mix[grown > _LIMIT]):
            for weight in self.weight:
                weight[full] = ((weight[full] >> _U(1)) + _U(1)) * (weight[full] > 0)
        fresh = now << 2 | 1
        for table, at, seen, trust, rank in zip(self.tables, self.at, self.seen, self.trust, self.rank):
            table[at] = np.where(rank == now, seen + (trust < 3), np.where(trust > 1, seen - 1, fresh))
        self.last[1, :n] = self.last[0, :n]
        self.last[0, :n] = now


class _Coder:
    """The interval of every block; both directions narrow and renew it alike."""

    def __init__(self, blocks: int):
        self.low, self.span = np.zeros(blocks, _U), np.full(blocks, (1 << 64) - 1, _U)

    def narrow(self, n: int, unit: np.ndarray, start: np.ndarray, size: np.ndarray, move) -> None:
        """Takes [start, start + size) units of the first n blocks; `move` shifts 16 settled bits of some blocks out."""
        low, span = self.low[:n], self.span[:n]
        low += unit * start
        np.multiply(unit, size, out=span)
        which, here, width = None, low, span
        while True:
            settled = (here ^ (here + width)) < _TOP
            short = ~settled & (width < _BOTTOM)
            if short.any():
                cut = np.flatnonzero(short) if which is None else which[short]
                self.span[cut] = (~self.low[cut] + _U(1)) & (_BOTTOM - _U(1))
            go = settled | short
            which = np.flatnonzero(go) if which is None else which[go]
            if not len(which):
                return
            move(which)
            here, width = self.low[which] << _WORD, self.span[which] << _WORD
            self.low[which], self.span[which] = here, width


def _shares(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct ids, their shares of 2^bits, and bits."""
    distinct, count = np.unique(ids, return_counts=True)
    bits = max(12, int(len(distinct)).bit_length() + 2)
    room = (1 << bits) - len(distinct)
    share = 1 + (count * (room / count.sum())).astype(np.int64)
    share[np.argmax(share)] += (1 << bits) - share.sum()
    return distinct.astype(np.uint32), share.astype(np.uint32), bits


def _encode_blocks(ids: np.ndarray, distinct: np.ndarray, share: np.ndarray, bits: int) -> list[bytes]:
    n_blocks = -(-len(ids) // BLOCK)
    grid = np.zeros(n_blocks * BLOCK, np.uint32)
    grid[:len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(n_blocks, BLOCK).T)
    before = np.concatenate([[0], np.cumsum(share, dtype=np.int64)]).astype(_U)
    wide = share.astype(_U)
    if int(distinct[-1]) < 1 << 22:                        # a vocabulary's ids: looked up instead of searched
        ranks = np.zeros(int(distinct[-1]) + 1, np.uint32)
        ranks[distinct] = np.arange(len(distinct), dtype=np.uint32)
        ranks[:distinct[0]] = 0
        grid = ranks[np.minimum(grid, distinct[-1])]
    else:
        grid = np.searchsorted(distinct, grid).astype(np.uint32)
    model, coder, b = _Model(n_blocks), _Coder(n_blocks), _U(bits)
    out, used = np.zeros((n_blocks, BLOCK // 2 + 64), np.uint16), np.zeros(n_blocks, np.int64)

    def put(which):
        nonlocal out
        if used.max() >= out.shape[1]:
            out = np.concatenate([out, np.zeros_like(out)], axis=1)
        out[which, used[which]] = (coder.low[which] >> _U(48)).astype(np.uint16)
        used[which] += 1

    last = len(ids) - (n_blocks - 1) * BLOCK
    for t in range(min(BLOCK, len(ids))):
        n = n_blocks if t < last else n_blocks - 1
        p2, p1, w2, w1, w0 = model.predict(n)
        now = grid[t, :n]
        is2 = now == p2
        is1 = (now == p1) & ~is2
        both = w2 + w1
        start = np.where(is2, _U(0), np.where(is1, w2 << b, (both << b) + before[now] * w0))
        size = np.where(is2, w2 << b, np.where(is1, w1 << b, wide[now] * w0))
        coder.narrow(n, coder.span[:n] // ((both + w0) << b), start, size, put)
        model.learn(now, np.where(is2, 0, 2 - is1))
    for _ in range(4):
        put(np.arange(n_blocks))
        coder.low <<= _WORD
    return [out[i, :used[i]].astype("<u2").tobytes() for i in range(n_blocks)]


def _decode_blocks(codes: list[bytes], total: int, block: int, distinct: np.ndarray, share: np.ndarray, bits: int) -> np.ndarray:
    n_blocks = len(codes)
    sizes = np.array([len(c) // 2 for c in codes], np.int64)
    read = np.cumsum(sizes) - sizes
    end = read + sizes
    words = np.concatenate([np.frombuffer(b"".join(codes), "<u2").astype(_U), np.zeros(4, _U)])
    before = np.concatenate([[0], np.cumsum(share, dtype=np.int64)]).astype(_U)
    owner = np.repeat(np.arange(len(distinct), dtype=np.uint32), share)        # of each of the 2^bits slots
    wide = share.astype(_U)
    model, coder, b = _Model(n_blocks), _Coder(n_blocks), _U(bits)
    code = np.zeros(n_blocks, _U)

    def pull(which):
        at = read[which]
        code[which] = code[which] << _WORD | np.where(at < end[which], words[np.minimum(at, len(words) - 1)], _U(0))
        read[which] = at + 1

    for _ in range(4):
        pull(np.arange(n_blocks))
    grid = np.zeros((block, n_blocks), np.uint32)
    last = total - (n_blocks - 1) * block
    for t in range(min(block, total)):
        n = n_blocks if t < last else n_blocks - 1
        p2, p1, w2, w1, w0 = model.predict(n)
        both = w2 + w1
        every, two, one = (both + w0) << b, w2 << b, both << b
        unit = coder.span[:n] // every
        at = np.minimum((code[:n] - coder.low[:n]) // unit, every - _U(1))
        is2 = at < two
        is1 = ~is2 & (at < one)
        k = owner[np.where(at < one, _U(0), at - one) // w0]
        now = np.where(is2, p2, np.where(is1, p1, k))
        start = np.where(is2, _U(0), np.where(is1, two, one + before[k] * w0))
        size = np.where(is2, two, np.where(is1, w1 << b, wide[k] * w0))
        coder.narrow(n, unit, start, size, pull)
        model.learn(now, np.where(is2, 0, 2 - is1))
        grid[t, :n] = now
    return distinct[grid.T.reshape(-1)[:total]]


_HEAD = "<4sBBIIIQI"


def pack_segment(docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray, nameless: int = 0) -> bytes:
    """The bytes of a segment: doc_ids, ids of each document, all ids; the first `nameless` documents have no doc_id."""
    with np.errstate(over="ignore"):
        distinct, share, bits = _shares(ids) if len(ids) else (np.zeros(0, np.uint32), np.zeros(0, np.uint32), 12)
        codes = _encode_blocks(ids, distinct, share, bits) if len(ids) else []
    index = b"".join(struct.pack("<II", len(c), zlib.crc32(ids[i * BLOCK:(i + 1) * BLOCK].astype("<u4").tobytes())) for i, c in enumerate(codes))
    return b"".join([struct.pack(_HEAD, b"SPTK", 2, bits, BLOCK, len(docs), nameless, len(ids), len(distinct)), docs.astype("<i8").tobytes(),
                     sizes.astype("<u8").tobytes(), distinct.astype("<u4").tobytes(), share.astype("<u4").tobytes(), index, *codes])


def unpack_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(doc_ids, ids of each document, all ids, documents without doc_id), each block's checksum checked."""
    magic, version, bits, block, n_docs, nameless, n_ids, n_distinct = struct.unpack_from(_HEAD, raw)
    if magic != b"SPTK" or version != 2:
        raise ValueError("not a segment of a token file")
    at, parts = struct.calcsize(_HEAD), []
    for kind, n in (("<i8", n_docs), ("<u8", n_docs), ("<u4", n_distinct), ("<u4", n_distinct), ("<u4", 2 * -(-n_ids // block))):
        parts.append(np.frombuffer(raw, kind, n, at))
        at += parts[-1].nbytes
    docs, sizes, distinct, share, index = parts
    edge = at + np.concatenate([[0], np.cumsum(index[::2], dtype=np.int64)])
    codes = [raw[a:b] for a, b in zip(edge[:-1], edge[1:])]
    with np.errstate(over="ignore"):
        ids = _decode_blocks(codes, n_ids, block, distinct, share, bits) if n_ids else np.zeros(0, np.uint32)
    for i, crc in enumerate(index[1::2].tolist()):
        if zlib.crc32(ids[i * block:(i + 1) * block].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} of a token segment is damaged")
    return docs, sizes.astype(np.int64), ids, nameless


# ---- files ---------------------------------------------------------------------------------------------------------

def _range(bounds: list[int]):
    @F.pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        out = np.searchsorted(np.array(bounds, np.int64), ids.fillna(0).to_numpy(np.int64)).astype(np.int32) + 1
        return pd.Series(np.where(ids.isna(), 0, out).astype(np.int32))
    return number


def _segments(path: str, end_id: int, lanes: int):
    def write(batches):
        encoder, part, number = encoder_of(path), None, 0
        docs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        nameless: list[int] = []

        def flush():
            nonlocal number
            d, s, x = (np.concatenate(v) for v in (docs, sizes, ids))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(x)], pa.int64()),
                                              pa.array([pack_segment(d, s, x, sum(nameless))], pa.binary())], ["part", "segment", "n_ids", "payload"])
            number += 1
            for v in (docs, sizes, ids, nameless):
                v.clear()
            return row

        for batch in batches:
            parts = batch.column(0).to_numpy()
            names, missing = batch.column(1).fill_null(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for a, b, data, offsets in text.pieces(batch.column(2), 4 << 20):
                with np.errstate(over="ignore"):
                    found, at = encoder(data, offsets)
                closed = np.insert(found, at[1:], end_id)
                at = at + np.arange(len(at))
                new = np.flatnonzero(np.diff(parts[a:b]) != 0) + 1
                for i, j in zip([0, *new], [*new, b - a]):             # rows of one part
                    if part != parts[a + i]:
                        if docs:
                            yield flush()
                        part, number = int(parts[a + i]), 0
                    docs.append(names[a + i:a + j])
                    nameless.append(int(missing[a + i:a + j].sum()))
                    sizes.append(np.diff(at[i:j + 1]))
                    ids.append(closed[at[i]:at[j]])
                    if sum(map(len, ids)) >= lanes * BLOCK:
                        yield flush()
        if docs:
            yield flush()
    return write


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, lanes: int = LANES) -> None:
    """Token files of docs (doc_id, text) below path, in ascending order of doc_id: part by part, segment by segment."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = min(RANGES, max(1, -(-docs.count() // ROWS)))
    bounds = docs.stat.approxQuantile("doc_id", [i / cuts for i in range(1, cuts)], 0.2 / cuts) if cuts > 1 else []
    bounds = sorted({int(b) for b in bounds})
    rows = docs.select(_range(bounds)(F.col("doc_id")).alias("part"), "doc_id", "text")
    rows = rows.repartitionById(len(bounds) + 2, "part").sortWithinPartitions("part", "doc_id", "text")     # a range, a task
    rows.mapInArrow(_segments(vocabulary, end_id, lanes), "part int, segment int, n_ids long, payload binary").write.parquet(path)


def _read(batches):
    for batch in batches:
        for payload, first in zip(batch.column(0), batch.column(1).to_pylist()):
            docs, sizes, ids, nameless = unpack_segment(payload.as_py())
            at = np.concatenate([[0], np.cumsum(sizes)])
            raw = memoryview(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, mask=np.arange(len(docs)) < nameless), pa.array(at[:-1] + first), pa.array(sizes),
                 pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the token files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema("part int, segment int, n_ids long, payload binary").parquet(path)
    sizes = files.groupBy("part", "segment").agg(F.sum("n_ids").alias("n"))
    inside = sizes.select("part", "segment", (F.sum("n").over(Window.partitionBy("part").orderBy("segment")) - F.col("n")).alias("inside"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))                # at most RANGES + 1 rows
    ahead = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    first = inside.join(ahead, "part").select("part", "segment", (F.col("inside") + F.col("ahead")).alias("first"))
    if first.limit(shared.BROADCAST_IDS + 1).count() <= shared.BROADCAST_IDS:
        first = F.broadcast(first)
    return files.join(first, ["part", "segment"]).select("payload", "first").mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long")
