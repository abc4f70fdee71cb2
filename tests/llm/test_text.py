"""Hashes of byte spans: equal for equal spans, different for the rest, also for texts made to collide in polynomials."""

import numpy as np

from spoor.llm import text


def thue_morse(n: int = 1024) -> tuple[str, str]:
    """Two words of n letters that any polynomial modulo 2^64 with an odd base takes for one."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def spans(parts: list[bytes]):
    ends = np.cumsum([len(p) for p in parts])
    return np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends


def test_hashes_depend_on_the_span_alone(monkeypatch):
    monkeypatch.setattr(text, "_BLOCKS", 3)
    rng = np.random.default_rng(1)
    some = [rng.integers(97, 99, n).astype(np.uint8).tobytes() for n in (0, 1, 7, 8, 9, 15, 16, 17, 24, 25, 100, 31)]
    some += [b"a" * n for n in range(40)] + [b"\0" * n for n in range(40)]
    for parts in (some * 2, [b"xyz", *some[::-1], b"!", *some]):
        data, starts, ends = spans(parts)
        one, two = text.SpanHasher(3).both(data, starts, ends)
        assert (text.SpanHasher(3)(data, starts, ends) == one).all()
        by = {}
        for p, *h in zip(parts, one.tolist(), two.tolist()):
            assert by.setdefault(p, h) == h
        assert len({h[0] for h in by.values()}) == len({h[1] for h in by.values()}) == len(by)


def test_crafted_words_differ():
    x, y = thue_morse()
    for seed in (2, 3, 5, 8, 21, 22, 31):
        for lower in (False, True):
            data, starts, ends = spans([x.encode(), y.encode(), x.upper().encode()])
            one, two = text.SpanHasher(seed, lower).both(data, starts, ends)
            assert one[0] != one[1] and two[0] != two[1] and (one[0] == one[2]) == (two[0] == two[2]) == lower


def test_grouped_by_content():
    class Poor(text.SpanHasher):
        def __call__(self, data, starts, ends):
            return (ends - starts).astype(np.uint64) % np.uint64(3)
    parts = [b"a", b"b", b"a", b"long word of many bytes 1", b"long word of many bytes 2", b"", b"long word of many bytes 1", b"12345678x", b"12345678y"]
    for hasher in (Poor(), text.SpanHasher(1)):
        first, which = text.grouped(*spans(parts), hasher)
        assert [parts[first[w]] for w in which] == parts and len(first) == len(set(parts))
