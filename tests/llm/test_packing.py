import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textmill.llm import packing as P
from textmill.llm.encoding import Encoder, vocabulary

TOKENIZER = Tokenizer.from_file(vocabulary())
ENCODER = Encoder(vocabulary())


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, docs, limit):
    """Every id is there once, in place, in sequences without gaps."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    for seq in by.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit
    want = Counter()
    for d in docs:
        ids = ids_of(d["text"])
        for p, s in enumerate(range(0, len(ids), limit)):
            part = ids[s : s + limit]
            want[d["doc_id"], p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    return len(by)


def test_round_trip(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    total = sum(len(ids_of(d["text"])) for d in docs.collect())
    for limit in (4096, 256):
        n = check(P.pack(docs.repartition(5), limit).collect(), docs.collect(), limit)
        assert n <= 1.02 * -(-total // limit) + 1


def test_odd(odd, none):
    check(P.pack(odd, 512).collect(), odd.collect(), 512)
    assert P.pack(none).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=14) | st.lists(st.integers(5, 20), max_size=12), st.integers(30, 40))
def test_reduction_keeps_the_optimum(sizes, limit):
    """What dominance fixes leaves the least number of bins as it was."""

    def least(items):
        best = len(items)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for b in sorted(set(bins)):
                if b >= items[i]:
                    rest = list(bins)
                    rest.remove(b)
                    go(i + 1, [*rest, b - items[i]])
            go(i + 1, [*bins, limit - items[i]])

        go(0, [])
        return best

    fixed, left = P.reduce_instance(Counter(sizes), limit)
    assert all(sum(s) <= limit for s, _ in fixed)
    n_fixed = sum(n for _, n in fixed)
    assert Counter(sizes) == sum((Counter({w: n * s.count(w) for w in s}) for s, n in fixed), Counter()) + Counter(left)
    assert n_fixed + least(sorted(Counter(left).elements(), reverse=True)) == least(sorted(sizes, reverse=True))


def test_sets_of_three():
    """{16, 8, 5} beats all other sets with 16, as often as its pieces last;
    with two pieces of 7, {16, 7, 7} is an alternative that it doesn't beat."""
    assert P.reduce_instance({16: 1, 8: 1, 5: 1}, 30) == ([((16, 8, 5), 1)], {})
    assert P.reduce_instance({16: 3, 8: 3, 5: 2}, 30)[0][0] == ((16, 8, 5), 2)
    assert ((16, 8, 5), 1) not in P.reduce_instance({16: 1, 8: 1, 7: 2, 5: 1}, 30)[0]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), max_size=12))
def test_plan(counts):
    runs, sequences = P.plan(counts, 60)
    fill, used = defaultdict(list), Counter()
    for i, (w, first, seq, offset) in enumerate(runs.tolist()):
        n = (runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == w else counts[w]) - first
        assert first == used[w]
        used[w] += n
        for j in range(n):
            fill[seq + j].append((offset, w))
    assert used == Counter(counts) and set(fill) == set(range(sequences))
    for parts in fill.values():
        at = 0
        for offset, w in sorted(parts):
            assert offset == at
            at += w
        assert at <= 60


TEXT = st.lists(st.sampled_from(list("abcABC.,'s  \n\t!?-1é́İ\x1c\xa0ßΣ日") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'re", ". ", "x" * 300]) | st.characters(exclude_categories=["Cs"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_encoder_equals_the_tokenizer(texts):
    want = [np.array(e.ids, "<u4").tobytes() for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
    assert ENCODER.ids([t.encode() for t in texts]) == want


def test_encoder_rounds(monkeypatch):
    from textmill.llm import encoding

    texts = [f"Wort{i % 50}. und,mehr\n" * (i % 7) for i in range(200)]
    want = ENCODER.ids([t.encode() for t in texts])
    monkeypatch.setattr(encoding, "ROUND", 100)
    monkeypatch.setattr(encoding, "GENERATION", 10)
    assert Encoder(vocabulary()).ids([t.encode() for t in texts]) == want
