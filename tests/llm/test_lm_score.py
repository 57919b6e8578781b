import math
import zlib
from collections import Counter

import numpy as np
import pytest

from textmill.llm import lm_score as L


def lower(t):
    return (t or "").encode().lower()


class ContextTree:
    """The mixed predictions of a context tree with frozen counts, in one
    process: what the sharded tree is compared with."""

    def __init__(self, depth: int, pairs: list[tuple[np.ndarray, np.ndarray]]):
        """pairs[d]: sorted context << 8 | byte of the kept contexts of d
        bytes, and their counts."""
        self.depth = depth
        self.contexts = [np.unique(k >> 8) for k, _ in pairs]
        nodes = [self._nodes(k, n) for k, n in pairs]
        block = [L._block(n0, n1) for _, n0, n1 in nodes]
        mixed: list[np.ndarray] = [np.empty(0)] * (depth + 1)
        own: list[np.ndarray] = [np.empty(0)] * (depth + 1)  # weight of stopping at a node
        up: list[np.ndarray] = [np.empty(0, np.int64)] * (depth + 1)
        for d in range(depth, -1, -1):
            key, n0, n1 = nodes[d]
            mixed[d], own[d] = block[d], np.ones(len(key))
            if d == depth or not len(nodes[d + 1][0]):
                continue
            child, c0, c1 = nodes[d + 1]
            mask = (1 << (8 * d)) - 1
            up[d + 1], _ = L._find(key, (((child >> 8) & mask) << 8) | (child & 255))
            size = len(key)
            below = np.bincount(up[d + 1], weights=mixed[d + 1], minlength=size)
            r0 = n0 - np.bincount(up[d + 1], weights=c0, minlength=size)
            r1 = n1 - np.bincount(up[d + 1], weights=c1, minlength=size)
            has = np.bincount(up[d + 1], minlength=size) > 0
            split = np.where(has, below + L._block(r0, r1), -np.inf)
            mixed[d] = np.where(has, np.logaddexp(block[d], split) - math.log(2), block[d])
            own[d] = np.where(has, np.exp(block[d] - math.log(2) - mixed[d]), 1.0)
        self.nodes, self.one = [n[0] for n in nodes], []
        acc, rest = np.zeros(len(nodes[0][0])), np.ones(len(nodes[0][0]))
        for d in range(depth + 1):
            _, n0, n1 = nodes[d]
            if d:
                kt = self._kt(*nodes[d - 1][1:])
                acc, rest = (acc + rest * own[d - 1] * kt)[up[d]] if len(up[d]) else np.zeros(len(n0)), (rest * (1 - own[d - 1]))[up[d]] if len(up[d]) else np.ones(len(n0))
            self.one.append((acc + rest * self._kt(n0, n1)).astype(np.float32))
        self.pairs = [k for k, _ in pairs]
        self.logs = [self._path(k, d).astype(np.float32) for d, (k, _) in enumerate(pairs)]

    @staticmethod
    def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        return (n1 + 0.5) / (n0 + n1 + 1)

    @staticmethod
    def _nodes(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """context << 8 | bits so far after a leading one; zeros and ones."""
        byte, context = k & 255, k >> 8 << 8
        at = np.concatenate([context | (1 << i) | (byte >> (8 - i)) for i in range(8)])
        bit = np.concatenate([(byte >> (7 - i)) & 1 for i in range(8)])
        key, code = np.unique(at, return_inverse=True)
        w = np.tile(n, 8).astype(np.float64)
        return key, np.bincount(code, weights=w * (bit == 0), minlength=len(key)), np.bincount(code, weights=w * bit, minlength=len(key))

    def _path(self, k: np.ndarray, d: int) -> np.ndarray:
        """log10 probability of the symbols after their contexts of d bytes;
        each decision by the longest context whose node has data."""
        total = np.zeros(len(k))
        byte = k & 255
        for i in range(8):
            prefix = (1 << i) | (byte >> (8 - i))
            p, open_ = np.full(len(k), 0.5), np.ones(len(k), bool)
            for j in range(d, -1, -1):
                idx = np.flatnonzero(open_)
                if not len(idx):
                    break
                at, there = L._find(self.nodes[j], (((k[idx] >> 8) & ((1 << (8 * j)) - 1)) << 8) | prefix[idx])
                p[idx[there]] = self.one[j][at[there]]
                open_[idx[there]] = False
            total += np.log10(np.where((byte >> (7 - i)) & 1, p, 1 - p))
        return total

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol after its context."""
        out, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for d in range(self.depth, -1, -1):
            k = grams[open_] & ((1 << (8 * (d + 1))) - 1)
            _, kept = L._find(self.contexts[d], k >> 8)
            if d == 0:
                kept[:] = True
            idx, k = open_[kept], k[kept]
            at, there = L._find(self.pairs[d], k)
            out[idx[there]] = self.logs[d][at[there]]
            if not there.all():
                out[idx[~there]] = self._path(k[~there], d)
            open_ = open_[~kept]
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each (lower-cased) text with its end."""
        out = np.zeros(len(texts))
        for k, doc in L.byte_grams(texts, self.depth):
            unique, codes = np.unique(k, return_inverse=True)
            out += np.bincount(doc, weights=self.log10(unique)[codes], minlength=len(texts))
        return out


def whole_tree(texts, depth):
    """The tree of all contexts of the texts."""
    k = np.concatenate([g for g, _ in L.byte_grams(texts, depth)])
    return ContextTree(depth, [np.unique(k & ((1 << (8 * (d + 1))) - 1), return_counts=True) for d in range(depth + 1)])


class Brute:
    """Context-tree weighting by recursion over dicts."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, {}
        for t in texts:
            s = b"\0" * depth + t + b"\0"
            for i in range(depth, len(s)):
                for d in range(depth + 1):
                    for bit in range(8):
                        node = (s[i - d : i], (1 << bit) | (s[i] >> (8 - bit)))
                        self.n.setdefault(node, [0, 0])[(s[i] >> (7 - bit)) & 1] += 1
        self.kids = {}
        for c, p in self.n:
            if c:
                self.kids.setdefault((c[1:], p), []).append((c, p))
        self.memo = {}

    @staticmethod
    def block(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def mixed(self, node):
        if node not in self.memo:
            own = self.block(*self.n[node])
            kids = self.kids.get(node)
            below = sum(self.mixed(k)[0] for k in kids) if kids else None
            total = own if below is None else np.logaddexp(own, below) - math.log(2)
            self.memo[node] = (total, 1.0 if below is None else math.exp(own - math.log(2) - total))
        return self.memo[node]

    def one(self, context, prefix):
        acc, rest, last = 0.0, 1.0, 0.5
        for d in range(self.depth + 1):
            node = (context[len(context) - d :], prefix)
            if node not in self.n:
                break
            a, b = self.n[node]
            kt = (b + 0.5) / (a + b + 1)
            last = acc + rest * kt
            lam = self.mixed(node)[1]
            acc, rest = acc + rest * lam * kt, rest * (1 - lam)
        return last

    def score(self, t):
        s, total = b"\0" * self.depth + t + b"\0", 0.0
        for i in range(self.depth, len(s)):
            for bit in range(8):
                p = self.one(s[i - self.depth : i], (1 << bit) | (s[i] >> (8 - bit)))
                total += math.log10(p if (s[i] >> (7 - bit)) & 1 else 1 - p)
        return total


def brute(docs, depth):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    train = [lower(t) for i, t in docs if not held[i]]
    c = Counter(w for t in train for w in [*t.split(), b"\n"])
    n, v, tree = sum(c.values()), len(c), Brute(train, depth)
    out = {}
    for i, t in docs:
        ws = [*lower(t).split(), b"\n"]
        out[i] = (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), tree.score(lower(t)))
    return out


def check(rows, want):
    for r in rows:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9) and r["score"] == pytest.approx(w[5], rel=1e-5)


@pytest.mark.parametrize("head", [200_000, 5])
def test_against_brute_force(spark, small, monkeypatch, head):
    """With the whole vocabulary in the broadcast map, and nearly none."""
    monkeypatch.setattr(L, "HEAD_WORDS", head)
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60 and n_chars < 3000")
    check(L.lm_scores(docs, depth=2).collect(), brute([(r["doc_id"], r["text"]) for r in docs.collect()], 2))


def test_shipped_depth(spark, small):
    """As the query scores, against brute force."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 40 and n_chars < 1200")
    rows = L.lm_scores(docs).collect()
    assert len(rows) >= 10 and {r["held_out"] for r in rows} == {True, False}
    check(rows, brute([(r["doc_id"], r["text"]) for r in docs.collect()], 5))


def test_probabilities_sum_to_one():
    texts = [b"abracadabra", b"banana bandana", b"abcabcabc"]
    tree = whole_tree(texts, 2)
    for context in (b"ab", b"zz", b"an", b"\0\0"):
        grams = np.array([(context[0] << 16) | (context[1] << 8) | b for b in range(256)], np.int64)
        assert (10 ** tree.log10(grams)).sum() == pytest.approx(1, abs=1e-5)


def test_no_context_is_dropped(spark, small, monkeypatch):
    """Scores are those of the whole tree, whatever fits into the head, and
    for held-out grams that no training text has."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60 and n_chars < 3000")
    want = {r["doc_id"]: r for r in L.lm_scores(docs, depth=4).collect()}
    rows = docs.collect()
    tree = whole_tree([lower(r["text"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2], 4)
    for r, s in zip(rows, tree.score([lower(r["text"]) for r in rows]), strict=True):
        assert want[r["doc_id"]]["score"] == pytest.approx(s, rel=1e-5)
    for name, value in (("HEAD_GRAMS", 5), ("PIECE", 50), ("SHARD", 2)):
        monkeypatch.setattr(L, name, value)
    for r in L.lm_scores(docs, depth=4).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]]["score"], rel=1e-6)


def test_long_texts_in_pieces(monkeypatch):
    texts = [b"abcdefgh" * 50, b"", b"x"]
    want = sorted(np.concatenate([k for k, _ in L.byte_grams(texts, 3)]).tolist())
    monkeypatch.setattr(L, "CHUNK", 37)
    got = list(L.byte_grams(texts, 3))
    assert sorted(np.concatenate([k for k, _ in got]).tolist()) == want
    assert Counter(np.concatenate([d for _, d in got]).tolist()) == {0: 401, 1: 1, 2: 2}


def test_lgamma():
    x = np.array([0.5, 1.0, 1.5, 3.7, 10.5, 1e6 + 0.5])
    assert L._lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-9, abs=1e-9)


def test_odd(odd, none):
    r = L.lm_scores(odd).collect()
    assert len(r) == odd.count() and all(x["score"] < 0 for x in r) and {x["n_tokens"] for x in r if x["doc_id"] in (0, 1, 2)} == {1}
    assert L.lm_scores(none).count() == 0


def test_no_training_rows(make):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = L.lm_scores(make(["ab"], ids=[held])).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 2, 0, 0, 0.0) and r["score"] == pytest.approx(24 * math.log10(0.5))
