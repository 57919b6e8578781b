import numpy as np
import xxhash

from textmill.llm import near_dedup as N


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=3):
    comp = list(range(len(ids)))
    while True:
        new = [min(comp[j] for j in range(len(ids)) if (fps[i] ^ fps[j]).bit_count() <= radius) for i in range(len(ids))]
        if new == comp:
            break
        comp = new
    least = {}
    for c, i in zip(comp, ids, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return [least.get(c) for c in comp]


def check(df, docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    want = sorted(zip([r["doc_id"] for r in rows], [f"{f:016x}" for f in fps], brute_components([r["doc_id"] for r in rows], fps), strict=True), key=str)
    assert sorted((tuple(r)[:3] for r in df.collect()), key=str) == want


def test_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(N.near_duplicates(docs), docs)


def test_odd(odd, none):
    check(N.near_duplicates(odd), odd)
    assert N.near_duplicates(none).count() == 0


def test_every_near_pair_meets():
    masks = N.covering_masks(list(range(64)))
    rng = np.random.default_rng(1)
    assert len(masks) == 15
    for _ in range(3000):
        x = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))
        assert any(x & m == 0 for m in masks)


def test_large_buckets(spark):
    """Buckets beyond the limit are covered again and give the same links."""
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 4), replace=False)) for _ in range(150)} | {int(rng.integers(0, 1 << 62)) for _ in range(50)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    fps = sorted(fps)
    want = brute_components(fps, fps)
    for bucket in (4096, 8):
        got = {r["node"]: r["root"] for r in N.components(N.links(df, bucket=bucket)).collect()}
        assert [got.get(f, f) for f in fps] == want


def test_deduplicate(make):
    docs = make(["a b c d e f", "a b c d e f", "A b c  d e f", "other words in this text here", None, ""], ids=[5, 2, 9, 1, 7, 7])
    kept = N.deduplicate(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 7] and kept[0].asDict().keys() == set(docs.columns)


def test_deduplicate_repeated_and_null_ids(make):
    """One row of each component stays, also where an id has several texts."""
    one, two, three, four = "a b c d e f", "other words in this text here", "and a third text that differs much", "the fourth of all these little texts"
    docs = make([one, one, two, three, three, three, four, four], ids=[1, 5, 5, None, None, 7, None, None])
    assert sorted(((r["doc_id"], r["text"]) for r in N.deduplicate(docs).collect()), key=str) == sorted([(1, one), (5, two), (7, three), (None, four)], key=str)
    docs = make([one, two, one + " g h i j k", two], ids=[3, 3, 3, 3])
    assert sorted(r["text"] for r in N.deduplicate(docs).collect()) == sorted([one, two, one + " g h i j k"])
