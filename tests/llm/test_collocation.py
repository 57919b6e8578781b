import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.helpers import canon, duck
from textmill.llm import collocation as C
from textmill.llm import queries


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(docs, least, top):
    n, f = Counter(), Counter()
    for lang, text in docs:
        for w in pieces(text):
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    f = {k: v for k, v in f.items() if v >= least}
    inside = {(lang, g[i : i + k], c) for (lang, g), c in f.items() for k in range(2, len(g)) for i in range(len(g) - k + 1)}
    rows = []
    for (lang, g), a in f.items():
        if len(g) < 2 or (lang, g, a) in inside:
            continue
        cut = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cut)
        rows.append((lang, -score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    out = []
    for lang in {r[0] for r in rows}:
        for rank, (_, s, a, g, left, right) in enumerate(sorted(r for r in rows if r[0] == lang)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def texts(seed, n=60):
    r = random.Random(seed)
    fixed = ["New York City", "as far as I", "a a a a a a", "x y", "ÄÖ äö", "one two three four five six"]
    make = lambda: " ".join(r.choice([*fixed, *"abcde", ". ", "!", "\n", "\t", "\x1c", "z,z"]) for _ in range(r.randrange(60)))
    return [(r.choice(["en", "de", None]), make()) for _ in range(n)] + [("en", None), (None, ""), ("fr", " .,. \n"), ("de", "only words")]


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, n int, size int").repartition(3)
    return sorted(tuple(r) for r in C.collocations(df, **more).collect())


@pytest.mark.parametrize(("seed", "least", "shard"), [(1, 3, 1 << 20), (2, 5, 7), (3, 2, 100)])
def test_against_brute_force(spark, seed, least, shard):
    rows = texts(seed)
    want = brute(rows, least, 25)
    assert len(want) > 30 and run(spark, rows, least=least, top=25, shard=shard) == want


def test_saturated_sets(spark):
    """With sets of 64 bits nearly all phrases pass, and the result is the same."""
    rows = texts(4)
    assert run(spark, rows, least=3, bits=6) == brute(rows, 3, C.TOP)


def test_sql(spark, small):
    got = queries.op12_collocations(spark, small).toPandas()
    assert canon(got) == canon(duck(small).sql(queries.OP12_SQL).df()) and len(got) > 0


def test_automaton():
    """All substrings, each once, with how often they end somewhere, and their links."""
    words = C.words_and_breaks(b"A b a b c. a b! b c a b c")
    assert words == b"a b a b c . a b . b c a b c".split()
    batch = pa.RecordBatch.from_arrays([pa.array([b"en"]), pa.array([b"A b a b c. a b! b c a b c"])], names=["lang", "text"])
    ((lang, own, ids),) = C._shards(iter([batch]), 100)
    assert lang == b"en" and own == [b"a", b"b", b"c"]
    a = C.Automaton(own, ids, lang)
    for _ in range(3):
        a.grow()
    assert [a.ends[d].sum() for d in (1, 2, 3, 4)] == [12, 9, 6, 4]
    got = {}
    for d in range(1, 5):
        for s, phrase in enumerate(a.phrases(d, np.arange(len(a.at[d]))).to_pylist()):
            assert tuple(phrase.split()) not in got
            got[tuple(phrase.split())] = int(a.ends[d][s])
    want = Counter(tuple(w[i : i + m]) for w in ("a b a b c".split(), "a b".split(), "b c a b c".split()) for m in range(1, 5) for i in range(len(w) - m + 1))
    assert got == {tuple(x.encode() for x in k): v for k, v in want.items()}
    for d in (2, 3, 4):
        for s in range(len(a.at[d])):
            assert a.phrases(d - 1, a.link[d][[s]])[0].as_py().split() == a.phrases(d, np.array([s]))[0].as_py().split()[1:]


def test_wide_products(spark):
    """Products beyond 64 bits stay exact."""
    rows = [("en", "p q", 2, 3_000_000_000), ("en", "p", 1, 4_000_000_001), ("en", "q", 1, 5_000_000_003)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, size int, n long")
    totals = spark.createDataFrame([("en", 10**12 + 7)], "lang string, total long")
    r = C.scored(counts, totals).first()
    assert r["score"] == 1000 * 3_000_000_000 * (10**12 + 7) // (4_000_000_001 * 5_000_000_003) and r["l"] == 4_000_000_001


def test_odd_rows(odd, none):
    """Of these only the long text repeats anything so often."""
    got = {(r["lang"], r["phrase"], r["a"]) for r in C.collocations(odd).collect()}
    assert got == {("de", " ".join(["wort"] * m), 60_000 - m + 1) for m in range(2, 6)} and C.collocations(none).count() == 0


def test_malformed(spark):
    docs = spark.range(120).selectExpr("'en' AS lang", "cast(unhex('61FF62') || encode(' b', 'utf-8') AS string) AS text")
    assert [(r["a"], bytes(r["p"])) for r in C.collocations(docs).selectExpr("a", "cast(phrase AS binary) AS p").collect()] == [(120, b"a\xffb b")]
