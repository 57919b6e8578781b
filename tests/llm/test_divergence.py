import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.helpers import canon, duck
from textmill.llm import divergence as D
from textmill.llm import queries


def brute(docs, least, ranks=50):
    found = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for lang, source, t in docs]
    df, n, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, w in found:
        groups[lang].add(source)
        df.update((lang, x) for x in set(w))
        n.update((lang, source, x) for x in w)
    out = []
    for lang, sources in groups.items():
        kept = [x for (la, x), c in df.items() if la == lang and c >= least]
        v = len(kept)

        def ps(count, v=v, kept=kept):
            total = sum(count(x) for x in kept)
            return {x: 1 + 10**9 * (count(x) + 5) // (total + 5 * v) for x in kept}

        q = ps(lambda x: sum(n[lang, s, x] for s in sources))
        p = {s: ps(lambda x, s=s: n[lang, s, x]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][x] - p[o][x]) for x in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -f, i) for i, (f, o) in enumerate(pairs, 1)]
            over = sorted((q[x] - p[s][x], x.encode()) for x in kept if n[lang, s, x] and p[s][x] > q[x])[:ranks]
            out += [(lang, s, "term", x.decode(), -f, i) for i, (f, x) in enumerate(over, 1)]
    return sorted(out)


def rows(seed, n=150):
    r = random.Random(seed)
    vocab = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)] + ["Äpfel", "äpfel", "ab1cd", "É"]
    out = [(r.choice(["en", "de", None]), r.choice(["a", "b", "B", "ä", None]), " ".join(r.choices(vocab, weights=range(len(vocab)), k=r.randrange(30)))) for _ in range(n)]
    return out + [("en", "empty", None), ("en", "empty2", ""), ("xx", "alone", "rare words"), ("yy", "a", "x"), ("yy", "b", "1 2 _")]


def run(spark, docs, **more):
    df = spark.createDataFrame([(*x, 1, 2) for x in docs], "lang string, source string, text string, n int, item int").repartition(3)
    return sorted(tuple(r) for r in D.audit(df, **more).collect())


@pytest.mark.parametrize(("seed", "least"), [(1, 5), (2, 20), (3, 1)])
def test_against_brute_force(spark, seed, least):
    docs = rows(seed)
    assert run(spark, docs, least=least) == brute(docs, least)


def test_full_sketch(spark):
    """A sketch of 16 cells a row holds back nothing, and changes nothing."""
    docs = rows(4)
    assert run(spark, docs, least=20, bits=4) == brute(docs, 20)


def test_counts_given_out_early(spark, monkeypatch):
    """A task whose terms fill its table many times."""
    monkeypatch.setattr(D, "HELD", 3)
    docs = rows(5)
    assert run(spark, docs, least=10) == brute(docs, 10)


def test_groups_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(D, "GROUPS", 0)
    docs = rows(6)
    assert run(spark, docs, least=10) == brute(docs, 10)


def test_sketch_never_underestimates(spark):
    docs = spark.createDataFrame([(*x,) for x in rows(7)], "lang string, source string, text string").selectExpr("cast(coalesce(lang, '') AS binary) AS lang", "cast('' AS binary) AS source", "cast(text AS binary) AS text")
    true = Counter((lang, x) for lang, _, t in docs.collect() for x in set(D.terms(t)))
    for bits in (3, 6, 20):
        got = {r["cell"]: r["n"] for r in D.sketch(docs, bits).collect()}
        assert all(got[c] >= n for (lang, x), n in true.items() for c in D.cells(bytes(lang), [bytes(x)], bits)[:, 0])
        bound = D.possible(docs, 30, bits).value
        ok = {k for k in true if D.held(bound, D.cells(bytes(k[0]), [bytes(k[1])], bits)).all()}
        assert {k for k, n in true.items() if n >= 30} <= ok
    assert len(ok) < len(true)  # the largest sketch does hold back
    assert np.all(D.cells(b"en", [b"x"], 3)[1] >= 8)


def test_sql(spark, small):
    got = queries.op11_source_divergence(spark, small).toPandas()
    assert canon(got) == canon(duck(small).sql(queries.OP11_SQL).df()) and set(got["part"]) == {"pair", "term"}


def test_odd_rows(odd, none):
    assert D.audit(odd).count() == 0 and D.audit(none).count() == 0  # one source, no term in 30 documents


def test_wide_numbers(spark):
    """p is exact beyond 64 bits."""
    n, total, kept = 3 * 10**12 + 1, 10**13 + 3, 12345
    got = spark.createDataFrame([(n, total, kept)], "n long, t long, k long").select(D._p("n", "t", "k").alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)
