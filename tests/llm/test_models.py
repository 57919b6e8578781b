"""Held-out accuracy and odd inputs of the trained operators."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import language, perplexity, toxicity


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_language(tables):
    docs, _ = tables
    r = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (r.held_out == r.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = r[r.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98 and r.score.between(0, 1).all() and held.rejected.mean() < 0.1


def test_language_ignores_the_labels_of_held_out(tables):
    docs, _ = tables
    crc = F.crc32(F.col("doc_id").cast("string")) % 4
    a = language.identify(docs).collect()
    b = language.identify(docs.withColumn("lang", F.when(crc == 2, "zz").otherwise(F.col("lang")))).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def plain_logits(m, embed, linear, raw):
    """Logits by definition: the mean embedding of all grams, gram by gram."""
    a = [c if c >= 128 or chr(c).isalpha() else 32 for c in raw.lower()]
    total, n = np.zeros(embed.shape[1]), 0
    for order in language.ORDERS:
        for at in range(len(a) - order + 1):
            h = 0
            for k, c in enumerate(a[at : at + order], 1):
                h = ((h ^ c) * 0x01000193 + k) & 0xFFFFFFFF
            total += embed[(h ^ (h >> 15)) & (language.BUCKETS - 1)]
            n += 1
    return (total / n) @ linear + m.bias


TEXTS = ["The cat sat on the mat!", "Der Hund und die Katze 12 läuft", "x", "ab", "Ä", "a  b\tc. " * 9]


@pytest.mark.parametrize("chunk", [1, 3, 7, 1 << 30])
@pytest.mark.parametrize("languages", [2, 40])
def test_language_against_brute_force(monkeypatch, chunk, languages):
    """Scores of whole texts, in one piece and in many, with the layers
    collapsed and apart."""
    monkeypatch.setattr(language, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    embed, linear = rng.normal(size=(language.BUCKETS, language.WIDTH)).astype(np.float32), rng.normal(size=(language.WIDTH, languages)).astype(np.float32)
    m = language.Model([str(i) for i in range(languages)], embed, linear, rng.normal(size=languages))
    assert (m.linear is None) == (languages <= language.WIDTH)
    for t in TEXTS:
        assert m.logits(t.encode()) == pytest.approx(plain_logits(m, embed, linear, t.encode()), rel=1e-4, abs=1e-4)
    at, share = language.text_features(TEXTS[-1].encode())
    assert m.top(share @ m.table[at]) == pytest.approx(m.logits(TEXTS[-1].encode()), abs=1e-4) and share.sum() == pytest.approx(1)


def test_language_fit():
    texts = [(b"the cat sat on the mat " * 3, "a"), (b"der hund und die katze " * 3, "b")] * 30
    m = language.fit([(*language.text_features(t), g) for t, g in texts])
    assert m.languages[int(m.logits(b"the mat").argmax())] == "a" and m.languages[int(m.logits(b"und der hund").argmax())] == "b"


def test_every_language_is_learnt(spark):
    """No cap on languages: each of 300 has its rows in the sample, though
    each has a third or a thousandth of all."""
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(300)]
    docs = spark.createDataFrame([(i, f"{w} " * 5, w) for i, w in enumerate([w for w in words for _ in range(8)] + words[:1] * 1000)], "doc_id long, text string, lang string")
    m = language.train(docs.selectExpr("doc_id", "cast(text as binary) as text", "lang"))
    assert m.languages == sorted(words)


def test_repeated_ids_teach_once(spark):
    """An id with many copies doesn't carry them to the driver."""
    rows = spark.createDataFrame([(1, bytearray(b"copy"), "en")] * 500 + [(i, bytearray(b"own %d" % i), "en") for i in range(2, 5)], "doc_id long, text binary, lang string")
    from textmill.llm.common import one_text

    assert one_text(rows, "doc_id", "lang").count() == 4


def test_language_odd(odd, none):
    r = {x["doc_id"]: x for x in language.identify(odd).collect()}
    assert all(r[i]["lang_pred"] == "und" and r[i]["score"] == 0 for i in (0, 1, 2, 8, 10)) and r[7]["lang_pred"] in ("de", "xx", "en")
    assert language.identify(odd).count() == odd.count() and language.identify(none).count() == 0
    assert {x["lang_pred"] for x in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(tables):
    docs, labels = tables
    r = toxicity.toxicity(docs, labels).join(labels, "doc_id").toPandas()
    held = r[r.held_out]
    assert (held.predicted == (held.score >= 0.7)).all()
    assert held[held.toxic == 0].predicted.mean() < 0.03 and held[held.toxic == 1].predicted.mean() > 0.5
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == toxicity.toxicity(docs, labels).where("predicted = 0").count()


def test_counterfactual(spark):
    """A group that stands in toxic sentences alone gains less weight, and no
    more than its counterparts, once swaps are penalised."""
    toxic = [f"{w} women are idiots {i}" for i, w in enumerate(["all", "these", "some"] * 20)]
    clean = [f"people walk home {i}" for i in range(60)] + [f"we met men there {i}" for i in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(toxic)] + [(1000 + i, t, 0) for i, t in enumerate(clean)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    m = toxicity.fitted(docs, labels)
    assert m.score(b"we met women there") < 0.7 <= m.score(b"you are idiots, idiots")
    assert abs(m.score(b"women") - m.score(b"men")) < 0.1
    old, toxicity.PENALTY = toxicity.PENALTY, 0.0
    try:
        free = toxicity.fitted(docs, labels)
    finally:
        toxicity.PENALTY = old
    assert free.score(b"we met women there") > m.score(b"we met women there")


def penalised_loss(texts, labels, weights, bias):
    """The loss by definition, with each sentence written anew for each swap."""
    import re

    def logit(t):
        return bias + sum(weights.get(f, 0.0) for f in {f for w in toxicity.words(t) for f in toxicity.features(w)})

    share = {y: 0.5 / max(1, labels.count(y)) for y in (0, 1)}
    fit = sum(share[y] * np.log1p(np.exp(-logit(t) if y else logit(t))) for t, y in zip(texts, labels, strict=True))
    gaps = []
    for t in texts:
        for sentence in re.split(rb"[.!?\n]+", t):
            for w in sorted(toxicity.words(sentence) & toxicity._SWAPS.keys()):
                gaps += [logit(sentence) - logit(re.sub(rb"(?<![a-z])%s(?![a-z])" % w, x, sentence.lower())) for x in toxicity._SWAPS[w]]
    return fit + toxicity.PENALTY * np.square(gaps).sum() / max(1, len(gaps)) + toxicity.DECAY / 2 / len(texts) * sum(v * v for v in weights.values())


def test_toxicity_against_brute_force(spark, monkeypatch):
    """The weights are the least point of the loss over swapped sentences, and
    a score is the plain sum of a text's features."""
    monkeypatch.setattr(toxicity, "STEPS", 6000)
    texts = [f"you idiot {w}. {g} sing" for w in ("fool", "moron", "liar") for g in ("all women", "a woman and a man", "people")] * 4
    texts += [f"{g} walk home. nice {w}" for w in ("day", "tree", "sun") for g in ("the men", "jews and muslims", "friends")] * 4
    texts, labels = [t.encode() for t in texts], [1] * 36 + [0] * 36
    rows = spark.createDataFrame([(i, bytearray(t), y) for i, (t, y) in enumerate(zip(texts, labels, strict=True))], "doc_id long, text binary, toxic int")
    m = toxicity.train(rows)
    best = penalised_loss(texts, labels, m.weights, m.bias)
    rng = np.random.default_rng(4)
    used = [k for k, v in m.weights.items() if any(k in toxicity.features(w) for t in texts for w in toxicity.words(t))]
    for size in (0.3, 0.05, 0.01):
        for _ in range(25):
            moved = {k: max(0.0, v + size * rng.normal() * (k in used)) for k, v in m.weights.items()}
            assert penalised_loss(texts, labels, moved, m.bias + size * rng.normal()) > best - 1e-6
    for t in [*texts[:9], b"", "ÄÖ idiot".encode()]:
        z = m.bias + sum(m.weights.get(f, 0.0) for f in {f for w in toxicity.words(t) for f in toxicity.features(w)})
        assert m.score(t) == pytest.approx(1 / (1 + np.exp(-z)))


def mentions(tables):
    """Labelled documents of which most toxic ones name a group beside what
    makes them toxic; and held-out clean ones that name groups neutrally."""
    docs, labels = tables
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows}
    learn = [(r["doc_id"], r["text"] + " all women here." if r["toxic"] and r["doc_id"] % 5 else r["text"], r["toxic"]) for r in rows if not held[r["doc_id"]]]
    clean = [r["text"] for r in rows if held[r["doc_id"]] and not r["toxic"]]
    return learn, clean, [r["text"] for r in rows if held[r["doc_id"]] and r["toxic"]]


def test_neutral_mentions(spark, tables, monkeypatch):
    """On the held-out fold: with the penalty, naming a group moves scores as
    much as naming its counterpart, and neutral mentions are no false alarms."""
    learn, clean, toxic = mentions(tables)
    docs = spark.createDataFrame([r[:2] for r in learn], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in learn], "doc_id long, toxic int")
    got = {}
    for penalty in (0.0, toxicity.PENALTY):
        monkeypatch.setattr(toxicity, "PENALTY", penalty)
        m = toxicity.fitted(docs, labels)
        a, b = (np.array([m.score(f"{t} We met {w} there.".encode()) for t in clean]) for w in ("women", "men"))
        plain = np.mean([m.score(t.encode()) >= 0.7 for t in clean])
        caught = np.mean([m.score(t.encode()) >= 0.7 for t in toxic])
        got[penalty] = (np.mean(a >= 0.7) - plain, np.abs(a - b).mean(), caught)
    (alarms0, gap0, caught0), (alarms1, gap1, caught1) = got[0.0], got[toxicity.PENALTY]
    print("false alarms added, gap, toxic caught:", got)
    assert alarms1 <= 0.01 and gap1 < 0.02 and gap0 > 5 * gap1 and alarms0 > alarms1 and caught1 >= caught0 - 0.05


def test_swaps_by_sentence(spark, monkeypatch):
    """Every sentence counts, and what else stands in it; singular forms too."""
    got = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, pairs, keys: got.extend((set(keys[a].tolist()), set(keys[b].tolist()), k) for a, b, k in pairs))
    texts = ["A woman sings. A woman and a man sing.", "That woman", "no term"]
    toxicity.train(spark.createDataFrame([(i, bytearray(t.encode()), i % 2) for i, t in enumerate(texts)], "doc_id long, text binary, toxic int"))
    f = lambda w: set(toxicity.features(w))
    assert (f(b"woman"), f(b"man"), 2) in got and (f(b"woman"), set(), 1) in got and (f(b"man"), f(b"girl"), 1) in got
    assert sum(k for _, _, k in got) == 4 * 3


def test_toxicity_odd(odd, none, no_labels, spark):
    r = toxicity.toxicity(odd, no_labels).collect()
    assert len(r) == odd.count() and all(0 <= x["score"] < 0.7 for x in r)
    labels = spark.createDataFrame([(4, 1, 1), (3, 1, 0), (None, 1, 1), (8, 0, None)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, labels).count() == odd.count() and toxicity.toxicity(none, labels).count() == 0


class KneserNey:
    """The estimate by its definition, over dicts."""

    def __init__(self, texts, vocabulary=None):
        """texts: lists of words; words beyond the vocabulary are one."""
        self.known = {w for t in texts for w in t} if vocabulary is None else vocabulary
        tri = Counter(g for t in texts for g in self.triples(t))
        bi = Counter((b, c) for _, b, c in tri)
        for b, c in bi:
            if b == "<s>":
                bi[b, c] = sum(n for (_, y, z), n in tri.items() if (y, z) == (b, c))
        uni = Counter(c for _, c in bi)
        self.counts = {1: {(c,): n for c, n in uni.items()}, 2: dict(bi), 3: dict(tri)}
        self.size = len(self.known) + 2
        self.d = {k: perplexity.discounts(Counter(v.values())) for k, v in self.counts.items()}
        self.sums = {k: Counter() for k in (1, 2, 3)}
        self.left = {k: Counter() for k in (1, 2, 3)}
        for k, v in self.counts.items():
            for g, n in v.items():
                self.sums[k][g[:-1]] += n
                self.left[k][g[:-1]] += self.d[k][min(n, 3)]

    def triples(self, words):
        w = ["<s>", "<s>", *[x if x in self.known else "<?>" for x in words], "</s>"]
        return list(zip(w, w[1:], w[2:], strict=False))

    def p(self, *gram):
        k = len(gram)
        if k == 0:
            return 1 / self.size
        lower = self.p(*gram[1:])
        if not self.sums[k][gram[:-1]]:
            return lower
        n = self.counts[k].get(gram, 0)
        return (max(0, n - self.d[k][min(n, 3)]) + self.left[k][gram[:-1]] * lower) / self.sums[k][gram[:-1]]

    def loss(self, text):
        return -sum(np.log10(self.p(*g)) for g in self.triples(text.encode().lower().split()))


SHORT = ["a b c a b d", "a b c", "b a b c d d", "c a", "a b", "d", "a b c a b d e f g", "", "x y z a b"]


@pytest.mark.parametrize(("head", "vocabulary", "chunk"), [(0, 1 << 20, 10), (6, 1 << 20, 1 << 20), (1 << 20, 1 << 20, 3), (6, 3 + 5, 7)])
def test_kneser_ney(make, monkeypatch, head, vocabulary, chunk):
    """All grams in the shards, some, none; and words beyond the vocabulary."""
    for name, value in (("HEAD_GRAMS", head), ("VOCABULARY", vocabulary), ("CHUNK", chunk)):
        monkeypatch.setattr(perplexity, name, value)
    as_bytes = lambda texts: make(texts).selectExpr("doc_id", "cast(text as binary) as text")
    m = perplexity.train(as_bytes(SHORT).select("text"))
    split = [t.encode().split() for t in SHORT]
    kn = KneserNey(split, set(m.head.value.ids))
    assert len(m.head.value.ids) == min(10, vocabulary - 3) and (m.others.count() > 0) == (head < 100)
    asked = [*SHORT, "a q b", "q", "b c a b z", "x a a a a", None]
    got = {r["doc_id"]: r for r in perplexity.losses(as_bytes(asked), m).collect()}
    for i, t in enumerate(asked):
        assert got[i]["total"] == pytest.approx(kn.loss(t or ""), rel=1e-9) and got[i]["n_tokens"] == len((t or "").split()) + 1, t
    for h in ((b"a", b"b"), ("<s>", "<s>"), (b"q", b"q")):
        assert sum(kn.p(*h, c) for c in [*kn.known, "</s>", "<?>"]) == pytest.approx(1)


def test_answers_are_packed(make, monkeypatch):
    """A shard answers a block of texts with one row, not with one a text, and
    equal texts have the same total to the last bit."""
    monkeypatch.setattr(perplexity, "HEAD_GRAMS", 0)
    as_bytes = lambda texts: make(texts).selectExpr("doc_id", "cast(text as binary) as text").coalesce(1)
    m = perplexity.train(as_bytes(SHORT).select("text"))
    lost = perplexity.losses(as_bytes(SHORT * 300), m)
    sizes = {}
    for r in lost.collect():
        sizes.setdefault(r["doc_id"] % len(SHORT), Counter())[r["total"]] += 1
    assert len(sizes) == len(SHORT) and all(list(c.values()) == [300] for c in sizes.values())
    plan = lost._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "block" in plan  # no row for each text and shard is summed


def test_bloom(spark):
    """No gram is lost; few others pass, also where bits are scarce."""
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 20_000))
    f = perplexity.bloom(spark.createDataFrame([(int(k),) for k in keys], "g long"), len(keys))
    other = rng.integers(-(1 << 62), 1 << 62, 20_000)
    assert perplexity.may_have(f, keys).all() and perplexity.may_have(f, other).mean() < 0.02
    assert not perplexity.may_have(perplexity.bloom(spark.createDataFrame([], "g long"), 0), other).any()


def test_bloom_by_shards(spark):
    """Each shard sends a part of its own, so the filter reaches the driver
    once, of no more bits than the grams are given."""
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(-(1 << 42), 1 << 62, 20_000))
    shard = perplexity.gram_shard(keys, 5)
    f = perplexity.bloom(spark.createDataFrame(list(zip(shard.tolist(), keys.tolist(), strict=True)), "shard int, g long"), len(keys), 5)
    assert len(f) == 5 and 64 * f.size <= perplexity.BITS_A_GRAM * len(keys)
    assert perplexity.may_have(f, keys).all() and perplexity.may_have(f, rng.integers(-(1 << 42), 1 << 62, 20_000)).mean() < 0.02


def brute_quality(docs, labels):
    """doc_id, text, lang -> verdict: the model by its definition, trained on
    the operator's own sample, and limits of unseen trusted texts by numpy."""
    base = docs.selectExpr("doc_id", "cast(text as binary) as text", "lang")
    good = labels.where("quality = 1").select("doc_id").distinct()
    sample, trains = perplexity.trusted_sample(base, good, perplexity.TRUSTED_ROWS)
    kn = KneserNey([bytes(r["text"] or b"").lower().split() for r in sample.collect()])
    trusted = {r["doc_id"] for r in good.collect()}
    train = {r["doc_id"] for r in base.where(trains).select("doc_id").collect()}
    lost = {(r["doc_id"], r["text"], r["lang"]): (kn.loss(r["text"] or ""), len((r["text"] or "").encode().split()) + 1) for r in docs.collect()}
    seen = {None: [x / n for (i, _, _), (x, n) in lost.items() if i in trusted and i not in train]}
    for (i, _, g), (x, n) in lost.items():
        if g is not None and i in trusted and i not in train:
            seen.setdefault(g, []).append(x / n)
    limits = {g: np.quantile(v, [0.5, perplexity.QUANTILE]) for g, v in seen.items() if len(v) >= (perplexity.LEAST_TEXTS if g else 1)}
    out = {}
    for row, (x, n) in lost.items():
        mid, high = limits.get(row[2], limits.get(None, (0.0, np.inf)))
        out[row] = (x + perplexity.PRIOR * mid) / (n + perplexity.PRIOR) <= (high + perplexity.SLACK * (high - mid) if np.isfinite(high) else np.inf)
    return out, lost


def test_quality_against_brute_force(spark, small, monkeypatch):
    """Losses and verdicts, with nearly all grams in the shards."""
    monkeypatch.setattr(perplexity, "HEAD_GRAMS", 50)
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    want, lost = brute_quality(docs, labels)
    got = {r["doc_id"]: r for r in perplexity.quality(docs, labels).collect()}
    for (i, text, lang), kept in want.items():
        x, n = lost[i, text, lang]
        assert got[i]["kept"] == kept and got[i]["n_tokens"] == n and got[i]["perplexity"] == pytest.approx(10 ** (x / n), rel=1e-6)
    assert sorted(r["doc_id"] for r in perplexity.keep_good(docs, labels).collect()) == sorted(k[0] for k, v in want.items() if v)


def test_quality(tables):
    docs, labels = tables
    q = perplexity.quality(docs, labels)
    r = q.join(labels, "doc_id").toPandas()
    assert r[r.quality == 1].kept.mean() > 0.98 and r[r.quality == 0].kept.mean() < r[r.quality == 1].kept.mean()
    kept = perplexity.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.select("doc_id").collect()) == sorted(x["doc_id"] for x in q.where("kept").collect())


def test_quality_odd(odd, none, no_labels, spark):
    assert all(x["kept"] for x in perplexity.quality(odd, no_labels).collect()) and perplexity.keep_good(odd, no_labels).count() == odd.count()
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    r = perplexity.quality(odd, labels).collect()
    assert len(r) == odd.count() and {x["n_tokens"] for x in r if x["doc_id"] in (0, 1, 2)} == {1} and {x["n_tokens"] for x in r if x["doc_id"] == 3} == {60_001}
    assert perplexity.quality(none, labels).count() == 0 and perplexity.keep_good(none, labels).count() == 0


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g, n in (("a", 1000), ("b", 31), ("c", 29), (None, 40)) for v in rng.normal(3, 0.01 if g == "a" else 1, n).round(2 if g == "b" else 9)]
    got = perplexity.quantiles(spark.createDataFrame(rows, "lang string, x double"), [0.5, 0.99], 30)
    assert set(got) == {"a", "b", None}
    for g, q in got.items():
        assert q == pytest.approx(np.quantile([v for h, v in rows if g in (h, None)], [0.5, 0.99]), rel=1e-12)
    assert perplexity.quantiles(spark.createDataFrame([], "lang string, x double"), [0.5], 30) == {}


def test_quality_of_a_small_language(spark):
    """A language of 1 % of many trusted texts has its words in the model and
    a limit of its own, from all texts that did not train."""
    rng = np.random.default_rng(2)
    make = lambda g, n: [(g, " ".join(f"{g}{i}" for i in rng.integers(0, 50, 12))) for _ in range(n)]
    rows = [(i, t, g) for i, (g, t) in enumerate(make("aa", 29_700) + make("bb", 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = docs.selectExpr("doc_id", "1 as quality")
    sample, _ = perplexity.trusted_sample(docs.selectExpr("doc_id", "cast(text as binary) as text", "lang"), labels, perplexity.TRUSTED_ROWS)
    texts = [bytes(r["text"]) for r in sample.collect()]
    assert len({w for t in texts if t.startswith(b"bb") for w in t.split()}) == 50 and 3000 < len(texts) < 5000
    kept = perplexity.quality(docs, labels).where("lang = 'bb'")
    assert kept.where("kept").count() >= 297 and kept.select("threshold").distinct().count() == 1


def test_discounts_leave_weight():
    """More fours than threes would give a discount below zero."""
    d = perplexity.discounts({1: 10, 2: 5, 3: 1, 4: 9})
    assert d[0] == 0 and all(x > 0 for x in d[1:])


def test_quality_learns_from_every_trusted_text(spark):
    """Two thirds of all trusted texts train, however many there are, and all
    others give the limits; a sample is drawn only where one is asked for."""
    docs = spark.range(24_000).selectExpr("id as doc_id", "cast(concat('w', id) as binary) as text", "'en' as lang").repartition(4)
    good = docs.where("doc_id % 4 <> 0").select("doc_id")
    sample, trains = perplexity.trusted_sample(docs, good)
    want = {f"w{r['doc_id']}".encode() for r in docs.where("doc_id % 4 <> 0").where(trains).collect()}
    assert {bytes(r["text"]) for r in sample.collect()} == want and abs(len(want) - 12_000) < 500
    assert docs.where(~trains).count() + docs.where(trains).count() == 24_000


def test_counts_are_packed(spark, monkeypatch):
    """What lies on disk of the model takes few bytes a gram, and none of its
    grams has a number beside its key and small counts."""
    monkeypatch.setattr(perplexity, "HEAD_GRAMS", 0)
    rng = np.random.default_rng(4)
    texts = [(" ".join(f"w{i}" for i in rng.integers(0, 3000, 500)).encode(),) for _ in range(200)]
    m = perplexity.train(spark.createDataFrame(texts, "text binary"))
    got = m.others.selectExpr("sum(length(blob)) as bytes", "sum(if(kind = 0, size, 0)) as triples", "count(distinct shard) as shards").first()
    assert got["triples"] >= 99_000 and got["shards"] == m.shards and got["bytes"] < 8 * got["triples"]
