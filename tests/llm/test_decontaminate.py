import hashlib
import re

import pytest

from tests.helpers import canon, duck
from textmill.llm import decontaminate as D
from textmill.llm import queries


def words(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    grams = []
    for item, t in items:
        w = words(t)
        if w:
            n = min(13, len(w))
            grams += [(item, w[i : i + n]) for i in range(len(w) - n + 1)]
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, g in grams:
            for at in range(len(w) - len(g) + 1):
                if w[at : at + len(g)] == g:
                    hit |= set(range(at, at + len(g)))
                    found.add(item)
        ids = ",".join(sorted(str(x) for x in found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


LONG = " ".join(f"w{i}" for i in range(40))
BENCH = [(1, LONG), (2, "kurz und GUT"), (10, "kurz und gut"), (3, None), (4, "--- !"), (5, LONG[20:]), (6, "Äpfel ÄPFEL äpfel"), (7, "the the the the the the the the the the the the the the the")]
DOCS = [
    (0, "vor " + LONG + " nach"), (1, "kurz, und: gut!"), (2, "kurz und"), (3, None), (4, ""), (5, "... ---"), (6, LONG.upper()), (7, "x " * 400 + "kurz und gut"), (8, "Äpfel ÄPFEL äpfel"), (9, "äpfel äpfel äpfel"),
    (10, "the " * 30), (11, " ".join(f"w{i}" for i in range(12))), (12, LONG.replace("w20", "x20")), (12, LONG), (13, "kurz und gut kurz und gut"), (13, "kurz und gut kurz und gut"), (None, "kurz und gut"), (14, "w1\x00w2 w3"), (15, "a " * 3000),
]


@pytest.fixture(scope="module")
def tables(spark):
    d = spark.createDataFrame([(*r, "en", 1, "k") for r in DOCS], "doc_id long, text string, lang string, n_hit int, key string")
    return d, spark.createDataFrame([(*r, 0) for r in BENCH], "item_id long, text string, h long")


def test_against_brute_force(tables):
    assert sorted((tuple(r) for r in D.contamination(*tables).collect()), key=str) == brute(DOCS, BENCH)


@pytest.mark.parametrize(("anchors", "windows"), [(3, 0), (1 << 40, 0), (3, 1 << 40)])
def test_more_windows_than_are_broadcast(tables, monkeypatch, anchors, windows):
    """In several passes over the anchors, and with the windows shuffled."""
    monkeypatch.setattr(D, "ANCHORS", anchors)
    monkeypatch.setattr(D, "WINDOWS", windows)
    assert sorted((tuple(r) for r in D.contamination(*tables).collect()), key=str) == brute(DOCS, BENCH)


def test_many_windows_and_long_texts(spark):
    """Over 200,000 windows, by the plan that production takes then."""
    items = spark.range(11_000).selectExpr("id AS item_id", "array_join(transform(sequence(0, 31), i -> concat('w', (id * 20 + i) % 210000)), ' ') AS text")
    windows = D.benchmark_windows(items)[0]
    assert windows.count() > D.WINDOWS
    # items 0 to 999 start in the words of text 0, and items 10500 to 10999 repeat the first 500
    # texts of 20,000 words: one follows the items' words, one jumps after every twelfth
    docs = spark.range(2).selectExpr("id AS doc_id", "array_join(transform(sequence(0, 19999), i -> concat('w', if(id = 0, i, i * 2 div 24 * 24 + i % 12))), ' ') AS text")
    r = {x["doc_id"]: x for x in D.contamination(docs, items).collect()}
    assert (r[0]["n_words"], r[0]["n_hit"], r[0]["n_items"]) == (20_000, 20_000, 1500) and r[1]["n_hit"] < 20_000
    want = brute([(1, docs.where("doc_id = 1").first()["text"][:3000])], [(i["item_id"], i["text"]) for i in items.limit(40).collect()])
    got = D.contamination(docs.where("doc_id = 1").selectExpr("doc_id", "substring(text, 1, 3000) AS text"), items.limit(40)).collect()
    assert [tuple(x) for x in got] == want


def test_no_text_is_shuffled(spark, tables, monkeypatch):
    """Of a text, only the words around met anchors cross an exchange."""
    monkeypatch.setattr(D, "WINDOWS", 0)
    monkeypatch.setattr(D, "ANCHORS", 3)
    _, found, _ = D.hits(*tables)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        exchanges, todo = [], [found._jdf.queryExecution().executedPlan()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "Exchange":
            exchanges.append({x.split("#")[0] for x in node.output().mkString(",").split(",")})
    assert any("around" in x for x in exchanges) and all(not x & {"w", "text"} for x in exchanges)


def test_a_window_of_all_items(spark):
    """A passage that all items share is kept as one set of items."""
    shared = " ".join(f"s{i}" for i in range(13))
    items = [(i, f"{shared} own{i} " + " ".join(f"x{i}y{j}" for j in range(15))) for i in range(300)]
    docs = [(i, f"before {shared} after {i}") for i in range(40)] + [(99, items[7][1]), (100, "nothing")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    windows, sets = D.benchmark_windows(b)
    assert windows.groupBy("set").count().where("count = 1").count() == 1 and sets.count() == 300 + 300
    assert sorted(tuple(r) for r in D.contamination(d, b).collect()) == sorted(brute(docs, items))


def test_empty(tables, odd, none):
    d, b = tables
    assert D.contamination(d.limit(0), b).count() == 0
    assert {(r["n_hit"], r["contaminated"]) for r in D.contamination(d, b.limit(0)).collect()} == {(0, False)}
    assert D.contamination(odd, b).count() == odd.count() and D.contamination(none, b).count() == 0


def test_sql(spark, small):
    got = queries.op6_decontamination(spark, small).toPandas()
    assert canon(got) == canon(duck(small).sql(queries.OP6_SQL).df())


def test_native(tables):
    plan = D.contamination(*tables)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_remove(tables):
    d, b = tables
    kept = D.remove_contaminated(d, b)
    bad = [r for r in brute(DOCS, BENCH) if r[5]]
    assert kept.columns == d.columns and kept.count() == len(DOCS) - len(bad)
    assert kept.where("doc_id = 12").count() == len([r for r in brute(DOCS, BENCH) if r[0] == 12 and not r[5]])
    cut = {r["doc_id"]: r["text"] for r in D.remove_spans(d, b).collect()}
    assert cut[1] == "!" and cut[7] == "x " * 400 and cut[3] is None and cut[2] == "kurz und" and cut[0] == "vor  nach"
