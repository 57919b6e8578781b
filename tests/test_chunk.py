import json

from pyspark.sql import functions as F

from textmill.operators import chunk, enrich
from textmill.schemas import GOLD


def words(n):
    return " ".join(["Wort"] * n)


def gold(spark, source, doc_id, full="", outline=(), pages=(), **meta):
    row = {
        "doc_id": doc_id, "source_type": source, "metadata": meta, "images": [],
        "content": {"full_text": full, "outline": [dict(zip(("level", "title", "page"), o, strict=True)) for o in outline], "pages": [{"page_number": n, "text": t} for n, t in pages]},
    }
    return spark.read.schema(GOLD).json(spark.sparkContext.parallelize([json.dumps(row)]))


def ids(df):
    return [r["id"] for r in df.orderBy("chunk_index").collect()]


def test_v0(spark):
    assert ids(chunk.v0(gold(spark, "forum", "test_doc", "kurz"))) == ["forum__test_doc_chunk_0000"]
    assert len(ids(chunk.v0(gold(spark, "forum", "d", words(1851))))) == 3
    assert ids(chunk.v0(gold(spark, "forum", "d", ""))) == []


def test_atomic(spark):
    r = chunk.v1(gold(spark, "forum", "forum_001", words(500))).collect()
    assert [(x["id"], x["chunking_strategy"], x["source_file"]) for x in r] == [("forum__forum_001", "atomic", "unknown")]
    r = chunk.v1(gold(spark, "ticket", "t", words(8500))).collect()
    assert len(r) == 6 and all(x["chunking_strategy"] == "recursive_fallback" and "overflow_recursive" in x["id"] for x in r)
    assert len(chunk.v1(gold(spark, "forum", "e", "")).collect()) == 1


def test_pages(spark):
    r = chunk.v1(gold(spark, "modulbeschreibung", "m", pages=[(1, words(100)), (2, words(150)), (3, words(120))])).orderBy("chunk_index").collect()
    assert [x["page_number"] for x in r] == [1, 2, 3] and r[2]["id"] == "modulbeschreibung__m_page_0003"
    r = chunk.v1(gold(spark, "modulbeschreibung", "m", pages=[(1, "a"), (2, "  "), (3, words(2900)), (4, "b")]))
    assert ids(r) == ["modulbeschreibung__m_page_0001", "modulbeschreibung__m_page_0003_recursive_0001", "modulbeschreibung__m_page_0003_recursive_0002", "modulbeschreibung__m_page_0004"]


def test_outline(spark):
    d = gold(spark, "handbuch", "h", outline=[(1, "K", 1), (2, "A", 2), (3, "x", 3), (3, "y", 4), (3, "z", 5), (2, "B", 6)], pages=[(1, "i"), (2, words(600)), (3, words(600)), (4, words(600)), (5, words(600)), (6, words(200))])
    r = chunk.v1(d).orderBy("chunk_index").collect()
    assert [x["id"] for x in r] == ["handbuch__h_h3_0000", "handbuch__h_h3_0001", "handbuch__h_h3_0002", "handbuch__h_h2_0003"]
    assert r[0]["outline_path"] == ["K", "A", "x"] and r[3]["outline_path"] == ["K", "B"]
    d = gold(spark, "handbuch", "h", outline=[(1, "K", 1), (2, "A", 2), (3, "x", 3), (2, "B", 4)], pages=[(1, "i"), (2, words(100)), (3, words(2200)), (4, words(100))])
    assert ids(chunk.v1(d)) == ["handbuch__h_h3_0000_recursive_0000", "handbuch__h_h3_0000_recursive_0001", "handbuch__h_h2_0002"]
    d = gold(spark, "handbuch", "h", outline=[(2, "A", 1), (2, "B", 1)], pages=[(1, "text")])
    assert ids(chunk.v1(d)) == ["handbuch__h_h2_0000"]
    d = gold(spark, "handbuch", "h", full=words(10), pages=[(1, "x")])
    assert ids(chunk.v1(d)) == ["handbuch__h_nooutline_recursive_0000"]


def test_limited(spark):
    c = chunk.v0(gold(spark, "forum", "d", words(1851)))
    assert ids(chunk.limited(c, 2)) == ["forum__d_chunk_0000", "forum__d_chunk_0001"]
    assert [tuple(r) for r in chunk.strategy_counts(c).collect()] == [("forum", "unknown", 3)]


def test_unknown_source(spark):
    assert ids(chunk.v1(gold(spark, "wiki", "w", "kurz"))) == ["wiki__w_chunk_0000"]


def test_metadata(spark):
    d = gold(spark, "handbuch", "h", outline=[(1, "Kapitel 1", 1), (2, "Abschnitt 1.1", 2), (2, "Abschnitt 1.2", 5)], pages=[(i, "t") for i in range(1, 7)], filename="Mein_Handbuch.pdf")
    r = enrich.with_metadata(chunk.v1(d), d).orderBy("chunk_index").collect()
    assert [(x["outline_level"], x["page_start"], x["page_end"], x["doc_title"], x["outline_path"]) for x in r] == [(2, 2, 5, "Mein Handbuch", "Kapitel 1 > Abschnitt 1.1"), (2, 5, 6, "Mein Handbuch", "Kapitel 1 > Abschnitt 1.2")]
    d = gold(spark, "forum", "forum_1", "x", post_id="1", module="M")
    r = enrich.with_metadata(chunk.v1(d), d).first()
    assert (r["post_id"], r["topic_id"], r["module_lookup"], r["post_date"], r["product"]) == ("1", "", "M", "", None)
    other = gold(spark, "forum", "nobody", "x")
    assert enrich.with_metadata(chunk.v1(d), other).first()["post_id"] is None
    assert enrich.missing_metadata(chunk.v1(d), other).count() == 1


def test_same_id_in_two_sources(spark):
    a, b = gold(spark, "modulbeschreibung", "x", pages=[(1, "a")], filename="A_1.pdf"), gold(spark, "schulungsunterlage", "x", pages=[(1, "b")], filename="B_2.pdf")
    d = a.unionByName(b)
    r = enrich.with_metadata(chunk.v1(d), d).collect()
    assert {x["source_type"]: x["doc_title"] for x in r} == {"modulbeschreibung": "A 1", "schulungsunterlage": "B 2"}


def test_keywords(spark):
    calls = []

    def provider(texts):
        calls.append(texts)
        return [["eins", "zwei", "drei", "x"] for _ in texts]

    c = chunk.v1(gold(spark, "forum", "a", "t").unionByName(gold(spark, "forum", "b", "u")))
    cache = spark.createDataFrame([("forum__a", ["k1", "k2", "k3"])], "chunk_id string, keywords array<string>")
    made = enrich.new_keywords(c, cache, provider)
    assert [(r["chunk_id"], r["keywords"]) for r in made.collect()] == [("forum__b", ["eins", "zwei", "drei"])]
    done = enrich.with_keywords(c, cache.unionByName(made)).orderBy("id").collect()
    assert [r["keywords"] for r in done] == ["k1,k2,k3", "eins,zwei,drei"]
    poor = spark.createDataFrame([("forum__a", ["k1", "k2"]), ("forum__b", ["k1", "k2"])], "chunk_id string, keywords array<string>")
    try:
        enrich.with_keywords(c, poor)
    except RuntimeError as e:
        assert "2 of 2" in str(e)
    else:
        raise AssertionError


def test_images(spark):
    blocks = spark.createDataFrame([("schulungsunterlage", "d", 42, 0, 10.0, " oben "), ("schulungsunterlage", "d", 42, 1, 90.0, "unten"), ("schulungsunterlage", "d", 42, 2, 95.0, " ")], "source_type string, doc_id string, page_number int, pos int, y double, text string")
    images = spark.createDataFrame([("schulungsunterlage", "d", 42, 1, 50.0), ("schulungsunterlage", "d", 42, 2, 60.0)], "source_type string, doc_id string, page_number int, index int, y double")
    said = spark.createDataFrame([("schulung_auftrag_einsteiger_p042_img01", "Test")], "image_id string, vlm_description string")
    merged = chunk.merge_images(blocks, images, said)
    assert merged.first()["text"] == "oben\n\n[Bild: Test]\n\nunten"
    d = gold(spark, "schulungsunterlage", "d", pages=[(41, "x"), (42, "y")], filename="B.pdf")
    cache = spark.createDataFrame([("schulungsunterlage__d_page_0042", ["aaa", "bbb", "ccc"])], "chunk_id string, keywords array<string>")
    r = enrich.v4(d, cache, merged, "B.pdf").collect()
    assert [(x["id"], x["chunk_index"], x["chunking_strategy"], x["keywords"]) for x in r] == [("schulungsunterlage__d_page_0042", 1, "page_v4", "aaa,bbb,ccc")]


def test_chunker(spark):
    d = gold(spark, "forum", "a", "t")
    assert enrich.chunker("v1")(d).count() == 1
    for bad in ("v9", ""):
        try:
            enrich.chunker(bad)
        except ValueError:
            continue
        raise AssertionError
    assert enrich.cost_estimate(chunk.v0(d)).first()["ok"]


def test_sorted_entries_are_dealt_to_tasks(spark, monkeypatch):
    """However small the compressed entries are, a task sorts about SORTED of
    them: Spark would join these to one partition."""
    monkeypatch.setattr(chunk, "SORTED", 100)
    d = spark.range(40).selectExpr("string(id) AS doc_id", "transform(sequence(0, 19), i -> struct(int(i % 3 + 1) AS level, string(i) AS title, int(i + 1) AS page)) AS outline", "transform(sequence(0, 19), i -> struct(int(i + 1) AS page_number)) AS pages")
    plain, dealt = chunk.sections(d), chunk.sections(d, n=800)
    assert dealt.rdd.getNumPartitions() == 8 > plain.rdd.getNumPartitions()
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))
    spans = d.select("doc_id", F.lit(1).alias("r"), F.lit(2).alias("start"), F.lit(5).alias("end"))
    points = d.select("doc_id", F.posexplode("pages").alias("at", "p")).select("doc_id", (F.col("at") + 1).cast("long").alias("rank"), F.col("p.page_number").alias("value"))
    met = lambda **n: chunk.inside(spans, points, ("doc_id",), ("r",), **n)
    assert met(n=880).rdd.getNumPartitions() == 9
    assert sorted(map(tuple, met(n=880).collect())) == sorted(map(tuple, met().collect())) == sorted((str(i), 1, k) for i in range(40) for k in (2, 3, 4))
