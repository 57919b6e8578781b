import csv
import io
import json
import struct

import pytest
from pyspark.sql import Observation

from textmill.operators import prepare
from textmill.sources import dbf, files, ranges, sinks


def post(post_id, text, forum="15", subject="[b]S[/b]", time="0"):
    row = [""] * 26
    row[0], row[1], row[2], row[6], row[14], row[15] = post_id, "t", forum, time, subject, text
    return ";".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ';\n"') else c for c in row)


def test_forum(spark, tmp_path):
    f = tmp_path / "f.csv"
    f.write_text("\n".join([post("1", "A;\nB ü"), post("2", "A;\nB ü"), post("x", "torn"), post("3", " "), post("4", "<p>neu</p>", "999", time="zzz"), post("5", "lang") + ";zuviel"]) + "\n", encoding="utf-8")
    b = files.forum_csv(spark, str(f))
    assert sorted(r["post_id"] for r in b.collect()) == ["1", "2", "3", "4"] and b.columns[:6] == list(files.FORUM_COLUMNS)
    assert files.forum_csv(spark, str(f), 2).count() == 2
    seen = Observation()
    s = prepare.forum_silver(b, seen)
    r = {x["post_id"]: x for x in s.collect()}
    assert set(r) == {"1", "4"} and r["1"]["module"] == "SelectLine Auftrag" and r["4"]["module"] == "999" and r["4"]["post_date"] == "1970-01-01" and r["1"]["post_subject"] == "S"
    assert seen.get["html"] == 1
    g = prepare.forum_gold(s).where("doc_id = 'forum_4'").first()
    assert g["content"]["full_text"] == "S\n\nneu" and g["metadata"]["module"] == "999" and g["metadata"]["filename"] is None


def table(path, fields, rows, cut=0):
    width = 1 + sum(w for _, _, w in fields)
    with open(path, "wb") as f:
        f.write(struct.pack("<B3sIHH20s", 3, b"\0\0\0", len(rows), 32 + 32 * len(fields) + 1, width, b""))
        for name, kind, w in fields:
            f.write(struct.pack("<11sc4xB15x", name.encode(), kind.encode(), w))
        f.write(b"\r")
        body = b"".join((b"*" if gone else b" ") + b"".join(v.encode("cp850").ljust(w) for v, (_, _, w) in zip(vals, fields, strict=True)) for gone, vals in rows)
        f.write(body[: len(body) - cut])


@pytest.fixture(params=["128m", "700", "37"])
def split(spark, request):
    """Byte ranges of these sizes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_dbf(spark, tmp_path, split):
    p = str(tmp_path / "a.dbf")
    table(p, [("NAME", "C", 10)], [(False, ["Alice"]), (True, ["Bob"]), (False, ["Grün"])])
    assert sorted(r["NAME"] for r in dbf.read(spark, p).collect()) == ["Alice", "Grün"]
    assert dbf.stats(spark, p, 2) == {"records_total": 3, "records_loaded": 2, "records_deleted": 1, "fields": ["NAME"]}
    table(p, [("NAME", "C", 10)], [(False, ["Alice"]), (False, ["Bob"])], cut=1)
    assert dbf.read(spark, p).count() == 1
    table(p, [("NAME", "C", 10)], [])
    assert dbf.read(spark, p).count() == 0
    m = tmp_path / "a.dbt"
    m.write_bytes(b"\0" * 512 + b"Memo text".ljust(512) + b"x" * 512 + b"y\x1arest")
    table(p, [("N", "N", 8), ("D", "D", 8), ("L", "L", 1), ("M", "M", 10)], [(False, ["      12", "20240115", "T", "1"]), (False, ["1.50", "", "N", "2"]), (False, ["", "x", "", ""]), (False, ["9", "x", "", "99"])])
    r = {x["N"]: tuple(x) for x in dbf.read(spark, p, str(m)).collect()}
    assert r["12"] == ("12", "2024-01-15", "True", ("Memo text".ljust(512) + "x" * 512 + "y")) and r["1.5"] == ("1.5", "", "False", "x" * 512 + "y") and r[""] == ("", "", "", "") and r["9"][3] == ""


def test_dbf_in_ranges(spark, tmp_path, split):
    """Hundreds of records and memos, cut anywhere, of bytes that are no text."""
    if split == "37":
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    p, m = str(tmp_path / "b.dbf"), tmp_path / "b.dbt"
    texts = [("é" * (i * 37 % 1900) + str(i)) for i in range(300)]
    blocks, rows = [b"\0" * 512], []
    for i, t in enumerate(texts):
        raw = t.encode("cp850") + b"\x1a"
        rows.append((i % 7 == 0, [f"{i:>5}", "\n \x1a"[: i % 4] + "ß", str(len(blocks))]))
        blocks += [raw[j : j + 512].ljust(512, b"\xb1") for j in range(0, len(raw), 512)]
    m.write_bytes(b"".join(blocks))
    table(p, [("I", "N", 5), ("C", "C", 6), ("M", "M", 10)], rows)
    got = {r["I"]: (r["C"], r["M"]) for r in dbf.read(spark, p, str(m)).collect()}
    assert got == {str(i): (("\n \x1a"[: i % 4] + "ß"), t) for i, t in enumerate(texts) if i % 7}


@pytest.mark.parametrize(("raw", "kind", "want"), [(b"9007199254740993", "N", "9007199254740993"), (b"   1e5", "N", "1e5"), (b" 1.50 ", "N", "1.5"), (b"-007", "N", "-7"), (b"  ab  ", "C", "  ab"), (b"  1.50 ", "F", "  1.50"), (b"x.y", "N", "x.y"), (b"    ", "N", "")])
def test_dbf_fields(raw, kind, want):
    """Long integers keep their digits, and blanks before a text stay."""
    assert dbf.field_text(raw, kind) == want


@pytest.mark.parametrize("parts", [1, 3])
def test_dbf_writer(spark, tmp_path, split, parts):
    if split == "37":
        spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    rows = [("  a", "12", "lang " * 300, "20240115"), ("", "", "", ""), ("b", "7", "kurz", ""), ("ß", "8", "x" * 511, ""), ("c", "9", "x" * 512, "")]
    fields = [("C", "C", 5), ("N", "N", 4), ("M", "M", 10), ("D", "D", 8)]
    dbf.write(spark.createDataFrame(rows, "C string, N string, M string, D string"), fields, str(tmp_path / "w"), str(tmp_path / "m"), parts)
    got = sorted(tuple(r) for r in dbf.read(spark, str(tmp_path / "w"), str(tmp_path / "m")).collect())
    assert got == sorted((c, n, m.strip(), "2024-01-15" if d else "") for c, n, m, d in rows)


def test_quoted_records(spark, tmp_path, split):
    """Records are those of the csv module wherever the ranges are cut, and
    positions are in their order, over files of different sizes."""
    if split == "37":
        spark.conf.set("spark.sql.files.maxPartitionBytes", "19")
    want = []
    for name, n in (("a", 3), ("b", 40), ("c", 1)):
        rows = [[f"{name}{i}", ("x\n" * (i % 5)) + 'q"' * (i % 3), ";" * (i % 2), "y\r\nz" if i % 7 == 3 else ""] for i in range(n)]
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f, delimiter=";", lineterminator="\r\n" if name == "b" else "\n").writerows(rows)
        want += rows
    got = ranges.quoted_records(spark, str(tmp_path)).orderBy("file", "at").collect()
    assert [next(csv.reader(io.StringIO(r["record"], newline=""), delimiter=";")) for r in got] == want


def test_numbered_lines(spark, tmp_path, split):
    """Line numbers are right across ranges and files, and validation names them."""
    ok = lambda i: json.dumps({"id": f"Q{i:03d}", "question": "was?", "category": "Recency"})
    (tmp_path / "a.jsonl").write_text("\n".join([ok(1), "", ok(2)]) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join(ok(i) for i in range(3, 60)) + "\r\n\r\n" + ok(60))
    got = {r["id"]: r["line_no"] for r in files.questions_jsonl(spark, str(tmp_path)).collect()}
    assert got == {"Q001": 1, "Q002": 3, **{f"Q{i:03d}": i + 1 for i in range(3, 60)}, "Q060": 62}
    with open(tmp_path / "b.jsonl", "a") as f:
        f.write("\n{torn")
    with pytest.raises(Exception, match="line 63"):
        files.questions_jsonl(spark, str(tmp_path)).collect()


def test_mis_encoded_export(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes(post("1", "gr\xfcn").encode("latin-1") + b"\n")
    with pytest.raises(Exception, match="(?i)utf"):
        files.forum_csv(spark, str(tmp_path / "f.csv")).collect()


def test_forum_of_several_files(spark, tmp_path, split):
    """Of equal texts the first by file name stays, though files are read by size."""
    (tmp_path / "a.csv").write_text(post("1", "gleich") + "\n")
    (tmp_path / "b.csv").write_text("\n".join([post(str(i), f"Zeile\n{i};\n\nmehr") for i in range(10, 40)] + [post("2", "gleich")]) + "\n")
    r = {x["post_id"]: x for x in prepare.forum_silver(files.forum_csv(spark, str(tmp_path))).collect()}
    assert "1" in r and "2" not in r and len(r) == 31 and r["10"]["post_text"] == "Zeile\n10;\nmehr"


def test_caches_of_many_appends(spark, tmp_path):
    """The last append counts, whatever the sizes of the files; compaction keeps it."""
    k, i = str(tmp_path / "k"), str(tmp_path / "i")
    sizes = [1, 2000, 3, 700]
    for n, size in enumerate(sizes, 1):
        d = spark.range(size).selectExpr("string(id) AS chunk_id", f"array('v{n}') AS keywords")
        assert sinks.append_cache(d.repartition(4) if n == 4 else d.coalesce(1), k) == n
        sinks.append_cache(spark.range(size).selectExpr("string(id) AS image_id", "1 AS page", "2 AS width", "3 AS height", f"repeat('d', {n}) AS vlm_description").coalesce(1), i)
    want = {str(x): f"v{max(n for n, s in enumerate(sizes, 1) if x < s)}" for x in range(2000)}
    for _ in range(2):
        assert {r["chunk_id"]: r["keywords"][0] for r in files.keyword_cache(spark, k).collect()} == want
        sinks.compact_cache(files.keyword_cache(spark, k), k)
    assert len([x for x in (tmp_path / "k").iterdir() if x.name.startswith("append=")]) == 1
    assert {r["image_id"]: len(r["vlm_description"]) for r in files.image_cache(spark, i).collect()} == {x: int(v[1:]) for x, v in want.items()}
    rows = spark.createDataFrame([("a", ["1"]), ("a", ["2"])], "chunk_id string, keywords array<string>").coalesce(1)
    sinks.append_cache(rows, str(tmp_path / "l"))
    assert files.keyword_cache(spark, str(tmp_path / "l")).first()["keywords"] == ["2"]


def test_plain_caches_of_several_files(spark, tmp_path):
    """Logs of another writer: by file name, then line, though the larger file is read first."""
    (tmp_path / "a.jsonl").write_text(json.dumps({"chunk_id": "x", "keywords": ["old"]}) + "\n" + "".join(json.dumps({"chunk_id": str(n), "keywords": ["y"]}) + "\n" for n in range(500)))
    (tmp_path / "b.jsonl").write_text("{torn\n" + json.dumps({"chunk_id": "x", "keywords": ["mid"]}) + "\n" + json.dumps({"chunk_id": "x", "keywords": ["new"]}))
    assert files.keyword_cache(spark, str(tmp_path)).where("chunk_id = 'x'").first()["keywords"] == ["new"]


def test_bucketed_index(spark, tmp_path):
    """Joins on a stored index's term and part exchange the asked terms only."""
    from textmill.operators import retrieve

    d = spark.createDataFrame([(i, " ".join(f"w{i * j % 13}" for j in range(1, 9))) for i in range(60)], "id int, text string")
    path = str(tmp_path / "index")
    sinks.write_lexical_index(retrieve.bm25_index(d, "text"), path, buckets=4)
    spark.sql(f"DROP TABLE {sinks._blocks_table(path, 4)}")  # as another session sees it; the files stay
    index = sinks.read_lexical_index(spark, path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        asked = spark.createDataFrame([("w1", 0)], "term string, part int")
        plan = asked.join(index["blocks"], ["term", "part"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    q = spark.createDataFrame([(1, "w1 w2 w5")], "query_id int, query string")
    plain = str(tmp_path / "plain")
    sinks.write_lexical_index(retrieve.bm25_index(d, "text"), plain)
    rows = lambda i: sorted(tuple(r) for r in retrieve.bm25_search(q, i, 7).collect())
    assert rows(index) == rows(sinks.read_lexical_index(spark, plain)) == rows(retrieve.bm25_index(d, "text"))


def test_lexical_index(spark, tmp_path):
    from textmill.operators import retrieve

    d = spark.createDataFrame([(1, "rot blau"), (2, "blau gelb gelb"), (3, "")], "id long, text string")
    path = str(tmp_path / "i")
    assert sinks.read_lexical_index(spark, path) is None
    sinks.write_lexical_index(retrieve.bm25_index(d, "text"), path)
    q = spark.createDataFrame([(1, "gelb")], "query_id long, query string")
    assert [r["id"] for r in retrieve.bm25_search(q, sinks.read_lexical_index(spark, path)).collect()] == [2]
    with pytest.raises(ValueError, match="more than 2"):
        sinks.markdown(d, most=2)


def test_tickets(spark):
    cols = list(files.TICKET_COLUMNS)
    rows = [("1", "K", "1", "2", "Titel", "1", "Fehler &amp; mehr", "Antwort\nMit freundlichen Grüssen\nX", "1000", "2024-01-15T00"), ("2", "K", "1", "2", "T", "999", "F", "  ", "999", ""), ("3", "K", "1", "2", "T", "2", "F", "ok", "7", None)]
    t = spark.createDataFrame(rows, cols).withColumnRenamed("ID", "ID")
    s = prepare.ticket_silver(files.ticket_columns(t))
    r = {x["ID"]: x for x in s.collect()}
    assert set(r) == {"1", "3"} and (r["1"]["product"], r["1"]["status"], r["1"]["LOESUNG"], r["1"]["FEHLER"], r["1"]["processed_date"]) == ("Auftrag", "Erledigt", "Antwort", "Fehler & mehr", "2024-01-15")
    assert r["3"]["status"] == "Zu Bearbeiten"
    assert prepare.ticket_gold(s).where("doc_id = 'ticket_1'").first()["content"]["full_text"] == "Titel\n\nFehlerbeschreibung:\nFehler & mehr\n\nLösung:\nAntwort"
    with pytest.raises(ValueError, match="LOESUNG"):
        files.ticket_columns(t.drop("LOESUNG"))


def test_pdf(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "Mein Buch.pdf").write_bytes(b"%PDF")
    (tmp_path / "sub" / "b.pdf").write_bytes(b"%PDF")
    assert files.pdf_files(spark, str(tmp_path)).count() == 1 and files.pdf_files(spark, str(tmp_path), True).count() == 2

    def parser(content):
        return ["eins\n42\n", "", "zwei"], [(1, "Kapitel Eins", 1), (2, "Unter", 1)], [(7, 1, 100, 100), (8, 1, 30, 30), (7, 2, 100, 100), (9, 3, 60, 60)]

    d = files.pdf_pages(files.pdf_files(spark, str(tmp_path)), parser)
    from pyspark.sql import functions as F

    d = d.withColumn("images", F.transform("images", lambda i: F.struct(i["image_id"].alias("image_id"), i["page"].alias("page"), F.lit("/r/x/a.png").alias("filepath"), i["width"].alias("width"), i["height"].alias("height"))))
    g = prepare.paged_gold(prepare.paged_silver(d), "handbuch", "/r").first()
    assert (g["doc_id"], g["content"]["full_text"], g["metadata"]["page_count"], g["metadata"]["image_count"]) == ("mein_buch", "eins\n\nzwei", 3, 2)
    assert [(i["image_id"], i["page"], i["filepath"]) for i in g["images"]] == [("img_001", 1, "x/a.png"), ("img_002", 3, "x/a.png")] and g["content"]["outline"][1]["level"] == 2


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines) + "\n", encoding="utf-8")
    return str(path)


GOOD = {"id": "Q001", "question": "?", "category": "Chunking", "ground_truth": "g"}


def test_questions(spark, tmp_path):
    r = files.questions_jsonl(spark, write(tmp_path / "q.jsonl", [GOOD, "", {"id": "Q002", "question": "x", "category": "Recency"}])).collect()
    assert [(x["line_no"], x["id"], x["ground_truth"]) for x in r] == [(1, "Q001", "g"), (3, "Q002", "")]
    for i, bad in enumerate([{**GOOD, "id": "Q1"}, {**GOOD, "category": "chunking"}, {**GOOD, "question": " "}, {"id": "Q001", "question": "?"}, {**GOOD, "ground_truth": 3}, {**GOOD, "question": 5}, "{torn"]):
        with pytest.raises(Exception, match="line 2"):
            files.questions_jsonl(spark, write(tmp_path / f"b{i}.jsonl", [GOOD, bad])).collect()


def test_caches(spark, tmp_path):
    k = write(tmp_path / "k.jsonl", [{"chunk_id": "a", "keywords": ["x"]}, "{torn", {"chunk_id": "a", "keywords": ["y"]}])
    assert [tuple(r) for r in files.keyword_cache(spark, k).collect()] == [("a", ["y"])]
    i = write(tmp_path / "i.jsonl", [{"image_id": "a", "page": 1, "vlm_description": "alt"}, {"image_id": "a", "page": 1, "vlm_description": "neu"}])
    assert files.image_cache(spark, i).first()["vlm_description"] == "neu"
    with pytest.raises(Exception, match="(?i)malformed"):
        files.image_cache(spark, write(tmp_path / "j.jsonl", ["{torn"])).collect()


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "ä", [1]), (2, None, [2])], "a int, b string, c array<int>")
    assert sinks.write_jsonl(d, str(tmp_path / "j")) == 2
    assert "ä" in "".join(p.read_text() for p in (tmp_path / "j").glob("part*"))
    sinks.write_silver_csv(d, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["a", "b"]
    assert sinks.markdown(d.select("a", "b")) == "| a | b |\n|---|---|\n| 1 | ä |\n| 2 | – |\n"
    (tmp_path / "r_1.json").write_text("{}")
    (tmp_path / "r_2.json").write_text("{}")
    assert files.latest_file(spark, str(tmp_path / "r_*.json")).endswith("r_2.json") and files.latest_file(spark, str(tmp_path / "none*")) is None
    sinks.backup_once(d, str(tmp_path / "b"))
    sinks.backup_once(d.limit(0), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2
    g = spark.createDataFrame([("f", 1)], "source_type string, x int")
    sinks.write_index(g, str(tmp_path / "v"))
    sinks.write_index(g, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    sinks.write_index(g, str(tmp_path / "v"), reset=True)
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1
    s = spark.createDataFrame([("Q1", 0.5)], "question_id string, faithfulness double")
    sinks.write_scores(s, str(tmp_path / "s"), judge="x")
    assert tuple(files.scores_json(spark, str(tmp_path / "s")).select("question_id", "faithfulness").first()) == ("Q1", 0.5) and spark.read.json(str(tmp_path / "s/metadata")).first()["judge"] == "x"
    old = write(tmp_path / "o.json", [{"metadata": {}, "scores": [{"question_id": "Q2"}]}])
    assert files.scores_json(spark, old).first()["question_id"] == "Q2"
    gold = write(tmp_path / "g.jsonl", [{"doc_id": "a", "source_type": "forum"}, ""])
    assert files.gold_jsonl(spark, [gold, str(tmp_path / "none.jsonl")]).where("doc_id is not null").count() == 1
    assert files.gold_jsonl(spark, [str(tmp_path / "none.jsonl")]).count() == 0


def test_artifacts_and_ticket_csv(spark, tmp_path):
    a = spark.createDataFrame([("Wie geht das?", "so")], "query string, answer string")
    sinks.write_query_artifact(a, str(tmp_path / "q"), "20260101T000000Z")
    assert [p.name for p in (tmp_path / "q").iterdir() if p.is_dir()] == ["artifact=20260101T000000Z_wie_geht_das"]
    (tmp_path / "t.csv").write_text('ID,LOESUNG\n1,"a\nb"\n2,c\n', encoding="utf-8")
    assert [r["LOESUNG"] for r in files.tickets_csv(spark, str(tmp_path / "t.csv")).orderBy("ID").collect()] == ["a\nb", "c"]


def test_silver_csv_gives_texts_back(spark, tmp_path):
    texts = ['a "b", c;\n"d"', "  blanks  ", None, '"', "back\\slash\\", 'x\r\ny\rz', '\\"', 'end\\",next']
    rows = [(str(i), t) for i, t in enumerate(texts)]
    sinks.write_silver_csv(spark.createDataFrame(rows, "id string, t string"), str(tmp_path / "c"))
    assert sorted(map(tuple, files.tickets_csv(spark, str(tmp_path / "c")).collect())) == rows


#: Texts that a CSV parser may mix up: empty ones, quotes, both line ends, the first and the last character of the plane.
ODD = ["", None, '"', '""', '","', "\0", 'a\0"\0b\n', '\0"', "\uffff", "a\uffff\n,b", "\r", "a\r\n", " ", "\ufeff", "\\", "null", '"\n' * 3000, "x" * 200_000]


def test_silver_table_of_odd_texts(spark, tmp_path, split):
    """Every text comes back as its SQL says: an empty one is no null, and no character is lost."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    if split != "128m":
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    rows = [(i, t, ODD[-i] if len(ODD[-i] or "") < 9 else "de", "s") for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries()["silver_table"](spark, str(tmp_path)).select("doc_id", "lang", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(c.sql(oracle_sql()["silver_table"]).fetchall(), key=repr)
    assert {r["text"] for r in got} == set(ODD)


def test_forum_keeps_every_character(spark, tmp_path):
    texts = ["a\0;b", "a\uffff;b", '\0"\n\uffff"', "ä"]
    (tmp_path / "f.csv").write_text("\n".join(post(str(i), t) for i, t in enumerate(texts)) + "\n", encoding="utf-8")
    got = files.forum_csv(spark, str(tmp_path / "f.csv")).collect()
    assert {r["post_id"]: r["post_text"] for r in got} == {str(i): t for i, t in enumerate(texts)}


@pytest.mark.parametrize(("record", "want"), [("a,,b", ["a", None, "b"]), ('"",a,""', ["", "a", ""]), (",", [None, None]), ('"a""b,","c"', ['a"b,', "c"]), ('"a" ,b', ["a", "b"]), ('"a"b,c', ['"a"b', "c"]), ('a"b,c"', ['a"b', 'c"']), ('a,"b,c', ["a", "b,c"]), ('a,"', ["a", '"']), ('""""', ['"'])])
def test_fields_of_records(record, want):
    assert files.fields_of(record, ",") == want


def test_stored_index_of_rows(spark, tmp_path):
    """Rows, plain and bucketed, found again by a session that doesn't know the table."""
    from textmill.operators import retrieve

    d = spark.createDataFrame([(i, " ".join(f"w{i * j % 13}" for j in range(1, 9))) for i in range(60)], "id int, text string")
    q = spark.createDataFrame([(1, "w1 w2 w5"), (2, "w3")], "query_id int, query string")
    rows = lambda i: sorted((r["query_id"], r["id"], round(r["bm25"], 7), r["rank"]) for r in retrieve.bm25_search(q, i, 7).collect())
    want = rows(retrieve.bm25_index(d, "text"))
    for buckets in (0, 4):
        path = str(tmp_path / f"index{buckets}")
        sinks.write_lexical_index(retrieve.bm25_rows(d, "text"), path, buckets)
        if buckets:
            spark.sql(f"DROP TABLE {sinks._blocks_table(path, buckets)}")
        assert rows(sinks.read_lexical_index(spark, path)) == want


def test_records_go_out_many_at_a_time(spark, tmp_path):
    """Records of several lines are not a batch each, and batches are bounded, whatever the session says."""
    from textmill.sources.ranges import quoted_records

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    (tmp_path / "a.csv").write_text("".join(f'{i};"a\nb"\n' for i in range(5000)))
    rows = quoted_records(spark, str(tmp_path / "a.csv"))

    def sizes(batches):
        for b in batches:
            yield b.slice(0, 1)

    assert rows.count() == 5000 and {r["record"] for r in rows.collect()} == {f'{i};"a\nb"' for i in range(5000)}
    assert rows.mapInArrow(sizes, rows.schema).count() >= 5 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1024"
