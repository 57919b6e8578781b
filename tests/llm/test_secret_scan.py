import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.helpers import canon, duck
from textmill.llm import queries
from textmill.llm import secret_scan as S

KEY = "AKIA" + "7EXAMPLE" * 2
TEXTS = [
    f"x token=abcdefgh y password=tok TOKEN='1234567890' äöü {KEY} " + "0a" * 20, None, "", "secret = secret=longervalue123 ", "é" * 5 + " " + " ".join(f"😀 Api_Key:abcdefgh{i}" for i in range(300)),
    "deadbeef" * 4, "deadbeef" * 4, "password: ghp_" + "A1" * 20, "password=token:longvalue12", "AKIAAKIA short AKIAAKIA12345678Z", "apikey\"= \"12345678", "-----BEGIN RSA PRIVATE KEY-----", "token\t=abcdefghij", "ſecret=abcdefghij toKen=abcdefghij",
    "ab" * 15 + "g" + "ab" * 16, "wort " * 50_000 + "token=12345678",
]


def brute(text, rules=S.RULES):
    found = [(m.start(), i, m.end()) for i, r in enumerate(rules) for m in re.finditer(r.pattern, text or "") if len(m[r.group]) >= r.least]
    name = lambda xs: ",".join(f"{rules[i].kind}:{a}:{e}" for a, i, e in xs)
    base = [x for x in sorted(found) if x[1] < 3]
    return (*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(name(base).encode()).hexdigest(), name(sorted(found)))


def plain(text):
    """The contract's words for the base kinds: all greedy matches, then the failing ones dropped."""
    either = re.compile("""(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    out = [(m.start(), 0, m.end()) for m in either.finditer(text or "") if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{e}" for a, k, e in sorted(out)).encode()).hexdigest()


def test_against_brute_force(make):
    got = {r["doc_id"]: tuple(r)[1:] for r in S.secrets(make(TEXTS)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert {i: r[3] for i, r in got.items()} == {i: plain(t) for i, t in enumerate(TEXTS)}
    assert got[8][0] == 0 and got[9][1] == 1 and got[14][2] == 1 and "private_key:0:31" in got[11][4]


@pytest.mark.parametrize("n", [1, 63, 64, 65, 129, 5000])
def test_many_matches(make, n):
    text = "ä".join(f"token={i:08d}" for i in range(n))
    assert tuple(S.secrets(make([text])).first())[1:] == brute(text)


def test_sql(spark, small):
    got = queries.op13_secret_scan(spark, small).toPandas()
    assert canon(got) == canon(duck(small).sql(queries.oracle_sql()["op13_secret_scan"]).df())


def versions(spark, rows):
    return spark.createDataFrame(rows, "path string, version int, text string")


def test_only_unseen_pairs_are_scanned(spark):
    first = versions(spark, [("a", 1, "token=abcdefgh"), ("b", 1, "token=abcdefgh"), ("c", 1, "nothing"), ("d", 1, None)])
    ledger = S.scan(first)
    assert ledger.count() == 3 and ledger.schema.simpleString() == "struct<blob:binary,rules:array<string>,found:array<struct<at:int,end:int,rule:string>>>"
    second = versions(spark, [("a", 2, "nothing"), ("c", 2, "token=abcdefgh"), ("a", 3, "new " + KEY), ("d", 2, "")])
    new = S.scan(second, ledger)
    assert [r["blob"] for r in new.collect()] == [bytearray(hashlib.sha256(("new " + KEY).encode()).digest())]
    every = ledger.unionByName(new)
    assert S.scan(first.unionByName(second), every).count() == 0
    found = {(r["path"], r["version"]): [tuple(f) for f in r["found"]] for r in S.findings(first.unionByName(second).withColumn("id", F.struct("path", "version")), every, id_col="id").select("doc_id.*", "found").collect()}
    assert found[("b", 1)] == found[("c", 2)] == [(0, 0, 14)] and found[("a", 3)] == [(4, 1, 4 + len(KEY))] and found[("d", 2)] == found[("c", 1)] == [] and len(found) == 8


def test_a_changed_rule_is_scanned_alone(spark, monkeypatch):
    docs = versions(spark, [("a", 1, "xoxb-1234567890 AKIA12"), ("b", 1, "nothing")])
    ledger = S.scan(docs)
    changed = (*S.BASE, S.Rule("access", "AKIA[A-Z0-9]+", version=2), *S.RULES[3:])
    for todo in (S.TODO, 0):  # blobs to scan by broadcast, and by a shuffle
        monkeypatch.setattr(S, "TODO", todo)
        new = S.scan(docs, ledger, changed)
        assert {tuple(r["rules"]) for r in new.collect()} == {("access@2",)} and sorted(len(r["found"]) for r in new.collect()) == [0, 1]
    # rows appended twice, or rules no longer asked, change nothing
    every = ledger.unionByName(new).unionByName(new)
    found = {r["doc_id"]: len(r["found"]) for r in S.findings(docs, every, changed, "path").collect()}
    assert found == {"a": 2, "b": 0} and S.scan(docs, every, changed).count() == 0
    assert {r["doc_id"]: len(r["found"]) for r in S.findings(docs, every, id_col="path").collect()} == {"a": 1, "b": 0}


def test_hot_blob(spark):
    """A blob of most rows is dealt by path, and none of its rows is lost."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "if(id % 3 > 0, 'token=abcdefgh', concat('text ', id)) AS text")
    out = S.secrets(docs)
    assert out.count() == 6000 and out.where("n_assign = 1").count() == 4000 and out.select("doc_id").distinct().count() == 6000


def test_native_and_odd_rows(odd, none):
    out = S.secrets(odd)
    plan = S.unseen(odd, None)._jdf.queryExecution().executedPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert out.count() == odd.count() and {r["spans"] for r in out.collect()} == {""} and S.secrets(none).count() == 0


def test_malformed(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62') || encode(' token=abcdefgh', 'utf-8') AS string) AS text")
    assert S.secrets(docs).first()["spans"] == "assign:4:18"
