import random
import time

import numpy as np
import pytest

from textmill.operators import chunk, evaluate, profile, select
from textmill.sources import files


@pytest.mark.parametrize("few", [1, 7, 10_000])
@pytest.mark.parametrize("parts", [2, 1024])
def test_percentiles(spark, monkeypatch, few, parts):
    """As numpy gives them, whatever the distribution, with ties, and with null and NaN left out."""
    monkeypatch.setattr(select, "FEW", few)
    monkeypatch.setattr(select, "PARTS", parts)
    r = random.Random(few)
    of = {"skewed": [r.expovariate(1) ** 9 for _ in range(120)], "same": [5.0] * 40, "few": [1.0, 2.0], "one": [-3.5], "ties": [float(r.randrange(4)) for _ in range(90)], None: [1e300, -1e300, 0.0], "wide": [float(10**i) for i in range(-30, 60)]}
    rows = [(k, v) for k, vs in of.items() for v in [*vs, None, float("nan"), float("inf")]] + [("none", None)]
    at = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {x["key"]["k"]: [x[n] for n in at] for x in select.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", at).collect()}
    assert set(got) == set(of)
    for k, vs in of.items():
        assert got[k] == pytest.approx(list(np.quantile(vs, list(at.values()))), rel=1e-9)


def test_profiles_of_nothing(spark):
    t = spark.createDataFrame([], "text string, lang string, v double")
    assert profile.lengths(t, "text").first()["n"] == 0 and profile.lengths(t, "text", ["lang"]).count() == 0
    assert evaluate.latency_profile(t, "lang", "v").count() == 0 and profile.distinct_gaps(t, {"a": ["text"]}).first()["a"] == 0


def test_distinct_gaps(spark, monkeypatch):
    rows = [("a", None), (None, "a"), ("a", None), (None, None), (None, None), ("ab", "c"), ("a", "bc")]
    t = spark.createDataFrame(rows, "x string, y string")
    keys = {"x": ["x"], "pair": ["x", "y"]}
    assert tuple(profile.distinct_gaps(t, keys).first()) == (len(rows) - 3, len(rows) - 5)
    plan = profile.distinct_gaps(t, keys)._jdf.queryExecution().executedPlan().toString()
    assert all("x#" not in line and "y#" not in line for line in plan.splitlines() if "Exchange" in line)
    # hashes that clash are told apart by the values
    from pyspark.sql import functions as F

    monkeypatch.setattr(profile.F, "xxhash64", lambda *cols: F.lit(1).cast("long"))
    assert tuple(profile.distinct_gaps(t, keys).first()) == (len(rows) - 3, len(rows) - 5)


def brute_outline(outline, pages):
    """Sections by the words of the operator: (h2, h3 or None, pages' text)."""
    out, last = [], max(n for n, _ in pages) + 1
    text = lambda a, b: "\n".join(t.strip() for n, t in pages if a <= n < b and t.strip())
    for i, (level, title, start) in enumerate(outline):
        if level != 2:
            continue
        end = next((p for lv, _, p in outline[i + 1 :] if lv <= 2), last)
        inner = [(t, p) for lv, t, p in outline if lv == 3 and start <= p < end]
        h1 = next((t for lv, t, _ in reversed(outline[:i]) if lv == 1), "")
        if not text(start, end):
            continue
        if len(text(start, end).split()) > chunk.SECTION_LIMIT and inner:
            for j, (t, p) in enumerate(inner):
                stop = inner[j + 1][1] if j + 1 < len(inner) else end
                if text(p, stop):
                    out.append((f"{h1} > {title} > {t}", text(p, stop)))
        else:
            out.append((f"{h1} > {title}", text(start, end)))
    return out


def document(spark, outline, pages, name="h"):
    from textmill import schemas

    content = {"full_text": "", "outline": [dict(zip(("level", "title", "page"), o, strict=True)) for o in outline], "pages": [{"page_number": n, "text": t} for n, t in pages]}
    return spark.createDataFrame([{"doc_id": name, "source_type": "handbuch", "metadata": {"filename": "f"}, "content": content, "images": []}], schemas.GOLD)


@pytest.mark.parametrize("seed", range(4))
def test_outline_against_brute_force(spark, monkeypatch, seed):
    """Outlines that jump back, sections that overlap, pages out of order and several of a number."""
    monkeypatch.setattr(chunk, "SECTION_LIMIT", 6)
    monkeypatch.setattr(chunk, "FALLBACK_WINDOW", (10_000, 0))
    r = random.Random(seed)
    pages = [(r.randrange(1, 20), " ".join(["w"] * r.randrange(5)) + f" p{i}" * r.randrange(2)) for i in range(25)]
    outline = [(r.choice([1, 2, 2, 3, 3, 4]), f"t{i}", r.randrange(0, 22)) for i in range(30)] + [(2, "end", 1)]
    got = [(" > ".join(x["outline_path"]), x["text"]) for x in chunk.by_outline(document(spark, outline, pages)).orderBy("chunk_index").collect()]
    assert got == brute_outline(outline, pages)


def test_a_large_outline(spark):
    """5,000 pages and 2,000 sections take seconds, and no array is carried below a generator."""
    pages = [(i, f"page {i}") for i in range(1, 5001)]
    outline = [(1, "K", 1)] + [(2, f"s{i}", 1 + i * 5 // 2) for i in range(2000)]
    d = document(spark, outline, pages)
    start = time.perf_counter()
    assert sorted(x["text"] for x in chunk.by_outline(d).collect()) == sorted(t for _, t in brute_outline(outline, pages))
    assert time.perf_counter() - start < 60
    plan = chunk.by_outline(d)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Generate" in line and "sequence" in line:
            assert "pages" not in line and "outline#" not in line.split("],")[0]


def test_run_in_batches(spark, tmp_path):
    q = spark.createDataFrame([(i, f"Q{i:03d}") for i in range(1, 24)], "line_no int, id string")
    asked, path = [], str(tmp_path / "run")

    def run(own):
        ids = [r["id"] for r in own.collect()]
        asked.extend(ids)
        if "Q012" in ids and asked.count("Q012") == 1:
            raise InterruptedError
        return own.selectExpr("id AS question_id", "'c' AS category", "cast(null AS string) AS error")

    with pytest.raises(InterruptedError):
        evaluate.run_in_batches(q, run, path, 10)
    assert evaluate.run_in_batches(q, run, path, 10) and asked.count("Q001") == 1 and asked.count("Q012") == 2
    assert sorted(r["question_id"] for r in files.bundle_jsonl(spark, path).collect()) == [f"Q{i:03d}" for i in range(1, 24)]

    def failing(own):
        return own.selectExpr("id AS question_id", "'c' AS category", "if(line_no % 4 > 0, 'no', null) AS error")

    assert not evaluate.run_in_batches(q, failing, str(tmp_path / "bad"), 3)
    assert files.bundle_jsonl(spark, str(tmp_path / "bad")).count() == 6  # the second batch ends above half of five or more
