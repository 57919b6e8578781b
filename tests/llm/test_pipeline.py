from collections import Counter

import corpus_pipeline
import pytest

from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_models import brute_quality
from tests.llm.test_near_dedup import brute_components, brute_fingerprint
from tests.llm.test_packing import check
from textmill.llm import toxicity


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "decontamination", "packing"]


def test_against_brute_force(spark, small, tmp_path):
    """Each stage, on what its predecessor kept, against a plain version: the
    toxicity model's own scores row by row, the rest by brute force."""
    read = lambda t: spark.read.parquet(f"{small}/{t}.parquet")
    docs, labels = read("documents"), read("labels")
    bench = [(r["item_id"], r["text"]) for r in read("benchmark").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        if name == "toxicity":
            m = toxicity.fitted(docs, labels)
            want = {k for k, r in before.items() if m.score(r["text"].encode()) < 0.7}
        elif name == "quality":
            want = {k[0] for k, kept in brute_quality(docs, labels)[0].items() if kept}
        elif name == "near_dedup":
            want = set(brute_components(list(before), [brute_fingerprint(r["text"]) for r in before.values()]))
        elif name == "decontamination":
            want = {r[0] for r in contaminated([(k, r["text"]) for k, r in before.items()], bench) if not r[5]}
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if name == "packing":
            check(out.collect(), list(before.values()), 4096)
            break
        assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want
        docs = out
    got = corpus_pipeline.run(spark, small)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, out.select(key).collect()))


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_odd(spark, small, odd, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    assert f(spark, odd.limit(0), small).count() == 0
    before, after = odd.collect(), f(spark, odd, small)
    rows = after.collect()
    if stage == "packing":  # each row, repeated ones too, is whole; the null and the empty text are their end
        ends = {i: sorted(r["start"] + r["length"] for r in rows if r["doc_id"] == i) for i in {r["doc_id"] for r in rows}}
        assert set(ends) == {r["doc_id"] for r in before} and ends[0] == ends[1] == [1]
        assert len(ends[4]) == 2 and ends[4][0] == ends[4][1] and len(ends[3]) > 10
        return
    assert after.columns == odd.columns and all(r in before for r in rows)
    kept = Counter(r["doc_id"] for r in rows)
    if stage == "near_dedup":  # 0, 1 and 2 have no words; 4 is there twice, with one text
        assert kept == Counter({r["doc_id"]: 1 for r in before if r["doc_id"] not in (1, 2)})
    else:  # what judges texts by themselves treats copies alike
        assert kept[4] in ((0, 2) if stage != "quality" else (0, 1, 2))
    if stage in ("toxicity", "decontamination"):
        assert kept[0] and kept[1] and kept[2]


def test_quality_stage_learns_from_every_trusted_text(spark, small, monkeypatch):
    """The stage asks for no sample."""
    import corpus_pipeline
    from textmill.llm import perplexity

    class Asked(Exception):
        pass

    def asked(base, good, trusted_rows=None):
        raise Asked(trusted_rows)

    monkeypatch.setattr(perplexity, "trusted_sample", asked)
    with pytest.raises(Asked) as e:
        corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{small}/documents.parquet"), small)
    assert e.value.args == (None,)
