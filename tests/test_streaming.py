import json

from textmill.operators import chunk
from textmill.streaming import ingest


def test_ingest_once(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()

    def drop(name, *ids):
        (src / name).write_text("\n".join(json.dumps({"doc_id": i, "source_type": "forum", "content": {"full_text": f"text {i}"}}) for i in ids))

    drop("a.json", "1", "2")
    ingest.ingest(ingest.gold_stream(spark, str(src)), chunk.v1, out, ck).awaitTermination()
    drop("b.json", "2", "3")
    ingest.ingest(ingest.gold_stream(spark, str(src)), chunk.v1, out, ck).awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == ["1", "2", "3"]


def test_windows_stream_equals_batch(spark, tmp_path, small):
    e = spark.read.parquet(f"{small}/events.parquet")
    e.repartition(1).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = ingest.event_rates(s).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {tuple(r)[:3] for r in ingest.event_rates(e).collect()}
    assert {tuple(r)[:3] for r in spark.table("rates").collect()} == batch
    assert ingest.sessions(e).agg({"n": "sum"}).first()[0] == e.count()


def test_ingest_reads_no_table(spark, tmp_path):
    """Known documents are the stream's own state: a batch comes by without the
    chunks that were written, and a batch that died is replaced."""
    src, out, ck = tmp_path / "src", tmp_path / "out", str(tmp_path / "ck")
    src.mkdir()
    put = lambda name, ids: (src / name).write_text("\n".join(json.dumps({"doc_id": str(i), "source_type": "forum", "content": {"full_text": f"text {i}"}}) for i in ids))
    go = lambda chunker: ingest.ingest(ingest.gold_stream(spark, str(src)), chunker, str(out), ck)
    put("a.json", range(50))
    go(chunk.v1).awaitTermination()
    out.rename(tmp_path / "moved")
    put("b.json", range(40, 60))

    def dies(batch):
        raise ValueError("killed")

    import pytest
    from pyspark.errors import StreamingQueryException

    with pytest.raises(StreamingQueryException):
        go(dies).awaitTermination()
    go(chunk.v1).awaitTermination()
    assert sorted(int(r["doc_id"]) for r in spark.read.parquet(str(out)).collect()) == list(range(50, 60))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("HDFSBackedStateStoreProvider") or spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None
