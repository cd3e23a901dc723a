"""Keyed store and ingest: untouched buckets keep their files, uncommitted versions are invisible, replayed batches leave the same rows."""

import json
import os

from pyspark.sql import functions as F

from cohortmill.sources.store import KeyedStore, bucket_of
from cohortmill.streaming import ingest
from tests.test_streaming import study


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([(f"k{i % 40}", i) for i in range(120)], "key string, v int")
    store = KeyedStore(spark, root, buckets=8)
    store.replace("t", "key", rows, rows, 1)
    assert store.read("t", rows.schema).count() == 0  # not committed yet
    store.commit(1)
    before = files(f"{root}/t")
    new = spark.createDataFrame([("k3", -1)], rows.schema)
    gone = new.select("key").unionByName(spark.createDataFrame([("k5",), (None,)], "key string"))
    touched = KeyedStore(spark, root, buckets=8).replace("t", "key", gone, new, 2)
    want = {r[0] for r in gone.where("key is not null").select(bucket_of("key", 8)).collect()}
    assert set(touched) == want and before <= files(f"{root}/t")
    assert store.read("t", rows.schema).count() == 120  # version 2 has no commit
    again = KeyedStore(spark, root, buckets=8)
    again.replace("t", "key", gone, new, 2)
    again.commit(2)
    got = sorted((r.key, r.v) for r in store.read("t", rows.schema).collect())
    assert got == sorted([(f"k{i % 40}", i) for i in range(120) if i % 40 not in (3, 5)] + [("k3", -1)])
    assert {os.path.basename(os.path.dirname(f)) for f in files(f"{root}/t") - before} == {f"bucket={b}" for b in want}


def test_bucket_without_rows(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), buckets=1)
    rows = spark.createDataFrame([("a", 1)], "key string, v int")
    store.replace("t", "key", rows, rows, 1)
    store.commit(1)
    store.replace("t", "key", rows, rows.limit(0), 2)
    store.commit(2)
    assert store.read("t", rows.schema).count() == 0 and store.read("other", rows.schema).count() == 0


def test_replayed_batch_and_outcomes(spark, tmp_path):
    src, store, cp = tmp_path / "src", str(tmp_path / "store"), str(tmp_path / "cp")
    src.mkdir()
    lines = [json.dumps(study("NCT00000001", "1. Age >= 18 years")), json.dumps(study("NCT00000001", "1. Age >= 18 years")), "{broken", '{"x": 1}', "[1]",
             json.dumps({"protocolSection": {"identificationModule": {}}}), json.dumps(study("NCT00000002", "1. ANC >= 1500"))]
    (src / "a.json").write_text("\n".join(lines))
    ingest.start(spark, str(src), store, cp, lines=True).awaitTermination()
    seen = spark.read.parquet(f"{store}/outcomes")
    assert {(r.status, r.error_message): r["count"] for r in seen.groupBy("status", "error_message").count().collect()} == {
        ("ingested", None): 2, ("superseded", None): 1, ("failed", "Record is not a JSON document"): 2, ("failed", "Record has no protocol section"): 1,
        ("failed", "Search result missing NCT ID"): 1}
    tables = ("trials", "criteria", "runs", "failed")
    rows = lambda: {t: sorted(map(str, spark.read.parquet(f"{store}/{t}").collect())) for t in tables} | {"now": sorted(map(str, ingest.stored_trials(spark, store).collect()))}
    first = rows()
    ingest.ingest_batch(spark.createDataFrame(seen.drop("batch_id").collect(), ingest.OUTCOME), store, 0)
    assert rows() == first
    (src / "b.json").write_text(json.dumps(study("NCT00000001", "1. age >= 18  YEARS")) + "\n" + json.dumps(study("NCT00000002", "1. ANC >= 2000")))
    ingest.start(spark, str(src), store, cp, lines=True).awaitTermination()
    assert {(r.nct_id, r.status) for r in spark.read.parquet(f"{store}/outcomes").where(F.col("batch_id") == 1).collect()} == {("NCT00000001", "skipped"), ("NCT00000002", "ingested")}
    assert {r.nct_id: r.eligibility_text for r in ingest.stored_trials(spark, store).collect()}["NCT00000002"] == "1. ANC >= 2000"
