import re

import corpus_pipeline
import helpers
from pyspark.sql import functions as F

from citeflow.llm import queries, simhash
from test_learned import labelled, secret_docs


def test_registry():
    names = list(queries.QUERIES)
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "secret_scan", "packing"]


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs, labels = labelled(180)
    docs += [(1000 + x[0], *x[1:]) for x in secret_docs()[:40]] + [(2000, docs[1][1], *[None] * 6), (None, docs[2][1], *[None] * 6), (3000, None, *[None] * 6)]
    docs += [(4000 + i, helpers.prose(i + 7000, 50) + " " + helpers.prose(9999, 80) + " " + helpers.prose(i + 8000, 50), *[None] * 6) for i in range(3)]
    where = str(tmp_path)
    helpers.table(spark, docs).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    df = spark.read.parquet(f"{where}/documents.parquet")
    columns, seen = df.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, where).write.parquet(f"{where}/{i}")
        df = spark.read.parquet(f"{where}/{i}")
        assert name == "packing" or df.columns == columns
        seen.append({r[0]: r for r in df.collect()})
    good = {d[0] for d, x in zip(docs, labels) if x[1]}
    assert len(good - set(seen[0])) <= 2 and len(seen[0]) < len(docs)
    fps = {k: simhash.fingerprint(r.text) for k, r in seen[0].items()}
    for k in seen[0]:
        assert any((fps[k] ^ simhash.fingerprint(r.text)).bit_count() <= 4 for r in seen[1].values())
    assert (1 in seen[1]) != (2000 in seen[1])
    length = 200
    counts = {}
    for r in seen[1].values():
        t = (r.text or "").encode()
        for i in range(len(t) - length + 1):
            counts[t[i : i + length]] = counts.get(t[i : i + length], 0) + 1
    for r in seen[2].values():
        before, after = (seen[1][r[0]].text or ""), r.text
        assert r.n_chars == len(after) and set(seen[2]) == set(seen[1])
        if all(counts[before.encode()[i : i + length]] == 1 for i in range(len(before.encode()) - length + 1)):
            assert before == after
    assert not any(helpers.prose(9999, 80) in r.text for r in seen[2].values())
    assert not any(re.search("[0-9a-f]{16}", r.text) for r in seen[3].values()) and set(seen[3]) == set(seen[2])
    assert set(seen[4]) == set(seen[3])


def test_run(spark, tmp_path):
    docs, labels = labelled(60)
    helpers.table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {"doc_id", "sequence_id", "offset", "ids"} <= set(corpus_pipeline.run(spark, str(tmp_path)).columns)


def test_columns_with_names_that_operators_use(spark, tmp_path):
    docs, labels = labelled(40)
    clash = ["score", "kept", "n_bytes", "spans", "fingerprint", "findings", "component_id", "ids", "SCORE2"]
    df = helpers.table(spark, docs)
    for i, c in enumerate(clash):
        df = df.drop(c).withColumn(c, F.lit(i))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        assert now.columns == df.columns and now.count() > 0
        assert now.select(*clash).distinct().collect() == df.select(*clash).distinct().collect()
