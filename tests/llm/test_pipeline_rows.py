from collections import Counter

import corpus_pipeline
import helpers
import numpy as np
import public_tokenizers as P
from citeflow.llm import quality_model, secrets, simhash
from citeflow.llm.queries import held_out
from pyspark.sql import functions as F
from test_learned import labelled, secret_docs
from test_near_duplicates import roots, slow_spans
from test_tokens import library


def corpus():
    docs, labels = labelled(120)
    docs += [(1000 + x[0], *x[1:]) for x in secret_docs()[:30]] + [(2000, docs[1][1], *[None] * 6), (None, docs[2][1], *[None] * 6)]
    docs += [(2500, docs[4][1] + " an", *[None] * 6), (3000, None, *[None] * 6), (3001, "", *[None] * 6)]
    docs += [(4000 + i, helpers.prose(i + 7000, 50) + " " + helpers.prose(9999, 80) + " " + helpers.prose(i + 8000, 50), *[None] * 6) for i in range(3)]
    return docs, labels


def survivors(rows):
    """The least id (null first) of each component of fingerprints within four bits."""
    fps = [simhash.fingerprint(t or "") for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    groups = {}
    for (k, _), top in zip(rows, roots(len(rows), links)):
        groups.setdefault(top, []).append((k is not None, k or 0))
    return Counter(k if known else None for known, k in map(min, groups.values()))


def test_rows_of_each_stage_and_of_the_chain(spark, tmp_path):
    docs, labels = corpus()
    where = str(tmp_path)
    helpers.table(spark, docs).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    df = first = spark.read.parquet(f"{where}/documents.parquet")
    seen, frames = [], []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, where).write.parquet(f"{where}/{i}")
        df = spark.read.parquet(f"{where}/{i}")
        frames.append(df)
        seen.append(df.collect())
    known = spark.read.parquet(f"{where}/labels.parquet").where(~held_out()).select("doc_id", "quality")
    model = quality_model.train(first.select("doc_id", "text"), known)
    scores = quality_model.score(first.select("doc_id", "text"), model).where(F.col("score") >= 0.5).collect()
    assert Counter(r.doc_id for r in seen[0]) == Counter(r.doc_id for r in scores) and len(seen[0]) < len(docs)
    assert Counter(r.doc_id for r in seen[1]) == survivors([(r.doc_id, r.text) for r in seen[0]])
    before = [(r.doc_id, (r.text or "").encode()) for r in seen[1]]
    kept = {k: x[2].decode(errors="ignore") for (k, _), x in zip(before, slow_spans([t for _, t in before], 200))}
    assert {r.doc_id: r.text for r in seen[2]} == kept and any(len(kept[k].encode()) < len(t) for k, t in before)
    found = secrets.scan_texts([r.text for r in seen[2]], secrets.train(frames[2].select("doc_id", "text")))
    assert {r.doc_id: r.text for r in seen[3]} == {r.doc_id: secrets.redacted(r.text, f, "[SECRET]") for r, f in zip(seen[2], found)}
    own, texts = library(P.path("word_bpe_49k.json")), {r.doc_id: r.text for r in seen[3]}
    ran = corpus_pipeline.run(spark, where).collect()
    for rows in (seen[4], ran):
        pieces = {}
        for r in sorted(rows, key=lambda r: r.start):
            pieces.setdefault(r.doc_id, []).append(bytes(r.ids))
        assert {k: np.frombuffer(b"".join(v), "<u4").tolist() for k, v in pieces.items()} == {k: [*own(t), 2] for k, t in texts.items()}
