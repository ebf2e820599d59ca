"""The pipeline over a small directory of tables, stage by stage."""

import random

import cases
import corpus_pipeline
from test_documents import brute_components


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    data, labels = cases.rows(), []
    for i in range(300):
        w = cases.words(rng, rng.randint(20, 90))
        data.append((3000 + i, " ".join(w) if i % 4 else " ".join(x.upper() + "!!" for x in w), "en", "s1", 0))
        labels.append((3000 + i, int(i % 4 != 0), 0))
    item = "when the early train leaves the town with 30 riders how many of them reach the lake by noon"
    data += [(4000, f"so {item} yes", "en", "s2", 0)]
    cases.docs(spark, data=data).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append([tuple(r) for r in docs.collect()])
    bad = {3000 + i for i in range(0, 300, 4)}
    assert not bad & {r[0] for r in seen[0]} and {r[0] for r in seen[0]} >= {3000 + i for i in range(300) if i % 4}
    stay = {d for d, _, c in brute_components(seen[0]) if d is not None and d == c}
    assert {r[0] for r in seen[1]} - {None} == stay
    assert {r[0] for r in seen[1]} - {r[0] for r in seen[2]} == {4000}
    assert {r[0] for r in seen[3]} <= {r[0] for r in seen[2]} and len(seen[4]) == len(seen[3])
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(seen[4])
