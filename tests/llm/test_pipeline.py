import random

import corpus_pipeline as C
from fixtures import changed, prose


def test_each_stage_on_planted_rows(spark, folder):
    """Toxic, copied, nearly copied and contaminated documents go; clean ones stay, with their ids."""
    draw = random.Random(1)
    clean = [" ".join(prose(k, 160, 5000)) for k in range(60)]
    item = prose(500, 40, 10**6)
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100 + i, t) for i, t in enumerate(clean[:10])]
    rows += [(200 + i, " ".join(changed(t.split(), {draw.randrange(80), 80 + draw.randrange(80)}, "new"))) for i, t in enumerate(clean[10:20])]
    rows += [(300 + i, " ".join(prose(700 + i, 20) + item[20:] + item[:20] + prose(800 + i, 20))) for i in range(3)]
    rows += [(400 + i, " ".join(prose(900 + i, 30) + ["wretch", "vermin", "wretch"])) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "é\n\n  ü")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    marks = [(i, 1, int(400 <= i < 500)) for i, _ in rows if i < 60 or 400 <= i < 500]
    spark.createDataFrame(marks, "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id BIGINT, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    read, left = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, read, folder)
        out.write.parquet(f"{folder}/stage{k}")
        read = spark.read.parquet(f"{folder}/stage{k}")
        left.append({r["doc_id"] for r in read.select("doc_id").collect()})
        if k < len(C.STAGES) - 1:
            assert read.columns == docs.columns
    every = {i for i, _ in rows}
    assert left[0] == every - set(range(400, 460))
    assert left[1] == left[0] - set(range(100, 110))
    assert left[2] == left[1] - set(range(200, 210))
    assert left[3] == left[2] - set(range(300, 303))
    assert left[4] == left[3]
    assert {r["doc_id"] for r in C.run(spark, folder).collect()} == left[4]
    assert read.filter("NOT round_trip").count() == 0
