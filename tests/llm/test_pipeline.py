import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

from . import test_bpe, test_decontaminate, test_line_dedup, test_near_copies


def test_stages_against_brute_force(spark, tmp_path):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")]
    rows = test_line_dedup.corpus(25) + [(300, "x y " + items[0][1] + " z"), (301, None), (302, ""), (303, "one two three"), (304, "one two three")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        df = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append({r.doc_id: r for r in df.collect()})
        assert k == 4 or df.columns == docs.columns
    assert len(seen[0]) == len(rows)
    assert {d: r.text for d, r in seen[1].items()} == dict(test_line_dedup.brute(rows))
    roots = test_near_copies.brute([(d, r.text) for d, r in seen[1].items()])
    assert {d: r.text for d, r in seen[2].items()} == {d: seen[1][d].text for d, root in roots.items() if d == root}
    hits = test_decontaminate.brute([(d, r.text) for d, r in seen[2].items()], items)
    assert all((seen[3][d].text == r.text) == (hits[d][1] == 0) for d, r in seen[2].items())
    assert not any(x[1] for x in test_decontaminate.brute([(d, r.text) for d, r in seen[3].items()], items).values())
    for d, r in seen[3].items():
        ids = test_bpe.library.encode(r.text or "", add_special_tokens=False).ids
        assert (seen[4][d].n_tokens, seen[4][d].ids_sha256) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.ids_sha256 for r in ran.collect()} == {d: r.ids_sha256 for d, r in seen[4].items()}
