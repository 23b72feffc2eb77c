"""The pipeline, stage by stage, against plain decisions."""

import corpus_pipeline
from quarry.llm import queries, sql
from quarry.llm.shared import materialize

from .common import corpus


def write_tables(spark, folder, rows, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, language int, `later.row` int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    rows = [(r[0], r[1], r[2] and "en", *r[3:], k, k) for k, r in enumerate(corpus())]
    leak = ["alpha beta gamma delta epsilon zeta eta theta iota", "kappa lambda mu nu xi omicron pi rho sigma"]
    rows.append((500, rows[0][1] + " " + " ".join(leak), "en", "a", 1, 1, 1))
    rows.append((501, rows[1][1] + " more words " + leak[0] + " and a different ending of it all", "en", "a", 1, 1, 1))
    folder = str(tmp_path)
    write_tables(spark, folder, rows, list(enumerate(leak)))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "mixing sources", "token-ID output"]
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), "test")
        seen[name] = docs.collect()
        if name != "token-ID output":
            assert docs.columns == columns
    ids = {n: [r.doc_id for r in v] for n, v in seen.items()}
    assert set(ids["language ID"]) == {r[0] for r in rows} - {102, 103, 104}
    assert 100 not in ids["SimHash near-dedup"] and 3 in ids["SimHash near-dedup"]
    assert set(ids["SimHash near-dedup"]) - set(ids["benchmark decontamination"]) == {500}
    cleaned = next(r for r in seen["benchmark decontamination"] if r.doc_id == 501)
    assert cleaned.text == rows[1][1] + " more words  and a different ending of it all" and cleaned.n_chars == len(cleaned.text)
    assert sum(r.n_tokens for r in seen["token-ID output"]) == max(r.start + r.n_tokens for r in seen["token-ID output"])
    assert sorted(ids["token-ID output"], key=lambda x: (x is not None, x)) == sorted(ids["mixing sources"], key=lambda x: (x is not None, x))


def test_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(sql.oracle_sql()) <= set(names)
