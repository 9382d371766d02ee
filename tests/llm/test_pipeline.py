import corpus_pipeline as P
import pytest
from .test_near_duplicates import naive_components, naive_fingerprint

from retention.llm import decontaminate, quality, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark):
    """Every stage, on all that its predecessor kept, does what the operator's scores or a comparison of all pairs say."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept, rows = {}, docs.collect()
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == COLUMNS
        kept[name] = out.collect()
        docs = spark.createDataFrame(kept[name], docs.schema)
    text = {r.doc_id: r.text for r in rows}
    ids = {k: sorted(r.doc_id for r in v) for k, v in kept.items()}
    assert all(r in rows for v in kept.values() for r in v)

    all_docs = spark.read.parquet(f"{SF}/documents.parquet")
    good, vile = quality.fit(all_docs, labels), toxicity.fit(all_docs, labels)
    want = [i for i in sorted(text) if good.score([text[i]])[0] >= 0.3]
    assert ids["quality_classifier"] == want
    want = [i for i in want if vile.score([text[i]])[0] < 0.3]
    assert ids["toxicity"] == want
    reach = naive_components([naive_fingerprint(text[i]) for i in want])
    want = sorted({min(j for j in want if naive_fingerprint(text[j]) in reach[naive_fingerprint(text[i])]) for i in want})
    assert ids["simhash_near_dedup"] == want
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {i for i in want if any(b" ".join(w) in b" ".join(decontaminate.words_of(text[i])) for w in items)}
    assert not whole & set(ids["benchmark_decontamination"])
    assert len(set(want) - set(ids["benchmark_decontamination"])) >= len(whole)

    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    size = {}
    for r in packed:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    assert size == {i: len(text[i].encode()) + 1 for i in ids["benchmark_decontamination"]}


@pytest.fixture
def short_training(monkeypatch):
    monkeypatch.setattr(toxicity, "NOISY_STEPS", 5)
    monkeypatch.setattr(toxicity, "BAG_STEPS", 5)


def test_run_returns_the_last_stage(spark, short_training):
    rows = P.run(spark, SF)
    assert rows.columns[0] == "doc_id" and rows.count() > 0
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "toxicity", "simhash_near_dedup", "benchmark_decontamination",
                                        "best_fit_packing"]


def test_stages_take_odd_tables(spark, odd_rows, short_training):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in odd_rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for rows in (docs, docs.where("false")):
        n = [stage(spark, rows, SF).count() for _, stage in P.STAGES]
        assert max(n[:4]) <= len(odd_rows)
        # the long text's 300,001 tokens make 37 pieces, every other row one
        assert n[4] == (len(odd_rows) - 1 + 37 if rows is docs else 0)
