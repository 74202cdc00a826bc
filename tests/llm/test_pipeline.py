import corpus_pipeline
from tidemark.llm import bpe, mil, toxicity
from tidemark.llm.queries import tokenizer_path
from test_neardup import plain
from test_scans import hits


def test_stages_against_plain_versions(spark, small):
    """Each stage on what the one before kept, one document at a time in plain Python."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels, items = spark.read.parquet(f"{small}/labels.parquet"), [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    model = mil.learned(docs, labels)
    kept = {r.doc_id: r.text for r in docs.join(mil.scored(docs, model).where("score >= 0.3").select("doc_id"), "doc_id").collect()}
    lexicon = toxicity.learned(docs.where(docs.doc_id.isin(list(kept))), labels)
    kept = {i: t for i, t in kept.items() if lexicon.score(t) < 0.5}
    group = plain(sorted(kept.items()))
    kept = {i: t for i, t in kept.items() if group[i][1] == i}
    kept = {i: t for i, t in kept.items() if not hits(t, items)[-1]}
    assert set(got) == set(kept) and 0 < len(kept) < docs.count()
    own = bpe.codec(tokenizer_path("byte_bpe_50k.tiktoken"))
    assert all(b"".join(own.tokens[i] for i in got[d].ids).decode() == t and got[d].n_tokens == len(got[d].ids) for d, t in kept.items())


def test_columns_stay(spark, frame, hard, small):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, hard, small).columns == hard.columns
    left = corpus_pipeline.near_duplicates(spark, hard.union(hard), small)
    assert sorted(str(r.doc_id) for r in left.where("doc_id is not null").collect()) == sorted(str(i) for i in [*range(12), 3])


def test_rows_of_null_and_repeated_ids_are_dropped_one_by_one(spark, frame, small):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, text), (None, text), (9, text + " end"), (5, text), (5, "a row of its own"), (None, "another row"), (None, None)]
    left = corpus_pipeline.near_duplicates(spark, frame(rows), small).collect()
    assert sorted(str((r.doc_id, r.text)) for r in left) == sorted(str(x) for x in rows[3:])
    item = max((r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()), key=len)
    rows = [(None, item), (7, item), (7, "a clean row"), (None, "another row"), (8, None)]
    left = corpus_pipeline.decontaminated(spark, frame(rows), small).collect()
    assert sorted(str((r.doc_id, r.text)) for r in left) == sorted(str(x) for x in rows[2:])


def test_no_documents_and_hard_ones(spark, frame, hard, empty, small):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).collect() == [], name
        got = stage(spark, hard, small)
        assert 0 < got.count() <= hard.count(), name
    rows = corpus_pipeline.tokens(spark, hard, small).collect()
    assert sorted(r.n_tokens for r in rows)[:2] == [0, 0] and sum(r.doc_id is None for r in rows) == 1
