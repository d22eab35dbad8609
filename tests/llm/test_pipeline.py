"""Each stage of the pipeline on what its predecessor kept, against plain Python."""

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from wattloom.llm import jaccard, mixing, pii, toxicity

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    stages = [f for _, f in cp.STAGES]
    clean = stages[0](spark, docs, D)
    assert clean.columns == docs.columns
    rejected = toxicity.score(docs, labels).where("rejected").count()
    assert clean.count() == docs.count() - rejected
    one = stages[1](spark, clean, D).cache()
    classes = {r["doc_id"]: r["component_id"] for r in jaccard.near_classes(clean).collect()}
    assert sorted(r["doc_id"] for r in one.select("doc_id").collect()) == sorted(set(classes.values()))
    safe = stages[2](spark, one, D).cache()
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (one, safe))
    assert before.keys() == after.keys()
    for i, t in before.items():
        for s, e, _ in pii.mentions(t or ""):
            assert t[s:e] not in after[i]
    mixed = stages[3](spark, safe, D).cache()
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    out = stages[4](spark, mixed, D).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(out) == mixed.count()
    for r in out[:50]:
        assert r["ids"] == t.encode(after[r["doc_id"]], add_special_tokens=False).ids


def test_mix_of_repeated_rows_and_null_ids(spark):
    """As many rows as the mix takes copies, however ids repeat; an extra column may be called like the row's hash."""
    rows = [(None, f"word {i} " * (i % 7 + 1), "en", "a", 1, i) for i in range(40)] + [(5, f"text {i} of five", "en", "b", 1, i) for i in range(40)] + [(7, "the same row", "de", None, 1, 0)] * 9 + [(8, None, None, "a", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_hash long")
    mixed = cp.mix(spark, docs, D)
    assert mixed.columns == docs.columns
    got, given = Counter(map(tuple, mixed.collect())), Counter(rows)
    assert got.keys() <= given.keys() and all(n <= 3 * given[r] for r, n in got.items())
    words = lambda source: sum(n * len((r[1] or "").split()) for r, n in got.items() if r[3] == source)
    sizes = {s: sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in ("a", "b", None)}
    goal = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    for s in sizes:
        assert abs(words(s) - goal[s]) <= 8
    assert Counter(map(tuple, cp.mix(spark, docs.repartition(3), D).collect())) == got


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, p_toxic string, component_id long, copies string, n_entities int"
    odd = [(None,) * 9, (1, "", "en", "web", 0, "x", 1, "y", 2), (1, "", "en", "web", 0, "x", 1, "y", 2), (2, None, None, None, None, None, None, None, None), (3, "mail a.b@example.org " + "long text " * 30_000, "en", "web", 7, "x", 3, "y", 2)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in cp.STAGES[:-1]:
            kept = stage(spark, docs, D).cache()
            assert kept.dtypes == docs.dtypes
            docs = kept
        assert cp.STAGES[-1][1](spark, docs, D).count() == docs.count()


def test_run(spark):
    assert cp.run(spark, D).count() > 0


def test_stages_send_small_batches_to_python(spark):
    """Whatever the texts' length, a worker gets some 4 MB at once; a longer text goes whole, and a setting of the session's own stays."""
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"n": pa.array([len(b)]), "bytes": pa.array([b.nbytes])})

    try:
        texts = ["xyz " * 25_000] * 100 + ["xyz " * 1_250_000]
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
        out = cp.STAGES[-1][1](spark, docs, D)
        got = docs.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in got) == len(texts)
        assert len(got) >= 3 and sorted(r["bytes"] for r in got)[-2] < 8e6
        assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == list(range(len(texts)))
        spark.conf.set(key, 1 << 20)
        cp.STAGES[-1][1](spark, docs, D)
        assert int(spark.conf.get(key)) == 1 << 20
    finally:
        spark.conf.unset(key)
