"""The pipeline on the smallest tables: every stage against what it was given."""

import collections

import public_tokenizers

import corpus_pipeline
from warder.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns and docs.count() > 0
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if k == 1:
            norm = ["".join(r["text"].split()) for r in docs.collect()]
            assert len(norm) == len(set(norm)) == len({"".join(r["text"].split()) for r in before.collect()})
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r["doc_id"]: len(lib.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before.collect()}
    got = collections.Counter()
    for r in docs.collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


HARD = "doc_id long, text string, lang string, source string, n_chars int, digest string, kept boolean, class_id long, __kid long, rest string"


def test_stages_take_hard_tables(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, ties, clashing names, and empty tables."""
    body = " ".join(f"w{i % 37}x{i}" for i in range(300))
    more = (None,) * 5
    rows = [(1, body, "en", "s", 9, *more), (1, body, "en", "s", 9, *more), (2, body + " ", None, None, None, *more), (None, None, None, None, None, *more), (None, "", "de", None, 0, *more)]
    rows += [(3, " ".join(body.split()[:290]) + " other", "en", "s", 1, "d", True, 1, 1, "r"), (4, "single", "fr", "t", 6, *more), (None, "no id " * 9, "en", "s", 1, *more), (5, "p " + " ".join(body.split()[:60]), "en", "s", 1, *more)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, given in (("full", rows), ("none", [])):
        docs = spark.createDataFrame(given, HARD).repartition(2)
        for stage, run in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{stage}")
            run(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
            if stage != "packing":
                assert docs.columns == HARD.replace(",", "").split()[::2]
            kept = docs.collect()
            assert bool(kept) == bool(given)
            if stage == "quality" and given:
                assert len(kept) == len(rows)
            if stage == "exact_dedup" and given:
                assert sorted("".join((r["text"] or "").split()) for r in kept) == sorted({"".join((r[1] or "").split()) for r in rows})
            if stage == "near_dedup" and given:
                # 2 has most characters of its copies, and 3 is near it: the smaller stays
                assert sorted((r["doc_id"] or 0, (r["text"] or "")[:6]) for r in kept) == [(0, ""), (0, "no id "), (2, body[:6]), (4, "single"), (5, "p " + body[:4])]
            if stage == "suffix_dedup" and given:
                texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept if r["doc_id"]}
                rest = " " + " ".join(body.split()[60:]) + " "
                assert texts == {2: (rest, len(rest)), 4: ("single", 6), 5: ("p ", 2)}


def test_registered():
    names = queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(oracle_sql()) <= set(names)


def test_stages_send_small_batches_to_python(spark, monkeypatch, tmp_path):
    """A Python worker holds the texts of a batch several times over."""
    import pyarrow as pa

    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("rows", lambda spark, docs, sf_dir: spark.range(0, 9_000, 1, 1).mapInArrow(rows, "n long"))])
    assert max(r["n"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) <= 2_000
