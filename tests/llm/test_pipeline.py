"""The pipeline's stages on their own inputs and end to end."""

import corpus_pipeline
from leafmill.llm import common


def test_stages_in_order_and_whole(spark, small):
    docs = common.table(spark, small, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "toxicity", "line_dedup", "simhash_near_dedup", "best_fit_packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(stage(spark, before, small), name)
        assert after.schema == docs.schema
        ids = after.select("doc_id")
        assert ids.join(before, "doc_id", "left_anti").count() == 0
        if name == "line_dedup":
            assert after.count() == before.count()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, small)
    assert packed.select("doc_id").distinct().count() == before.count()
    whole = corpus_pipeline.run(spark, small)
    assert whole.count() == packed.count()


def test_first_stage_rejects_mostly_poor_documents(spark, small):
    docs = common.table(spark, small, "documents")
    kept = corpus_pipeline.quality_stage(spark, docs, small).select("doc_id")
    truth = common.table(spark, small, "labels")
    gone = truth.join(kept, "doc_id", "left_anti")
    assert gone.where("quality = 1").count() <= 0.05 * truth.where("quality = 1").count()
    assert gone.where("quality = 0").count() >= 0.8 * truth.where("quality = 0").count()


def test_stages_handle_odd_rows(spark, small, odd):
    """Nulls, repeats, ties, long texts and clashing columns, and no rows."""
    rows = odd.withColumnsRenamed({"label": "leafmill_text", "node": "n"}).withColumn("y", odd["start"])
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, small)
        assert out.schema == rows.schema, name
        kept[name] = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
        assert stage(spark, rows.limit(0), small).count() == 0
    every = sorted(((r.doc_id, r.text) for r in rows.collect()), key=repr)
    assert kept["line_dedup"] == every
    for name in ("quality_classifier", "toxicity"):
        assert all(x in every for x in kept[name])
    # One row each: the copies (1 and 2), all without words, and the rest.
    texts = [t for _, t in kept["simhash_near_dedup"]]
    assert texts.count("a b c d e f") == 1 and sum(not (t or "").split() for t in texts) == 1
    assert {t for _, t in every if (t or "").split()} == {t for t in texts if (t or "").split()}
    assert (1, "a b c d e f") in kept["simhash_near_dedup"] and (None, None) in kept["simhash_near_dedup"]
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, small)
    assert packed.select("doc_id", "piece").where("piece = 0").count() == len(every)
    assert corpus_pipeline.STAGES[-1][1](spark, rows.limit(0), small).count() == 0


def test_near_dedup_by_brute_force(spark, small):
    """The stage's choice over the whole table against all pairs."""
    import re

    docs = common.table(spark, small, "documents")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()))
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else {""})
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    want = [rows[k][0] for k in sorted(set(root))]
    for n in (3, 11):  # whatever the partitions
        got = corpus_pipeline.near_dedup_stage(spark, docs.repartition(n), small)
        assert sorted(r.doc_id for r in got.collect()) == want
    assert len(want) < len(rows)


def test_columns_may_have_any_name(spark):
    """Those that the stages use for themselves are left as they are."""
    from leafmill.llm import lines, neardup

    passage = "\n".join(" ".join(f"shared{k}w{j}" for j in range(12)) for k in range(5))
    names = ["leafmill_k1", "leafmill_k2", "leafmill_cuts", "leafmill_node", "leafmill_id", "leafmill_h", "k1", "cuts", "c0", "c7"]
    rows = [(k, f"own {k} text\n{passage}" if k < 4 else " ".join(f"{k}word{j}" for j in range(30)), 3, *range(len(names))) for k in range(8)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "n_chars int", *(f"{n} int" for n in names)]))
    for out, n in ((lines.dedup(docs), 8), (neardup.keep_one(docs), 5)):
        found = out.collect()
        assert out.columns == docs.columns and len(found) == n
        assert all(tuple(r)[3:] == tuple(range(len(names))) for r in found)
    assert sum("shared" in r.text for r in lines.dedup(docs).collect()) == 1
