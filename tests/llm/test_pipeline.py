"""The pipeline as a whole against plain versions of its stages, and its results for odd tables."""

import corpus_pipeline
from tests.conftest import DATA
from tests.llm import brute
from tests.llm.test_groups import brute_components
from tests.llm.test_models import plain_model
from triplewright.llm import quality_rules


def test_run_equals_plain_stages(spark):
    d = f"{DATA}/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    marks = {r["doc_id"]: r["quality"] for r in corpus_pipeline.labels(spark, d).collect()}
    score = plain_model(rows, marks)
    rows = [x for x in rows if score(x[1]) >= 0.3]
    trusted = {i for i, y in marks.items() if y == 1}
    ratio = {i: (w, n) for i, w, n in brute.op3_llr(rows, trusted)}
    rows = [(i, t) for i, t in rows if not brute.op3(t)[-1] and ratio[i][0] >= quality_rules.THRESHOLD * ratio[i][1]]
    comp = brute_components(rows)
    rows = [(i, t) for i, t in rows if comp[i][1] == i]
    got = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in rows} and 50 < len(rows) < 200
    # Each mark replaces a stretch of one to several words, so clean texts alone keep their number of words.
    clean = {i: len(brute.WORD.findall(t)) for i, t in rows if sum(brute.op9(t)[:4]) == 0 and "iban" not in t.lower() and "-" not in t}
    words = {}
    for r in got:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n_words"]
    assert clean and all(words[i] == n for i, n in clean.items())


ODD = [
    (1, None, "s", 1), (None, "word " * 80, "s", 1), (2, "", None, 1), (3, "plain words of a text " * 30, "s", 1), (3, "plain words of a text " * 30, "s", 1),
    (4, "plain words of a text " * 30, "t", 1), (3, "other words of it " * 40, None, 1), (5, "mail a@b.cd or " * 3 + " ".join(f"w{k}" for k in range(4000)), "s", 1),
]


def test_every_stage_on_odd_tables(spark):
    d = f"{DATA}/sf0.001"
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string, held int").selectExpr("*", "'x' as words", "1 as kept", "cast(length(text) as long) as n_chars", "'en' as lang")
    stages = dict(corpus_pipeline.STAGES)
    for table, n in ((docs, len(ODD)), (docs.limit(0), 0)):
        for name in ("quality classifier", "quality rules", "personal data", "near-dedup"):
            out = stages[name](spark, table, d)
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
            assert out.count() <= n and (name != "personal data" or out.count() == n)
        assert stages["packing"](spark, table, d).select("doc_id").count() >= n
    kept = [(r["doc_id"], (r["text"] or "")[:5]) for r in stages["near-dedup"](spark, docs, d).collect()]
    assert sorted(kept, key=str) == sorted([(1, ""), (None, "word "), (2, ""), (3, "plain"), (3, "other"), (5, "mail ")], key=str)
    assert [r["text"][:20] for r in stages["personal data"](spark, docs, d).where("doc_id = 5").collect()] == ["mail <EMAIL> or mail"]
