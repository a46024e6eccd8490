"""The toy graph, the pairing case, parsers and the normaliser, with results worked out by hand."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from triplewright.functions import text as T
from triplewright import storage
from triplewright.operators import encode, extract, minimize, ordering, spans, training, transe
from triplewright.sources import lines

TEXTS = [
    ("Q1", "I am John Doe  from Honolulu, and I am living in Italy", ["John Doe", "JD"]),
    ("Q4", "Honolulu is a city in Utopia", ["Honolulu", "Honhon city"]),
    ("Q2", "Rome is the capital of Italy and a city in Italia", ["Rome", "Roma"]),
    ("Q3", "Milan is a city in Italy, and Milan likes Rome", ["Milan", "Milano"]),
    ("Q5", "Italy is a good country ", ["Italy", "italia"]),
]
TRIPLES = [("Q1", "R1", "Q4"), ("Q1", "R2", "Q5"), ("Q2", "R3", "Q5"), ("Q2", "R4", "Q5"), ("Q3", "R4", "Q5"), ("Q3", "R5", "Q2")]
GOLD = [
    ("Q1", "R1", "Q4", 2, 3, 5, 5), ("Q1", "R2", "Q5", 2, 3, 12, 12), ("Q2", "R3", "Q5", 0, 0, 5, 5), ("Q2", "R3", "Q5", 0, 0, 10, 10), ("Q2", "R4", "Q5", 0, 0, 5, 5),
    ("Q2", "R4", "Q5", 0, 0, 10, 10), ("Q3", "R4", "Q5", 0, 0, 5, 5), ("Q3", "R4", "Q5", 8, 8, 5, 5), ("Q3", "R5", "Q2", 0, 0, 10, 10), ("Q3", "R5", "Q2", 8, 8, 10, 10),
]


@pytest.fixture(scope="module")
def toy(spark):
    df = spark.createDataFrame(TEXTS, "entity_id string, text string, aliases array<string>")
    return (
        spark.createDataFrame(TRIPLES, "h string, r string, t string"),
        df.select("entity_id", T.normalize(F.col("text"), lower=True).alias("text")),
        df.select("entity_id", T.normalize_aliases(F.col("aliases")).alias("aliases")),
    )


def test_gold_triples_of_the_toy_graph(toy):
    assert sorted(tuple(r) for r in spans.gold_triples(*toy).collect()) == sorted(GOLD)


def test_repeated_triples_repeat_their_rows(toy):
    triples, descriptions, aliases = toy
    assert spans.gold_triples(triples.unionAll(triples), descriptions, aliases).count() == 2 * len(GOLD)


def test_filters_by_label(toy):
    labels = spans.silver_labels(*toy)
    assert {r["entity_id"] for r in spans.labelled(toy[1], labels).collect()} == {"Q1", "Q2", "Q3"}
    assert {r["entity_id"] for r in spans.labelled(toy[1], labels, every_kind=True).collect()} == {"Q1", "Q2", "Q3"}
    assert labels.where("pos < 0 or pos >= 128").count() == 0


def test_greedy_pairing(spark):
    rows = [(0, [0.6, 0.4, 0.7, 0.9, 0.1], [0.5, 0.3, 0.6, 0.1, 0.2]), (1, [0.8, 0.3, 0.1, 0.8, 0.4], [0.1, 0.4, 0.2, 0.3, 0.9])]
    emb = [[[1, 2, 3, 4], [1, 3, 7, 1], [7, 1, 2, 1], [1, 3, 1, 1], [2, 1, 3, 1]], [[5, 4, 3, 4], [2, 2, 5, 7], [1, 2, 5, 4], [6, 3, 3, 7], [8, 1, 2, 1]]]
    df = spark.createDataFrame(rows, "entity_id int, start_prob array<double>, end_prob array<double>")
    found = extract.extract_spans(df, threshold=0.5, most=3)
    assert sorted(tuple(r) for r in found.collect()) == [(0, 0, 0, 0), (0, 1, 2, 2), (1, 0, 3, 4)]
    tokens = spark.createDataFrame([(i, p, [float(x) for x in v]) for i, e in enumerate(emb) for p, v in enumerate(e)], "entity_id int, pos int, emb array<double>")
    got = {(r["entity_id"], r["slot"]): r["emb"] for r in extract.span_vectors(found, tokens).collect()}
    assert got == {(0, 0): [1, 2, 3, 4], (0, 1): [7, 1, 2, 1], (1, 0): [7, 2, 2.5, 4]}


def test_placeholder_slots(spark):
    tokens = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [3.0, 4.0])], "entity_id int, pos int, emb array<double>")
    found = spark.createDataFrame([(1, 0, 0, 0)], "entity_id int, slot int, s int, e int")
    got = sorted((r["entity_id"], r["emb"]) for r in extract.span_vectors(found, tokens, compat=True, dims=2).collect())
    assert got == [(1, [1.0, 2.0]), (2, [0.0, 0.0])]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('Italy Y "q" AT&T Été naïve x ß i̇ \x1cz', "italy y q ATandT ete naive x ii z"),
        ("日本 Tokyo　(x)", "Tokyo (x)"), ("", ""), ("  \n ", ""), (None, None),
    ],
)
def test_normaliser(spark, raw, want):
    once = T.normalize(F.col("t"))
    row = spark.createDataFrame([(raw,)], "t string").select(once.alias("t")).select("t", T.normalize(F.col("t")).alias("again")).first()
    assert row["t"] == want and row["again"] == want


def test_parsers(spark):
    def of(*rows):
        return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "line long, value string")

    assert [tuple(r) for r in lines.parse_triples(of(" a\tr\tb ", "a\tr", "a\tr\tb\tc", "")).collect()] == [("a", "r", "b")]
    assert {r[0]: r[1] for r in lines.parse_descriptions(of("Q1\told", "Q2\t", "Q1\tnew\tmore")).collect()} == {"Q1": "new"}
    assert {r[0]: r[1] for r in lines.parse_lists(of("Q1\ta\tb", "Q1\tc"), append=True).collect()} == {"Q1": ["a", "b", "c"]}
    assert {r[0]: r[1] for r in lines.parse_lists(of("Q1\ta\tb", "Q1\tc")).collect()} == {"Q1": ["c"]}
    with pytest.raises(Exception, match="three fields"):
        lines.parse_triples(of("a\tb"), strict=True).collect()


def test_graph_folder(spark, tmp_path, toy):
    g = lines.Graph(spark, f"file://{tmp_path}")
    g.put("triples_train", toy[0])
    assert g.table("triples_train").count() == len(TRIPLES)
    assert len(g.missing()) == len(g.NAMES) - 1
    assert lines.read_or_make(spark, g.path("descriptions"), lambda: toy[1]).count() == len(TEXTS)


def test_minimised_graph_is_closed(toy):
    triples, descriptions, aliases = toy
    relations = triples.select(F.col("r").alias("relation_id")).distinct()
    cut = minimize.minimize(triples, aliases, relations, descriptions, minimize.sample_heads(triples, 0.4))
    ends = {r[0] for r in cut["triples"].select("h").union(cut["triples"].select("t")).collect()}
    assert ends == {r["entity_id"] for r in cut["aliases"].collect()}
    assert {r["r"] for r in cut["triples"].collect()} == {r["relation_id"] for r in cut["relations"].collect()}
    with pytest.raises(ValueError):
        minimize.sample_heads(triples, 0)


def test_embedding_training(spark, toy):
    e, r = transe.id_maps(toy[0])
    enc = transe.encode(toy[0], e, r)
    neg = transe.negatives(enc, 5).collect()
    assert all((x["h_idx"] == x["nh_idx"]) or (x["t_idx"] == x["nt_idx"]) for x in neg)
    entities, relations = transe.train(enc, e, r, e.count(), r.count(), dims=4, epochs=2)
    assert relations.count() == 5
    assert all(math.isclose(math.hypot(*x["emb"]), 1, rel_tol=1e-9) for x in entities.collect())


def test_encoders(spark, toy):
    got = encode.description_embeddings(toy[1], encode.hash_encoder(6)).collect()
    assert len(got) == len(TEXTS) and all(len(r["emb"]) == 6 for r in got)
    rel = spark.createDataFrame([("R1", ["is from", "born in"]), ("R2", [])], "relation_id string, aliases array<string>")
    assert encode.relation_embeddings(rel, encode.hash_encoder(6)).count() == 2
    assert encode.token_embeddings(toy[1], encode.hash_encoder(6)).where("entity_id = 'Q4'").count() == 6


def test_streamed_triples(spark, tmp_path):
    from triplewright.streaming import stream_triples

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a\tr\tb\nbad\n")
    q = stream_triples(spark, f"file://{tmp_path}/in").writeStream.format("memory").queryName("streamed").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("streamed").collect()] == [("a", "r", "b")]


def test_places_in_a_wide_table(spark):
    """Every row of two million keeps its place, other columns with it: ranges are planned once."""
    wide = spark.range(2_000_000, numPartitions=7).select((F.col("id") * 7_919 % 2_000_003).alias("k"), F.md5(F.col("id").cast("string")).alias("a"), F.xxhash64("id").alias("b"), F.lit("x" * 20).alias("c"))
    got = ordering.ranked(wide, "k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("idx").alias("d"), F.min("idx"), F.max("idx"), F.sum(F.col("b") % 1_000_003).alias("b")).first()
    assert tuple(got)[:4] == (2_000_000, 2_000_000, 0, 1_999_999) and got["b"] == wide.agg(F.sum(F.col("b") % 1_000_003)).first()[0]
    pieces = ordering.chunked(wide, "k", 7).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("chunk").collect()
    assert [r["n"] for r in pieces] == [285_715] * 6 + [285_710]
    assert all(a["hi"] < b["lo"] for a, b in zip(pieces, pieces[1:]))


def test_chunks_of_ties_and_of_nothing(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)], "k int, chunk_no int")
    assert sorted(r["count"] for r in ordering.chunked(df, "k", 3).groupBy("chunk").count().collect()) == [2, 4, 4]
    assert ordering.chunked(df.limit(0), "k", 3).count() == 0 == ordering.ranked(df.limit(0), "chunk_no").count()


@pytest.mark.parametrize("n", [1, 2, 50, 499, 1500, 5000])
def test_first_by_hash_equals_a_full_sort(spark, monkeypatch, n):
    monkeypatch.setattr(minimize, "BORDER_ROWS", 3)
    rows = [(f"h{i % 40}", "r", f"t{i % 300}") for i in range(1500)]
    df = spark.createDataFrame(rows, "h string, r string, t string")
    want = {x for _, x in sorted((hashlib.md5("#".join((*x, "5")).encode()).hexdigest(), x) for x in rows)[:n]}
    assert {tuple(r) for r in minimize.first_by_hash(df, ["h", "r", "t"], n, 5).collect()} == want


def test_a_stopped_training_goes_on(spark, toy, tmp_path):
    e, r = transe.id_maps(toy[0])
    enc = transe.encode(toy[0], e, r)

    def run(folder, **options):
        got = transe.train(enc, e, r, e.count(), r.count(), dims=4, epochs=3, steps=2, rate=0.05, folder=f"file://{tmp_path}/{folder}", **options)
        return [sorted((x["idx"], x["emb"]) for x in df.collect()) for df in got]

    whole = run("one")
    first = run("two", until=1)
    assert first != whole and run("two") == whole
    ids = spark.createDataFrame([(f"R{k}", k) for k in range(5)], "relation_id string, idx long")
    saved = transe.save_relations(spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "idx long, emb array<double>"), ids, f"file://{tmp_path}/saved")
    assert dict(saved.dtypes)["emb"] == "array<float>" and saved.count() == 5


def test_heads_go_on_from_a_checkpoint(spark, tmp_path):
    tokens = spark.createDataFrame([(i, p, [float(i), float(p % 3), 1.0]) for i in range(4) for p in range(6)], "entity_id int, pos int, emb array<double>")
    labels = spark.createDataFrame([(i, "h_s", i) for i in range(4)] + [(0, "t_e", 5)], "entity_id int, kind string, pos int")

    def run(folder, epochs):
        return sorted(tuple(r) for r in training.train_heads(tokens, labels, 3, f"file://{tmp_path}/{folder}", epochs=epochs, rate=0.1).collect())

    whole = run("one", 3)
    run("two", 1)
    assert run("two", 3) == whole and len(whole) == 8


def test_strict_gold_names_an_entity_without_aliases(spark, toy):
    triples, descriptions, aliases = toy
    assert spans.strict_gold_triples(triples, descriptions, aliases).count() == len(GOLD)
    with pytest.raises(Exception, match="no aliases: Q2"):
        spans.strict_gold_triples(triples, descriptions, aliases.where("entity_id <> 'Q2'")).collect()


def test_spans_at_borders(spark):
    cases = [
        ("a1", "aa aa aa aa x", ["aa aa"], [("aa aa", 0, 5, 0, 1), ("aa aa", 6, 11, 2, 3)]),
        ("a2", "(x) a.b x.", [".", "x", "a.b", "(x)"], [("x", 1, 2, 1, 1), ("a.b", 4, 7, 3, 5), ("x", 8, 9, 6, 6), ("(x)", 0, 3, 0, 2)]),
        ("a3", "x" + " y" * 200 + " x", ["x", "", "zz"], [("x", 0, 1, 0, 0)]),
        ("a4", "don't do", ["don", "don't", "'t", "t"], [("don", 0, 3, 0, 0), ("don't", 0, 5, 0, 2), ("t", 4, 5, 2, 2)]),
        ("a5", "", ["x"], []),
    ]
    descriptions = spark.createDataFrame([(i, t) for i, t, _, _ in cases], "entity_id string, text string")
    aliases = spark.createDataFrame([(i, a) for i, _, a, _ in cases], "entity_id string, aliases array<string>")
    pairs = descriptions.select(F.col("entity_id").alias("h"), F.col("entity_id").alias("entity"))
    got = {(r["h"], r["alias"], r["start"], r["end"], r["s"], r["e"]) for r in spans.alias_spans(pairs, descriptions, aliases).collect()}
    assert got == {(i, *x) for i, _, _, found in cases for x in found}
    literal = descriptions.join(aliases, "entity_id").select("entity_id", "text", F.explode("aliases").alias("alias"))
    rows = literal.select("entity_id", "alias", F.explode(T.literal_spans(F.col("text"), F.col("alias"))).alias("x")).collect()
    assert {(r["entity_id"], r["alias"], r["x"]["start"], r["x"]["end"]) for r in rows if r["x"]["start"] < 300} == {x[:4] for x in got}
    assert spans.alias_spans(pairs, descriptions, aliases.limit(0)).count() == 0


def test_tables_of_a_graph_are_made_once(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\tr\tb\nbad\n")
    (tmp_path / "d.txt").write_text("Q1\tone\nbad\nQ2\ttwo\n")
    g = lines.Graph(spark, f"file://{tmp_path}/g")
    raw = {"triples_train": f"file://{tmp_path}/t.txt", "descriptions": f"file://{tmp_path}/d.txt"}
    assert g.cache_all(raw) == list(raw) and g.cache_all(raw) == []
    assert g.table("triples_train").count() == 1 and g.table("descriptions").count() == 2
    assert [r["entity_id"] for r in lines.parse_descriptions(spark.read.text(raw["descriptions"]).coalesce(1), stop=True).collect()] == ["Q1"]
    one, two = spark.createDataFrame([(1, [0.5])], "k int, emb array<double>"), spark.createDataFrame([(2, [1.5])], "k int, emb array<double>")
    path = f"file://{tmp_path}/w"
    for df, mode, want in ((one, "skip", 1), (two, "skip", 1), (two, "overwrite", 2)):
        assert lines.write_table(lines.vector_table(df), path, mode).first()["k"] == want
    with pytest.raises(Exception, match="(?i)exists"):
        lines.write_table(one, path, "error")
    with pytest.raises(FileNotFoundError):
        g.table("aliases")
    with pytest.raises(KeyError):
        g.table("nothing")
    spans.write_gold_log(g.table("descriptions"), g.table("triples_train"), spark.createDataFrame([], "h string, r string, t string, hs int, he int, ts int, te int"), f"file://{tmp_path}/log")
    assert spark.read.text(f"file://{tmp_path}/log").count() == 8


def test_predictions_without_overlaps(spark):
    df = spark.createDataFrame([(1, 0, 3), (1, 2, 4), (1, 4, 4), (1, 6, 7), (2, 1, 1), (2, 1, 1)], "entity_id int, s int, e int")
    assert sorted(tuple(r) for r in extract.without_overlaps(df).collect()) == [(1, 0, 3), (1, 4, 4), (1, 6, 7), (2, 1, 1)]


def test_many_relations_are_met_without_a_broadcast(spark, monkeypatch):
    means = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "entity_id int, emb array<double>")
    relations = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "relation_id int, emb array<double>")
    few = sorted(map(tuple, extract.likely_relations(means, relations, 2).collect()))
    monkeypatch.setattr(extract, "MOST_RELATIONS", 2)
    assert sorted(map(tuple, extract.likely_relations(means, relations, 2).collect())) == few and len(few) == 6


def test_a_cluster_must_name_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.scratch_dir(Session())
