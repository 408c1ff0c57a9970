"""The engine's operators against worked examples and properties."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import legal, rouge
from corvane.functions import text as T
from corvane.operators import corpus, evaluate, retrieve, verify
from corvane.plans import fixtures
from corvane.plans.api import Engine


def passages(spark, rows):
    names = "claim int, rank int, doc_id string, chunk_id string, verdict string, confidence double, p_unsupported double, deterministic boolean, high_flag boolean"
    return spark.createDataFrame([(1, *r, False, False) for r in rows], names)


TWO_DOCKETS = [(1, "case_a", "case_a_c1", "SUPPORTED", 0.95, 0.02), (2, "case_b", "case_b_c1", "CONTRADICTED", 0.95, 0.02)]


def test_bm25_metadata_by_key(spark):
    hits = spark.createDataFrame([(1, "chunk_b", 10.0, 1), (1, "gone", 9.5, 2), (1, "chunk_a", 9.0, 3)], "query int, key string, score double, rank int")
    meta = spark.createDataFrame([("chunk_a", "passage A"), ("chunk_b", "passage B")], "chunk_id string, text string")
    got = [(r.key, r.text, r.rank) for r in retrieve.with_metadata(hits, meta, "chunk_id").orderBy("rank").collect()]
    assert got == [("chunk_b", "passage B", 1), ("chunk_a", "passage A", 3)]


def test_docket_filter_stands_before_top_k(spark):
    vectors = spark.createDataFrame([("other_c0", "other", [0.99]), ("target_c0", "target", [0.90]), ("target_c1", "target", [0.80])], "key string, docket string, v array<float>")
    asked = spark.createDataFrame([(1, "target", [1.0])], "id int, d string, q array<float>")
    got = retrieve.dense_search(asked, vectors, "id", "q", "key", "v", 1, "docket", "d").collect()
    assert [(r.key, r.rank) for r in got] == [("target_c0", 1)]


def test_fusion_order(spark):
    dense = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query int, key string, rank int")
    sparse = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query int, key string, rank int")
    got = retrieve.reciprocal_rank_fusion(dense, sparse).orderBy("rank").collect()
    assert [(r.key, r.rank, r.method) for r in got] == [("b", 1, "hybrid_rrf"), ("a", 2, "hybrid_rrf"), ("c", 3, "hybrid_rrf")]


def test_foreign_docket_cannot_override(spark):
    rows = passages(spark, TWO_DOCKETS)
    for asked in ("case_a", None):
        own = verify.anchored(rows.withColumn("asked", F.lit(asked).cast("string")), "claim", asked="asked")
        assert own.count() == 1
        assert verify.synthesize(own, "claim").first().verdict == "SUPPORTED"


def test_missing_docket_is_unsupported(spark):
    rows = passages(spark, TWO_DOCKETS).withColumn("asked", F.lit("case_missing"))
    claims = spark.createDataFrame([(1,)], "claim int")
    got = verify.with_unmatched(claims, verify.synthesize(verify.anchored(rows, "claim", asked="asked"), "claim"), "claim").first()
    assert (got.verdict, got.confidence, got.evidence_id, got.reason) == ("UNSUPPORTED", 1.0, None, verify.NO_PASSAGE)


def test_trust_example(spark):
    rows = spark.createDataFrame([("SUPPORTED", 0.95), ("CONTRADICTED", 0.92)], "verdict string, confidence double")
    got = verify.trust(rows).first()
    assert (got.trust_score, got.total_claims, got.badge) == (0.015, 2, "LOW TRUST / CONTRADICTED")


def test_legal_examples(spark):
    rows = spark.createDataFrame(fixtures.LEGAL_PAIRS, "id int, claim_text string, text string")
    got = {r.id: (sorted(f.type for f in r.legal_flags), r.deterministic) for r in verify.with_legal_checks(rows).collect()}
    assert got[1] == ([], False)
    assert got[2] == (["PROVISION_MISMATCH"], True)
    assert got[3] == (["CITATION_MISMATCH"], True)
    assert got[5] == ([], False)
    first = rows.select(legal.references(F.col("claim_text"), "dates").alias("d")).first().d
    assert first == ["15th January 2020"]


def test_claims_example(spark):
    text = "The appellant, convicted under Section 302 of the Code, was sentenced to life imprisonment, but was subsequently acquitted by the High Court. Too short."
    rows = T.decompose_claims(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "; and ;")], "id int, t string"), "t", "id").orderBy("id", "claim_index").collect()
    assert [(r.id, r.claim_index, r.claim_text) for r in rows] == [
        (1, 1, "The appellant, convicted under Section 302 of the Code, was sentenced to life imprisonment,."),
        (1, 2, "Was subsequently acquitted by the High Court."),
        (4, 1, "; and ;."),
    ]


GOLDEN = [
    ([[4, 0, 65], [3, 0, 66], [0, 0, 55]], 0.3057, 0.1872, 0.0242, 0.0),
    ([[0, 0, 69], [0, 0, 69], [0, 0, 55]], 0.2850, 0.1478, 0.0, 0.0),
    ([[38, 0, 31], [29, 0, 40], [1, 0, 54]], 0.4767, 0.3849, 0.2419, 0.0),
    ([[23, 8, 38], [5, 42, 22], [0, 16, 39]], 0.5389, 0.5343, 0.0403, 0.6087),
    ([[23, 8, 38], [5, 42, 22], [0, 18, 37]], 0.5285, 0.5247, 0.0403, 0.6087),
    ([[3, 3, 3], [2, 18, 10], [0, 2, 2]], 0.5349, 0.4394, 0.0588, 0.6),
    ([[4, 0, 65], [3, 6, 60], [0, 3, 52]], 0.3212, 0.2358, 0.0242, 0.0870),
]


def test_golden_matrices(spark):
    rows = [(k, t, p) for k, (m, *_) in enumerate(GOLDEN) for t, row in zip(evaluate.LABELS, m, strict=True) for p, n in zip(evaluate.LABELS, row, strict=True) for _ in range(n)]
    pairs = spark.createDataFrame(rows, "system int, t string, p string")
    got = {r.system: r for r in evaluate.metrics(pairs, "system").collect()}
    for k, (_, accuracy, f1, fsr, recall) in enumerate(GOLDEN):
        r = got[k]
        assert (r.accuracy, r.macro_f1, r.fsr, round(r.contradiction_recall, 4)) == (accuracy, f1, fsr, recall)


def test_chunks_cover_and_stay_whole():
    rng = random.Random(3)
    for _ in range(40):
        text = " ".join((rng.choice(["alpha", "Beta", "gamma,", "No.", "v."]) + (rng.choice([".", "", "", "!"]))) for _ in range(rng.randint(0, 900)))
        units, spans = corpus.sentence_units(text), corpus.chunk_spans(text, 120, 30)
        assert [text[a:b].strip() for a, b in spans] == [text[a:b] for a, b in spans]
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(spans, spans[1:], strict=False))
        assert all(any(a <= u[0] and u[1] <= b for a, b in spans) for u in units)
        assert sum(u[2] for u in units) == len(text.split())


def test_sentences_agree_with_chunker(spark):
    text = 'He met Dr. Smith vs. Jones. "Yes!" (Really?) No. 5 stands.  End of it'
    units = [text[a:b] for a, b, _ in corpus.sentence_units(text)]
    got = spark.createDataFrame([(text,)], "t string").select(T.sentences(F.col("t")).alias("s")).first().s
    assert got == units


def test_token_repair(spark):
    words = spark.createDataFrame(fixtures.DICTIONARY, "word string, freq double")
    got = {r.token: (r.status, r.replacement) for r in corpus.resolve_tokens(spark.createDataFrame(fixtures.TOKENS, "token string"), words).collect()}
    assert got["numberdoubt"] == ("two_word", "no doubt")
    assert got["companyered"] == ("single", "covered")
    assert got["Companyntract"] == ("single", "Contract")
    assert got["NUMBERMAL"] == ("single", "NORMAL")
    assert got["company"] == ("unchanged", "company")
    assert got["numberxyzzy"] == ("unresolved", "numberxyzzy")
    assert got["companyrare"][0] == "low_confidence"
    assert got["companyse"] == ("single_listed", "copse")
    broken = spark.createDataFrame(fixtures.BROKEN, "doc_id int, text string")
    assert sorted((r.doc_id, r.text) for r in corpus.repair_texts(broken, "doc_id", "text", words).collect()) == fixtures.MENDED


def test_rouge():
    assert rouge.f1("the cat sat on the mat", "the cat sat on the mat") == 1.0
    assert rouge.f1("a b c d", "a c") == pytest.approx(2 * 2 / 6)
    assert rouge.f1(None, "x") == 0.0


def test_rouge_query_reads_long_documents(spark, tmp_path):
    """A document of any length, with or without n_chars, is scored against the item it holds, whatever the ids."""
    from corvane.plans.catalogue import QUERIES

    item = "the tenant shall repair the northern wall before winter"
    long = item + " filler" * 900
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(2, long, len(long)), (3, item, None), (41, "unrelated", 9)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.item_id, r.f1, r.verdict) for r in QUERIES["rouge_l"](spark, str(tmp_path)).collect()}
    assert got[3] == (1, 1.0, "SUPPORTED") and got[2] == (1, round(2 * 9 / (909 + 9), 6), "UNSUPPORTED")


def test_api_empty_and_modes(spark):
    docs = spark.createDataFrame([("c1", "d1", "the court held the appeal allowed"), ("c2", "d2", "another text entirely")], "chunk_id string, doc_id string, text string")
    engine = Engine(docs)
    got = {r.id: r for r in engine.verify(spark.createDataFrame([(1, "The court held the appeal allowed."), (2, "Short."), (3, "Zzz qqq xxx yyy.")], "id int, t string"), "id", "t").collect()}
    assert (got[1].trust_score, got[1].n_supported) == (0.8, 1)
    assert (got[2].trust_score, got[2].total_claims) == (1.0, 0)
    assert got[3].n_unsupported == 1
    with pytest.raises(ValueError):
        engine.search(docs, mode="other")


def test_entry_and_catalogue(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streamed_claims(spark, tmp_path):
    from corvane import streaming

    docs = spark.createDataFrame([("d1", "alpha beta"), ("d2", "gamma delta"), ("d3", "other words")], "doc_id string, text string")
    index = retrieve.bm25_index(docs, "doc_id", "text")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"claim_id": "x", "claim_text": "Alpha beta", "ts": "2024-01-01T00:00:00Z"}\n')
    query = streaming.stream_scores(streaming.claims_stream(spark, str(tmp_path / "in")), index).writeStream.format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.key, r.term) for r in spark.sql("SELECT * FROM scores").collect()} == {("d1", "alpha"), ("d1", "beta")}


def test_resumed_shards(spark, tmp_path):
    from corvane.sources import sinks

    path = str(tmp_path / "t")
    sinks.resume_shards(spark.createDataFrame([(0, "a"), (1, "b")], "shard int, x string"), path, "shard")
    got = sinks.resume_shards(spark.createDataFrame([(1, "again"), (2, "c")], "shard int, x string"), path, "shard")
    assert sorted((r.shard, r.x) for r in got.collect()) == [(0, "a"), (1, "b"), (2, "c")]


def test_numbered_is_right_at_any_size(spark):
    """Far more rows than a range sample holds, with a payload that one side of a self join doesn't need."""
    rows = spark.range(1_000_000).selectExpr("(id * 7919) % 1000003 AS k", "repeat('x', 40) AS payload")
    placed = evaluate.numbered(rows, "k")
    want = rows.select("k").rdd.map(lambda r: r.k).collect()
    assert placed.where(F.length("payload") < 40).count() == 0
    got = placed.select("k", "pos").toPandas().sort_values("pos")
    assert got["k"].tolist() == sorted(want) and got["pos"].tolist() == list(range(1_000_000))


def test_rotation_is_right_at_any_size(spark):
    rows = spark.range(300_000).selectExpr("id AS k", "cast(id AS string) AS e")
    wrong = evaluate.rotate_evidence(rows, "k", "e").where("other_k <> (k + 45) % 300000 OR rotated <> cast(other_k AS string)")
    assert wrong.count() == 0


@pytest.mark.parametrize("rows", [1 << 21, 100])
def test_block_search_equals_scoring_all(spark, monkeypatch, rows):
    monkeypatch.setattr(retrieve, "ASKED_ROWS", rows)
    monkeypatch.setattr(retrieve, "BLOCK_POSTINGS", 50 * rows)
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(60_000)]
    docs = spark.createDataFrame([(i, " ".join(words[i * 30 : i * 30 + rng.randint(1, 60)])) for i in range(1500)], "key long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(120)] + [(900, "nothing known"), (901, ""), (902, None)], "q long, text string")
    index = retrieve.bm25_index(docs, "key", "text")
    all_ = retrieve.top_k(retrieve.bm25_scores(index, asked, "q", "text"), "query", "key", 5)
    got = retrieve.bm25_search(index, asked, "q", "text", 5)
    assert sorted(map(tuple, got.select("query", "key", "score", "rank").collect())) == sorted(map(tuple, all_.select("query", "key", "score", "rank").collect()))


def shuffled_rows(spark) -> int:
    """Rows that all stages so far have written to shuffles."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_search_prunes_exactly_and_deals_no_query_to_every_block(spark, monkeypatch):
    """With many blocks, what is dealt is each block's best of a query, not the query's terms; rows that share a key are one document."""
    monkeypatch.setattr(retrieve, "FEW", 0, raising=False)
    monkeypatch.setattr(retrieve, "SEEDS", 7, raising=False)
    monkeypatch.setattr(retrieve, "BLOCK_POSTINGS", 500)
    rng = random.Random(11)
    words = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(40_000)]
    docs = spark.createDataFrame([(i % 990, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(1000)], "key long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=20))) for i in range(300)], "q long, text string")
    index = retrieve.bm25_index(docs, "key", "text")
    want = retrieve.top_k(retrieve.bm25_scores(index, asked, "q", "text"), "query", "key", 1).select("query", "key", "score", "rank").collect()
    before = shuffled_rows(spark)
    got = retrieve.bm25_search(index, asked, "q", "text", 1).select("query", "key", "score", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert shuffled_rows(spark) - before < 60_000  # 94,000 when every block was dealt the terms


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "alpha beta"), ("d2", "gamma delta"), ("d3", "other words")], "doc_id string, text string")
    retrieve.bm25_index(docs, "doc_id", "text").save(str(tmp_path / "index"))
    index = retrieve.Bm25Index.load(spark, str(tmp_path / "index"), 3)
    asked = spark.createDataFrame([(1, "Gamma")], "q int, t string")
    assert [(r.key, r.rank) for r in retrieve.bm25_search(index, asked, "q", "t").collect()] == [("d2", 1)]
    with pytest.raises(ValueError):
        retrieve.Bm25Index.load(spark, str(tmp_path / "index"), 4)


def test_dense_blocks_equal_one_broadcast(spark, monkeypatch):
    vectors = spark.range(60).selectExpr("id", "transform(sequence(1, 8), x -> cast(sin(id * x) AS float)) AS v")
    want = sorted(map(tuple, retrieve.dense_search(vectors, vectors, "id", "v", "id", "v", 3).collect()))
    monkeypatch.setattr(retrieve, "BROADCAST_BYTES", 1000)
    assert sorted(map(tuple, retrieve.dense_search(vectors, vectors, "id", "v", "id", "v", 3).collect())) == want


def test_stemmer():
    known = {"ponies": "poni", "ties": "tie", "agreed": "agre", "motoring": "motor", "troubled": "troubl", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "sensibiliti": "sensibl", "electrical": "electr", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controll": "control"}
    assert {w: rouge.stem(w) for w in known} == known


def test_chunk_ends_and_overlaps():
    text = " ".join(f"S{i} " + "w " * 38 + "end." for i in range(40))  # 40 sentences of 40 words
    spans = corpus.chunk_spans(text)
    assert [len(text[a:b].split()) for a, b in spans] == [360] * 4 + [320]  # 9 units are nearer to 350 than 8; one unit of 40 is the nearest to 50
    assert [text[a : a + 3].strip() for a, _ in spans] == ["S0", "S8", "S16", "S24", "S32"]
    long = " ".join(["word"] * 130 + ["cut,"] + ["word"] * 90)
    assert [n for *_, n in corpus.sentence_units(long)] == [100, 100, 21]
    assert [n for *_, n in corpus.sentence_units(" ".join(["word"] * 59 + ["cut,"] + ["word"] * 60))] == [60, 60]


def test_contexts(spark):
    from corvane.operators import audit

    text = "alpha beta gamma the total number of cases delta epsilon zeta"
    at = text.index("number")
    row = spark.createDataFrame([(text, at, at + 6)], "t string, a int, b int").select(
        audit.word_context(F.col("t"), F.col("a"), F.col("b"), 2).alias("w"), audit.char_context(F.col("t"), F.col("a"), F.col("b"), 8).alias("c"),
        audit.char_context(F.col("t"), F.col("a"), F.col("b"), 500).alias("all"), audit.standalone_number_count(F.col("t")).alias("n"),
    ).first()
    assert row.w == "the total [number] of cases" and row.c == "the total number of cases" and row.all == text and row.n == 0
    rights = spark.createDataFrame([(" 5 of",), (" xvi.",), ("\n. 12",), (" mind",), (" ixe",), (None,)], "r string")
    assert [r.x for r in rights.select(audit.third_rule(F.col("r")).alias("x")).collect()] == [True, True, True, False, False, False]
    samples, blind = spark.createDataFrame([(1, 5), (2, 6)], "a int, b int"), spark.createDataFrame([(2, 6), (2, 6)], "a int, b int")
    assert [tuple(r) for r in audit.not_blind(samples, blind, "a", "b").collect()] == [(1, 5)]


def test_search_lists_a_document_once_and_scores_as_the_relational_plan(spark):
    """A document that holds several of a query's few terms is one hit; common terms, added up as rows of numbers, score as rare ones."""
    rng = random.Random(5)
    words = ["the", "of", "rent", "court", *[f"w{i}" for i in range(60)]]
    docs = [(i, " ".join(rng.choices(words, [30, 20, 9, 4, *[1] * 60], k=rng.randint(3, 40)))) for i in range(300)] + [(900, "solely unheard words")]
    corpus_ = spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame([(i, " ".join(rng.choices(words, k=6))) for i in range(40)] + [(99, "unheard words"), (98, "the of"), (97, "the w3 the")], "q long, text string")
    index = retrieve.bm25_index(corpus_, "doc_id", "text")
    hits = [(r.query, r.key, r.score, r["rank"]) for r in retrieve.bm25_search(index, queries, "q", "text", 5).collect()]
    want = [(r.query, r.key, r.score, r["rank"]) for r in retrieve.top_k(retrieve.bm25_scores(index, queries, "q", "text"), "query", "key", 5).collect()]
    assert [h[:2] for h in hits if h[0] == 99] == [(99, 900)]
    assert sorted(hits) == sorted(want)


def test_references_are_read_where_the_claim_has_some(spark):
    rows = spark.createDataFrame([("relief under Section 302", "Section 420 and AIR 1999 SC 12"), ("no reference", "Section 420"), ("AIR 1999 SC 12", "(2001) 3 SCC 44")], "c string, t string")
    read = rows.select(legal.entities(F.col("t"), legal.entities(F.col("c"))).alias("e")).select("e.*").collect()
    assert [(r.provisions, r.citations) for r in read] == [(["Section 420"], []), ([], []), ([], ["(2001) 3 SCC 44"])]


def test_third_rule_bounds_words_as_its_sql(spark):
    """A numeral ends before a letter beyond ASCII, and blanks are those of the SQL's patterns."""
    import duckdb

    from corvane.operators import audit

    rights = ["Vi\u00e8 euxquepa", "vi\u00e8", "x\u00e9", "ix_", "xx", " \u00e9i", "\x0b5", "\t\n\f\r 5", "\u00a05", ".\x0b5", "i"]
    mine = [r.x for r in spark.createDataFrame([(r,) for r in rights], "r string").select(audit.third_rule(F.col("r")).alias("x")).collect()]
    assert mine == [duckdb.execute("SELECT regexp_matches(?, ?)", [r, audit._THIRD]).fetchone()[0] for r in rights]
    assert mine[:3] == [True, True, True]


TRIPLES = [
    ("e1", "the court allowed the appeal of the tenant", "In this case the court allowed the appeal of the tenant and more.", "SUP", "factual_holding"),
    ("e2", "relief under Section 302 of the Code", "relief under Section 420 of the Code", "CON", "legal_citation"),
    ("e3", "the tenant paid the rent in full", "weather was fine that day everywhere", "NEI", "procedural_history"),
    ("e4", "a second plain claim about rent", "a second plain claim about rent and its terms", "SUP", "factual_holding"),
]


def test_experiments(spark):
    from corvane.operators import experiments

    triples = spark.createDataFrame(TRIPLES, "example_id string, claim string, evidence string, gold_label string, claim_type string")
    judged = experiments.verdicts(triples)
    got = {r.example_id: r for r in judged.collect()}
    assert (got["e1"].rouge, got["e1"].bm25, got["e1"].model) == ("SUPPORTED", "UNSUPPORTED", "SUPPORTED") and got["e3"].model == "UNSUPPORTED" and got["e2"].deterministic
    grid = {r.system: r for r in evaluate.metrics(experiments.legal_check_grid(judged), "system").collect()}
    assert set(grid) == {"model", "model_checked", "model_references", "model_checked_references"} and grid["model_references"].n == 1
    assert (grid["model"].accuracy, grid["model_checked"].accuracy, grid["model_checked"].contradiction_recall) == (0.75, 1.0, 1.0)
    assert {r.system for r in evaluate.metrics(experiments.ablations(judged), "system").collect()} == {"full", "no_checks", "no_model", "rouge_only"}
    rows = experiments.degraded(triples, by=2)
    assert {(r.example_id, r.evidence) for r in rows.where("condition = 'rotated'").collect()} == {("e1", TRIPLES[2][2]), ("e4", TRIPLES[3][2])}
    shares = {r.condition: r for r in experiments.robustness(experiments.verdicts(rows)).collect()}
    assert shares["gold"].supported == 1.0 and shares["empty"].supported == 0.0 and shares["rotated"].passes_safety is False and shares["gold"].passes_safety is None
    report = {r.system: r.report for r in experiments.metrics_report(experiments.baselines(judged)).collect()}
    assert "**Accuracy**: `75.00%`" in report["model"] and "| **SUPPORTED** | 0.6667 | 1.0000 | 0.8000 | 2 |" in report["model"] and "True_CON 1" in report["model"]


def test_encoder(spark):
    from corvane.operators import encode

    rows = spark.createDataFrame([(1, "alpha beta alpha"), (2, "ALPHA alpha beta"), (3, ""), (4, None)], "id int, t string")
    got = {r.id: r.vector for r in encode.encode(rows, "t").collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-9 and got[3] == got[4] == [0.0] * 64


def test_decompose_falls_back_to_rules(spark):
    rows = spark.createDataFrame([(1, "One plain claim here."), (2, "Another plain claim here.")], "id int, t string")
    ask = lambda df: df.withColumn("reply", F.when(F.col("id") == 1, '```json\n["A claim by the model.", "And one more."]\n```').otherwise("no list"))
    got = sorted((r.id, r.claim_index, r.claim_text, r.method) for r in T.decompose(rows, "t", "id", method="llm", ask=ask).collect())
    assert got == [(1, 1, "A claim by the model.", "llm"), (1, 2, "And one more.", "llm"), (2, 1, "Another plain claim here.", "rule_based")]
    for method, asked in (("auto", None), ("rule_based", ask), ("unknown", ask)):
        assert {r.method for r in T.decompose(rows, "t", "id", method=method, ask=asked).collect()} == {"rule_based"}


def test_small_readers_and_writers(spark, tmp_path):
    from corvane import sources
    from corvane.sources import sinks

    assert sources.prompt("Claims of: {input_text}", "x") == "Claims of: x"
    rows = spark.createDataFrame([(1, None), (2, "5")], "id int, label string")
    assert [r.label for r in sources.with_label(rows).orderBy("id").collect()] == [-1, 5]
    assert sources.present(rows, "label", "other").columns == ["label"]
    sinks.json_document(rows, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '[{"id":1},{"id":2,"label":"5"}]'


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from corvane.sources import store

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        store.shared_dir(session)
