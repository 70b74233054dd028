"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketspark.llm import decontaminate, hmm, langid, mixing, quality, secrets, simhash, sketches, substrings, warc
from marketspark.session import new_path

PROSE = "the cat sat on the mat and looked at the moon while the dog slept by the fire in the old house near the river"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, doc long, h long, copy int, spans string, keep boolean"
ROWS = [
    (1, PROSE, "en", "a"),
    (1, PROSE, "en", "a"),  # a repeated row
    (2, None, "en", "a"),
    (3, "", "en", None),
    (4, " \t\n ", None, None),
    (None, PROSE, None, "b"),
    (5, LONG, "de", "b"),
    (6, "one", "de", None),
    (7, PROSE, None, "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 9.0, 1, 2, 3, 4, "x", True) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(10, PROSE, 1), (11, None, 1), (12, "", 1), (13, "two words", 1)], "item_id long, text string, doc_id int")


def per_row(docs, items):
    model = langid.fit(docs)
    return {
        "repeats": substrings.find_repeats(docs),
        "fingerprints": sketches.with_next(docs),
        "sketch": sketches.sketch(docs),
        "language": langid.predict(docs, model),
        "quality": quality.classify(docs),
        "simhash": simhash.near_duplicates(docs),
        "secrets": secrets.find_secrets(docs),
        "redact": secrets.redact(docs),
        "score": hmm.score(docs, states=2, rounds=1),
    }


def test_every_row_has_a_result(docs, items):
    for name, made in per_row(docs, items).items():
        rows = made.collect()
        assert len(rows) == len(ROWS), name
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS), name
        assert len(set(made.columns)) == len(made.columns), name


def test_empty_tables(docs, items):
    none = docs.limit(0)
    for name, made in per_row(none, items).items():
        assert made.count() == 0, name
    assert decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, items.limit(0)).count() == len(ROWS)
    assert mixing.mix(none, repeats=2.0).count() == 0


def test_defined_values(docs, items):
    got = {r.doc_id: r for r in substrings.find_repeats(docs).collect()}
    assert (got[7].n_words, got[7].n_removed) == (25, 25)  # document 1 has them earlier
    assert (got[None].n_removed, got[1].n_removed) == (25, 0)  # no id: after all others; one id: not from each other
    assert got[2].n_words == got[3].n_words == got[4].n_words == 0
    language = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert {language[i].lang_pred for i in (2, 3, 4)} == {"und"} and language[2].score == 0.0
    assert language[5].lang_pred == "de" and language[7].lang_pred == "en"
    groups = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {(1, 1), (7, 1), (None, 1), (2, 2), (3, 2), (4, 2)} <= groups
    leaks = decontaminate.find_leaks(docs, items).collect()
    assert sorted((str(r.doc_id), r.item_id, r.edits) for r in leaks) == [("1", 10, 0), ("1", 10, 0), ("7", 10, 0), ("None", 10, 0)]
    kept = {r.doc_id for r in decontaminate.without_leaks(docs, items).collect()}
    assert kept == {2, 3, 4, 5, 6}
    found = {r.doc_id: r for r in quality.classify(docs).collect()}
    assert found[2].score == found[4].score == 0.0 and not found[3].keep
    tokens = {r.doc_id: r.n_tokens for r in hmm.score(docs, states=2, rounds=1).collect()}
    assert (tokens[2], tokens[6], tokens[5]) == (1, 2, 60_001)
    prints = {r.doc_id: r for r in sketches.with_next(docs).filter("doc_id IN (1, 2, 3, 7)").collect()}
    assert prints[2].n_chars == 0 and prints[2].fingerprint == prints[3].fingerprint == "" and prints[2].near_next == 1.0
    assert prints[7].near_next == 1.0  # the row without an id is last and has the same text


def test_mixture_of_odd_rows(docs):
    got = mixing.mix(docs, repeats=2.0).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    n = {r.doc_id: r.n for r in got}
    assert n[5] >= 1 and n[6] >= 1 and n[1] >= 2 and n[None] >= 1  # sources a, b and null all have tokens
    assert "copy" in mixing.mix(docs, repeats=2.0).columns
    wordless = docs.filter("doc_id IN (2, 3, 4)")
    assert mixing.mix(wordless, repeats=2.0).count() == 0


def test_pages(spark):
    big = "x" * 200
    rows = [(1, None, big), (2, "http://a b/\n", big), (2, "u", "small"), (3, "u", None), (None, "u", big), (4, "u", "small"), (5, "u", "é" * 60_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    root = new_path(spark, "test-warc")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(warc.write(pages, root), root).collect()), key=repr)
    assert got == sorted([(1, 200, "response", None), (2, 200, "revisit", 1), (2, 5, "response", None), (3, 0, "response", None), (None, 200, "revisit", 1), (4, 5, "response", None), (5, 120_000, "response", None)], key=repr)
    assert warc.read(warc.write(pages.limit(0), new_path(spark, "test-warc")), root).count() == 0


def test_stages_on_odd_rows(spark, docs, tmp_path, items):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, rows, str(tmp_path))
        assert made.columns == rows.columns or k == len(corpus_pipeline.STAGES) - 1, name
        assert stage(spark, rows.limit(0), str(tmp_path)).count() == 0, name
        if name == "language":
            assert {r.doc_id for r in made.collect()} == {1, 5, 6, 7, None}
            rows = docs.filter("doc_id IN (5, 6)")
            continue
        assert {r.doc_id for r in made.select("doc_id").collect()} == {5, 6}
        rows = made


def test_odd_names_through_all_stages(spark, tmp_path, items):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = {"a.b": F.lit(1), "__text": F.lit("x"), "with blank": F.struct(F.lit(2).alias("in.side")), "spans": F.lit("s"), "c0": F.lit(3), "lang_pred": F.lit("l"), "n": F.lit(4)}
    secret = f"password: hunter2hunter2 {' '.join(f'ord{i}' for i in range(40))}"
    docs = spark.createDataFrame([(1, PROSE, "en", "a"), (2, secret, "en", "a"), (3, secret, "en", "b")], "doc_id long, text string, lang string, source string")
    docs = docs.select(docs.columns[0], F.length("text").alias("n_chars"), *docs.columns[1:], *[v.alias(k) for k, v in odd.items()])
    rows = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stage(spark, rows, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert rows.schema.names == docs.schema.names, name
            assert [f.dataType.simpleString() for f in rows.schema] == [f.dataType.simpleString() for f in docs.schema], name
    (kept,) = {tuple(r[c] for c in docs.columns) for r in rows.collect()}
    told = dict(zip(docs.columns, kept, strict=True))
    assert told["doc_id"] == 2 and "hunter2" not in told["text"] and told["n_chars"] == len(told["text"])
    assert (told["a.b"], told["__text"], told["with blank"], told["spans"], told["c0"], told["lang_pred"], told["n"]) == (1, "x", (2,), "s", 3, "l", 4)
