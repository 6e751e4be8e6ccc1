"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest

from framesift.llm import decontam, langid, mixing, pii, quality, rules, secrets, simhash, substrings, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, spans string, score double, kept boolean, fp long, start int, component string, h long"
LONG = "word " * 60000 + "a" * 100000 + "\n" * 5000 + "1 2-" * 5000


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \n\t ", "one", "two words", LONG, LONG, "Straße é ñ 你好 \U0001f600 token = \"abcdef123456\"", "same text here again", "same text here again", "!!! ??? 123"]
    rows = [(i, t, "en" if i % 3 else None, "s1" if i % 2 else None, 5) for i, t in enumerate(texts)] + [(3, "one", "en", "s1", 3), (None, "null id", None, None, None)]
    return spark.createDataFrame([r + (1, 2.0, "x", 0.5, True, 7, 1, "c", 9) for r in rows], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (5, 0, 0), (7, 1, None), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "simhash": lambda spark, d: simhash.near_duplicates(d),
    "quality": lambda spark, d: quality.score(d, quality.train(d, labels(spark))),
    "secrets": lambda spark, d: secrets.scan(d, secrets.train(d)),
    "redact": lambda spark, d: secrets.redact(d, secrets.train(d)),
    "mixing": lambda spark, d: mixing.mix_sources(d),
    "rules": lambda spark, d: rules.apply_rules(d, labels(spark)),
    "langid": lambda spark, d: langid.identify(d, langid.train(d)),
    "pii": lambda spark, d: pii.personal_data(d),
    "substrings": lambda spark, d: substrings.remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(spark, docs, name):
    rows = OPERATORS[name](spark, docs).collect()
    assert len(rows) == docs.count()
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    again = OPERATORS[name](spark, docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](spark, docs.limit(0)).collect() == []


def test_accepted_edges(spark, docs):
    model = langid.train(docs)
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns
    told = langid.identify(docs, model).filter("accepted")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in told.collect())
    assert langid.accepted(docs.limit(0), model).collect() == [] and langid.accepted(docs, None).collect() == []


def test_tokens_edges(spark, docs):
    rows = tokens.count_tokens(docs).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(r.n_tokens == 0 for r in rows if r.doc_id in (0, 1))
    assert tokens.count_tokens(docs.limit(0)).collect() == []


def test_contaminated_edges(spark, docs):
    items = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "same text here again", 3), (None, "x", 3)], "item_id long, text string, distance int")
    found = decontam.contaminated(docs, items)
    assert sorted((r.doc_id, r.item_id, r.distance) for r in found.collect()) == [(8, 3, 0), (9, 3, 0)]
    assert decontam.contaminated(docs.limit(0), items).collect() == []
    assert decontam.contaminated(docs, items.limit(0)).collect() == []


def test_parts_beside_the_operators(spark, docs):
    """Base spans alone, the base rule's counts, and tokens of given fields, on the same rows."""
    spans = secrets.scan(docs).collect()
    assert len(spans) == docs.count() and all(r.n_added == 0 for r in spans) and {r.doc_id: r.n_assign for r in spans}[7] == 1
    assert all(r.spans == "" for r in spans if r.doc_id in (0, 1, 2)) and secrets.scan(docs.limit(0)).collect() == []
    counts = rules.text_statistics(docs).collect()
    assert len(counts) == docs.count() and {r.doc_id: r.n_words for r in counts}[2] == 0 and rules.text_statistics(docs.limit(0)).collect() == []
    fields = tokens.with_fields(docs, "doc_id", ["source", "text"])
    rows = tokens.count_tokens(fields, sections_col="sections", rule="largest").filter("section >= 0").collect()
    assert len(rows) == 2 * docs.count() and {r.name for r in rows} == {"source", "text"}
    assert all(r.n_tokens == 0 for r in rows if r.name == "text" and r.doc_id in (0, 1))
    assert tokens.count_tokens(fields.limit(0), sections_col="sections", rule="largest").collect() == []
