import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framesift.llm import decontam, simhash
from framesift.llm.entry import ORACLE_SQL, QUERIES
from tests.oracle import rows_of, sql_rows

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).cache())
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert all(a >= b for a, b in zip(ids, ids[1:]))
    assert all(d.columns == docs.columns for d in kept[1:-1])
    leaders = {r.component_id for r in simhash.near_duplicates(kept[1]).collect()}
    assert ids[2] == leaders
    leaked = {r.doc_id for r in decontam.contaminated(kept[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids[3] == ids[2] - leaked
    assert not kept[4].filter("text LIKE '%token = \"%' AND NOT text LIKE '%[SECRET]%'").count()
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(kept[5].collect())


def test_queries_with_sql(spark):
    for name, sql in ORACLE_SQL.items():
        assert rows_of(QUERIES[name], spark, SF) == sql_rows(sql, SF), name


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ENGLISH = "the quick brown fox jumps over the lazy dog and runs away from here to there number "


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with a benchmark of one item and rows that nothing was made for."""
    at = str(tmp_path_factory.mktemp("tables"))
    items = [(1, "seven gray owls quietly watched eleven brown mice near the old stone mill"), (2, None), (None, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    rows = [(i, ENGLISH + str(i) + " and " + "abcdefghijklmnopqrstuvwxyz"[i % 26] * 5 + " " + ENGLISH[i:] * 3, "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(i, f"der schnelle braune fuchs springt {i} mal über den faulen hund und läuft dann weit weg " * 3, "de", None, 1) for i in range(40, 70)]
    rows += [
        (100, None, "en", "s0", None), (101, "", None, None, 0), (102, " \n ", "en", "s1", 3), (103, rows[3][1], "en", "s2", 1), (104, rows[3][1], "en", "s2", 1), (104, rows[3][1], "en", "s2", 1),
        (105, ENGLISH + "So " + items[0][1] + " at dusk " + ENGLISH, "en", "s1", 1), (106, ENGLISH + 'password = "abcdef123456" ' + ENGLISH[::-1], "en", "s1", 1), (None, ENGLISH + "without any id " + ENGLISH[5:], "en", "s1", 1),
        (107, ENGLISH * 3000 + "x" * 50000, "en", "s1", 1), (108, "12345 !!! 678", "en", "s1", 1),
    ]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    return at


def test_stages_on_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("fp", F.lit(1)).withColumn("kind", F.lit("x"))
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    every = ids(docs)
    by_name = dict(corpus_pipeline.STAGES)
    kept = by_name["language_id"](spark, docs, folder)
    assert {100, 101, 102, 108}.isdisjoint(ids(kept)) and kept.columns == list(corpus_pipeline.COLUMNS) and {3, 45, 104, None} <= set(ids(kept))
    kept = by_name["near_dedup"](spark, docs, folder)
    assert {101, 102, 103, 104}.isdisjoint(ids(kept)) and {3, 100, None} <= set(ids(kept)) and kept.columns == list(corpus_pipeline.COLUMNS)
    kept = by_name["decontamination"](spark, docs, folder)
    assert ids(kept) == sorted((i for i in every if i != 105), key=str)
    kept = by_name["secret_scan"](spark, docs, folder)
    rows = {r.doc_id: r for r in kept.collect()}
    assert ids(kept) == every and rows[100].text is None and rows[100].n_chars is None and "abcdef123456" not in rows[106].text
    assert rows[106].n_chars == len(rows[106].text) and rows[101].text == ""
    assert ids(by_name["mixing"](spark, docs, folder)) == every
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == [], name


def test_whole_run_on_odd_rows(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    found = {r.doc_id for r in rows}
    assert {100, 101, 102, 103, 104, 105, 108}.isdisjoint(found) and {0, 3, 45, None} <= found
    assert all(r.taken <= 3 * r.size for r in rows)
