"""Registered oracles and the pipeline."""

import os
import re

import duckdb

import __spark_entry__ as entry
import corpus_pipeline
from tandem.llm import quality
from tests.llm.conftest import AWKWARD, SF


def test_oracles(spark):
    connection = duckdb.connect()
    for name in ("documents", "pages"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name in ("op2_warc_writer", "op8_jaccard_join"):
        got = entry.queries()[name](spark, SF)
        columns = sorted(got.columns)
        want = connection.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())


#: Where a query has no SQL: the test that compares it with a plain computation.
PLAIN = {
    "op1_quality_classifier": "test_documents.py::held_out_accuracy", "op3_permutation_search": "test_search.py", "op4_benchmark_decontamination": "test_leaks.py",
    "op5_html_extraction": "test_articles.py", "op6_best_fit_packing": "test_documents.py::packing_is_whole", "op7_toxicity": "test_documents.py::held_out_accuracy",
    "op9_suffix_dedup": "test_pairs.py::repeated_strings", "op10_pii_sanitisation": "test_documents.py::plain_matching", "op11_simhash": "test_simhash.py::given_documents",
    "pipeline": "test_pipeline.py::stages_keep",
}


def test_every_query_has_sql_or_a_plain_test():
    here = os.path.dirname(os.path.abspath(__file__))
    llm = {q for q in entry.queries() if re.match(r"op\d+_|pipeline", q)}
    assert llm - set(entry.oracle_sql()) == set(PLAIN)
    for name in PLAIN.values():
        file, _, words = name.partition("::")
        with open(os.path.join(here, file)) as f:
            assert any(words in line for line in f if line.startswith("def test_")), name


def test_near_duplicate_stage_on_awkward_rows(spark):
    """Rows without an id or without words all stay; of linked documents the smallest id stays."""
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long), (None, long), (1, ""), (1, ""), (2, None), (3, " \t"), (5, long), (4, long), (4, long), (6, long + " more"), (7, "short one")]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id bigint, text string, n string, tie int")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    want = [(None, long), (None, long), (1, ""), (1, ""), (2, None), (3, " \t"), (4, long), (7, "short one")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), SF).count() == 0


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_quality_stage_on_awkward_rows(spark, awkward):
    """What stays are the rows whose text scores one half or more, with every column; equal rows stay or go together."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = awkward.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    kept = corpus_pipeline.stored(corpus_pipeline.quality_classifier(spark, docs, SF), "test-quality")
    scores = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r["doc_id"] for r in scores.filter("score >= 0.5").collect()), key=repr)
    assert set(texts(kept)) <= set(texts(docs))
    assert corpus_pipeline.quality_classifier(spark, docs.limit(0), SF).count() == 0


def test_decontamination_stage_on_awkward_rows(spark, awkward):
    """Only documents with a whole test item go, whatever stands around it; rows without an id stay."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 80").orderBy("item_id").first()["text"]
    added = [(50, item), (51, "before it. " + item + " and after"), (52, item.upper()), (53, "plain words " * 300 + item), (None, item), (54, item[: len(item) // 4])]
    docs = awkward.unionByName(spark.createDataFrame(added, "doc_id bigint, text string"), allowMissingColumns=True)
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, SF)
    assert kept.columns == docs.columns
    assert texts(kept) == texts(docs.filter("doc_id IS NULL OR doc_id NOT IN (50, 51, 52, 53)"))
    assert corpus_pipeline.benchmark_decontamination(spark, docs.limit(0), SF).count() == 0


def test_pii_stage_on_awkward_rows(spark, awkward):
    """No row goes; base matches become their kind, also in rows without an id and in repeated ones; nulls stay null."""
    secret = "to bob@example.org or 10.1.2.3"
    docs = awkward.unionByName(spark.createDataFrame([(60, secret), (60, secret), (None, secret), (61, "from 10.1.2.300")], "doc_id bigint, text string"), allowMissingColumns=True)
    clean = corpus_pipeline.stored(corpus_pipeline.pii_sanitisation(spark, docs, SF), "test-pii")
    assert clean.columns == docs.columns
    got = texts(clean)
    hidden = [t for i, t in got if t and "[EMAIL]" in t]
    assert len(hidden) == 3 and all("bob@" not in t and "10.1.2.3" not in t for t in hidden)
    untouched = [(i, t) for i, t in texts(docs) if t is None or "bob@" not in t]
    assert sorted([g for g in got if g[1] is None or "[EMAIL]" not in g[1]], key=repr) == untouched
    assert corpus_pipeline.pii_sanitisation(spark, docs.limit(0), SF).count() == 0


def test_packing_stage_on_awkward_rows(spark, awkward):
    """Every row has its pieces end to end, and the pieces of a sequence leave no gap and do not overlap."""
    packed = corpus_pipeline.stored(corpus_pipeline.best_fit_packing(spark, awkward, SF), "test-packed").collect()
    first = [r["doc_id"] for r in packed if r["piece"] == 0]
    assert sorted(first, key=repr) == sorted((i for i, _ in AWKWARD), key=repr)
    long = sorted((r["piece"], r["start"], r["length"]) for r in packed if r["doc_id"] == 11)
    assert len(long) > 1 and all(a[1] + a[2] == b[1] for a, b in zip(long, long[1:])) and all(n == 4096 for _, _, n in long[:-1])
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        ends = [0, *(a + n for a, n in sorted(places))]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 4096
    assert corpus_pipeline.best_fit_packing(spark, awkward.limit(0), SF).count() == 0


def test_stages_keep_the_columns_and_end_in_sequences(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs.count()
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, SF)
        out = corpus_pipeline.stored(out, "test-stage")
        assert out.columns == docs.columns
        assert (out.count() == left) == (number == 3)
        docs, left = out, out.count()
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == left
