"""Every operator on odd tables: repeated rows, extra columns with the operators' own names, no rows."""

import pytest

from seriesloom.llm import decontaminate, jaccard, licenses, pieces, pii, quality, suffix_dedup, token_counts, toxicity

from .fixtures import ODD, SF, documents, empty

#: Names that operators, or their tables in between, give to columns of their own.
NAMES = "id row_id item item_id text_hash size rep bits gram pos at runs lead_id a b m k c y x u s n n_words n_tokens n_docs score n_hits held_out predicted spans masked kept content_share labels n_spans n_removed ids nbest_ids scores round_trip component_id n_shingles n_links block value".split()


def clashing(df):
    return df.selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source", "0L AS n_chars", *(f"'own' AS {n}" for n in NAMES))


@pytest.fixture(scope="module")
def models(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return {"toxicity": toxicity.fit(docs, labels), "pii": pii.fit(docs), "quality": quality.fit(docs, labels), "benchmark": spark.read.parquet(f"{SF}/benchmark.parquet")}


#: Results by document; a repeated row has a repeated result, but for decontamination, whose result is one row a document and item.
BY_ROW = {
    "toxicity": lambda d, m: toxicity.score(d, m["toxicity"]),
    "pieces": lambda d, m: pieces.encode(d, all_ids=True),
    "pii": lambda d, m: pii.personal_data(d, m["pii"]),
    "quality": lambda d, m: quality.quality(d, m["quality"]),
    "licenses": lambda d, m: licenses.license_scan(d),
    "lengths": lambda d, m: token_counts.document_lengths(d),
}
STAGES = {
    "toxicity": lambda d, m: toxicity.keep_clean(d, m["toxicity"]),
    "decontamination": lambda d, m: decontaminate.keep_clean(d, m["benchmark"]),
    "pii": lambda d, m: pii.masked(d, m["pii"]),
    "jaccard": lambda d, m: jaccard.one_of_each(d),
}
ROWS = [*documents(60), *ODD, (None, "a row without id"), (None, None)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def told(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", BY_ROW)
def test_rows_repeat_and_names_clash(spark, models, name):
    run = BY_ROW[name]
    once = told(run(table(spark, ROWS), models))
    assert len(once) == len(ROWS)
    assert told(run(clashing(table(spark, ROWS + ROWS)), models)) == sorted(once + once)
    assert run(clashing(empty(spark)), models).count() == 0


def test_decontamination_of_repeated_rows(spark, models):
    once = told(decontaminate.contaminated(table(spark, ROWS), models["benchmark"]))
    again = told(decontaminate.contaminated(clashing(table(spark, ROWS + ROWS)), models["benchmark"].selectExpr("*", "'own' AS id", "'own' AS item", "'own' AS doc_id")))
    assert sorted(set(again)) == sorted(set(once)) and once


def test_suffix_dedup_names_clash(spark):
    rows = [(k, f"{'lorem ipsum dolor sit amet ' * 30} {k}") for k in range(4)] + [r for r in ROWS if len(r[1] or "") < 1000]
    once = told(suffix_dedup.remove_repeats(table(spark, rows)))
    assert len(once) == len(rows) and told(suffix_dedup.remove_repeats(clashing(table(spark, rows)))) == once
    assert suffix_dedup.remove_repeats(clashing(empty(spark))).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_all_columns(spark, models, name):
    run = STAGES[name]
    odd = clashing(table(spark, ROWS + ROWS[:5]))
    got = run(odd, models)
    assert got.columns == odd.columns and got.dtypes == odd.dtypes
    kept = got.collect()
    plain = run(table(spark, ROWS + ROWS[:5]).selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source", "0L AS n_chars"), models).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(r.doc_id), str(r.text)) for r in plain)
    assert all(r[n] == "own" for r in kept for n in NAMES) and kept
    assert run(clashing(empty(spark)), models).count() == 0
