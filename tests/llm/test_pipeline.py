"""Every stage of the pipeline on odd rows, against its operator's meaning."""

import random

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from tests.llm.test_llm import brute_components, prose

from tidewright.llm.store import keep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark, tmp_path):
    bench = [prose(25, 5000 + k) for k in range(3)]
    rows = [(k, prose(random.Random(k).randint(20, 90), k), "en", f"s{k % 3}") for k in range(60)]
    rows += [(100 + k, rows[k][1], "en", "s0") for k in range(5)] + [(110 + k, rows[k][1] + " more", "en", None) for k in range(5)]
    rows += [(120 + k, f"{prose(20, 300 + k)} {b} tail", "en", "s1") for k, b in enumerate(bench)]
    rows += [(130, None, "en", "s1"), (131, "", None, "s1"), (132, "12 34", "en", "s2")]
    folder = str(tmp_path / "tables")
    table = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_stages(spark, tmp_path):
    folder, rows = documents(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in pipeline.STAGES:
        docs = keep(stage(spark, docs, folder), name)
        after[name] = docs
        if name != "token_output":
            assert docs.columns == COLUMNS
    ids = lambda name: {r.doc_id for r in after[name].select("doc_id").collect()}
    assert ids("language_id") == {r[0] for r in rows} - {130, 131, 132}
    _, component = brute_components([r[:2] for r in rows if r[0] < 130])
    assert ids("near_dedup") == {i for i, c in component.items() if i == c}
    assert ids("decontamination") == ids("near_dedup") - {120, 121, 122}
    copies = after["mixing"].groupBy("doc_id").count().collect()
    assert {r.doc_id for r in copies} <= ids("decontamination") and all(r["count"] in (1, 2) for r in copies)
    assert after["token_output"].count() == after["mixing"].count()


def test_empty_and_more_columns(spark, tmp_path):
    folder, _ = documents(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for table in (docs.where("false"), docs.withColumns({c: F.lit(1) for c in ("row", "kept", "bad_row", "kept_id", "mix_row", "mix_copy", "mix_copies", "col", "columns", "id", "rep", "score")})):
        for name, stage in pipeline.STAGES[:4]:
            out = keep(stage(spark, table, folder), name)
            assert out.columns == table.columns and out.count() <= 2 * table.count()


def test_rows_that_repeat_a_doc_id(spark, tmp_path):
    """Different texts of one doc_id are documents of their own; copies of one text are one, whatever the partitions."""
    one, two, three = prose(40, 1), prose(40, 2), prose(40, 3)
    rows = [(1, one, "en"), (1, two, "en"), (1, one, "fr"), (2, two + " x", "en"), (3, three, "en"), (3, three, "en"), (None, three, "en"), (None, three, "en")]
    table = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stays = [sorted((r.doc_id or 0, r.text, r.lang) for r in pipeline.near_dedup(spark, table.repartition(n), "").collect()) for n in (1, 5)]
    assert stays[0] == stays[1]
    texts = [(i, t) for i, t, _ in stays[0]]
    assert texts.count((0, three)) == 2 and texts.count((3, three)) == 1 and texts.count((1, one)) == 1
    assert len([t for _, t in texts if t.startswith(two)]) == 1 and len(texts) == 5
