import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from spikeframe.llm import queries, stages
from spikeframe.llm.toxicity import score_toxicity

from .test_near_copies import brute_groups
from .test_operators import brute_lines

NAMES = ["toxicity", "line_dedup", "near_dedup", "mix", "encode"]


def test_each_stage_on_its_own_input(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, made[-1], sf_dir).write.parquet(str(tmp_path / name))
        made.append(spark.read.parquet(str(tmp_path / name)))
    assert all(df.columns == columns for df in made[:-1])
    text = [{r["doc_id"]: r["text"] for r in df.collect()} for df in made[:-1]]

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~queries.held_out())
    toxic = {r["doc_id"] for r in score_toxicity(docs, labels).where("score >= 0.7").collect()}
    assert set(text[1]) == set(text[0]) - toxic and all(text[1][i] == text[0][i] for i in text[1])

    want = brute_lines(list(text[1].items()), 40, 5)
    assert {i: t for i, t in text[2].items()} == {i: w[2] for i, w in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in made[2].collect())

    groups = brute_groups(list(text[2].items()))
    assert set(text[3]) == {i for i, root in groups.items() if i == root}

    # no document is lost to the mix, and each source keeps pace with its share
    assert text[4] == text[3]
    last = {r["doc_id"]: r for r in made[-1].collect()}
    assert set(last) == set(text[4]) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in last.values())


def test_run_gives_the_last_stage(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert "n_tokens" in found.columns and found.count() > 100


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    data = [(i, int(i % 2)) for i in range(40)]
    spark.createDataFrame(data, "doc_id long, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at)


#: Names that the operators use inside or return.
CLASHES = ["_id", "_text", "_th", "_node", "_score", "_kept", "c0", "c1", "score", "evidence", "n_lines", "n_dropped", "gone", "block", "slot", "position", "component_id", "stays", "node", "root", "low", "toxic"]


def odd_documents(spark):
    clean, bad = (" ".join(f"{w}{k % 7}{'abcdefg'[k % 7]} fine" for k in range(30)) for w in ("good", "other"))
    rows = [(i, ("awful nasty vile " if i % 2 else "") + f"{clean} {i}word", "s", 5) for i in range(40)]
    rows += [(None, clean, None, 1), (None, bad + " awful nasty vile", "s", 1), (None, None, None, None), (70, clean + " more", "s", 1), (70, bad + " awful nasty vile", "s", 1), (71, "", "t", 1), (72, " \n\n", "t", 1), (73, "x" * 100_000, "t", None), (73, "x" * 100_000, "t", None)]
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES)
    made = spark.createDataFrame([r + tuple(range(len(CLASHES))) for r in rows], schema)
    nested = F.struct(F.array("n_chars").alias("x"), F.create_map(F.lit("k"), "text").alias("y"))
    return made.withColumns({"a map": F.create_map(F.lit("k"), F.col("n_chars")), "list": F.array(F.col("text"), F.lit(None)), "nested": nested})


@pytest.mark.parametrize("name", NAMES[:-1])
def test_stages_on_odd_and_empty_documents(spark, folder, name):
    docs, stage = odd_documents(spark), dict(stages.STAGES)[name]
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    assert all([r[c] for c in CLASHES] == list(range(len(CLASHES))) for r in rows)
    assert stage(spark, docs.limit(0), folder).count() == 0
    n = collections.Counter(r["doc_id"] for r in rows)
    if name in ("line_dedup", "mix"):
        assert len(rows) == docs.count()
    if name == "toxicity":  # a toxic row takes no other row of its id, or without one, along
        assert n[None] == 2 and n[70] == 1 and n[73] == 2
        assert not any("awful nasty" in (r["text"] or "") for r in rows)
    if name == "near_dedup":  # of the texts without words, the smallest id stays; repeated rows are one document
        assert n[71] == 1 and n[72] == 0 and n[73] == 2
    assert stage(spark, docs.select(F.lit(None).cast("long").alias("doc_id"), "text", "source", "n_chars"), folder).columns == ["doc_id", "text", "source", "n_chars"]


def test_encode_of_odd_documents(spark, folder):
    docs = odd_documents(spark)
    got = stages.encode(spark, docs, folder)
    assert got.count() == docs.count() and got.where("doc_id IS NULL AND n_tokens = 0").count() == 1
    assert stages.encode(spark, docs.limit(0), folder).count() == 0
