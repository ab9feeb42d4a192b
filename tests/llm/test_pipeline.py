"""The pipeline stage by stage, and the queries that have SQL."""

import re

import pytest

import corpus_pipeline as pipeline
from __spark_entry__ import oracle_sql, queries
from packsift.llm import jaccard, pieces
from packsift.llm.queries import SQL
from packsift_oracle.compare import compare, connect

from .test_groups import brute_components, brute_hits, brute_lines, prose

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage over the smallest tables."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_keep_the_columns(stages):
    for before, after in stages[:-1]:
        assert before.dtypes == after.dtypes and 0 < after.count() <= before.count()
    assert dict(stages[-1][1].dtypes)["ids"] == "array<int>"


def test_toxic_documents_go(spark):
    """On the next larger tables: the smallest have eight toxic documents to learn from."""
    folder = FOLDER.replace("0.001", "0.01")
    before = spark.read.parquet(f"{folder}/documents.parquet")
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    dropped = {i for i, _ in texts(before)} - {i for i, _ in texts(pipeline.toxic_stage(spark, before, folder))}
    toxic = [i for i, t in marks.items() if t == 1]
    assert sum(i in dropped for i in toxic) >= 0.6 * len(toxic)
    assert sum(marks.get(i) == 0 for i in dropped) <= 0.06 * sum(t == 0 for t in marks.values())


def test_later_copies_of_lines_go(stages):
    before, after = texts(stages[1][0]), dict(texts(stages[1][1]))
    gone = brute_lines([(i, t) for i, t in before if t.count("\n") < 60], 50)
    for i, t in before:
        if t.count("\n") < 60:
            kept, s = [], 0
            for line in t.split("\n"):
                if not line.strip() or (i, s) not in gone:
                    kept.append(line)
                s += bool(line.strip())
            # a long document may hold an earlier copy, so more may go, never less
            assert i not in after or len(after[i]) <= len("\n".join(kept))
            if i in after and after[i] == t:
                assert not any(d == i for d, _ in gone)


def test_one_of_each_group_stays(stages):
    before, after = texts(stages[2][0]), {i for i, _ in texts(stages[2][1])}
    assert after == {i for i, (n, c) in brute_components(before, 5, 80).items() if i == c}


def test_contaminated_documents_go(spark, stages):
    before, after = texts(stages[3][0]), {i for i, _ in texts(stages[3][1])}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    short = [(i, t) for i, t in before if len(t) < 1500]
    hits = brute_hits(short, items, 10)
    assert {i for i, _ in short if hits[i][1] == 0} == {i for i, _ in short} & after


def test_encoding_is_exact(stages):
    with open(pipeline.PIECES, "rb") as file:
        model = pieces.Pieces(file.read())
    before = dict(texts(stages[4][0]))
    rows = stages[4][1].collect()
    assert len(rows) == len(before) and all(r.exact and model.decode(r.ids) == before[r.doc_id] for r in rows)


def test_stages_on_odd_rows(spark, documents, odd):
    same = prose(60)
    docs = documents([*odd, (30, same), (31, same), (31, same), (32, "")])
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and stage(spark, docs.filter("false"), FOLDER).count() == 0, name
    kept = sorted(((r.doc_id or 0, r.text or "") for r in pipeline.near_stage(spark, docs, FOLDER).collect()))
    assert [i for i, _ in kept] == [0, 1, 2, 3, 5, 7, 8, 30, 32]
    cut = [(r.doc_id, r.n_chars) for r in pipeline.line_stage(spark, docs, FOLDER).collect()]
    assert (30, len(same)) in cut and not any(i == 31 for i, _ in cut)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, name):
    verdict, info = compare(spark, connect(FOLDER), FOLDER, queries()[name], oracle_sql()[name])
    assert verdict == "ok", info


def test_queries_are_registered():
    names = queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13


def test_jaccard_query_matches_brute_force(spark):
    rows = texts(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    rows = [r for r in rows if len(re.findall(r"\S+", r[1])) < 400]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute_components(rows, 4, 85)
