"""Judgment lines: the edge rows of FIXTURES.md section 4."""

import pytest

from quiver.operators import knn
from quiver.sources import qrels as Q


def _lines(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "line_no long, value string")


def test_four_and_five_fields(spark):
    p = Q.parse_qrels(_lines(spark, ["q1 0 d1 1", "  q1\t0 d1  1 3"])).orderBy("line_no").collect()
    assert [(r.qid, r.doc_id, r.rel, r.task_id) for r in p] == [("q1", "d1", 1, "0"), ("q1", "d1", 1, "3")]


def test_malformed_rejected(spark):
    lines = _lines(spark, ["q1 0 d1", "", "q2 0 d2 1"])
    assert Q.parse_qrels(lines).count() == 1
    rej = Q.qrels_rejects(lines).orderBy("line_no").collect()
    assert [r.value for r in rej] == ["q1 0 d1", ""]


def test_not_relevant_sets_task_only(spark):
    p = Q.parse_qrels(_lines(spark, ["q2 0 d9 0 5"]))
    assert Q.positive_judgments(p).count() == 0
    assert Q.task_map(p).collect()[0].task_id == "5"
    assert Q.qrel_sets(p).count() == 0


def test_repeated_query_last_task_wins(spark):
    p = Q.parse_qrels(_lines(spark, ["q3 0 d1 1 1", "q3 0 d2 1 2"]))
    assert Q.positive_judgments(p).count() == 2
    assert Q.task_map(p).collect()[0].task_id == "2"
    s = Q.qrel_sets(p).collect()[0]
    assert s.doc_ids == ["d1", "d2"] and s.n_docs == 2


def test_duplicate_lines_collapse(spark):
    p = Q.parse_qrels(_lines(spark, ["q 0 d 1", "q 0 d 1"]))
    assert Q.positive_judgments(p).count() == 1


def test_non_integer_relevance_raises(spark):
    with pytest.raises(Exception):
        Q.parse_qrels(_lines(spark, ["q 0 d x"])).collect()


def test_id_as_text_does_not_match(spark):
    """A judgment on '007' must not match pool id 7."""
    queries = spark.createDataFrame([(1, "it", [1.0, 0.0])], "qid long, q_mod string, vec array<double>")
    pool = spark.createDataFrame([(7, "it", [1.0, 0.0])], "doc_id long, c_mod string, vec array<double>")
    j = spark.createDataFrame([("1", "007")], "qid string, doc_id string")
    r = knn.first_relevant_rank(queries, pool, j).collect()
    assert r[0].first_rank is None
    j2 = spark.createDataFrame([("1", "7")], "qid string, doc_id string")
    assert knn.first_relevant_rank(queries, pool, j2).collect()[0].first_rank == 1


def test_identity_generation(spark):
    recs = spark.createDataFrame([(5, "test"), (6, "train")], "id long, split string")
    out = {r.id: r.value for r in Q.generate_identity_qrels(recs, "id", "split").collect()}
    assert out == {5: "5 0 5 1 0", 6: "6 0 6 1 0"}


def test_read_and_write_text(spark, tmp_path):
    lines = spark.createDataFrame([("test", "1 0 1 1 0"), ("test", "2 0 2 1 0")], "split string, value string")
    Q.write_qrels(lines, str(tmp_path / "q"))
    back = Q.read_qrels_text(spark, str(tmp_path / "q" / "split=test"))
    assert sorted(r.value for r in back.collect()) == ["1 0 1 1 0", "2 0 2 1 0"]
    with pytest.raises(Exception):
        Q.read_qrels_text(spark, str(tmp_path / "missing")).collect()
