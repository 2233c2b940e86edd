from fogline.operators import objectives
from fogline.streaming.query_lines import evaluate_lines


def test_lines_are_evaluated_as_they_come(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 1, 50), (2, 4, 1, 50), (1, 3, 2, 90), (3, 4, 2, 90)], "src long, dst long, color long, p_pct long")
    (tmp_path / "in").mkdir()
    where = [f"file://{tmp_path}/{x}" for x in ("in", "out", "state")]
    for k, line in enumerate(("1;4;1\n1;4;2\n", "1;4;1 2\n1;4;1 2\n")):
        (tmp_path / "in" / f"{k}.txt").write_text(line)
        evaluate_lines(spark, edges, *where).awaitTermination()
    got = {tuple(r["colors"]): r["hits"] for r in spark.read.parquet(where[1]).collect()}
    assert set(got) == {(1,), (2,), (1, 2)} and got[1, 2] >= max(got[1,], got[2,])
    q = spark.createDataFrame([(0, [1], [4])], "query_id long, sources array<long>, targets array<long>")
    want = objectives.evaluate(edges, q, spark.createDataFrame([(0, 2)], "query_id long, color long"), "sum", 64).first()["hits"]
    assert got[2,] == want
