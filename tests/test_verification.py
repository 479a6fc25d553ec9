"""The check runner: a broken module, several runs in one log."""

from loomgraph.operators import verification as V

CHECKS = "name string, category string, score double, threshold double, status string"


def test_a_broken_module_does_not_stop_the_run(spark, tmp_path):
    fine = lambda: spark.createDataFrame([("a", "x", 1.0, 0.5, "PASS"), ("b", "x", 0.1, 0.5, "FAIL")], CHECKS)

    def broken():
        raise RuntimeError("gone\nmore")

    path, as_of = str(tmp_path / "log"), "2024-05-01 00:00:00"
    V.run_checks(spark, {"one": fine}, "r0", as_of, path)
    got = V.run_checks(spark, {"bad": broken, "one": fine}, "r1", as_of, path)
    assert {(r["check_name"], r["status"], r["details"]) for r in got.collect()} == {("a", "PASS", "{}"), ("b", "FAIL", "{}"), ("bad", "FAIL", '{"error": "gone"}')}
    log = spark.read.schema(V.LOG).parquet(path)
    assert {tuple(r) for r in V.summary(log).collect()} == {("r0", "PASS", 1), ("r0", "FAIL", 1), ("r1", "PASS", 1), ("r1", "FAIL", 2)}
