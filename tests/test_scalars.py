"""Scalar queries over small tables."""

from foldmark.plans import scalars


def test_names_of_matches_of_every_type_are_compared(spark, tmp_path):
    spark.createDataFrame([(1, 1, 1, "name_only"), (2, 1, 2, "diverged"), (3, 2, 1, None)], "id long, local_dir_id long, github_repo_id long, match_type string").write.parquet(f"{tmp_path}/local_github_matches.parquet")
    spark.createDataFrame([(1, "a-b"), (2, "tide")], "id long, name string").write.parquet(f"{tmp_path}/directories.parquet")
    spark.createDataFrame([(1, "a_b"), (2, "x")], "id long, name string").write.parquet(f"{tmp_path}/github_repos.parquet")
    got = {r["id"]: r["ratio"] for r in scalars.name_ratios(spark, str(tmp_path)).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0}
