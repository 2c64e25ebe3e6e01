import json
import os

from pyspark.sql import functions as F

from foldmark.schema import SCHEMAS, create_tables, empty_table, schema_of
from foldmark.sources import files, logs, mounts, reports, repos, tables
from foldmark.streaming import incremental, uploads


def test_scan_and_roll_up(spark, rows, tmp_path):
    for name, text in (("a/x.py", "one"), ("a/b/y.MD", ""), (".git/z", "no"), ("top", "one")):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(text)
    root = str(tmp_path)
    found = files.scan_files(spark, root, ["**/.git/**"]).cache()
    assert rows(found.select("rel_path", "extension", "size_bytes")) == [("a/b/y.MD", ".md", 0), ("a/x.py", ".py", 3), ("top", "", 3)]
    assert found.where("filename = 'top'").first()["git_sha1"] == "43dd47ea691c90a5fa7827892c70241913351963"
    dirs = files.directories_of(found, root)
    assert rows(dirs.select("name", "depth", "file_count", "total_size_bytes"))[:2] == [("a", 1, 2, 3), ("b", 2, 1, 0)]
    (tmp_path / "top").write_text("changed")
    os.utime(tmp_path / "top", (1, 1))
    again = files.scan_files(spark, root, ["**/.git/**"], previous=found)
    assert rows(again.select("rel_path")) == [("top",)]
    assert tuple(files.estimated_count(found).first()) == (3, False)


def test_scan_ids():
    assert files.new_scan_id(1716100000.9, "a1b2c3d4") == "scan-1716100000-a1b2c3"


def test_files_are_hashed_as_a_stream(spark, tmp_path):
    import hashlib

    (tmp_path / "big").write_bytes(b"x" * 200_000)
    row = files.scan_files(spark, str(tmp_path)).first()
    assert row["sha256"] == hashlib.sha256(b"x" * 200_000).hexdigest() and row["git_sha1"] == hashlib.sha1(b"blob 200000\0" + b"x" * 200_000).hexdigest()


def test_mounts(spark, rows, tmp_path):
    table = tmp_path / "mounts"
    table.write_text("proc /proc proc rw\nC: /mnt/c drvfs rw\n/dev/sdb /media/my\\040usb ext4 rw\nC: /mnt/c drvfs rw\nbroken line\n/dev/sda / ext4 rw\nx /snap/y squashfs ro\n")
    got = mounts.drives(mounts.read_mounts(spark, str(table)))
    assert [tuple(r) for r in got.select("letter", "label", "is_windows").collect()] == [("c", "C:", True), ("my usb", "sdb", False), ("root", "sda", False)]


def test_repository_json(spark, rows):
    page = json.dumps([{"id": 1, "name": "n", "full_name": "o/n", "owner": {"login": "o"}, "topics": ["a", "b"], "private": True}, {"id": 2, "name": "f", "full_name": "o/f", "fork": True}])
    pages = spark.createDataFrame([(1, page), (2, page), (3, "{}"), (4, None)], "page_no int, json string")
    assert rows(repos.repo_catalogue(pages).select("full_name", "topics", "is_private", "default_branch")) == [("o/f", None, 0, "main"), ("o/n", "a,b", 1, "main")]
    assert repos.repo_catalogue(pages, skip_forks=True).count() == 1
    tree = json.dumps({"truncated": True, "tree": [{"path": "a.py", "type": "blob", "sha": "s", "size": 3}, {"path": "d", "type": "tree"}, {"path": "i.PNG", "type": "blob"}]})
    assert rows(repos.tree_files(spark.createDataFrame([(5, tree), (6, "nonsense")], "repo_id long, json string"), (".png",))) == [(5, "a.py", "s", 3, True)]
    refs = spark.createDataFrame([(1, '{"ref": "r", "object": {"sha": "x"}}'), (2, '[{"object": {"sha": "y"}}]'), (3, "[]")], "repo_id long, json string")
    assert rows(repos.head_digests(refs)) == [(1, "x"), (2, "y"), (3, None)]


def test_worker_logs(spark, rows):
    lines = [(1, 1, "10file [0:1, 5.0file/s]"), (1, 2, "20file [0:2, 7.5file/s]"), (1, 3, "WORKER1_DONE"), (2, 1, "FAILED badly"), (2, 2, "5file [0:1, 1.5file/s]")]
    df = spark.createDataFrame(lines, "worker int, line_no int, value string")
    progress = logs.worker_progress(df)
    assert rows(progress) == [(1, 20, 7.5, True, None), (2, 5, 1.5, False, "FAILED badly")]
    assert tuple(logs.run_status(progress, 2).first()) == (25, 9.0, 1, "FAILED badly", "active")
    assert rows(logs.last_error(df)) == [(1, None), (2, "FAILED badly")]
    assert [r["line_no"] for r in logs.tail(df.where("worker = 1"), 2).collect()] == [2, 3]


def test_tables(spark, rows, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    for root, names in ((one, ["a", "b"]), (two, ["b", "c"])):
        for t, key in (("github_repos", "full_name"), ("files", "abs_path")):
            df = empty_table(spark, t).unionByName(spark.createDataFrame([(n, 1 if root == one else 2) for n in names], f"{key} string, id long"), allowMissingColumns=True)
            tables.write_table(df, root, t)
    merged = tables.merged_store(spark, one, two)
    assert rows(merged["github_repos"].select("full_name", "id")) == [("a", 1), ("b", 2), ("c", 2)]
    assert rows(merged["files"].select("abs_path", "id")) == [("a", 1), ("b", 1), ("c", 2)]
    tables.swap_table(merged["files"], one, "files")
    assert tables.read_table(spark, one, "files").count() == 3
    assert tables.read_table(spark, one, "files").schema == schema_of("files")


def test_swaps_can_be_cut_off(spark, tmp_path):
    root = str(tmp_path / "s")
    tables.swap_table(empty_table(spark, "files"), root, "files")
    os.rename(f"{root}/files.parquet", f"{root}/files.parquet.old")
    tables.restore_table(spark, root, "files")
    assert tables.read_table(spark, root, "files").count() == 0 and not os.path.exists(f"{root}/files.parquet.old")


def test_pairs_and_matches_are_stored_once(spark, rows, tmp_path):
    root = str(tmp_path / "p")
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 1.0)], "dir1_id long, dir2_id long, content_similarity double")
    for _ in range(2):
        tables.store_pairs(pairs, root, 7.0)
        tables.store_matches(pairs.selectExpr("dir1_id as local_dir_id", "dir2_id as github_repo_id", "'exact' as match_type"), root, 7.0)
    assert rows(tables.read_table(spark, root, "dir_pairs").select("dir1_id", "dir2_id", "content_similarity", "analyzed_at")) == [(1, 2, 0.5, 7.0), (1, 3, 1.0, 7.0)]
    assert rows(tables.read_table(spark, root, "local_github_matches").select("local_dir_id", "github_repo_id", "match_type")) == [(1, 2, "exact"), (1, 3, "exact")]


def test_stored_matches_are_small_and_numbered_by_the_pair(spark, tmp_path):
    root, big = str(tmp_path / "m"), 2**40
    pairs = spark.range(0, 200_000, 1, 2).selectExpr("id div 1000 as local_dir_id", "id * 7 % 1000 as github_repo_id", "0.5D as content_similarity", "'exact' as match_type")
    odd = spark.createDataFrame([(1, big), (big, 1), (-1, 1), (None, 1), (1, None)], "local_dir_id long, github_repo_id long")
    seen = []
    for _ in range(2):
        tables.store_matches(pairs.unionByName(odd, allowMissingColumns=True), root, 7.0)
        got = tables.read_table(spark, root, "local_github_matches").select("local_dir_id", "github_repo_id", "id").collect()
        seen.append({r[:2]: r[2] for r in map(tuple, got)})
        assert len(got) == len(seen[-1]) == len(set(seen[-1].values())) == 200_005
    assert seen[0] == seen[1]
    assert sum(p.stat().st_size for p in (tmp_path / "m").rglob("*.parquet") if p.is_file()) < 4 * 200_005


def test_create_tables_twice(spark):
    assert create_tables(spark) == create_tables(spark) == list(SCHEMAS)


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n int")
    text = reports.markdown_report("T", {"S": df, "E": df.limit(0)}, "now")
    assert "| a\\|b | 1   |" in text and "Nothing found." in text
    page = reports.html_report("<T>", {"S": spark.createDataFrame([("</script><b>",)], "x string")}, "now")
    assert "&lt;T&gt;" in page and "<\\/script>" in page and page.count("</script>") == 2
    many = spark.range(2500).selectExpr("id", "concat('row ', id) as name")
    assert reports.markdown_report("T", {"S": many}, "now").count("| row ") == 2500
    reports.write_report(str(tmp_path / "r" / "all.html"), "T", {"S": many, "E": df.limit(0)}, "now")
    page = (tmp_path / "r" / "all.html").read_text()
    embedded = json.loads(page.split('type="application/json">')[1].split("</script>")[0])
    assert len(embedded["S"]["rows"]) == 2500 and embedded["E"] == {"columns": ["name", "n"], "rows": []}
    scripts = reports.copy_script_rows(spark.createDataFrame([(1, 2, "push", "/x/it's", "git@h:o/r", "b", "why\nnot"), (2, 1, "push", "/y", "", "b", "r")], "position int, priority int, action string, folder string, remote_url string, branch string, reason string"))
    assert reports.write_scripts(scripts, str(tmp_path / "s")) == 1
    assert "folder='/x/it'\\''s'" in (tmp_path / "s" / "001_2_push__it_s.sh").read_text()


def test_upload_stream_copies_each_file_once(spark, rows, tmp_path):
    source, sink, mark = str(tmp_path / "in"), str(tmp_path / "up"), str(tmp_path / "ck")
    make = lambda ids: empty_table(spark, "files").unionByName(spark.createDataFrame([(i, f"/d/{i}") for i in ids], "id long, abs_path string"), allowMissingColumns=True)
    copied = []

    def copy(df):
        copied.extend(r["file_id"] for r in df.collect())
        return df

    for ids in ([1, 2, 2], [2, 3]):
        make(ids).write.mode("append").parquet(source)
        query = uploads.upload_stream(uploads.scanned_files(spark, source), copy, sink, "/base/", mark, once=True)
        assert uploads.drain(query, 60)
    assert sorted(copied) == [1, 2, 3]
    assert rows(spark.read.parquet(sink).select("file_id", "remote_path")) == [(1, "/base/d/1"), (2, "/base/d/2"), (3, "/base/d/3")]
    running = spark.readStream.schema(schema_of("files")).parquet(source)
    query = incremental.content_counts(running.withColumn("sha256", F.lit("h"))).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    assert spark.table("counts").first()["n_rows"] == 5
    query.stop()


def test_a_replayed_batch_keeps_its_record(spark, rows, tmp_path):
    source, sink, mark = str(tmp_path / "in"), str(tmp_path / "up"), str(tmp_path / "ck")
    there = tmp_path / "there"
    there.write_text("x")
    made = [(1, str(there)), (2, str(there)), (3, str(tmp_path / "gone"))]
    empty_table(spark, "files").unionByName(spark.createDataFrame(made, "id long, abs_path string"), allowMissingColumns=True).write.parquet(source)
    copied = []

    def copy(df):
        copied.append(sorted(r["file_id"] for r in df.collect()))
        # only one of the files arrives at first
        return df.where("file_id = 1") if len(copied) == 1 else df

    for _ in range(3):
        query = uploads.upload_stream(uploads.scanned_files(spark, source), copy, sink, "/base", mark, once=True, present=uploads.existing_files)
        assert uploads.drain(query, 60)
        for name in os.listdir(f"{mark}/commits"):
            os.remove(f"{mark}/commits/{name}")
    assert copied == [[1, 2], [2], []]
    assert rows(spark.read.parquet(sink).select("file_id")) == [(1,), (2,)]


def test_progress_is_flushed(spark):
    class Event:
        class progress:
            numInputRows = 60

    seen = []
    listener = uploads.Progress(seen.append, 100)
    for _ in range(3):
        listener.onQueryProgress(Event)
    listener.onQueryTerminated(None)
    assert seen == [{"batches": 2, "rows": 120}, {"batches": 3, "rows": 180}]


def test_triggers_fire_once():
    looks = []
    made = lambda name, at: (name, (lambda: len(looks) >= at, lambda: looks.append(name)))
    fired = incremental.poll(dict([made("first", 0), made("second", 1), made("never", 99)]), 5, sleep=lambda s: None)
    assert fired == ["first", "second"] == looks


def test_polling(tmp_path):
    now = [0.0]
    pause = lambda s: now.__setitem__(0, now[0] + s)
    clock = lambda: now[0]
    assert not incremental.wait_for(str(tmp_path / "none"), 10, sleep=pause, clock=clock) and now[0] == 10
    assert incremental.wait_for(str(tmp_path), 10, sleep=pause, clock=clock)
    assert incremental.when_there(str(tmp_path), lambda: "ran", 1, sleep=pause, clock=clock) == "ran" and incremental.when_there(str(tmp_path / "none"), lambda: "ran", 0, sleep=pause, clock=clock) is None
    gate = incremental.CallGate(pause, clock)
    gate.before(100)
    gate.before(10, resets_at=50.0)
    assert now[0] == 50
    gate.before(100)
    assert now[0] == 51
