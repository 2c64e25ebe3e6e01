import os

import pytest

import residue_sets as S
from foldmark.llm.residue import matches, residue_documents

RESIDUE = [
    "# {{project_name}}\n\nSome words about the scanner.", "Welcome to [INSERT TITLE HERE], friends.", "Maintained by ${OWNER} since May.", "Version %%VERSION%% was tagged.", "Title: <your name here>", "Dear TODO: add owner team, hello there.", "Rename __TEAM_NAME__ to __TEAM_NAME__",
    "Lorem ipsum dolor sit amet consectetur.", "Real content here about drives.\n\nVestibulum mollit dolor rutrum velit ipsum.\n\nAnd more content.", "404 Not Found", "<html><head><title>410 Gone</title></head><body><h1>410 Gone</h1></body></html>", '{"code":503,"reason":"Service Unavailable","trace":"3dc4"}',
    "Please enable JavaScript to view this page.", "You must switch on client-side scripts and reload the page.", "BITTE JAVASCRIPT EINSCHALTEN, UM DIESE SEITE ZU SEHEN.", "Checking your browser before opening umber-watcher ...", "Insert a headline - to be done.", "xxx xxx xxx xxx xxx", "Content coming soon. Check back later.",
    "An ordinary paragraph.\r\n\r\nAccess denied.\r\n", "word " * 50_000, "Style guide: never ship text like [insert title here] or TODO blocks for {{owner}}.", "x" * 300_000 + "\n\n{{ name }}",
]
CONTENT = [
    "A page about the scanner.", "Run `echo {{project_name}}` first.", "```yaml\nimage: {{ .Values.tag }}\n```\nand so on.", 'Fixed: the script header printed "{target_dir}" literally when a-b had no description.', "When a repository was deleted the fetcher gets a 404 Not Found and the size summary marks it as gone; this happened 19 times.",
    "We dropped 4 pages of lorem ipsum from the crawl on 2024-02-14 because the scanner rewrote them as real notes.", "The dashboard needs JavaScript: sorting and paging run in the browser, so please enable it in kiosk mode, and 58 rows are embedded in the page.",
    "Style guide: never ship text like [insert title here] or TODO blocks.", "2024-09-12 16:36:05 WARN  fetcher: a/b answered 404, marked as gone", "- 2: service unavailable, try later", "Add a check for the shared backup", "Please do not move the partial checkout: the build crew still reads from it.",
    "[Docs](http://x.example) and __init__ files.", "", "   \n", None, "x", "Files and folders, " + "and more of them in the tree " * 4000 + "at last.",
]

def frame(spark):
    texts = RESIDUE + CONTENT
    return spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)], "doc_id long, text string, w int")


def test_residue_is_told_from_content(spark):
    # ordinary documents give the words their weights
    filler = spark.range(1000, 1400).selectExpr("id as doc_id", "concat('The scanner lists folder ', id, ' and the report names each page, so please look for errors here when the server is up. Add your notes to the text.') as text", "1 as w")
    found = {r["doc_id"] for r in residue_documents(frame(spark).unionByName(filler), "doc_id", "text").collect()}
    assert found == set(range(len(RESIDUE)))


def test_repeated_rows_give_one_document(spark):
    df = spark.createDataFrame([(1, "404 Not Found"), (1, "404 Not Found"), (1, "fine"), (2, "All is well with the drives.")], "doc_id long, text string")
    assert [r["doc_id"] for r in residue_documents(df, "doc_id", "text").collect()] == [1]


@pytest.mark.parametrize("texts", [[], [None], ["", " "]])
def test_nothing_to_search(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert residue_documents(df, "doc_id", "text").count() == 0


def test_scores(spark):
    got = matches(frame(spark), "doc_id", "text").collect()
    assert all(0.79 <= r["containment"] <= 1.0 + 1e-9 and 0 <= r["coverage"] <= 1.0 + 1e-9 for r in got)


def test_filler_that_holds_a_third_of_the_corpus_is_found(spark):
    filler = spark.range(300).selectExpr("id as doc_id", "'Lorem ipsum dolor sit amet, consectetur adipiscing elit.' as text")
    notes = spark.range(1000, 1600).selectExpr("id as doc_id", "concat('The scanner lists folder ', id, ' for the crew and keeps its notes.') as text")
    # a catalogue term met once sets the largest weight
    once = spark.createDataFrame([(2000, "The mockup has a maintenance column.")], "doc_id long, text string")
    found = {r["doc_id"] for r in residue_documents(filler.unionByName(notes).unionByName(once), "doc_id", "text").collect()}
    assert found == set(range(300))


def found_among_notes(spark, texts):
    notes = spark.range(1000, 1400).selectExpr("id as doc_id", "concat('The scanner lists folder ', id, ' and the report names each page, so please look for errors here when the server is up. Add your notes to the text.') as text")
    if os.path.isdir("/root/testdata/sf0.001"):
        notes = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text")
    mine = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in residue_documents(mine.unionByName(notes), "doc_id", "text").collect() if r["doc_id"] < 1000}


def test_recall_and_precision_on_texts_held_out(spark):
    texts = S.HELD_OUT_RESIDUE + S.LATER_RESIDUE
    n = len(texts)
    found = found_among_notes(spark, texts + S.HELD_OUT_CONTENT + S.LATER_CONTENT)
    right = sum(k < n for k in found)
    assert right / n >= 0.9 and right / len(found) >= 0.9


def test_long_placeholders(spark):
    texts = ["{{" + "a" * 500 + "}}", "{% " + "b " * 300 + "%}", "${" + "c" * 500 + "}", "[insert " + "a short text about the project " * 20 + "]", "__" + "_".join(["LONG"] * 50) + "__", "%%" + "D" * 500 + "%%"]
    assert found_among_notes(spark, texts) == set(range(len(texts)))


def test_repeated_ids_with_different_texts(spark):
    df = spark.createDataFrame([(1, "All is well."), (1, "404 Not Found"), (2, "All is well.")], "doc_id long, text string")
    assert [r["doc_id"] for r in residue_documents(df, "doc_id", "text").collect()] == [1]
