import csv
import random

import pytest
from pyspark.sql import functions as F

from feedback_signals import config as C
from feedback_signals.operators.reshape import named
from feedback_signals.sources import files, loaders, profile as P, runs, sinks


def write(path, rows, header=None):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        if header:
            w.writerow(header)
        w.writerows(rows)
    return str(path)


COURSE_HEADER = [
    "teaching", "teaching", "coursecontent", "coursecontent", "examination", "Examination",
    "labwork", "labwork", "library_facilities", " library_facilities", "extracurricular", "extracurricular",
]


def course_rows(n=6):
    return [
        [i % 3 - 1, f"teaching text number {i}", 1, "content, with a comma", 0, "exam \"quoted\" text", -1, "lab\nwith a line break", 1, "  ", 0, ""]
        for i in range(n)
    ]


def test_names():
    assert files.unique_names(["a", "a", "", "a", "a.1"]) == ["a", "a.2", "Unnamed: 2", "a.3", "a.1"]
    assert files.unique_names(["teaching", "teaching", "b"]) == ["teaching", "teaching.1", "b"]
    stored = files.storage_names(["examination", "Examination", "x"])
    assert stored[0] == "examination" and len({s.lower() for s in stored}) == 3
    assert files.is_headerless("This is a whole sentence of feedback text.")
    assert not files.is_headerless("feedback_text") and not files.is_headerless("Q1_Comments")


def test_header_variants(spark, tmp_path):
    path = write(tmp_path / "c.csv", course_rows(), COURSE_HEADER)
    df = files.read_feedback(spark, path)
    originals = files.original_names(df)
    assert list(originals.values())[:12] == [
        "teaching", "teaching.1", "coursecontent", "coursecontent.1", "examination", "Examination",
        "labwork", "labwork.1", "library_facilities", " library_facilities", "extracurricular", "extracurricular.1",
    ]
    rows = df.orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(6))
    assert rows[2][files.stored_name(df, "teaching.1")] == "teaching text number 2"
    assert rows[0][files.stored_name(df, "labwork.1")] == "lab\nwith a line break"
    assert rows[0][files.stored_name(df, "Examination")] == 'exam "quoted" text'
    assert dict(df.dtypes)["teaching"] == "bigint"


def test_course_eval(spark, tmp_path):
    df = loaders.load_course_eval(spark, write(tmp_path / "c.csv", course_rows(), COURSE_HEADER))
    counts = {r.dimension: r["count"] for r in df.groupBy("dimension").count().collect()}
    assert counts == {"teaching": 6, "course_content": 6, "examination": 6, "lab_work": 6}
    assert df.select("row_id").distinct().count() == df.count() == 24
    with pytest.raises(ValueError):
        loaders.load_course_eval(spark, write(tmp_path / "d.csv", [["x", 1]], ["some_text", "score"]))


def test_row_ids_over_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(4):  # later files are larger: Spark reads those first
        write(folder / f"part{i}.csv", [[f"file {i} line {j}", j] for j in range(3 + 40 * i)], ["comment", "n"])
    for multi_line in (True, False):
        df = files.read_feedback(spark, str(folder), multi_line)
        got = [r.comment for r in df.orderBy("row_id").collect()]
        assert got == [f"file {i} line {j}" for i in range(4) for j in range(3 + 40 * i)]
        assert df.agg(F.max("row_id")).first()[0] == len(got) - 1


def test_split_file_keeps_order(spark, tmp_path):
    path = write(tmp_path / "big.csv", [[f"row {j}", j] for j in range(5000)], ["comment", "n"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = files.read_feedback(spark, path, multi_line=False)
        assert df.rdd.getNumPartitions() > 3
        assert df.filter("row_id <> n").count() == 0 and df.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_every_file_by_its_own_header(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder / "a.csv", [["first comment", 1], ["second\ncomment", 2]], ["comment", "rating"])
    write(folder / "b.csv", [[3, "third comment", "x"]], ["rating", "comment", "Comment"])
    write(folder / "c.csv", [["This whole file has no header, only feedback."], ["fourth"]])
    write(folder / "d.csv", [["fifth comment", 5]], ["comment", "rating"])
    (folder / "e.csv").write_text("")
    (folder / "f.csv").write_text("comment,rating\n")
    for multi_line in (True, False):
        df = files.read_feedback(spark, str(folder), multi_line)
        other = files.stored_name(df, "Comment")
        assert files.original_names(df)[other] == "Comment" and dict(df.dtypes)["rating"] == "bigint"
        rows = [(r.row_id, r.comment, r.rating, r[other], r.text) for r in df.orderBy("row_id").collect()]
        if multi_line:
            assert rows == [
                (0, "first comment", 1, None, None), (1, "second\ncomment", 2, None, None),
                (2, "third comment", 3, "x", None),
                (3, None, None, None, "This whole file has no header, only feedback."), (4, None, None, None, "fourth"),
                (5, "fifth comment", 5, None, None),
            ]
        else:
            assert (rows[-1][1:3], rows[3][1:4]) == (("fifth comment", 5), ("third comment", 3, "x"))
    (tmp_path / "empty.csv").write_text("")
    assert files.read_feedback(spark, str(tmp_path / "empty.csv")).count() == 0


def test_quoted_line_breaks_survive_splitting(spark, tmp_path):
    draw = random.Random(7)
    piece = ["a", "word", '"', ",", "\n", "\n\n", '""', " ", '",', '"\n', "x" * 40]
    rows = [["".join(draw.choices(piece, k=draw.randint(1, 12))) + "|", str(i)] for i in range(1500)]
    folder = tmp_path / "split"
    folder.mkdir()
    for i in range(3):
        write(folder / f"{i}.csv", rows[500 * i:500 * i + 500], ["comment", "n"])
    sizes = [("512", 30), ("4096", 3), ("100000000", 0)]
    for size, at_least in sizes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            df = files.read_feedback(spark, str(folder))
            assert spark.read.text(str(folder)).rdd.getNumPartitions() > at_least
            found = df.orderBy("row_id").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [[r.comment, str(r.n)] for r in found] == rows
        assert [r.row_id for r in found] == list(range(1500))


def test_open_cells_line_by_line():
    draw = random.Random(3)

    def plain(line, inside):  # a character at a time
        cell, at = ("inside" if inside else "new"), 0
        while at < len(line):
            c = line[at]
            if cell == "inside" and c == '"':
                if line[at + 1:at + 2] == '"':
                    at += 1
                else:
                    cell = "rest"
            elif cell != "inside" and c == ",":
                cell = "new"
            elif cell == "new":
                cell = "inside" if c == '"' else "rest"
            at += 1
        return cell == "inside"

    for _ in range(20_000):
        line = "".join(draw.choices('",a', k=draw.randint(0, 12)))
        for inside in (False, True):
            assert files.leaves_open(line, inside) == plain(line, inside), (line, inside)
    assert files.leaves_open('a,' * 100_000 + '"' + 'b""' * 100_000, False)


def test_malformed_records_are_shown(spark, tmp_path):
    (tmp_path / "m.csv").write_text('\ufeffcomment,rating\r\ngood one,4\r\nshort\r\n\r\n"long, with ""quotes""",5,more\r\n', newline="")
    df = files.read_feedback(spark, str(tmp_path / "m.csv"), malformed="raw")
    assert [(r.row_id, r.comment, r.rating, r.raw) for r in df.orderBy("row_id").collect()] == [
        (0, "good one", 4, None), (1, "short", None, "short"),
        (2, 'long, with "quotes"', 5, '"long, with ""quotes""",5,more'),
    ]


def test_headerless_and_peer(spark, tmp_path):
    lines = [["This teammate always shows up and helps the others."], ["short"], ["207043,2227414"], ["Student 1234567 did the whole part alone"],
             ["12 34 56 78 90 !! ?? 12 34"], ["Another fine comment about the team member."]]
    path = write(tmp_path / "p.csv", lines)
    df = files.read_feedback(spark, path)
    assert df.drop("row_id").columns == ["text"] and df.count() == 6
    found = files.detect_roles(df)
    assert found.text_cols == ["text"] and found.rating_col is None and found.label_col is None
    peers = loaders.load_peer_comments(spark, path)
    assert [r.text for r in peers.orderBy("row_id").collect()] == [lines[0][0], lines[5][0]]
    assert peers.first().mode == C.S2S


def test_reviews(spark, tmp_path):
    rows = [[5, 2, f"a long enough comment {i}", " Awesome" if i % 2 else "awful", "x"] for i in range(30)]
    rows += [[3, 1, "a neutral enough comment", "average", ""], ["n/a", 1, "rating is missing here", "good", ""], ["bad", 1, "rating is no number", "good", ""], [1, 1, "short", "good", ""]]
    path = write(tmp_path / "r.csv", rows, ["quality", "difficulty", "comment", "emotional_label", "tags"])
    df = loaders.load_reviews(spark, path, n_per_class=10)
    counts = {r.rating: r["count"] for r in df.groupBy("rating").count().collect()}
    assert counts == {1: 10, 0: 1, -1: 1}  # a missing rating counts as low
    assert {r.pseudo_label for r in df.collect()} <= set(C.SEED_LABELS.values())


def test_roles(spark, tmp_path):
    path = write(tmp_path / "f.csv", [[i, f"some feedback sentence {i}", 1 + i % 5, "yes"] for i in range(12)], ["id", "feedback", "rating", "flag"])
    found = files.detect_roles(files.read_feedback(spark, path))
    assert found.text_cols == ["feedback"] and found.label_col is None
    # A row number from 0 is no rating, so the first column within 1 to 10 is.
    assert found.rating_col == "rating"
    labelled = write(tmp_path / "l.csv", [["nice and long comment", "Positive"], ["awful and long comment", "Negative"]], ["comment", "sentiment"])
    found = files.detect_roles(files.read_feedback(spark, labelled))
    assert found.label_col == "sentiment" and found.df.first().text == "nice and long comment"


def prof(spark, data, schema):
    return P.profile_columns(spark.createDataFrame(data, schema))


def test_detection_rules(spark):
    p = prof(spark, [("short", "x" * 40, "y" * 30, 0, 2.5, "Positive", None)] * 2, "a string, plain string, my_comment string, t long, score double, kind string, gone string")
    assert P.detect_text_columns(p) == ["my_comment", "plain"]
    assert P.detect_rating_column(p, ["plain"]) == "score"
    assert P.detect_rating_column(p, ["plain"], training=True) == "t"
    assert P.detect_label_column(p, ["plain"]) == "kind"
    digits = prof(spark, [("2",), ("positive",)], "kind string")
    assert P.detect_label_column(digits, []) == "kind" and P.detect_label_column(digits, [], training=True) is None
    only_ids = prof(spark, [("abcdefghijkl", 1)], "user_id string, n long")
    assert P.detect_text_columns(only_ids) == ["user_id", "n"]        # longest columns
    assert P.detect_text_columns(only_ids, training=True) == ["user_id"]
    short = prof(spark, [("ab", "cd", 1)], "uuid string, memo string, n long")
    assert P.detect_text_columns(short) == ["memo"]
    many = [f"answer_{i}" for i in range(13)]
    wide = prof(spark, [tuple(f"a long enough answer {i}" for i in range(13))], ", ".join(f"{c} string" for c in many))
    assert sorted(P.detect_text_columns(wide)) == sorted(many) and len(P.detect_text_columns(wide, max_cols=12)) == 12


def test_pairs(spark):
    p = prof(spark, [(1, "some text", 0, "other text", -1, "third text", 1)], "`a` long, `a.1` string, `lab work` long, ` lab work` string, c long, c_comments string, Title long")
    assert P.detect_rating_text_pairs(p) == [("a", "a.1", "a"), ("lab work", " lab work", "lab_work"), ("c", "c_comments", "c")]
    one = prof(spark, [(1, "text", 5)], "a long, a_text string, b long")
    assert P.detect_rating_text_pairs(one) == []


def test_two_ratings_that_want_one_text():
    rating = lambda name: P.ColumnProfile(name, False, 5, 1.0, -1.0, 1.0, True, False, False, True)
    text = lambda name: P.ColumnProfile(name, True, 5, 20.0, None, None, False, False, False, False)
    table = [rating("lab"), rating(" Lab"), text(" lab"), text("Lab"), rating("x"), text("x.1"), text("x_text")]
    assert P.detect_rating_text_pairs(table) == [("lab", "Lab", "lab"), (" Lab", " lab", "lab"), ("x", "x.1", "x")]
    shared = [rating("a"), rating("A"), text("a_text"), text("A"), text("A_text")]  # "A" is a rating and a text
    assert [r[:2] for r in P.detect_rating_text_pairs(shared)] == [("a", "A"), ("A", "A_text")]


def test_lexicon_file(spark, tmp_path):
    path = write(tmp_path / "lex.csv", [["B", "second, one"], ["A", "first"], ["B", "third"]], ["category", "phrase"])
    assert list(files.read_lexicon(spark, path).items()) == [("B", ["second, one", "third"]), ("A", ["first"])]


@pytest.fixture(scope="module")
def scored(spark, sf_dir, tmp_path_factory):
    from feedback_signals.catalog import frames

    path = str(tmp_path_factory.mktemp("scored"))
    sinks.save_scored(frames.scored(spark, sf_dir), path, "r1")
    sinks.save_scored(frames.scored(spark, sf_dir).limit(3), path, "r2")
    sinks.save_scored(frames.scored(spark, sf_dir), path, "r1")
    return path


def read_back(spark, path):
    return spark.read.options(header=True, escape='"', multiLine=True).csv(path)


def test_scored_runs(spark, sf_dir, scored):
    rows = files.load_scored(spark, scored, "r1")
    assert rows.count() == 200 and files.load_scored(spark, scored, "r2").count() == 3
    assert "run_id=r1" in str(rows.inputFiles()) or "PartitionFilters: [isnotnull(run_id" in rows._jdf.queryExecution().toString()


def test_exports(spark, scored, tmp_path):
    df = files.load_scored(spark, scored, "r1")
    texts = {r.row_id: r.text for r in df.collect()}
    sinks.export_full(df, str(tmp_path / "full"))
    full = {int(r.row_id): r.text for r in read_back(spark, str(tmp_path / "full")).collect()}
    assert full.keys() == texts.keys()
    assert all((full[i] or "").replace("\r\n", "\n") == (texts[i] or "").replace("\r\n", "\n") for i in texts)
    sinks.export_minority(df, str(tmp_path / "min"))
    assert read_back(spark, str(tmp_path / "min")).count() == df.filter("is_minority_pattern").count()
    sinks.export_by_label(df, str(tmp_path / "labels"))
    per = {r.label: r["count"] for r in read_back(spark, str(tmp_path / "labels")).groupBy("label").count().collect()}
    assert per == {r.prediction: r["count"] for r in df.groupBy("prediction").count().collect()}
    with pytest.raises(ValueError):
        sinks.export_by_label(df, str(tmp_path / "none"), "No_Such_Label")
    named = df.withColumn("label", F.lit("mine"))
    sinks.export_by_label(named, str(tmp_path / "named"))
    back = read_back(spark, str(tmp_path / "named"))
    assert {r.label for r in back.collect()} == {"mine"} and "label_1" in back.columns
    names = sinks.export_course_split(df, str(tmp_path / "course"), "entity")
    assert len(names) == 8
    summary = read_back(spark, str(tmp_path / "course" / "dimension_summary"))
    assert summary.count() == df.select("entity").distinct().count()
    alerts = sinks.read_output(df, str(tmp_path / "course"), "priority_alerts")
    first = sorted(df.collect(), key=lambda r: (r.priority_score is None, -(r.priority_score or 0), r.row_id))[:100]
    assert {int(r.row_id) for r in alerts.collect()} == {r.row_id for r in first} and alerts.columns == df.columns
    assert len(sinks.export_peer_split(df, str(tmp_path / "peer"))) == 5
    sinks.export_queue(df, str(tmp_path / "q"), "mismatch", kind="HIGH_MISMATCH")
    queue = read_back(spark, str(tmp_path / "q"))
    assert queue.columns == ["text", "prediction", "confidence", "mismatch_type"]
    assert queue.count() == df.filter("mismatch_type = 'HIGH_MISMATCH'").count()
    sinks.export_report(df, str(tmp_path / "report"), C.S2P)
    report = spark.read.json(str(tmp_path / "report")).first()
    assert report.summary.total == 200 and report.label_count == df.select("prediction").distinct().count()


def test_split_in_one_scan(spark, scored, tmp_path):
    df = files.load_scored(spark, scored, "r1").withColumns({
        "output": F.lit("mine"), "priority_score": F.when(F.col("row_id") % 3 == 0, F.col("priority_score")),
    })
    rules = sinks.course_routes(df)
    routed = sinks.route(df, rules, "output_1")
    per = {r.output_1: r["count"] for r in routed.groupBy("output_1").count().collect()}
    alone = {name: df.filter(rule).count() for name, rule in rules.items()}
    assert per == {name: n for name, n in alone.items() if n} and per["priority_alerts"] == 100
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 4  # rows and bound; the plan text may name each twice
    folder = str(tmp_path / "split")
    sinks.export_split(df, folder, C.S2P, "entity")
    for name, n in alone.items():
        back = sinks.read_output(df, folder, name)
        assert back.count() == n and {r.output for r in back.collect()} <= {"mine"}
    nothing = df.filter("false")
    sinks.export_split(nothing, folder, C.S2S)
    assert sinks.read_output(nothing, folder, "priority_alerts").count() == 0


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for run, at, name in (("a", 1, "x.csv"), ("b", 3, "y.csv"), ("a", 5, "x2.csv")):
        runs.append_run(path, spark.createDataFrame([(run, at, name, C.S2S)], "run_id string, finished_at long, filename string, mode string"))
    log = spark.read.parquet(path)
    assert [r.filename for r in runs.latest_runs(log).collect()] == ["x2.csv", "y.csv"]
    assert [r.run_id for r in runs.latest_runs(log, search="Y.CS").collect()] == ["b"]
    assert named("a.b") is not None
