"""CSV import, its error gate, and the three sinks."""

import csv
import glob
import os
import random

import pytest

from twinframe.plans.files import import_csv, reset, synthesize_csv, synthesize_table
from twinframe.sources.csv import output_paths, read_csv, read_csv_errors
from twinframe.sources.records import file_records
from twinframe.sources.scratch import cut_lineage, run_folder, scratch_scope, shared_folder


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as file:
        file.write(text)
    return path


def test_rows_keep_file_order_over_many_splits(spark, tmp_path):
    folder = tmp_path / "many.csv"
    os.mkdir(folder)
    for part in range(5):
        rows = "\n".join(f"{part * 400 + n},w{n}" for n in range(400))
        write(folder, f"part-{part}.csv", f"a,b\n{rows}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = read_csv(spark, str(folder)).orderBy("row_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.row_idx for r in rows] == list(range(2000))
    assert [int(r.a) for r in rows] == list(range(2000))


def test_loose_cells_are_typed_by_column(spark, tmp_path):
    lines = [f"{n},{n / 4},{'yes' if n % 3 else 'n/a'},TRUE" for n in range(60)]
    lines[3], lines[7] = 'null,"1,5",no,false', ",Continuous,no,true"
    path = write(tmp_path, "loose.csv", "id,amount,answer,flag\n" + "\n\n".join(lines) + "\n")
    loose = import_csv(spark, path)
    kinds = {c.column: (c.type, c.unique_count, c.precision) for c in loose.columns}
    assert kinds["id"] == ("numerical", 58, 0)
    assert kinds["amount"][0] == "categorical"  # a word among the first fifty cells
    assert kinds["answer"] == ("categorical", 2, 0) and kinds["flag"][1] == 2
    rows = loose.rows.orderBy("row_idx").collect()
    assert len(rows) == 60 and rows[3].id is None and rows[7].amount is None and rows[0].answer is None
    assert rows[2].amount == "0.5" and rows[2].flag == "true" and rows[3].amount == "1,5"


@pytest.mark.parametrize("bad", ["3", "1,2,3"])
def test_malformed_rows_reject_the_import(spark, tmp_path, bad):
    path = write(tmp_path, "bad.csv", f"a,b\n1,2\n{bad}\n")
    assert [r._broken_row for r in read_csv_errors(spark, path).collect()] == [bad]
    with pytest.raises(Exception, match="(?i)malformed"):
        import_csv(spark, path)


def test_quotes_and_separators(spark, tmp_path):
    path = write(tmp_path, "q.csv", 'a;b\n"x ""y""; z";1\n" s ";2\n')
    assert [r.a for r in read_csv(spark, path, sep=";").orderBy("row_idx").collect()] == ['x "y"; z', " s "]
    path = write(tmp_path, "lines.csv", 'a,b\n"x\ny",1\nz,2\n')
    assert [r.a for r in read_csv(spark, path, multi_line=True).orderBy("row_idx").collect()] == ["x\ny", "z"]


def test_from_csv_to_all_three_results(spark, tmp_path):
    lines = "\n".join(f"{n % 37},{(n * 7 % 101) / 10},{'ab'[n % 2]}" for n in range(200))
    path = write(tmp_path, "patients.csv", f"age,dose,arm\n{lines}\n")
    report = synthesize_csv(spark, path, 300, 5, str(tmp_path))
    paths = output_paths(str(tmp_path), path)
    made = spark.read.csv(paths["synthetic"], header=True)
    assert made.columns == ["age", "dose", "arm"] and made.count() == 300
    summary = spark.read.csv(paths["summary"], header=True).collect()
    assert [(r.Variable, r.Type) for r in summary] == [("age", "numerical"), ("dose", "numerical"), ("arm", "categorical")]
    (file,) = glob.glob(f"{paths['report']}/part-*")
    text = open(file).read().split("\n")
    assert text[0] == "Statistical Comparison Report" and "age:" in text and text.index("age:") < text.index("dose:")
    assert os.path.basename(paths["summary"]) == "stats_summary_patients.csv"
    assert report.summary().first().total_numerical == 2


def test_reset_deletes_the_run_and_keeps_results(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("twinframe.sources.scratch._runs", {})
    path = write(tmp_path, "r.csv", "a,b\n" + "".join(f"{n % 13},{'xy'[n % 2]}\n" for n in range(60)))
    synthesize_csv(spark, path, 20, 5, str(tmp_path))
    folder = run_folder(spark)
    assert os.path.isdir(folder)
    reset(spark)
    assert not os.path.exists(folder)
    assert spark.read.csv(output_paths(str(tmp_path), path)["synthetic"], header=True).count() == 20


def test_a_blocked_synthesis_leaves_only_its_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("twinframe.sources.scratch._runs", {})
    path = write(tmp_path, "s.csv", "a,b,c\n" + "".join(f"{n % 13},{'xy'[n % 2]},{'uvw'[n % 3]}\n" for n in range(60)))
    loose = import_csv(spark, path)
    folder = run_folder(spark)
    held = set(os.listdir(folder))
    assert len(held) == 2  # the profile and the typed rows
    made = synthesize_table(loose, 30, 5, strategy="blocked", rows_per_block=8)
    assert len(set(os.listdir(folder)) - held) == 1 and made.count() == 30 and loose.rows.count() == 60
    with pytest.raises(ZeroDivisionError), scratch_scope(spark):
        cut_lineage(spark.range(1))
        1 / 0
    assert len(os.listdir(folder)) == 3


@pytest.mark.parametrize("bad", ['"x"y,2', '"x,2'])
def test_quote_errors_reject_the_import(spark, tmp_path, bad):
    path = write(tmp_path, "quotes.csv", f"a,b\n1,2\n{bad}\n")
    with pytest.raises(Exception, match="(?i)malformed|not closed|unescaped quote"):
        import_csv(spark, path)


def test_line_breaks_inside_quotes_are_found(spark, tmp_path):
    path = write(tmp_path, "one.csv", 'a\n"x\n\ny"\n\nz\n')
    assert [r.a for r in read_csv(spark, path).orderBy("row_idx").collect()] == ["x\n\ny", "z"]


@pytest.mark.parametrize(
    ("text", "bad"),
    [
        ("1,2\n5,6", []),
        ('"x\ny",1\nz,2', []),
        ('"x ""y"", z",1\na"b"c,2\n,\n"",3', []),
        ("1,2\n3", ["3"]),
        ("1,2,3\n4,5", ["1,2,3"]),
        ('1,2\n"x"y,2\n5,6', ['"x"y,2']),
        ('"x"y\n"u","v"w,1\n5,6', ['"x"y', '"u","v"w,1']),
        ('1,2\n"x,2', ['"x,2']),
        ('"x\ny",1\nz\n"q\nr",5,6', ["z", '"q\nr",5,6']),
        ("1," + "7" * 100_000 + '\n"' + 'k""' * 50_000 + '",1', []),
    ],
)
def test_the_error_list_agrees_with_the_import(spark, tmp_path, text, bad):
    path = write(tmp_path, "any.csv", f"a,b\n{text}\n")
    assert sorted(r._broken_row.strip() for r in read_csv_errors(spark, path).collect()) == sorted(bad)
    if bad:
        with pytest.raises(Exception, match="(?i)malformed|not closed|unescaped quote"):
            read_csv(spark, path).count()
    else:
        assert read_csv(spark, path).count() == 2 + text.startswith('"x ""y""') * 2


class Session:
    """As much of a session as the scratch folder asks for."""

    def __init__(self, master, folder):
        self.sparkContext = self
        self.conf = {"spark.checkpoint.dir": folder}
        self.master, self.applicationId = master, "app-1"


def test_scratch_folder():
    assert shared_folder(Session("yarn", "/shared")) == "/shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session("yarn", None))
    made = shared_folder(Session("local[2]", None))
    assert os.path.isdir(made) and made == shared_folder(Session("local[2]", None))


def test_a_file_with_quoted_line_breaks_is_read_by_many_tasks(spark, tmp_path):
    """Records that cross slices, one that fills several of them, blank lines, a header with a break, both line ends."""
    draw = random.Random(5)
    folder = tmp_path / "broken.csv"
    os.mkdir(folder)
    wanted = []
    for part in range(2):
        rows = [[f"{part}-{n}", draw.choice(["x", 'a "b" c', "p\nq", "p\r\n\n,q", '"', "\n" * 40, ""]), "z" * draw.randrange(60)] for n in range(300)]
        rows[150][1] = "long\n" * 1500
        wanted += rows
        with open(folder / f"part-{part}.csv", "w", newline="") as file:
            lines = csv.writer(file, lineterminator="\r\n" if part else "\n")
            lines.writerow(["a", "b\nb", "c.d"])
            for n, row in enumerate(rows):
                lines.writerow(row)
                if n % 50 == 7:
                    file.write("\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert file_records(spark, str(folder)).where("NOT is_header").select("file").distinct().count() == 2
        assert spark.read.text(str(folder), lineSep="\n").rdd.getNumPartitions() > 20
        rows = read_csv(spark, str(folder)).orderBy("row_idx").collect()
        assert read_csv_errors(spark, str(folder)).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.row_idx for r in rows] == list(range(600))
    assert [[x or "" for x in r[:3]] for r in rows] == wanted
    assert rows[0].__fields__ == ["a", "b\nb", "c.d", "row_idx"]


@pytest.mark.parametrize(
    ("text", "bad"),
    [
        ('"x\ny",1\n"u"v,2\n3,4', ['"u"v,2']),
        ('"x\ny",1\n5" disk,2\n3,4\n6" disk,7', ['5" disk,2\n3,4\n6" disk,7']),
        ('5" disk,2\n3,4', ['5" disk,2\n3,4']),
    ],
)
def test_stray_quotes_among_quoted_line_breaks_are_listed(spark, tmp_path, text, bad):
    path = write(tmp_path, "stray.csv", f"a,b\n{text}\n")
    assert [r._broken_row.strip() for r in read_csv_errors(spark, path).collect()] == bad
    with pytest.raises(Exception, match="(?i)malformed|not closed|unescaped quote"):
        read_csv(spark, path).count()


def test_headers_that_differ_are_rejected(spark, tmp_path):
    folder = tmp_path / "two.csv"
    os.mkdir(folder)
    write(folder, "1.csv", 'a,b\n"x\ny",1\n')
    write(folder, "2.csv", "a,c\nz,1\n")
    with pytest.raises(ValueError, match="headers differ"):
        read_csv(spark, str(folder))
