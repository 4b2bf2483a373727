"""Quoted text cut into splits, positions, schemas of all files, and tables that grow while they are read."""

import csv
import glob
import random

import pytest
from evalspark.operators import incremental, metrics, pipeline
from evalspark.sources import folders, records
from evalspark.sources import results as files
from evalspark.sources.saved import SavedTable
from evalspark.sources.schema import RESULT_COLUMNS
from test_runs import replies

PIECES = ["x", '"', "\n", ",", " ", "é", "y\n", "\r\n", '""', "\\", "'", "👍"]


@pytest.fixture
def splits(spark):
    """Sets how many bytes a split has."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def cut(size):
        for name in names:
            spark.conf.set(name, size)

    yield cut
    for name in names:
        spark.conf.unset(name)


def write_csv(folder, seed, end, quoting, bom=False, n=30, names=("a", "b", "it's c")):
    dice, rows = random.Random(seed), []
    folder.mkdir()
    for k in range(3):
        with open(folder / f"f{k}.csv", "w", newline="", encoding="utf-8-sig" if bom else "utf-8") as out:
            writer = csv.writer(out, lineterminator=end, quoting=quoting)
            writer.writerow(names)
            for _ in range(n if k else 1):
                row = ["".join(dice.choice(PIECES) for _ in range(dice.choice([0, 1, 3, 9]))) for _ in names]
                row = row if any(row) else ["q", *row[1:]]
                writer.writerow(row)
                rows.append(tuple(row))
                if dice.random() < 0.1:
                    out.write(end)  # a blank line is no row
    return rows


def texts(rows):
    return sorted((r[0], *("" if x is None else x for x in r[1:])) for r in rows)


@pytest.mark.parametrize(("end", "quoting", "bom"), [
    ("\n", csv.QUOTE_ALL, False), ("\n", csv.QUOTE_MINIMAL, True), ("\r\n", csv.QUOTE_MINIMAL, False), ("\r\n", csv.QUOTE_ALL, True),
])
def test_rows_and_positions_at_any_split(spark, splits, tmp_path, end, quoting, bom):
    rows = [(i, *r) for i, r in enumerate(write_csv(tmp_path / "t", len(end) + bom, end, quoting, bom))]
    for size in ("1g", "200", "31", "5"):
        splits(size)
        found = records.read_csv(spark, str(tmp_path / "t"), ["a", "b", "c"], names=["a", "b", "it's c"])
        assert texts(found.collect()) == rows
    splits("5")
    assert spark.read.text(str(tmp_path / "t")).rdd.getNumPartitions() > 50
    if end == "\n":
        splits("1g")
        whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(str(tmp_path / "t"))
        assert texts((0, *r) for r in whole.collect()) == texts((0, *r[1:]) for r in rows)


def test_csv_refusals(spark, tmp_path):
    (tmp_path / "open").mkdir()
    (tmp_path / "open" / "f.csv").write_text('a,b\n1,"two\n3,4\n')
    with pytest.raises(Exception, match="never closed"):
        records.read_csv(spark, str(tmp_path / "open"), ["a", "b"]).collect()
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "f.csv").write_text("a,b\n1,2\n")
    (tmp_path / "two" / "g.csv").write_text("a,z\n1,2\n")
    with pytest.raises(Exception, match="g.csv is a,z"):
        records.read_csv(spark, str(tmp_path / "two"), ["a", "b"]).collect()
    assert texts(records.read_csv(spark, str(tmp_path / "two"), ["a", "b"], header=False).collect()) == [
        (0, "a", "b"), (1, "1", "2"), (2, "a", "z"), (3, "1", "2")]
    (tmp_path / "none.csv").write_text("")
    assert records.read_csv(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0


def test_no_python_worker_reads_csv(spark, tmp_path):
    write_csv(tmp_path / "t", 1, "\n", csv.QUOTE_ALL)
    plan = records.read_csv(spark, str(tmp_path / "t"), ["a", "b", "c"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_results_without_row_numbers(spark, splits, tmp_path):
    results = pipeline.evaluate(replies(spark)).orderBy("row_id")
    files.export_csv(results.select(*RESULT_COLUMNS), str(tmp_path / "csv"))
    for size in ("1g", "64"):
        splits(size)
        again = files.read_results_csv(spark, str(tmp_path / "csv"))
        assert [r.row_id for r in again.orderBy("row_id").collect()] == list(range(6))
        assert metrics.eval_summary(again).first() == metrics.eval_summary(results).first()
    named = [f"old_{c}" for c in RESULT_COLUMNS]
    files.export_csv(results.select(*RESULT_COLUMNS).toDF(*named), str(tmp_path / "named"))
    assert files.read_results_csv(spark, str(tmp_path / "named"), header=named).count() == 6
    assert files.read_results_csv(spark, str(tmp_path / "named"), on_mismatch="empty").count() == 0


def test_question_positions(spark, splits, tmp_path):
    rows = spark.range(1000).selectExpr("id * 7 % 1000 AS row_id", "concat('q', id) AS question", "'t' AS best_answer")
    rows.repartition(5).write.parquet(str(tmp_path / "q"))
    rows.coalesce(1).write.options(header=True).csv(str(tmp_path / "q.csv"))
    expected = [r.question for name in sorted(glob.glob(str(tmp_path / "q/*.parquet"))) for r in spark.read.parquet(name).collect()]
    for size in ("1g", "2k"):
        splits(size)
        found = files.read_questions(spark, str(tmp_path / "q")).orderBy("row_id").collect()
        assert [r.row_id for r in found] == list(range(1000)) and [r.question for r in found] == expected
        assert [r.question for r in files.read_questions(spark, str(tmp_path / "q.csv")).orderBy("row_id").collect()] == [f"q{i}" for i in range(1000)]


def test_every_file_is_guarded(spark, tmp_path):
    results = pipeline.evaluate(replies(spark))
    path = str(tmp_path / "t")
    files.write_results(results, path)
    assert files.read_results(spark, path).count() == 6
    for name, wrong in (("less", results.drop("reason")), ("other", results.withColumn("similarity", results.similarity.cast("string")))):
        folder = str(tmp_path / name)
        files.write_results(results.repartition(3), folder)
        wrong.select("row_id", *(c for c in RESULT_COLUMNS if c in wrong.columns)).coalesce(1).write.mode("append").parquet(folder)
        with pytest.raises(ValueError, match="several schemas.*1 files such as file:.*parquet"):
            files.read_results(spark, folder)
        assert files.read_results(spark, folder, "empty").count() == 0
    assert files.footers(spark, path).select("schema").distinct().count() == 1


def saved(spark, folder, n=300):
    results = pipeline.evaluate(replies(spark, n)).select("row_id", *RESULT_COLUMNS)
    table = SavedTable(spark, str(folder), results.schema)
    for k in range(6):
        assert table.append(results.where(f"row_id DIV 50 = {k}").coalesce(1), f"b{k}")
    return results, table


def sorted_rows(frame):
    return sorted(map(tuple, frame.select("row_id", *RESULT_COLUMNS).collect()), key=str)


def test_saved_batches(spark, tmp_path):
    results, table = saved(spark, tmp_path / "t")
    everything = sorted_rows(results)
    assert sorted_rows(table.read()) == everything and table.version() == 6
    assert not table.append(results, "b3") and table.version() == 6
    reader = table.read()  # begun before the compaction
    assert table.compact() == 6 and table.listed().count() == 1
    assert sorted_rows(table.read()) == everything == sorted_rows(reader)
    assert not table.append(results, "b3") and table.compact() == 0
    with pytest.raises(ValueError, match="comma"):
        table.append(results, "a,b")
    empty = SavedTable(spark, str(tmp_path / "none"), results.schema)
    assert empty.read().count() == 0 and empty.version() == 0 and empty.compact() == 0


def test_put_replaces_its_batch(spark, tmp_path):
    results, table = saved(spark, tmp_path / "t")
    table.put(results.where("row_id = 7"), "b1")
    assert sorted(r.row_id for r in table.read().collect()) == sorted([7, *range(50), *range(100, 300)])


def test_fill_rewrites_touched_files_only(spark, tmp_path):
    results, table = saved(spark, tmp_path / "t")
    before = {r.file for r in table.listed().collect()}
    late = spark.createDataFrame(
        [(61, "new", True, True), (63, "new", True, False), (62, "not needed", True, True)],
        "row_id long, base_answer string, base_correct boolean, base_judged boolean",
    )
    assert table.fill(late) == 1
    after = {r.file for r in table.listed().collect()}
    assert len(before & after) == 5 and len(after) == 6
    assert sorted_rows(table.read()) == sorted_rows(incremental.fill_merge(results, late))
    assert table.fill(late) == 0 and table.version() == 7
    assert not table.append(results, "b1")


def test_a_crash_before_the_version_changes_nothing(spark, tmp_path, monkeypatch):
    results, table = saved(spark, tmp_path / "t")
    late = spark.createDataFrame([(61, "new", True, True)], "row_id long, base_answer string, base_correct boolean, base_judged boolean")

    def crash(*_):
        raise RuntimeError("lost")

    for action in (lambda t: t.fill(late), lambda t: t.compact(), lambda t: t.append(results, "b9")):
        with monkeypatch.context() as patch:
            patch.setattr(SavedTable, "_commit", crash)
            with pytest.raises(RuntimeError):
                action(table)
        assert sorted_rows(table.read()) == sorted_rows(results)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        table._commit(table.listed(), 3)  # another writer was first
    assert table.fill(late) == 1 and table.compact() == 6


def test_shared_folder(spark, monkeypatch):
    assert folders.fresh_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir") + "/x-")
    conf = {"spark.master": "local[8]"}
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: conf.get(key, default))
    assert folders.shared_folder(spark) == folders.shared_folder(spark)
    for master in ("local-cluster[3,2,1000]", "yarn", "spark://host:7077", "k8s://x"):
        conf["spark.master"] = master
        with pytest.raises(ValueError, match="checkpoint.dir"):
            folders.shared_folder(spark)
