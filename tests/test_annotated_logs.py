"""Annotated logs: read once, names and order as Spark reads them back."""

import os

from pyspark.sql import functions as F

from logicspark.sources import sinks, tables

HEAD = "Nr,Zeit [ns],MOSI,note\n"


def test_logs_are_read_and_listed_once(spark, tmp_path):
    for n in range(40):
        (tmp_path / f"log{n}").mkdir()
        (tmp_path / f"log{n}" / "a.csv").write_text(HEAD + f"1,10,600081,first {n}\n2,20,zz,\n")
    (tmp_path / "log0" / "a.csv").write_text("")
    spark.sparkContext.setJobGroup("logs", "logs")
    try:
        rows = tables.read_log_rows(spark, str(tmp_path / "*" / "a.csv"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("logs")]
    tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    assert sum(t >= 39 for t in tasks) == 1
    assert rows.columns == ["log_id", "seq", "id", "time_text", "mosi_text", "note"]
    seen = spark.sparkContext.accumulator(0)

    def counted(note):
        seen.add(1)
        return note

    out = str(tmp_path / "out")
    sinks.write_annotated_csv(rows.withColumn("note", F.udf(counted, "string")("note")), out)
    assert seen.value == 78
    back = spark.read.csv(out, header=True)
    assert back.columns == ["Nr", "Zeit [ns]", "MOSI", "note", "Description", "file"] and back.count() == 78
    assert back.filter("file = 'log7/a_annotated'").orderBy("Nr").first().note == "first 7"


def test_parts_names_and_overwrite(spark, tmp_path):
    """A log of several parts stays in order; odd names and cells come back; a second call leaves nothing of the first."""
    out, names = str(tmp_path / "out"), ["a", "c 0/x=%41ä", "q'[1]{2}:*?\"#^\\"]
    notes = ["plain", "a, b", 'say "x"', "", None, " led", "tail ", "a\\b", "two\nlines", "ä"]
    data = [(n, k * 20_000, str(k), None, "600000", v) for n in names for k, v in enumerate(notes)]
    rows = spark.createDataFrame(data, "log_id string, seq long, id string, time_text string, mosi_text string, note string")
    want = rows.repartition(7)
    sinks.write_annotated_csv(want, out)
    back = spark.read.csv(out, header=True, multiLine=True)
    plain = str(tmp_path / "plain")
    named = sinks.annotate_log(rows).withColumn("file", F.concat("log_id", F.lit("_annotated"))).drop("log_id", "seq")
    named.coalesce(1).write.partitionBy("file").csv(plain, header=True)
    assert sorted(back.collect(), key=repr) == sorted(spark.read.csv(plain, header=True, multiLine=True).collect(), key=repr)
    assert sorted(os.listdir(out)) == sorted(n for n in os.listdir(plain) if n.startswith("file="))
    folder = tmp_path / "out" / "file=a_annotated"
    texts = [p.read_text() for p in sorted(folder.iterdir())]
    assert len(texts) == 3 and all(t.startswith("id,time_text,mosi_text,note,Description\n") for t in texts)
    ids = [x[0] for t in texts for x in t.split("\n")[1:] if x[:1].isdigit()]
    assert ids == [str(k) for k in range(len(notes))]
    sinks.write_annotated_csv(rows.filter("log_id = 'a' and seq = 0"), out)
    assert os.listdir(out) == ["file=a_annotated"] and spark.read.csv(out, header=True).count() == 1
