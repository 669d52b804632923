"""Sinks that commit, and datasets converted whole."""

import io as bytes_io
import json
import os
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brakta import jobs
from brakta.sources import sinks


def files_of(path):
    return {os.path.relpath(os.path.join(d, n), path).split("/", 1)[-1]: open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(path) for n in names if not n.endswith(".crc") and n != "_SUCCESS"}


def test_files_are_there_once_and_whole(spark, tmp_path):
    path = f"{tmp_path}/out"
    rows = spark.createDataFrame([("a.txt", "åäö"), ("b/c.txt", ""), ("_d", None), (None, "x"), ("e.txt", "y" * 100_000)], "name string, content string").repartition(3)
    sinks.save_files(rows, path)
    assert files_of(path) == {"a.txt": "åäö".encode(), "b_c.txt": b"", "-_d": b"", "e.txt": b"y" * 100_000}
    said = json.load(open(f"{path}/_SUCCESS"))
    assert (said["files"], said["bytes"]) == (4, 100_006)
    sinks.save_files(rows.limit(0), path, "append")
    assert len(files_of(path)) == 4
    sinks.save_files(rows.filter("name = 'a.txt'").withColumn("content", F.lit("new").cast("binary")), path)
    assert files_of(path) == {"a.txt": b"new"}
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    assert [bytes(r.content) for r in read.collect()] == [b"new"]
    with pytest.raises(Exception, match="no column"):
        rows.select("name").write.format("brakta_files").mode("append").option("path", path).save()


def test_archives_hold_their_entries_in_order(spark, tmp_path):
    path = f"{tmp_path}/zips"
    rows = spark.createDataFrame([(f"{i % 3}.zip", -i, f"{i:02d}.txt", f"text {i}".encode()) for i in range(40)], "name string, place int, entry string, content binary").repartition(5)
    sinks.save_archives(rows, path)
    got = files_of(path)
    assert set(got) == {"0.zip", "1.zip", "2.zip"}
    for k, data in got.items():
        with zipfile.ZipFile(bytes_io.BytesIO(data)) as z:
            want = [i for i in range(39, -1, -1) if i % 3 == int(k[0])]
            assert z.namelist() == [f"{i:02d}.txt" for i in want] and z.testzip() is None
            assert [z.read(n) for n in z.namelist()] == [f"text {i}".encode() for i in want]


def test_failed_and_doubled_attempts_leave_nothing(tmp_path):
    sink = sinks.Sink(f"file://{tmp_path}", False, False)
    batch = pa.RecordBatch.from_pydict({"name": ["a", "b"], "content": ["1", "2"]})

    def breaks():
        yield batch
        raise OSError("lost")

    with pytest.raises(OSError):
        sink.write(breaks())
    first, again = sink.write(iter([batch])), sink.write(iter([batch]))
    assert not [n for n in os.listdir(tmp_path) if not n.startswith("_")]  # nothing is seen before the commit
    sink.commit([again, None])
    assert sorted(os.listdir(tmp_path)) == ["_SUCCESS", f"part-00000-{sink.job}"] and files_of(tmp_path) == {"a": b"1", "b": b"2"}
    assert first.folder != again.folder
    other = sinks.Sink(f"file://{tmp_path}", False, True)
    other.write(iter([batch]))
    other.abort([])
    assert len(os.listdir(tmp_path)) == 2  # what another save has committed stays


def test_a_failed_task_is_tried_again(tmp_path):
    """In a session of its own: local tasks are tried once unless the master says otherwise."""
    import subprocess
    import sys

    code = f"""
import os
from pyspark import TaskContext
from pyspark.sql import SparkSession
from brakta.sources import sinks
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def flaky(batches):
    for b in batches:
        yield b
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("first attempt")
rows = spark.createDataFrame([(f"f{{i}}", str(i)) for i in range(20)], "name string, content string").repartition(4).mapInArrow(flaky, "name string, content string")
sinks.save_files(rows, {str(tmp_path)!r})
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, env=os.environ | {"PYTHONPATH": f"{os.getcwd()}:{os.environ.get('PYTHONPATH', '')}"}, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert files_of(tmp_path) == {f"f{i}": str(i).encode() for i in range(20)}
    assert not [n for n in os.listdir(tmp_path) if n.startswith("_attempt")]


def test_a_dataset_is_converted_with_copies_and_card(spark, tmp_path):
    rows = [(f"Anna{i} Ek bor i Umeå, skriv till anna{i}@mail.se eller ring", json.dumps({"person": [f"Anna{i} Ek"], "email": [f"anna{i}@mail.se"]}), i % 10 != 9) for i in range(60)]
    rows += [(rows[0][0], rows[0][1], True)] * 2
    spark.createDataFrame(rows, "text string, entities string, entities_validated boolean").coalesce(1).write.parquet(f"{tmp_path}/raw")
    counts = jobs.convert(spark, f"{tmp_path}/raw", f"{tmp_path}/lines", noise_rate=0.2, train=0.5, validation=0.25)
    assert sum(counts.values()) == 2 * 54 and set(counts) == {"train", "val", "test"}
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/lines").collect() if r.value.startswith("{")]
    assert len(lines) == 2 * 54 and all(len(x["output"]["entities"]) > 10 for x in lines)
    assert all(m in x["input"] for x in lines for ms in x["output"]["entities"].values() for m in ms)
    text = open(f"{tmp_path}/lines/dataset_card.md").read()
    assert f"| train | {counts['train']} |" in text and "- noise: 0.2" in text and "| relations |" in text
    by_text = spark.read.text(f"{tmp_path}/lines").filter("value like '{%'").select("split", F.regexp_extract("value", "nna(\\d+)@", 1).alias("who")).filter("who <> ''").distinct()
    assert by_text.groupBy("who").count().filter("count > 1").count() <= 2  # a noisy address may read as another's
    sparse = jobs.convert(spark, f"{tmp_path}/raw", f"{tmp_path}/sparse", dense=False)
    assert sum(sparse.values()) == 54
    some = json.loads(spark.read.text(f"{tmp_path}/sparse").filter("value like '{%'").first().value)
    assert set(some["output"]["entities"]) == {"person", "email"}

    def alike():
        return lambda texts: [(i, [1.0, 0.0] if t.startswith('Anna1') else [0.0, 1.0]) for i, t in enumerate(texts)]

    few = jobs.convert(spark, f"{tmp_path}/raw", f"{tmp_path}/few", threshold=0.99, embedder=alike)
    assert sum(few.values()) == 2
    with pytest.raises(ValueError):
        jobs.convert(spark, f"{tmp_path}/raw", f"{tmp_path}/none", threshold=0.9)
