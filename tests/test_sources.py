"""Data sources and streams: addresses, a file for each document, values that earlier micro-batches had."""

import http.server
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from quarry import cli
from quarry.config import ExtractConfig
from quarry.plans.engine import Spec
from quarry.schema import Example, Extraction
from quarry.sinks import files
from quarry.sources import web
from quarry.sources.models import RuleModel
from quarry.streaming.documents import new_values, value_stream

SPEC = Spec("Find numbers", (Example("Call 12", (Extraction("number", "12"),)),))


class Pages(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        self.send_response(200 if self.path != "/gone" else 404)
        self.end_headers()
        self.wfile.write(f"page {self.path}".encode())

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def pages():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_addresses(spark, pages):
    web.register(spark)
    urls = [f"{pages}/{i}" for i in range(9)] + [f"{pages}/gone", "no address"]
    d = spark.read.format("quarry_addresses").option("urls", "\n".join(urls)).option("per_task", "4").load()
    assert d.rdd.getNumPartitions() == 3
    got = d.orderBy("place").collect()
    assert [r.url for r in got] == urls and [r.text for r in got[:9]] == [f"page /{i}" for i in range(9)]
    assert [r.text for r in got[9:]] == [None, None] and "404" in got[9].error and "Not a URL" in got[10].error
    assert spark.read.format("quarry_addresses").load().count() == 0


def found(path):
    """Files in place; what a task that outlives its aborted job stages is none of them."""
    return sorted(os.path.relpath(os.path.join(folder, f), path).split(os.sep, 1)[-1] for folder, _, names in os.walk(path) for f in names if files.STAGED not in folder)


def test_a_file_for_each_document(spark, tmp_path):
    out = str(tmp_path / "out")
    d = spark.createDataFrame([("a/b", "one"), ("é", "two"), (None, "three"), ("é", "four"), ("x", None)], "doc_id string, report string").repartition(2)
    files.write_files(d, out, ".txt")
    assert len(found(out)) == 5 and {"a%2Fb.txt", "x.txt", "none.txt"} <= set(found(out)) and not [n for n in os.listdir(out) if n.startswith(files.STAGED)]
    files.write_files(d.filter("doc_id = 'x'"), out, ".txt", mode="overwrite")
    assert found(out) == ["x.txt"]
    files.write_files(d.limit(0), out, ".txt")
    assert found(out) == ["x.txt"]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    out = str(tmp_path / "out")
    d = spark.range(20).repartition(4).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 13, F.raise_error(F.lit("lost")).cast("string")).otherwise("fine").alias("report"))
    with pytest.raises(Exception, match="lost"):
        files.write_files(d, out)
    assert found(out) == [] and (not os.path.exists(out) or all(n.startswith(files.STAGED) for n in os.listdir(out)))
    files.write_files(d.filter("doc_id <> 13"), out)
    assert len(found(out)) == 19


def test_cli_writes_files(spark, tmp_path, capsys):
    out = str(tmp_path / "reports")
    assert cli.main(["extract", "Ann is 31", "--prompt", "p", "--provider", "rules", "--rule", "number=[0-9]+", "--export", "json", "--output", out, "--files"]) == 0
    (name,) = found(out)
    (folder,) = os.listdir(out)
    with open(os.path.join(out, folder, name)) as f:
        assert json.load(f)["extractions"][0]["extraction_text"] == "31" and name.endswith(".json")


def test_later_batches_drop_known_values(spark, tmp_path):
    folder = tmp_path / "in"
    batches = [[(1, "Ann 3 Bob"), (2, "Ann")], [(1, "bob 3 Cid"), (1, "Cid"), (None, "Dan")], [(1, "Ann 4"), (2, "Cid  Ann"), (3, ""), (None, "dan Eve")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("*.parquet"):
            if not f.name.startswith("b"):
                f.rename(folder / f"b{k}.parquet")
                os.utime(folder / f"b{k}.parquet", (1000 + k, 1000 + k))
    s = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    v = new_values(value_stream(s, SPEC, ExtractConfig(RuleModel({"number": "[0-9]+", "name": "[A-Za-z]{3}"}))))
    q = v.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).outputMode("append").format("parquet").start(str(tmp_path / "out"))
    q.awaitTermination(200)
    assert len(q.recentProgress) >= 3
    got = sorted((str(r.doc_id), r.extraction_text, r.extraction_class, r.start_pos) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted([("1", "Ann", "name", 0), ("1", "3", "number", 4), ("1", "Bob", "name", 6), ("2", "Ann", "name", 0), ("1", "Cid", "name", 0), ("None", "Dan", "name", 0), ("1", "4", "number", 4), ("2", "Cid", "name", 0), ("None", "Eve", "name", 4)])
