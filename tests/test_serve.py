import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from millrace.operators import frames
from millrace.operators.index import Catalogue
from millrace.streaming.dataset import Dataset
from millrace.streaming.serve import server


@pytest.fixture(scope="module")
def records(spark):
    df = spark.range(40).select("id", F.col("id").alias("pos"), F.concat(F.lit('{"i":'), F.col("id").cast("string"), F.lit("}")).alias("record"))
    return frames.assign_frames(df.withColumn("nbytes", (F.octet_length("record") + 1).cast("long")), 64).cache()


@pytest.fixture(scope="module")
def address(spark, records, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "a.jsonl"
    path.write_text("x\n")
    running = server(Catalogue(spark, [("one", str(path))]), lambda _: records, tokens=["secret"])
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_address[1]}/v1"
    running.shutdown()


def get(url, token="secret"):
    request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
    with urllib.request.urlopen(request, timeout=120) as r:
        return r.headers, r.read()


def test_catalogue(address):
    assert json.loads(get(f"{address}/health", None)[1]) == {"status": "ok"}
    assert [d["id"] for d in json.loads(get(f"{address}/datasets")[1])] == ["one"]
    assert json.loads(get(f"{address}/datasets/one")[1])["fingerprint"]


@pytest.mark.parametrize("mode", ["none", "index-perm", "chunk-shuffled"])
def test_streams_are_those_of_the_iterator(address, records, mode):
    headers, body = get(f"{address}/streams/one?seed=5&shuffle={mode}&rank=1&world_size=2&unknown=1")
    assert body == b"".join(Dataset(records, mode, 5, rank=1, world_size=2))
    assert headers["X-Seed"] == "5" and headers["X-Shuffle"] == mode
    assert len(get(f"{address}/streams/one?shuffle={mode}&sample=3&epochs=2")[1].splitlines()) == 6


@pytest.mark.parametrize("path, token, status", [("datasets", None, 401), ("datasets", "wrong", 401), ("streams/two", "secret", 404), ("nope", "secret", 404), ("streams/one?shuffle=x", "secret", 400), ("streams/one?seed=x", "secret", 400)])
def test_refusals(address, path, token, status):
    with pytest.raises(urllib.error.HTTPError) as e:
        get(f"{address}/{path}", token)
    assert e.value.code == status
