import http.server
import threading

import pytest

import __spark_entry__ as entry
from pathloom.meta import TableMeta
from pathloom.operators.table import KeyedTable
from pathloom.errors import HttpStatus
from pathloom.plans.catalog import http_fetch
from pathloom.streaming.lookup import lookup_stream, promote_stream


def test_lookup_and_promote_streams(spark, tmp_path):
    table = KeyedTable(spark.createDataFrame([(1, "a"), (2, "b"), (2, "aa")], "key long, path string"), TableMeta())
    spark.createDataFrame([(1,), (2,), (9,)], "key long").write.parquet(str(tmp_path / "in"))
    stream = lookup_stream(spark.readStream.schema("key long").parquet(str(tmp_path / "in")), table)
    promote_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {(r["key"], r["path"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "a"), (2, "aa")}


def test_http_fetch():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/base/manifest.json" else 404)
            self.end_headers()
            self.wfile.write(b"body")

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    fetch = http_fetch(f"http://127.0.0.1:{server.server_port}/base/")
    assert fetch("manifest.json") == b"body"
    with pytest.raises(HttpStatus):
        fetch("missing")
    server.shutdown()


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"lookup_batch", "lookup_layered", "hunt_round", "arena_layout"} <= set(sql)


def test_absent_modules_are_told_from_broken_ones(tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "half_there").mkdir()
    (tmp_path / "half_there/__init__.py").write_text("import nothing_of_that_name")
    assert entry._optional("not_there.at_all") is None
    with pytest.raises(ModuleNotFoundError):
        entry._optional("half_there")


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"key", "path", "hit"} == set(rows[0].asDict())
