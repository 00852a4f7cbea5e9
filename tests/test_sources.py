import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from marlstone import cli, config, errors
from marlstone.functions import text as fn
from marlstone.library import Library
from marlstone.operators.embedding import ApiEmbedder, HashEmbedder
from marlstone.sources import files, net
from marlstone.storage.store import Store
from marlstone.streaming.ingest import ingest_stream


@pytest.fixture
def server():
    pages = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, headers, body = pages[self.path]
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            self.do_GET()

        def log_message(self, *_):
            pass

    made = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", pages
    made.shutdown()


def test_addresses():
    public = "8.8.8.8 1.1.1.1 100.63.0.1 2606:4700::1111 2001:4860::1 ::ffff:8.8.8.8".split()
    private = "10.0.0.1 127.0.0.1 169.254.1.1 172.16.0.1 192.168.1.1 100.64.0.1 198.18.0.1 240.0.0.1 224.0.0.1 0.0.0.0 255.255.255.255 192.0.2.1 ::1 fe80::1 fc00::1 2001:db8::1 ::ffff:10.0.0.1 ff02::1 x".split()
    assert all(map(net.is_public_ip, public)) and not any(map(net.is_public_ip, private))
    for url, kind in (("ftp://a.test/", errors.NetworkError), ("http://a.test:99999/", errors.InvalidInput), ("http://localhost/", errors.NetworkError), ("http://x.localhost/", errors.NetworkError), ("http://127.0.0.1/", errors.NetworkError)):
        with pytest.raises(kind):
            net.check_destination(url)


def test_fetch(server, spark):
    url, pages = server
    pages["/a"] = (200, {"Content-Type": "text/html; charset=iso-8859-1"}, "<p>é</p>".encode("latin-1"))
    pages["/r"] = (302, {"Location": "/a"}, b"")
    pages["/loop"] = (302, {"Location": "/loop"}, b"")
    pages["/e"] = (404, {}, b"x" * 2000)
    pages["/big"] = (200, {}, b"x" * 11)
    found = net.fetch(url + "/r", True)
    assert found.final_url == url + "/a" and found.body == "<p>é</p>"
    assert net.fetch(url + "/big", True, limit=11).body == "x" * 11
    for path, word in (("/loop", "redirects"), ("/e", "returned HTTP 404"), ("/big", "exceeded the")):
        with pytest.raises(errors.NetworkError, match=word):
            net.fetch(url + path, True, limit=10)
    with pytest.raises(errors.NetworkError, match="non-public"):
        net.fetch(url + "/a")
    pages["/odd"] = (200, {"Content-Length": "x"}, b"")
    wrong = [url + "/e", url.rsplit(":", 1)[0] + ":x/", "http://[::1/", "no address", url + "/odd\nx"]
    rows = net.fetch_table(spark.createDataFrame([(u,) for u in [url + "/a", None, *wrong]], "u string"), "u", True).select("fetched.*").collect()
    assert [r["error"] is None for r in rows] == [True, True] + [False] * len(wrong)
    assert net.decode(b"\xe9", "text/html; charset=nope") == "�" == net.decode(b"\xe9", "text/html; charset=rot13")
    assert net.decode(b"\x80\x81", "text/html; charset=latin1") == "€\x81" and net.decode(b"\xef\xbb\xbfa", "x/y; charset=latin1") == "a"
    assert net.decode("é".encode("utf-16-le"), "x/y; charset=UTF-16") == "é" and net.decode("é".encode(), "x/y") == "é"
    pages["/v/embeddings"] = (200, {}, b'{"data": [{"index": 0, "embedding": [1.0, 2.0]}]}')
    embedder = ApiEmbedder(url + "/v/", "m", 2, "secret")
    assert embedder.embed(["x"]) == [[1.0, 2.0]] and embedder.embed([]) == [] and "secret" not in repr(embedder)
    assert embedder.fingerprint() == f"api-space-v1|endpoint={url}/v|model=m|dimension=2"
    pages["/v/embeddings"] = (500, {}, b"y" * 3000)
    with pytest.raises(errors.EmbeddingError, match="truncated"):
        embedder.embed(["x"])


def test_detect(spark):
    cases = [
        ("text/markdown; charset=x", None, "<html>", "Markdown", "MediaType"),
        ("TEXT/HTML", "md", "# x", "Html", "MediaType"),
        (None, "mkd", "<html>", "Markdown", "Extension"),
        (None, "xhtml", "", "Html", "Extension"),
        (None, None, "  <!DOCTYPE html>", "Html", "BodySignal"),
        (None, None, "text\n# head", "Markdown", "BodySignal"),
        (None, None, "- a\n- b\n[c](d)", "Markdown", "BodySignal"),
        (None, None, "plain", "Html", "Fallback"),
        (None, None, None, "Html", "Fallback"),
    ]
    rows = spark.createDataFrame([c[:3] for c in cases], "t string, e string, b string").select(fn.detect_format(F.col("t"), F.col("e"), F.col("b")).alias("f")).select("f.*").collect()
    assert [tuple(r) for r in rows] == [c[3:] for c in cases]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\nx")
    (tmp_path / "b.HTM").write_text("<p>y</p>")
    (tmp_path / "c.pdf").write_text("z")
    (tmp_path / "d.markdown").write_text("z")
    rows = {r["raw_source"][-5:]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert rows["/a.md"]["content"] == "# A\n\nx" and rows["b.HTM"]["source_format"] == "Html"
    assert rows["c.pdf"]["error"] == f"not implemented: {errors.PDF_NOT_IMPLEMENTED}" and rows["c.pdf"]["content"] is None
    assert "unsupported file extension 'markdown'" in rows["kdown"]["error"]
    with pytest.raises(errors.NotImplementedFormat):
        files.read_one(str(tmp_path / "c.pdf"))
    with pytest.raises(errors.InvalidInput):
        files.read_one("none")
    library = Library(spark, Store(spark, str(tmp_path / "store")), HashEmbedder(16))
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("# A\n\nx")
    for _ in range(2):
        ingest_stream(spark, library, str(folder), str(tmp_path / "cp")).awaitTermination(60)
    assert library.list().count() == 1


def test_config(tmp_path, capsys):
    path = tmp_path / "c.toml"
    path.write_text('[storage]\npath = "s"\n[embedding]\nendpoint = "https://e"\nmodel = "m"\ndimension = 3\napi_key_env = "K"\napi_key = "file"\n')
    c = config.load(str(path))
    assert (c.store, c.dimension) == ("s", 3) and "file" not in repr(c)
    assert config.resolve_key(c, {"K": "named", config.KEY_VARIABLE: "usual"}.get) == "named"
    assert config.resolve_key(c, {"K": "", config.KEY_VARIABLE: "usual"}.get) == "usual"
    assert config.resolve_key(c, {}.get) == "file"
    with pytest.raises(errors.InvalidInput):
        config.load(str(tmp_path / "none.toml"))
    old = tmp_path / config.LEGACY
    old.mkdir()
    (old / "config.toml").write_text("")
    assert config.default_path(str(tmp_path)) == old / "config.toml" and "legacy" in capsys.readouterr().err


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "c.toml"
    path.write_text(f'[storage]\npath = "{tmp_path}/s"\n')
    note = tmp_path / "n.md"
    note.write_text("# Sea\n\nsalt water")

    def run(*args):
        code = cli.main(["--config", str(path), *args])
        return code, capsys.readouterr()

    assert run("list")[1].out == "(no documents)\n" and run("search", "x")[1].out == "(no results)\n"
    made = run("ingest", str(note))[1].out.strip()
    assert run("search", "salt")[1].out == "[Sea] salt water\n"
    assert run("list")[1].out == f"{made}\tSea\n" and run("emit", made, "text")[1].out == "SEA\n\nsalt water\n"
    assert '"chunk_count": 1' in run("info", made, "--json")[1].out and "[Source: Sea]" in run("context", "salt")[1].out
    assert '"vectors_indexed": 1' in run("rebuild-index", "--json")[1].out and run("remove", made)[1].out == f"removed {made}\n"
    code, said = run("emit", made, "pdf")
    assert code == 1 and "unsupported format" in said.err
