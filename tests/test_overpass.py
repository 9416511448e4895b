"""Fetching by tiles against a local server: retries, cache, lifetime, and stale answers when it is down."""

import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs

from gridloom.sources import overpass


class Server(BaseHTTPRequestHandler):
    asked, fails = [], 0

    def do_POST(self):
        query = parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["data"][0]
        Server.asked.append(query)
        if Server.fails > 0:
            Server.fails -= 1
            self.send_error(504)
            return
        south = float(query.split("(")[1].split(",")[0])
        way = lambda k: {"type": "way", "id": k, "tags": {"highway": "primary"}, "geometry": [{"lat": 1, "lon": 2}, {"lat": 2, "lon": 3}]}
        body = json.dumps({"elements": [way(1), way(int(south * 10))]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_fetching_by_tiles(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = lambda **more: overpass.fetched(spark, f"http://127.0.0.1:{server.server_port}", f"{tmp_path}/cache", "roads", "way({box});out geom;", 120.0, 22.0, 121.5, 24.0, **({"wait": 0.01, "tries": 2, "timeout": 5} | more))
    Server.fails = 1
    rows = ask().collect()
    assert len(rows) == 4 and {r.status for r in rows} == {"fetched"} and len(Server.asked) == 5
    assert {(r.west, r.south, r.east, r.north) for r in rows} == {(120.0, 22.0, 121.0, 23.0), (121.0, 22.0, 121.5, 23.0), (120.0, 23.0, 121.0, 24.0), (121.0, 23.0, 121.5, 24.0)}
    assert {r.status for r in ask().collect()} == {"cached"} and len(Server.asked) == 5
    assert sorted(r.feature_id for r in overpass.features(ask()).collect()) == [1, 220, 230]
    assert all(f.endswith(".json") for f in os.listdir(tmp_path / "cache"))
    old = sorted((tmp_path / "cache").iterdir())
    for f in old:
        os.utime(f, (time.time() - 9 * 86400,) * 2)
    server.shutdown()
    server.server_close()
    assert {r.status for r in ask().collect()} == {"stale"}
    old[0].unlink()
    found = {r.status: r for r in ask().collect()}
    assert set(found) == {"stale", "missing"} and found["missing"].body is None
    assert {r.feature_id for r in overpass.features(ask()).collect()} <= {1, 220, 230}
