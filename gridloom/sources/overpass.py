"""Map features over HTTP as a Spark data source: a box is fetched by tiles, each kept in a cache with a lifetime.

Tiles are dealt to a few lanes, tasks that ask one tile after another with a pause before each request, so that a public
server sees no more than so many clients. A tile whose cached answer is fresh isn't asked for. An answer goes to a file
of its own attempt, which is then moved into place, so that readers see whole answers, whichever attempt wins. If all
tries fail, the stale answer serves, and the tile says so; without one its body is null, and other tiles don't suffer.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.sources import osm


class Lane(InputPartition):
    def __init__(self, boxes: list[tuple[float, ...]]) -> None:
        self.boxes = boxes


class OverpassReader(DataSourceReader):
    """Options: url, folder (of the cache), name, query (with {box}), west, south, east, north, tile (degrees), days (a cached answer's lifetime), tries, wait and timeout (seconds), lanes."""

    def __init__(self, options: dict) -> None:
        get = lambda k, default: type(default)(options.get(k, default))
        self.url, self.folder, self.name, self.query = (options[k] for k in ("url", "folder", "name", "query"))
        self.box = [float(options[k]) for k in ("west", "south", "east", "north")]
        self.tile, self.days, self.tries, self.wait, self.timeout, self.lanes = get("tile", 1.0), get("days", 7.0), get("tries", 3), get("wait", 2.0), get("timeout", 180.0), get("lanes", 2)

    def partitions(self) -> list[Lane]:
        west, south, east, north = self.box
        tiles = []
        for i in range(max(1, math.ceil((north - south) / self.tile))):
            for j in range(max(1, math.ceil((east - west) / self.tile))):
                low, left = south + i * self.tile, west + j * self.tile
                tiles.append((left, low, min(east, left + self.tile), min(north, low + self.tile)))
        return [Lane(tiles[k :: self.lanes]) for k in range(min(self.lanes, len(tiles)))]

    def read(self, partition: Lane) -> Iterator[tuple]:
        store, at = fs.FileSystem.from_uri(self.folder)
        store.create_dir(at, recursive=True)
        for box in partition.boxes:
            west, south, east, north = box
            query = self.query.replace("{box}", f"{south},{west},{north},{east}")
            path = f"{at}/{self.name}_{hashlib.sha256(query.encode()).hexdigest()[:16]}.json"
            info = store.get_file_info(path)
            there = info.type == fs.FileType.File
            fresh = there and (datetime.now(UTC) - info.mtime).total_seconds() < self.days * 86400
            status, body = "cached" if fresh else "fetched", None if fresh else self._ask(query)
            if fresh or (body is None and there):
                status = "cached" if fresh else "stale"
                with store.open_input_stream(path) as f:
                    body = f.read().decode()
            elif body is None:
                status = "missing"
            else:
                with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
                    f.write(body.encode())
                store.move(part, path)
            yield (*box, status, body)

    def _ask(self, query: str) -> str | None:
        """The answer, if it is JSON with elements; each further try waits twice as long."""
        for k in range(self.tries):
            time.sleep(self.wait * 2**k)
            try:
                data = urllib.parse.urlencode({"data": query}).encode()
                with urllib.request.urlopen(urllib.request.Request(self.url, data), timeout=self.timeout) as answer:  # noqa: S310
                    body = answer.read().decode()
                if isinstance(json.loads(body).get("elements"), list):
                    return body
            except (OSError, ValueError, AttributeError):
                continue
        return None


class Overpass(DataSource):
    @classmethod
    def name(cls) -> str:
        return "overpass"

    def schema(self) -> str:
        return "west double, south double, east double, north double, status string, body string"

    def reader(self, schema: object) -> OverpassReader:
        return OverpassReader(self.options)


def fetched(spark: SparkSession, url: str, folder: str, name: str, query: str, west: float, south: float, east: float, north: float, **options: object) -> DataFrame:
    """A row for each tile of the box: its sides, status (cached, fetched, stale or missing) and body, the answer to query."""
    spark.dataSource.register(Overpass)
    return spark.read.format("overpass").options(url=url, folder=folder, name=name, query=query, west=west, south=south, east=east, north=north, **options).load()


def features(tiles: DataFrame) -> DataFrame:
    """The ways of fetched tiles, as osm.ways() gives them; one that several tiles have comes once."""
    rows = tiles.filter("body is not null").select(F.from_json("body", osm.SCHEMA).alias("b")).select(F.inline("b.elements"))
    return osm.ways(rows.dropDuplicates(["type", "id"]))
