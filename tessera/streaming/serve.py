"""JSON-lines requests (status, sync, search, fetch) and continuous indexing of arriving files."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import IO

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.engine import Engine
from tessera.operators.index import assemble, tokenized, write_index
from tessera.sources.tokens import TokenStore

#: Bytes of a request line, newline included.
MAX_REQUEST = 1 << 20


def read_request(stream: IO[bytes]) -> tuple[bytes | None, bool]:
    """(line, too long): None at the end; a line over the limit is drained."""
    line = stream.readline(MAX_REQUEST + 1)
    if not line:
        return None, False
    if len(line) <= MAX_REQUEST:
        return line, False
    while line and not line.endswith(b"\n"):
        line = stream.readline(MAX_REQUEST)
    return b"", True


def respond(engine: Engine, line: bytes) -> dict:
    """The response envelope of one request; errors never end the session."""
    text = line.decode("utf-8", "replace").strip()
    if not text:
        return {"ok": False, "op": "", "error": "invalid request: empty"}
    try:
        request = json.loads(text)
        if not isinstance(request, dict):
            raise ValueError("not an object")
    except ValueError as e:
        return {"ok": False, "op": "", "error": f"invalid request: {e}"}
    op = request.get("op", "")
    handlers: dict[str, Callable[[], object]] = {
        "status": engine.status,
        "sync": engine.sync,
        "search": lambda: engine.search(request["q"], int(request.get("top_k") or 0)),
        "fetch": lambda: engine.fetch([int(i) for i in request["ids"]], int(request.get("max_lines") or 0)),
    }
    if op not in handlers:
        return {"ok": False, "op": "", "error": f"unknown op: {op}"}
    if op == "search" and not str(request.get("q") or "").strip():
        return {"ok": False, "op": op, "error": "q is required"}
    if op == "fetch" and not request.get("ids"):
        return {"ok": False, "op": op, "error": "ids are required"}
    try:
        return {"ok": True, "op": op, "data": handlers[op]()}
    except Exception as e:
        return {"ok": False, "op": op, "error": str(e).splitlines()[0] if str(e) else type(e).__name__}


def serve(engine: Engine, source: IO[bytes], sink: IO[bytes]) -> None:
    """Answer each line until the source ends; a last line without a newline is served too."""
    while True:
        line, too_long = read_request(source)
        if line is None:
            return
        reply = {"ok": False, "op": "", "error": f"request exceeds {MAX_REQUEST} bytes"} if too_long else respond(engine, line)
        sink.write(json.dumps(reply).encode() + b"\n")
        sink.flush()


def index_stream(files: DataFrame, config, entries: str, checkpoint: str) -> StreamingQuery:
    """Take files (path, mtime, size, content) up as they arrive: each batch is one segment of the store of tokens `entries`.

    A path that comes again replaces its entry; of a batch's rows with one path the last changed counts. What a batch
    writes and reads grows with the batch, and with the buckets that it touches when their changes are merged. A batch that
    runs again finds its segment and adds nothing. `publish` makes an index of what the store holds.
    """

    def batch(rows: DataFrame, number: int) -> None:
        latest = Window.partitionBy("path").orderBy(F.desc("mtime"), F.desc("size"), "content")
        once = rows.withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_r")
        TokenStore(rows.sparkSession, entries).apply(tokenized(once, config), name=f"batch-{number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(spark: SparkSession, entries: str, root: str) -> dict:
    """A new version of the index at root, from the store of tokens; returns its record."""
    return write_index(assemble(TokenStore(spark, entries).tokens()), root)
