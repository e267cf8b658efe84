"""Counters of the ingestion, and their export as text that a scraper reads."""

from __future__ import annotations

import threading
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Names of the series (fixed values).
WRITTEN, CONFIRMED = "cdc_records_written", "cdc_confirmed_lsn"


class Metrics:
    """Records written by table, and the highest confirmed position."""

    def __init__(self):
        self.lock, self.written, self.confirmed = threading.Lock(), defaultdict(int), 0

    def record(self, counts: dict[str, int], position: int | None) -> None:
        with self.lock:
            for table, n in counts.items():
                self.written[table] += n
            self.confirmed = max(self.confirmed, position or 0)

    def text(self) -> str:
        """The series in the exposition format."""
        with self.lock:
            lines = [f"# HELP {WRITTEN}_total Change events written to the log", f"# TYPE {WRITTEN}_total counter"]
            lines += [f'{WRITTEN}_total{{table="{t}"}} {n}' for t, n in sorted(self.written.items())]
            lines += [f"# HELP {CONFIRMED} Highest position confirmed", f"# TYPE {CONFIRMED} gauge", f"{CONFIRMED} {self.confirmed}"]
        return "\n".join(lines) + "\n"


def serve(metrics: Metrics, port: int = 9108) -> ThreadingHTTPServer:
    """Serves the series at /metrics from a thread of its own; port 0 takes any free one. Shut it down with ``shutdown``."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            body = metrics.text().encode() if self.path == "/metrics" else b""
            self.send_response(200 if body else 404)
            self.send_header("Content-Type", "text/plain; version=0.0.4")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("", port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def observed(batch: DataFrame, tables: list[str]) -> tuple[DataFrame, Observation]:
    """The batch, and an observation that has rows by table, rows of others and the last position once it is written: no job of its own counts."""
    seen = Observation()
    by_table = [F.count_if(F.col("table_name") == t).alias(t) for t in tables]
    rest = F.count_if(~F.col("table_name").isin(tables)).alias("__other")
    return batch.observe(seen, F.max("lsn_numeric").alias("__position"), rest, *by_table), seen


def counts_of(seen: Observation) -> tuple[dict[str, int], int | None]:
    got = dict(seen.get)
    position, other = got.pop("__position"), got.pop("__other")
    return {t: n for t, n in (*got.items(), ("other", other)) if n}, position
