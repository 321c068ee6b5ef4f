"""Parser plug-ins in child processes: a time limit, a memory limit, and every fault a row.

A plug-in is a piece of source text that defines ``parse(tables, context=None)``. A Python table function sends
each report's tables to it as one JSON frame; the child answers with one frame. A child serves all reports that its Spark
worker meets, so its start is paid once; a child that overruns the limit or dies is killed with all that it
started, and the next report gets a new one. Nothing that a plug-in does ends a task.

Statuses: ok | empty (no rows) | rejected (no parse function, or the source doesn't run) | error (an exception) |
malformed (not the agreed shape) | too_large | timeout | crash (the child ended).
"""

from __future__ import annotations

import atexit
import json
import os
import select
import signal
import struct
import subprocess
import sys
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.grid import TABLE

OUT = "status string, error string, dim string, idx int, name string, amount double"
#: Bytes of an answer, and characters of an error that are kept.
MOST_BYTES, MOST_ERROR = 16 << 20, 200

#: What the child runs: frames come in on descriptor 3 and go out on 4, as a plug-in may print what it likes.
CHILD = r"""
import json, os, resource, struct, sys

def read(n):
    out = b""
    while len(out) < n:
        got = os.read(3, n - len(out))
        if not got:
            os._exit(0)
        out += got
    return out

def frame():
    return json.loads(read(struct.unpack(">I", read(4))[0]))

def answer(x):
    data = json.dumps(x).encode()
    data = struct.pack(">I", len(data)) + data
    while data:
        data = data[os.write(4, data):]

def fault(kind, e):
    answer({"status": kind, "error": f"{type(e).__name__}: {e}"[:200]})

start = frame()
if start["memory_mb"]:
    resource.setrlimit(resource.RLIMIT_AS, (start["memory_mb"] << 20,) * 2)
resource.setrlimit(resource.RLIMIT_CORE, (0, 0))
space = {"__name__": "plugin"}
try:
    exec(compile(start["source"], "plugin", "exec"), space)
    if not callable(space.get("parse")):
        raise ValueError("no function parse(tables)")
except BaseException as e:
    fault("rejected", e)
    os._exit(0)
answer({"status": "ready"})
while True:
    tables = frame()
    try:
        found = space["parse"](tables)
        rows = []
        for dim, items in (found or {}).items():
            for i, x in enumerate(items):
                amount = x["revenue_yuan"]
                rows.append([str(dim), i, str(x["name"]), None if amount is None else float(amount)])
        out = {"status": "ok" if rows else "empty", "rows": rows}
    except (AttributeError, KeyError, TypeError) as e:
        # raised by the loop above, or by the plug-in itself
        inside = e.__traceback__.tb_next is not None
        fault("error" if inside else "malformed", e)
        continue
    except BaseException as e:
        fault("error", e)
        continue
    try:
        answer(out)
    except ValueError as e:
        fault("malformed", e)
"""


class Child:
    """One running plug-in."""

    def __init__(self, source: str, memory_mb: int, limit: float) -> None:
        to_child, self.to = os.pipe()
        self.back, from_child = os.pipe()
        self.rejected = None

        def wire() -> None:
            # both ends may be anything, so first out of each other's way
            a, b = os.dup(to_child), os.dup(from_child)
            os.dup2(a, 3)
            os.dup2(b, 4)

        self.process = subprocess.Popen([sys.executable, "-I", "-S", "-c", CHILD], stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, env={"PATH": os.defpath}, cwd="/", preexec_fn=wire, pass_fds=(3, 4), start_new_session=True)
        os.close(to_child)
        os.close(from_child)
        # a start is slow on a busy machine, and isn't the plug-in's time
        said = self.ask(json.dumps({"source": source, "memory_mb": memory_mb}).encode(), limit + 30)
        if said["status"] != "ready":
            self.rejected = said | {"status": said["status"] if said["status"] in ("timeout", "crash") else "rejected"}

    def ask(self, data: bytes, limit: float) -> dict:
        """The answer to one frame, within ``limit`` seconds for sending, thinking and answering."""
        end = time.monotonic() + limit
        try:
            self._send(struct.pack(">I", len(data)) + data, end)
            size = struct.unpack(">I", self._read(4, end))[0]
            if size > MOST_BYTES:
                self.kill()
                return {"status": "too_large", "error": f"{size} bytes"}
            return json.loads(self._read(size, end))
        except TimeoutError:
            self.kill()
            return {"status": "timeout", "error": f"{limit:g} s"}
        except OSError:
            self.kill()
            return {"status": "crash", "error": f"exit {self.process.returncode}"}

    def _send(self, data: bytes, end: float) -> None:
        view = memoryview(data)
        os.set_blocking(self.to, False)
        while view:
            if not select.select([], [self.to], [], max(0, end - time.monotonic()))[1]:
                raise TimeoutError
            view = view[os.write(self.to, view) :]

    def _read(self, n: int, end: float) -> bytes:
        out = bytearray()
        while len(out) < n:
            if not select.select([self.back], [], [], max(0, end - time.monotonic()))[0]:
                raise TimeoutError
            got = os.read(self.back, n - len(out))
            if not got:
                raise ConnectionError
            out += got
        return bytes(out)

    @property
    def alive(self) -> bool:
        return self.process.poll() is None

    def kill(self) -> None:
        """The child and all that it started."""
        try:
            os.killpg(self.process.pid, signal.SIGKILL)
        except ProcessLookupError:
            pass
        self.process.wait()
        for fd in (self.to, self.back):
            try:
                os.close(fd)
            except OSError:
                pass
        self.to = self.back = -1


_children: dict[tuple[str, int], Child] = {}


def _end() -> None:
    for child in _children.values():
        if child.to >= 0:
            child.kill()


atexit.register(_end)


def call(source: str, tables: bytes, limit: float, memory_mb: int) -> dict:
    """One report through a plug-in. The answer has status, error and rows."""
    key = (source, memory_mb)
    child = _children.get(key)
    if child is None or child.to < 0 or not (child.rejected or child.alive):
        if child is not None and child.to >= 0:
            child.kill()
        child = _children[key] = Child(source, memory_mb, limit)
    if child.rejected:
        return child.rejected
    return child.ask(tables, limit)


class Parse:
    """eval(source, tables as JSON, seconds, MB) gives the plug-in's rows, or one that says what went wrong."""

    def eval(self, source: str, tables: str, limit: float, memory_mb: int) -> Iterator[tuple]:
        said = call(source or "", (tables or "[]").encode(), limit, memory_mb)
        if said["status"] == "ok":
            for dim, i, name, amount in said["rows"]:
                yield "ok", None, dim, i, name, amount
        else:
            yield said["status"], (said.get("error") or "")[:MOST_ERROR] or None, None, None, None, None


def report_tables(cells: DataFrame) -> DataFrame:
    """code, year and tables, an array of (table_id, grid), of each report. One shuffle: cells meet by report, and the steps
    from rows to tables to reports go on in the same tasks. What meets is bounded by a report's length."""
    met = cells.select(*TABLE, "r", "c", F.coalesce("v", F.lit("")).alias("v")).repartition("code", "year")
    ordered = lambda *names: F.transform(F.array_sort(F.collect_list(F.struct(*names))), lambda x: x[names[-1]])
    rows = met.groupBy(*TABLE, "r").agg(ordered("c", "v").alias("row"))
    tables = rows.groupBy(*TABLE).agg(ordered("r", "row").alias("grid"))
    return tables.groupBy("code", "year").agg(F.array_sort(F.collect_list(F.struct("table_id", "grid"))).alias("tables"))


def run(tables: DataFrame, plugins: dict[str, str], limit: float = 10.0, memory_mb: int = 512) -> DataFrame:
    """code, year, plugin, status, error, dim, idx, name, amount: each plug-in of the catalog over each report of ``tables``
    (see ``report_tables``). A plug-in gives a report its rows, or one row with a status other than ok.

    The catalog's sources are few and travel with the plan. ``limit`` is in seconds for a report, ``memory_mb`` bounds a child's address space (0: no bound). A report without
    tables is handed over as an empty list. No plug-ins or no reports give no rows.
    """
    if not plugins:
        return tables.sparkSession.createDataFrame([], "code string, year int, plugin string, " + OUT)
    catalog = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(source).alias("source")) for name, source in sorted(plugins.items())))
    asked = tables.select("code", "year", F.to_json("tables").alias("_json")).withColumn("_plugin", F.explode(catalog))
    asked = asked.select("code", "year", F.col("_plugin.name").alias("plugin"), F.col("_plugin.source").alias("_source"), "_json")
    parse = F.udtf(Parse, returnType=OUT)
    return asked.lateralJoin(parse(F.col("_source").outer(), F.col("_json").outer(), F.lit(float(limit)), F.lit(int(memory_mb)))).drop("_source", "_json")
