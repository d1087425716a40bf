"""The external tag tool: one child process that stays open, reads and writes tags of many files.

Arguments go to its standard input, a line each; `-execute` with a number ends a request and the tool answers it with
lines up to `{ready}` with that number.
"""

from __future__ import annotations

import functools
import json
import os
import queue
import shutil
import subprocess
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from mediacat.sources.scratch import local_uri

TOOL = "exiftool"
FIELDS = {"date_time_original": "DateTimeOriginal", "create_date": "CreateDate", "media_create_date": "MediaCreateDate", "track_create_date": "TrackCreateDate"}
EXIF_DDL = "rel_path string, " + ", ".join(f"{c} string" for c in FIELDS)
OUTCOME_DDL = "dst_path string, error string"
NO_TOOL = "the tag tool is not available"


@functools.cache
def available(tool: str = TOOL) -> bool:
    """Whether this machine has the tool; asked once a process."""
    return shutil.which(tool) is not None


class ToolError(RuntimeError):
    pass


class TagTool:
    """A running tool. A thread drains its answers, so that neither side waits for the other's full pipe."""

    def __init__(self, tool: str = TOOL, common: tuple[str, ...] = (), timeout: float = 600) -> None:
        self.timeout, self.number = timeout, 0
        self.child = subprocess.Popen([tool, "-stay_open", "True", "-@", "-", "-common_args", *common], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, encoding="utf-8", errors="replace")
        self.lines: queue.Queue[str | None] = queue.Queue()
        threading.Thread(target=self._drain, daemon=True).start()

    def _drain(self) -> None:
        for line in self.child.stdout:
            self.lines.put(line.rstrip("\n"))
        self.lines.put(None)

    def ask(self, requests: list[list[str]]) -> list[list[str]]:
        """The answer lines of each request; all requests are sent before the first answer is awaited."""
        first = self.number
        text = []
        for args in requests:
            text += [*map(argument_line, args), f"-execute{self.number}"]
            self.number += 1
        try:
            self.child.stdin.write("\n".join(text) + "\n")
            self.child.stdin.flush()
        except OSError as e:
            raise ToolError(f"the tag tool has ended: {e}") from e
        return [self._answer(n) for n in range(first, self.number)]

    def _answer(self, number: int) -> list[str]:
        got: list[str] = []
        while True:
            try:
                line = self.lines.get(timeout=self.timeout)
            except queue.Empty:
                raise ToolError("the tag tool does not answer") from None
            if line is None:
                raise ToolError("the tag tool has ended: " + "; ".join(got))
            if line == f"{{ready{number}}}":
                return got
            got.append(line)

    def close(self) -> None:
        try:
            self.child.stdin.write("-stay_open\nFalse\n")
            self.child.stdin.close()
            self.child.wait(timeout=30)
        except (OSError, ValueError, subprocess.TimeoutExpired):
            self.child.kill()
            self.child.wait()


def argument_line(arg: str) -> str:
    """An argument as one line; one with line breaks or backslashes as a C string."""
    if "\n" not in arg and "\r" not in arg and "\\" not in arg:
        return arg
    return "#[CSTR]" + arg.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace('"', '\\"').replace("$", "\\$").replace("@", "\\@")


def exif_tags(files: DataFrame, root: str, tool: str = TOOL, batch: int = 100) -> DataFrame:
    """Date tags of files (rel_path), by one process a task; all null where the tool is missing or fails."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        child = None
        try:
            for part in parts:
                paths, rows = part["rel_path"].tolist(), []
                for i in range(0, len(paths), batch):
                    some = paths[i : i + batch]
                    answers: list[dict] = [{} for _ in some]
                    if available(tool):
                        try:
                            child = child or TagTool(tool)
                            lines = child.ask([["-json", *[f"-{f}" for f in FIELDS.values()], os.path.join(root, p)] for p in some])
                            answers = [first_record(x) for x in lines]
                        except (OSError, ToolError):
                            if child:
                                child.close()
                            child = None
                    rows += answers
                yield pd.DataFrame({"rel_path": paths} | {c: [r.get(f) for r in rows] for c, f in FIELDS.items()}, dtype=object)
        finally:
            if child:
                child.close()

    return files.select("rel_path").mapInPandas(run, EXIF_DDL)


def first_record(lines: list[str]) -> dict:
    """The texts of the first record of a JSON answer, which other lines may surround."""
    text = "\n".join(lines)
    try:
        found = json.loads(text[text.index("[") : text.rindex("]") + 1])[0]
        return {k: v for k, v in found.items() if isinstance(v, str)}
    except (ValueError, IndexError, AttributeError):
        return {}


# -- writing ----------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    batches: int
    failed: int


class TagWriter(DataSourceWriter):
    """Feeds batches of files to one tool a task. A batch that was answered leaves a record in the journal, so a task that
    runs again sends only what its forerunner had not finished."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.journal, self.tool = options["root"], options["journal"], options["tool"]

    def write(self, rows: Iterator[Row]) -> Written:
        os.makedirs(self.journal, exist_ok=True)
        child, batches, failed = None, 0, 0
        try:
            for name, files in batches_of(rows):
                record = os.path.join(self.journal, f"{name}.json")
                if os.path.exists(record):
                    continue
                if child is None and available(self.tool):
                    child = TagTool(self.tool, ("-overwrite_original", "-m"))
                errors = self._send(child, files)
                batches, failed = batches + 1, failed + sum(e is not None for e in errors)
                with open(part := f"{record}.{uuid.uuid4().hex}.part", "w", encoding="utf-8") as f:
                    f.writelines(json.dumps({"dst_path": path, "error": e}, ensure_ascii=False) + "\n" for (path, _), e in zip(files, errors, strict=True))
                os.replace(part, record)
        finally:
            if child:
                child.close()
        return Written(batches, failed)

    def _send(self, child: TagTool | None, files: list[tuple[str, list[str]]]) -> list[str | None]:
        if child is None:
            return [NO_TOOL] * len(files)
        answers = child.ask([[*args, os.path.join(self.root, path)] for path, args in files])
        return [next((x for x in lines if x.startswith("Error")), None) for lines in answers]

    def commit(self, messages: list[Written | None]) -> None:
        self._note("_committed", messages)

    def abort(self, messages: list[Written | None]) -> None:
        self._note("_aborted", messages)  # records of answered batches stay: those tags are written

    def _note(self, name: str, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        os.makedirs(self.journal, exist_ok=True)
        with open(os.path.join(self.journal, name), "w", encoding="utf-8") as f:
            json.dump({"batches": sum(m.batches for m in done), "failed": sum(m.failed for m in done)}, f)


def last_run(journal: str) -> dict[str, int]:
    """Counts of the last run of a journal that ended well: `batches` that it sent and files that `failed` in them."""
    with open(os.path.join(journal, "_committed"), encoding="utf-8") as f:
        return json.load(f)


def batches_of(rows: Iterator[Row]) -> Iterator[tuple[str, list[tuple[str, list[str]]]]]:
    """Name and files (path, arguments) of each batch of rows that are sorted by bucket and batch."""
    name, files = None, []
    for r in rows:
        if name is not None and name != f"{r['bucket']}-{r['batch']}":
            yield name, files
            files = []
        name = f"{r['bucket']}-{r['batch']}"
        files.append((r["dst_path"], list(r["args"])))
    if name is not None:
        yield name, files


class TagSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mediatags"

    def writer(self, schema, overwrite: bool) -> TagWriter:
        return TagWriter(dict(self.options))


def write_tags(tags: DataFrame, root: str, journal: str, size: int = 25, tool: str = TOOL, buckets: int = 64) -> DataFrame:
    """Writes tags (dst_path, ord, tag, op, value) into the files below root and returns (dst_path, error) of each file.

    Files are numbered into batches of `size` within hash buckets; a task sends its buckets' batches to one process. The
    journal, a folder that driver and executors see, names the run: with the same journal a run that broke off goes on
    where it stopped, and no answered batch is sent twice (speculative execution must be off). Files whose tags cannot
    be written come back with the tool's message.
    """
    spark = tags.sparkSession
    spark.dataSource.register(TagSink)
    files = tags.groupBy("dst_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tag", "op", "value"))), lambda t: F.concat(F.lit("-"), t["tag"], t["op"], t["value"])).alias("args"))  # tags of one file
    files = files.withColumn("bucket", F.pmod(F.xxhash64("dst_path"), F.lit(buckets)).cast("int"))
    numbered = files.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("bucket").orderBy("dst_path")) - 1) / max(1, size)).cast("int"))
    out = numbered.select("bucket", "batch", "dst_path", "args").sortWithinPartitions("bucket", "batch", "dst_path")
    out.write.format("mediatags").mode("append").options(root=root, journal=journal, tool=tool).save()
    return spark.read.schema(OUTCOME_DDL).option("pathGlobFilter", "*.json").json(local_uri(journal))
