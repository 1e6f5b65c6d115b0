"""Subtitle and screenplay files as formats of ``spark.read``, ``spark.readStream`` and ``write``.

``register(spark)`` makes two formats known: ``cueline_srt`` (cues; read, streamed and written) and ``cueline_lines`` (numbered lines of screenplays; read and
streamed). A path is a file or a folder, which is searched with all its folders, in any file system that Arrow opens; names that begin with "_" or "." are left out.

Lines are numbered from a file's start, so a file is one task's work at least; small files share a task up to ``partitionBytes``. A stream takes files in the order of
the time at which they were put in place, those ``settle`` seconds old or older, and its offset is the last of them: put files there by renaming them, never with
an older time. The driver lists a folder's names; it never reads a file.
"""

from __future__ import annotations

import posixpath
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from cueline.errors import SubtitleError
from cueline.schema import SUBTITLE
from cueline.sources.encoding import decode
from cueline.sources.subtitles import CORNERS, srt_cues
from cueline.sources.tables import seconds

#: Bytes of files that share a task.
PARTITION_BYTES = 32 << 20
LINES = "filepath string, line_idx int, raw string"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[int, str, int]]:
    """(time in nanoseconds, path, bytes) of the files in ``path``, in order."""
    system, root = _opened(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise SubtitleError(f"{path} does not exist")
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda p: any(x[:1] in ("_", ".") for x in posixpath.relpath(p, root).split("/"))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.is_file and (info.is_file or not hidden(f.path)))


@dataclass
class Files(InputPartition):
    """The files of a task."""

    paths: list[str]


def dealt(files: list[tuple[int, str, int]], most: int) -> list[Files]:
    """``files`` in partitions of ``most`` bytes, or of one longer file."""
    out, size = [], most
    for _, path, n in files:
        if size + n > most or not out:
            out.append(Files([]))
            size = 0
        out[-1].paths.append(path)
        size += n
    return out


class _Reader(DataSourceReader):
    def __init__(self, source: _Source):
        self.source, self.most = source, int(source.options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        return dealt(listed(self.source.path), self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _opened(self.source.path)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                yield from self.source.rows(path, decode(f.read()))


class _Stream(_Reader, DataSourceStreamReader):
    def __init__(self, source: _Source):
        super().__init__(source)
        self.settle = float(source.options.get("settle", 1))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        settled = [f for f in listed(self.source.path) if f[0] <= (time.time() - self.settle) * 1e9]
        return {"time": settled[-1][0], "path": settled[-1][1]} if settled else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        own = [f for f in listed(self.source.path) if (start["time"], start["path"]) < f[:2] <= (end["time"], end["path"])]
        return dealt(own, self.most) or [Files([])]

    def commit(self, end: dict) -> None:
        pass


class _Source(DataSource):
    """Options: ``path``; ``partitionBytes``; ``settle`` for streams."""

    @property
    def path(self) -> str:
        if not self.options.get("path"):
            raise SubtitleError(f"{self.name()} needs a path")
        return self.options["path"]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self)


class LinesSource(_Source):
    """filepath, line_idx (from 1), raw of text files, as ``read_screenplay_lines`` reads them."""

    @classmethod
    def name(cls) -> str:
        return "cueline_lines"

    def schema(self) -> str:
        return LINES

    def rows(self, path: str, text: str) -> Iterator[tuple]:
        for n, line in enumerate(re.split(r"\r\n|\r|\n", re.sub(r"(\r\n|\r|\n)\Z", "", text)), 1):
            yield path, n, line


class SrtSource(_Source):
    """Cues of SRT files, as ``read_srt`` reads them, with their markup. ``mode``: FAILFAST (a bad line or timecode fails the read) or PERMISSIVE (it is a row with an error)."""

    @classmethod
    def name(cls) -> str:
        return "cueline_srt"

    @property
    def permissive(self) -> bool:
        mode = self.options.get("mode", "FAILFAST").upper()
        if mode not in ("FAILFAST", "PERMISSIVE"):
            raise SubtitleError("mode must be FAILFAST or PERMISSIVE")
        return mode == "PERMISSIVE"

    def schema(self) -> str:
        return SUBTITLE + (", error string" if self.permissive else "")

    def rows(self, path: str, text: str) -> Iterator[tuple]:
        permissive = self.permissive
        for idx, _, at, start, end, content, x1, y1, x2, y2, error in srt_cues(path, text):
            a, b = seconds(start), seconds(end)
            if not error and (a is None or b is None):
                error = f"{path}:{at}: bad timestamps"
            if error and not permissive:
                raise SubtitleError(error)
            row = (idx, path, at, a, b, content and content.strip(), None, x1, y1, x2, y2)
            yield (*row, error) if permissive else row

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SrtWriter(self.path, overwrite)


def code(at: float) -> str:
    """HH:MM:SS,mmm of seconds."""
    ms = round(at * 1000)
    return f"{ms // 3_600_000:02}:{ms // 60_000 % 60:02}:{ms // 1000 % 60:02},{ms % 1000:03}"


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's finished files, and their names."""

    folder: str
    names: list[str]


class SrtWriter(DataSourceWriter):
    """Writes each ``filepath``'s cues as a file of that name. Tasks write to folders of their own; a commit moves what they finished, so a repeated or lost task leaves nothing."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.work = path, overwrite, f"_cueline-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, root = _opened(self.path)
        folder, names, out, last = f"{root}/{self.work}/{uuid.uuid4().hex}", [], None, None
        try:
            for row in iterator:
                if out is None or row["filepath"] != last:
                    if out:
                        out.close()
                    last = row["filepath"]
                    name = posixpath.basename((last or "").rstrip("/"))
                    if not name or name in names or name[0] in "_.":
                        raise SubtitleError(f"{last!r}: no name for a file, or its cues are not together")
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder}/{name}")
                    names.append(name)
                out.write(self._block(row).encode())
        finally:
            if out:
                out.close()
        return Written(folder, names)

    @staticmethod
    def _block(row) -> str:
        content = " ".join((row["content"] or "").split("\n")).strip()
        values = row["idx"], row["timestamp_start"], row["timestamp_end"]
        if not content or None in values:
            raise SubtitleError(f"{row['filepath']}: a cue needs an index, times and a text")
        known = row.asDict()
        corners = [(c, known.get(c.lower())) for c in CORNERS]
        places = "".join(f" {c}:{v}" for c, v in corners if v is not None)
        return f"{values[0]}\n{code(values[1])} --> {code(values[2])}{places}\n{content}\n\n"

    def commit(self, messages: list[Written]) -> None:
        system, root = _opened(self.path)
        names = [n for m in messages for n in m.names]
        held = {f.base_name for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file}
        twice = len(names) != len(set(names)) or (not self.overwrite and held & set(names))
        if twice:
            self.abort(messages)
            raise SubtitleError(f"{self.path}: several files of one name")
        if self.overwrite:
            for name in held:
                system.delete_file(f"{root}/{name}")
        system.create_dir(root, recursive=True)
        for message in messages:
            for name in message.names:
                system.move(f"{message.folder}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, root = _opened(self.path)
        if system.get_file_info(f"{root}/{self.work}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.work}")


def register(spark: SparkSession) -> None:
    """Make the formats known to the session."""
    for source in (SrtSource, LinesSource):
        spark.dataSource.register(source)


def write_srt(cues: DataFrame, path: str, mode: str = "append") -> None:
    """Write ``cues`` (filepath, idx, timestamp_start, timestamp_end, content and perhaps x1, x2, y1, y2) as SRT files named by filepath's last part.

    Cues are in order of idx. A cue without text, index or times, two files of one name and a name that is there already (unless ``mode`` is overwrite, which
    takes the folder's own files away first) are errors, and nothing is written then.
    """
    register(cues.sparkSession)
    cues.repartition("filepath").sortWithinPartitions("filepath", "idx").write.format("cueline_srt").mode(mode).save(path)
