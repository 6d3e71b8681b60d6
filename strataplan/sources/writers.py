"""Committing writers ``ply`` and ``dxf``: executors write the parts of a folder, each a whole file of its kind, into
a staging folder inside it; the driver moves what the tasks committed and deletes the rest. A failed task or job
leaves nothing, ``_SUCCESS`` comes last, and the folder reads back as one table (``scan``, ``dxf``).

    points.write.format("ply").mode("overwrite").save(folder)

``append`` adds parts; ``overwrite`` deletes the earlier ones once the new ones are all in place."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import sinks
from .scan_files import _place


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int
    dropped: list[str]


class _Parts(DataSourceArrowWriter):
    """Parts of at most ``rowsPerFile`` rows, so that a task holds no more than one part."""

    suffix = ""
    needs: tuple[str, ...] = ()

    def __init__(self, options, schema, overwrite):
        self.path, self.most, self.overwrite = options["path"].rstrip("/"), int(options.get("rowsPerFile", 1_000_000)), overwrite
        self.options = dict(options)
        self.names = schema.names
        if lost := [c for c in self.needs if c not in self.names]:
            raise ValueError(f"{self.suffix} needs the columns {', '.join(lost)}")
        self.run = uuid.uuid4().hex

    def body(self, rows: pa.Table) -> tuple[Iterable[bytes], int, set[str]]:
        """A whole file piece by piece, its rows, and classes that were left out."""
        raise NotImplementedError

    def notes(self, dropped: list[str]) -> bytes | None:
        return None

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        where, name = _place(self.path)
        return where, name, f"{name}/_staging-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, _, staging = self._staging()
        task = TaskContext.get()
        stem = f"part-{self.run[:8]}-{task.partitionId():05d}-{task.taskAttemptId()}"
        where.create_dir(staging)
        files, total, dropped, held, n = [], 0, set(), [], 0

        def put(batches):
            nonlocal total
            content, rows, unknown = self.body(pa.Table.from_batches(batches))
            dropped.update(unknown)
            if rows:
                files.append(f"{stem}-{len(files):04d}.{self.suffix}")
                with where.open_output_stream(f"{staging}/{files[-1]}") as out:
                    for piece in content:
                        out.write(piece)
                total += rows

        for batch in iterator:
            while batch.num_rows:
                some = batch.slice(0, self.most - n)
                held.append(some)
                n += some.num_rows
                batch = batch.slice(some.num_rows)
                if n == self.most:
                    put(held)
                    held, n = [], 0
        if held:
            put(held)
        return Written(files, total, sorted(dropped))

    def commit(self, messages) -> None:
        where, folder, staging = self._staging()
        where.create_dir(folder)
        old = [f.path for f in where.get_file_info(fs.FileSelector(folder)) if f.is_file] if self.overwrite else []
        done = [m for m in messages if m is not None]
        for m in done:
            for name in m.files:
                where.move(f"{staging}/{name}", f"{folder}/{name}")
        note = self.notes(sorted({c for m in done for c in m.dropped}))
        if note is not None:
            with where.open_output_stream(f"{folder}/part-{self.run[:8]}-notes.{self.suffix}") as out:
                out.write(note)
        for path in old:
            where.delete_file(path)
        self._clean()
        with where.open_output_stream(f"{folder}/_SUCCESS") as out:
            out.write(b"")

    def abort(self, messages) -> None:
        self._clean()

    def _clean(self) -> None:
        where, _, staging = self._staging()
        if where.get_file_info(staging).type != fs.FileType.NotFound:
            where.delete_dir(staging)


class PlyParts(_Parts):
    """``x, y, z[, r, g, b in 0..1]`` as binary PLY: float32, colours truncated to bytes; rows without a place are left
    out, a missing colour is black."""

    suffix, needs = "ply", ("x", "y", "z")

    def body(self, rows):
        colours = {"r", "g", "b"} <= set(self.names)
        place = [rows[c].cast(pa.float64()).to_numpy() for c in "xyz"]
        ok = ~np.isnan(np.stack(place)).any(0)
        out = np.zeros(int(ok.sum()), dtype=[*[(c, "<f4") for c in "xyz"], *([(c, "u1") for c in "rgb"] if colours else [])])
        for c, v in zip("xyz", place):
            out[c] = v[ok]
        for c in "rgb" if colours else "":
            out[c] = np.clip(np.nan_to_num(rows[c].cast(pa.float64()).to_numpy()[ok]) * 255, 0, 255).astype(np.uint8)
        return [sinks.ply_head(len(out), colours), out.tobytes()], len(out), set()


class DxfParts(_Parts):
    """``class, x1, y1, x2, y2`` as drawings with the layers of :data:`sinks.LAYERS`; rows of unknown classes and without
    a place are left out, and a part of its own notes those classes."""

    suffix, needs = "dxf", ("class", "x1", "y1", "x2", "y2")

    #: rows that are text at one time
    step = 10_000

    def body(self, rows):
        kinds = rows["class"]
        dropped = {str(k) for k in kinds.unique().to_pylist() if k not in sinks.LAYERS}
        drawn = pc.is_in(kinds, value_set=pa.array(list(sinks.LAYERS), kinds.type))
        for c in self.needs[1:]:
            drawn = pc.and_(drawn, pc.is_valid(rows[c]))
        kept = rows.filter(drawn).select(self.needs)
        return self._pieces(kept), kept.num_rows, dropped

    def _pieces(self, rows: pa.Table) -> Iterator[bytes]:
        text = lambda lines: "".join(f"{x}\n" for x in lines).encode()
        yield text(sinks.dxf_head(self.options.get("units", "metres")))
        for low in range(0, rows.num_rows, self.step):
            yield text(x for row in zip(*[c.to_pylist() for c in rows.slice(low, self.step).columns]) for x in sinks.dxf_line(*row))
        yield text(sinks.DXF_END[:-1])

    def notes(self, dropped):
        if not dropped:
            return None
        return sinks.dxf_file(sinks.dxf_note(f"dropped classes: {', '.join(dropped)}", 0), self.options.get("units", "metres")).encode()


def _source(kind: str, writer: type[_Parts]) -> type[DataSource]:
    class Parts(DataSource):
        @classmethod
        def name(cls):
            return kind

        def writer(self, schema, overwrite):
            return writer(self.options, schema, overwrite)

    return Parts


def register(spark: SparkSession) -> None:
    """Makes the formats ``ply`` and ``dxf_parts`` known; ``dxf`` is the reader's name."""
    spark.dataSource.register(_source("ply", PlyParts))
    spark.dataSource.register(_source("dxf_parts", DxfParts))
