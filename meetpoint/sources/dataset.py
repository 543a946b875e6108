"""Reading the travel-time data set and the tables, checking them, and writing results."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DEFAULT_TIMEZONE, GRID, MANIFEST, SUPPORTED_FORMAT, TABLES, UNREACHABLE


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that driver and executors share, and read back.

    Cuts the lineage: what several branches of a query read is computed once, and
    the planner knows its size.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Below which folder intermediate tables lie, if ``scratch`` gives one.
SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Within it, ``stored`` writes below one folder, which goes at the end; results must be written elsewhere by then."""
    folder = shared_folder(spark)
    token = SCRATCH.set(folder)
    try:
        yield folder
    finally:
        SCRATCH.reset(token)
        delete_path(spark, folder)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``.

    In plain local mode a temporary folder will do where that is unset; elsewhere its
    absence is an error.
    """
    root = SCRATCH.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="meetpoint-")
    return f"{root.rstrip('/')}/meetpoint-{uuid.uuid4().hex}"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per matrix, in the manifest's order, with the manifest's own columns."""
    raw = spark.read.schema(MANIFEST).json(path, multiLine=True)
    flat = raw.select("format_version", "grid_version", F.col("grid.n_cells").alias("n_cells"), F.posexplode("matrices").alias("pos", "matrix_key", "m"))
    return flat.select(
        "format_version", "grid_version", "n_cells", "pos", "matrix_key", "m.file", "m.build_hash", "m.build_inputs.mode", "m.shape", "m.max_seconds", "m.min_seconds",
        "m.coverage_pct", "m.wall_seconds", "m.build_inputs.departure", "m.build_inputs.departure_window_min", "m.timezone",
    )


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """One row per cell: cell_id, h3, lat, lon, and the grid's version and count."""
    raw = spark.read.schema(GRID).json(path, multiLine=True)
    return raw.select("grid_version", "n_cells", F.explode("cells").alias("c")).select(F.col("c.id").alias("cell_id"), "c.h3", "c.lat", "c.lon", "grid_version", "n_cells")


def shared_uri(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and place that Spark's readers give it, so that tasks open the same file."""
    fs, at = hadoop_path(spark, path)
    full = fs.makeQualified(at).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def readable_by_tasks(uri: str) -> bool:
    """Whether pyarrow knows the file system."""
    try:
        pafs.FileSystem.from_uri(uri)
    except (ValueError, NotImplementedError, OSError):
        return False
    return True


def ingest_matrices(spark: SparkSession, folder: str, matrices: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """(matrix_key, origin, seconds): a row per origin of each .npy file that the manifest names.

    A task reads a file's header; then each task reads a range of some
    ``block_bytes``, so a matrix may have any size.  Only in a store that Spark's
    readers alone can open is a file one row of a task (2 GB at most).  Write the
    result as Parquet partitioned by matrix_key once; queries read that.
    """
    uri = shared_uri(spark, folder)
    if readable_by_tasks(uri):
        return read_ranges(matrix_ranges(matrices, uri, block_bytes), uri)
    return whole_files(spark, folder, matrices)


def as_rows(key: str, first: int, m: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a part of a matrix, the first of which is the origin ``first``."""
    step = max(1, (4 << 20) // max(1, m.shape[1]))
    for at in range(0, len(m), step):
        part = m[at : at + step].astype(np.int32)
        lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32), part.ravel()) if part.size else pa.array([[]] * len(part), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([key] * len(part)), pa.array(np.arange(first + at, first + at + len(part), dtype=np.int32)), lists], names=["matrix_key", "origin", "seconds"])


ROWS = "matrix_key string, origin int, seconds array<int>"


def matrix_ranges(matrices: DataFrame, uri: str, block_bytes: int) -> DataFrame:
    """(matrix_key, file, start, n, width, kind, first, rows): ranges of rows of the files that matrices(matrix_key, file) names.

    ``start`` is where a file's numbers begin, ``kind`` their type.
    """

    def heads(batches):
        import io

        fs, root = pafs.FileSystem.from_uri(uri)
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
        for batch in batches:
            found = []
            for key, file in zip(batch.column("matrix_key").to_pylist(), batch.column("file").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{file}") as f:
                    head = io.BytesIO(f.read(1 << 16))
                shape, by_column, kind = read[np.lib.format.read_magic(head)](head)
                if by_column or len(shape) != 2 or kind.hasobject:
                    raise ValueError(f"{file} is not a matrix of numbers stored by row")
                found.append((key, file, head.tell(), *shape, kind.str))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["matrix_key", "file", "start", "n", "width", "kind"])

    named = matrices.select("matrix_key", "file").repartition("matrix_key")
    known = named.mapInArrow(heads, "matrix_key string, file string, start long, n long, width long, kind string").where("n > 0")
    step = F.greatest(F.lit(1), F.lit(block_bytes) / F.greatest(F.lit(1), F.col("width") * F.substring("kind", 3, 2).cast("int"))).cast("long")
    cut = known.withColumn("step", step).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("step"))))
    return cut.withColumn("rows", F.least("step", F.col("n") - F.col("first"))).drop("step")


def read_ranges(ranges: DataFrame, uri: str) -> DataFrame:
    def read(batches):
        fs, root = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for r in batch.to_pylist():
                kind = np.dtype(r["kind"])
                line = r["width"] * kind.itemsize
                with fs.open_input_file(f"{root}/{r['file']}") as f:
                    content = f.read_at(r["rows"] * line, r["start"] + r["first"] * line)
                if len(content) != r["rows"] * line:
                    raise ValueError(f"{r['file']} ends before its last row")
                yield from as_rows(r["matrix_key"], r["first"], np.frombuffer(content, kind).reshape(r["rows"], r["width"]))

    return ranges.repartition("file", "first").mapInArrow(read, ROWS)


def whole_files(spark: SparkSession, folder: str, matrices: DataFrame) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def rows(batches):
        import io

        for batch in batches:
            for key, content in zip(batch.column("matrix_key").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield from as_rows(key, 0, np.load(io.BytesIO(content), allow_pickle=False))

    return matrices.select("file", "matrix_key").join(files, "file").select("matrix_key", "content").mapInArrow(rows, ROWS)


def streamed_files(rows: DataFrame, uri: str, key: str, suffix: str, head: Callable[[dict], bytes], body: Callable[[pa.RecordBatch, bool], bytes], tail: bytes = b"") -> DataFrame:
    """A file below ``uri`` for each value of ``key``, written in the rows' order as it streams through a task; (key, file).

    Rows come sorted by the caller, a key's all in one partition.  ``head`` is of
    the first row, ``body`` of rows of one key and whether the file has some
    already.  A file has a name of its own, so a task that runs twice harms none.
    """

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        out, now, name, made = None, None, None, []
        for batch in batches:
            keys = batch.column(key).to_pylist()
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                fresh = out is None or keys[a] != now
                if fresh:
                    if out is not None:
                        out.write(tail)
                        out.close()
                    now, name = keys[a], f"{keys[a]}-{uuid.uuid4().hex}{suffix}"
                    made.append((now, name))
                    out = fs.open_output_stream(f"{root}/{name}")
                    out.write(head(batch.slice(a, 1).to_pylist()[0]))
                out.write(body(batch.slice(a, b - a), not fresh))
        if out is not None:
            out.write(tail)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], pa.string()) for k in range(2)], names=[key, "file"])

    return rows.mapInArrow(write, f"{key} string, file string")


def write_dataset(rows: DataFrame, cells: DataFrame, folder: str, grid_version: str, max_seconds: int, timezones: dict[str, str] | None = None) -> None:
    """Matrices (matrix_key, origin, seconds) and cells as a data set: manifest, grid and a .npy file per matrix.

    A matrix streams through one task into its file, row by row, whatever its size;
    so does the grid.  The driver gets a few numbers of each matrix, for the manifest.
    """
    spark, uri = rows.sparkSession, shared_uri(rows.sparkSession, folder)
    reached = F.filter("seconds", lambda s: s != UNREACHABLE)
    by_row = rows.select("matrix_key", "origin", F.size("seconds").alias("cells"), F.size(reached).alias("ok"), F.array_min(reached).alias("lo"))
    shapes = by_row.groupBy("matrix_key").agg(
        F.count("*").alias("n"), F.count_distinct("origin").alias("origins"), F.max("origin").alias("last"), F.min("cells").alias("least"), F.max("cells").alias("width"), F.sum("ok").alias("ok"), F.min("lo").alias("lo")
    )
    known = {r["matrix_key"]: r for r in shapes.collect()}
    ragged = [k for k, r in known.items() if not r["n"] == r["origins"] == r["last"] + 1 or r["least"] != r["width"]]
    if ragged:
        raise ValueError(f"not a row of equal length for each origin: {', '.join(sorted(ragged))}")

    def head(row):
        import io

        out = io.BytesIO()
        shape = known[row["matrix_key"]]
        np.lib.format.write_array_header_1_0(out, {"descr": "<u2", "fortran_order": False, "shape": (shape["n"], shape["width"])})
        return out.getvalue()

    def body(batch, _):
        return batch.column("seconds").flatten().to_numpy(zero_copy_only=False).astype("<u2").tobytes()

    ordered = rows.select("matrix_key", "origin", "seconds").repartition(max(1, len(known)), "matrix_key").sortWithinPartitions("matrix_key", "origin")
    files = {r["matrix_key"]: r["file"] for r in streamed_files(ordered, uri, "matrix_key", ".npy", head, body).collect()}
    n_cells = cells.count()

    def listed(batch, more):
        return (", " * more + ", ".join(json.dumps(r, separators=(",", ":")) for r in batch.drop_columns("part").to_pylist())).encode()

    place = cells.select(F.lit("grid").alias("part"), F.col("cell_id").alias("id"), F.col("cell_id").cast("string").alias("h3"), "lat", "lon").repartition(1).sortWithinPartitions("id")
    start = f'{{"grid_version": {json.dumps(grid_version)}, "n_cells": {n_cells}, "cells": ['.encode()
    grid = [r["file"] for r in streamed_files(place, uri, "part", ".json", lambda _: start, listed, b"]}").collect()]
    entries = {
        key: {
            "file": files[key], "build_inputs": {"mode": key}, "shape": [r["n"], r["width"]], "coverage_pct": round(100 * r["ok"] / max(1, r["n"] * r["width"]), 2), "max_seconds": max_seconds,
            "min_seconds": r["lo"], "timezone": (timezones or {}).get(key),
        }
        for key, r in sorted(known.items())
    }
    manifest = {"format_version": SUPPORTED_FORMAT, "grid_version": grid_version, "grid": {"file": grid[0] if grid else "grid.json", "n_cells": n_cells}, "matrices": entries}
    write_file(spark, f"{folder}/manifest.json", json.dumps(manifest).encode())


def grid_path(spark: SparkSession, folder: str) -> str:
    """Where the manifest of a data set says its grid is."""
    return f"{folder}/{json.loads(read_file(spark, f'{folder}/manifest.json'))['grid']['file']}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) as Spark's own readers see them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, there as a whole or not at all, through the same file systems that Spark reads."""
    fs, at = hadoop_path(spark, path)
    part = hadoop_path(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")[1]
    out = fs.create(part, True)
    try:
        out.write(content)
    finally:
        out.close()
    if not fs.rename(part, at):  # the target may be there from before
        fs.delete(at, False)
        if not fs.rename(part, at):
            raise OSError(f"can't write {path}")


def read_file(spark: SparkSession, path: str) -> bytes:
    """A small file's content."""
    fs, at = hadoop_path(spark, path)
    jvm, held = spark.sparkContext._jvm, spark.sparkContext._jvm.java.io.ByteArrayOutputStream()
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(fs.open(at), held, 1 << 16, True)
    return bytes(held.toByteArray())


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it is absent."""
    fs, at = hadoop_path(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def delete_path(spark: SparkSession, path: str) -> None:
    fs, at = hadoop_path(spark, path)
    fs.delete(at, True)


def read_tables(spark: SparkSession, where: str, fmt: str = "parquet", partitions: dict[str, tuple[str, int, int, int]] | None = None, **options) -> dict[str, DataFrame]:
    """The model's tables under their schemas: Parquet below a folder, or tables of a JDBC URL.

    Of a JDBC table only the model's columns are asked for.  ``partitions`` gives
    tables a numeric column, its range and a number of parallel reads.
    """
    if fmt == "jdbc":
        return {t: under_schema(_jdbc_reader(spark, where, t, (partitions or {}).get(t), options).load(), TABLES[t]) for t in TABLES}
    return {t: spark.read.schema(schema).format(fmt).options(**options).load(f"{where}/{t}") for t, schema in TABLES.items()}


def under_schema(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the schema's columns (found in either case of letters) and types; arrays and maps may come as JSON text."""
    given = {name.lower(): (name, kind) for name, kind in df.dtypes}

    def column(name: str, kind: str) -> Column:
        there, now = given[name.lower()]
        nested = kind.lower().startswith(("array", "map")) and now == "string"
        return (F.from_json(F.col(there), kind) if nested else F.col(there).cast(kind)).alias(name)

    return df.select(*[column(*c.split()) for c in schema.split(", ")])


def jdbc_options(where: str, table: str, split: tuple[str, int, int, int] | None) -> dict[str, str]:
    """Options of a JDBC read of the model's columns; ``split``: column, lower and upper bound, number of reads."""
    columns = ", ".join(c.split()[0] for c in TABLES[table].replace("MAP<STRING,STRING>", "MAP").split(", "))
    found = {"url": where, "dbtable": f"(SELECT {columns} FROM {table}) {table}"}
    if split:
        found |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, split), strict=True))
    return found


def _jdbc_reader(spark, where, table, split, options):
    return spark.read.format("jdbc").options(**jdbc_options(where, table, split), **options)


def read_evolved(spark: SparkSession, *paths: str) -> DataFrame:
    """Files of older and newer schemas as one table; columns that a file lacks are null."""
    first, *rest = [spark.read.parquet(p) for p in paths]
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def validate_dataset(matrices: DataFrame, cells: DataFrame, rows: DataFrame) -> DataFrame:
    """(check, key, ok, detail) for format, grid versions, cell counts and matrix shapes."""
    head = matrices.agg(F.min("format_version").alias("f"), F.max("format_version").alias("f2"), F.min("grid_version").alias("v"), F.min("n_cells").alias("n"))
    grid = cells.agg(F.min("grid_version").alias("gv"), F.max("grid_version").alias("gv2"), F.min("n_cells").alias("gn"), F.count("*").alias("count"), F.count_distinct("cell_id").alias("ids"))
    both = F.broadcast(head).join(F.broadcast(grid))  # one row each

    def check(name, ok, detail):
        return both.select(F.lit(name).alias("check"), F.lit(None).cast("string").alias("key"), F.coalesce(ok, F.lit(False)).alias("ok"), F.concat_ws(" ", *detail).alias("detail"))

    shapes = rows.groupBy("matrix_key").agg(F.count_distinct("origin").alias("o"), F.count("*").alias("r"), F.min(F.size("seconds")).alias("a"), F.max(F.size("seconds")).alias("b"))
    shaped = matrices.select("matrix_key", "n_cells").join(shapes, "matrix_key", "left").select(
        F.lit("matrix_shape").alias("check"), F.col("matrix_key").alias("key"),
        F.coalesce((F.col("o") == F.col("n_cells")) & (F.col("r") == F.col("n_cells")) & (F.col("a") == F.col("n_cells")) & (F.col("b") == F.col("n_cells")), F.lit(False)).alias("ok"),
        F.concat_ws(" ", F.col("o").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")).alias("detail"),
    )
    c = F.col
    return (
        check("format_version", (c("f") == SUPPORTED_FORMAT) & (c("f2") == SUPPORTED_FORMAT), [c("f").cast("string")])
        .union(check("grid_version", (c("v") == c("gv")) & (c("gv") == c("gv2")), [c("v"), c("gv")]))
        .union(check("n_cells", (c("n") == c("gn")) & (c("n") == c("count")) & (c("n") == c("ids")), [c("n").cast("string"), c("count").cast("string")]))
        .union(shaped)
    )


def require_valid(checks: DataFrame) -> None:
    """Raise if any check failed."""
    bad = checks.where("not ok").limit(20).collect()
    if bad:
        raise ValueError("the data set is not valid: " + "; ".join(f"{r['check']} {r['key'] or ''} ({r['detail']})" for r in bad))


def dataset_timezone(matrices: DataFrame) -> DataFrame:
    """One row: the time zone of the first matrix that has one, else the default."""
    first = matrices.where("timezone is not null").agg(F.min_by("timezone", "pos").alias("timezone"))
    return first.select(F.coalesce("timezone", F.lit(DEFAULT_TIMEZONE)).alias("timezone"))


def write_results(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).format(fmt).save(path)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features as places: key, label, context, position, and their fields."""
    from ..functions.geo import place_context, place_label

    fields = "osm_type STRING, osm_id BIGINT, name STRING, street STRING, housenumber STRING, postcode STRING, city STRING, district STRING, state STRING, country STRING"
    schema = f"features ARRAY<STRUCT<geometry: STRUCT<coordinates: ARRAY<DOUBLE>>, properties: STRUCT<{fields.replace(' STRING', ': STRING').replace(' BIGINT', ': BIGINT')}>>>"
    flat = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("index", "f")).select("index", "f.properties.*", "f.geometry.coordinates")
    c = F.col
    return flat.select(
        F.concat(F.coalesce("osm_type", F.lit("?")), F.coalesce(c("osm_id"), c("index")).cast("string"), F.lit("-"), c("index").cast("string")).alias("key"),
        place_label(c("name"), c("street"), c("housenumber")).alias("label"),
        place_context(c("postcode"), c("city"), c("district"), c("state"), c("country")).alias("context"),
        F.element_at("coordinates", 2).alias("lat"), F.element_at("coordinates", 1).alias("lon"), *[c(x.split()[0]) for x in fields.split(", ")],
    )
