"""Readers and writers of measurements: instrument text files, Parquet, JSON records."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlake.operators.segments import seg_filter, segment_by_change, state_sign
from voltlake.operators.storage import qualified, staged
from voltlake.sources.lines import located, numbered_lines

#: Unit prefixes and time units of column headers.
PREFIXES = {"M": 1e6, "k": 1e3, "m": 1e-3, "µ": 1e-6, "μ": 1e-6, "n": 1e-9}
TIMES = {"s": 1.0, "m": 60.0, "min": 60.0, "h": 3600.0}
UNITS = ("A", "V", "Ω", "Ohm", "Hz", "W", "C")


def unit_factor(header: str) -> tuple[str, float]:
    """Name and factor to the unit without prefix of a header ``name [unit]``; an unknown unit has factor 1."""
    found = re.fullmatch(r"\s*(.*?)\s*\[(.*)\]\s*", header)
    if not found:
        return header.strip(), 1.0
    name, unit = found.groups()
    if name in ("t", "time") and unit in TIMES:
        return name, TIMES[unit]
    if unit == "deg":
        return name, 0.017453292519943295
    if len(unit) > 1 and unit[0] in PREFIXES and unit[1:] in UNITS:
        return name, PREFIXES[unit[0]]
    return name, 1.0


def unit_scale(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Scales the named columns by their headers' units and gives them the headers' names."""
    out = df
    for column, header in headers.items():
        name, factor = unit_factor(header)
        out = out.withColumn(column, F.col(column) * F.lit(factor)).withColumnRenamed(column, name)
    return out


def decimal(text: Column, symbol: str = ",") -> Column:
    """A number written with another decimal symbol; null if it is none."""
    return F.replace(text, F.lit(symbol), F.lit(".")).try_cast("double")


def file_number(name: Column, digits: int) -> Column:
    """The last digits of a file name's digits, as a number; null without any."""
    return F.right(F.regexp_replace(name, "[^0-9]", ""), F.lit(digits)).try_cast("int")


def read_instrument_csv(spark: SparkSession, path: str | Sequence[str], columns: dict[int, str], skip: int = 0, delimiter: str = "\t", encoding: str = "utf-8", symbol: str = ".", limit: int | None = None, keep: Sequence[int] = ()) -> DataFrame:
    """file, pt and the given columns (position -> ``name [unit]``) of delimited text files, in SI units.

    Lines aren't split by quotes; the first ``skip`` of each file are comments, blank ones among them; at most ``limit`` data lines of each file are taken.
    Blank data lines are rows without values. ``encoding``: any that Python knows.
    Values of columns without a unit that aren't numbers stay as text in ``<name>_text``. Columns at positions ``keep`` come as text in ``_cell<position>``.
    """
    rows = numbered_lines(spark, path, encoding).withColumn("pt", F.col("n") - skip).filter("pt >= 0")
    if limit is not None:
        rows = rows.filter(F.col("pt") < limit)
    cells = F.split("line", re.escape(delimiter))
    out = [F.trim(F.get(cells, F.lit(k))).alias(f"_cell{k}") for k in keep]
    for k, header in columns.items():
        name, factor = unit_factor(header)
        cell = F.trim(F.get(cells, F.lit(k)))
        number = decimal(cell, symbol) if symbol != "." else cell.try_cast("double")
        out.append((number * F.lit(factor)).alias(name))
        if "[" not in header:
            out.append(F.when(number.isNull(), cell).alias(f"{name}_text"))
    return rows.select("file", F.col("pt").cast("long").alias("pt"), *out)


#: Names of columns in headers, and what they are called here.
CYCLING = {"t": "t", "I": "i", "U": "u"}
IMPEDANCE = {"f": "f", "real": "re", "imag": "im", "phase": "phase", "abs": "abs"}


def read_instrument(
    spark: SparkSession, path: str | Sequence[str], columns: dict[int, str], skip: int = 0, delimiter: str = "\t", encoding: str = "utf-8", symbol: str = ".", limit: int | None = None,
    datatype: str = "cycling", segment_column: int | None = None, segments: Sequence[int] | None = None, state_column: int | None = None, signs: dict[str, float] | None = None,
    flip_voltage: bool = False, flip_imaginary: bool = False,
) -> DataFrame:
    """A measurement in one call: file, seg_pos, pt, then t, i, u (cycling), with static features per segment beside them (static), or f, re, im (impedance; from real and
    imag, or from abs and phase), and further columns of ``columns``.

    A new segment begins where the text of ``segment_column`` changes (without one, a file is one segment), counted from 0 in all lines of a file before ``segments`` keeps
    some. Currents are multiplied by the factor in ``signs`` of the text in ``state_column``; a text without one fails the job. ``flip_voltage`` turns the sign of the voltage, or of
    both impedance parts; ``flip_imaginary`` that of the imaginary part (both cancel out there).
    """
    keep = sorted({k for k in (segment_column, state_column) if k is not None})
    d = read_instrument_csv(spark, path, columns, skip, delimiter, encoding, symbol, limit, keep).withColumn("meas_id", F.col("file"))
    d = segment_by_change(d, f"_cell{segment_column}") if segment_column is not None else d.withColumn("seg_pos", F.lit(0))
    if segments is not None:
        d = seg_filter(d, segments)
    names = IMPEDANCE if datatype == "impedance" else CYCLING
    for given, name in names.items():
        d = d.withColumnRenamed(given, name) if given in d.columns else d
    if signs and state_column is not None:
        d = state_sign(d, signs, f"_cell{state_column}", "i")
    if datatype == "impedance":
        if "re" not in d.columns:
            d = d.withColumn("re", F.col("abs") * F.cos("phase")).withColumn("im", F.col("abs") * F.sin("phase"))
        d = d.withColumn("re", F.col("re") * (-1 if flip_voltage else 1)).withColumn("im", F.col("im") * (-1 if flip_voltage != flip_imaginary else 1))
    elif flip_voltage:
        d = d.withColumn("u", -F.col("u"))
    d = d.drop(*[f"_cell{k}" for k in keep])
    if datatype == "static":
        from voltlake.operators.fits import static_features

        d = d.join(static_features(d), ["meas_id", "seg_pos"], "left")
    return d.drop("meas_id")


def comment_lines(spark: SparkSession, path: str, skip: int, encoding: str = "utf-8") -> DataFrame:
    """file, n, line of the comments in front of each file."""
    return numbered_lines(spark, path, encoding).filter(F.col("n") < skip).select("file", "n", "line")


def write_parquet(df: DataFrame, path: str, level: int = 3) -> None:
    """Sorted by segment within measurements, so statistics prune row groups; ZSTD at the given level."""
    ordered = df.repartition("meas_id").sortWithinPartitions("meas_id", "seg_pos", "pt")
    ordered.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)


#: Row groups of a file: a writer holds what it has to say of each until its file is closed.
FILE_GROUPS = 4096


def write_segments(df: DataFrame, folder: str, level: int = 3, file_groups: int = FILE_GROUPS) -> DataFrame:
    """uri, groups, rows of Parquet files in which each segment is one row group, so that readers fetch segments alone.

    ``df``: meas_id, seg_pos, pt and further columns. A task holds one segment and the footer of one file at a time, of at most ``file_groups`` groups.
    Files of repeated attempts aren't in the result.
    """
    place = qualified(df.sparkSession, folder)
    ordered = df.repartition("meas_id", "seg_pos").sortWithinPartitions("meas_id", "seg_pos", "pt")

    def run(batches):
        system, path, _ = located(place)
        system.create_dir(path, recursive=True)
        name, held, out, key, groups, rows = None, [], None, None, 0, 0

        def flush():
            nonlocal name, out, groups, rows
            table = pa.Table.from_batches(held)
            if out is None:
                name, groups, rows = f"part-{uuid.uuid4().hex}.parquet", 0, 0
                out = pq.ParquetWriter(f"{path}/{name}", table.schema, filesystem=system, compression="zstd", compression_level=level)
            out.write_table(table, row_group_size=max(1, table.num_rows))
            groups, rows = groups + 1, rows + table.num_rows
            held.clear()

        def closed():
            nonlocal out
            out.close()
            out = None
            return pa.RecordBatch.from_pydict({"uri": [f"{place}/{name}"], "groups": [groups], "rows": [rows]})

        for batch in batches:
            keys = list(zip(batch["meas_id"].to_pylist(), batch["seg_pos"].to_pylist(), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and keys[a] != key:
                    flush()
                    if groups >= file_groups:
                        yield closed()
                key = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            flush()
        if out:
            yield closed()

    return staged(ordered.mapInArrow(run, "uri string, groups long, rows long"), "manifest")


def write_lines(df: DataFrame, folder: str, key: str, order: str, header: str, columns: Sequence[str], delimiter: str = "\t") -> DataFrame:
    """file, lines of text files, one for each value of ``key`` by the name ``<key>=<value>.csv``, all in one folder: the header, then the rows' columns by rising ``order``.

    A task streams one file at a time. A file gets its name when it is whole, so repeated attempts replace it by the same.
    """
    place = qualified(df.sparkSession, folder)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    lines = df.select(F.col(key).cast("string").alias("key"), F.col(order).alias("order"), F.concat_ws(delimiter, *cells).alias("line"))
    lines = lines.repartition("key").sortWithinPartitions("key", "order").select("key", "line")

    def run(batches):
        system, path, _ = located(place)
        system.create_dir(path, recursive=True)
        out, own, held, n = None, None, "", 0

        def closed():
            out.close()
            system.move(held, f"{path}/{key}={own}.csv")
            return pa.RecordBatch.from_pydict({"file": [f"{place}/{key}={own}.csv"], "lines": [n]})

        for batch in batches:
            keys, texts = batch["key"].to_pylist(), batch["line"].to_pylist()
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if out is None or keys[a] != own:
                    if out is not None:
                        yield closed()
                    own, held, n = keys[a], f"{path}/.{uuid.uuid4().hex}", 0
                    out = system.open_output_stream(held)
                    out.write(f"{header}\n".encode())
                out.write("".join(f"{x}\n" for x in texts[a:b]).encode())
                n += b - a
        if out is not None:
            yield closed()

    return staged(lines.mapInArrow(run, "file string, lines long"), "manifest")


def read_parquet(spark: SparkSession, path: str, known: Sequence[str] = ("meas_id", "seg_pos", "pt", "t", "i", "u")) -> tuple[DataFrame, list[str]]:
    """The measurement, and the names of its further columns."""
    df = spark.read.parquet(path)
    return df, [c for c in df.columns if c not in known]


SEGMENTS = "struct<timepoints:array<array<double>>,currents:array<array<double>>,voltages:array<array<double>>,indices:array<bigint>>"


def to_measurement_json(df: DataFrame) -> DataFrame:
    """meas_id, json: nested lists of segments of points, in order."""
    inner = df.groupBy("meas_id", "seg_pos").agg(F.array_sort(F.collect_list(F.struct("pt", "t", "i", "u"))).alias("p"))
    outer = inner.groupBy("meas_id").agg(F.array_sort(F.collect_list(F.struct("seg_pos", "p"))).alias("s"))
    lists = lambda c: F.transform("s", lambda g: F.transform(g["p"], lambda p: p[c]))
    record = F.struct(lists("t").alias("timepoints"), lists("i").alias("currents"), lists("u").alias("voltages"), F.transform("s", lambda g: g["seg_pos"].cast("long")).alias("indices"))
    return outer.select("meas_id", F.to_json(record).alias("json"))


def from_measurement_json(df: DataFrame) -> DataFrame:
    """meas_id, seg_pos, pt, t, i, u of such records."""
    m = df.select("meas_id", F.from_json("json", SEGMENTS).alias("m"))
    segs = m.select("meas_id", F.explode(F.arrays_zip("m.indices", "m.timepoints", "m.currents", "m.voltages")).alias("s"))
    points = segs.select("meas_id", F.col("s.indices").cast("int").alias("seg_pos"), F.posexplode(F.arrays_zip(F.col("s.timepoints").alias("t"), F.col("s.currents").alias("i"), F.col("s.voltages").alias("u"))).alias("pt", "p"))
    return points.select("meas_id", "seg_pos", F.col("pt").cast("long").alias("pt"), "p.t", "p.i", "p.u")


def to_ocv_json(df: DataFrame) -> DataFrame:
    """meas_id, json: parallel arrays of SOC, voltage and source index."""
    rows = df.groupBy("meas_id").agg(F.array_sort(F.collect_list(F.struct("source_index", "soc", "ocv"))).alias("r"))
    lists = lambda c: F.transform("r", lambda x: x[c])
    return rows.select("meas_id", F.to_json(F.struct(lists("soc").alias("SOC [C]"), lists("ocv").alias("OCV [V]"), lists("source_index").alias("indices"))).alias("json"))


def from_ocv_json(df: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("SOC [C]", T.ArrayType(T.DoubleType())), T.StructField("OCV [V]", T.ArrayType(T.DoubleType())), T.StructField("indices", T.ArrayType(T.LongType()))])
    m = df.select("meas_id", F.from_json("json", schema).alias("m"))
    rows = m.select("meas_id", F.explode(F.arrays_zip(F.col("m.`SOC [C]`").alias("soc"), F.col("m.`OCV [V]`").alias("ocv"), F.col("m.indices").alias("source_index"))).alias("x"))
    return rows.select("meas_id", "x.*")


def to_result_json(df: DataFrame) -> DataFrame:
    """run_id, json: estimates (name, value, lo, hi) as maps."""
    pairs = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", value.alias("v")))))
    rows = df.groupBy("run_id").agg(pairs(F.col("value")).alias("inferred parameters"), pairs(F.array("lo", "hi")).alias("error bounds"))
    return rows.select("run_id", F.to_json(F.struct("`inferred parameters`", "`error bounds`")).alias("json"))


def from_result_json(df: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("inferred parameters", T.MapType(T.StringType(), T.DoubleType())), T.StructField("error bounds", T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))])
    m = df.select("run_id", F.from_json("json", schema).alias("m"))
    rows = m.select("run_id", F.explode("m.`inferred parameters`").alias("name", "value"), F.col("m.`error bounds`").alias("b"))
    bound = lambda k: F.try_element_at(F.try_element_at("b", F.col("name")), F.lit(k))
    return rows.select("run_id", "name", "value", bound(1).alias("lo"), bound(2).alias("hi"))


def by_catalog(spark: SparkSession, catalog: DataFrame, columns: dict[int, str], **options) -> DataFrame:
    """Reads the files that the catalog names and adds what it says about them: ``path`` (a file or folder, without wildcards) and any other columns.

    The catalog is metadata, a row per file or folder; its paths are what the driver hands to the reader. A file belongs to the longest path that it
    begins with. Columns ``encoding``, ``skip``, ``delimiter`` and ``symbol`` of the catalog hold for their row's files, and nulls in them for none: then ``options`` do.
    """
    known = catalog.collect()
    if not known:
        raise ValueError("the catalog names no file")
    own = [c for c in ("encoding", "skip", "delimiter", "symbol") if c in catalog.columns]
    kinds: dict[tuple, list[str]] = {}
    for r in known:
        kinds.setdefault(tuple(r[c] for c in own), []).append(r["path"])
    d = None
    for kind, paths in kinds.items():  # a plan for each way of reading, not for each file
        given = options | {c: v for c, v in zip(own, kind, strict=True) if v is not None}
        some = read_instrument_csv(spark, paths, columns, **given)
        d = some if d is None else d.unionByName(some)
    files = d.select("file").distinct()
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")
    named = F.broadcast(spark.createDataFrame(known, catalog.schema).withColumnRenamed("path", "_path"))
    of = files.join(named, plain(F.col("file")).startswith(plain(F.col("_path"))))
    best = of.groupBy("file").agg(F.max_by(F.struct(*[c for c in named.columns if c != "_path"]), F.length("_path")).alias("_c"))
    return d.join(best, "file").select(*d.columns, "_c.*")
