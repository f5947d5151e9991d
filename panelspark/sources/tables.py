"""Readers and writers for period tables and draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULLS = ("", "NA")
LINE = "_line"    # place of a row in its file, where a reader is asked for it

# Names of the sampler's own columns, kept apart from the parameters.
SAMPLER_INTERNALS = (
    "lp", "n_steps", "is_accept", "acceptance_rate", "log_density", "hamiltonian_energy",
    "hamiltonian_energy_error", "max_hamiltonian_energy_error", "tree_depth", "numerical_error",
    "step_size", "nom_step_size",
)

DRAWS = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("param", T.StringType()),
    T.StructField("chain", T.IntegerType()),
    T.StructField("iter", T.LongType()),
    T.StructField("value", T.DoubleType()),
])


def read_delimited(spark: SparkSession, path: str, columns: list, period: str, sep: str = ",",
                   nulls: tuple = NULLS, types: dict | None = None, lines: bool = False) -> DataFrame:
    """The named ``columns`` of delimited text, found by the file's header in any order.

    ``lines`` adds ``LINE``, which orders rows as the files do, for ``first_match``.

    A name the header lacks is an error.  Every field is read as text, the strings in ``nulls`` become null, rows
    without a period are dropped and the fields named in ``types`` are cast.  A
    field that does not parse as its type is null rather than an error.
    """
    header = spark.read.csv(path, sep=sep, header=False).first()    # the first line only
    names = distinct_names([c or f"column {k}" for k, c in enumerate(header or columns)])
    if missing := [c for c in columns if c not in names]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = spark.read.csv(path, sep=sep, header=True, schema=schema, enforceSchema=True)
    types = types or {}
    picked = []
    for c in columns:
        text = F.when(~F.trim(F.col(c)).isin(*nulls), F.col(c))
        picked.append((text.try_cast(types[c]) if c in types else text).alias(c))
    if lines:
        picked.append(F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"),
                               F.monotonically_increasing_id().alias("row")).alias(LINE))
    return raw.select(*picked).filter(F.col(period).isNotNull())


# Header of the statistical office's long format, in file order.
SDMX_COLUMNS = [
    "STRUCTURE", "STRUCTURE_ID", "STRUCTURE_NAME", "freq", "Time frequency", "unit", "Unit of measure",
    "age", "Age class", "sex", "Sex", "geo", "Geopolitical entity (reporting)", "TIME_PERIOD", "Time",
    "OBS_VALUE", "Observation value", "OBS_FLAG", "Observation status (Flag) V2 structure",
    "CONF_STATUS", "Confidentiality status (flag)",
]


def distinct_names(header: list) -> list:
    """Column names that stay apart without regard to case.

    Of names that differ in case only, the lower-case one (a code) stays and the others (its labels) get
    ``label`` appended, in whatever order they come.
    """
    codes = {c for c in header if c == c.lower()}
    return [c if c in codes or c.lower() not in codes else f"{c} label" for c in header]


def read_sdmx(spark: SparkSession, path: str, filters: dict | None = None,
              columns: list | None = None, sep: str = ",") -> DataFrame:
    """SDMX long file to ``(geo, freq, unit, period, value)``.

    ``filters`` maps a dimension code column to the wanted value or values.
    Columns are found by the header, in any order.  Names that differ only in case
    (``sex`` and ``Sex``) are a code and its label; the label columns are renamed on the way in.
    """
    names = columns or list(dict.fromkeys(["geo", "freq", "unit", "TIME_PERIOD", "OBS_VALUE", *(filters or {})]))
    df = read_delimited(spark, path, names, "TIME_PERIOD", sep, types={"OBS_VALUE": "double"})
    for dim, wanted in (filters or {}).items():
        wanted = [wanted] if isinstance(wanted, str) else list(wanted)
        df = df.filter(F.col(dim).isin(*wanted))
    return df.select("geo", "freq", "unit", F.col("TIME_PERIOD").alias("period"), F.col("OBS_VALUE").alias("value"))


def read_observables(spark: SparkSession, path: str, order: list, fmt: str = "parquet",
                     date: str = "date") -> DataFrame:
    """Read back a derived table and select the date and the series in the given order."""
    if fmt == "csv":
        header = T.StructType([T.StructField(c, T.DateType() if c == date else T.DoubleType()) for c in [date, *order]])
        df = spark.read.csv(path, header=True, schema=header, enforceSchema=False)
    else:
        df = spark.read.format(fmt).load(path)
    return df.select(date, *order)


def write_table(df: DataFrame, path: str, order: list | None = None, fmt: str = "csv", mode: str = "error",
                sep: str = ",") -> None:
    """Write a result table with a header and an explicit column order."""
    out = df.select(*order) if order else df
    if fmt == "csv":
        out.write.mode(mode).csv(path, header=True, sep=sep)
    else:
        out.write.mode(mode).format(fmt).save(path)


def write_draws(draws: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store draws under one folder per ``run``, so that a run is read without its neighbours.

    By default the folders of the runs in ``draws`` are replaced and other runs stay, so a rerun is safe.
    """
    (draws.select(*DRAWS.names).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("run").parquet(path))


def read_draws(spark: SparkSession, path: str, run: str | None = None, internals: bool = False) -> DataFrame:
    """Long draws; one run prunes to its folder, sampler internals are left out by default."""
    df = spark.read.schema(DRAWS).parquet(path)
    if run is not None:
        df = df.filter(F.col("run") == run)
    inside = F.col("param").isin(*SAMPLER_INTERNALS)
    return df.filter(inside if internals else ~inside).select(*DRAWS.names)


def wide_draws_to_long(wide: DataFrame, params: list) -> DataFrame:
    """One column per parameter to ``(run, param, chain, iter, value)``."""
    return (wide.unpivot(["run", "chain", "iter"], params, "param", "value")
            .select("run", "param", F.col("chain").cast("int").alias("chain"),
                    F.col("iter").cast("long").alias("iter"), F.col("value").cast("double").alias("value")))
