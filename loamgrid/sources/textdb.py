"""Tables of tab-separated text with a schema file beside them, and the document loaders on top.

`BASE[-SPLIT].data.txt[.gz|.bz2]` holds rows, `BASE[-SPLIT].schema.txt` names:
the field names in its first line, then `field TAB value [TAB description]` for
fields that have one value in all rows.  Listing and schema files are read
through Spark's file system, so any store that Spark reads will do.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_as_null, decode_counts, decode_field, decode_sequence, encode_counts, encode_field, encode_sequence
from ..functions.geo import parse_coordinate, valid_coordinate

SCHEMA, DATA = ".schema.txt", ".data.txt"


@dataclass
class Schema:
    names: list[str]
    fixed: dict[str, str] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def parse(text: str) -> Schema:
        lines = [x for x in text.split("\n") if x]
        if not lines:
            raise ValueError("the schema is empty")
        names = lines[0].split("\t")
        if any(not n for n in names):
            raise ValueError("a field has no name")
        out = Schema(names)
        for line in lines[1:]:
            parts = line.split("\t")
            if len(parts) not in (2, 3) or not parts[0]:
                raise ValueError(f"bad schema line: {line!r}")
            out.fixed[parts[0]] = parts[1]
            if len(parts) == 3:
                out.notes[parts[0]] = parts[2]
        return out

    def show(self) -> str:
        lines = ["\t".join(self.names)]
        lines += ["\t".join([k, v] + ([self.notes[k]] if k in self.notes else [])) for k, v in self.fixed.items()]
        return "\n".join(lines) + "\n"

    def changed(self, add: dict[str, str] | None = None, remove: Sequence[str] = (), rename: dict[str, str] | None = None) -> Schema:
        """A derived schema."""
        rename = rename or {}
        fixed = {rename.get(k, k): v for k, v in self.fixed.items() if k not in remove} | (add or {})
        return Schema([rename.get(n, n) for n in self.names if n not in remove], fixed, {k: v for k, v in self.notes.items() if k in fixed})


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_folder(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.getFileStatus(at).isDirectory()


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Files and data folders under a folder, or those whose names begin with the path; sorted."""
    at, fs = _fs(spark, path)
    if fs.exists(at) and fs.getFileStatus(at).isDirectory():
        found = fs.listStatus(at)
    else:
        glob, fs = _fs(spark, path + "*")
        found = fs.globStatus(glob) or []
    return sorted(str(f.getPath()) for f in found if not f.isDirectory() or f.getPath().getName().endswith(DATA))


def read_small(spark: SparkSession, path: str) -> str:
    """A small file of the driver's: a schema or a word list."""
    return "\n".join(r[0] for r in spark.read.text(path, lineSep="\n").collect())


def write_small(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _fs(spark, path)
    stream = fs.create(at, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def find(spark: SparkSession, base: str, suffix: str = "") -> tuple[str, list[str]]:
    """(schema file, data files) of a folder, prefix, or one of the files; the schema must be the only one that fits."""
    base = re.sub(r"\.(?:schema|data)\.txt(?:\.\w+)?$", "", base)
    files = list_files(spark, base)
    fits = re.compile(rf"{suffix}\.(schema|data)\.txt(?:\.(?:gz|bz2))?$")
    named = {f: m[1] for f in files if (m := fits.search(f))}
    schemas = [f for f, kind in named.items() if kind == "schema"]
    if len(schemas) != 1:
        raise ValueError(f"{len(schemas)} schema files for {base}{suffix}")
    data = [f for f, kind in named.items() if kind == "data"]
    if not data:
        raise ValueError(f"no data files for {base}{suffix}")
    return schemas[0], data


def scan(spark: SparkSession, base: str, suffix: str = "", with_rejects: bool = False):
    """Rows of a table, all fields as text, with the fixed fields as constant columns.

    Data may be files or the folders that `write` makes.  Lines with another
    number of fields go; with_rejects also returns them, as (file, line), so
    that they can be counted or kept.
    """
    schema_file, data = find(spark, base, suffix)
    schema = Schema.parse(read_small(spark, schema_file))
    lines = spark.read.text(data, lineSep="\n").select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("src_file"))
    parts = F.split("value", "\t", -1)
    good = F.size(parts) == len(schema.names)
    rows = lines.filter(good).select(
        *[parts[i].alias(n) for i, n in enumerate(schema.names)], *[F.lit(v).alias(k) for k, v in schema.fixed.items() if k not in schema.names]
    )
    if not with_rejects:
        return rows
    return rows, lines.filter(~good).select("src_file", F.col("value").alias("line"))


#: What a null is written as; no encoded value holds it, for a percent sign is written as %25.
NULL = "%NULL"


def kind_of(data_type: T.DataType) -> str | None:
    """The codec that `write` uses for a column of this type; None: its text as Spark casts it."""
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, T.StringType):
        return "sequence"
    if isinstance(data_type, T.MapType) and isinstance(data_type.keyType, T.StringType) and isinstance(data_type.valueType, T.IntegralType):
        return "counts"
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        raise ValueError(f"a table of text can't hold {data_type.simpleString()}")
    return None


def write(rows: DataFrame, base: str, schema: Schema | None = None, suffix: str = "", compression: str | None = None) -> None:
    """Write a table: data as a folder of part files `BASE.data.txt/`, the schema beside it.

    Each value is encoded by the type of its column (`kind_of`), so tabs, line
    ends and percent signs survive; nulls are written as NULL.  Pass values as
    they are, not those of `encoded`.  Columns that the schema fixes are left
    out.  `read_back` undoes it; `scan` gives the encoded text.
    """
    schema = schema or Schema(list(rows.columns))
    types = {f.name: f.dataType for f in rows.schema.fields}

    def shown(name: str) -> Column:
        kind, at = kind_of(types[name]), raw_column(name)
        return F.coalesce(CODECS[kind][0](at) if kind else at.cast("string"), F.lit(NULL))

    writer = rows.select(F.concat_ws("\t", *[shown(n) for n in schema.names]).alias("value")).write
    if compression:
        writer = writer.option("compression", compression)
    path = f"{base}{suffix}"
    writer.text(f"{path}{DATA}")
    write_small(rows.sparkSession, f"{path}{SCHEMA}", schema.show())


def read_back(spark: SparkSession, base: str, suffix: str = "", kinds: dict[str, str] | None = None, with_rejects: bool = False):
    """A table of `write`, scanned and decoded: by `kinds` where a field has one there, else as a string.

    NULL is null again, of any kind.  Lines that do not fit are returned too,
    as `scan` does, if with_rejects.
    """
    rows, rejects = scan(spark, base, suffix, with_rejects=True)
    fixed = Schema.parse(read_small(spark, find(spark, base, suffix)[0])).fixed
    out = []
    for name in rows.columns:
        at = raw_column(name)
        if name not in fixed:
            at = CODECS[(kinds or {}).get(name, "string")][1](F.nullif(at, F.lit(NULL)))
        out.append(at.alias(name))
    rows = rows.select(*out)
    return (rows, rejects) if with_rejects else rows


#: Codecs by kind: (to text, from text).
CODECS = {
    "string": (encode_field, decode_field),
    "sequence": (encode_sequence, decode_sequence),
    "counts": (encode_counts, decode_counts),
    "int": (lambda c: c.cast("string"), lambda c: blank_as_null(c).try_cast("int")),
    "long": (lambda c: c.cast("string"), lambda c: blank_as_null(c).try_cast("long")),
    "double": (lambda c: c.cast("string"), lambda c: blank_as_null(c).try_cast("double")),
}


def typed(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return rows.withColumns({c: CODECS[k][1](F.col(c)) for c, k in kinds.items()})


def encoded(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return rows.withColumns({c: CODECS[k][0](F.col(c)) for c, k in kinds.items()})


# --- documents ------------------------------------------------------------------------

#: Fields of each corpus type beside title, id, split, coord: fixed values.
CORPUS_FIELDS = {
    "wikipedia": ("incoming_links", "redir", "namespace", "is_list_of", "is_disambig", "is_list"),
    "twitter-tweet": ("salience", "lang", "location", "timezone", "utc_offset"),
    "twitter-user": ("salience", "lang", "location", "timezone", "utc_offset", "user"),
    "cophir": ("salience", "photo-id", "owner-id"),
    "generic": ("salience",),
}


def documents(rows: DataFrame, corpus_type: str = "generic", importance: float = 1.0, domain: str | None = None, split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of raw rows.

    Adds lat, lon, salience, importance and domain.  A training document without
    a coordinate is skipped, one with an impossible coordinate or the wrong
    split is bad, and so is a Wikipedia page outside the main namespace;
    `status` and `reason` of the rejects say so.
    """
    have = set(rows.columns)
    fields = CORPUS_FIELDS.get(corpus_type, CORPUS_FIELDS["generic"])
    text = F.col("coord") if "coord" in have else F.lit(None).cast("string")
    lat, lon = parse_coordinate(text)
    salience = "incoming_links" if corpus_type == "wikipedia" else "salience"
    amount = blank_as_null(F.col(salience)).try_cast("double") if salience in have else F.lit(None).cast("double")
    out = rows.withColumns({"lat": lat, "lon": lon, "salience": amount, "importance": F.lit(importance), "domain": F.lit(domain).cast("string")})
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    reason = F.when(~blank & ~valid_coordinate(F.col("lat"), F.col("lon")), "bad: coordinate")
    if split and "split" in have:
        reason = reason.when(F.col("split") != split, "bad: split")
    if "namespace" in have and "namespace" in fields:
        reason = reason.when(~F.coalesce(F.col("namespace"), F.lit("")).isin("", "Main"), "skipped: namespace")
    if (split or "training") == "training":
        reason = reason.when(blank, "skipped: no coordinate")
    marked = out.withColumn("_why", reason)
    rejects = marked.filter("_why is not null")
    rejects = rejects.withColumns({"status": F.substring_index("_why", ":", 1), "reason": F.substring_index("_why", ": ", -1)}).drop("_why")
    return marked.filter("_why is null").drop("_why"), rejects


def corpora(spark: SparkSession, bases: Sequence[str], importance: Sequence[float] = (), mode: str = "concatenate", suffix: str = "") -> DataFrame:
    """Several corpora as one relation with `corpus_id` and `importance`.

    concatenate: all are one corpus (corpus_id 0); separate-grids and
    interpolate: each keeps its number.
    """
    if mode not in ("concatenate", "separate-grids", "separate-grid", "interpolate"):
        raise ValueError(f"unknown way to combine corpora: {mode}")
    weights = list(importance) or [1.0] * len(bases)
    out = None
    for i, (base, w) in enumerate(zip(bases, weights, strict=True)):
        rows = scan(spark, base, suffix).withColumns({"corpus_id": F.lit(0 if mode == "concatenate" else i), "importance": F.lit(float(w))})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


# --- small files ----------------------------------------------------------------------


def word_list(spark: SparkSession, path: str) -> list[str]:
    """Stopwords or a whitelist: a word per line, read by the driver."""
    return [w.strip() for w in read_small(spark, path).split("\n") if w.strip()]


def word_weights(spark: SparkSession, path: str) -> DataFrame:
    """(gram, weight) of lines `word TAB weight`."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].alias("gram"), F.get(parts, 1).try_cast("double").alias("weight")).filter("weight is not null")


def points(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon) of lines `LAT,LONG`."""
    lat, lon = parse_coordinate(F.col("value"))
    return spark.read.text(path).select(lat.alias("lat"), lon.alias("lon")).filter("lat is not null and lon is not null")


def boxes(spark: SparkSession, path: str) -> list[tuple[float, float, float, float]]:
    """Lines `SWLAT,SWLONG,NELAT,NELONG` (or with colons)."""
    return [tuple(map(float, re.split("[,:]", x))) for x in read_small(spark, path).split("\n") if x.strip()]


def raw_column(name: str) -> Column:
    return F.col(f"`{name}`")
