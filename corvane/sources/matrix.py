"""Reading keyword-in-context matrices, reviewed concordances, catalogues and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.tables import numbered

#: Places (from 1) of node, context, path and url in a matrix without a header.
COLUMNS = {"node": 6, "path": 12, "url": 13, "context": 15}
KEEP, ACCEPT = 0.2, 0.15  # share of file names that keeps a column, and that another one needs


def read_matrix(spark: SparkSession, path: str, columns: dict[str, int] = COLUMNS, kind: str = "parquet", header: bool = False, limit: int | None = None, order: str | None = None) -> DataFrame:
    """(source_matrix_row, node, context, path, url) from columns by their places.

    Rows of a table have no order of their own: it is that of a column (order), else
    that of all columns.  Rows start at 1, or 2 below a header; url may be missing.
    """
    raw = spark.read.parquet(path) if kind == "parquet" else spark.read.option("header", header).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    for name, place in columns.items():
        if name != "url" and not 1 <= place <= len(raw.columns):
            raise ValueError(f"column {place} for {name} is outside 1 .. {len(raw.columns)}")
    get = lambda name: F.col(f"`{raw.columns[columns[name] - 1]}`").cast("string") if 1 <= columns.get(name, 0) <= len(raw.columns) else F.lit("")
    picked = raw.select(*([F.col(order).alias("_order")] if order else []), *[get(c).alias(c) for c in ("node", "context", "path", "url")])
    rows = with_row_numbers(picked, ["_order"] if order else ["node", "context", "path", "url"], 2 if header else 1)
    out = rows.select("source_matrix_row", "node", "context", "path", "url")
    return out if limit is None else out.where(F.col("source_matrix_row") < limit + (2 if header else 1))


def with_row_numbers(df: DataFrame, order: list[str], first: int = 1) -> DataFrame:
    """df with source_matrix_row, counted in an order without gaps; parts are counted side by side."""
    out = numbered(df.withColumn("_key", F.struct(*order)), "_key", "source_matrix_row").drop("_key")
    return out if first == 1 else out.withColumn("source_matrix_row", F.col("source_matrix_row") + (first - 1))


def file_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, share): the share of values of each column that look like file names, in one pass."""
    shares = df.agg(*[F.avg(T.looks_like_file(F.col(c).cast("string")).cast("double")).alias(c) for c in columns])
    return shares.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.round(F.col(c), 6).alias("share")) for c in columns])).alias("s")).select("s.*")


def choose_source_column(df: DataFrame, wanted: str) -> str:
    """The wanted column if a fifth of it are files, else the one with most files; an error if none has enough."""
    shares = {r.col: r.share or 0.0 for r in file_shares(df, df.columns).collect()}  # one row a column
    if shares.get(wanted, 0.0) >= KEEP:
        return wanted
    best = max(shares, key=lambda c: (shares[c], -df.columns.index(c)))
    if shares[best] < ACCEPT:
        raise ValueError(f"no column holds file names; {wanted} looks like a directory")
    return best


def read_concordance(spark: SparkSession, path: str, mark: str = "contexto", sep: str = "\t") -> DataFrame:
    """A reviewed table in a text file whose header is its first line or stands below a banner of up to three."""
    lines = spark.read.text(path).limit(4).collect()  # the head of one file
    at = next((i for i, r in enumerate(lines) if mark in r.value.split(sep)), None)
    if at is None:
        raise ValueError(f"no header with {mark} in the first lines")
    names = lines[at].value.split(sep)
    rows = spark.read.option("sep", sep).schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    head = [lines[i].value for i in range(at + 1)]
    return rows.where(~F.concat_ws(sep, *[F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names]).isin(head) & ~F.col(f"`{names[0]}`").isin([h.split(sep)[0] for h in head]))


def file_key(path):
    """The lower-cased file name without its extension."""
    return F.regexp_replace(T.basename(F.lower(path)), r"\.[^.]*$", "")


def read_catalogue(spark: SparkSession, path: str, keys: list[str], reference: str, sep: str | None = None) -> DataFrame:
    """(key, reference): a work's reference by each of its key columns; of rows of one key the last one counts.

    The separator is the one that the header has most of.
    """
    if sep is None:
        head = spark.read.text(path).first()
        sep = max("\t;,", key=lambda s: head.value.count(s) if head else 0)
    rows = spark.read.option("header", True).option("sep", sep).csv(path).withColumn("_at", F.struct(F.input_file_name(), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    pairs = rows.select("_at", F.col(f"`{reference}`").alias("reference"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), file_key(F.col(f"`{k}`")).alias("key")) for i, k in enumerate(keys) if k in rows.columns])).alias("k"))
    pairs = pairs.where(F.coalesce(F.trim("reference"), F.lit("")) != "").where("k.key != ''")
    return pairs.groupBy("k.key").agg(F.max_by("reference", F.struct("_at", "k.i")).alias("reference"))


#: Names that columns of a manifest go by.
MANIFEST_NAMES = {
    "key": ["ficheiro", "file", "filename", "caminho_ficheiro", "caminho", "path"],
    "autores": ["autores", "autor", "author", "authors"],
    "ano": ["ano", "year", "date"],
    "titulo": ["titulo", "title"],
    "tipo": ["tipo", "type"],
    "contentor": ["contentor", "journal", "revista", "container"],
    "volume": ["volume", "vol"],
    "numero": ["numero", "issue", "number"],
    "paginas": ["paginas", "pages"],
    "editora": ["editora", "publisher"],
    "doi_ou_url": ["doi_ou_url", "doi", "url"],
    "edicao": ["edicao", "edition"],
}


def manifest(df: DataFrame) -> DataFrame:
    """(key, fields): what a manifest says of each file, whatever names its columns have."""
    lower = {c.lower(): c for c in df.columns}
    found = lambda names: [F.when(F.trim(F.col(f"`{lower[n]}`").cast("string")) != "", F.trim(F.col(f"`{lower[n]}`").cast("string"))) for n in names if n in lower]
    pick = lambda names: F.coalesce(*found(names)) if found(names) else F.lit(None).cast("string")
    out = df.select(file_key(pick(MANIFEST_NAMES["key"])).alias("key"), *[pick(v).alias(k) for k, v in MANIFEST_NAMES.items() if k != "key"])
    fields = [k for k in MANIFEST_NAMES if k != "key"]
    return out.where("key is not null and key != ''").groupBy("key").agg(F.max_by(F.struct(*fields), F.struct(*[F.coalesce(F.col(f), F.lit("")) for f in fields])).alias("m")).select("key", "m.*")
