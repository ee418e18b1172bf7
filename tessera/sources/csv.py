"""CSV scan / sink and header standardisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical retail column names with the words that a header must
# and must not hold; the first row that fits wins.
RETAIL_HEADERS = [
    ("InvoiceNo", ["invoice"], ["date", "no"]),
    ("InvoiceDate", ["invoice", "date"], []),
    ("StockCode", ["stock"], []),
    ("Description", ["description"], []),
    ("Quantity", ["quantity"], []),
    ("UnitPrice", ["price"], []),
    ("CustomerID", ["customer"], []),
    ("Country", ["country"], []),
]


def canonical_name(header: str, rules=RETAIL_HEADERS) -> str:
    """Canonical name of a header, or the header without outer blanks."""
    text = "".join(header.lower().split())
    fits = (name for name, need, bar in rules if all(w in text for w in need) and not any(w in text for w in bar))
    return next(fits, header.strip())


# Cells that stand for a missing value when a CSV file is read.
MISSING_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
                 "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns cast to what all their values are: whole numbers (bigint),
    numbers (double), True/False (boolean), else text.  A column without any
    value becomes double.  One aggregation over all columns; the result comes
    back as three flags per column."""
    checks = []
    for i, c in enumerate(df.columns):
        v = F.trim(F.col(f"`{c}`"))
        whole = v.rlike(r"^[+-]?[0-9]+$") & v.try_cast("bigint").isNotNull()
        number = v.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$") | F.lower(v).isin("inf", "-inf", "+inf", "infinity", "-infinity")
        logical = v.isin("True", "False", "TRUE", "FALSE", "true", "false")
        checks += [F.coalesce(F.bool_and(F.when(v.isNotNull(), x)), F.lit(True)).alias(f"{k}{i}") for k, x in [("w", whole), ("n", number), ("b", logical)]]
        checks.append(F.count(v).alias(f"c{i}"))
    got = df.agg(*checks).first()
    out = []
    for i, c in enumerate(df.columns):
        kind = "double" if not got[f"c{i}"] else "bigint" if got[f"w{i}"] else "double" if got[f"n{i}"] \
            else "boolean" if got[f"b{i}"] else None
        col = F.col(f"`{c}`")
        out.append((F.trim(col).try_cast(kind) if kind else col).alias(c))
    return df.select(*out)


def scan_csv(spark: SparkSession, path: str, encoding: str | None = None, infer_schema: bool = True, schema=None,
             missing: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with a header row.  ``encoding="latin-1"`` reads ISO-8859-1 files.

    Cells that hold one of ``missing`` (``MISSING_WORDS``) are null, so a
    column of numbers with "NA" among them stays numeric.  Quoted cells may
    hold line breaks and doubled quotes; such a file is read by one task, so
    pass ``multi_line=False`` for large files without breaks in cells, and an
    explicit ``schema``: inference costs an extra full pass.
    """
    r = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    if encoding:
        r = r.option("encoding", "ISO-8859-1" if encoding.lower() in ("latin-1", "latin1")
                     else encoding)
    if schema is not None:
        return r.schema(schema).csv(path)
    words = MISSING_WORDS if missing is None else missing
    raw = r.option("inferSchema", False).csv(path)
    raw = raw.select(*[F.when(~F.col(f"`{c}`").isin(words), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return infer_types(raw) if infer_schema else raw


def standardise_columns(df: DataFrame, rules=RETAIL_HEADERS, map_invoice_no: bool = True) -> DataFrame:
    """Strip header blanks, then rename to canonical retail names.

    Metadata only: one projection, no job.  A header like "Invoice No" is
    mapped to InvoiceNo (``map_invoice_no``); two headers mapping to the same
    target raise ``ValueError`` instead of producing duplicate columns.
    """
    names = [canonical_name(c, rules) for c in df.columns]
    if map_invoice_no:
        plain = ["".join(c.lower().split()) for c in df.columns]
        names = ["InvoiceNo" if p in ("invoiceno", "invoicenumber") else n for p, n in zip(plain, names)]
    dups = sorted({n for n in names if names.count(n) > 1})
    if dups:
        raise ValueError(f"several columns map to {dups}")
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header row, no index; one file per partition (distributed write).
    Quotes in cells are doubled."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
