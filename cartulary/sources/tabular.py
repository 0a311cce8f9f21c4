"""Sheets and stored tables: headers, aliases, required columns, and file-name checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions.ids import is_sheet_id
from cartulary.functions.text import sheet_text

#: Headers that sheets use, and the columns they name.
ALIASES = {
    "identificacion": "id_number", "numero_identificacion": "id_number", "cedula": "id_number", "cc": "id_number", "documento": "id_number",
    "nombre": "given_names", "nombres": "given_names", "primer_nombre": "given_names",
    "apellido": "surnames", "apellidos": "surnames",
    "fecha_nacimiento": "birth_date", "nacimiento": "birth_date",
    "fecha_expedicion": "issue_date", "expedicion": "issue_date",
    "lugar_expedicion": "issue_place", "lugar": "issue_place", "ciudad": "issue_place",
    "sexo": "sex", "genero": "sex",
}


def canonical_header(name: str) -> str:
    """Lower case, trimmed, spaces as underscores, accents of Spanish folded."""
    return name.strip().lower().replace(" ", "_").translate(str.maketrans("éíóúáñ", "eiouan"))


def rename_headers(df: DataFrame, aliases: Mapping[str, str] = ALIASES, required: Sequence[str] = ("id_number",)) -> DataFrame:
    """df with canonical headers; two headers that name one column, or a missing required one, are an error."""
    names = [aliases.get(c, c) for c in map(canonical_header, df.columns)]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"several columns are called {', '.join(twice)}")
    absent = sorted(set(required) - set(names))
    if absent:
        raise ValueError(f"no column for {', '.join(absent)}")
    return df.toDF(*names)


def read_sheet(spark: SparkSession, path: str, aliases: Mapping[str, str] = ALIASES, **options) -> DataFrame:
    """A CSV sheet as strings, cleaned: canonical headers, valid ids only, four text columns in upper case."""
    return clean_sheet(rename_headers(spark.read.options(header=True, inferSchema=False, **options).csv(path), aliases))


def clean_sheet(sheet: DataFrame, key: str = "id_number", texts: Sequence[str] = ("given_names", "surnames", "issue_place", "sex")) -> DataFrame:
    rows = sheet.withColumn(key, F.trim(key)).where(is_sheet_id(F.col(key)))
    return rows.withColumns({c: sheet_text(F.col(c)) for c in texts if c in rows.columns})


def allowed_file(name: Column, extensions: Sequence[str]) -> Column:
    return name.rlike(rf"(?i)\.({'|'.join(extensions)})$")


def read_dictionary(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The words of a JSON file {field: [...]}; one column `word`, each once."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(field).alias("word")).distinct()
