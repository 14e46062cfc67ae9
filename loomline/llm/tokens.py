"""Token counts, token totals and token ids of texts under a public byte-level vocabulary."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from loomline.llm.bpe import default_path, vocabulary
from loomline.llm.textbatch import slices


def _with(df: DataFrame, text: str, keep: Sequence[str], fields: list[StructField], make) -> DataFrame:
    """The kept columns and what ``make`` has of each slice of texts."""
    df = df.select(*keep, F.col(text).alias("__text"))
    schema = StructType([*df.drop("__text").schema.fields, *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "__text"):
            columns = [part.column(c) for c in keep] + make(texts)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str, keep: Sequence[str], path: str = default_path()) -> DataFrame:
    """The columns ``keep`` and ``n_tokens BIGINT``, the tokens of each row's text without special tokens.

    Distinct pieces are stored once as symbol arrays; adjacent pairs are joined with the merge ranks and the
    lowest-ranked merges applied until none is left. Null and empty texts have 0 tokens; blank texts have
    the tokens of their white space. Rows are independent: repeated rows, ties and clashing ids do not
    matter, and there is no shuffle. Texts of any length are counted whole.
    """
    return _with(df, text, keep, [StructField("n_tokens", LongType(), False)], lambda t: [pa.array(vocabulary(path).count(t), pa.int64())])


def encode(df: DataFrame, text: str, keep: Sequence[str], path: str = default_path(), offsets: bool = False) -> DataFrame:
    """The columns ``keep`` and ``ids ARRAY<INT>``, the token ids of each row's text without special tokens.

    Null and empty texts have the empty list. Strings of special tokens in a text are ordinary text. With
    ``offsets`` also ``piece_offsets ARRAY<BIGINT>``, the byte offsets in the text at which the pre-split
    pieces begin, so that a stretch of the text can be decoded on its own. Encoding is lossless:
    ``Vocabulary.decode`` gives back every text.
    """
    fields = [StructField("ids", ArrayType(IntegerType(), False), False)]
    if offsets:
        fields.append(StructField("piece_offsets", ArrayType(LongType(), False), False))

    def make(texts):
        vocab = vocabulary(path)
        out = [vocab.encode(texts)]
        if offsets:
            start, at = vocab.piece_offsets(texts)
            out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(start, pa.int64())))
        return out

    return _with(df, text, keep, fields, make)


#: Three-letter codes of the languages that the project's labels use.
LANGUAGE_CODES = {"tur": "tr", "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es"}
#: Labels that name no language.
NO_LANGUAGE = ("", "und", "unknown", "none", "null", "n/a", "xx", "zxx", "mis", "mul")


def language_label(label: Column) -> Column:
    """Two-letter code of a label in any code style (``tur_Latn``, ``TR``, ``tr-TR``); null if it names none."""
    code = F.regexp_extract(F.lower(label), r"^\s*([^-_\s]*)", 1)
    short = F.create_map(*(F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair), *(F.lit(x) for none in NO_LANGUAGE for x in (none, "")))
    return F.nullif(F.coalesce(F.try_element_at(short, code), code), F.lit(""))


def slice_name(value: Column) -> Column:
    """A source or domain without differences of case and outer blanks; null for blank."""
    return F.nullif(F.lower(F.trim(value)), F.lit(""))


def token_totals(counted: DataFrame) -> DataFrame:
    """Documents and tokens of each slice of ``source, lang, domain, n_tokens``.

    One row per value of each axis (``axis`` is source, lang or domain) and one per combination (``axis`` is
    slice). Null values form slices of their own. Sums are formed before the shuffle, so a hot source costs nothing more.
    """
    keys = ["source", "lang", "domain"]
    grouped = counted.groupingSets([(F.col("source"),), (F.col("lang"),), (F.col("domain"),), (F.col("source"), F.col("lang"), F.col("domain"))], *map(F.col, keys))
    out = grouped.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    axis = F.when(F.col("g") == 3, "source").when(F.col("g") == 5, "lang").when(F.col("g") == 6, "domain").otherwise("slice")
    return out.select(axis.alias("axis"), *keys, "n_docs", "n_tokens")
