"""Records that differ only in formatting, found by dictionary encoding.

1. Each distinct value of a batch is brought to a canonical form once, and the form to a 128-bit digest.
2. The dictionary of all forms is built by a shuffle of the digests: it gives every form that occurs more
   than once an integer identifier, common to all columns.
3. A record is rewritten as the tuple of its (field, identifier) pairs in order of the fields, and equal
   tuples are one record. A record with a form that occurs once has no copy and needs no identifiers.

The texts themselves are never shuffled. To bring equal values of different batches together before they
are brought to their forms would shuffle every text of the corpus.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.textbatch import LETTER, MARK, NUMBER, TextBatch, hash_spans, slices
from loomline.session import cut

_DECODER = json.JSONDecoder(object_pairs_hook=lambda pairs: {"\0": sorted(((k, json.dumps(v, ensure_ascii=False)) for k, v in pairs))}, parse_int=str, parse_float=str)


def sort_json_fields(text: str) -> str:
    """The text, composed (NFC), with the fields of every JSON object in it in order of their names."""
    text = unicodedata.normalize("NFC", text)
    out, at = [], 0
    while (brace := text.find("{", at)) >= 0:
        out.append(text[at:brace])
        head = text[brace + 1 : brace + 200].lstrip()
        at = brace
        if head[:1] in ('"', "}"):
            try:
                value, at = _DECODER.raw_decode(text, brace)
                out.append(" " + json.dumps(value, ensure_ascii=False).replace("\\", "") + " ")
            except (ValueError, RecursionError):
                at = brace
        if at == brace:
            out.append("{")
            at += 1
    return "".join(out) + text[at:]


@functools.lru_cache(1)
def _lower() -> np.ndarray:
    """Code point in lower case, for every code point; dotted and dotless i are one letter, and so are both small sigmas."""
    table = np.arange(0x110000, dtype=np.uint32)
    for x in range(0x20000):
        table[x] = ord(chr(x).lower()[0])
    table[[0x130, 0x131]] = ord("i")
    table[0x3C2] = 0x3C3
    return table


def form_digests(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digest of the canonical form of each text: its letters, digits and accents in lower case, all else
    dropped; ß is ss. Texts with JSON objects or combining marks are composed and have their fields sorted first."""
    special = pc.match_substring_regex(values, r'\{\s*["}]|\pM')
    if pc.any(special).as_py():
        values = pa.array([sort_json_fields(v) if hit else v for v, hit in zip(values.to_pylist(), special.to_pylist())], pa.large_string())
    values = pc.replace_substring_regex(values, "[ßẞ]", "ss")
    text = TextBatch(values)
    keep = (text.cls == LETTER) | (text.cls == NUMBER) | (text.cls == MARK)
    low = _lower()[text.cp]
    keep[1:] &= ~((text.cp[1:] == 0x307) & (low[:-1] == ord("i")))  # the dot that some lower case of a dotted capital i has
    start, end = text.starts[:-1], text.starts[1:]
    return tuple(hash_spans(low ^ np.uint32(salt), keep, start, end).view(np.int64) for salt in (0, 0x5BD1E995))


def formatting_records(df: DataFrame, name: str, id_column: str, fields: Sequence[str], required: str) -> DataFrame:
    """Records as ``tbl, id, a0, b0, a1, b1, ...``: the digest of each field's canonical form, in order of the fields' names.

    A null field counts as empty. Rows whose ``required`` field is null or blank (white space and invisible
    characters only) are no records. Other columns are ignored.
    """
    fields = sorted(fields)
    rows = df.where(F.col(required).rlike(r"[^\s\p{Z}\p{C}]")).select(F.col(id_column).alias("id"), *(F.col(f).alias(f"f{k}") for k, f in enumerate(fields)))
    names = [f"{side}{k}" for k in range(len(fields)) for side in "ab"]
    schema = pa.schema([("tbl", pa.string()), ("id", pa.int64()), *((n, pa.int64()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array([name] * batch.num_rows, pa.string()), batch.column("id").cast(pa.int64())]
            for k in range(len(fields)):
                values = batch.column(f"f{k}").cast(pa.large_string()).fill_null("").dictionary_encode()
                distinct = pa.RecordBatch.from_arrays([values.dictionary], ["v"])
                parts = [form_digests(part.column("v")) for part, _ in slices(iter([distinct]), "v")] or [(np.zeros(0, np.int64),) * 2]
                index = np.asarray(values.indices)
                columns += [pa.array(np.concatenate([p[side] for p in parts])[index]) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.mapInArrow(run, ", ".join(["tbl string", "id bigint", *(f"{n} bigint" for n in names)]))


def _split(counted: DataFrame, count: str, total: int) -> tuple[DataFrame, DataFrame]:
    """The entries that so many rows share that they are joined by broadcast, and the others: a large entry has at
    least one in 10 000 of all rows, so there are at most 10 000 of them. Both joins give the same."""
    large = max(100_000, total // 10_000)
    return counted.where(F.col(count) >= large).drop(count), counted.where(F.col(count) < large).drop(count)


def encoded(tables: Sequence[DataFrame]) -> DataFrame:
    """``tbl, id, record``: the records of all tables as tuples of ``(field, value)`` integers; null for a record with
    a form that no other place has.

    Digests are counted before the shuffle. Forms that many rows share are joined by broadcast, the others by shuffle.
    """
    tables = [cut(t) for t in tables]
    fields = [(len(t.columns) - 2) // 2 for t in tables]
    digests = [t.select(F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b")) for t, n in zip(tables, fields) for k in range(n)]
    every = reduce(DataFrame.unionByName, digests)
    counted = every.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dictionary = cut(counted.withColumn("value", F.monotonically_increasing_id()))
    few, rest = _split(dictionary, "n", sum(t.count() * n for t, n in zip(tables, fields)))
    out = []
    for rows, n in zip(tables, fields):
        for k in range(n):
            names = lambda d: d.select(F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}"), F.col("value").alias(f"v{k}"))  # noqa: B023, E731
            key = [f"a{k}", f"b{k}"]
            common, others = F.broadcast(names(few)), names(rest)
            rows = rows.join(common, key).unionByName(rows.join(common, key, "left_anti").join(others, key, "left")).drop(*key)
        whole = F.array(*(F.struct(F.lit(k).alias("field"), F.col(f"v{k}").alias("value")) for k in range(n)))
        known = reduce(lambda x, y: x & y, (F.col(f"v{k}").isNotNull() for k in range(n)))
        out.append(rows.select("tbl", "id", F.when(known, whole).alias("record")))
    return reduce(DataFrame.unionByName, out)


def formatting_classes(records: DataFrame) -> DataFrame:
    """``tbl, keep_id, copies``: one row per distinct record of ``encoded``, with its smallest id and its number of copies."""
    groups = records.where("record is not null").groupBy("tbl", "record").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    return groups.drop("record").unionByName(records.where("record is null").select("tbl", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("copies")))


def formatting_copies(records: DataFrame) -> DataFrame:
    """``tbl, keep_id, dup_id``: every record of ``encoded`` that is a formatting copy of another, with the one to keep.

    Groups are formed with sums before the shuffle, so a group that holds a third of all rows is one row
    per task there. Its members then find their group by broadcast if it is among the largest, else by
    shuffle. An id that occurs twice in a group is listed once. Empty tables give an empty result.
    """
    records = cut(records.where("record is not null"))
    groups = cut(records.groupBy("tbl", "record").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    few, rest = _split(groups, "copies", records.count())
    both = records.join(F.broadcast(few), ["tbl", "record"]).unionByName(records.join(rest, ["tbl", "record"]))
    return both.where("id > keep_id").select("tbl", "keep_id", F.col("id").alias("dup_id")).distinct()
