"""Fill-in-the-middle forms of documents, made by DuckDB SQL over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import table

#: Texts are handed to DuckDB together until they hold this many bytes; a longer text is handed over alone, and whole.
CHUNK = 1 << 20
#: A text is cut into runs of so many code points; only the runs that hold a cut are cut into single ones.
BLOCK = 64


@dataclass(frozen=True)
class Form:
    """Marks of the three parts, and how documents are dealt to forms: per cent that are cut, per cent of those in the
    order suffix, prefix, middle, and the seed of the hash that decides."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    cut: int = 90
    spm: int = 20
    seed: int = 1

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        # no mark may begin where another one ends, or the parts could not be told apart again
        overlap = any(a.endswith(b[:k]) for a, b in product(marks, marks) for k in range(1, min(len(a), len(b)) + (a != b)))
        if not all(marks) or len(set(marks)) < 3 or overlap:
            raise ValueError("marks must be three texts, none beginning with an end of another")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


#: Code points a to b (from 0, end exclusive) of a text in blocks: whole blocks, and single code points of the outer two.
_PIECE = f"""create or replace temp macro piece(blocks, a, b) as case
  when a >= b then ''
  when a // {BLOCK} = b // {BLOCK} then array_to_string(list_slice(regexp_extract_all(blocks[a // {BLOCK} + 1], '(?s).'), a % {BLOCK} + 1, b % {BLOCK}), '')
  else array_to_string(list_slice(regexp_extract_all(blocks[a // {BLOCK} + 1], '(?s).'), a % {BLOCK} + 1, {BLOCK}), '')
    || array_to_string(list_slice(blocks, a // {BLOCK} + 2, b // {BLOCK}), '')
    || array_to_string(list_slice(regexp_extract_all(coalesce(blocks[b // {BLOCK} + 1], ''), '(?s).'), 1, b % {BLOCK}), '') end"""


def _infill_sql(form: Form) -> str:
    p, s, m = map(_text, (form.prefix, form.suffix, form.middle))
    part = lambda k: f"('0x' || substr(sha, {8 * k - 7}, 8))::ubigint"
    return f"""
with blocks as (select doc_id, text, regexp_extract_all(text, '(?s).{{1,{BLOCK}}}') as blocks, sha256('{form.seed}:' || coalesce(doc_id::varchar, '')) as sha from batch),
sized as (select *, case when len(blocks) = 0 then 0 else {BLOCK} * (len(blocks) - 1) + length(blocks[len(blocks)]) end as n from blocks),
drawn as (select *, {part(1)} % (n + 1)::ubigint as x, {part(2)} % (n + 1)::ubigint as y,
  case when n = 0 or contains(text, {p}) or contains(text, {s}) or contains(text, {m}) or {part(3)} % 100 >= {form.cut} then 'plain' when {part(4)} % 100 < {form.spm} then 'spm' else 'psm' end as form from sized),
placed as (select *, least(x, y)::bigint as a, greatest(x, y)::bigint as b from drawn),
parts as (select *, case when form <> 'plain' then piece(blocks, 0::bigint, a) end as prefix, case when form <> 'plain' then piece(blocks, a, b) end as middle, case when form <> 'plain' then piece(blocks, b, n::bigint) end as suffix from placed)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  case form when 'plain' then text when 'psm' then {p} || prefix || {s} || suffix || {m} || middle else {s} || suffix || {p} || prefix || {m} || middle end as output from parts"""


def _restore_sql(form: Form) -> str:
    p, s, m = map(_text, (form.prefix, form.suffix, form.middle))
    np_, ns, nm = map(len, (form.prefix, form.suffix, form.middle))
    return f"""
with found as (select *, case form when 'psm' then strpos(output, {s}) when 'spm' then strpos(output, {p}) end as i, strpos(output, {m}) as j from batch)
select * exclude (i, j), case form when 'plain' then output
  when 'psm' then substr(output, {np_ + 1}, i - {np_ + 1}) || substr(output, j + {nm}) || substr(output, i + {ns}, j - i - {ns})
  else substr(output, i + {np_}, j - i - {np_}) || substr(output, j + {nm}) || substr(output, {ns + 1}, i - {ns + 1}) end as restored from found"""


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about CHUNK bytes, one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(batch):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right"))
        to = max(at + 1, to)
        yield batch.slice(at, to - at)
        at = to


def _by_sql(sql: str, column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: every batch is registered as ``batch`` and the SQL's result returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(config={"threads": 1})
        db.execute(_PIECE)
        for whole in batches:
            for batch in _pieces(whole, column):
                db.register("batch", pa.Table.from_batches([batch]))
                yield from db.sql(sql).to_arrow_table().to_batches()
                db.unregister("batch")

    return run


def infill(docs: DataFrame, form: Form = Form()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs(doc_id, text)``, without a shuffle.

    A text of n code points is cut at two places that a hash of its doc_id draws, both from 0 to n, and its parts are put
    in the order prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each behind its mark. Some documents, empty
    ones and those that hold a mark stay as they are (plain). Null texts count as empty, a null doc_id hashes as an empty
    one; invalid UTF-8 is mended first. Repeated rows give equal rows, an empty table none; further columns are left out.
    Memory is bounded by CHUNK or the longest text.
    """
    texts = docs.select("doc_id", F.make_valid_utf8(F.coalesce("text", F.lit(""))).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_by_sql(_infill_sql(form), "text"), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(examples: DataFrame, form: Form = Form()) -> DataFrame:
    """Adds restored to what ``infill`` returns: the text that it was given, read off form and output alone. As no text in
    parts holds a mark, the first mark of each kind is the one that was put there."""
    schema = StructType([*examples.schema.fields, StructField("restored", StringType())])
    return examples.mapInArrow(_by_sql(_restore_sql(form), "output"), schema)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill(table(spark, sf_dir, "documents"))
    hashed = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed("output"), hashed("restored"))


OP13_SQL = """
with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as sha from documents),
h as (select *, ('0x' || substr(sha, 1, 8))::bigint % (n + 1) as x, ('0x' || substr(sha, 9, 8))::bigint % (n + 1) as y, ('0x' || substr(sha, 17, 8))::bigint % 100 as r, ('0x' || substr(sha, 25, 8))::bigint % 100 as o from d),
c as (select *, least(x, y) as a, greatest(x, y) as b, case when n = 0 or regexp_matches(text, '<[PSM]>') or r >= 90 then 'plain' when o < 20 then 'spm' else 'psm' end as form from h),
p as (select *, text[1:a] as pre, text[a + 1:b] as mid, text[b + 1:n] as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(text) as restored_sha256 from p
"""
