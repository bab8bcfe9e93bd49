"""Registered queries of the training-data operators and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, embedding_dedup, language_id, minhash, mixing, pii, substring_dedup, token_files, toxicity
from .scratch import Scratch

#: Scripts without blanks, as in the operator.
UNSPACED = r"\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3005}-\x{3007}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5('0:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(source, '')) as key
  from documents),
totals as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighed as (
  select *, cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as double) as weight,
         cast(source_size * 3 as double) as cap, cast(sum(source_size) over () as double) as pool
  from totals),
dealt as (
  select *, (pool - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
            / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as r
  from weighed),
rated as (select *, max(case when r * weight <= cap then r end) over () as rate from dealt),
plan as (
  select source, source_size, least(cap, coalesce(rate * weight, cap)) as target from rated),
plans as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from plan),
placed as (
  select s.doc_id, s.size, p.source_size, p.target, p.epochs,
         cast(round(p.target - p.epochs * p.source_size) as bigint) as rest,
         cast(sum(s.size) over (partition by s.source order by s.key, s.doc_id rows between unbounded preceding and current row) as bigint) - s.size as start
  from sized s join plans p on s.source is not distinct from p.source)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, rest - start)) as bigint) as taken from placed
"""


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), toxicity.grades_from(table(spark, sf_dir, "labels")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of sentences and whole lines: shared passages stand inside lines, where hashes of lines alone find none of them."""
    return substring_dedup.dedup_units(table(spark, sf_dir, "documents"), kind="passage")


def op2_sql() -> str:
    """The same in windows: units are cut at their ends, numbered over the words before them, and runs are ranges of words."""
    stops, wide, close, lines, single = (re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", x) for x in (substring_dedup.STOPS, substring_dedup.WIDE, substring_dedup.CLOSE, substring_dedup.LINES, UNSPACED))
    blank = r"[ \t\x{3000}]"
    end = rf"([{stops}][{stops}{close}]*{blank}+|[{wide}][{stops}{wide}{close}]*{blank}*|\r\n|[{lines}])"
    close, end, single = (x.replace("'", "''") for x in (close, end, single))
    bare = rf"regexp_replace(piece, '({blank}+|\r\n|[{lines}])$', '')"
    return rf"""
with cut as (select doc_id, string_split(regexp_replace(text, '{end}', '\1' || chr(31), 'g'), chr(31)) as pieces from documents where text is not null),
units as (select doc_id, unnest(pieces) as piece, generate_subscripts(pieces, 1) as unit from cut),
placed as (
  select doc_id, unit, piece, case when regexp_matches(piece, '{end}$') then {bare} else piece end as raw, regexp_matches(piece, '[{lines}]$') as ends_line,
         cast(coalesce(sum(length(piece)) over (partition by doc_id order by unit rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from units),
normal as (select *, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'))) as norm, coalesce(sum(cast(ends_line as int)) over (partition by doc_id order by unit rows between unbounded preceding and 1 preceding), 0) as line from placed),
said as (
  select doc_id, unit, line, norm, len(regexp_extract_all(norm, '[{single}]|[^ {single}]+')) as size, row_number() over (partition by doc_id order by unit) as i,
         cast(sum(len(regexp_extract_all(norm, '[{single}]|[^ {single}]+'))) over w as bigint) as upto, cast(sum(length(norm) + 1) over w as bigint) as chars
  from normal where norm <> '' window w as (partition by doc_id order by unit rows between unbounded preceding and current row)),
texts as (select doc_id, string_agg(norm, ' ' order by unit) as whole from said group by 1),
onward as (select a.doc_id, a.i, a.chars - length(a.norm) - 1 as beg, b.chars - 1 as fin, b.i as j from said a asof join said b on a.doc_id = b.doc_id and a.upto - a.size + 5 <= b.upto),
backward as (select b.doc_id, a.i, a.chars - length(a.norm) - 1 as beg, b.chars - 1 as fin, b.i as j from said b asof join said a on a.doc_id = b.doc_id and b.upto - 5 >= a.upto - a.size),
short as (select doc_id, min(i) as i, min(chars - length(norm) - 1) as beg, max(chars) - 1 as fin, max(i) as j from said group by doc_id, line having sum(size) < 5),
runs as (select distinct doc_id, i, j, beg, fin from (select * from onward union all select * from backward union all select * from short) r),
spoken as (select doc_id, i, j, substr(whole, cast(beg + 1 as bigint), cast(fin - beg as bigint)) as digest from runs join texts using (doc_id)),
ranked as (select doc_id, i, j, row_number() over (partition by digest order by doc_id, i) as r from spoken),
gone as (select distinct s.doc_id, s.unit from ranked r join said s on s.doc_id = r.doc_id and s.i between r.i and r.j where r.r > 1),
told as (select n.*, g.unit is not null as out, n.norm = '' as blank from normal n left join gone g on g.doc_id = n.doc_id and g.unit = n.unit),
near as (
  select *, last_value(case when not blank then cast(out as int) end ignore nulls) over (partition by doc_id order by unit rows between unbounded preceding and current row) as before,
         first_value(case when not blank then cast(out as int) end ignore nulls) over (partition by doc_id order by unit rows between current row and unbounded following) as after
  from told),
dropped as (select *, coalesce(case when blank then before = 1 and after = 1 else out end, false) as drop_it from near),
ends as (select *, max(unit) filter (not drop_it) over (partition by doc_id) as last_kept, max(unit) over (partition by doc_id) as last_unit, max(case when drop_it then unit end) over (partition by doc_id) as last_drop from dropped),
done as (
  select doc_id, count(*) as n_units, count(*) filter (where drop_it) as n_removed,
         coalesce(string_agg(start || ':' || (start + length(raw)), ',' order by unit) filter (where drop_it), '') as removed_spans,
         coalesce(string_agg(case when unit = last_kept and last_drop = last_unit then raw else piece end, '' order by unit) filter (where not drop_it), '') as text
  from ends group by doc_id)
select d.doc_id, coalesce(n_units, 0) as n_units, coalesce(n_removed, 0) as n_removed, coalesce(removed_spans, '') as removed_spans, x.text
from documents d left join done x using (doc_id)
"""


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_digests(spark, manifest)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_events(chat.as_events(rows.unionByName(more)))
    return chat.digests(Scratch(spark, "chat").save(formatted, "formatted"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_embeddings(table(spark, sf_dir, "embeddings"), least=0.93)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_minhash": op6_minhash,
    "op7_token_files": op7_token_files,
    "op8_chat": op8_chat,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": op2_sql(), "op3_mixing": OP3_SQL}
