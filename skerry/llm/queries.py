"""Queries of the training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.abuse import score_documents, source_rates
from skerry.llm.markup import clean_markup
from skerry.llm.near_copies import near_copies, near_copy_groups, row_pairs
from skerry.llm.pack import fill_containers, fill_report
from skerry.llm.ranking import ideal_point_ranking, majority_winners
from skerry.llm.site_lines import found_lines, without_repeated_lines
from skerry.llm.split import split_oversized
from skerry.llm.tokens import encode_texts
from skerry.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return clean_markup(table(spark, folder, "chunks", wide=True), with_text=False).filter("has_markup").select("chunk_ord")


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean_markup(table(spark, folder, "chunks", wide=True))


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "chunks", wide=True), ["chunk_ord", "doc_id", "chunk_id", "section"], whole=False)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = split_oversized(table(spark, folder, "chunks", wide=True), ["chunk_ord"], whole=False)
    return pieces.filter("piece_no = 0").select("chunk_ord", "boundary")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return row_pairs(*near_copies(table(spark, folder, "chunks", wide=True), by="overlap"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_copy_groups(table(spark, folder, "chunks", wide=True))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return majority_winners(table(spark, folder, "search_hits"))


def p4_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return ideal_point_ranking(table(spark, folder, "search_hits")).select("query_id", "chunk_id", F.round("closeness", 4).alias("closeness"), "rank")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return found_lines(table(spark, folder, "chunks", wide=True))


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeated_lines(table(spark, folder, "chunks", wide=True))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents", wide=True))


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    return fill_containers(table(spark, folder, "documents", wide=True))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return fill_report(p7_pack(spark, folder), 2048)


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents", wide=True))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_scores(spark, folder).filter("score >= 0.5").select("doc_id")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return source_rates(table(spark, folder, "documents"), p8_scores(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clean": p1_clean,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_ranking": p4_ranking,
    "p5_found": p5_found,
    "p5_clean": p5_clean,
    "p6_ids": p6_ids,
    "p7_pack": p7_pack,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
}

_NORM = r"""trim(regexp_replace(regexp_replace(lower({line}), '\p{{Nd}}+', '0', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"""

_LINES = rf"""
lines as (
  select chunk_ord, doc_id, split_part(doc_id, '__', 1) as wiki, unnest(string_split(text, chr(10))) as line,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no
  from chunks where text is not null and doc_id is not null),
normed as (select *, {_NORM.format(line="line")} as norm from lines),
repeated as (
  select n.wiki, n.norm from normed n
  join (select split_part(doc_id, '__', 1) as wiki, count(distinct doc_id) as total from chunks group by 1) t on t.wiki = n.wiki
  where n.norm <> ''
  group by n.wiki, n.norm having count(distinct n.doc_id) >= 5 and count(distinct n.doc_id) * 10 >= max(t.total)),
found as (select n.chunk_ord, n.line_no from normed n join repeated r on r.wiki = n.wiki and r.norm = n.norm)
"""

ORACLES: dict[str, str] = {
    "p2_found": r"""
with long as (select chunk_ord, text from chunks where length(text) > 1800),
parts as (
  select chunk_ord, 1 as level, unnest(regexp_split_to_array(text, '\n[ \t\r\n]*\n')) as part from long
  union all select chunk_ord, 2, unnest(string_split(text, chr(10))) from long
  union all select chunk_ord, 3, unnest(string_split(regexp_replace(text, '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10))) from long
  union all select chunk_ord, 4, unnest(regexp_split_to_array(text, '[ \t\r\n]+')) from long),
fits as (select chunk_ord, level from parts group by 1, 2 having max(length(trim(part, ' ' || chr(9) || chr(10) || chr(13)))) <= 1800)
select l.chunk_ord, coalesce(['paragraph', 'line', 'sentence', 'word'][min(f.level)], 'none') as boundary
from long l left join fits f on f.chunk_ord = l.chunk_ord group by l.chunk_ord""",
    "p3_found": r"""
with words as (
  select chunk_ord, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from chunks where text is not null),
sets as (
  select chunk_ord, list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as s
  from words where len(w) >= 3),
one as (select chunk_ord, len(s) as n, unnest(s) as x from sets),
met as (
  select a.chunk_ord as a, b.chunk_ord as b, count(*) as common, max(a.n + b.n) as total
  from one a join one b on a.x = b.x and a.chunk_ord < b.chunk_ord and a.n >= 0.7 * b.n and b.n >= 0.7 * a.n group by 1, 2)
select a as chunk_ord_a, b as chunk_ord_b from met where common >= 0.7 * (total - common)""",
    "p4_found": """
with s as (
  select query_id, chunk_id, scorer, max(case when isnan(score) then null else score end) as score
  from search_hits group by 1, 2, 3),
items as (select distinct query_id, chunk_id from s),
scorers_of as (select query_id, scorer from s where score is not null group by 1, 2),
grid as (
  select i.query_id, i.chunk_id, c.scorer, s.score from items i join scorers_of c on c.query_id = i.query_id
  left join s on s.query_id = i.query_id and s.chunk_id = i.chunk_id and s.scorer = c.scorer),
duels as (
  select a.query_id, a.chunk_id, b.chunk_id as other,
         count(*) filter (where a.score is not null and (b.score is null or a.score > b.score)) * 2 > count(*) as won
  from grid a join grid b on a.query_id = b.query_id and a.scorer = b.scorer and a.chunk_id <> b.chunk_id
  group by 1, 2, 3)
select i.query_id, i.chunk_id from items i
left join duels d on d.query_id = i.query_id and d.chunk_id = i.chunk_id
group by 1, 2 having bool_and(coalesce(d.won, true))""",
    "p4_ranking": """
with s as (
  select query_id, chunk_id, scorer, max(case when isnan(score) then null else score end) as score
  from search_hits where query_id is not null and chunk_id is not null group by 1, 2, 3),
r as (select * from s where score is not null and scorer is not null),
b as (select query_id, scorer, quantile_disc(score, 0.05) as low, quantile_disc(score, 0.95) as high from r group by 1, 2),
m as (
  select r.query_id, r.chunk_id, r.scorer, greatest(low, least(high, score)) - low + 0.1e0 * case when high > low then high - low else 1 end as x
  from r join b on b.query_id = r.query_id and b.scorer = r.scorer),
items as (select distinct query_id, chunk_id from s),
n as (select query_id, count(*) as n from items group by 1),
p as (
  select m.query_id, scorer, sqrt(sum(x * x)) as len, max(x) / sqrt(sum(x * x)) as ideal,
         case when count(*) < max(n.n) then 0 else min(x) / sqrt(sum(x * x)) end as floor_
  from m join n on n.query_id = m.query_id group by 1, 2),
d as (
  select i.query_id, i.chunk_id, sum((coalesce(x, 0) / len - floor_) ** 2) as near, sum((coalesce(x, 0) / len - ideal) ** 2) as far
  from items i left join p on p.query_id = i.query_id left join m on m.query_id = i.query_id and m.chunk_id = i.chunk_id and m.scorer = p.scorer group by 1, 2),
c as (
  select query_id, chunk_id, sqrt(round(coalesce(near, 0), 12)) as a, sqrt(round(coalesce(far, 0), 12)) as b from d),
k as (select query_id, chunk_id, case when a + b > 0 then round(a / (a + b), 9) else 0 end as c from c)
select query_id, chunk_id, round(c, 4) as closeness, row_number() over (partition by query_id order by c desc, chunk_id) as rank from k""",
    "p5_found": f"with {_LINES} select chunk_ord, cast(line_no as bigint) as line_no from found",
    "p5_clean": f"""
with {_LINES}
select c.chunk_ord,
  case when c.text is null then null else coalesce((select string_agg(n.line, chr(10) order by n.line_no) from lines n
    left join found f on f.chunk_ord = n.chunk_ord and f.line_no = n.line_no
    where n.chunk_ord = c.chunk_ord and f.line_no is null), '') end as clean_text,
  (select count(*) from found f where f.chunk_ord = c.chunk_ord) as n_removed
from chunks c""",
}
