"""The registered queries of the operators, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import (
    decontaminate,
    html_text,
    importance,
    infill,
    language,
    mixing,
    neighbours,
    ngram_join,
    passages,
    pii,
    suffixes,
    token_store,
    toxicity,
)
from tallyhouse.llm.common import held_out, table

TOKENIZER = "word_bpe_49k.json"
#: Queries of the neighbour search are the vectors whose id this divides: fixed by the contract.
ASKED = 50


def op1_vantage_point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where(F.col("vec_id") % ASKED == 0)
    return neighbours.nearest_neighbours(vectors, queries)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.profiles_of(docs.where(~held_out(F.col("doc_id"))))
    return language.identify(docs, profiles).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op4_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_join(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "n_links"
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.without_repeated_passages(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return judged.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.tokenised(
        table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.reordered(table(spark, sf_dir, "documents"))
    back = infill.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


REGISTERED = (
    op1_vantage_point_neighbours,
    op2_main_text,
    op3_identify_language,
    op4_score_toxicity,
    op5_mix_sources,
    op6_ngram_jaccard_join,
    op7_personal_data,
    op8_line_dedup,
    op9_decontaminate,
    op10_token_store,
    op11_fill_in_middle,
    op12_suffix_array_dedup,
    op13_importance_resampling,
)

ORACLE_SQL: dict[str, str] = {
    "op5_mix_sources": r"""
with sized as (
    select doc_id, source,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
           ('0x' || substr(md5(coalesce(doc_id::varchar, text, '')), 1, 15))::bigint as ticket
    from documents
), sources as (
    select source, sum(size)::bigint as source_size, 3 * sum(size)::bigint as cap,
           [1, 2, 3][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
    from sized group by source
), levelled as (
    select *, (sum(source_size) over ()
               - coalesce(sum(cap) over (order by cap / weight, source
                   nulls last rows between unbounded preceding and 1 preceding), 0))
              / sum(weight) over (order by cap / weight, source nulls last
                   rows between current row and unbounded following) as level
    from sources
), targets as (
    select source, source_size,
           case when cap <= level * weight then cap::double
                else max(case when cap > level * weight then level end) over () * weight
           end as target
    from levelled
), budgets as (
    select *, case when source_size > 0 then floor(target / source_size) else 0 end as copies
    from targets
), grouped as (
    select s.*, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size as budget,
           sum(size) over (partition by s.source order by ticket) as upto,
           sum(size) over (partition by s.source, ticket) as words
    from sized s join budgets b on s.source is not distinct from b.source
), edges as (
    select source, min(ticket) as edge from grouped where upto > budget group by source
)
select doc_id, size, source_size::bigint as source_size, target,
       (size * (copies + case
           when edge is null then 0
           when ticket < edge then 1
           when ticket = edge and words < 2 * (budget - (upto - words)) then 1
           else 0 end))::bigint as taken
from grouped left join edges on grouped.source is not distinct from edges.source
""",
    "op6_ngram_jaccard_join": r"""
with recursive texts as (
    select row_number() over () as r, doc_id,
           coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as words
    from documents
), shingled as (
    select r, doc_id, list_sort(list_distinct(list_transform(
               range(1, greatest(len(words) - 3, 2)),
               lambda i: array_to_string(words[i : i + 4], ' ')))) as shingles
    from texts where len(words) > 0
), sets as (
    select shingles, row_number() over () as s, len(shingles) as n
    from (select distinct shingles from shingled)
), spread as (
    select s, n, unnest(shingles) as shingle from sets
), shared as (
    select a.s as a, b.s as b, count(*) as common, any_value(a.n) + any_value(b.n) as either
    from spread a join spread b on a.shingle = b.shingle and a.s <> b.s
                                and b.n >= 0.8 * a.n and a.n >= 0.8 * b.n
    group by a.s, b.s
), links as (
    select a, b from shared where common >= 0.8 * (either - common)
), reached as (
    select s as a, s as b from sets
    union
    select reached.a, links.b from reached join links on reached.b = links.a
), members as (
    select s, doc_id from shingled join sets using (shingles)
), classes as (
    select a as s, min(doc_id) as class_id from reached join members on members.s = reached.b
    group by a
), counts as (
    select a as s, count(*) as n_links from links group by a
)
select texts.doc_id, case when s is null then texts.doc_id else class_id end as class_id,
       coalesce(n_links, 0)::bigint as n_links
from texts left join shingled using (r) left join sets using (shingles)
     left join classes using (s) left join counts using (s)
""",
    "op8_line_dedup": r"""
with docs as materialized (
    select row_number() over () as r, doc_id, coalesce(text, '') as text,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'),
               '[\x00-\x2F\x3A-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as pieces
    from documents
), worded as (
    select r, unnest(words) as word, unnest(pieces) as piece,
           generate_subscripts(words, 1) as nth, len(words) as n
    from docs
), hashed as (
    select *, ('0x' || substr(md5(word), 1, 8))::bigint::hugeint * 4294967296 + n + 1 - nth as code,
           sum(length(piece)) over (partition by r order by nth) - length(word) as start
    from worded
), least_of as (
    select r, nth, n, min(code) over (
               partition by r order by nth rows between 11 preceding and current row) as code
    from hashed
), cuts as (
    select r, (n - code % 4294967296)::bigint as cut from least_of where nth >= least(12, n)
    union select r, 0 from worded union select r, n from worded
), units as (
    select r, cut, lead(cut, 2) over (partition by r order by cut) as stop from cuts
), ranked as (
    select r, cut, stop, rank() over (
               partition by words[cut + 1 : stop] order by doc_id nulls last, text, cut) as place
    from units join docs using (r) where stop is not null
), reached as (
    select r, cut, stop, max(stop) over (
               partition by r order by cut rows between unbounded preceding and 1 preceding) as upto
    from ranked where place > 1
), numbered as (
    select *, count(*) filter (upto is null or cut > upto) over (
               partition by r order by cut) as run
    from reached
), gone as (
    select r, run, min(cut) as first, max(stop) as stop from numbered
    group by r, run having max(stop) - min(cut) >= 28
), placed as (
    select gone.*, case when first = 0 then 0 else a.start end::bigint as from_char,
           coalesce(b.start, length(text))::bigint as to_char, text
    from gone join docs using (r)
    join hashed a on a.r = gone.r and a.nth = first + 1
    left join hashed b on b.r = gone.r and b.nth = gone.stop + 1
), pieces as (
    select r, from_char as a, to_char as b, true as removed, stop - first as n_gone from placed
    union all
    select r, to_char, coalesce(lead(from_char) over (partition by r order by run), length(text)),
           false, 0
    from placed
    union all
    select r, 0, coalesce(min(from_char), any_value(length(docs.text))), false, 0
    from docs left join placed using (r) group by r
)
select doc_id,
       coalesce(string_agg(text[a + 1 : b], '' order by a) filter (not removed), '') as text,
       count(*) filter (removed) as n_spans,
       coalesce(sum(n_gone), 0)::bigint as n_removed,
       coalesce(string_agg(a || ':' || b, ',' order by a) filter (not removed), '') as kept,
       coalesce(string_agg(a || ':' || b, ',' order by a) filter (removed), '') as removed
from docs left join (select * from pieces where a < b) using (r) group by r, doc_id
""",
    "op9_decontaminate": r"""
with docs as (
    select row_number() over () as r, doc_id,
           coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as words
    from documents
), items as (
    select item_id::varchar as item,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
    from benchmark
), windows as (
    select distinct item, least(13, len(words)) as n, words[i : i + least(13, len(words)) - 1] as w
    from (select *, unnest(range(1, len(words) - least(13, len(words)) + 2)) as i from items
          where len(words) > 0)
), lengths as (select distinct n from windows
), places as (
    select r, n, unnest(range(1, len(words) - n + 2)) as i from docs, lengths where len(words) >= n
), occurring as (
    select r, i, p.n, item
    from places p join docs using (r) join windows on windows.n = p.n
         and windows.w = words[i : i + p.n - 1]
), hit as (
    select r, count(distinct k) as n_hit
    from (select r, unnest(range(i, i + n)) as k from occurring) group by r
), found as (
    select r, count(distinct item) as n_items,
           string_agg(distinct item, ',' order by item) as ids
    from occurring group by r
)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from docs left join hit using (r) left join found using (r)
""",
    "op11_fill_in_middle": r"""
with cut as (
    select doc_id, coalesce(text, '') as text,
           regexp_extract_all(coalesce(text, ''),
               '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
           sha256('42:' || coalesce(doc_id::varchar, '')) as h
    from documents
), drawn as (
    select *, len(units) as n,
           list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::bigint) as d
    from cut
), placed as (
    select *, least(d[1] % (n + 1), d[2] % (n + 1)) as a,
           greatest(d[1] % (n + 1), d[2] % (n + 1)) as b,
           case when text = '' or contains(text, '<P>') or contains(text, '<S>')
                     or contains(text, '<M>') or d[3] % 100 >= 50 then 'plain'
                when d[4] % 100 < 80 then 'spm' else 'psm' end as form
    from drawn
), parts as (
    select *, array_to_string(units[1 : a], '') as prefix,
           array_to_string(units[a + 1 : b], '') as middle,
           array_to_string(units[b + 1 : n], '') as suffix
    from placed
)
select doc_id, n::bigint as n, form,
       case when form <> 'plain' then length(prefix)::bigint end as prefix_chars,
       case when form <> 'plain' then length(middle)::bigint end as middle_chars,
       sha256(case form when 'plain' then text
                        when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        else '<P>' || prefix || '<S>' || suffix || '<M>' || middle end
       ) as output_sha256,
       sha256(text) as restored_sha256
from parts
""",
}
