"""Registered queries of the training-data operators, and their DuckDB answers where SQL can give them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybrook.llm import backoff, exact, html_text, packing, prefix_trie, puquality, superminhash, tiling, token_counts, token_files, toxicity, unigram, variants
from daybrook.session import prepare, work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Queries beside the one of each number, offered before it, and their answers.
MORE: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
MORE_SQL: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at 85 of 100."""
    return superminhash.near_groups(_table(spark, sf_dir, "documents"), 85)


def op1_backoff_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram scores of all documents against all others, with two steps back."""
    scores = backoff.backoff_scores(_table(spark, sf_dir, "documents"), 3)
    return scores.withColumn("log10_score", F.round("log10_score", 4))


MORE["op1_backoff_trigrams"] = op1_backoff_trigrams
MORE_SQL["op1_backoff_trigrams"] = r"""
with lists as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
words as (select doc_id, unnest(w) as w1, generate_subscripts(w, 1) as i, len(w) as n from lists),
grams as (select *, lag(w1) over p as w0, lag(w1, 2) over p as w00 from words window p as (partition by doc_id order by i)),
counted as (
  select doc_id, n, i, sum(1) over () as corpus,
         count(*) over (partition by w1) - count(*) over (partition by doc_id, w1) as c1,
         count(*) over (partition by w0, w1) - count(*) over (partition by doc_id, w0, w1) as c2,
         count(*) over (partition by w00, w0, w1) - count(*) over (partition by doc_id, w00, w0, w1) as c3 from grams),
placed as (select *, lag(c1) over p as b1, lag(c2) over p as b2 from counted window p as (partition by doc_id order by i)),
steps as (
  select *, case when i > 2 and c3 > 0 then 3 when i > 1 and c2 > 0 then 2 when c1 > 0 then 1 else 0 end as found, least(i, 3) as longest from placed),
scored as (
  select doc_id, (found < longest)::int as backed, (longest - found) * log10(0.4::double)
         + case found when 3 then log10(c3::double) - log10(b2::double) when 2 then log10(c2::double) - log10(b1::double)
                when 1 then log10(c1::double) - log10(greatest(corpus - n, 1)::double) else -log10(greatest(corpus - n, 1)::double) end as s from steps)
select d.doc_id, count(s) as n_words, cast(coalesce(sum(backed), 0) as bigint) as n_backed_off, round(coalesce(sum(s), 0), 4) as log10_score
from documents d left join scored using (doc_id) group by d.doc_id
"""


@_query
def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram scores of all documents against all others."""
    scores = backoff.backoff_scores(_table(spark, sf_dir, "documents"), 2)
    return scores.withColumn("log10_score", F.round("log10_score", 4))


SQL["op1_stupid_backoff"] = r"""
with lists as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
words as (select doc_id, unnest(w) as w1, generate_subscripts(w, 1) as i, len(w) as n from lists),
pairs as (select *, case when i > 1 then lag(w1) over (partition by doc_id order by i) end as w0 from words),
counted as (
  select doc_id, n, i, w0, w1, sum(1) over () as corpus,
         count(*) over (partition by w1) - count(*) over (partition by doc_id, w1) as c1,
         count(*) over (partition by w0, w1) - count(*) over (partition by doc_id, w0, w1) as c2 from pairs),
placed as (select *, lag(c1) over (partition by doc_id order by i) as c0 from counted),
scored as (
  select doc_id, case when i > 1 and c2 > 0 then 0 when c1 > 0 and i = 1 then 0 else 1 end as backed,
         case when i > 1 and c2 > 0 then log10(c2::double) - log10(c0::double)
              when c1 > 0 then (i > 1)::int * log10(0.4) + log10(c1::double) - log10(greatest(corpus - n, 1)::double)
              else ((i > 1)::int + 1) * log10(0.4) - log10(greatest(corpus - n, 1)::double) end as s from placed)
select d.doc_id, count(s) as n_words, cast(coalesce(sum(backed), 0) as bigint) as n_backed_off, round(coalesce(sum(s), 0), 4) as log10_score
from documents d left join scored using (doc_id) group by d.doc_id
"""


@_query
def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return puquality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of every document; the largest id stays."""
    return exact.copies(_table(spark, sf_dir, "documents"))


SQL["op4_exact_dedup"] = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""


@_query
def op5_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or in rearranged parts."""
    return tiling.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back from the files."""
    folder = work_dir(spark, "token-files")
    manifest = token_files.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_files.read_tokens(spark, manifest, folder)


@_query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


@_query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents through a digest cache that starts empty."""
    counts = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), work_dir(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@_query
def op9_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents, and a digest of the texts that they decode to."""
    coded = unigram.code(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))


SQL["op10_superminhash"] = r"""
with recursive lists as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (select doc_id, unnest(case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
         when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from lists),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as i from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id as v, doc_id as o from documents union select r.v, e.b from reach r join edges e on e.a = r.o)
select d.doc_id, coalesce(any_value(n), 0) as n_shingles, min(o) as component_id, d.doc_id = min(o) as kept
from documents d join reach on v = d.doc_id left join sizes using (doc_id) group by d.doc_id
"""


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations."""
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


#: CRC-32 of a list of byte values, as SQL.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, {bytes}), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
  lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint)"""

SQL["op13_prefix_trie"] = """
with lists as (
  select conv_id, list(one order by turn nulls first, one.k) as own from (
    select conv_id, turn, {'k': sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 'n': length(coalesce(text, ''))} as one
    from conversations where conv_id is not null) group by conv_id),
shares as (select *, """ + _CRC32.format(bytes="list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)") + """ % 6 as h from lists),
built as (select a.conv_id, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) as turns from shares a left join lists b on b.conv_id = a.conv_id - a.conv_id % 100),
steps as (select conv_id, len(turns) as n_turns, unnest(range(0, len(turns) + 1)) as d, turns from built),
members as (select conv_id, d, n_turns, list_transform(turns[1:d], lambda x: x.k) as node, turns[d].n as chars from steps),
nodes as (
  select node, d, min(conv_id) as conv_id, count(*) as n_convs, any_value(coalesce(chars, 0)) as chars,
         string_agg(conv_id::varchar, ',' order by conv_id) filter (n_turns = d) as ends from members group by node, d),
families as (select n.*, p.conv_id as parent_conv_id from nodes n left join nodes p on n.d > 0 and p.d = n.d - 1 and p.node = n.node[1:n.d - 1]),
sizes as (select node[1:d - 1] as node, count(*) as n_children from nodes where d > 0 group by all),
known as (select f.*, coalesce(s.n_children, 0) as n_children from families f left join sizes s on s.node = f.node),
above as (select node, d, chars, n_convs, n_children, unnest(range(0, d + 1)) as e from known),
sums as (select node[1:e] as node, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * chars)::bigint as saved_tokens from above group by all)
select conv_id, d as depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from known join sums using (node)
"""


@_query
def op11_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of four sizes."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), work_dir(spark, "packed"))


@_query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, and the more frequent words that they may stand for."""
    return variants.variants(_table(spark, sf_dir, "documents"))


SQL["op12_spelling_variants"] = """
with recursive runs as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents),
counted as (select doc_id, run, count(*) as k, hex(encode(doc_id || ':' || run)) as raw from runs where length(run) >= 6 group by all),
hashed as (select run, k, """ + _CRC32.format(bytes="list_transform(range(0, length(raw) // 2), lambda i: ('0x' || raw[2 * i + 1:2 * i + 2])::bigint)") + """ as h from counted),
slipped as (select k, case when h % 199 = 0 then run[1:h % length(run)] || run[h % length(run) + 2:] else run end as word from hashed),
words as (select word, sum(k)::bigint as n from slipped where length(word) >= 6 group by word having sum(k) >= 5),
cut as (select word, n, i, word[1:i - 1] || word[i + 1:] as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
shorter as (select distinct c.word as a, w.word as b from cut c join words w on w.word = c.rest),
pairs as (
  select x.word as a, y.word as b from cut x join cut y on x.i = y.i and x.rest = y.rest and x.word <> y.word
  union all select a, b from shorter union all select b, a from shorter),
near as (select a as word, count(*) as n_near, min({'n': -n, 'w': b}) as best from pairs join words on words.word = b group by a),
formed as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when -best.n >= 5 * w.n then best.w end as form, case when -best.n >= 5 * w.n then -best.n end as form_n
  from words w left join near using (word)),
chain as (select word, word as at, form as next from formed union all select c.word, f.word, f.form from chain c join formed f on f.word = c.next)
select f.word, f.form, c.at as root, f.n, f.n_near, f.form_n from formed f join chain c on c.word = f.word and c.next is null
"""
