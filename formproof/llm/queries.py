"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formproof.functions.text import let
from formproof.llm import bpe, editprint, html, lines, mix, phrases, pii, quality, runs, setjoin, shards, toxic, vectors
from formproof.llm.common import table, text_of

LLM_QUERIES, LLM_ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        LLM_QUERIES[f.__name__] = f
        if sql:
            LLM_ORACLES[f.__name__] = sql
        return f
    return register


@query(r"""
with line as (
    select doc_id, unnest(l) as line, generate_subscripts(l, 1) as pos
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
keyed as (
    select doc_id, pos, line,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from line),
repeated as (
    select key, max(doc_id) as keeper from keyed where length(key) >= 20
    group by key having count(distinct doc_id) >= 3),
marked as (
    select k.*, r.key is not null and k.doc_id <> r.keeper as gone from keyed k left join repeated r on k.key = r.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.number_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.BASE]
    return found.select(
        "doc_id", *counts, F.sha2(pii.written_out(F.col("base")), 256).alias("base_sha256"),
        pii.written_out(F.col("spans")).alias("spans"))


@query()
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shuffled_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(text_of()).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, table(spark, sf_dir, "labels")).select("doc_id", "n_grams", "log_ratio", "gumbel_key", "kept")


@query()
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.edited_prints(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


@query()
def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.similar_sets(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)


@query()
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@query()
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxic.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxic.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; in the tenth of the documents that their ids' CRC picks, words from a place on repeat a stretch."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    n = F.size("_w").cast("long")

    def repeated(ws):
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return let(F.struct(ws.alias("w"), a.alias("a"), p.alias("p")), lambda x: F.array_join(
            F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(
                x["w"], F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))), " "))

    cut = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all(text_of(), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("_w"))
    return cut.select("doc_id", F.when(n > 0, repeated(F.col("_w"))).otherwise(F.col("text")).alias("text"))


@query(r"""
with hashed as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
        xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint),
            lambda c, b: list_reduce(range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(c, b)),
            4294967295::bigint), 4294967295::bigint) as h
    from documents),
placed as (
    select *, len(ws) as n, h // 10 as g, (h // 10) % greatest(len(ws), 1) as a from hashed),
sized as (select *, 1 + (n - a) // (3 + g % 8) as p from placed),
edited as (
    select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: ws[1 + case when i < a then i else a + (i - a) % p end])
        else ws end as ws
    from sized),
position as (select doc_id, n, unnest(range(n)) as i, ws from edited),
-- a run of 24 words and three periods repeats at least nine stretches of eight words, a period apart
eight as (select doc_id, n, i, array_to_string(ws[i + 1:i + 8], ' ') as w from position where i + 8 <= n),
pair as (select l.doc_id, l.i, r.i - l.i as d from eight l join eight r on l.doc_id = r.doc_id and l.w = r.w and r.i > l.i and 3 * (r.i - l.i) <= l.n),
island as (select *, i - row_number() over (partition by doc_id, d order by i) as part from pair),
stretch as (select doc_id, d, min(i) as s, count(*) + 7 + d as length from island group by doc_id, d, part),
run as (select doc_id, s, length, min(d) as q from stretch where length >= greatest(24, 3 * d) group by doc_id, s, length),
best as (
    select doc_id, s, length, q from run
    qualify row_number() over (partition by doc_id order by (length::hugeint * 1000000000000) // q desc, s, q) = 1),
listed as (
    select doc_id, count(*) as n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' order by s, q) as all_runs from run group by doc_id),
gone as (select distinct doc_id, unnest(range(s + q, s + length)) as i from run),
kept as (
    select p.doc_id, string_agg(p.ws[p.i + 1], ' ' order by p.i) as collapsed
    from position p left join gone g on p.doc_id = g.doc_id and p.i = g.i where g.i is null group by p.doc_id)
select d.doc_id, coalesce(l.n_runs, 0) as n_runs, b.s as start, b.length, b.q as period, 1000 * b.length // b.q as exponent_milli,
    sha256(coalesce(l.all_runs, '')) as runs_sha256, sha256(coalesce(k.collapsed, '')) as collapsed_sha256
from documents d left join listed l on l.doc_id = d.doc_id left join best b on b.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id
""")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    best = runs.strongest(F.col("runs"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.sha2(runs.written_out(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
        best.alias("_best"),
    ).select(
        "doc_id", "n_runs", "_best.start", "_best.length", "_best.period",
        F.expr("(_best.length * 1000) div _best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query(r"""
with piece as (
    select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as ws
    from documents),
place as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from piece),
total as (select lang, count(*) as n from place group by lang),
gram as (
    select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase, count(*) as f
    from place cross join (values (1), (2), (3), (4)) as size(k) where i + k - 1 <= len(ws) group by all having count(*) >= 30),
candidate as (select *, string_split(phrase, ' ') as w from gram where k >= 2),
cut as (select c.*, unnest(range(1, k)) as m from candidate c),
scored as (
    select c.lang, c.phrase, c.k, c.f as a, l.f as l, r.f as r, c.m, (2000000 * c.f::hugeint) // (l.f::hugeint + r.f) as score
    from cut c join gram l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:c.m], ' ')
        join gram r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.m + 1:], ' ')),
least as (select * from scored qualify row_number() over (partition by lang, phrase order by score, m) = 1),
inside as (
    select lang, array_to_string(w[b:b + m - 1], ' ') as phrase, max(f) as longer
    from (select lang, w, f, m, unnest(range(1, k - m + 2)) as b from (select *, unnest(range(2, k)) as m from candidate where k >= 3))
    group by all),
own as (
    select s.* from least s left join inside i on i.lang = s.lang and i.phrase = s.phrase
    where i.phrase is null or 100 * i.longer::hugeint < 80 * s.a::hugeint),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from own)
select r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score::bigint as score from ranked r join total t on t.lang = r.lang where r.rank <= 2000
""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


LLM_QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    LLM_ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
