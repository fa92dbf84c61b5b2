"""The numbered queries: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, mixing, pages, quality, repeats, runs, secrets, simhash, spelling, tokenfile, toxicity, vectors

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", secrets.spans(F.col("text")).alias("found"))
    base = F.filter("found", lambda s: s["kind"] != "novel")

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.digest(base), 256).alias("base_sha256"),
        secrets.digest(F.col("found")).alias("spans"),
        count("novel"),
    )


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", licenses.notices(F.col("text")).alias("found"))
    return found.select("doc_id", F.inline("found"))


@query
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, scorer).select(
        F.col("row.doc_id").alias("doc_id"),
        (toxicity.remainder(F.col("row.doc_id")) == 2).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).drop("text_key")


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    return mixed.select(
        "_row_.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
        "_row_.source", "copies",
    )


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", "url", pages.extracted(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return tokenfile.token_file(table(spark, sf_dir, "documents"), vocabulary)


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", runs.with_planted_tail(F.col("doc_id"), F.col("text")).alias("text")
    )
    found = docs.select("doc_id", runs.runs(F.col("text")).alias("found"))
    listed, best = F.col("found.runs"), F.col("best")
    return found.withColumn("best", runs.strongest(listed)).select(
        "doc_id",
        F.size(listed).cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(runs.digest(listed), 256).alias("runs_sha256"),
        F.sha2("found.collapsed", 256).alias("collapsed_sha256"),
    )


#: The unsigned crc32 of a string's UTF-8 bytes, in DuckDB: ``{0}`` is the string, ``crc_table.crcs`` the table.
CRC_TABLE = """crc_table as (
  select list_transform(range(256), lambda b: list_reduce(list_prepend(b::ubigint, list_transform(range(8), lambda i: 0::ubigint)),
    lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)) crcs)"""
CRC = """xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(octet_length(encode({0}))),
    lambda i: ('0x' || substr(hex(encode({0})), (2 * i + 1)::int, 2))::ubigint)),
    lambda c, b: xor(c >> 8, crcs[((xor(c, b) & 255) + 1)::bigint])), 4294967295::ubigint)"""

# Pairs of equal words up to a third of the text apart, in stretches of one distance.
ORACLE["op11_periodic_runs"] = rf"""
with {CRC_TABLE},
texts as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) words,
    {CRC.format("doc_id::varchar")}::bigint h from documents, crc_table),
planned as (select *, len(words) n, h // 10 g from texts),
docs as (select doc_id, case when h % 10 = 0 and n > 0 then
    list_transform(range(n), lambda i: words[1 + case when i < g % n then i
      else g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) end]) else words end words from planned),
places as (select doc_id, unnest(words) w, unnest(range(len(words))) i, len(words) n from docs),
same as (select x.doc_id, y.i - x.i q, x.i from places x join places y
    on x.doc_id = y.doc_id and x.w = y.w and y.i > x.i and 3 * (y.i - x.i) <= x.n),
islands as (select doc_id, q, min(i) s, count(*) + q len from (
    select *, i - row_number() over (partition by doc_id, q order by i) island from same) group by doc_id, q, island),
runs as (select doc_id, s, len, min(q) q from islands where len >= 24 and len >= 3 * q group by doc_id, s, len),
best as (select * from runs qualify row_number() over (partition by doc_id order by len / q desc, s, q) = 1),
listed as (select doc_id, count(*) n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) lines
    from runs group by doc_id),
dropped as (select distinct doc_id, unnest(range(s + q, s + len)) i from runs),
kept as (select p.doc_id, string_agg(w, ' ' order by p.i) body from places p left join dropped d
    on d.doc_id = p.doc_id and d.i = p.i where d.i is null group by p.doc_id)
select docs.doc_id, coalesce(n_runs, 0) n_runs, best.s as start, best.len as length, best.q as period,
    1000 * best.len // best.q as exponent_milli, sha256(coalesce(lines, '')) runs_sha256,
    sha256(coalesce(body, '')) collapsed_sha256
from docs left join listed using (doc_id) left join best using (doc_id) left join kept using (doc_id)
"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), spoiled=spelling.SPOILED)


# Words one edit apart share the rest of the word without the letter at one place.
ORACLE["op13_spelling_variants"] = rf"""
with recursive {CRC_TABLE},
texts as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) w from documents),
lowered as (select doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w, count(*) n
    from texts group by 1, 2),
hashed as (select w, n, length(w) l, {CRC.format("(doc_id || ':' || w)")}::bigint h from lowered, crc_table),
counted as (select case when h % 97 = 0 then left(w, (h % l)::int) || substr(w, (h % l)::int + 2) else w end w, n from hashed),
words as (select w, sum(n)::bigint n from counted where length(w) >= 5 group by w having sum(n) >= 3),
rests as (select w, n, p, left(w, p - 1) || substr(w, p + 1) rest from (select w, n, unnest(range(1, length(w) + 1))::int p from words)),
pairs as (
  select distinct a.w, b.w near, b.n from rests a join rests b on a.p = b.p and a.rest = b.rest and a.w <> b.w
  union select a.w, b.w, b.n from rests a join words b on a.rest = b.w
  union select b.w, a.w, a.n from rests a join words b on a.rest = b.w),
best as (select w, count(*) n_near, first(near order by n desc, near) near, max(n) near_n from pairs group by w),
forms as (select words.w, words.n, coalesce(n_near, 0) n_near,
    case when near_n >= 2 * words.n then near end form, case when near_n >= 2 * words.n then near_n end form_n
    from words left join best using (w)),
walk as (select w, w as at_word from forms
    union all select walk.w, forms.form from walk join forms on forms.w = walk.at_word where forms.form is not null),
ends as (select walk.w, at_word from walk join forms on forms.w = walk.at_word where forms.form is null)
select forms.w word, form, at_word root, n, n_near, form_n from forms join ends using (w)
"""


@query
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op12_substring_dedup"] = r"""
with docs as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) words from documents),
places as (select doc_id, words, unnest(range(1, len(words) - 11)) p from docs),
windows as (select doc_id, p, list_slice(words, p, p + 12) w from places),
firsts as (select w, min(doc_id) least from windows group by w),
covered as (select distinct doc_id, unnest(range(p, p + 13)) p from windows join firsts using (w) where doc_id > least),
every_word as (select doc_id, unnest(words) w, unnest(range(1, len(words) + 1)) p from docs),
kept as (select doc_id, string_agg(w, ' ' order by p) body, count(*) n from every_word anti join covered using (doc_id, p) group by doc_id)
select doc_id, len(words) n_words, len(words) - coalesce(n, 0) n_removed, sha256(coalesce(body, '')) kept_sha256
from docs left join kept using (doc_id)
"""
