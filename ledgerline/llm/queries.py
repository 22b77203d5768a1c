"""The registered queries of this package, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (
    bpe,
    collocations,
    decontamination,
    fingerprints,
    language,
    lexical,
    packing,
    simhash,
    substring,
    token_counts,
    toxicity,
    urls,
    wrappers,
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Where the vocabulary file lies; the file itself is not part of this package.
VOCABULARY = "byte_bpe_50k.json"


@functools.cache
def vocabulary(name: str = VOCABULARY) -> str:
    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that no model may learn from: a third, by the checksum of the id as text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    separator = next(t["id"] for t in json.loads(vocabulary())["added_tokens"] if t["content"] == "<|endoftext|>")
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), vocabulary(), separator)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op3_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary())


def op4_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs.filter(~held_out()), labels)
    return toxicity.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


#: Rules of the query: verdict, host, start of the path.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op5_association_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number ends its path; the labels of that document are the page's."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(urls.path_of(F.col("url")), r"/(\d{1,18})(?:[./][^/]*)?$", 1)
    shown = pages.withColumn("doc_id", number.try_cast("long"))
    labels = read(spark, sf_dir, "labels").select(
        "doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("unwanted")
    )
    mined = urls.mine(shown.join(labels, "doc_id"), "url", "unwanted")
    return urls.judge(pages, mined, URL_RULES)


def op6_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(read(spark, sf_dir, "documents"))


def op7_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~held_out()))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out().alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"),
    )


def op8_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return wrappers.extract(pages, wrappers.infer(pages)).withColumn("n_chars", F.length("text").cast("long"))


def op9_winnowed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontamination.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    return leaks.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(read(spark, sf_dir, "documents"))
    words = F.regexp_extract_all("kept_text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return kept.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.array_join(words, " "), 256).alias("kept_sha256")
    )


def op11_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), vocabulary()), vocabulary())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents"))


def op13_blocked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_separator_scan,
        op2_simhash_near_dedup,
        op3_cutting_stock_packing,
        op4_toxicity_grammar,
        op5_association_url_filter,
        op6_winnowing_fingerprints,
        op7_nearest_centroid_language,
        op8_wrapper_extraction,
        op9_winnowed_decontamination,
        op10_substring_dedup,
        op11_speculative_bpe,
        op12_phrase_collocations,
        op13_blocked_lexical_search,
    )
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {
    "op9_winnowed_decontamination": f"""
        with items as (
            select item_id, regexp_extract_all({_FOLD}, '{_ALNUM}') as w from benchmark
        ), short as (
            select item_id, w, least(len(w), 10) as size from items where len(w) > 0
        ), item_windows as (
            select distinct item_id, size, array_to_string(w[i : i + size - 1], ' ') as words
            from (select *, unnest(range(1, len(w) - size + 2)) as i from short)
        ), docs as (
            select doc_id, regexp_extract_all({_FOLD}, '{_ALNUM}') as w from documents
        ), starts as (
            select d.doc_id, s.size, d.w, unnest(range(1, len(d.w) - s.size + 2)) as i
            from docs d, (select distinct size from item_windows) s
        ), hits as (
            select s.doc_id, s.i, s.size, m.item_id
            from starts s join item_windows m
              on m.size = s.size and m.words = array_to_string(s.w[s.i : s.i + s.size - 1], ' ')
        ), covered as (
            select doc_id, count(distinct p) as n_hit
            from (select doc_id, unnest(range(i, i + size)) as p from hits) group by doc_id
        ), listed as (
            select doc_id, count(*) as n_items, sha256(string_agg(id, ',' order by id)) as items_sha256
            from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id
        )
        select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
               coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
               coalesce(n_hit, 0) > 0 as contaminated
        from docs d left join covered using (doc_id) left join listed using (doc_id)
    """,
    "op10_substring_dedup": f"""
        with docs as (
            select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') as w from documents
        ), windows as (
            select doc_id, i, array_to_string(w[i : i + 12], ' ') as words
            from (select *, unnest(range(1, len(w) - 11)) as i from docs)
        ), firsts as (
            select words, min(doc_id) as first_id from windows group by words having count(*) > 1
        ), gone as (
            select distinct doc_id, unnest(range(i, i + 13)) as p
            from windows join firsts using (words) where first_id < doc_id
        ), each as (
            select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from docs
        ), kept as (
            select e.doc_id, count(g.p) as n_removed,
                   string_agg(e.word, ' ' order by e.p) filter (where g.p is null) as words
            from each e left join gone g on g.doc_id = e.doc_id and g.p = e.p group by e.doc_id
        )
        select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed,
               sha256(coalesce(words, '')) as kept_sha256
        from docs d left join kept using (doc_id)
    """,
    "op12_phrase_collocations": r"""
        with pieces as (
            select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(FOLD, '[.,;:!?\x0A-\x0D]')) as piece
            from documents
        ), words as (
            select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
        ), one as (
            select lang, phrase, count(*) as f from (select lang, unnest(w) as phrase from words) group by lang, phrase
        ), two as (
            select lang, phrase, count(*) as f
            from (select lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as phrase from words)
            group by lang, phrase having count(*) >= 10
        ), three as (
            select lang, phrase, count(*) as f
            from (select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as phrase
                  from words)
            group by lang, phrase having count(*) >= 10
        ), f as (
            from one union all from two union all from three
        ), sizes as (
            select lang, cast(sum(f) as bigint) as n from one group by lang
        ), split as (
            select lang, phrase, f as a, string_split(phrase, ' ') as g from (from two union all from three)
        ), cuts as (
            select c.lang, c.phrase, a, len(g) as size, k, l.f as l, r.f as r,
                   (1000000::hugeint * a * a) // (l.f::hugeint * r.f) as score
            from (select *, unnest(range(1, len(g))) as k, array_to_string(g[1 : k], ' ') as head,
                         array_to_string(g[k + 1 :], ' ') as tail from split) c
            join f l on l.lang = c.lang and l.phrase = head
            join f r on r.lang = c.lang and r.phrase = tail
        ), lowest as (
            select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
        ), held as (
            select lang, part, max(a) as most
            from (select lang, a, unnest([g[1] || ' ' || g[2], g[2] || ' ' || g[3]]) as part from split where len(g) = 3)
            group by lang, part
        )
        select c.lang, row_number() over (partition by c.lang order by score desc, a desc, phrase) as rank,
               phrase, a, l, r, n, cast(score as bigint) as score
        from lowest c join sizes using (lang) left join held h on h.lang = c.lang and h.part = c.phrase
        where most is null or 100 * most < 50 * a
        qualify rank <= 2000
    """.replace("FOLD", _FOLD),
    "op13_blocked_lexical_search": f"""
        with terms as (
            select doc_id, unnest(regexp_extract_all({_FOLD}, '{_ALNUM}')) as term from documents
        ), tf as (
            select doc_id, term, count(*) as tf from terms group by doc_id, term
        ), sizes as (
            select doc_id, count(*) as n from terms group by doc_id
        ), total as (
            select count(*) as docs, cast(sum(n) as bigint) as l from sizes
        ), df as (
            select term, count(*) as df from tf group by term
        ), asked as (
            select item_id, term, count(*) as q
            from (select item_id, unnest(regexp_extract_all({_FOLD}, '{_ALNUM}')) as term from benchmark)
            group by item_id, term
        ), scored as (
            select item_id, doc_id, cast(sum(
                q * cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint)
                * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // l)))) as bigint) as score
            from asked join df using (term) join tf using (term) join sizes using (doc_id), total
            group by item_id, doc_id
        )
        select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank,
               doc_id, score
        from scored where score > 0 qualify rank <= 20
    """,
}
