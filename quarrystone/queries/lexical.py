"""Full-text queries over documents; fields are body (the text), lang and source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.lexical import LexicalIndex
from ..plans.filters import Typed
from . import query, spread, table

FIELDS = ["body", "lang", "source"]


def docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"), "lang", "source")


def index(spark, sf_dir, fields=FIELDS, schema=None):
    return LexicalIndex.build(docs(spark, sf_dir), fields, schema)


def _base(fields=FIELDS, k1="1.2", b="0.75"):
    each = " union all ".join(f"select id, h, '{f}' as field, {f} as t from d" for f in fields)
    return f"""
with d as (select doc_id::varchar as id, substr(sha256(doc_id::varchar), 1, 16) as h, text as body, lang, source from documents),
tok as (select id, h, field, lower(unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+'))) as term from ({each})),
post as (select field, term, id, h, least(count(*), 65535) as tf from tok group by all),
len as (select id, field, least(count(*), 65535) as len from tok group by all),
stats as (select field, count(*) as docs, sum(len) as total from len group by field),
df as (select field, term, count(*) as df from post group by all),
w as (select p.id, p.h, field, term, ln(1 + (docs - df + 0.5::double) / (df + 0.5::double)) * tf * ({k1}::double + 1) / (tf + {k1}::double * (1 - {b}::double + {b}::double * len / (total::double / docs))) as w
  from post p join len using (id, field) join stats using (field) join df using (field, term))"""


def _search(score: str, k: int = 10, having: str = "true", leaves: str = "", fields=FIELDS, join: str = "", k1="1.2", b="0.75", extra: str = "") -> str:
    return f"""{_base(fields, k1, b)}{extra},
s as (select w.id, w.h, {score} as score from w {join} group by w.id, w.h{leaves}),
top as (select * from s where score > 0 and {having} order by score desc, h limit {k})
select id, round(score, 6) as score from top
"""


def leaf(terms: str, field: str | None = None) -> str:
    return f"coalesce(sum(w) filter (where term in ({terms}){f" and field = '{field}'" if field else ''}), 0)"


def show(df):
    return df.select("id", F.round("score", 6).alias("score"))


@query("tokenize_terms", _base(["body"]) + " select term, sum(tf)::bigint as n from post group by term")
def tokenize_terms(spark, sf_dir):
    tokens = docs(spark, sf_dir).select(F.explode(t.tokens(F.col("body"))).alias("term"))
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("field_stats", _base() + " select field, docs, total::bigint as total, round(total::double / docs, 6) as average from stats")
def field_stats(spark, sf_dir):
    return index(spark, sf_dir).field_stats().select("field", "docs", "total", F.round("average", 6).alias("average"))


@query("term_stats", _base() + " select field, term, count(*) as df, sum(tf)::bigint as total_tf from post group by field, term")
def term_stats(spark, sf_dir):
    return index(spark, sf_dir).term_stats()


@query("doc_lookup", _base() + " select distinct field, post.id, post.h, len::integer as len from post join len using (id, field)")
def doc_lookup(spark, sf_dir):
    return index(spark, sf_dir).doc_lookup()


@query("bm25_field", _search(leaf("'the', 'of', 'und'", "body"), fields=["body"]))
def bm25_field(spark, sf_dir):
    return show(index(spark, sf_dir, ["body"]).search(["body", "BM25", "The of UND of"], 10))


@query("bm25_text", _search(leaf("'de', 'src7', 'la'")))
def bm25_text(spark, sf_dir):
    return show(index(spark, sf_dir).search(["text", "BM25", "de src7 la"], 10))


@query(
    "bm25_prefix",
    _search(
        "coalesce(sum(w) filter (where term in (select term from pre)), 0)",
        fields=["body"],
        extra=""", pre as (select term from (select term, n, sum(strlen(term) + 112) over (order by n) as spent from (select term, row_number() over (order by sha256(term), term) as n from (select distinct term from post where starts_with(term, 'thes')))) where n <= 64 and spent <= 4096)""",
    ),
)
def bm25_prefix(spark, sf_dir):
    return show(index(spark, sf_dir, ["body"]).search(["body", "BM25_PREFIX", "Thes"], 10))


@query("bm25_sum", _search(f"{leaf("'the', 'with'", 'body')} + {leaf("'en'", 'lang')}", fields=["body", "lang"]))
def bm25_sum(spark, sf_dir):
    return show(index(spark, sf_dir, ["body", "lang"]).search(["Sum", ["body", "BM25", "the with"], ["lang", "BM25", "en"]], 10))


@query("bm25_max", _search(f"greatest(0, {leaf("'the'", 'body')}, {leaf("'de'", 'lang')}, {leaf("'src3'", 'source')})", k=20))
def bm25_max(spark, sf_dir):
    return show(index(spark, sf_dir).search(["Max", [["body", "BM25", "the"], ["lang", "BM25", "de"], ["source", "BM25", "src3"]]], 20))


@query("bm25_product", _search(f"3 * {leaf("'con', 'para'", 'body')} + 0.5::double * {leaf("'es'", 'lang')}", fields=["body", "lang"]))
def bm25_product(spark, sf_dir):
    return show(index(spark, sf_dir, ["body", "lang"]).search(["Sum", ["Product", 3, ["body", "BM25", "con para"]], ["Product", 0.5, ["lang", "BM25", "es"]]], 10))


@query("bm25_boost", _search(f"{leaf("'the', 'that'", 'body')} * (case when any_value(d.source) = 'src5' then 2 else 1 end)", fields=["body"], join="join d on d.id = w.id"))
def bm25_boost(spark, sf_dir):
    i = index(spark, sf_dir, ["body"])
    return show(i.search(["rank_by_filter", ["source", "Eq", "src5"], ["body", "BM25", "the that"], 2.0], 10, backend=Typed(i.docs.schema)))


@query("bm25_filtered", _search(leaf("'le', 'les'", "body"), fields=["body"], join="join d on d.id = w.id and d.lang = 'fr' and d.source in ('src1', 'src2', 'src3')"))
def bm25_filtered(spark, sf_dir):
    i = index(spark, sf_dir, ["body"])
    where = ["And", ["lang", "Eq", "fr"], ["source", "In", ["src1", "src2", "src3"]]]
    return show(i.search(["body", "BM25", "le les"], 10, where, Typed(i.docs.schema)))


@query("bm25_field_config", _search(leaf("'the', 'was'", "body"), fields=["body"], k1="0.9", b="0.4"))
def bm25_field_config(spark, sf_dir):
    schema = {"body": {"full_text_search": {"tokenizer": "word_v1", "k1": 0.9, "b": 0.4}}, "lang": {"full_text_search": False}}
    return show(index(spark, sf_dir, ["body", "lang"], schema).search(["text", "BM25", "the was"], 10))


@query(
    "bm25_explain",
    f"""{_base(["body", "lang"])},
s as (select id, {leaf("'the', 'with'", "body")} as leaf_0, {leaf("'en'", "lang")} as leaf_1 from w group by id),
f as (select *, leaf_0 + 2 * leaf_1 as base from s)
select id, round(leaf_0, 6) as leaf_0, round(leaf_1, 6) as leaf_1, round(base, 6) as base, 1.0::double as boost, round(base, 6) as final_score from f where base > 0 order by f.base desc, id limit 10
""",
)
def bm25_explain(spark, sf_dir):
    got = index(spark, sf_dir, ["body", "lang"]).explain(["Sum", ["body", "BM25", "the with"], ["Product", 2, ["lang", "BM25", "en"]]], 10)
    return got.select("id", *[F.round(c, 6).alias(c) for c in ("leaf_0", "leaf_1", "base")], "boost", F.round("final_score", 6).alias("final_score"))


@query("store_ask_text", _search(leaf("'license', 'the', 'und'", "body")))
def store_ask_text(spark, sf_dir):
    """Asked of a collection whose full-text index is stored: only the words' folders are read."""
    from .store import collection

    got = collection(spark, sf_dir, "documents").ask("documents", ["body", "BM25", "license the und"], 10, include_attributes=False)
    return got.select("id", F.round(-F.col("$dist"), 6).alias("score"))
