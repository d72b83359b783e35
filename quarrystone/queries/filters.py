"""Each filter operator over typed metadata (part), and the type-strict cases over JSON (events.props and literals)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators.filter_index import FilterIndex
from ..plans.filters import Typed, Variant, compile_filter
from . import query, table

_CASES = {
    "eq": (["p_size", "Eq", 7], "p_size = 7"),
    "ne": (["p_size", "Ne", 7], "p_size <> 7"),
    "lt": (["p_retailprice", "Lt", 950], "p_retailprice < 950"),
    "lte": (["p_size", "<=", 12], "p_size <= 12"),
    "gt": (["p_brand", "Gt", "Brand#3"], "p_brand > 'Brand#3'"),
    "gte": (["gte", "p_size", 40.5], "p_size >= 40.5"),
    "in": (["p_brand", "In", ["Brand#12", "Brand#23", "Brand#12"]], "p_brand in ('Brand#12', 'Brand#23')"),
    "not_in": (["p_size", "NotIn", [1, 2, 3]], "p_size not in (1, 2, 3)"),
    "contains_any": (["words", "ContainsAny", ["promo", "PROMO", "small"]], "list_has_any(string_split(p_type, ' '), ['promo', 'PROMO', 'small'])"),
    "contains_all_tokens": (["p_name", "ContainsAllTokens", "RING small"], "list_has_all(list_transform(regexp_extract_all(p_name, '[A-Za-z0-9]+'), lambda x: lower(x)), ['ring', 'small'])"),
    "glob": (["p_brand", "Glob", "Brand#?3*"], "p_brand glob 'Brand#?3*'"),
    "regex": (["p_brand", "Regex", "#[12][0-9]$"], "regexp_matches(p_brand, '#[12][0-9]$')"),
    "and": (["And", ["p_size", "Gt", 10], ["p_size", "Lt", 20]], "p_size > 10 and p_size < 20"),
    "or": (["Or", [["p_size", "Eq", 1], ["p_size", "Eq", 50]]], "p_size = 1 or p_size = 50"),
    "not": (["Not", ["p_size", "Gte", 3]], "not p_size >= 3"),
    "nested": (["And", ["Or", ["p_size", "Lt", 5], ["p_size", "Gt", 45]], ["Not", ["p_brand", "Regex", "1"]], ["p_retailprice", "Gte", 900.5]], "(p_size < 5 or p_size > 45) and not regexp_matches(p_brand, '1') and p_retailprice >= 900.5"),
    "missing_field": (["And", ["Not", ["ghost", "Eq", 1]], ["Not", ["ghost", "Ne", 1]], ["p_size", "Eq", 5]], "p_size = 5"),
    "strict_types": (["Or", ["p_size", "Eq", 7.0], ["p_size", "Eq", "7"], ["p_retailprice", "Eq", 901], ["p_size", "Eq", 3]], "p_size = 3"),
}

for _name, (_tree, _sql) in _CASES.items():

    def _run(spark, sf_dir, tree=_tree):
        p = table(spark, sf_dir, "part")
        used = json.dumps(tree)
        if '"words"' in used:
            p = p.withColumn("words", F.split("p_type", " "))
        return p.filter(compile_filter(tree, Typed(p.schema))).select(F.col("p_partkey").cast("string").alias("id"))

    query(f"filter_{_name}", f"select p_partkey::varchar as id from part where {_sql}")(_run)


@query("filter_json_types", "select event_id::varchar as id from events where (props->>'k')::bigint >= 69 and (props->>'k')::bigint < 80 and (props->>'k')::bigint <> 72")
def filter_json_types(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    tree = ["And", ["k", "Gte", 69], ["k", "Lt", 80.0], ["k", "Ne", 72], ["Not", ["k", "Eq", "70"]], ["Not", ["k", "Eq", 70.0]], ["Not", ["gone", "Eq", None]]]
    return e.filter(compile_filter(tree, Variant(F.col("v")))).select(F.col("event_id").cast("string").alias("id"))


#: Metadata objects, and the trees each of which must hold for exactly the rows named.
STRICT = [
    ("a", '{"x": 1, "tags": ["red", "blue"], "t": "Rust and DB", "n": null}'),
    ("b", '{"x": 1.0, "tags": "red", "t": "rust"}'),
    ("c", '{"x": "1", "tags": [1, true], "n": 0}'),
    ("d", '{"x": true, "t": ["rust guide", 5, "db"]}'),
    ("e", "{}"),
]
STRICT_TREES = [
    (["x", "Eq", 1], "a"),
    (["x", "Eq", 1.0], "b"),
    (["x", "Eq", "1"], "c"),
    (["x", "Eq", True], "d"),
    (["x", "Ne", 1], "bcd"),
    (["Not", ["x", "Eq", 1]], "bcde"),
    (["x", "Gte", 1], "ab"),
    (["x", "Lt", True], ""),
    (["x", "Lte", True], "d"),
    (["n", "Eq", None], "a"),
    (["n", "Ne", None], "c"),
    (["n", "Lte", None], "a"),
    (["tags", "In", ["red"]], "ab"),
    (["tags", "In", [True, "blue"]], "ac"),
    (["tags", "NotIn", ["red"]], "c"),
    (["tags", "Eq", "red"], "b"),
    (["t", "ContainsAllTokens", ["DB", "rust"]], "ad"),
    (["t", "Glob", "Rust*"], "a"),
    (["t", "Regex", "^rust$"], "b"),
]


@query("filter_json_strict", "select * from (values " + ", ".join(f"({i}, '{x}')" for i, (_, xs) in enumerate(STRICT_TREES) for x in xs) + ") t(tree, id)")
def filter_json_strict(spark, sf_dir):
    rows = spark.createDataFrame(STRICT, "id string, m string").withColumn("v", F.parse_json("m"))
    hits = F.array(*[F.when(compile_filter(tree, Variant(F.col("v"))), F.lit(i)) for i, (tree, _) in enumerate(STRICT_TREES)])
    return rows.select(F.explode(F.array_compact(hits)).alias("tree"), "id")


def lexicon(spark, sf_dir):
    """The values of two fields of parts, by eight buckets."""
    p = table(spark, sf_dir, "part")
    return FilterIndex.build(p.select((F.col("p_partkey") % 8).cast("int").alias("bucket"), F.to_variant_object(F.struct("p_brand", "p_size", "p_name")).alias("metadata")))


_BUCKETS = "(p_partkey % 8)::integer as bucket"


@query(
    "filter_lexicon",
    f"select field, value, sha256(field || chr(0) || value) as hash, bucket, count(*) as n from (select unnest(['p_brand', 'p_size', 'p_name']) as field, unnest(['\"' || p_brand || '\"', p_size::varchar, '\"' || p_name || '\"']) as value, {_BUCKETS} from part) group by all",
)
def filter_lexicon(spark, sf_dir):
    return lexicon(spark, sf_dir).values


@query("filter_tokens", f"select 'p_name' as field, token, bucket, count(distinct p_partkey) as n from (select p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) as token, {_BUCKETS} from part) group by token, bucket")
def filter_tokens(spark, sf_dir):
    return lexicon(spark, sf_dir).tokens.filter("field = 'p_name'").drop("hash")


@query(
    "filter_estimate",
    f"""with c as (select bucket, count(*) as whole, count(*) filter (where p_size > 10) as a, count(*) filter (where regexp_matches(p_brand, '1')) as b, count(*) filter (where p_size in (1, 2)) as c from (select *, {_BUCKETS} from part) group by bucket)
    select bucket, n from (select bucket, least(whole, least(a, b) + (whole - c)) as n from c) where n > 0""",
)
def filter_estimate(spark, sf_dir):
    """About how many rows of each bucket a filter leaves, from the values alone."""
    got = lexicon(spark, sf_dir).matches(["Or", ["And", ["p_size", "Gt", 10], ["p_brand", "Regex", "1"]], ["Not", ["p_size", "In", [1, 2]]]])
    return spark.createDataFrame(sorted(got.items()), "bucket int, n long")
