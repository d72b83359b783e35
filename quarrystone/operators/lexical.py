"""Full-text search: an inverted index as tables, and BM25 over them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidArgument
from ..functions import text as t
from ..plans import rank
from ..plans.filters import compile_filter

MOST = 65_535
#: Prefix expansion: at most so many terms and bytes (each term costs its length and OVERHEAD), for prefixes of at most so many characters.
TERMS, BYTES, OVERHEAD, PREFIX = 64, 4096, 112, 8


@dataclass(frozen=True)
class FieldConfig:
    enabled: bool = True
    tokenizer: str = "word_v1"
    k1: float = t.K1
    b: float = t.B


def configs(schema: dict | None, fields: list[str]) -> dict[str, FieldConfig]:
    """The metadata schema's full_text_search entries; fields without one are indexed with defaults."""
    out = {}
    for f in fields:
        entry = (schema or {}).get(f, {})
        fts = entry.get("full_text_search", True) if isinstance(entry, dict) else True
        if isinstance(fts, bool):
            out[f] = FieldConfig(enabled=fts)
            continue
        if fts.get("tokenizer", "word_v1") != "word_v1":
            raise InvalidArgument(f"unknown tokenizer {fts['tokenizer']}")
        own = fts.get("bm25", {})
        k1, b = (float(own.get(n, fts.get(n, d))) for n, d in (("k1", t.K1), ("b", t.B)))
        if k1 < 0 or not 0 <= b <= 1:
            raise InvalidArgument("k1 must not be negative, b is from 0 to 1")
        out[f] = FieldConfig(bool(fts.get("enabled", True)), "word_v1", k1, b)
    return out


def bucket_of(field_: Column, term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(field_, term), F.lit(buckets)).cast("int")


@dataclass
class LexicalIndex:
    """postings: field, term, id, h (tie-break), tf, len; stats: field, docs, total; docs: id and metadata, for filters."""

    postings: DataFrame
    stats: DataFrame
    docs: DataFrame
    config: dict[str, FieldConfig] = field(default_factory=dict)
    saved: bool = False  # whether postings are stored; else queries read the documents themselves
    buckets: int = 0  # folders of the stored postings
    words: DataFrame | None = None  # id, h, field, tokens of the documents, where postings are made of them

    @staticmethod
    def build(docs: DataFrame, fields: list[str], schema: dict | None = None) -> LexicalIndex:
        """docs: id and text (or array of texts) fields. One pass: tokens are counted within each row, so no shuffle is needed."""
        config = {f: c for f, c in configs(schema, fields).items() if c.enabled}
        kinds = dict(docs.dtypes)
        each = [F.struct(F.lit(f).alias("field"), _field_tokens(f, kinds[f]).alias("tokens")) for f in config]
        rows = docs.select("id", t.stable_hash(F.col("id")).alias("h"), F.explode(F.array(*each)).alias("f"))
        words = rows.select("id", "h", "f.field", "f.tokens").filter("size(tokens) > 0")
        length = F.least(F.size("tokens"), F.lit(MOST)).alias("len")
        stats = words.groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.sum(length).alias("total"))
        return LexicalIndex(_postings(words), stats, docs, config, words=words)

    def save(self, path: str, buckets: int | None = None) -> None:
        """Terms are dealt out by hash to folders, and sorted, so a query opens its terms' folders and reads their row groups only; a frequent term's documents go to some parts.

        buckets: by default one for each 20,000 documents, 4 at least; a part for each million documents, 8 at most.
        """
        stats = self.stats.collect()  # a row for each field
        docs = max((r.docs for r in stats), default=0)
        buckets = buckets or max(4, docs // 20_000)
        part = F.pmod(F.xxhash64("id"), F.lit(min(8, 1 + docs // 1_000_000)))
        salted = bucket_of(F.col("field"), F.col("term"), buckets)
        self.postings.withColumn("bucket", salted).repartition("bucket", part).sortWithinPartitions("bucket", "field", "term", "h").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        facts = self.stats.sparkSession.createDataFrame([(r.field, r.docs, r.total, buckets) for r in stats], "field string, docs long, total long, buckets int")
        facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(docs: DataFrame, path: str, fields: list[str], schema: dict | None = None) -> LexicalIndex:
        spark = docs.sparkSession
        config = {f: c for f, c in configs(schema, fields).items() if c.enabled}
        stats = spark.read.schema("field string, docs long, total long, buckets int").parquet(f"{path}/stats")
        form = f"field string, term string, id {dict(docs.dtypes)['id']}, h string, tf int, len int, bucket int"
        first = stats.select("buckets").first()
        postings = spark.read.schema(form).parquet(f"{path}/postings") if first else spark.createDataFrame([], form)  # no document has a word
        return LexicalIndex(postings, stats.drop("buckets"), docs, config, True, first.buckets if first else 0)

    def changed(self, ids: DataFrame, docs: DataFrame) -> LexicalIndex:
        """The index after documents with these ids were written or deleted: only they are cut into words again."""
        fresh = LexicalIndex.build(docs.join(ids, "id", "left_semi"), list(self.config))
        columns = ["field", "term", "id", "h", "tf", "len"]
        kept = self.postings.select(*columns).join(ids, "id", "left_anti").select(*columns)
        both = kept.unionByName(fresh.postings.select(*columns))
        stats = both.groupBy("field", "id").agg(F.first("len").alias("len")).groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.sum("len").alias("total"))
        return LexicalIndex(both, stats, docs, self.config, True)

    def term_stats(self) -> DataFrame:
        return self.postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))

    def field_stats(self) -> DataFrame:
        return self.stats.select("field", "docs", "total", (F.col("total") / F.col("docs")).alias("average"))

    def doc_lookup(self) -> DataFrame:
        if self.words is None:
            return self.postings.select("field", "id", "h", "len").distinct()
        return self.words.select("field", "id", "h", F.least(F.size("tokens"), F.lit(MOST)).alias("len")).distinct()

    def expand(self, prefix: str, fields: list[str]) -> list[tuple[str, str]]:
        """(field, term) of a prefix query, in the order of the terms' hashes, within the limits."""
        p = prefix.strip().lower()
        if not p or len(p) > PREFIX:
            return []
        if self.saved:
            found = self.postings.filter(F.col("field").isin(*fields) & F.col("term").startswith(p)).select("field", "term")
        else:
            kinds = dict(self.docs.dtypes)
            each = [F.struct(F.lit(f).alias("field"), F.array_distinct(F.filter(_field_tokens(f, kinds[f]), lambda x: F.startswith(x, F.lit(p)))).alias("terms")) for f in fields]
            found = self.docs.select(F.inline(F.array(*each))).select("field", F.explode("terms").alias("term"))
        found = found.distinct()
        first = found.withColumn("hash", t.term_hash(F.col("term")))
        w = Window.partitionBy("field").orderBy("hash", "term")
        rows = first.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= TERMS).orderBy("field", "n").collect()  # TERMS a field at most
        out, spent = [], {}
        for r in rows:
            spent[r.field] = spent.get(r.field, 0) + len(r.term.encode()) + OVERHEAD
            if spent[r.field] <= BYTES:
                out.append((r.field, r.term))
        return out

    def _leaf_terms(self, leaf: rank.Bm25) -> list[tuple[str, str]]:
        fields = [f for f in self.config if leaf.field is None or f == leaf.field]
        if leaf.prefix:
            return [x for word in t.tokens_of(leaf.query) for x in self.expand(word, fields)] if fields else []
        return [(f, w) for f in fields for w in t.tokens_of(leaf.query)]

    def scored(self, expr: Any, where: Any = None, backend: Callable[[], Any] | None = None) -> DataFrame:
        """id, h, leaf_0.., base, boost, score of every document that scores above 0.

        A boost multiplies the whole score.
        """
        leaves = rank.leaves(expr)
        terms = [list(dict.fromkeys(self._leaf_terms(x))) for x in leaves]
        docs = self._from_postings(terms) if self.saved else self._from_documents(terms)
        at = iter(range(len(leaves)))
        docs = docs.withColumn("base", _evaluate(expr, at))
        if where is not None or rank.boosts(expr):
            meta = self.docs
            if where is not None:
                meta = meta.filter(compile_filter(where, backend))
            boost = F.lit(1.0)
            for x in rank.boosts(expr):
                boost = boost * F.when(compile_filter(json.loads(x.filter_json), backend), F.lit(x.boost)).otherwise(1.0)
            docs = docs.join(meta.select("id", boost.alias("boost")), "id")
        else:
            docs = docs.withColumn("boost", F.lit(1.0))
        return docs.withColumn("score", F.col("base") * F.col("boost")).filter("score > 0")

    def _from_postings(self, terms: list[list[tuple[str, str]]]) -> DataFrame:
        """id, h, leaf_0..: reads the postings of the terms and adds by document."""
        wanted = list(dict.fromkeys(x for ts in terms for x in ts))
        match = reduce(lambda a, b: a | b, [(F.col("field") == f) & (F.col("term") == w) for f, w in wanted], F.lit(False))
        found = self.postings.filter(match)
        if self.buckets and wanted:  # constants, so they become a partition filter
            found = found.filter(F.col("bucket").isin(*[bucket_of(F.lit(f), F.lit(w), self.buckets) for f, w in wanted]))
        df = found.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
        facts = df.join(self.stats, "field")  # a row for each of the query's terms
        known = found.join(F.broadcast(facts), ["field", "term"])
        by_field = lambda get: reduce(lambda c, f: c.when(F.col("field") == f, F.lit(get(self.config[f]))), self.config, F.when(F.lit(False), F.lit(0.0)))
        k1, b = by_field(lambda c: c.k1), by_field(lambda c: c.b)
        weight = t.bm25(t.idf(F.col("docs"), F.col("df")), F.col("tf"), F.col("len"), F.col("total") / F.col("docs"), k1, b)
        sums = []
        for i, ts in enumerate(terms):
            own = reduce(lambda a, b: a | b, [(F.col("field") == f) & (F.col("term") == w) for f, w in ts], F.lit(False))
            sums.append(F.sum(F.when(own, F.col("w")).otherwise(0.0)).alias(f"leaf_{i}"))
        return known.withColumn("w", weight).groupBy("id", "h").agg(*sums)

    def _from_documents(self, terms: list[list[tuple[str, str]]]) -> DataFrame:
        """The same in two passes over the documents, the first for the statistics (one row); nothing is shuffled."""
        wanted = list(dict.fromkeys(x for ts in terms for x in ts))
        used = list(dict.fromkeys(f for f, _ in wanted))
        if not wanted:
            return self.docs.select("id", t.stable_hash(F.col("id")).alias("h"), *[F.lit(0.0).alias(f"leaf_{i}") for i in range(len(terms))])
        kinds = dict(self.docs.dtypes)
        own = {f: [w for g, w in wanted if g == f] for f in used}
        cut = self.docs.select("id", *[_field_tokens(f, kinds[f]).alias(f"t{i}") for i, f in enumerate(used)])
        # of each document only its lengths and the query's words in it go on
        hits = cut.select(
            "id",
            *[F.least(F.size(f"t{i}"), F.lit(MOST)).alias(f"len{i}") for i in range(len(used))],
            *[F.filter(f"t{i}", _one_of(own[f])).alias(f"h{i}") for i, f in enumerate(used)],
        )
        at = {x: f"n{j}" for j, x in enumerate(wanted)}
        count = lambda i, w: F.least(F.size(F.filter(f"h{i}", lambda x: x == F.lit(w))), F.lit(MOST))
        facts = F.struct(*[F.col(f"len{i}") for i in range(len(used))], *[count(used.index(f), w).alias(at[f, w]) for f, w in wanted])
        rows = hits.select("id", F.inline(F.array(facts)))  # a generator: filters on scores stay above it
        r = rows.agg(
            *[x for i in range(len(used)) for x in (F.count_if(F.col(f"len{i}") > 0).alias(f"docs{i}"), F.sum(f"len{i}").alias(f"total{i}"))],
            *[F.count_if(F.col(c) > 0).alias(f"df_{c}") for c in at.values()],
        ).first()
        leaf = []
        for j, ts in enumerate(terms):
            total = F.lit(0.0)
            for f, w in ts:
                i, c, cfg = used.index(f), at[f, w], self.config[f]
                n = r[f"docs{i}"]
                if n and r[f"df_{c}"]:
                    weight = t.bm25(t.idf(F.lit(n), F.lit(r[f"df_{c}"])), F.col(c), F.col(f"len{i}"), F.lit(r[f"total{i}"] / n), cfg.k1, cfg.b)
                    total = total + F.when(F.col(c) > 0, weight).otherwise(0.0)
            leaf.append(total.alias(f"leaf_{j}"))
        return rows.select("id", t.stable_hash(F.col("id")).alias("h"), *leaf)

    def search(self, tree: Any, k: int = 10, where: Any = None, backend: Any = None) -> DataFrame:
        """id, score: cut by score and hash of the id, then ordered by score and id."""
        got = self.scored(rank.parse(tree), where, backend)
        return got.orderBy(F.desc("score"), "h").limit(k).select("id", "score").orderBy(F.desc("score"), "id")

    def explain(self, tree: Any, k: int = 10, where: Any = None, backend: Any = None) -> DataFrame:
        if k > 100:
            raise InvalidArgument("explain takes a top_k of at most 100")
        got = self.scored(rank.parse(tree), where, backend)
        return got.drop("h").withColumnRenamed("score", "final_score").orderBy(F.desc("final_score"), "id").limit(k)


def _one_of(words: list[str]) -> Callable[[Column], Column]:
    return lambda x: x.isin(*words)


def _field_tokens(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    texts = F.flatten(F.transform(F.array_compact(c), t.tokens)) if kind.startswith("array") else t.tokens(c.cast("string"))
    return F.coalesce(texts, F.array().cast("array<string>"))


def _postings(words: DataFrame) -> DataFrame:
    """id, h, field, tokens -> field, term, id, h, tf, len: tokens are counted within each row."""
    rows = words.select("id", "h", "field", F.array_sort("tokens").alias("s"))
    rows = rows.select("id", "h", "field", F.least(F.size("s"), F.lit(MOST)).alias("len"), _runs(F.col("s")).alias("runs"))
    return rows.select("field", F.inline("runs"), "id", "h", "len").select("field", "term", "id", "h", F.least("tf", F.lit(MOST)).alias("tf"), "len")


def _runs(s: Column) -> Column:
    """Sorted tokens -> (term, tf) of each run of equal ones."""

    def of(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.get(
            F.transform(F.array(starts), lambda a: F.transform(a, lambda p, j: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(a, j + 1), F.size(s)) - p).alias("tf")))),
            F.lit(0),
        )

    return F.get(F.transform(F.array(s), of), F.lit(0))


def _evaluate(e: Any, at) -> Column:
    if isinstance(e, rank.Many):
        parts = [_evaluate(c, at) for c in e.children]
        return reduce(lambda a, b: a + b, parts) if e.op == "sum" else F.greatest(F.lit(0.0), *parts)
    if isinstance(e, rank.Product):
        return F.lit(e.weight) * _evaluate(e.child, at)
    if isinstance(e, rank.Boost):
        return _evaluate(e.child, at)
    return F.col(f"leaf_{next(at)}")
