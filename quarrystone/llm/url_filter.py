"""URL filtering by a character language-model ratio, with DataFrame functions only.

Rules give some URLs a verdict. Two smoothed variable-order Markov models of
characters, one of accepted and one of rejected URLs, are learned from four
fifths of those; a URL is scored by the mean over its characters of the
log-likelihood difference (log10 accepted - rejected), which is calibrated on
the last fifth: the cut lies midway between the means of accepted and rejected.
URLs that no rule fits are blocked if their score is below the cut.

The models see nothing of a URL that rules look at, or they would learn the
rules: they get the host without the longest host of a rule that it ends with
(or its last label), and the path without as many segments as rules name.

The order varies by Witten and Bell's weights: the more often a context was
seen, and the fewer characters followed it, the more it counts against the next
shorter one. Characters are folded to SYMBOLS classes, so the models have at
most SYMBOLS ** (ORDER + 1) entries, whatever the number of URLs; that bound is
what allows them to be broadcast, and what limits the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import cut, table

#: (rule, allow). A rule is a host and the beginning of a path.
RULES = (("com/", True), ("example.com/en/", False), ("www.example.com/en/", True), ("net/es/", False), ("net/fr/", False))
#: Characters of context at most.
ORDER = 3
#: a-z, 0 (all digits), . / - _ ? = & % # ~ (all others) and ^ (before the beginning).
FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789"
TO = "abcdefghijklmnopqrstuvwxyz000000000"
OTHER = r"[^a-z0./\-_?=&%#]"
SYMBOLS = 38


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), FROM[:26], TO[:26])
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (of equal ones the first by name) or null, and whether it allows."""
    rule, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for text, ok in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        at = text.find("/")
        own_host, own_path = text[:at], text[at:]
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit(own_path))
        rule, allow = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(ok)).otherwise(allow)
    return rule, allow


def depth(rules) -> int:
    """How many path segments rules name at most."""
    return max((text[text.find("/") :].count("/") - 1 for text, _ in rules), default=0)


def unruled(host: Column, path: Column, rules=RULES) -> Column:
    """What is left of a URL without all that rules look at."""
    rest = F.regexp_replace(host, r"[^.]*$", "")
    for own in sorted({text[: text.find("/")] for text, _ in rules}, key=lambda x: (len(x), x)):
        fits = (host == own) | F.endswith(host, F.lit("." + own))
        rest = F.when(fits, F.substring(host, F.lit(1), F.length(host) - len(own))).otherwise(rest)
    return F.concat(rest, F.regexp_replace(path, rf"^(?:/[^/]*){{{depth(rules)}}}/", "/"))


def _models(grams: DataFrame, order: int) -> DataFrame:
    """g (order + 1 characters) -> d, the difference of the two models' log10 probabilities of its last character.

    grams: g, a, r: counts in accepted and rejected URLs. A context that one
    class hasn't leaves its model's probability to the shorter context.
    """
    p = grams.select("g", "a", "r")
    levels = []
    for k in range(order + 1):  # k characters of context
        x = F.substring("g", order + 1 - k, k + 1)
        c = p.groupBy(x.alias("x")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        n = c.groupBy(F.substring("x", 1, k).alias("u")).agg(*[f for y in "ar" for f in (F.sum(y).alias(f"n{y}"), F.count_if(F.col(y) > 0).alias(f"t{y}"))])
        levels.append(c.join(F.broadcast(n), F.substring(c.x, 1, k) == n.u).select("x", "a", "r", "na", "nr", "ta", "tr"))
    low = levels[0].select("x", *[((F.col(c) + 1.0) / (F.col(f"n{c}") + float(SYMBOLS))).alias(f"p{c}") for c in "ar"])
    for k in range(1, order + 1):
        low = low.select(F.col("x").alias("y"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        top = levels[k]
        mixed = [F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"q{c}")) / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(F.col(f"q{c}")).alias(f"p{c}") for c in "ar"]
        low = top.join(F.broadcast(low), F.substring(top.x, 2, k) == low.y).select("x", *mixed)
    return low.select(F.col("x").alias("g"), (F.log10("pa") - F.log10("pr")).alias("d"))


def judge(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages (page_id, url).

    A null url, or one without ://, has empty parts and the score 0; without
    training urls of both classes there is no cut, and all urls without a rule
    are allowed, as is a url whose score equals the cut (ties). Repeated rows
    count and are judged each for itself; a url is read whole, however long;
    other columns are ignored; an empty table gives an empty result.
    """
    host, path = parts(F.col("url"))
    rule, allow = ruled(F.col("host"), F.col("path"), rules)
    p = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    p = p.select("page_id", "host", "path", rule.alias("rule"), allow.alias("allow"))
    folded = F.regexp_replace(F.translate(unruled(F.col("host"), F.col("path"), rules), FROM, TO), OTHER, "~")
    padded = F.concat(F.lit("^" * order), folded)
    n = F.length(folded)
    fold = F.pmod(F.conv(F.substring(F.md5(F.concat("host", "path").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(5))
    p = cut(p.select("*", F.monotonically_increasing_id().alias("row"), F.split(padded, "").alias("s"), n.alias("n"), fold.alias("fold")), "url-pages")
    each = p.filter("n > 0").select("row", "n", "allow", "fold", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.array_join(F.slice("s", i, order + 1), ""))).alias("g"))
    counts = each.groupBy("g").agg(F.count_if(F.col("allow") & (F.col("fold") != 0)).alias("a"), F.count_if(~F.col("allow") & (F.col("fold") != 0)).alias("r"))
    model = cut(_models(cut(counts, "url-grams"), order), "url-model")
    score = each.join(F.broadcast(model), "g").groupBy("row").agg(F.sum("d").alias("total"))
    scored = cut(p.join(score, "row", "left").withColumn("score", F.round(F.coalesce(F.col("total") / F.col("n"), F.lit(0.0)), 9)).drop("total", "s", "n"), "url-scored")
    means = [F.avg(F.when((F.col("fold") == 0) & (F.col("allow") == F.lit(ok)), F.col("score"))).alias(name) for name, ok in (("ma", True), ("mr", False))]
    ma, mr = scored.agg(*means).first()
    cutoff = None if ma is None or mr is None else round((ma + mr) / 2, 9)
    ok = F.coalesce("allow", F.lit(True) if cutoff is None else F.col("score") >= F.lit(cutoff))
    return scored.select("page_id", "host", "path", "rule", F.when(ok, F.lit("allow")).otherwise(F.lit("block")).alias("verdict"), "score")


def op2_character_model_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("score")


_RULE = "case " + " ".join(
    f"when (host = '{r[: r.find('/')]}' or ends_with(host, '.{r[: r.find('/')]}')) and starts_with(path, '{r[r.find('/') :]}') then {{{i}}}"
    for i, (r, _) in enumerate(sorted(RULES, key=lambda x: -len(x[0])))
) + " end"
_LONGEST = sorted(RULES, key=lambda x: -len(x[0]))


def _level(k: int) -> str:
    mixed = ", ".join(f"case when n{c} > 0 then ({c} + t{c} * l.p{c}) / (n{c} + t{c}) else l.p{c} end as p{c}" for c in "ar")
    up = (
        f"select x, (a + 1.0::double) / (na + {SYMBOLS}.0::double) as pa, (r + 1.0::double) / (nr + {SYMBOLS}.0::double) as pr from c{k}"
        if not k
        else f"select c.x, {mixed} from c{k} c join m{k - 1} l on l.x = substr(c.x, 2)"
    )
    sums = ", ".join(f"(sum({c}) over u)::double as n{c}, (count(*) filter (where {c} > 0) over u)::double as t{c}" for c in "ar")
    return f"""
), n{k} as (
  select substr(g, {ORDER + 1 - k}, {k + 1}) as x, sum(a) as a, sum(r) as r from counts group by 1
), c{k} as (
  select x, a::double as a, r::double as r, {sums} from n{k} window u as (partition by substr(x, 1, {k}))
), m{k} as (
  {up}"""


_HOSTS = sorted({r[: r.find("/")] for r, _ in RULES}, key=lambda x: (-len(x), x))
_REST = "case " + " ".join(f"when host = '{h}' or ends_with(host, '.{h}') then substr(host, 1, length(host) - {len(h)})" for h in _HOSTS) + " else regexp_replace(host, '[^.]*$', '') end"
OP2_SQL = f"""
with u as (
  select page_id, row_number() over () as row, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) as rest from pages
), h as (
  select page_id, row, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{FROM[:26]}', '{TO[:26]}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), p as (
  select *, {_RULE.format(*[f"'{r}'" for r, _ in _LONGEST])} as rule, {_RULE.format(*[str(ok).lower() for _, ok in _LONGEST])} as allow,
    regexp_replace(translate({_REST} || regexp_replace(path, '^(?:/[^/]*){{{depth(RULES)}}}/', '/'), '{FROM}', '{TO}'), '{OTHER}', '~', 'g') as s, ('0x' || substr(md5(host || path), 1, 8))::bigint % 5 as fold from h
), each as (
  select row, allow, fold, substr('{"^" * ORDER}' || s, i, {ORDER + 1}) as g from (select *, unnest(range(1, length(s) + 1)) as i from p where s <> '')
), counts as (
  select g, count(*) filter (where allow and fold <> 0) as a, count(*) filter (where not allow and fold <> 0) as r from each group by g{"".join(_level(k) for k in range(ORDER + 1))}
), total as (
  select row, sum(log10(pa) - log10(pr)) as t from each join m{ORDER} on x = g group by row
), scored as (
  select p.*, round(coalesce(t / length(s), 0), 9) as score from p left join total using (row)
), cutoff as (
  select round((avg(score) filter (where fold = 0 and allow) + avg(score) filter (where fold = 0 and not allow)) / 2, 9) as c from scored
)
select page_id, host, path, rule, case when coalesce(allow, score >= (select c from cutoff), true) then 'allow' else 'block' end as verdict from scored
"""
