"""URL rules, and for URLs without one a ratio of character language models; DataFrame functions only.

The models are variable-order Markov models over 39 symbols, learnt from the URLs that
rules accept and from those that rules reject: contexts of up to three symbols,
smoothed into shorter ones by Witten and Bell's weights.  A URL's score is the
difference of its two log-likelihoods over its length; the threshold lies midway
between the mean scores of accepted and of rejected URLs that were not learnt from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._exchange import width, written

# Verdict, host, path; a rule fits its host and every subdomain.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DEPTH = 4
#: Grams that are broadcast at most, and rows of one URL that a task takes.
MAX_BROADCAST, HOT = 500_000, 1 << 20
SYMBOLS = 39
LETTERS = "abcdefghijklmnopqrstuvwxyz0/.-?=&#:_%"  # and "~" for what is none of these, "$" for the end


def parts(url: Column) -> tuple[Column, Column]:
    """Host, its A-Z lower-cased, and path; both empty without ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like ``net/de/``, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def grams(url: Column) -> Column:
    """For each symbol of a URL and its end, the symbol after the three before it; at most 39^4 differ."""
    low = F.translate(F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    text = F.concat(F.lit("^" * (DEPTH - 1)), F.regexp_replace(low, "(?s)[^a-z0/.\\-?=&#:_%]", "~"), F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(text) - DEPTH + 1), lambda i: F.substring(text, i, DEPTH))


def model(seen: DataFrame) -> DataFrame:
    """(gram, ratio): log-probability of a gram's last symbol after the others, accepted less rejected.

    ``seen``: (gram, allow, block) with how often it occurs in URLs of either kind, or in neither.  At most 39^4 grams.
    """
    kinds = ("allow", "block")
    table = seen.select("gram", *[F.lit(1 / SYMBOLS).alias(f"p_{v}") for v in kinds])
    for k in range(1, DEPTH + 1):
        end, context = F.substring("gram", DEPTH - k + 1, k), F.substring("gram", DEPTH - k + 1, k - 1)
        counts = seen.groupBy(end.alias("end")).agg(*[F.sum(v).alias(f"n_{v}") for v in kinds])
        contexts = counts.groupBy(F.substring("end", 1, k - 1).alias("context")).agg(*[F.sum(f"n_{v}").alias(f"all_{v}") for v in kinds], *[F.count_if(F.col(f"n_{v}") > 0).alias(f"kinds_{v}") for v in kinds])
        table = table.withColumn("end", end).withColumn("context", context).join(counts, "end").join(contexts, "context")
        smoothed = [F.when(F.col(f"all_{v}") == 0, F.col(f"p_{v}")).otherwise((F.col(f"n_{v}") + F.col(f"kinds_{v}") * F.col(f"p_{v}")) / (F.col(f"all_{v}") + F.col(f"kinds_{v}"))).alias(f"p_{v}") for v in kinds]
        table = table.select("gram", *smoothed)
    return table.select("gram", (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, aside: str = "012") -> DataFrame:
    """Host, path, rule and verdict of every page.

    One row per input row: ``(page_id, host, path, rule, verdict, score)``; the verdict is the longest
    rule's, else ``allow`` where score (accepted less rejected log-likelihood per symbol) reaches the
    threshold, else ``block``.  URLs whose MD5 begins with a digit of ``aside`` are not learnt from but set the threshold.  A null URL, or one without ``://``, has empty host and path and is scored
    as the symbols it has.  With no URL of one kind to learn from, that kind's model is uniform.  A URL counts once, however
    many rows have it.  Null ids and repeated rows are kept; an empty table gives no rows; other columns are not read.
    """
    key = F.coalesce(F.col(url_col), F.lit(""))
    host, path = parts(F.col("url"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    split = lambda df: df.select("*", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("ruled"))
    urls = written(split(pages.groupBy(key.alias("url")).agg(F.count("*").alias("n"))).select("url", "n", "ruled", F.substring(F.md5("url"), 1, 1).isin(*aside).alias("aside")))
    # few bytes, so one task would read them all, but each becomes many grams
    pieces = urls.repartition(width(pages.sparkSession), "url").select("*", F.explode(grams(F.col("url"))).alias("gram"))
    learnt = lambda v: F.count_if((F.col("ruled") == v) & ~F.col("aside")).alias(v)
    ratios = written(model(written(pieces.groupBy("gram").agg(learnt("allow"), learnt("block")))))
    small = ratios.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    scored = written(pieces.join(F.broadcast(ratios) if small else ratios, "gram").groupBy("url", "n", "ruled", "aside").agg(F.avg("ratio").alias("score")))
    mean = lambda v: F.avg(F.when(F.col("ruled") == v, F.col("score")))
    a, b = scored.where("aside").agg(mean("allow"), mean("block")).first()
    passed = F.when(F.col("score") >= F.lit(0.0 if a is None or b is None else (a + b) / 2), "allow").otherwise("block")
    rows = split(pages.select(F.col(id_col).alias("page_id"), key.alias("url")))
    # the rows of a URL that very many pages share go to many tasks; there is at most one such URL for HOT rows
    blocks = F.ceil(F.col("n") / HOT).cast("int")
    hot = scored.where(F.col("n") > HOT).select("url", blocks.alias("blocks"))
    dealt = rows.join(F.broadcast(hot), "url", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("blocks")), F.lit(0)).cast("int"))
    copies = scored.select("url", "score", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("salt"))
    return dealt.join(copies, ["url", "salt"]).select("page_id", "host", "path", "rule", F.coalesce("ruled", passed).alias("verdict"), F.round("score", 9).alias("score"))


def _sql() -> str:
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fits = lambda h, p: f"(host = '{h}' or host like '%.{h}') and starts_with(path, '{p}')"
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    levels = ["m0 as (select gram, 1.0::double / 39 pa, 1.0::double / 39 pb from seen)"]
    for k in range(1, DEPTH + 1):
        end, context = f"substr(gram, {DEPTH - k + 1}, {k})", f"substr(gram, {DEPTH - k + 1}, {k - 1})"
        smooth = lambda v: f"case when t{v} = 0 then p{v} else (n{v} + d{v} * p{v}) / (t{v} + d{v}) end p{v}"
        levels.append(f"c{k} as (select {end} e, sum(a) na, sum(b) nb from seen group by 1)")
        levels.append(f"x{k} as (select substr(e, 1, {k - 1}) x, sum(na) ta, sum(nb) tb, count(*) filter (na > 0) da, count(*) filter (nb > 0) db from c{k} group by 1)")
        levels.append(f"m{k} as (select gram, {smooth('a')}, {smooth('b')} from m{k - 1} join c{k} on e = {end} join x{k} on x = {context})")
    return f"""
with p as (select page_id, coalesce(url, '') url from pages),
r as (select page_id, url, translate(regexp_extract(y, '^([^/?#]*)', 1), '{upper}', '{low}') host, regexp_extract(y, '^[^/?#]*([^?#]*)', 1) path from (select *, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end y from p)),
v as (select *, case {' '.join(f"when {fits(h, q)} then '{h + q}'" for _, h, q in order)} end rule, case {' '.join(f"when {fits(h, q)} then '{w}'" for w, h, q in order)} end ruled from r),
u as (select distinct url, ruled, substr(md5(url), 1, 1) in ('0', '1', '2') aside from v),
g as (select url, ruled, aside, substr(t, i, {DEPTH}) gram from (select *, unnest(range(1, len(t) - {DEPTH - 2})) i from (select *, '{'^' * (DEPTH - 1)}' || regexp_replace(translate(url, '{upper}123456789', '{low}000000000'), '[^a-z0/.\\-?=&#:_%]', '~', 'g') || '$' t from u))),
seen as (select gram, count(*) filter (ruled = 'allow' and not aside) a, count(*) filter (ruled = 'block' and not aside) b from g group by 1),
{', '.join(levels)},
s as (select url, any_value(ruled) ruled, any_value(aside) aside, avg(ln(pa) - ln(pb)) score from g join m{DEPTH} using (gram) group by url),
t as (select coalesce((avg(score) filter (ruled = 'allow') + avg(score) filter (ruled = 'block')) / 2, 0) t from s where aside)
select page_id, host, path, rule, coalesce(v.ruled, case when score >= t then 'allow' else 'block' end) verdict, round(score, 9) score from v join s using (url), t
"""


SQL = _sql()
