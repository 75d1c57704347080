"""Ranked retrieval: keyword and vector search, fusion, decay, graph expansion, tiers.

Every search takes ``as_of`` (seconds since 1970); scores tie by id.  Candidate lists are as
long as a request asks for, so what is broadcast does not grow with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import stem
from ..sources.tables import written
from . import vectors as V

HOUR = 3600.0


def hours_since(ts: Column, as_of: float, clamp: bool = True) -> Column:
    h = (F.lit(float(as_of)) - ts) / HOUR
    return F.greatest(F.lit(0.0), h) if clamp else h


def bm25(df: DataFrame, query: list[str], top_k: int | None = None, k1: float = 1.2, b: float = 0.75, match: str = "and", id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, score): BM25 over all rows for those that hold every (``match='or'``: any) query term, best first; terms match by stem.

    Texts are read once: their lengths and term frequencies are written, a few numbers a row.
    """
    wanted = sorted({stem(t.lower()) for t in query})
    counts = df.select(F.col(id_col).alias("id"), T.term_counts(F.col(text_col), wanted).alias("c"))
    tf = written(counts.select("id", F.get("c", F.lit(0)).alias("len"), *[F.get("c", F.lit(i + 1)).alias(f"tf{i}") for i in range(len(wanted))]))
    totals = tf.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    score, hit = F.lit(0.0), F.lit(match == "and")
    for i in range(len(wanted)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        f = F.col(f"tf{i}").cast("double")
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
        hit = hit & (f > 0) if match == "and" else hit | (f > 0)
    rows = tf.join(F.broadcast(totals)).where(hit).select("id", score.alias("score"))
    return rows.orderBy(F.desc("score"), "id").limit(top_k) if top_k else rows


def minmax(df: DataFrame, col: str = "score", out: str = "norm") -> DataFrame:
    """Scores scaled to 0..1 over the list; all equal: 1."""
    ends = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    x = F.col(col)
    scaled = F.when(F.col("__hi") == F.col("__lo"), F.lit(1.0)).otherwise((x - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return df.join(F.broadcast(ends)).withColumn(out, scaled).drop("__lo", "__hi")


def fuse(vector: DataFrame, keyword: DataFrame, alpha: float = 0.5, min_score: float = 0.0) -> DataFrame:
    """(id, score): alpha of the vector norm and the rest of the keyword norm; what is missing counts nothing."""
    v, k = vector.select("id", F.col("norm").alias("v")), keyword.select("id", F.col("norm").alias("k"))
    score = alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("k", F.lit(0.0))
    return v.join(k, "id", "full").select("id", "v", "k", score.alias("score")).where(F.col("score") >= min_score)


def expand(hits: DataFrame, pool: DataFrame, edges: DataFrame, seeds: int, most: int, factor: float = 0.9) -> DataFrame:
    """hits with at most ``most`` neighbours of the best ``seeds``, scored by their own pool score times ``factor``."""
    top = hits.orderBy(F.desc("score"), "id").limit(seeds).select(F.col("id").alias("src"))
    near = edges.select("src", "dst").join(F.broadcast(top), "src").select(F.col("dst").alias("id")).distinct()
    more = near.join(hits.select("id"), "id", "left_anti").join(pool.select("id", "score"), "id").where(F.col("score") > 0)
    more = more.select("id", (F.col("score") * factor).alias("score")).orderBy(F.desc("score"), "id").limit(most)
    return hits.select("id", "score").union(more)


def hybrid_search(memories: DataFrame, query_vector: list[float], query_terms: list[str], as_of: float, top_k: int = 10, alpha: float = 0.5, min_score: float = 0.0, decay: float = 0.005, edges: DataFrame | None = None, filter_unreliable: bool = True, index=None) -> DataFrame:
    """(rank, id, score, combined): vector and keyword candidates, fused, reliable, decayed by age.

    Vector candidates are max(3 top_k, 50), keyword ones 3 top_k, 2 top_k survive fusion;
    unreliable texts go, scores decay by exp(-decay * hours), the top k stay.  Keywords are looked up in
    ``index`` (a ``postings.KeywordIndex`` of the memories) where there is one, else in all texts.
    """
    # candidate lists are as long as the request asks for; written, so that scaling and fusion do not scan the corpus again
    vector = written(V.knn(memories, query_vector, max(3 * top_k, 50), "l2").select("id", (1 / (1 + F.col("score"))).alias("score")))
    keyword = written(bm25(memories, query_terms, 3 * top_k) if index is None else index.search(query_terms, 3 * top_k))
    pool = fuse(minmax(vector), minmax(keyword), alpha, 0.0).select("id", "score")
    hits = pool.where(F.col("score") >= min_score)
    if edges is not None and min_score > 0:
        hits = expand(hits, pool, edges, 5, top_k)
    hits = hits.orderBy(F.desc("score"), "id").limit(2 * top_k)
    rows = memories.select("id", "text", "timestamp").join(F.broadcast(hits), "id")
    # the limit holds the costly test back from the scan: only candidates are judged
    rows = rows.orderBy(F.desc("score"), "id").limit(2 * top_k)
    if filter_unreliable:
        rows = rows.where(~T.verdict(F.col("text"))["is_flagged"])
    rows = rows.select("id", F.col("score").alias("combined"), (F.col("score") * F.exp(-decay * hours_since(F.col("timestamp"), as_of))).alias("score"))
    return ranked(rows, top_k)


def ranked(rows: DataFrame, top_k: int) -> DataFrame:
    """The top k by score, ties by id, with their rank from 1; the window sorts k rows."""
    from pyspark.sql import Window

    top = rows.orderBy(F.desc("score"), "id").limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def vector_search(memories: DataFrame, query_vector: list[float], as_of: float, top_k: int = 10, decay: float = 0.005, edges: DataFrame | None = None) -> DataFrame:
    """(rank, id, score, raw_score): 3k nearest by cosine, decayed by age; with edges, unseen neighbours of the best three join, scored alike."""
    score = lambda rows: rows.select("id", F.col("raw").alias("raw_score"), (F.col("raw") * F.exp(-decay * hours_since(F.col("timestamp"), as_of))).alias("score"))
    near = V.knn(memories, query_vector, 3 * top_k).select("id", F.col("score").alias("raw"))
    hits = score(memories.select("id", "timestamp").join(F.broadcast(near), "id"))
    best = hits.orderBy(F.desc("score"), "id").limit(top_k)
    if edges is None:
        return ranked(hits, top_k)
    seeds = best.orderBy(F.desc("score"), "id").limit(3).select(F.col("id").alias("src"))
    more = edges.select("src", "dst").join(F.broadcast(seeds), "src").where(F.col("dst") > 0).select(F.col("dst").alias("id")).distinct().join(best.select("id"), "id", "left_anti").orderBy("id").limit(top_k)
    found = V.knn(memories.join(F.broadcast(more), "id", "left_semi"), query_vector, top_k).select("id", F.col("score").alias("raw"))
    extra = score(memories.select("id", "timestamp").join(F.broadcast(found), "id"))
    return ranked(best.select("id", "raw_score", "score").union(extra), top_k)


def recall(memories: DataFrame, query_vector: list[float], as_of: float, access: DataFrame, k: int = 10, threshold: float = 0.3, decay: float = 0.01, base_decay: float = 0.005, frequency: float = 0.05, where: dict[str, str] | None = None, terms: list[str] | None = None) -> DataFrame:
    """(rank, id, score, age_hours): vector search of 5k, filtered by metadata, tags and reliability, decayed again, raised by importance and access.

    ``access``: (mem_id, n).  With ``terms``, nothing is searched if no memory holds any of them.  score = s exp(-decay h) + 0.15 importance exp(-decay h / 2) + frequency ln(1 + n), kept from ``threshold`` up.
    """
    if terms and not token_prefilter(memories, terms).limit(1).count():
        memories = memories.limit(0)
    base = written(vector_search(memories, query_vector, as_of, 5 * k, base_decay).select("id", F.col("score").alias("base")))
    rows = memories.join(F.broadcast(base), "id").orderBy(F.desc("base"), "id").limit(5 * k)  # only candidates are judged
    for key, value in (where or {}).items():
        rows = rows.where(F.col(key) == value)
    rows = rows.withColumn("clean", T.sanitize(F.col("text")))
    rows = rows.where(~T.has_tags(F.col("clean")) & ~T.verdict(F.col("clean"))["is_flagged"])
    h = hours_since(F.col("timestamp"), as_of, clamp=False)
    seen = access.select(F.col("mem_id").alias("id"), "n").join(F.broadcast(base.select("id")), "id", "left_semi")  # of the log, candidates alone are shuffled
    rows = rows.join(seen, "id", "left")
    importance = F.coalesce(F.col("importance_score"), F.lit(0.0))
    score = F.col("base") * F.exp(-decay * h) + F.when(importance > 0, 0.15 * importance * F.exp(-0.5 * decay * h)).otherwise(0.0) + frequency * F.log1p(F.coalesce("n", F.lit(0)))
    return ranked(rows.select("id", score.alias("score"), h.alias("age_hours")).where(F.col("score") >= threshold), k)


def recorded(found: DataFrame, query: str, as_of: float) -> DataFrame:
    """(mem_id, ts, query): the accesses that a recall makes, for the access log."""
    return found.select(F.col("id").alias("mem_id"), F.lit(float(as_of)).alias("ts"), F.lit(query).alias("query"))


def dual_search(fast: DataFrame, slow: DataFrame, query_vector: list[float], k_fast: int = 5, k_slow: int = 5, boost: float = 1.2, as_of: float | None = None) -> DataFrame:
    """(rank, id, score, tier): the best of the fast tier, raised by ``boost``, and of the slow one, each memory once; ``as_of`` leaves out what has expired."""
    live = fast if as_of is None else fast.where(F.col("expires_at") >= as_of)
    a = V.knn(live, query_vector, k_fast, id_col="memory_id").select("id", (F.col("score") * boost).alias("score"), F.lit("fast").alias("tier"))
    b = V.knn(slow, query_vector, 2 * k_slow).join(F.broadcast(a.select("id")), "id", "left_anti").select("id", "score", F.lit("slow").alias("tier"))
    return ranked(a.union(b), max(k_fast, k_slow))


def injection(rows: DataFrame, width: int = 200) -> DataFrame:
    """(lines): one text of ``[score] text`` lines in order of score, for a prompt."""
    line = F.format_string("[%.2f] %s", F.col("score"), F.rtrim(F.substring("text", 1, width)))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", line.alias("line"))))
    return rows.agg(F.concat(F.lit("\n[MEM]\n"), F.array_join(F.transform(order, lambda x: x["line"]), "\n")).alias("lines"))


def recall_injection(memories: DataFrame, query_vector: list[float], as_of: float, access: DataFrame, k: int = 3, threshold: float = 0.3, doubt: float = 0.6, width: int = 200) -> DataFrame:
    """(lines): ``[score] text`` lines of the k best recalled memories, for a prompt; texts that are unreliable by ``doubt`` or more are left out.  No row without a line."""
    found = recall(memories, query_vector, as_of, access, k, threshold).select("id", F.round("score", 4).alias("score"))
    rows = memories.select("id", T.sanitize(F.col("text")).alias("text")).join(F.broadcast(found), "id").orderBy(F.desc("score"), "id").limit(k)  # only candidates are judged
    rows = rows.where((F.col("text") != "") & (T.verdict(F.col("text"))["confidence"] < doubt))
    line = F.concat(F.lit("["), F.col("score").cast("string"), F.lit("] "), F.regexp_replace(F.substring("text", 1, width), T.like_python(r"\s+$"), ""))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", line.alias("line"))))
    return rows.agg(order.alias("o")).where(F.size("o") > 0).select(F.concat(F.lit("\n[MEM]\n"), F.array_join(F.transform("o", lambda x: x["line"]), "\n")).alias("lines"))


def last_user_message(turns: DataFrame) -> DataFrame:
    """(conv_id, text): each conversation's last user turn, without platform prefix; ``text`` is a string, or a list of parts (type, text), whose texts are joined by blanks."""
    if dict(turns.dtypes)["text"].startswith("array"):
        parts = F.filter("text", lambda p: (p["type"] == "text") & p["text"].isNotNull())
        turns = turns.withColumn("text", F.array_join(F.transform(parts, lambda p: p["text"]), " "))
    return turns.where(F.col("role") == "user").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text")).withColumn("text", T.strip_meta(F.col("text")))


def token_prefilter(memories: DataFrame, query_terms: list[str]) -> DataFrame:
    """(term): the query terms that some memory holds; none means nothing can be found.  ``KeywordIndex.known`` asks an index for stems instead."""
    return memories.select(F.explode(T.terms(F.col("text"))).alias("term")).where(F.col("term").isin([t.lower() for t in query_terms])).distinct()
