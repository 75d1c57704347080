"""Queries over retrieval, graphs, clustering and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import stem
from ..operators import clustering as C
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import vectors as V
from . import fixtures as X
from .fixtures import AS_OF, DIM, TERMS
from .fixtures import literal as q
from .registry import query
from .store_queries import MV
from .text_queries import sanitize_sql

FROM, TO = T.accents()


def knn_sql(k: int, metric: str = "cosine", rows: str = "memories", key: str = "id") -> str:
    s = "list_cosine_similarity(vector, q)" if metric == "cosine" else "list_distance(vector, q) ** 2"
    return f"select {key} id, {s} score from {rows}, qv order by {'-' if metric == 'cosine' else ''}({s}), {key} limit {k}"


def _round(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


@query(f"select id, round(score, 6) score from ({knn_sql(10, 'l2')})", "memories", "qv")
def knn_l2(spark, d):
    return _round(V.knn(X.memories(spark, d), X.query_vector(spark, d), 10, "l2"), "score")


@query(f"select id, round(score, 6) score from ({knn_sql(10)})", "memories", "qv")
def knn_cosine(spark, d):
    return _round(V.knn(X.memories(spark, d), X.query_vector(spark, d), 10), "score")


def words_of(term: str) -> list[str]:
    """Words that have the term's stem: what the SQL has in place of a stemmer."""
    endings = ("", "s", "es", "ed", "ing", "ings", "er", "ers", "ly", "al", "ance", "ence", "able", "ement", "ment", "ent", "ism", "ate", "ous", "ive", "ize", "ness", "ful", "e", "y")
    made = {base + e for base in (term, term + term[-1]) for e in endings}
    return sorted(w for w in made if stem(w) == stem(term))


def bm25_sql(rows: str, terms=TERMS) -> str:
    ts = sorted(terms)
    forms = {t: ", ".join(q(w) for w in words_of(t)) for t in ts}
    idf = [f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6)" for i in range(len(ts))]
    score = " + ".join(f"{idf[i]} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in range(len(ts)))
    return f"""tk as (select id, regexp_extract_all(translate(lower(coalesce(text, '')), {q(FROM)}, {q(TO)}), '[\\p{{L}}\\p{{N}}]+') w from {rows}),
tf as (select id, len(w) l, {', '.join(f"len(list_filter(w, lambda x: x in ({forms[t]})))::double f{i}" for i, t in enumerate(ts))} from tk),
tt as (select count(*) n, avg(l) a, {', '.join(f'count(*) filter (f{i} > 0) d{i}' for i in range(len(ts)))} from tf),
bm as (select id, {score} score from tf, tt where {' and '.join(f'f{i} > 0' for i in range(len(ts)))})"""


@query(f", {bm25_sql('texts')} select id, round(score, 6) score from bm order by bm.score desc, id limit 30", "texts")
def bm25_topk(spark, d):
    return _round(R.bm25(X.texts(spark, d), list(TERMS), 30), "score")


FUSED = f""", {bm25_sql('memories')},
v0 as (select id, 1 / (1 + score) score from ({knn_sql(50, 'l2')})), k0 as (select * from bm order by score desc, id limit 30),
v1 as (select id, case when max(score) over () = min(score) over () then 1.0 else (score - min(score) over ()) / (max(score) over () - min(score) over ()) end v from v0),
k1 as (select id, case when max(score) over () = min(score) over () then 1.0 else (score - min(score) over ()) / (max(score) over () - min(score) over ()) end k from k0),
fused as (select coalesce(v1.id, k1.id) id, 0.5 * coalesce(v, 0) + 0.5 * coalesce(k, 0) score from v1 full join k1 on v1.id = k1.id)
"""


@query(FUSED + "select id, round(v, 6) norm from v1", "memories", "qv")
def minmax_norm(spark, d):
    v = V.knn(X.memories(spark, d), X.query_vector(spark, d), 50, "l2").select("id", (1 / (1 + F.col("score"))).alias("score"))
    return R.minmax(v).select("id", F.round("norm", 6).alias("norm"))


@query(FUSED + "select id, round(score, 6) score from fused", "memories", "qv")
def score_fusion(spark, d):
    m = X.memories(spark, d)
    v = V.knn(m, X.query_vector(spark, d), 50, "l2").select("id", (1 / (1 + F.col("score"))).alias("score"))
    return _round(R.fuse(R.minmax(v), R.minmax(R.bm25(m, list(TERMS), 30))).select("id", "score"), "score")


FLAGS = MV.rstrip() + FUSED.rstrip()


def _final(pool: str) -> str:
    return f""", {pool}, cut as (select * from hits order by score desc, id limit 20),
done as (select id, cut.score combined, cut.score * exp(-0.005 * greatest(0, ({AS_OF} - "timestamp") / 3600)) score from cut join verdicts using (id) where not f)
select (row_number() over (order by score desc, id))::int rank, id, round(combined, 6) combined, round(score, 9) score from (select * from done order by score desc, id limit 10)"""


@query(FLAGS + _final("hits as (select * from fused)"), "memories", "qv")
def hybrid_search(spark, d):
    r = R.hybrid_search(X.memories(spark, d), X.query_vector(spark, d), list(TERMS), AS_OF)
    return r.select("rank", "id", F.round("combined", 6).alias("combined"), F.round("score", 9).alias("score"))


GRAPH = """kept as (select * from fused where score >= 0.3), seeds as (select id from kept order by score desc, id limit 5),
more as (select distinct dst id from edges where src in (select id from seeds) and dst not in (select id from kept)),
grown as (select id, score * 0.9 score from fused join more using (id) where score > 0 order by score desc, id limit 10),
hits as (select * from kept union all select * from grown)"""


@query(FLAGS + _final(GRAPH), "memories", "qv", "edges")
def hybrid_graph(spark, d):
    r = R.hybrid_search(X.memories(spark, d), X.query_vector(spark, d), list(TERMS), AS_OF, min_score=0.3, edges=X.edges(spark, d))
    return r.select("rank", "id", F.round("combined", 6).alias("combined"), F.round("score", 9).alias("score"))


DECAYED = f"exp(-0.005 * greatest(0, ({AS_OF} - \"timestamp\") / 3600))"


@query(f", n as ({knn_sql(30)}), s as (select id, n.score raw, n.score * {DECAYED} score from n join memories using (id)) select (row_number() over (order by score desc, id))::int rank, id, round(raw, 6) raw_score, round(score, 9) score from (select * from s order by score desc, id limit 10)", "memories", "qv")
def vector_search_decay(spark, d):
    r = R.vector_search(X.memories(spark, d), X.query_vector(spark, d), AS_OF)
    return r.select("rank", "id", F.round("raw_score", 6).alias("raw_score"), F.round("score", 9).alias("score"))


@query(f""", s as (select id, list_cosine_similarity(vector, q) raw, list_cosine_similarity(vector, q) * {DECAYED} score from memories, qv),
n as (select s.* from s where id in (select id from ({knn_sql(30)})) order by score desc, id limit 10), seeds as (select id from n order by score desc, id limit 3),
more as (select distinct dst id from edges where src in (select id from seeds) and dst > 0 and dst not in (select id from n) order by id limit 10),
a as (select * from n union all select s.* from s join more using (id))
select (row_number() over (order by score desc, id))::int rank, id, round(raw, 6) raw_score, round(score, 9) score from (select * from a order by score desc, id limit 10)""", "memories", "qv", "edges")
def vector_search_graph(spark, d):
    r = R.vector_search(X.memories(spark, d), X.query_vector(spark, d), AS_OF, edges=X.edges(spark, d))
    return r.select("rank", "id", F.round("raw_score", 6).alias("raw_score"), F.round("score", 9).alias("score"))


RANKED = "select (row_number() over (order by score desc, id))::int rank, id, round(score, 4) score, round(h, 2) age_hours from best"
NOW = 1704240000.0  # 2024-01-03: near the memories, so that decayed scores differ


def _recall_sql(where: str, k: int = 10, threshold: float = 0.01, ending: str = RANKED) -> str:
    clean = sanitize_sql("text")
    from .text_queries import verdicts_sql

    return verdicts_sql("cleaned").replace(", base as", f", cleaned as (select * replace ({clean} as \"text\") from memories), base as", 1).rstrip() + f"""
, n as (select id, list_cosine_similarity(vector, q) * exp(-0.005 * greatest(0, ({NOW} - "timestamp") / 3600)) b from memories, qv where id in (select id from ({knn_sql(15 * k)}))),
top as (select * from n order by b desc, id limit {5 * k}), acc as (select mem_id, count(*) c from access_log group by 1),
s as (select id, ({NOW} - "timestamp") / 3600 h, b, coalesce(importance_score, 0) w, coalesce(c, 0) c from top join verdicts using (id) left join acc on mem_id = id where not f and not regexp_matches("text", {q(T.TAG)}) and {where}),
t as (select id, h, b * exp(-0.01 * h) + case when w > 0 then 0.15 * w * exp(-0.005 * h) else 0 end + 0.05 * ln(1 + c) score from s),
best as (select * from t where score >= {threshold} order by score desc, id limit {k}) {ending}"""


def _recall(spark, d, where=None):
    access = X.access_log(spark, d).groupBy("mem_id").agg(F.count("*").alias("n"))
    r = R.recall(X.memories(spark, d), X.query_vector(spark, d), NOW, access, threshold=0.01, where=where)
    return r.select("rank", "id", F.round("score", 4).alias("score"), F.round("age_hours", 2).alias("age_hours"))


@query(_recall_sql("true"), "memories", "qv", "access_log")
def redshifted_recall(spark, d):
    return _recall(spark, d)


@query(_recall_sql("lang = 'en'"), "memories", "qv", "access_log")
def recall_filtered(spark, d):
    return _recall(spark, d, {"lang": "en"})


@query(f""", f as (select id, score * 1.2 score, 'fast' tier from ({knn_sql(5, rows='(select * from memories where id % 4 = 0)')})), s as (select id, score, 'slow' tier from ({knn_sql(10)}) where id not in (select id from f))
select (row_number() over (order by score desc, id))::int rank, id, round(score, 6) score, tier from (select * from (select * from f union all select * from s) order by score desc, id limit 5)""", "memories", "qv")
def dual_search(spark, d):
    m = X.memories(spark, d)
    fast = m.where("id % 4 = 0").select(F.col("id").alias("memory_id"), "vector")
    r = R.dual_search(fast, m, X.query_vector(spark, d))
    return r.select("rank", "id", F.round("score", 6).alias("score"), "tier")


LINES = """select chr(10) || '[MEM]' || chr(10) || string_agg('[' || round(score, 4)::varchar || '] ' || regexp_replace(substr("text", 1, 200), '\\s+$', ''), chr(10) order by round(score, 4) desc, id) lines
from best join verdicts using (id) where conf < 0.6 and "text" <> '' having count(*) > 0"""


@query(_recall_sql("true", 3, 0.3, LINES), "memories", "qv", "access_log")
def mem_injection(spark, d):
    access = X.access_log(spark, d).groupBy("mem_id").agg(F.count("*").alias("n"))
    return R.recall_injection(X.memories(spark, d), X.query_vector(spark, d), NOW, access)


@query(f"select distinct w term from (select unnest(regexp_extract_all(translate(lower(text), {q(FROM)}, {q(TO)}), '[\\p{{L}}\\p{{N}}]+')) w from memories) where w in ('that', 'and', 'zebra')", "memories")
def token_prefilter(spark, d):
    return R.token_prefilter(X.memories(spark, d), [*TERMS, "zebra"])


WORDS = "select id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{4,}'))) w from memories"


@query(f", t as ({WORDS}), c as (select w, -(row_number() over (order by w)) k from (select distinct w from t)), e as (select id src, k dst, 'contains' \"type\" from t join c using (w) union all select k, id, 'instance' from t join c using (w)) select * from e", "memories")
def concept_edges(spark, d):
    return G.concept_edges(X.memories(spark, d))


LINKS = """, c as (select a.id src, b.id dst, list_cosine_similarity(a.vector, b.vector) s, a."timestamp" - b."timestamp" dt, a.source_file = b.source_file and a.source_file <> '' same from memories a join memories b on a.id <> b.id),
k as (select * from (select *, row_number() over (partition by src order by s desc, dst) r from c) where r <= 16),
w as (select src, dst, s, 0.85 * greatest(0, s) + 0.15 * exp(-dt * dt / (2 * 43200.0 * 43200.0)) + case when same then 0.05 else 0 end weight from k),
links as (select src, dst, round(weight, 3) weight from w where weight > 0.4)
"""


@query(LINKS + "select * from links", "memories")
def link_neighbors_raw(spark, d):
    return G.link_neighbors(X.memories(spark, d), DIM, denoised=False)


@query(None)
def link_neighbors(spark, d):
    return G.link_neighbors(X.memories(spark, d), DIM)


@query("select distinct dst id, 1 depth from edges where src = 3 and dst <> 3", "edges")
def graph_neighbors_d1(spark, d):
    return G.reach(X.edges(spark, d), 3, 1)


@query(", one as (select distinct dst id from edges where src = 3 and dst <> 3), two as (select distinct e.dst id from edges e join one on e.src = one.id where e.dst <> 3 and e.dst not in (select id from one)) select id, 1 depth from one union all select id, 2 from two", "edges")
def graph_neighbors_d2(spark, d):
    return G.reach(X.edges(spark, d), 3, 2)


@query(", p as (select [3, a.dst, b.dst, c.dst] p from edges a join edges b on b.src = a.dst join edges c on c.src = b.dst where a.src = 3 and c.dst = 61) select array_to_string(min(p), '>') path from p having count(*) > 0", "edges")
def graph_path(spark, d):
    return G.path(X.edges(spark, d), 3, 61)


@query(", c as (select a.id src, b.id dst, list_distance(a.vector, b.vector) s from memories a join memories b on a.id <> b.id) select round(avg(s), 6) eps from (select *, row_number() over (partition by src order by s, dst) r from c) where r <= 5", "memories")
def optimal_eps(spark, d):
    return C.optimal_eps(X.memories(spark, d), DIM).select(F.round("eps", 6).alias("eps"))


@query(""", c as materialized (select a.id src, b.id dst from memories a join memories b on a.id <> b.id and list_distance(a.vector, b.vector) <= 1.15),
core as materialized (select src id from c group by 1 having count(*) >= 3), e as materialized (select src, dst from c where src in (from core) and dst in (from core)),
r as (select id, id top from core union select r.id, e.dst from r join e on e.src = r.top), root as materialized (select id, min(top) top from r group by 1),
num as materialized (select id, dense_rank() over (order by top) - 1 label from root),
edge as (select src id, min(dst) core from c where dst in (from core) and src not in (from core) group by 1)
select m.id, coalesce(n.label, x.label, -1)::int label from memories m left join num n using (id) left join edge on edge.id = m.id left join num x on x.id = edge.core""", "memories")
def dbscan(spark, d):
    return C.dbscan(X.memories(spark, d), DIM, 1.15, 4)


@query(None)
def cluster_memories(spark, d):
    return C.cluster_memories(X.memories(spark, d), DIM)


SMALL = "select id, vector, case when id % 97 = 0 then 100 + id % 3 else label end label from memories"


@query(f""", m as ({SMALL}), c as (select label, count(*) n, [{', '.join(f'avg(vector[{i + 1}])' for i in range(64))}] c from m where label <> -1 group by label),
t as (select a.label, arg_max(b.label, (round(list_cosine_similarity(a.c, b.c), 9), -b.label)) dst from c a join c b on a.n < 6 and b.n >= 6 group by 1)
select id, coalesce(dst, m.label)::int label from m left join t on t.label = m.label""", "memories")
def merge_tiny_clusters(spark, d):
    m = X.memories(spark, d)
    m = m.withColumn("label", F.when(F.col("id") % 97 == 0, (100 + F.col("id") % 3).cast("int")).otherwise(F.col("label")))
    return C.merge_tiny(m, DIM)


@query(None)
def denoise(spark, d):
    v = V.denoise(X.memories(spark, d), DIM)
    return v.select("id", F.size("vector").alias("size"), F.round(V.dot(F.col("vector"), F.col("vector")), 4).alias("length"))


@query("""select topic, n, 'Summary based on prompt ''life summary'': ' || substr(s, 1, 200) || '...' summary from (select source_file topic, count(*) n, string_agg(text, ' ' order by id) s from texts group by 1)""", "texts")
def topic_summaries(spark, d):
    return C.topic_summaries(X.texts(spark, d))


@query(None)
def domain_clusters(spark, d):
    return C.domain_clusters(X.texts(spark, d))


RESULTS = """, r as (select id % 20 qid, id, (row_number() over (partition by id % 20 order by relevance desc, id))::int rank from memories),
w as (select distinct doc_id % 20 qid, doc_id id from labels where quality = 1),
t as (select r.*, case when w.id is null then 0 else 1 end hit from r left join w on w.qid = r.qid and w.id = r.id where rank <= 10),
n as (select qid, count(*) wanted from w group by 1),
u as (select *, sum(hit) over (partition by qid order by rank) c from t),
e as (select qid, count(*) retrieved, sum(hit) hits, sum(hit * c / rank) ap, sum(hit / log2(rank + 1)) dcg from u group by qid)
"""


def _evaluated(spark, d):
    from pyspark.sql import Window

    m = X.memories(spark, d).select((F.col("id") % 20).alias("qid"), "id", "relevance")
    r = m.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("relevance"), "id")))
    want = X.read(spark, d, "labels").where("quality = 1").select((F.col("doc_id") % 20).alias("qid"), F.col("doc_id").alias("id"))
    return E.measures(r.select("qid", "id", "rank"), want)


@query(RESULTS + "select qid, retrieved, hits::bigint hits, hits / retrieved \"precision\" from e", "memories")
def eval_precision_at_k(spark, d):
    return _evaluated(spark, d).select("qid", "retrieved", "hits", "precision")


@query(RESULTS + "select qid, round(hits / greatest(coalesce(wanted, 0), 1), 6) recall, round(ap / least(greatest(coalesce(wanted, 0), 1), 10), 6) average_precision, round(dcg / list_sum(list_transform(range(1, greatest(1, least(coalesce(wanted, 0), 10)) + 1), lambda i: 1 / log2(i + 1))), 6) ndcg from e left join n using (qid)", "memories")
def eval_recall_map_ndcg(spark, d):
    return _evaluated(spark, d).select("qid", *[F.round(c, 6).alias(c) for c in ("recall", "average_precision", "ndcg")])
