"""Queries over scans, writes, maintenance, triples, tiers, access and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kg as K
from ..operators import maintenance as M
from ..operators import tiering as B
from ..operators import vectors as V
from ..sources import tables as S
from . import fixtures as X
from .fixtures import AS_OF, DIM
from .fixtures import literal as q
from .registry import query
from .text_queries import ENTITY_SQL, QUESTIONS_SQL, verdicts_sql

MV = verdicts_sql("memories")


@query('select id, source_file, "timestamp", relevance from memories order by id', "memories")
def scan_memories(spark, d):
    return S.scan(X.memories(spark, d), "id", "source_file", "timestamp", "relevance")


@query("select id, relevance from memories where not merged", "memories")
def active_memories(spark, d):
    return S.active(X.memories(spark, d)).select("id", "relevance")


@query('select id, source_file, "timestamp" from memories order by id limit 5000', "memories")
def list_by_age(spark, d):
    return X.memories(spark, d).select("id", "source_file", "timestamp").orderBy("id").limit(5000)


@query('select id, coalesce(text, \'\') "text", source_file from memories order by id limit 10000', "memories")
def list_with_text(spark, d):
    return S.listing(X.memories(spark, d))


@query("select id, source_file, (select count(*) from memories) total from memories order by id limit 20 offset 40", "memories")
def list_page(spark, d):
    return S.page(X.memories(spark, d).select("id", "source_file"), 40, 20)


@query("select id, round(list_dot_product(n, n), 6) length, round(n[1], 6) first from (select id, list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector))) n from memories)", "memories")
def normalize_vectors(spark, d):
    v = V.normalize_vectors(X.memories(spark, d), DIM)
    return v.select("id", F.round(V.dot(F.col("vector"), F.col("vector")), 6).alias("length"), F.round(F.get("vector", F.lit(0)), 6).alias("first"))


@query("select trim(c_name) subject, 'lives_in' predicate, trim(n_name) \"object\", case when c_custkey % 3 = 0 then 'other' else 'person' end subject_type, 'other' object_type, '' source_file, case when c_custkey % 4 = 0 then 1.0 else c_custkey % 10 / 10.0 end confidence from customer join nation on c_nationkey = n_nationkey where c_custkey % 7 <> 0")
def kg_import_validate(spark, d):
    c, n = X.read(spark, d, "customer"), X.read(spark, d, "nation")
    k = F.col("c_custkey")
    raw = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name")).alias("subject"), F.lit("lives_in ").alias("predicate"), F.col("n_name").alias("object"), F.when(k % 3 == 0, "").otherwise(" person").alias("subject_type"),
        F.lit(None).cast("string").alias("object_type"), F.lit(None).cast("string").alias("source_file"), F.when(k % 4 == 0, "high").otherwise((k % 10 / 10.0).cast("string")).alias("confidence"),
    )
    return S.valid_triples(raw)


@query(f"select id, coalesce(m, 0) = 1 is_new, {AS_OF} archived_at from (select id, 1 m from memories where merged union all select 1000000 + id, 0 from memories where id % 50 = 0)", "memories")
def archive_merged(spark, d):
    m = X.memories(spark, d)
    old = m.where("id % 50 = 0").withColumn("id", F.col("id") + 1000000).unionByName(m.where("merged")).withColumn("archived_at", F.lit(AS_OF))
    _, kept = M.archive(m, old, AS_OF)
    return kept.select("id", (F.col("id") < 1000000).alias("is_new"), "archived_at")


@query("select id, min(id) over (partition by text) canonical_id from texts", "texts")
def dedup_exact(spark, d):
    return M.exact_canonical(X.texts(spark, d))


@query("select sha256(text) content_hash, min(id) id from texts group by text", "texts")
def dedup_hash(spark, d):
    return M.hash_dedup(X.texts(spark, d))


def greedy_sql(rows: str, limit: float) -> str:
    """CTEs that end in ``greedy`` (id, kept, duplicate_of): rows in order of id, by recursion over the list of those kept."""
    return f"""n as (select id, vector, row_number() over (order by id) i from {rows}),
p as materialized (select a.i, b.i j, a.id, b.id jd, list_distance(a.vector, b.vector) ** 2 s from n a join n b on b.i < a.i and list_distance(a.vector, b.vector) ** 2 < {limit}),
l as materialized (select n.i, coalesce(list(p.j) filter (p.j is not null), []) js from n left join p using (i) group by 1),
g as (select 0::bigint i, []::bigint[] kept union all select g.i + 1, case when list_has_any(kept, js) then kept else list_append(kept, g.i + 1) end from g join l on l.i = g.i + 1),
k as (select unnest(kept) i from (select kept from g order by i desc limit 1)),
greedy as (select n.id, n.i in (from k) kept, d duplicate_of from n left join (select p.id, arg_min(jd, (s, jd)) d from p where j in (from k) group by 1) q on q.id = n.id and n.i not in (from k))
"""


@query(", " + greedy_sql("memories", 1.25) + "select * from greedy", "memories")
def dedup_semantic(spark, d):
    return M.semantic_dedup(X.memories(spark, d), DIM, 1.25)


ADDED = MV.rstrip() + ", good as (select id, text, vector from verdicts where not f), canon as (select id, min(id) over (partition by text) c from good), firsts as (select id, vector from good join canon using (id) where id = c),\n" + greedy_sql("firsts", 1.25).rstrip() + """,
made as (select v.id, case when f then -1 else coalesce(duplicate_of, c) end result_id, case when f then 'unreliable' when c <> v.id then 'exact' when duplicate_of is not null then 'semantic' else 'added' end reason from verdicts v left join canon using (id) left join greedy on greedy.id = c)
"""


@query(ADDED + "select * from made", "memories")
def add_memory_decision(spark, d):
    return M.add_decision(X.memories(spark, d), DIM, 1.25)


@query(ADDED + "select id, result_id from made", "memories")
def batch_add_ids(spark, d):
    return M.add_decision(X.memories(spark, d), DIM, 1.25).select("id", "result_id")


@query("select id, case when id % 4 = 1 then 0.25 else relevance end relevance from memories", "memories")
def update_relevance(spark, d):
    m = X.memories(spark, d).select("id", "relevance")
    return M.update_values(m, m.where("id % 4 = 1").select("id", F.lit(0.25).alias("value")), "relevance")


@query("select id from memories where id % 4 <> 1", "memories")
def delete_ids(spark, d):
    m = X.memories(spark, d)
    return M.delete_ids(m, m.where("id % 4 = 1").select("id")).select("id")


@query("select id, access_counter + coalesce(n, 0) access_counter from memories left join (select mem_id, count(*) n from access_log group by 1) on mem_id = id", "memories", "access_log")
def bump_access(spark, d):
    return M.bump_access(X.memories(spark, d).select("id", "access_counter"), X.access_log(spark, d))


@query(f"""select id from memories where not merged and ("timestamp" < {AS_OF} - 29.3 * 86400 or relevance * exp(-0.02 * ({AS_OF} - "timestamp") / 86400) < 0.3)""", "memories")
def prune(spark, d):
    return M.prune(X.memories(spark, d), AS_OF, max_age_days=29.3, decay=0.02).select("id")


@query("select id from memories order by id limit greatest(0, (select count(*) from memories) - 150)", "memories")
def prune_overflow(spark, d):
    return M.overflow(X.memories(spark, d).select("id"), 150)


@query('select count(*) total, count(*) filter (not merged) active, count(*) filter (merged) merged, coalesce(avg(relevance) filter (not merged), 0) avg_relevance, min("timestamp") filter (not merged) oldest, max("timestamp") filter (not merged) newest from memories', "memories")
def memory_stats(spark, d):
    return M.stats(X.memories(spark, d))


@query(f"select (select count(*) from memories) n, (select round(({AS_OF} - avg(\"timestamp\")) / 3600, 2) from memories where \"timestamp\" > 0) avg_age_hours, count(distinct mem_id) tracked, count(*) accesses, 'active' status from access_log", "memories", "access_log")
def holo_stats(spark, d):
    return M.holo_stats(X.memories(spark, d), X.access_log(spark, d), AS_OF)


@query("""select mem_id, n, first, last, string_agg(query, '|' order by r desc) queries from (select mem_id, substr(query, 1, 120) query, row_number() over (partition by mem_id order by ts desc, query desc) r, count(*) over (partition by mem_id) n, min(ts) over (partition by mem_id) "first", max(ts) over (partition by mem_id) "last" from access_log) where r <= 10 group by mem_id, n, first, last""", "access_log")
def access_stats(spark, d):
    return M.access_stats(X.access_log(spark, d))


@query("select count(*) accesses, count(distinct mem_id) tracked from access_log", "access_log")
def access_totals(spark, d):
    return X.access_log(spark, d).agg(F.count("*").alias("accesses"), F.countDistinct("mem_id").alias("tracked"))


@query("select mem_id, count(*) n from access_log group by 1 order by n desc, mem_id limit 10", "access_log")
def most_accessed(spark, d):
    return M.most_accessed(X.access_log(spark, d))


@query("""select label, n "size", summary, first from (select label, count(*) n, round(avg(vector[1]), 6) first from memories where not merged group by label) join (select label, string_agg(s, '; ' order by id) summary from (select label, id, substr(split_part(text, '. ', 1), 1, 100) s, row_number() over (partition by label order by id) r from memories where not merged) where r <= 5 group by label) using (label) where n >= 2""", "memories")
def consolidate(spark, d):
    return M.consolidate(X.memories(spark, d), DIM).select("label", "size", "summary", F.round(F.get("centroid", F.lit(0)), 6).alias("first"))


TYPE = lambda c: ENTITY_SQL.replace("name", c)
KG = f", kg as (select subject, predicate, object, {TYPE('subject')} subject_type, {TYPE('object')} object_type, arg_min(confidence, seq) confidence, min(seq) seq from triples group by subject, predicate, object)\n"


def _kg(spark, d):
    return K.insert_ignore(X.triples(spark, d))


@query(KG + "select subject, predicate, \"object\", subject_type, object_type, confidence, seq from kg", "triples")
def triples_insert_ignore(spark, d):
    return _kg(spark, d).select("subject", "predicate", "object", "subject_type", "object_type", "confidence", "seq")


@query("select arg_min(subject, seq) subject, arg_min(predicate, seq) predicate, arg_min(object, seq) \"object\", min(seq) seq from triples group by lower(subject), lower(predicate), lower(object)", "triples")
def kg_dedup(spark, d):
    return K.dedup(X.triples(spark, d)).select("subject", "predicate", "object", "seq")


def _found(where: str, most: int) -> str:
    return KG + f'select subject, predicate, "object", confidence from kg where {where} order by confidence desc, subject, predicate, object limit {most}'


OUT = ("subject", "predicate", "object", "confidence")


@query(_found("predicate = 'located_in' and object = 'ASIA'", 100), "triples")
def kg_query(spark, d):
    return K.query(_kg(spark, d), predicate="located_in", object="ASIA").select(*OUT)


@query(_found("subject = 'NATION_3' or object = 'NATION_3'", 50), "triples")
def kg_by_entity(spark, d):
    return K.by_entity(_kg(spark, d), "NATION_3").select(*OUT)


@query(_found("subject_type = 'other'", 100), "triples")
def kg_by_type(spark, d):
    return K.query(_kg(spark, d), subject_type="other").select(*OUT)


@query(_found("predicate = 'based_in'", 100), "triples")
def kg_by_predicate(spark, d):
    return K.query(_kg(spark, d), predicate="based_in").select(*OUT)


@query(_found("subject ilike '%tion_1%' or predicate ilike '%tion_1%' or object ilike '%tion_1%'", 50), "triples")
def kg_keyword(spark, d):
    return K.by_keyword(_kg(spark, d), "tion_1").select(*OUT)


@query(KG + "select distinct case when subject = 'NATION_3' then object else subject end entity from kg where 'NATION_3' in (subject, object)", "triples")
def kg_related(spark, d):
    return K.related(_kg(spark, d), "NATION_3")


@query("select distinct subject, predicate, object from triples where predicate = 'follows' and object = 'x'", "triples")
def kg_relational(spark, d):
    return K.relational(_kg(spark, d), "What agents are following X?").select("subject", "predicate", "object")


@query(KG + "select subject_type \"name\", count(*) n from kg group by 1", "triples")
def kg_stats_subject(spark, d):
    return K.counts(_kg(spark, d), "subject_type")


@query(KG + "select object_type \"name\", count(*) n from kg group by 1", "triples")
def kg_stats_object(spark, d):
    return K.counts(_kg(spark, d), "object_type")


@query(KG + "select predicate \"name\", count(*) n from kg group by 1 order by n desc, 1 limit 20", "triples")
def kg_top_predicates(spark, d):
    return K.counts(_kg(spark, d), "predicate", 20)


def _service_triples(spark, d):
    """Triples about entities that questions name: documents' sources use a service each."""
    t = X.texts(spark, d)
    service = F.element_at(F.array(*[F.lit(x) for x in ("redis", "postgres", "run_all.py", "web-search")]), (F.col("id") % 4 + 1).cast("int"))
    return t.select("source_file", service.alias("object"), (0.5 + F.col("id") % 5 / 10.0).alias("confidence")).groupBy("source_file", "object").agg(F.max("confidence").alias("confidence")).select(F.col("source_file").alias("subject"), F.lit("uses").alias("predicate"), "object", "confidence")


ST = ", st as (select source_file subject, 'uses' predicate, ['redis', 'postgres', 'run_all.py', 'web-search'][id % 4 + 1] object, max(0.5 + id % 5 / 10.0) confidence from texts group by 1, 2, 3),\n"
ASK = f"asked as (select id qid, {QUESTIONS_SQL} e from texts)\n"
CTX = ST + ASK.rstrip() + ", named as (select distinct qid, unnest(e[1:5]) e from asked), met as (select distinct qid, subject, predicate, object, confidence from named join st on e in (subject, object)), ranked as (select *, row_number() over (partition by qid order by confidence desc, subject, predicate, object) r from met)\n"


@query(CTX + 'select qid, subject, predicate, "object", confidence from ranked where r <= 10', "texts")
def kg_context(spark, d):
    return K.context(_service_triples(spark, d), X.texts(spark, d).select(F.col("id").alias("qid"), "text"))


@query(CTX + "select qid, string_agg('- ' || subject || ' → ' || predicate || ' → ' || object, chr(10) order by r) lines from ranked where r <= 8 group by qid", "texts")
def search_kg_context(spark, d):
    return K.context_lines(K.context(_service_triples(spark, d), X.texts(spark, d).select(F.col("id").alias("qid"), "text")))


@query(ST + ASK.rstrip() + """, named as (select qid, p, e[p] e from asked, (values (1), (2), (3)) t(p) where p <= len(e)),
two as (select * from (select qid, p, e, subject, object, row_number() over (partition by qid, p order by confidence desc, subject, predicate, object) r from named join st on e in (subject, object)) where r <= 2),
every as (select qid, p, r, 0 s, 'What is ' || subject || '?' x from two where subject <> e union all select qid, p, r, 1, 'How does ' || object || ' work?' from two where object <> e)
select qid, n::int n, x suggestion from (select qid, x, row_number() over (partition by qid order by p, r, s) n from every) where n <= 3""", "texts")
def kg_suggest(spark, d):
    return K.suggest(_service_triples(spark, d), X.texts(spark, d).select(F.col("id").alias("qid"), "text"))


def _fast(spark, d):
    return B.fast_add(X.memories(spark, d).where("id % 4 = 0"), 0.0).join(X.memories(spark, d).select(F.col("id").alias("memory_id"), F.col("timestamp").alias("t")), "memory_id").withColumn("expires_at", F.col("t") + 86400 * 29.5).drop("t")


@query(f'select id memory_id, round(list_dot_product(vector, vector), 6) > 0 has_vector, {AS_OF}::double "timestamp", {AS_OF + 86400}::double expires_at, coalesce(importance_score, 1.0) importance from memories', "memories")
def fast_add(spark, d):
    f = B.fast_add(X.memories(spark, d), AS_OF)
    return f.select("memory_id", (F.size("vector") == DIM).alias("has_vector"), "timestamp", "expires_at", "importance")


@query(f'select id memory_id from memories where id % 4 = 0 and "timestamp" + 86400 * 29.5 >= {AS_OF}', "memories")
def evict_expired(spark, d):
    return B.evict_expired(_fast(spark, d), AS_OF).select("memory_id")


@query(f"select id memory_id, least(5.0, 1 + access_counter / 100) importance, {AS_OF + 48 * 3600}::double expires_at from memories where access_counter > 100 and id % 4 <> 0", "memories")
def promote_hot(spark, d):
    return B.promote_hot(X.memories(spark, d), _fast(spark, d), AS_OF)


@query('select id, "text" from memories where id % 3 <> 0 or id % 4 = 0', "memories")
def fast_flush(spark, d):
    m = X.memories(spark, d)
    return B.flush(_fast(spark, d), m.where("id % 3 <> 0"), 10)


@query(None)
def bloom_prefilter(spark, d):
    m = X.memories(spark, d).select("id", "source_file")
    return B.bloom_prefilter(m, m.where("id % 4 = 0"), 1000)


@query("select item_id, sha256(text) digest from benchmark")
def embed_fallback(spark, d):
    b = X.read(spark, d, "benchmark").select("item_id", "text")
    made = V.embed(b, DIM).select("item_id", "text", "vector")
    again = V.embed(b, DIM).select("item_id", F.col("vector").alias("v"))  # of the text alone, so a second run agrees
    same = (F.size("vector") == DIM) & (F.col("vector") == F.col("v")) & (F.exists("vector", lambda x: x != 0) == (F.trim("text") != ""))
    return made.join(again, "item_id").where(same).select("item_id", F.sha2("text", 256).alias("digest"))


@query(MV + f"select count(*) flagged from verdicts where f and {q('x')} = 'x'", "memories")
def flagged_memories(spark, d):
    from ..functions import text as T

    return X.memories(spark, d).where(T.verdict(F.col("text"))["is_flagged"]).agg(F.count("*").alias("flagged"))
