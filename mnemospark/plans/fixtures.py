"""Views over the test tables for the queries, and the same views as SQL for their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = 1706659200.0  # 2024-01-31 00:00:00 UTC
DIM = 64
TERMS = ("that", "and")

#: Text put before and after a memory's by id % 20, so that rules have something to find.
AROUND: dict[int, tuple[str, str]] = {
    0: ("", " The service crashed during deployment."),
    1: ("", " This method is deprecated."),
    2: ("", " I tried deploying but it failed again."),
    3: ("[Telegram A B id:5381354945 +1m 2026-02-02 09:16 GMT+2] ", ""),
    4: ("", " <result>x</result>"),
    5: ("", "\n\n# Heading\n\nSee tools/run_all.py and skills/web-search/ for redis."),
    6: ("", " fastfetch"),
    7: ("# Session: 2026-01-05 10:00\n- **Session Key**: abc\n- **Session ID**: 17\n\n## Conversation Summary\n\nuser: hello there\nassistant: it is broken\nsecond line\nuser: thanks\n", ""),
    8: ("", "\n- [x] Write the report\nadded retry logic to gateway\nThe poller depends on redis, always\nDashboard uses postgres, daily\n"),
    9: ("[2026-01-02 10:00] first note here\n[2026-01-03 11:00] second note here\n", ""),
    10: ("## Tool: Web Poller (beta)\nruns `poll.py` with redis\n| fetch | gets pages |\n## Conversation Summary\nfixed the timeout in poller\n## End\n", ""),
    11: ("user: [Discord x y]\nuser:\n", " id:1234567 +9h 2026-02-02 09:16 GMT+2"),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decorated(key, text):
    out = text
    for k, (a, b) in AROUND.items():
        out = F.when(key % 20 == k, F.concat(F.lit(a), text, F.lit(b))).otherwise(out)
    return out


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d, v = (read(spark, sf_dir, t) for t in ("embeddings", "documents", "events"))
    # what lies outside of the vectors' ids goes before it is shuffled: most texts do
    first, last = e.agg(F.min("vec_id")).scalar(), e.agg(F.max("vec_id")).scalar()
    d, v = d.where(d.doc_id.between(first, last)), v.where(v.event_id.between(first, last))
    rows = e.join(d, e.vec_id == d.doc_id).join(v, e.vec_id == v.event_id)
    i = F.col("vec_id")
    return rows.select(
        i.alias("id"), F.col("embedding").alias("vector"), decorated(i, F.col("text")).alias("text"), F.col("source").alias("source_file"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("timestamp"),
        ((i * 7 % 10 + 1) / 10.0).alias("relevance"), (i % 11 == 0).alias("merged"), F.when(i % 3 == 0, F.col("value") / 1000).alias("importance_score"), (i * 13 % 250).alias("access_counter"), F.col("label"), F.col("lang"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as (id, text, source_file), decorated."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), decorated(F.col("doc_id"), F.col("text")).alias("text"), F.col("source").alias("source_file"))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(read(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("mem_id"), F.col("event_type").alias("query"), "ts", "event_id")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, subject, predicate, object, subject_type, object_type, source_file, confidence) of the star schema; some twice, in other case."""
    c, s, n, r = (read(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region"))
    n2 = n.select("n_nationkey", "n_name", "n_regionkey")

    def made(rows, key, subject, predicate, obj, offset):
        null = F.lit(None).cast("string")
        return rows.select((F.lit(offset) + key).cast("long").alias("seq"), subject.alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"), null.alias("subject_type"), null.alias("object_type"), F.lit("star").alias("source_file"), (0.5 + (key % 5) / 10.0).alias("confidence"))

    lives = made(c.join(n2, c.c_nationkey == n2.n_nationkey), F.col("c_custkey"), F.col("c_name"), "lives_in", F.col("n_name"), 1_000_000)
    based = made(s.join(n2, s.s_nationkey == n2.n_nationkey), F.col("s_suppkey"), F.col("s_name"), "based_in", F.col("n_name"), 2_000_000)
    located = made(n2.join(r, n2.n_regionkey == r.r_regionkey), F.col("n_nationkey"), F.col("n_name"), "located_in", F.col("r_name"), 3_000_000)
    again = made(n2.join(r, n2.n_regionkey == r.r_regionkey), F.col("n_nationkey"), F.lower("n_name"), "located_in", F.lower("r_name"), 4_000_000)
    twice = made(n2.join(r, n2.n_regionkey == r.r_regionkey), F.col("n_nationkey"), F.col("n_name"), "located_in", F.col("r_name"), 5_000_000)
    return lives.union(based).union(located).union(again).union(twice)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring with chords over the memories' ids: (src, dst)."""
    i = memories(spark, sf_dir).select("id")
    n = i.agg(F.count("*").alias("n"))
    rows = i.join(F.broadcast(n))
    step = lambda k: rows.select(F.col("id").alias("src"), ((F.col("id") + k) % F.col("n")).alias("dst"))
    return step(1).union(step(7)).union(step(50))


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def decorated_sql(key: str, text: str) -> str:
    cases = " ".join(f"when {key} % 20 = {k} then {literal(a)} || {text} || {literal(b)}" for k, (a, b) in AROUND.items())
    return f"case {cases} else {text} end"


VIEWS = {
    "memories": f"""select vec_id id, embedding::double[] vector, {decorated_sql('vec_id', 'text')} "text", source source_file, floor(epoch(ts)) "timestamp", (vec_id * 7 % 10 + 1) / 10.0 relevance,
  vec_id % 11 = 0 merged, case when vec_id % 3 = 0 then value / 1000 end importance_score, vec_id * 13 % 250 access_counter, label, lang
  from embeddings join documents on doc_id = vec_id join events on event_id = vec_id""",
    "texts": f"""select doc_id id, {decorated_sql('doc_id', 'text')} "text", source source_file from documents""",
    "qv": "select embedding::double[] q from embeddings where vec_id = 0",
    "access_log": "select user_id mem_id, event_type query, ts, event_id from events",
    "triples": """select 1000000 + c_custkey seq, c_name subject, 'lives_in' predicate, n_name object, 0.5 + (c_custkey % 5) / 10.0 confidence from customer join nation on c_nationkey = n_nationkey
  union all select 2000000 + s_suppkey, s_name, 'based_in', n_name, 0.5 + (s_suppkey % 5) / 10.0 from supplier join nation on s_nationkey = n_nationkey
  union all select o + n_nationkey, case when o = 4000000 then lower(n_name) else n_name end, 'located_in', case when o = 4000000 then lower(r_name) else r_name end, 0.5 + (n_nationkey % 5) / 10.0 from nation join region on n_regionkey = r_regionkey, (values (3000000), (4000000), (5000000)) t(o)""",
    "edges": "select id src, (id + k) % (select count(*) from memories) dst from memories, (values (1), (7), (50)) t(k)",
}
NEEDS = {"edges": ("memories",)}


def with_views(sql: str, *names: str) -> str:
    wanted = [v for n in names for v in (*NEEDS.get(n, ()), n)]
    head = ",\n".join(f"{v} as ({VIEWS[v]})" for v in dict.fromkeys(wanted))
    glue = ",\n" if sql.lstrip().startswith(",") else "\n"
    return f"with recursive {head}{glue}{sql.lstrip().removeprefix(',')}"
