"""Triples: store queries, context for questions, extraction from markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import written
from ..sources.versions import Table
from .graph import first_edges, reached
from .maintenance import equals_all


def best(rows: DataFrame, most: int) -> DataFrame:
    return rows.orderBy(F.desc("confidence"), "subject", "predicate", "object").limit(most)


def insert_ignore(triples: DataFrame) -> DataFrame:
    """Triples with their types inferred where missing, the first of each subject, predicate and object."""
    typed = triples.withColumn("subject_type", F.coalesce("subject_type", T.entity_type(F.col("subject")))).withColumn("object_type", F.coalesce("object_type", T.entity_type(F.col("object"))))
    return first_edges(typed, "subject", "predicate", "object")


def dedup(triples: DataFrame) -> DataFrame:
    """The first of each subject, predicate and object, whatever their case."""
    keyed = triples.select("*", *[F.lower(c).alias(f"__{c}") for c in ("subject", "predicate", "object")])
    return first_edges(keyed, "__subject", "__predicate", "__object").drop("__subject", "__predicate", "__object")


def _keyed(triples: DataFrame) -> DataFrame:
    return insert_ignore(triples).withColumn("key", F.to_json(F.array("subject", "predicate", "object")))


def create_store(triples: DataFrame, folder: str, buckets: int = 16) -> Table:
    """Triples (with seq) as a table of versions: the first of each."""
    return Table.create(_keyed(triples), folder, "key", buckets)


def refresh(store: Table, triples: DataFrame) -> Table:
    """All triples of the store deleted and these inserted, the first of each, in one commit: no reader sees a part of it."""
    return store.overwrite(_keyed(triples))


def query(triples: DataFrame, most: int = 100, **values: str | None) -> DataFrame:
    return best(triples.where(equals_all(**values)), most)


def by_entity(triples: DataFrame, name: str, most: int = 50, ignore_case: bool = False) -> DataFrame:
    same = (lambda c: F.lower(c) == name.lower()) if ignore_case else (lambda c: F.col(c) == name)
    return best(triples.where(same("subject") | same("object")), most)


def by_keyword(triples: DataFrame, word: str, most: int = 50) -> DataFrame:
    """Triples with a part like ``%word%``, whatever its case; % and _ in the word stand for anything."""
    p = f"%{word}%"
    return best(triples.where(F.col("subject").ilike(p) | F.col("predicate").ilike(p) | F.col("object").ilike(p)), most)


def related(triples: DataFrame, name: str, depth: int = 1) -> DataFrame:
    """(entity): what is linked with a name, in either direction, within ``depth`` steps."""
    both = triples.select(F.col("subject").alias("src"), F.col("object").alias("dst")).union(triples.select("object", "subject"))
    return reached(both, triples.sparkSession.createDataFrame([(name,)], "id string"), depth).where(F.col("depth") > 0).select(F.col("id").alias("entity"))


def relational(triples: DataFrame, question: str) -> DataFrame:
    """Triples for a question like ``who is following X?``; none for other questions."""
    _, found, target = question.lower().partition("following")
    return triples.where((F.col("predicate") == "follows") & (F.col("object") == target.strip().strip("?")) if found else F.lit(False))


def counts(triples: DataFrame, col: str, most: int | None = None) -> DataFrame:
    rows = triples.groupBy(F.col(col).alias("name")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "name").limit(most) if most else rows


def context(triples: DataFrame, questions: DataFrame, most_entities: int = 5, most: int = 10) -> DataFrame:
    """(qid, subject, predicate, object, confidence): for each question (qid, text) the best triples of its first entities."""
    names = written(questions.select("qid", F.explode(F.slice(T.question_entities(F.col("text")), 1, most_entities)).alias("e")))
    met = _best_of(triples, names, most, distinct=True).join(names, "e").groupBy("qid", "subject", "predicate", "object").agg(F.max("confidence").alias("confidence"))
    w = Window.partitionBy("qid").orderBy(F.desc("confidence"), "subject", "predicate", "object")
    return met.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def _best_of(triples: DataFrame, names: DataFrame, most: int, distinct: bool = False) -> DataFrame:
    """The ``most`` best triples of each named entity e: no question needs more of one, so a name that many ask for and a name that many triples have never meet in full."""
    asked = names.select("e").distinct()
    rows = triples.select("subject", "predicate", "object", "confidence", F.explode(F.array_distinct(F.array("subject", "object"))).alias("e")).join(asked, "e", "left_semi")
    if distinct:
        rows = rows.groupBy("e", "subject", "predicate", "object").agg(F.max("confidence").alias("confidence"))
    w = Window.partitionBy("e").orderBy(F.desc("confidence"), "subject", "predicate", "object")
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def context_summary(found: DataFrame) -> DataFrame:
    """(qid, summary): ``Types: a(n), b(n); Relations: c(n)`` of context with types, most frequent first."""

    def told(col: Column, label: str) -> DataFrame:
        n = found.select("qid", col.alias("x")).where("x is not null").groupBy("qid", "x").agg(F.count("*").alias("n"))
        parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.concat("x", F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("t"))))
        return n.groupBy("qid").agg(F.concat(F.lit(f"{label}: "), F.array_join(F.transform(parts, lambda p: p["t"]), ", ")).alias(label))

    types = told(F.explode(F.array(T.entity_type(F.col("subject")), T.entity_type(F.col("object")))), "Types")
    return types.join(told(F.col("predicate"), "Relations"), "qid", "full").select("qid", F.concat_ws("; ", "Types", "Relations").alias("summary"))


def context_lines(found: DataFrame, most: int = 8) -> DataFrame:
    """(qid, lines): context as lines of a prompt."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "subject", "predicate", "object")))
    line = lambda x: F.concat(F.lit("- "), x["subject"], F.lit(" → "), x["predicate"], F.lit(" → "), x["object"])
    return found.groupBy("qid").agg(F.array_join(F.transform(F.slice(order, 1, most), line), "\n").alias("lines"))


def suggest(triples: DataFrame, questions: DataFrame, most: int = 3) -> DataFrame:
    """(qid, n, suggestion): further questions about the two best triples of each of a question's first three entities."""
    names = written(questions.select("qid", F.posexplode(F.slice(T.question_entities(F.col("text")), 1, 3)).alias("p", "e")))
    both = _best_of(triples, names, 2)
    best_two = Window.partitionBy("qid", "p").orderBy(F.desc("confidence"), "subject", "predicate", "object")
    rows = both.join(names, "e").withColumn("r", F.row_number().over(best_two)).where(F.col("r") <= 2)
    said = F.array(F.when(F.col("subject") != F.col("e"), F.concat(F.lit("What is "), "subject", F.lit("?"))), F.when(F.col("object") != F.col("e"), F.concat(F.lit("How does "), "object", F.lit(" work?"))))
    every = rows.select("qid", "p", "r", F.posexplode(said).alias("s", "suggestion")).where("suggestion is not null")
    w = Window.partitionBy("qid").orderBy("p", "r", "s")
    return every.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("qid", "n", "suggestion")


# Verbs and relations that make triples, in order of trial.
VERBS = ("added", "created", "fixed", "updated", "implemented", "removed", "patched", "disabled", "installed", "wired", "configured", "improved", "refactored", "enhanced", "resolved", "replaced", "deleted", "renamed", "moved", "started", "stopped")
RELATIONS = {
    "depends_on": (r"depends\s+on\s+(.+)", r"requires\s+(.+)", r"needs\s+(.+)"),
    "installed": (r"installed\s+(.+)", r"install\s+(.+)"),
    "runs_on": (r"runs\s+on\s+(.+)", r"running\s+on\s+(.+)"),
    "connected_to": (r"connected\s+to\s+(.+)", r"connects?\s+to\s+(.+)"),
    "configured_with": (r"configured\s+with\s+(.+)", r"config.*\s+(.+)"),
    "has_command": (r"command[:\s]+(.+)", r"commands?\s+(.+)"),
    "monitors": (r"monitors?\s+(.+)", r"monitoring\s+(.+)"),
    "supports": (r"supports?\s+(.+)",),
    "failed_with": (r"failed\s+(?:with|due to|error)\s+(.+)",),
}
TRIPLE = "struct<subject:string,predicate:string,object:string,subject_type:string,object_type:string,confidence:double>"


def _lines(df: DataFrame) -> DataFrame:
    return df.select("source_file", F.explode(F.transform(F.split("text", r"\r?\n"), T.stripped)).alias("line")).where("line <> ''")


def _triple(s: Column, p: Column, o: Column, confidence: float, s_type: Column | None = None, o_type: Column | None = None) -> Column:
    def made(x: Column) -> Column:
        return F.struct(x["s"].alias("subject"), p.alias("predicate"), x["o"].alias("object"), (T.subject_type(x["s"]) if s_type is None else s_type).alias("subject_type"), (T.subject_type(x["o"]) if o_type is None else o_type).alias("object_type"), F.lit(confidence).alias("confidence"))

    return T.let(F.struct(s.alias("s"), o.alias("o")), made)


def _done(line: Column, verbs) -> tuple[Column, Column]:
    """The verb that a line begins with, and what it was done to."""
    pattern = r"(?i)^(" + "|".join(verbs) + r")s?\s+(.+)$"
    return F.lower(F.regexp_extract(line, pattern, 1)), T.normalize_entity(F.regexp_extract(line, pattern, 2))


def _flat(rows: DataFrame, triples: list[Column]) -> DataFrame:
    found = F.filter(F.flatten(F.array(*triples)), lambda t: t.isNotNull())
    return rows.select("source_file", F.inline(found))


def extract_memory(df: DataFrame) -> DataFrame:
    """Triples of a memory file's lines: what was done, its components, what uses what, relations."""
    rows = _lines(df).where(~F.col("line").startswith("#"))
    line = F.regexp_replace(F.regexp_replace("line", r"^\d{4}-\d{2}-\d{2}:\s*", ""), r"^- ", "")
    rows = rows.select("source_file", F.regexp_replace(line, r"^\d{4}-\d{2}-\d{2}:\s*", "").alias("line"))
    verb, obj = _done(F.col("line"), VERBS)
    rows = rows.withColumns({"verb": verb, "obj": obj})
    ok = (F.col("verb") != "") & (F.length("obj") > 1)
    none = F.array().cast(f"array<{TRIPLE}>")
    nested = F.filter(F.transform(F.slice(F.regexp_extract_all("line", F.lit(r"[-*]\s+([^-].+)"), F.lit(1)), 1, 5), T.normalize_entity), lambda n: F.length(n) > 2)
    done = F.when(ok, F.concat(F.array(_triple(F.lit("agent"), F.col("verb"), F.col("obj"), 0.9, F.lit("agent"))), F.transform(nested, lambda n: _triple(F.col("obj"), F.lit("has_component"), n, 0.7)))).otherwise(none)
    sides = F.split("line", r"(?i)\s+uses\s+")
    user, used = T.normalize_entity(F.regexp_extract(F.get(sides, F.lit(0)), r"(\S+)\s*$", 1)), T.normalize_entity(F.substring_index(F.get(sides, F.lit(1)), ",", 1))
    uses = F.when(F.lower("line").contains(" uses ") & (F.size(sides) == 2) & (user != "") & (used != ""), F.array(_triple(user, F.lit("uses"), used, 0.8))).otherwise(none)
    found = [done, uses]
    for name, patterns in RELATIONS.items():
        picked = F.lit(None).cast("array<string>")
        for p in reversed(patterns):
            picked = F.when(F.col("line").rlike("(?i)" + p), F.array(F.regexp_extract("line", "(?i)" + p, 0), F.regexp_extract("line", "(?i)" + p, 1))).otherwise(picked)

        def sides_of(x: Column) -> Column:
            word = F.regexp_extract(F.get(x, F.lit(0)), r"^(\S+)", 1)
            before = F.substring(F.col("line"), F.lit(1), F.greatest(F.instr(F.col("line"), word) - 1, F.lit(0)))
            return F.struct(T.normalize_entity(F.substring_index(T.stripped(before), ",", 1)).alias("s"), T.normalize_entity(F.substring_index(F.get(x, F.lit(1)), ",", 1)).alias("o"))

        rows = rows.withColumn(f"r_{name}", T.let(picked, sides_of))
        found.append(_related(F.col(f"r_{name}"), name, none))
    return _flat(rows, found)


def _related(v: Column, name: str, none: Column) -> Column:
    return F.when((F.length(v["s"]) > 1) & (F.length(v["o"]) > 1), F.array(_triple(v["s"], F.lit(name), v["o"], 0.8))).otherwise(none)


def extract_tasks(df: DataFrame) -> DataFrame:
    rows = _lines(df).where(F.col("line").startswith("- [") & F.col("line").rlike(r"- \[.?\]\s+(.+)"))
    task = T.normalize_entity(F.regexp_extract("line", r"- \[.?\]\s+(.+)", 1))
    return _flat(rows, [F.array(_triple(F.lit("agent"), F.lit("has_task"), task, 0.7, F.lit("agent"), F.lit("other")))])


def _state_lines(df: DataFrame, inside, leaves, enters) -> DataFrame:
    """Lines of each text with the state that earlier lines put it in: the text is cut where a line enters or leaves one, without a shuffle."""
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), T.stripped), lambda x: x != "")
    rows = df.select("source_file", lines.alias("l"))
    mark = lambda x, i: F.struct((i + 1).alias("at"), F.when(enters(x), inside(x)).alias("state"), (enters(x) | leaves(x)).alias("cuts"))
    head = F.array(F.struct(F.lit(1).alias("at"), F.lit(None).cast("string").alias("state"), F.lit(True).alias("cuts")))
    rows = rows.select("source_file", "l", F.concat(head, F.filter(F.transform("l", mark), lambda m: m["cuts"])).alias("m"))
    part = F.transform("m", lambda m, k: F.struct(m["state"].alias("state"), F.slice("l", m["at"], F.coalesce(F.get("m", k + 1)["at"], F.size("l") + 1) - m["at"]).alias("lines")))
    return rows.select("source_file", F.explode(part).alias("p")).select("source_file", F.explode("p.lines").alias("line"), F.col("p.state").alias("state"))


def extract_daily(df: DataFrame) -> DataFrame:
    """What was done, in lines of a daily log's conversation summary."""
    heading = lambda x: F.lower(x).contains("conversation summary")
    rows = _state_lines(df, lambda x: F.lit("summary"), lambda x: x.startswith("## "), heading).where(F.col("state").isNotNull() & ~heading(F.col("line")))
    verb, obj = _done(F.col("line"), VERBS[:8])
    rows = rows.withColumns({"verb": verb, "obj": obj}).where((F.col("verb") != "") & (F.length("obj") > 2))
    return _flat(rows, [F.array(_triple(F.lit("agent"), F.col("verb"), F.col("obj"), 0.6, F.lit("agent")))])


def extract_tools(df: DataFrame) -> DataFrame:
    """Files, services and commands in the sections of a tools file."""
    title = r"##\s+(?:Tool|Script)[:\s]+([^\(]+)"
    rows = _state_lines(df, lambda x: T.normalize_entity(F.regexp_extract(x, title, 1)), lambda x: F.lit(False), lambda x: x.startswith("## ") & x.rlike(title)).where("state <> ''")
    make = lambda names, p, kind, c: F.transform(names, lambda n: _triple(F.col("state"), F.lit(p), n, c, F.lit("tool"), F.lit(kind)))
    parts = F.transform(F.split("line", r"\|"), T.stripped)
    command = T.normalize_entity(F.get(parts, F.lit(1)))
    return _flat(rows, [
        make(F.slice(T.entities(F.col("line"), "file"), 1, 3), "implemented_in", "file", 0.9),
        make(F.slice(T.entities(F.col("line"), "service"), 1, 2), "uses_service", "service", 0.8),
        F.when((F.size(parts) >= 3) & (F.get(parts, F.lit(1)) != ""), F.array(_triple(F.col("state"), F.lit("has_command"), command, 0.8, F.lit("tool"), F.lit("other")))).otherwise(F.array().cast(f"array<{TRIPLE}>")),
    ])


def extract_skills(df: DataFrame) -> DataFrame:
    """From SKILL.md files below ``skills/<name>/``: the skill itself, up to five commands with what they do, services that it uses; from ``_meta.json`` files there, up to five commands."""
    name = F.regexp_extract("source_file", r"skills/([^/]+)/", 1)
    rows = df.select("source_file", "text", name.alias("skill")).where("skill <> ''")
    pattern = r"(`?\w+`?\s*[-–]\s*.+)"
    command = lambda x: F.concat(F.regexp_extract(x, r"^`?(\w+)", 1), F.lit(": "), F.substring(F.regexp_extract(x, r"^`?\w+`?\s*[-–]\s*(.+)", 1), 1, 40))
    commands = F.transform(F.slice(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), 1, 5), command)
    make = lambda names, p, kind, c: F.transform(names, lambda n: _triple(F.col("skill"), F.lit(p), n, c, F.lit("skill"), F.lit(kind)))
    own = F.array(_triple(F.lit("agent"), F.lit("has_skill"), F.col("skill"), 1.0, F.lit("agent"), F.lit("skill")))
    meta = F.col("source_file").rlike(r"skills/[^/]+/_meta\.json$")
    listed = F.filter(F.slice(F.coalesce(F.from_json("text", "commands array<string>")["commands"], F.array().cast("array<string>")), 1, 5), lambda c: c.isNotNull())
    none = F.array().cast(f"array<{TRIPLE}>")
    found = [own, make(commands, "has_command", "other", 0.9), make(T.entities(F.col("text"), "service"), "uses_service", "service", 0.8)]
    return _flat(rows, [*[F.when(~meta, x).otherwise(none) for x in found], F.when(meta, make(listed, "has_command", "other", 0.9)).otherwise(none)])


def build(memory: DataFrame | None = None, tools: DataFrame | None = None, tasks: DataFrame | None = None, daily: DataFrame | None = None, skills: DataFrame | None = None) -> DataFrame:
    """All triples of files (source_file, text) by kind, each once whatever its case; the most certain stays."""
    from .maintenance import union_all

    made = [f(df) for f, df in ((extract_memory, memory), (extract_tools, tools), (extract_tasks, tasks), (extract_daily, daily), (extract_skills, skills)) if df is not None]
    rows = union_all(made).withColumn("seq", F.struct((-F.col("confidence")).alias("c"), "source_file", "subject", "predicate", "object"))
    return dedup(rows).drop("seq")
