"""Benchmark decontamination by a broadcast set of normalised n-grams, in DataFrame functions only.

Every window of a text whose first words begin some benchmark n-gram is spelt out
and looked up in the table of n-grams, word for word, so a hit is verified by
equality.  Heads are kept as bits, one filter for n-grams of all sizes, sized by their
number up to 128 MB; they are the value of a subquery, which no plan spells out, and only
windows that begin like an n-gram are spelt out.  The n-grams are broadcast while they
are few, and joined by a shuffle beyond; which items have them is joined to what was found.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._exchange import fresh, written

#: What no word holds: ASCII other than digits and lower-case letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before letters are lower-cased.
OTHER, WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
HEAD = 4
MAX_BROADCAST = 200_000
#: Bits for each n-gram while that is within MANY_BITS, else FEW_EACH; the least, MANY_BITS and the most as powers of two.
BITS_EACH, FEW_EACH, LEAST_BITS, MANY_BITS, MOST_BITS = 64, 16, 15, 27, 30


def lowered(text: Column) -> Column:
    """A-Z lower-cased, and nothing else."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), BREAK), "")


def ngrams(benchmark: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """(size, gram, head, item): each n-gram of an item, or the whole of a shorter item, once an item."""
    w = benchmark.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("size", F.least(F.size("w"), F.lit(n)))
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.slice("w", i, F.col("size")))
    rows = w.select("item", "size", F.explode(cut).alias("g"))
    return rows.select("size", F.array_join("g", " ").alias("gram"), _head("g", F.lit(0), F.least("size", F.lit(HEAD))).alias("head"), "item").distinct()


def _head(words_col: str, at: Column, size: Column) -> Column:
    """Hash of the ``size`` words from a place on, HEAD at most."""
    return F.xxhash64(size, *[F.when(k < size, F.get(words_col, at + k)) for k in range(HEAD)])


def size_of(n: int) -> int:
    """How many bits the filter of n heads has."""
    many = min(1 << MANY_BITS, 1 << (BITS_EACH * n).bit_length())
    return min(1 << MOST_BITS, max(1 << LEAST_BITS, many, 1 << (FEW_EACH * n).bit_length()))


def bitmap(heads: DataFrame, bits: int) -> DataFrame:
    """(bits): one row, the filter as bytes; the head modulo ``bits`` is set for each head."""
    place = F.pmod("head", F.lit(bits)) + 1
    rows = heads.groupBy((F.bitmap_bucket_number(place) - 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("part"))
    every = heads.sparkSession.range(max(1, bits >> 15)).select(F.col("id").alias("k")).join(rows, "k", "left")
    return every.select("k", F.coalesce("part", F.lit(bytes(4096))).alias("part")).agg(F.expr("listagg(part) within group (order by k)").alias("bits"))


def _heads(length: int):
    return lambda i: _head("w", i, F.lit(length))


def _held(bits: Column, head: Column, count: int) -> Column:
    """Whether the filter may hold a head."""
    place = F.pmod(head, F.lit(count))
    byte = F.ascii(F.decode(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    return F.getbit(byte, (place % 8).cast("int")) == 1


def _grams(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    return written(ngrams(benchmark, n, item_col, text_col))


def _met(docs: DataFrame, grams: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, digest, at, size, gram) of each window that is an n-gram, and of each row one line with -1 for at and its number of words for size."""
    table = grams.select(F.col("size").alias("g_size"), F.col("gram").alias("g_gram"), "head").distinct()
    sizes = {r["g_size"]: r["n"] for r in table.groupBy("g_size").agg(F.count("*").alias("n")).collect()}  # n rows at most
    small = sum(sizes.values()) <= MAX_BROADCAST
    count = size_of(sum(sizes.values()))
    lengths = sorted({min(size, HEAD) for size in sizes})
    places = {length: F.greatest(F.lit(0), F.size("w") - (length - 1)) for length in lengths}
    heads = [F.transform(F.when(n_of > 0, F.sequence(F.lit(0), n_of - 1)).otherwise(F.array().cast("array<int>")), _heads(length)) for length, n_of in places.items()]
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("digest"), words(F.col(text_col)).alias("w"))
    # one line for the row, then one for each place and length of a head; whole-stage code drops those that the filter has not, before anything is copied
    each = base.select("row", "doc_id", "digest", "w", F.posexplode_outer(F.concat(F.array(F.lit(None).cast("long")), *heads)).alias("p", "head"))
    each = each.where((F.col("p") == 0) | _held(bitmap(table, count).scalar(), F.col("head"), count)) if sizes else each
    at, length, first = F.lit(-1), F.lit(0), F.lit(1)
    for k, n_of in places.items():
        inside = (F.col("p") >= first) & (F.col("p") < first + n_of)
        at, length, first = F.when(inside, F.col("p") - first).otherwise(at), F.when(inside, k).otherwise(length), first + n_of
    of = F.array(F.size("w"))
    for k in lengths:
        of = F.when(F.col("length") == k, F.array(*[F.lit(s) for s in sorted(sizes) if min(s, HEAD) == k])).otherwise(of)
    each = each.withColumns({"at": at, "length": length}).withColumn("size", F.explode(of)).where((F.col("at") < 0) | (F.col("at") + F.col("size") <= F.size("w")))
    # a row's own line has a key of its own, that no n-gram is: no join gathers such lines
    gram = F.when(F.col("at") < 0, F.concat(F.lit("\x00"), F.col("row").cast("string"))).otherwise(F.array_join(F.slice("w", F.col("at") + 1, F.col("size")), " "))
    rows = each.select("row", "doc_id", "digest", "at", "size", gram.alias("gram"))
    table = table.select("g_size", "g_gram", F.lit(True).alias("known"))
    met = rows.join(F.broadcast(table) if small else table, (F.col("gram") == F.col("g_gram")) & (F.col("size") == F.col("g_size")), "left")
    return met.where((F.col("at") < 0) | F.col("known")).select("row", "doc_id", "digest", "at", "size", "gram")


def _found(met: DataFrame) -> DataFrame:
    first = F.col("at") < 0
    return met.groupBy("row").agg(
        F.max(F.when(first, F.struct("doc_id", "digest"))).alias("own"),
        F.max(F.when(first, F.col("size"))).cast("long").alias("n_words"),
        F.array_sort(F.collect_list(F.when(~first, F.struct("at", "size")))).alias("found"),
    ).select("row", "own.*", "n_words", "found")


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 13) -> DataFrame:
    """One row per row of docs: (row, doc_id, digest of the text, n_words, found array<(at, size)>)."""
    return _found(_met(docs, _grams(benchmark, item_col, item_text_col, n), id_col, text_col))


def covered(found: Column) -> Column:
    """How many words the windows cover: they come in order of their starts."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(s["end"], x["at"]))).cast("long").alias("n"), F.greatest(s["end"], x["at"] + x["size"]).alias("end"))
    return F.aggregate(found, start, step, lambda s: s["n"])


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 13, share: int = 20) -> DataFrame:
    """Whether each document holds benchmark text.

    One row per input row: ``(doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated)``.  A word is hit if any occurrence of an item's window of ``n`` words (all
    words of a shorter item) holds it; a document is contaminated if it has hits and they
    are at least one in ``share`` of its words.  Null and empty texts have no words and
    no hits; items without words have no window; a null item_id hits but is not listed;
    repeated rows are judged each; other columns are not read.
    """
    grams = _grams(benchmark, item_col, item_text_col, n)
    # few windows are n-grams: what was met is kept, so that both its uses read it; an n-gram's items join what is distinct in a row
    met = written(_met(docs, grams, id_col, text_col))
    has = met.where("at >= 0").select("row", "size", "gram").distinct().join(grams.select("size", "gram", F.col("item").cast("string").alias("item")), ["size", "gram"]).select("row", "item").distinct()
    items = has.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = _found(met).join(items, "row", "left").select("doc_id", "n_words", covered(F.col("found")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    hit, n_words = F.col("n_hit"), F.col("n_words")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((hit > 0) & (share * hit >= n_words)).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 13, share: int = 20, spans: bool = False) -> DataFrame:
    """``docs`` without contaminated rows, or with ``spans`` without the words hit in them (each with what follows it up to the next word).

    Contamination is as judge() has it.  Null and empty texts, and texts without hits, stay as
    they are; rows of equal id and text share one fate, a null id included.  All columns stay;
    an empty table gives no rows.
    """
    found = hits(docs, benchmark, id_col, text_col, item_col, item_text_col, n)
    own_id, own_text, own_found = (fresh(docs, c) for c in ("bad_id", "bad_digest", "bad_found"))
    hit = covered(F.col("found"))
    bad = found.where((hit > 0) & (share * hit >= F.col("n_words"))).select(F.col("doc_id").alias(own_id), F.col("digest").alias(own_text), F.col("found").alias(own_found)).dropDuplicates([own_id, own_text])
    same = docs[id_col].eqNullSafe(bad[own_id]) & (F.xxhash64(docs[text_col]) == bad[own_text])
    if not spans:
        return docs.join(bad.drop(own_found), same, "left_anti")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD}+{OTHER}*)"), F.lit(1))
    stay = F.filter(pieces, lambda p, i: ~F.exists(own_found, lambda x: (x["at"] <= i) & (i < x["at"] + x["size"])))
    cut = F.when(F.col(own_found).isNotNull(), F.concat(F.regexp_extract(text_col, f"^{OTHER}*", 0), F.array_join(stay, ""))).otherwise(F.col(text_col))
    return docs.join(bad, same, "left").select(*[cut.alias(c) if c == text_col else F.col(c) for c in docs.columns])


UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
SQL = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') w from benchmark),
s as (select item_id, w, least(len(w), 13) n from b where len(w) > 0),
g as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') g from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) i from s)),
dw as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from g) where len(w) >= n)),
h as (select doc_id, i, dw.n, item_id from dw join g using (n, g)),
c as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from (select distinct doc_id, i, n from h)) group by doc_id),
t as (select doc_id, count(*) n_items, string_agg(x, ',' order by x) x from (select distinct doc_id, item_id::varchar x from h) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(x, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join c using (doc_id) left join t using (doc_id)
"""
