"""Merkle fixity audit of WARC replicas.

Each record is hashed.  Records lie in files in order of their ids, each replica laid out by
itself, so that offsets behind a lost or longer record differ between replicas.  A node of
the tree is therefore a range of places in the order of records of a file, or a range of files; its hash is that of its children's places and hashes, in order: first of the
records in LEAF places of a file, then of FAN ranges of it, then of FAN files by number, up to one root for a replica.  Replicas whose
roots agree are equal.  Else only the children of nodes that differ are compared, level by
level, and the records of the ranges that differ at last, so an audit of a good replica
reads one row.  Bit-for-bit copies can be audited by offset in the same way.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._exchange import written

LEAF, FAN = 1 << 16, 16
PER_FILE = 1000
#: Files that records without an id are dealt to.
LOOSE = 1 << 20
#: The number of the last of these files: below the file of any id.
LAST_LOOSE = -(1 << 62)
# The header of a record, its date a parameter.
DATE = "2024-01-01T00:00:00Z"
HEADER = "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{}>\r\nWARC-Date: {}\r\nWARC-Target-URI: {}\r\nContent-Type: text/html\r\nContent-Length: {}\r\n\r\n"


def record(key: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """A page as a WARC resource record; nulls are empty.  Its record id is made of key and URL."""
    u, h = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    x = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(" "), u))
    uuid = F.concat_ws("-", *[F.substring(x, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    between = iter((uuid, F.lit(date), u, F.octet_length(h).cast("string")))
    first, *rest = HEADER.split("{}")
    return F.concat(F.lit(first), *[c for part in rest for c in (next(between), F.lit(part))], h, F.lit("\r\n\r\n"))


def _down(name: str, n: int) -> Column:
    """A column over n, rounded down, in whole numbers: right for every long."""
    return F.expr(f"{name} div {n} - int({name} < 0 and {name} % {n} <> 0)")


def _file(per_file: int) -> Column:
    return F.coalesce(_down("page_id", per_file), F.lit(LAST_LOOSE) - F.pmod(F.xxhash64("sha256"), F.lit(LOOSE)))


def laid_out(records: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """(page_id, sha256, n_bytes, file, offset): where each of ``records`` (page_id, sha256, n_bytes) lies, in files of ``per_file`` ids, in order of id, then digest.

    Only hashes and lengths are sorted, and equal records once.  Null ids go to files below all
    others, by their digest; repeated records lie side by side; an empty table gives no rows.
    """
    file = _file(per_file)
    rows = records.groupBy("page_id", "sha256", "n_bytes").agg(F.count("*").alias("copies")).withColumn("file", file)
    order = Window.partitionBy("file").orderBy("page_id", "sha256").rowsBetween(Window.unboundedPreceding, 0)
    first = F.sum(F.col("n_bytes") * F.col("copies")).over(order) - F.col("n_bytes") * F.col("copies")
    each = rows.withColumn("first", first).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("k"))
    return each.select("page_id", "sha256", "n_bytes", "file", (F.col("first") + F.col("k") * F.col("n_bytes")).alias("offset"))


def placed(manifest: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """(file, offset, digest) with, for offset, a record's place among its file's ids, which does not shift; equal records are one digest and their number; an empty table gives no rows."""
    place = F.coalesce(F.pmod("page_id", F.lit(per_file)), F.pmod(F.xxhash64("sha256", F.lit(1)), F.lit(LEAF)))
    rows = manifest.groupBy("file", place.alias("offset"), "sha256").agg(F.count("*").alias("copies"))
    return rows.select("file", "offset", F.concat_ws("x", "sha256", "copies").alias("digest"), "sha256")


def files(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", per_file: int = PER_FILE) -> DataFrame:
    """(file, content): the replica's files, records in the order that laid_out() states."""
    text = record(F.col(id_col), F.col(url_col), F.col(html_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), text.alias("text"), F.sha2(text, 256).alias("sha256"))
    file = _file(per_file)
    order = F.array_sort(F.collect_list(F.struct("page_id", "sha256", "text")))
    return rows.groupBy(file.alias("file")).agg(F.encode(F.array_join(F.transform(order, lambda x: x["text"]), ""), "UTF-8").alias("content"))


def read_records(replica: DataFrame) -> DataFrame:
    """(file, offset, n_bytes, record_id, url, sha256, content) of each record in the files (file, content) of a replica.

    A file without content has none; what follows a broken header is one record with null id and URL.
    """

    def run(batches):
        import hashlib

        for b in batches:
            rows = []
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data, at = data or b"", 0
                while at < len(data):
                    end = data.find(b"\r\n\r\n", at)
                    head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in data[at:end].split(b"\r\n")[1:])} if end >= 0 else {}
                    size = head.get(b"content-length", b"")
                    good = data.startswith(b"WARC/1.", at) and size.isdigit()
                    to = end + 8 + int(size) if good else len(data)
                    text = lambda c: head.get(c, b"").decode("utf-8", "replace") if good else None  # noqa: E731, B023
                    rows.append((file, at, min(to, len(data)) - at, text(b"warc-record-id"), text(b"warc-target-uri"), hashlib.sha256(data[at:to]).hexdigest(), data[end + 4 : end + 4 + int(size)] if good else data[at:]))
                    at = to
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["file", "offset", "n_bytes", "record_id", "url", "sha256", "content"])

    kinds = "file long, offset long, n_bytes long, record_id string, url string, sha256 string, content binary"
    return replica.select(F.col("file").cast("long"), "content").mapInArrow(run, kinds)


def trees(leaves: DataFrame) -> list[tuple[DataFrame, list[Column]]]:
    """Levels (side, file, node, hash) from the ranges of records up to the roots, for ``leaves`` (side, file, place, digest); with each, the (file, node) above a row of the level below.

    A node stands over LEAF places of a file, then over FAN nodes of it, then over FAN files; files are keyed by
    number, so no product of numbers is made and any long will do.  At last what is left, within FAN numbers, is one root.
    """

    def level(rows: DataFrame, up: list[Column], digest: str, *place: str) -> DataFrame:
        children = F.array_sort(F.collect_list(F.struct(*place, F.col(digest).alias("d"))))
        text = F.array_join(F.transform(children, lambda x: F.concat_ws(":", *[x[p].cast("string") for p in place], x["d"])), ";")
        return written(rows.groupBy("side", up[0].alias("up_file"), up[1].alias("up_node")).agg(F.sha2(text, 256).alias("hash")).select("side", F.col("up_file").alias("file"), F.col("up_node").alias("node"), "hash"))

    # a node has at most LEAF places or FAN children: no group grows with the archive
    up = [F.col("file"), _down("place", LEAF)]
    out = [(level(leaves, up, "digest", "place"), up)]
    last = (leaves.agg(F.max("place")).first()[0] or 0) // LEAF
    while last > 0:
        up = [F.col("file"), _down("node", FAN)]
        out.append((level(out[-1][0], up, "hash", "node"), up))
        last //= FAN
    ends = leaves.agg(F.min("file").alias("low"), F.max("file").alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    while high - low >= FAN:
        up = [_down("file", FAN), F.lit(0).cast("long")]
        out.append((level(out[-1][0], up, "hash", "file"), up))
        low, high = low // FAN, high // FAN
    up = [F.lit(0).cast("long"), F.lit(0).cast("long")]
    return [*out, (level(out[-1][0], up, "hash", "file"), up)]


def _differ(rows: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys, a, b) where the two sides' hashes are not equal, or only one side has the keys."""
    a, b = (rows.where(F.col("side") == s).select(*keys, F.col(digest).alias(s)) for s in ("a", "b"))
    return a.join(b, keys, "full").where(~F.col("a").eqNullSafe(F.col("b")))


def _below(rows: DataFrame, up: list[Column], wrong: DataFrame) -> DataFrame:
    """The rows that lie under nodes (file, node)."""
    above = wrong.select(F.col("file").alias("up_file"), F.col("node").alias("up_node"))
    return rows.join(above, (up[0] == F.col("up_file")) & (up[1] == F.col("up_node")), "left_semi")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, offset, verdict): the records of two replicas (file, offset, digest) that differ: corrupt, missing in b, or extra in b.

    Empty replicas are equal; a record that occurs twice at one place is compared as both its digests; file numbers are any longs, offsets any from 0.
    """
    both = a.select(F.lit("a").alias("side"), "file", "offset", "digest").union(b.select(F.lit("b"), "file", "offset", "digest"))
    leaves = written(both.groupBy("side", "file", F.col("offset").alias("place")).agg(F.array_join(F.array_sort(F.collect_list("digest")), ",").alias("digest")))
    levels = trees(leaves)
    wrong = _differ(levels[-1][0], ["file", "node"], "hash").select("file", "node")
    for (level, _), (_, up) in zip(reversed(levels[:-1]), reversed(levels)):
        if not wrong.limit(1).count():
            break
        wrong = written(_differ(_below(level, up, wrong), ["file", "node"], "hash").select("file", "node"))
    found = _below(leaves, levels[0][1], wrong)
    verdict = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt")
    return _differ(found, ["file", "place"], "digest").select("file", F.col("place").alias("offset"), verdict.alias("verdict"))


def root(replica: DataFrame) -> str | None:
    """A replica's root hash; null without records."""
    found = trees(written(replica.select(F.lit("a").alias("side"), "file", F.col("offset").alias("place"), "digest")))[-1][0].first()
    return found["hash"] if found else None


def damaged(key: Column, html: Column) -> Column:
    """What a second replica holds of a page's html: some pages have a byte changed, some a byte more."""
    longer = F.when(key % 193 == 11, F.concat(html, F.lit("~"))).otherwise(html)
    return F.when((key % 97 == 5) & (F.length(html) > 10), F.concat(F.substring(longer, 1, 5), F.lit("~"), F.expr("substring(html, 7)"), F.when(key % 193 == 11, F.lit("~")).otherwise(F.lit("")))).otherwise(longer)


def replicas(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, sha256, n_bytes, file, offset, second_offset, verdict) of every page as a record, held against a replica, laid out by itself, with planted damage:
    a byte changed where id % 97 is 5, a byte more where id % 193 is 11, the record lacking where id % 211 is 7.

    ``second_offset``: where the record of that id, if there is one, begins in the second replica; the least of several.
    Null ids have no planted damage and no second offset; null URLs and pages are empty; repeated rows are
    reported each; of several records of an id, those are as they were that the second replica has as often; an empty table gives no rows; other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def manifest(df: DataFrame, html: Column) -> DataFrame:
        text = record(F.col("page_id"), F.col("url"), html)
        return written(laid_out(df.select("page_id", F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("n_bytes"))))

    first = manifest(rows, F.col("html"))
    second = manifest(rows.where(F.coalesce(F.col("page_id") % 211 != 7, F.lit(True))), damaged(F.col("page_id"), F.col("html")))
    here, other = placed(first), placed(second)
    found = audit(here, other)
    same = here.join(found.where("verdict = 'corrupt'"), ["file", "offset"], "left_semi").join(other, ["file", "offset", "digest"], "left_semi")
    found = here.join(found, ["file", "offset"]).join(same.select("file", "offset", "digest"), ["file", "offset", "digest"], "left_anti").select("file", F.col("offset").alias("place"), "sha256", "verdict")
    place = F.coalesce(F.pmod("page_id", F.lit(PER_FILE)), F.pmod(F.xxhash64("sha256", F.lit(1)), F.lit(LEAF)))
    there = second.where("page_id is not null").groupBy("page_id").agg(F.min("offset").alias("second_offset"))
    out = first.withColumn("place", place).join(found, ["file", "place", "sha256"], "left").join(there, "page_id", "left")
    return out.select("page_id", "sha256", "n_bytes", "file", "offset", "second_offset", F.coalesce("verdict", F.lit("ok")).alias("verdict"))


def _sql() -> str:
    line = lambda text: " || chr(13) || chr(10) || ".join(f"'{x}'" for x in text.split("\r\n"))
    uuid = " || '-' || ".join(f"substr(x, {i}, {n})" for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))

    def text(h: str) -> str:
        between = iter((uuid, f"'{DATE}'", "u", f"octet_length(encode({h}))"))
        first, *rest = HEADER.split("{}")
        return line(first) + "".join(f" || {next(between)} || {line(r)}" for r in rest) + f" || {h} || {line(chr(13) + chr(10) + chr(13) + chr(10))}"

    return f"""
with p as (select page_id, coalesce(url, '') u, coalesce(html, '') h, md5(coalesce(page_id::varchar, '') || ' ' || coalesce(url, '')) x from pages),
c as (select *, case when page_id % 97 = 5 and length(h) > 10 then substr(h, 1, 5) || '~' || substr(h, 7) else h end || case when page_id % 193 = 11 then '~' else '' end g from p),
r as (select page_id, page_id // {PER_FILE} file, {text('h')} t, {text('g')} s from c),
n as (select page_id, file, sha256(t) sha256, octet_length(encode(t)) n_bytes, case when page_id % 211 = 7 then 0 else octet_length(encode(s)) end m, t <> s changed from r)
select page_id, sha256, n_bytes, file, (sum(n_bytes) over w - n_bytes)::bigint "offset", case when m > 0 then (sum(m) over w - m)::bigint end second_offset,
  case when m = 0 then 'missing' when changed then 'corrupt' else 'ok' end verdict from n window w as (partition by file order by page_id)
"""


SQL = _sql()
