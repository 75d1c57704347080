"""Quality by distribution divergence from language references.

For each language the whole corpus gives two references: how its bytes fall into
classes (letters, capitals, digits, blanks, line ends, punctuation, symbols, other
scripts) and how often its commonest words occur.  A document's own histograms are
held against each language's by Jensen-Shannon distance; the nearest language
counts, so a document's language need not be known.  Short texts have rough
histograms, so each distance is held against a text only from a least length on.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
KINDS = 8
FLUSH = 400_000
OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def byte_kinds() -> np.ndarray:
    k = np.full(256, 6, np.int64)
    k[128:] = 7
    k[97:123], k[65:91], k[48:58] = 0, 1, 2
    k[[32, 9, 11, 12, 13]], k[10] = 3, 4
    k[list(b".,;:!?'\"-()")] = 5
    return k


def counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, kind, word, n): over all rows with a language, bytes of each kind, and with kind null how often each word occurs."""

    def run(batches):
        kinds, words, chars = byte_kinds(), {}, {}

        def rows():
            out = [(lang, None, w, n) for lang, c in words.items() for w, n in c.items()] + [(lang, k, None, int(n)) for lang, c in chars.items() for k, n in enumerate(c)]
            types = (pa.string(), pa.int32(), pa.binary(), pa.int64())
            words.clear(), chars.clear()
            for i in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 50_000]), types)], ["lang", "kind", "word", "n"])

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (text or "").encode()
                words.setdefault(lang, Counter()).update(raw.lower().split())
                chars[lang] = chars.get(lang, 0) + np.bincount(kinds[np.frombuffer(raw, np.uint8)], minlength=KINDS)
            if sum(map(len, words.values())) > FLUSH:
                yield from rows()
        yield from rows()

    return docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(run, "lang string, kind int, word binary, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = 40) -> tuple[list[str], np.ndarray, list[bytes], np.ndarray]:
    """Languages; their shares of byte kinds; common words of any; each language's shares of its own common words (nan: not its own).

    ``common`` words a language come to the driver, whatever the corpus.
    """
    from ._exchange import written

    found = written(counts(docs, text_col, lang_col))
    words = found.where(F.col("word").isNotNull())
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    order = [F.col("n").desc(), F.col("word")]
    salted = words.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(64)))
    few = salted.withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("r") <= common)
    top = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= common).join(totals, "lang").select("lang", "word", (F.col("n") / F.col("total")).alias("share")).collect()
    kinds = found.where(F.col("kind").isNotNull()).select("lang", "kind", "n").collect()
    langs = sorted({r["lang"] for r in kinds})
    at = {x: i for i, x in enumerate(langs)}
    chars = np.zeros((len(langs), KINDS))
    for r in kinds:
        chars[at[r["lang"]], r["kind"]] = r["n"]
    vocab = sorted({bytes(r["word"]) for r in top})
    col = {w: i for i, w in enumerate(vocab)}
    shares = np.full((len(langs), len(vocab)), np.nan)
    for r in top:
        shares[at[r["lang"]], col[bytes(r["word"])]] = r["share"]
    return langs, chars / np.maximum(chars.sum(axis=1, keepdims=True), 1), vocab, shares


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1), np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def repeated(words: list[bytes], n: int = 5) -> int:
    """Words that lie in a window of n words that the text has twice or more."""
    windows = list(zip(*(words[i:] for i in range(n))))
    if len(set(windows)) == len(windows):
        return 0
    times, inside = Counter(windows), bytearray(len(words))
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside[i : i + n] = b"\1" * n
    return sum(inside)


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common: int = 40, char_limit: float = 0.3, char_words: int = 50, word_limit: float = 0.35, word_words: int = 100) -> DataFrame:
    """Counts, distances and verdict for every whole text.

    One row per input row: ``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, char_distance, word_distance)``.  A text is kept unless base_failed or farther
    from every language than ``char_limit`` (from ``char_words`` words on) or ``word_limit`` (from
    ``word_words`` on).  Null and empty texts have no words, fail the base and have null distances; with
    no row that has a language there are no references, and nothing is rejected for its distances.
    Rows with a null language are judged but give no reference.  Repeated rows count each time; other
    columns are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(references(docs, text_col, lang_col, common))

    def run(batches):
        langs, chars, vocab, shares = known.value
        kinds, col = byte_kinds(), {w: i for i, w in enumerate(vocab)}
        own = [np.flatnonzero(~np.isnan(s)) for s in shares]
        for b in batches:
            rows, hist, seen = [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                raw = text.encode()
                words = raw.split()
                n, again = len(words), repeated(words)
                chars_in = len(text) - (len(raw) - sum(map(len, words)))
                rows.append((n, chars_in, len(raw) - len(raw.translate(None, SYMBOLS)), duplicate_lines(raw), again, n < 10 or 100 * again > 20 * n))
                hist.append(np.bincount(kinds[np.frombuffer(raw, np.uint8)], minlength=KINDS) / max(len(raw), 1))
                at = np.fromiter((col.get(w, len(vocab)) for w in raw.lower().split()), np.int64, n)
                seen.append(np.bincount(at, minlength=len(vocab) + 1)[:-1] / max(n, 1))
            n = np.array([r[0] for r in rows])
            far = np.full((2, len(rows)), np.inf)
            if len(rows):
                hist, seen = np.array(hist), np.array(seen).reshape(len(rows), -1)
                for c, s, o in zip(chars, shares, own):
                    far[0] = np.minimum(far[0], js_distance(hist, c))
                    with_rest = lambda x: np.concatenate([x, 1 - x.sum(axis=-1, keepdims=True)], axis=-1)
                    far[1] = np.minimum(far[1], js_distance(with_rest(seen[:, o]), with_rest(s[o])))
            base = np.array([r[5] for r in rows], bool)
            off = np.isfinite(far[0]) & (((n >= char_words) & (far[0] > char_limit)) | ((n >= word_words) & (far[1] > word_limit)))
            none = (n == 0) | ~np.isfinite(far[0])
            arrays = [b.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(5)), pa.array(base, pa.bool_()), pa.array(~base & ~off, pa.bool_()), *(pa.array(f, pa.float64(), mask=none) for f in far)]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, OUT)


_ONLY = lambda keep: f"length(regexp_replace(t, '[^{keep}]', '', 'g'))"
_TERM = lambda p, q: f"case when {p} > 0 then {p} * log2({p} / (({p} + {q}) / 2)) else 0 end + case when {q} > 0 then {q} * log2({q} / (({p} + {q}) / 2)) else 0 end"
#: The query's rows, distances to six places.
SQL = rf"""
with d as (select doc_id, lang, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') lw, octet_length(encode(t)) size,
  {_ONLY('a-z')} k0, {_ONLY('A-Z')} k1, {_ONLY('0-9')} k2, {_ONLY(chr(92) + 'x20' + chr(92) + 'x09' + chr(92) + 'x0B-' + chr(92) + 'x0D')} k3, {_ONLY(chr(92) + 'n')} k4, {_ONLY(".,;:!?''" + '"()-')} k5, {_ONLY(chr(92) + 'x00-' + chr(92) + 'x7F')} a from d),
k as (select *, a - k0 - k1 - k2 - k3 - k4 - k5 k6, size - a k7, len(w) n from w),
rc as (select lang, {', '.join(f'sum(k{i}) / sum(size) r{i}' for i in range(8))} from k where lang is not null group by lang),
wc as (select lang, x, count(*) n from (select lang, unnest(lw) x from k where lang is not null) group by 1, 2),
tot as (select lang, sum(n) total from wc group by 1),
top as (select lang, x, n / total q from (select *, row_number() over (partition by lang order by n desc, x) r from wc) join tot using (lang) where r <= 40),
q as (select lang, coalesce(sum(q), 0) q from rc left join top using (lang) group by 1),
dw as (select doc_id, x, count(*) c from (select doc_id, unnest(lw) x from k) group by 1, 2),
m as (select dw.doc_id, lang, sum(p) p, sum(q) q, sum({_TERM('p', 'q')}) s from (select doc_id, x, c / n p from dw join k using (doc_id)) dw join top using (x) group by 1, 2),
pairs as (select k.doc_id, rc.lang, 1 - coalesce(m.p, 0) pr, 1 - q.q qr, coalesce(m.s, 0) + q.q - coalesce(m.q, 0) s, ({' + '.join(_TERM(f'(k{i} / size)', f'r{i}') for i in range(8))}) c from k cross join rc join q on q.lang = rc.lang left join m on m.doc_id = k.doc_id and m.lang = rc.lang where n > 0),
far as (select doc_id, min(sqrt(least(1, greatest(0, c / 2)))) cd, min(sqrt(least(1, greatest(0, (s + {_TERM('pr', 'qr')}) / 2)))) wd from pairs group by 1),
g as (select doc_id, i, array_to_string(w[i : i + 4], ' ') g from (select doc_id, w, unnest(range(1, n - 3)) i from k)),
again as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 5)) p from (select *, count(*) over (partition by doc_id, g) c from g) where c > 1) group by 1),
lines as (select doc_id, count(*) - count(distinct x) n from (select doc_id, unnest(string_split(t, chr(10))) x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by 1),
b as (select k.doc_id, k.n n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, {_ONLY('#*$%&|<>')} n_symbols, coalesce(lines.n, 0) n_dup_lines, coalesce(again.n, 0) n_repeat_words from k left join lines using (doc_id) left join again using (doc_id))
select b.*, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not coalesce(n_words >= 50 and cd > 0.3 or n_words >= 100 and wd > 0.35, false) kept, round(cd, 6) char_distance, round(wd, 6) word_distance
from b left join far using (doc_id)
"""
