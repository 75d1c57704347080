"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

Pre-tokens keep their positions in their chunk; each distinct pre-token of the
corpus goes to one shard, is encoded there once, and its ids are joined back and
put together by position.  Decoding joins the ids with the token-byte table.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _exchange as X

# The pre-token pattern of the vocabulary files, its white space written out as Unicode has it
# (Python's own class also holds U+001C to U+001F).
SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
FULL = "doc_id long, ids array<int>, decoded string"


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a base64 token and its rank a line. Its size is fixed by the file, not by the corpus."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _pretokens(texts: list, pattern: str):
    import regex

    find, vocab = regex.compile(pattern).findall, X.vocabulary()
    at = vocab.__getitem__
    docs = [np.fromiter(map(at, found), np.int32, len(found)) for found in (find(t or "") for t in texts)]
    return [w.encode() for w in vocab], docs


def _flat(starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of the concatenated runs starts[i]..starts[i]+lengths[i] for i in at."""
    n = lengths[at]
    ends = np.cumsum(n)
    return np.repeat(starts[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN, digest: bool = False) -> DataFrame:
    """Token ids of every whole text and the text decoded from them.

    One row per input row: ``(doc_id, ids array<int>, decoded string)``, or with
    ``digest`` ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``.  A null or empty
    text has no tokens; null ids stay null; repeated rows are encoded each; an
    empty table gives no rows; other columns are not read, whatever their names.
    A text of any length is one row: it is never cut.
    """
    spark = docs.sparkSession
    n = X.width(spark)
    table = spark.sparkContext.broadcast(ranks)  # as large as the vocabulary file, whatever the corpus

    def ask(t: pa.Table) -> pa.Table:
        words, _ = _pretokens(X.unpack(t)[1], pattern)
        parts = X.by_shard(words, n)
        return X.asked(t.column("chunk")[0].as_py(), {s: X.to_blob(word=pa.array([words[i] for i in at], pa.binary())) for s, at in enumerate(parts) if len(at)})

    def answer(t: pa.Table) -> pa.Table:
        import tiktoken

        code = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        out = {}
        for chunk, blob in zip(t.column("chunk").to_pylist(), t.column("blob")):
            ids = []
            for w in X.from_blob(blob.as_py()).column("word").to_pylist():
                got = known.get(w)
                if got is None:
                    got = known[w] = code._encode_single_piece(w)
                ids.append(got)
            out[chunk] = X.to_blob(ids=pa.array(ids, pa.list_(pa.int32())))
        return X.answered(t.column("shard")[0].as_py(), out)

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = X.unpack(t)
        words, docs_at = _pretokens(texts, pattern)
        lengths, runs = np.zeros(len(words), np.int64), {}
        parts = X.by_shard(words, n)
        for shard, blob in zip(answers.column("shard").to_pylist(), answers.column("blob")):
            got = X.from_blob(blob.as_py()).column("ids").combine_chunks()
            lengths[parts[shard]] = got.value_lengths().to_numpy()
            runs[shard] = got.flatten().to_numpy()
        order = np.concatenate([parts[s] for s in sorted(runs)]) if runs else np.zeros(0, np.int64)
        flat = np.concatenate([runs[s] for s in sorted(runs)]) if runs else np.zeros(0, np.int32)
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        token = {i: b for b, i in table.value.items()}
        out_ids, out_n, out_text = [], [], []
        for at in docs_at:
            got = flat[_flat(starts, lengths, at)]
            decoded = b"".join(map(token.__getitem__, got.tolist()))
            out_n.append(len(got))
            out_ids.append(hashlib.sha256(got.astype("<u4").tobytes()).hexdigest() if digest else got)
            out_text.append(hashlib.sha256(decoded).hexdigest() if digest else decoded.decode("utf-8", "replace"))
        i = pa.array(ids, pa.int64())
        if digest:
            return pa.table({"doc_id": i, "n_tokens": pa.array(out_n, pa.int64()), "ids_sha256": pa.array(out_ids, pa.string()), "decoded_sha256": pa.array(out_text, pa.string())})
        return pa.table({"doc_id": i, "ids": pa.array(out_ids, pa.list_(pa.int32())), "decoded": pa.array(out_text, pa.string())})

    packed = X.pack(docs, id_col, text_col)
    answers = X.per_shard(X.per_chunk(packed, ask), answer)
    return X.applied(packed, answers, finish, DIGEST if digest else FULL)
