"""Encoding of whole corpora with a public byte-level BPE vocabulary.

Texts are cut by the vocabulary's pattern, distinct words of a batch become rows of padded numpy matrices, one matrix for each
length bucket. In every round each row merges its leftmost pair of minimum rank; the pair's rank comes from a hash table, rows
without a pair left are compacted away. Words longer than the widest bucket merge all places of their minimum pair in a round,
which gives the same ids (a pair made by a merge never ranks below that merge) in fewer rounds.

Defined cases: null and empty text give an empty list; the strings of special tokens are ordinary text; the text is never cut."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quarrykit.runtime import read_table, spread

TOKENIZER_DIR = os.environ.get("QUARRYKIT_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = (4, 8, 12, 16, 24, 32, 64, 128)
NONE = np.int32(2**31 - 1)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Characters whose words are encoded together; bounds a worker's memory whatever the batch.
BATCH_CHARS = 4_000_000


class PairTable:
    """Open-addressing hash table from (left id, right id) to the rank of the merged token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, vals = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    vals.append(rank)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        keys, vals = np.array(keys, np.int64), np.array(vals, np.int32)
        slot = self._home(keys)
        while len(keys):  # one key of each free slot settles, the others move on
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            take = np.zeros(len(keys), bool)
            take[first] = True
            take &= free
            self.keys[slot[take]], self.vals[slot[take]] = keys[take], vals[take]
            keys, vals, slot = keys[~take], vals[~take], (slot[~take] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where no token joins them; a negative id is padding."""
        shape = left.shape
        l, r = left.ravel(), right.ravel()
        out = np.full(len(l), NONE, np.int32)
        live = np.flatnonzero((l >= 0) & (r >= 0))
        keys = l[live].astype(np.int64) << 32 | r[live]
        slot = self._home(keys)
        while len(live):
            at = self.keys[slot]
            hit = at == keys
            out[live[hit]] = self.vals[slot[hit]]
            on = ~hit & (at != -1)
            live, keys, slot = live[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


def merge_rows(table: PairTable, mat: np.ndarray) -> np.ndarray:
    """The final ids of each row of a padded matrix, padded with -1."""
    out = np.full_like(mat, -1)
    where = np.arange(len(mat))
    ranks = table.rank(mat[:, :-1], mat[:, 1:]) if mat.shape[1] > 1 else np.full((len(mat), 1), NONE, np.int32)
    while len(where):
        at = ranks.argmin(axis=1)
        rows = np.arange(len(where))
        best = ranks[rows, at]
        done = best == NONE
        if done.any():  # compaction
            out[where[done], : mat.shape[1]] = mat[done]
            keep = ~done
            where, mat, ranks, at, best = where[keep], mat[keep], ranks[keep], at[keep], best[keep]
            if not len(where):
                break
            used = int((mat >= 0).sum(axis=1).max())
            mat, ranks, rows = mat[:, : max(used, 2)], ranks[:, : max(used, 2) - 1], np.arange(len(where))
        mat[rows, at] = best
        n = mat.shape[1]
        shift = np.arange(n)[None, :] > at[:, None]
        nxt = np.minimum(np.arange(n)[None, :] + shift, n - 1)
        mat = np.take_along_axis(mat, nxt, axis=1)
        mat[:, -1] = -1
        m = n - 1
        ranks = np.take_along_axis(ranks, np.minimum(np.arange(m)[None, :] + shift[:, :m], m - 1), axis=1)
        ranks[:, -1] = NONE
        inside = at < m
        ranks[rows[inside], at[inside]] = table.rank(mat[rows[inside], at[inside]], mat[rows[inside], at[inside] + 1])
        left = at > 0
        ranks[rows[left], at[left] - 1] = table.rank(mat[rows[left], at[left] - 1], mat[rows[left], at[left]])
    return out


def merge_long(table: PairTable, ids: np.ndarray) -> np.ndarray:
    """The final ids of one long word."""
    ranks = table.rank(ids[:-1], ids[1:])
    while len(ranks) and (best := ranks.min()) != NONE:
        at = np.flatnonzero(ranks == best)
        if len(at) > 1 and (np.diff(at) == 1).any():  # of overlapping places every other, from the left
            start = np.concatenate([[True], np.diff(at) != 1])
            head = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
        ids = ids.copy()
        ids[at] = best
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        kept_ranks = np.append(ranks, NONE)[keep][:-1] if keep[-1] else np.append(ranks, NONE)[keep]
        ids = ids[keep]
        new_at = at - np.arange(len(at))
        ranks = kept_ranks[: len(ids) - 1]
        for i in (new_at, new_at - 1):
            i = i[(i >= 0) & (i < len(ids) - 1)]
            ranks[i] = table.rank(ids[i], ids[i + 1])
    return ids


class Encoder:
    """Encodes batches of texts; built once a worker from the broadcast pair table."""

    def __init__(self, table: PairTable):
        self.table, self.split = table, regex.compile(PATTERN)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and where each word begins (one more than words)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = self.table.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        begin = np.concatenate([[0], np.cumsum(size)])
        parts: list = [None] * len(words)
        low = 0
        for width in BUCKETS:
            rows = np.flatnonzero((size > low) & (size <= width))
            low = width
            for block in np.array_split(rows, max(1, len(rows) * width // 2_000_000)):
                if not len(block):
                    continue
                mat = np.full((len(block), width), -1, np.int32)
                col = np.arange(width)[None, :]
                inside = col < size[block][:, None]
                mat[inside] = flat[(begin[block][:, None] + col)[inside]]
                done = merge_rows(self.table, mat)
                count = (done >= 0).sum(axis=1)
                for i, row, n in zip(block.tolist(), done, count.tolist()):
                    parts[i] = row[:n]
        for i in np.flatnonzero(size > BUCKETS[-1]).tolist():
            parts[i] = merge_long(self.table, flat[begin[i] : begin[i + 1]])
        for i in np.flatnonzero(size == 0).tolist():
            parts[i] = np.zeros(0, np.int32)
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(count)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and where each text begins (one more than texts)."""
        index: dict[str, int] = {}
        seq: list[int] = []
        ends = [0]
        for text in texts:
            if text:
                seq.extend(index.setdefault(w, len(index)) for w in self.split.findall(text))
            ends.append(len(seq))
        ids, begin = self.words([w.encode("utf-8", "surrogatepass") for w in index])
        order = np.array(seq, np.int64)
        count = (begin[1:] - begin[:-1])[order] if len(order) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        take = np.repeat(begin[order] - total[:-1], count) + np.arange(total[-1]) if len(order) else np.zeros(0, np.int64)
        return ids[take], total[np.array(ends)]


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_texts(df: DataFrame, key: str, text: str, ranks_path: str | None = None) -> DataFrame:
    """(key, ids): ids of every text. The table of the vocabulary is broadcast: its size is fixed by the vocabulary
    (about 6 MB), whatever the corpus. No shuffle but the spreading of rows over the tasks."""
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(PairTable(load_ranks(ranks_path or os.path.join(TOKENIZER_DIR, "byte_bpe_50k.tiktoken"))))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(table.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to] or "") <= BATCH_CHARS):
                    chars += len(texts[to] or "")
                    to += 1
                ids, begin = enc.encode(texts[at:to])
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([keys.slice(at, to - at), lists], ["key", "ids"])
                at = to

    out = spread(df.select(df[key].alias("key"), df[text].cast("string").alias("text"))).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens of each source, as training budgets need them."""
    from pyspark.sql import functions as F

    docs = read_table(spark, sf_dir, "documents")
    n = encode_texts(docs, "doc_id", "text").select("doc_id", F.size("ids").alias("n"))
    src = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return n.join(src, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").cast("long").alias("tokens"))
