"""Token counts under a unigram model: pre-tokens share their prefixes in a trie, and so its forward scores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import text as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x20  # stands before every pre-token, as the vocabulary's word mark
TRIE_BYTES = 64  # longer pre-tokens are scored alone
UNIT = 10_000  # scores are whole multiples of 1/UNIT nats, so sums are exact


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: bytes and score of every piece, and the score of a byte that no piece covers."""

    pieces: tuple[bytes, ...]
    scores: tuple[int, ...]
    fallback: int


def load(path: str = MODEL) -> Pieces:
    """Pieces of a vocabulary file. Their scores are -log(rank + 2): pieces are filed by falling frequency."""
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=path)
    best: dict[bytes, int] = {}
    for k in range(sp.get_piece_size()):
        if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k)):
            piece = sp.id_to_piece(k).replace("▁", " ").encode()
            best.setdefault(piece, -round(UNIT * math.log(k + 2)))
    return Pieces(tuple(best), tuple(best.values()), min(best.values()) - 10 * UNIT)


class Table:
    """Pieces by length: sorted hashes and values. A value is score * 2^20 - 1, so that of equal scores fewer tokens win."""

    def __init__(self, p: Pieces):
        self.known = dict(zip(p.pieces, p.scores, strict=True))
        self.fallback = (p.fallback << 20) - 1
        self.longest = max((len(x) for x in p.pieces), default=1)
        self.keys, self.values, self.filter = {}, {}, {}
        for n in sorted({len(x) for x in p.pieces}):
            own = [x for x in p.pieces if len(x) == n]
            data = np.frombuffer(b"".join(own), np.uint8)
            at = np.arange(len(own)) * n
            h = T.span_hash(data, at, at + n)
            order = np.argsort(h)
            self.keys[n] = h[order]
            self.values[n] = (np.array([self.known[x] for x in own], np.int64)[order] << 20) - 1
            self.filter[n] = np.zeros(1 << 16, bool)
            self.filter[n][(h & np.uint64(0xFFFF)).astype(np.int64)] = True

    def alone(self, word: bytes) -> int:
        """Token count of one pre-token by the plain recurrence."""
        best, count = [0], [0]
        for end in range(1, len(word) + 1):
            top, n = best[end - 1] + self.fallback, count[end - 1] + 1
            for k in range(1, min(end, self.longest) + 1):
                s = self.known.get(word[end - k : end])
                if s is not None and best[end - k] + (s << 20) - 1 > top:
                    top, n = best[end - k] + (s << 20) - 1, count[end - k] + 1
            best.append(top)
            count.append(n)
        return count[-1]

    def shared(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Token counts of distinct pre-tokens in `data`, all at once along the levels of their trie.

        A level's nodes are the distinct prefixes of that length. Each gets its forward score once,
        from its ancestors' scores and the pieces that end in it; a pre-token ends at a node and
        takes the node's count.
        """
        sums = T.ByteSums(data)
        out = np.zeros(len(start), np.int64)
        node = {0: np.zeros(len(start), np.int64)}
        best, count = {0: np.zeros(1, np.int64)}, {0: np.zeros(1, np.int64)}
        active = np.arange(len(start))
        for d in range(1, int(size.max(initial=0)) + 1):
            active = active[size[active] >= d]
            h = sums.hash(start[active], start[active] + d)
            _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            node[d] = np.zeros(len(start), np.int64)
            node[d][active] = inverse
            word = active[first]
            end = start[word] + d
            up = node[d - 1][word]
            score, n = best[d - 1][up] + self.fallback, count[d - 1][up] + 1
            for k, keys in self.keys.items():
                if k > d:
                    break
                sub = sums.hash(end - k, end)
                may = np.flatnonzero(self.filter[k][(sub & np.uint64(0xFFFF)).astype(np.int64)])
                at = np.minimum(np.searchsorted(keys, sub[may]), len(keys) - 1)
                hit = keys[at] == sub[may]
                may, at = may[hit], at[hit]
                up = node[d - k][word[may]]
                value = best[d - k][up] + self.values[k][at]
                win = value > score[may]
                score[may[win]], n[may[win]] = value[win], count[d - k][up[win]] + 1
            best[d], count[d] = score, n
            done = active[size[active] == d]
            out[done] = n[node[d][done]]
            for old in (node, best, count):
                old.pop(d - self.longest, None)
        return out

    def counts(self, s: T.Slice, w: T.Words) -> np.ndarray:
        """Token count of every word of a slice; equal words are inserted once."""
        key = T.span_hash(s.data, w.start, w.end)
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        lo, size = w.start[first], w.end[first] - w.start[first] + 1
        begin = np.concatenate([[0], np.cumsum(size)])
        source = np.arange(begin[-1]) - np.repeat(begin[:-1], size) + np.repeat(lo, size) - 1
        data = s.data[np.maximum(source, 0)] if len(s.data) else s.data
        data = data.copy()
        data[begin[:-1]] = MARK
        short = size <= TRIE_BYTES
        out = np.zeros(len(first), np.int64)
        out[short] = self.shared(data, begin[:-1][short], size[short])
        for k in np.flatnonzero(~short):
            out[k] = self.alone(data[begin[k] : begin[k + 1]].tobytes())
        return out[inverse]


def count_tokens(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pretokens, n_tokens) per input row: tokens of the best segmentation of every pre-token.

    A pre-token is a run of bytes other than space and \\x09-\\x0D behind a word mark. Its best
    segmentation has the greatest sum of piece scores, and among equals the fewest tokens; a byte
    that no piece covers is a token at the fallback score. Null and empty texts have 0 of both; null
    ids are counted too; repeated rows are counted each; an empty table gives an empty result. Whole
    texts count, a megabyte at a time or a longer text at once; no row is shuffled. Other columns of
    the input are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(pieces)
        for b in batches:
            for s in T.slices(b.column(1)):
                w = T.words(s)
                n = np.concatenate([[0], np.cumsum(table.counts(s, w))])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.first, s.last - s.first), pa.array(np.diff(w.row_start)), pa.array(np.diff(n[w.row_start]))],
                    ["_id", "n_pretokens", "n_tokens"],
                )

    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return d.mapInArrow(count, "_id long, n_pretokens long, n_tokens long").withColumnRenamed("_id", id_col)
