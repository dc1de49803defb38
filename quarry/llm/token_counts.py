"""Token counts under a unigram model, by a trie over distinct pre-tokens.

A pre-token is a word with a leading word mark. The best segmentation of a
prefix does not depend on what follows, so distinct pre-tokens are put in a
trie and the forward scores (Viterbi over pieces) are computed once for each
node, that is, once for each shared prefix; a node at which a pre-token ends
keeps its count of tokens. The trie is built level by level over sorted words,
so a level's nodes are handled as arrays. Terminal counts stay in the worker
and serve every later text.

The vocabulary is that of a public piece file. It has merge ranks and no
probabilities, so a piece's unigram score is Zipf's: minus the log of its rank.
A character that no piece covers costs FALLBACK more than the rarest piece and
counts as its UTF-8 bytes. Of equal scores the fewest tokens win.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import spans

MARK = "▁"
FALLBACK = 10.0
#: Longer pre-tokens (bytes) are scored one by one; terminal counts kept by a worker.
LONGEST_IN_TRIE, MOST_KEPT = 64, 1_000_000


def vocabulary(model_file: str) -> dict[bytes, float]:
    """Pieces (UTF-8) and scores; control, unknown and single-byte pieces left out."""
    import sentencepiece

    tool = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [tool.id_to_piece(i) for i in range(tool.get_piece_size()) if not (tool.is_control(i) or tool.is_unknown(i) or tool.is_byte(i) or tool.is_unused(i))]
    return {p.encode(): -float(np.log(rank + 1)) for rank, p in enumerate(pieces, 1)}


class Unigram:
    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.lost = min(scores.values(), default=0.0) - FALLBACK
        self.known: dict[str, int] = {}
        self.table = None

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "table": None}

    def _table(self):
        if self.table is None:
            keys = list(self.scores)
            data, at = spans.flat(pa.array(keys, pa.binary()))
            h = spans.hashes(spans.prefix_sums(data), at[:-1], at[1:]) if keys else np.zeros(0, np.uint64)
            order = np.argsort(h)
            bits = np.zeros(1 << 20, bool)
            bits[(h >> np.uint64(44)).astype(np.int64)] = True
            self.table = h[order], np.array([self.scores[keys[i]] for i in order]), bits
        return self.table

    def one(self, word: bytes) -> int:
        """Tokens of one word, by the plain recurrence."""
        best = [(0.0, 0)] + [(-np.inf, 0)] * len(word)
        for e in range(1, len(word) + 1):
            if e < len(word) and word[e] & 0xC0 == 0x80:
                continue
            s = e - 1
            while word[s] & 0xC0 == 0x80:
                s -= 1
            options = [(best[s][0] + self.lost, -(best[s][1] + e - s))]
            for s in range(max(0, e - self.longest), e):
                if (x := self.scores.get(word[s:e])) is not None:
                    options.append((best[s][0] + x, -(best[s][1] + 1)))
            x = max(options)
            best[e] = x[0], -x[1]
        return best[-1][1]

    def trie(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each of the sorted distinct words, none over LONGEST_IN_TRIE bytes."""
        keys, values, bits = self._table()
        n, deep = len(words), max(map(len, words))
        size = np.array([len(w) for w in words])
        letters = np.zeros((n, deep), np.uint8)
        letters[np.arange(deep) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        up, down = spans.powers(deep + 1)
        sums = np.zeros((n, deep + 1), np.uint64)
        np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * up[:deep], axis=1, out=sums[:, 1:])
        # a word opens a node at each depth beyond what it shares with the word before
        shared = np.zeros(n, np.int64)
        if n > 1:
            shared[1:] = np.cumprod((letters[1:] == letters[:-1]) & (np.arange(deep) < np.minimum(size[1:], size[:-1])[:, None]), axis=1).sum(1)
        node = np.zeros((n, deep + 1), np.int32)  # of each word's prefixes
        score, count = [np.zeros(1)], [np.zeros(1, np.int64)]
        for d in range(1, deep + 1):
            has = size >= d
            opens = has & (shared < d)
            node[:, d] = np.cumsum(opens) - 1
            own = np.flatnonzero(opens)
            best, tokens = np.full(len(own), -np.inf), np.zeros(len(own), np.int64)
            ends = np.ones(len(own), bool)  # at the end of a character
            if d < deep:
                more = np.flatnonzero(size[own] > d)
                ends[more] = letters[own[more], d] & 0xC0 != 0x80
            for length in range(1, min(d, max(self.longest, 4)) + 1):
                s = d - length
                before, at = score[s][node[own, s]], count[s][node[own, s]]
                first = letters[own, s]
                if length <= 4:  # the last character alone, as bytes
                    width = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
                    alone = ends & (first & 0xC0 != 0x80) & (width == length)
                    self._better(best, tokens, alone, before + self.lost, at + length)
                if length <= self.longest:
                    h = spans.mix((sums[own, d] - sums[own, s]) * down[s])
                    maybe = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
                    k = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
                    ok = keys[k] == h[maybe]
                    hit = np.zeros(len(own), bool)
                    hit[maybe[ok]] = True
                    add = np.zeros(len(own))
                    add[maybe[ok]] = values[k[ok]]
                    self._better(best, tokens, hit & ends, before + add, at + 1)
            score.append(best)
            count.append(tokens)
        return np.array([count[s][node[i, s]] for i, s in enumerate(size)], np.int64)

    @staticmethod
    def _better(best, tokens, where, value, count) -> None:
        take = where & ((value > best) | ((value == best) & (count < tokens)))
        best[take], tokens[take] = value[take], count[take]

    def counts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        cut = [t.split() if t else [] for t in texts]
        if len(self.known) > MOST_KEPT:
            self.known.clear()
        new = set().union(*cut).difference(self.known)
        marked = sorted(((MARK + w).encode(), w) for w in new)
        inner = [x for x in marked if len(x[0]) <= LONGEST_IN_TRIE]
        if inner:
            self.known.update(zip((w for _, w in inner), self.trie([b for b, _ in inner]).tolist(), strict=True))
        self.known.update((w, self.one(b)) for b, w in marked if len(b) > LONGEST_IN_TRIE)
        return [(len(ws), sum(map(self.known.__getitem__, ws))) for ws in cut]


def token_counts(docs: DataFrame, model: Unigram, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep, n_pretokens and n_tokens of each row's whole text (null or blank: 0 and 0).

    Rows are counted alone: repeated rows agree, null ids are kept, an empty table stays empty. Other columns are left out.
    """
    schema = docs.select(*keep).schema.add("n_pretokens", "long").add("n_tokens", "long")

    def run(parts):
        for part in parts:
            out = []
            for i, j in spans.batches(part.column("__text"), 8 << 20):
                out += model.counts(part.column("__text").slice(i, j - i).to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array([r[k] for r in out], pa.int64()) for k in (0, 1))], [*keep, "n_pretokens", "n_tokens"])

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = Unigram(vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), model, ["doc_id"])
