"""Operator 8: token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots (pieces that begin a word, pieces that continue one). Each node carries
a failure link and the precomputed number of pieces that are popped when it is taken; a word's greedy
longest-match-first length then follows from one pass over its characters, without building a piece.
Characters that no piece holds cost their UTF-8 bytes (byte fallback) and are passed over.

Defined cases: null and empty texts have no words and no tokens; repeated rows count alike; a word of any
length takes time in proportion to it; other columns pass through, and on a clash an added column gets a
trailing underscore.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name, map_text

#: Marks the beginning of a word in the vocabulary file.
WORD_START = "▁"
#: Words remembered by a worker, and the longest word that is; beyond it the memory starts anew.
MEMO_WORDS, MEMO_LENGTH = 200_000, 48


def load_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model (no control, unknown or byte pieces)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class LongestMatch:
    """Greedy longest-match lengths of words over ``pieces``."""

    def __init__(self, pieces: list[str]):
        # Node 0 is the beginning of a word (WORD_START already read or not is part of the trie), node 1 its rest.
        self.next: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for piece in pieces:
            node = 0 if piece[0] == WORD_START else 1
            for c in piece:
                found = self.next[node].get(c)
                if found is None:
                    found = self.next[node][c] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = found
            ends[node] = True
        self.fail = [-1] * len(self.next)
        self.pops = [0] * len(self.next)
        queue = [0, 1]
        for node in queue:  # grows while it is read: breadth first
            for c, child in self.next[node].items():
                queue.append(child)
                if ends[child]:
                    self.fail[child], self.pops[child] = 1, 1
                    continue
                # Without the child's last character, pop pieces until it fits; at the root it costs its bytes.
                at, popped = (self.fail[node], self.pops[node]) if node > 1 else (-1, 0)
                while at > 1 and c not in self.next[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at >= 0 and c in self.next[at]:
                    self.fail[child], self.pops[child] = self.next[at][c], popped
                else:
                    self.fail[child], self.pops[child] = 1, popped + len(c.encode("utf-8"))

    def count(self, word: str) -> int:
        """Number of pieces of one word."""
        step, fail, pops = self.next, self.fail, self.pops
        node, n = step[0].get(WORD_START, -1), 0
        if node < 0:
            raise ValueError("the vocabulary lacks the word mark")
        for c in word:
            while (found := step[node].get(c, -1)) < 0:
                if node == 1:
                    n += len(c.encode("utf-8"))
                    found = 1
                    break
                n += pops[node]
                node = fail[node]
            node = found
        return n + self._rest(node)

    def _rest(self, node: int) -> int:
        n = 0
        while node > 1:
            n += self.pops[node]
            node = self.fail[node]
        return n


@lru_cache(maxsize=4)
def automaton(path: str) -> LongestMatch:
    """The automaton of a vocabulary file, built once in each process."""
    return LongestMatch(load_pieces(path))


def count_tokens(df: DataFrame, vocab_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_words`` (words between white space) and ``n_tokens`` (their pieces)."""
    added = {free_name(df, c, keep): T.LongType() for c in ("n_words", "n_tokens")}

    def make():
        count, memo = automaton(vocab_path).count, {}

        def tokens(word):
            n = count(word)
            if len(word) <= MEMO_LENGTH:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                memo[word] = n
            return n

        def work(texts):
            words = [(t or "").split() for t in texts]
            get = memo.get
            return [[len(w) for w in words], [sum(get(x) or tokens(x) for x in w) for w in words]]

        return work

    return map_text(df, text_col, added, make, keep)
