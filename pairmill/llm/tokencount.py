"""Token counts by a count-only Viterbi over a unigram vocabulary (operator 3).

Blanks are written as the mark that starts a word, and one stands before the
text; no piece holds a mark behind another character (runs of marks at a
piece's start there are), so a word is segmented apart with the whole run of
blanks before it, and every different word of a step once. An Aho-Corasick automaton gives all
pieces that end at a position, longest first; the best score and the number of
pieces of the best way there are all that is kept. Ties go to the piece that
starts first, and characters that no piece covers cost the least score less
10, neighbours of them counting as one token: the rules of the tokenizers
library's unigram model.

A null or empty text has 0 tokens. Repeated rows and ids give a row each.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from pairmill.llm import common

MARK = "▁"
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")
#: Below the least score of the vocabulary by which an unknown character stands: the library's value.
UNKNOWN = 10.0
#: Different words that a worker remembers before it starts anew.
MEMORY = 400_000
STEP_CHARS = 4_000_000


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file's ordinary pieces; scores fall with the logarithm of the rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [(p, -float(np.log(i + 2))) for i, p in enumerate(own)]


class Counter:
    """Tokens of texts, words remembered."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(reversed(vocabulary)).items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN
        self.seen: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces on the best way through a word."""
        size = len(word)
        worst = float("-inf")
        best, count, open_ = [worst] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        best[0] = 0.0
        unknown = self.unknown
        at = 0  # ends up to here are settled

        def lone(end: int) -> None:
            """A character that is no piece of its own may end here as unknown."""
            score = best[end - 1] + unknown
            if score > best[end]:
                best[end], open_[end] = score, True
                count[end] = count[end - 1] + (not open_[end - 1])

        single = False
        for last, (length, score) in self.automaton.iter(word):
            end = last + 1
            while at < end:
                if at and not single:
                    lone(at)
                at, single = at + 1, False
            start = end - length
            new = best[start] + score
            if new > best[end]:
                best[end], count[end], open_[end] = new, count[start] + 1, False
            single |= length == 1
        while at < size + 1:
            if at and not single:
                lone(at)
            at, single = at + 1, False
        return count[size]

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.seen) > MEMORY:
            self.seen = {}
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, f"^ |  | $|{MARK}|^$").to_numpy(zero_copy_only=False)
        split = pc.split_pattern(column, " ")
        kinds = split.flatten().dictionary_encode()
        words = kinds.dictionary.to_numpy(zero_copy_only=False).tolist()
        seen = self.seen
        for w in words:
            if w not in seen:
                seen[w] = self.count(MARK + w)
        table = np.fromiter((seen[w] for w in words), np.int64, len(words))
        upto = np.concatenate([[0], np.cumsum(table[kinds.indices.to_numpy(zero_copy_only=False)])])
        offs = split.offsets.to_numpy().astype(np.int64)
        out = np.diff(upto[offs - offs[0]])
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._marked(texts[i].replace(" ", MARK))
        return out

    def _marked(self, text: str) -> int:
        """Tokens of a text in which marks stand for blanks; one that starts with the mark gets no other before it."""
        if not text:
            return 0
        return sum(map(self.count, _RUNS.findall(text if text[0] == MARK else MARK + text)))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(unigram_vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chars, n_tokens of each whole text; row-local."""

    def run(batches):
        count = counter(path)
        for batch in batches:
            for b in common.steps(batch, limit=STEP_CHARS):
                texts = b["text"].to_pylist()
                yield pa.record_batch({"doc_id": b["doc_id"], "n_chars": pa.array([len(t) for t in texts], pa.int64()), "n_tokens": pa.array(count(texts), pa.int64())})

    return common.texts(docs).mapInArrow(run, "doc_id long, n_chars long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
