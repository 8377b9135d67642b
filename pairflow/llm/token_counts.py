"""Token counts by a SentencePiece BPE model: Arrow functions that return lengths only.

The library sees a text as one string in which blanks are a mark, with one mark put in front. Pieces of the
model hold that mark at their start only, so no merge crosses from another character into a mark, and none
holds a line feed; both are checked when the model is loaded. These are the safe boundaries: a text's count is
the sum over its space-delimited words, with the first word of a line encoded behind a line feed, whose own
tokens are taken off. Long texts thus never reach the library whole, and words recur, so their counts are kept
in a bounded memo. New words go to the library in batches of equal bytes.

Results for odd input: a null text counts as empty, with 0 bytes and 0 tokens; repeated rows get a row each; a
null id stays null; only the two named columns are read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
import sentencepiece
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from pairflow.llm import textkit, worker

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS_KEPT, WORD_CHARS = 500_000, 64  # of each of two generations, about 80 MB; longer words are never kept
BATCH_BYTES = 1 << 20
MARK = "▁"
RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_BEHIND_BLANKS = re.compile(r" +[^ ]*")


class Counter:
    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        mark = self.model.encode("a", out_type=str)
        self.splits = (mark[0].startswith(MARK) and not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces)
                       and len(self.model.encode("\n")) == 2 and len(self.model.encode("  ")) != 0)
        self.counts: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        """Keys whose counts, and one for each line feed, add up to the text's count."""
        out: list[str] = []
        for i, line in enumerate(text.replace(MARK, " ").split("\n")):
            if i == 0:
                if not line:
                    if text:
                        out.append("")  # the mark in front stands alone
                    continue
                line = " " + line
            elif not line:
                continue
            elif line[0] != " ":
                head, blank, rest = line.partition(" ")
                out.append("\n" + head)
                line = blank + rest
            if "  " in line or line[-1:] == " ":
                out += [x[1:] for x in _BEHIND_BLANKS.findall(line)]
            elif line:
                out += line[1:].split(" ")
        return out

    def learn(self, keys: list[str]) -> dict[str, int]:
        """Counts of new keys, in batches of about BATCH_BYTES; those of long keys are given back, the others kept."""
        long: dict[str, int] = {}
        for a, b in textkit.slices([len(k) for k in keys], BATCH_BYTES):
            part = keys[a:b]
            for key, ids in zip(part, self.model.encode(part, num_threads=1)):
                # Behind a line feed: without the mark in front and the line feed. An empty key is a lone mark.
                kept = self.counts if len(key) <= WORD_CHARS else long
                kept[key] = 1 if key == "" else len(ids) - 2 if key[0] == "\n" else len(ids)
        return long

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [len(ids) for a, b in textkit.slices([len(t) for t in texts], BATCH_BYTES)
                    for ids in self.model.encode(texts[a:b], num_threads=1)]
        keyed = [self.words(t) for t in texts]
        if len(self.counts) > WORDS_KEPT:
            self.older, self.counts = self.counts, {}
        known, older = self.counts, self.older
        new = set().union(*keyed) - known.keys()
        again = new & older.keys()
        known.update((k, older[k]) for k in again)
        long = self.learn(list(new - again))
        if long:
            return [sum(long[k] if k in long else known[k] for k in keys) + t.count("\n") for keys, t in zip(keyed, texts)]
        return [sum(map(known.__getitem__, keys)) + t.count("\n") for keys, t in zip(keyed, texts)]


def counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker.kept(("token_counts", path), lambda: Counter(path))
        for batch in batches:
            sizes, tokens = [], []
            lengths = [0 if t is None else t for t in pa.compute.binary_length(batch.column(1)).to_pylist()]
            for a, b in textkit.slices(lengths, BATCH_BYTES):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                sizes += lengths[a:b]
                tokens += own.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, RESULT)
