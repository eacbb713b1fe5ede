"""Token counts: lengths of batch encodings, in Arrow functions.

A text is cut at its spaces, tabs and line feeds, which the tokenizer itself
drops between words, so no token spans a cut.  A piece such as ``word,`` falls
further into its letters and its trailing marks, which the tokenizer separates
as well.  Unseen pieces are encoded in batches of about equal bytes, only their
lengths are kept, and a worker remembers them in a table of bounded size.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MARKS = ".,;:!?"  # ASCII marks that neither the tokenizer's contractions nor its special strings hold
BATCH_BYTES = 1 << 18
REMEMBERED = 1 << 19  # pieces a worker keeps; then it starts over


class Lengths:
    """Token counts of texts, for an encoder ``list of pieces -> list of counts`` and its special strings."""

    def __init__(self, encode: Callable[[list[str]], list[int]], special: Iterable[str] = ()):
        self._encode, self._whole, self._part = encode, {}, {}
        self._special = re.compile("|".join(map(re.escape, special)) or r"(?!)", re.I)

    def _parts(self, piece: str) -> tuple[str, str]:
        """The piece as letters and trailing marks; a piece whose cut is not certain stays whole.

        So does one with a special string in any case of letters: the tokenizer takes those as they are written.
        """
        if self._special.search(piece):
            return piece, ""
        letters = piece.rstrip(MARKS)
        marks = piece[len(letters):]
        if letters.isascii():
            return (letters.lower(), marks) if letters and letters[-1].isalpha() else (piece, "")
        normal = unicodedata.normalize("NFC", letters).lower()  # may end in an accent, which would join the marks
        return (letters, marks) if normal[-1].isalpha() else (piece, "")

    def _learn(self, unseen: set[str]) -> None:
        parts = {p: self._parts(p) for p in unseen}
        todo = sorted({x for pair in parts.values() for x in pair if x not in self._part}, key=len)
        batch, held = [], 0
        for i, x in enumerate(todo):  # of similar length, so that batches are even
            batch.append(x)
            held += 4 * len(x)
            if held >= BATCH_BYTES or i == len(todo) - 1:
                self._part.update(zip(batch, self._encode(batch)))
                batch, held = [], 0
        self._whole.update((p, self._part[a] + self._part[b]) for p, (a, b) in parts.items())

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        pieces = text.replace("\n", " ").replace("\t", " ").split(" ")
        if len(self._whole) > REMEMBERED or len(self._part) > REMEMBERED:
            self._whole, self._part = {}, {}
        unseen = {p for p in set(pieces) if p not in self._whole}
        if unseen:
            self._learn(unseen)
        return sum(map(self._whole.__getitem__, pieces))


_loaded: dict[str, Lengths] = {}


def lengths(name: str) -> Lengths:
    """The counter of a public tokenizer file, one per worker."""
    if name not in _loaded:
        import public_tokenizers
        path = public_tokenizers.path(name)
        if name.endswith(".json"):
            import os
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work to cores
            from tokenizers import Tokenizer
            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            special = [t.content for t in model.get_added_tokens_decoder().values()]
            _loaded[name] = Lengths(lambda pieces: [len(e.ids) for e in model.encode_batch_fast(pieces, add_special_tokens=False)], special)
        else:
            raise ValueError(f"no counter for {name}: its pieces depend on the white space around them")
    return _loaded[name]


def count_tokens(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row; a null or empty text has no bytes and no tokens.

    Repeated rows are counted each; an empty table gives an empty table.  The
    tokenizer must separate words at white space and drop it, as the word-level
    vocabularies do.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = lengths(name)
        for b in slices(batches, "text", 4 << 20):
            counts = [counter.count(t.as_py()) for t in b.column("text")]
            yield pa.record_batch([b.column("id"), b.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                        F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
