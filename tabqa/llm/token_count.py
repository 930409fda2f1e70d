"""Token counts by batch encoding in an Arrow function that returns lengths only.

Texts are cut at ASCII white space, a safe boundary for a tokenizer whose
pre-tokenizer drops white space and never matches across it: the tokens of a
text are those of its pieces.  Each task keeps a bounded memo of the lengths of
pieces; the pieces of an Arrow batch that it lacks are encoded together, in
batches balanced by bytes, so a text of any length costs memory in proportion to
one Arrow batch.  A memo that is full starts anew, which costs time, not results.

A tokenizer whose white space matters (byte-level BPE with spaces, sentencepiece)
has ``safe_split=False``: whole texts are encoded, in batches balanced by bytes.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows that repeat a
doc_id are counted each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabqa.llm.common import ship

ship(__name__)


@dataclass(frozen=True)
class TokenParams:
    tokenizer: str  # path of a tokenizer file, the same on every executor
    limit: int = 2048
    safe_split: bool = True
    batch_bytes: int = 1 << 20  # bytes encoded at once
    memo_pieces: int = 300_000  # pieces remembered by a task
    memo_piece_chars: int = 64  # longer pieces are not remembered


def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """Lengths of a batch of texts, by the library that the file belongs to."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def batches(texts: Iterable[str], limit: int) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters; a longer text is a run of its own."""
    run: list[str] = []
    size = 0
    for t in texts:
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


class Counter:
    """Lengths of texts in tokens, with a memo of pieces."""

    def __init__(self, p: TokenParams):
        self.p, self.encode, self.memo = p, encoder(p.tokenizer), {}

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.p.safe_split:
            return [n for run in batches(texts, self.p.batch_bytes) for n in self.encode(run)]
        memo, split = self.memo, [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        fresh = list({w for words in split for w in words if w not in memo})
        lengths = {}
        for run in batches(fresh, self.p.batch_bytes):
            lengths.update(zip(run, self.encode(run), strict=True))
        if len(memo) + len(lengths) > self.p.memo_pieces:
            memo = {w: memo[w] for words in split for w in words if w in memo}  # what this batch needs
        memo.update(lengths)
        out = [sum(map(memo.__getitem__, words)) for words in split]
        self.memo = {} if len(memo) > self.p.memo_pieces else memo
        for w in fresh:
            if len(w) > self.p.memo_piece_chars:
                self.memo.pop(w, None)
        return out


def count_tokens(docs: DataFrame, p: TokenParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` for every row."""

    def lengths(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(p)
        for b in parts:
            texts, at = b.column("text"), 0
            while at < b.num_rows:  # rows of about batch_bytes at a time
                to, size = at, 0
                while to < b.num_rows and (to == at or size < 4 * p.batch_bytes):
                    size += b.column("n_bytes")[to].as_py()
                    to += 1
                n = counter([t or "" for t in texts.slice(at, to - at).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("id").slice(at, to - at), b.column("n_bytes").slice(at, to - at), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])
                at = to

    x = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = dict(x.dtypes)["id"]
    return x.mapInArrow(lengths, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > p.limit)
