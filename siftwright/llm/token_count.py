"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.hashing import column_bytes
from siftwright.llm.workspace import unused

_SAFE = re.compile(r"\S(?=[ \t\n\r])")
_LOADED: dict[str, tuple] = {}


def tokenizer_path(name: str) -> str:
    """Where this machine has a public tokenizer's file; a path is returned as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _load(name: str) -> tuple:
    """(kind, tokenizer, whether texts can be split) of a file, once for each worker."""
    if name not in _LOADED:
        path = tokenizer_path(name)
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[name] = ("piece", sentencepiece.SentencePieceProcessor(model_file=path), False)
        else:
            import json
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
            from tokenizers import Tokenizer

            own = json.load(open(path, encoding="utf-8"))
            before = own.get("pre_tokenizer") or {}
            plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not own.get("normalizer")
            # an added token could span or swallow white space; then nothing is split
            plain &= all(not (t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])) for t in own.get("added_tokens", []))
            _LOADED[name] = ("json", Tokenizer.from_file(path), plain)
            _LOADED[name][1].no_truncation()
            _LOADED[name][1].no_padding()
    return _LOADED[name]


def split_safely(text: str, most: int) -> list[str]:
    """Pieces of about ``most`` characters, cut only between a non-space and a white space.

    A byte-level pre-tokenizer never joins white space to what stands before it, so the
    tokens of the pieces are those of the text. A text without such a place stays whole.
    """
    pieces, at = [], 0
    while len(text) - at > most:
        cut = _SAFE.search(text, at + most - 1)
        if not cut or cut.end() >= len(text):
            break
        pieces.append(text[at : cut.end()])
        at = cut.end()
    return [*pieces, text[at:]]


def _lengths(kind: str, tokenizer, texts: list[str]) -> list[int]:
    if kind == "piece":
        return [len(ids) for ids in tokenizer.encode(texts, num_threads=1)]
    return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _counter(name: str, batch_bytes: int, piece_chars: int):
    """Counts of the last column's texts. Texts wait for each other until they fill batch_bytes, across Arrow batches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, tokenizer, can_split = _load(name)
        waiting: list[str] = []
        owners: list[tuple[list[int], int]] = []
        ready: list[tuple[pa.RecordBatch, list[int], list[int]]] = []  # rows that wait for their last pieces
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (totals, i), n in zip(owners, _lengths(kind, tokenizer, waiting), strict=True):
                totals[i] += n
            waiting.clear()
            owners.clear()
            for batch, sizes, totals in ready:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())], names=[*batch.schema.names[:-1], "n_bytes", "n_tokens"])
            ready.clear()

        for batch in batches:
            column = batch.columns[-1]
            _, offsets = column_bytes(column)
            sizes = (offsets[1:] - offsets[:-1]).tolist()
            totals = [0] * len(sizes)
            for i, size in enumerate(sizes):
                if not size:
                    continue
                text = column[i].as_py()
                pieces = split_safely(text, piece_chars) if can_split and size > piece_chars else [text]
                for piece in pieces:
                    waiting.append(piece)
                    owners.append((totals, i))
                    held += size if len(pieces) == 1 else len(piece.encode())
                    if held >= batch_bytes:
                        yield from flush()
                        held = 0
            ready.append((batch, sizes, totals))
            if held >= batch_bytes // 2 or not waiting:
                yield from flush()
                held = 0
        yield from flush()

    return count


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text: str = "text", keep: list[str] | None = None, batch_bytes: int = 1 << 20, piece_chars: int = 1 << 16) -> DataFrame:
    """``docs``' columns ``keep`` (default: all but the text) with n_bytes and n_tokens.

    tokenizer: a file name that public_tokenizers knows on every executor, or a path there:
    .json is read by tokenizers, .model by sentencepiece. Counts are those of the library
    for the whole text, without begin, end or added special tokens; special strings inside
    texts are handled as the library's default does.

    Defined results: a null text counts as an empty one (0 bytes, 0 tokens); repeated rows
    are counted each; an empty table gives no rows; a text of any length is encoded whole,
    in pieces where the tokenizer allows it, ``batch_bytes`` at a time; input columns called
    n_bytes or n_tokens are replaced.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in (text, "n_bytes", "n_tokens")]
    rows = docs.select(*keep, F.col(text).cast("string").alias(unused(docs, "__text")))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "n_bytes long", "n_tokens long"])
    return rows.mapInArrow(_counter(tokenizer, batch_bytes, piece_chars), schema)
